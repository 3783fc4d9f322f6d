"""Queries over the given tables for every operator of this package, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from headwater.llm import bpe, chunking, encode, leaks, mixing, neardup, overlap, reading, source_files, splits, token_budget
from headwater.session import table


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return overlap.texts_of(table(spark, d, "raw_documents"), table(spark, d, "training_examples"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.close_pairs(*overlap.cross_split(_texts(spark, d)))


def p1_records(spark: SparkSession, d: str) -> DataFrame:
    return overlap.record_report(*overlap.cross_split(_texts(spark, d))).select("kind", "id", "split", "source", "partners", F.round("jaccard", 6).alias("jaccard"))


def p1_coverage(spark: SparkSession, d: str) -> DataFrame:
    return overlap.coverage_report(overlap.record_report(*overlap.cross_split(_texts(spark, d), contained=0.8), contained=0.8))


def _near(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return neardup.near_duplicates(table(spark, d, "raw_documents"), "record_id", "content", k=3, similarity=0.5, least_words=30)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.expand_pairs(*_near(spark, d))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.link_groups(*_near(spark, d)).withColumnRenamed("id", "record_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.torn_records(table(spark, d, "raw_documents"), table(spark, d, "key_aliases"))


def p3_assign(spark: SparkSession, d: str) -> DataFrame:
    return splits.assign_splits(table(spark, d, "raw_documents"), table(spark, d, "key_aliases"), table(spark, d, "split_targets"))


def p4_budget(spark: SparkSession, d: str) -> DataFrame:
    return token_budget.token_budget(*(table(spark, d, t) for t in ("documents", "training_examples", "raw_documents", "mix_targets")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return chunking.oversized_items(table(spark, d, "raw_documents"), "record_id", "content").select(F.col("id").alias("record_id"), "cut")


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return chunking.split_oversized(table(spark, d, "raw_documents"), "record_id", "content").withColumnRenamed("id", "record_id")


def p5_check(spark: SparkSession, d: str) -> DataFrame:
    """Per text: its length, the characters that its pieces add one after another, and pieces that are too long or overlap too much or not at all."""
    pieces = chunking.split_oversized(table(spark, d, "raw_documents"), "record_id", "content")
    before = F.lag("end_at").over(Window.partitionBy("id").orderBy("piece_no"))
    pieces = pieces.select("id", "begin_at", "end_at", F.length("piece").alias("n"), before.alias("before"))
    wrong = (F.col("n") != F.col("end_at") - F.col("begin_at")) | (F.col("n") > 6000) | (F.col("begin_at") > F.col("before")) | (F.col("before") - F.col("begin_at") > 200) | (F.col("before") >= F.col("end_at"))
    return pieces.groupBy(F.col("id").alias("record_id")).agg(
        F.max("end_at").alias("chars"), F.sum(F.col("end_at") - F.greatest("begin_at", F.coalesce("before", F.lit(0)))).alias("covered"), F.sum(F.coalesce(wrong, F.lit(False)).cast("long")).alias("wrong")
    )


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return source_files.classify_files(table(spark, d, "repo_files")).where(F.size("kinds") > 0).select("file_id")


def p6_kinds(spark: SparkSession, d: str) -> DataFrame:
    return source_files.classify_files(table(spark, d, "repo_files")).select("file_id", "lang", F.array_join("kinds", ",").alias("kinds"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.short_sources(table(spark, d, "training_examples"), table(spark, d, "mix_targets"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_report(table(spark, d, "training_examples"), table(spark, d, "mix_targets"))


def p7_blocks(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixed_blocks(table(spark, d, "training_examples"), table(spark, d, "mix_targets"), vocabulary=bpe.vocabulary_path())


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_corpus(table(spark, d, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_passages(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items")).select("doc_id", "item_id").distinct()


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    """Per item: the documents it leaked into, and in how many of them most of its question and answer stand beside it."""
    hits = leaks.leaked_passages(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"))
    most = lambda c: F.coalesce(F.sum((F.col(c) >= 0.8).cast("long")), F.lit(0)).alias(f"with_{c}")
    return hits.groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.max("words").alias("most_words"), most("question"), most("answer"))


def _levels(spark: SparkSession, d: str) -> DataFrame:
    return reading.reading_levels(table(spark, d, "documents"), "doc_id", "text", reading.train(table(spark, d, "reading_samples")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return reading.demanding(_levels(spark, d)).withColumnRenamed("id", "doc_id")


def p10_levels(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d).withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_records, p1_coverage, p2_found, p2_groups, p3_found, p3_assign, p4_budget, p5_found, p5_pieces, p5_check, p6_found, p6_kinds, p7_found, p7_mix, p7_blocks, p8_ids, p9_found, p9_report, p10_found, p10_levels)
}

_REPO = r"regexp_replace(regexp_replace(regexp_replace(lower(trim({0})), '^[a-z][a-z0-9+.-]*://[^/]*/+', ''), '^[^/@:\s]+@[^/:\s]+:/*', ''), '(\.git)?/*$', '')"
_TITLE = r"trim(regexp_replace(lower(nfc_normalize(url_decode({0}))), '[\s_\x{{00a0}}]+', ' ', 'g'))"

# Texts (kind, id, split, text) to pairs of close ones; words, runs and similarity as in TESTDATA.md.
_CLOSE = r"""
        words as (select kind, id, split, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from texts where text is not null),
        runs as (select kind, id, split, list_distinct(list_transform(range(1, len(w) - 1), lambda i: concat(w[i], ' ', w[i + 1], ' ', w[i + 2]))) as r from words where len(w) >= 30),
        one as (select kind, id, split, len(r) as n, unnest(r) as run from runs),
        met as (select a.kind, a.id as id_a, b.id as id_b, any_value(a.n) as n_a, any_value(b.n) as n_b, count(*) as shared from one a join one b on a.kind = b.kind and a.run = b.run and a.id < b.id {and} group by all)
        select {columns} from met where shared >= 0.5 * (n_a + n_b - shared)
"""
_ACROSS = "and ((a.split = 'train' and b.split in ('validation', 'test')) or (b.split = 'train' and a.split in ('validation', 'test')))"

ORACLE: dict[str, str] = {
    "p1_found": """
        with texts as (select 'raw' as kind, record_id as id, split, content as text from raw_documents union all
            select 'example', example_id, split, array_to_string([coalesce(m.content, '') for m in messages if lower(trim(m.role)) = 'user'], chr(10)) from training_examples),"""
    + _CLOSE.replace("{and}", _ACROSS).replace("{columns}", "kind, id_a, id_b"),
    "p1_records": """
        with texts as (select 'raw' as kind, record_id as id, split, content as text, source as s from raw_documents union all
            select 'example', example_id, split, array_to_string([coalesce(m.content, '') for m in messages if lower(trim(m.role)) = 'user'], chr(10)), metadata.source from training_examples),"""
    + _CLOSE.replace("{and}", _ACROSS).replace("select {columns} from met", """, pairs as (select kind, id_a, id_b, shared / (n_a + n_b - shared) as j from met""")
    + """), sides as (select kind, id_a as id, j from pairs union all select kind, id_b, j from pairs)
        select r.kind, r.id, r.split, nullif(regexp_replace(lower(any_value(t.s)), '[^\\p{L}\\p{N}]+', '', 'g'), '') as source, count(s.id) as partners, round(max(s.j), 6) as jaccard
        from runs r join texts t on t.kind = r.kind and t.id = r.id left join sides s on s.kind = r.kind and s.id = r.id where r.split in ('validation', 'test') group by r.kind, r.id, r.split""",
    "p2_found": "with texts as (select 'raw' as kind, record_id as id, split, content as text from raw_documents)," + _CLOSE.replace("{and}", "").replace("{columns}", "id_a, id_b"),
    "p2_groups": "with recursive texts as (select 'raw' as kind, record_id as id, split, content as text from raw_documents),"
    + _CLOSE.replace("{and}", "").replace("select {columns} from met", ", pairs as (select id_a, id_b, shared = n_a + n_b - shared as same from met")
    + """), sides as (select id_a as x, id_b as y, same from pairs union all select id_b, id_a, same from pairs),
        reach as (select id as node, id as other from runs union select node, y from reach join sides on other = x),
        grouped as (select node, min(other) as group_id from reach group by node),
        linked as (select x, count(*) as n_links, min(case when same then y end) as twin from sides group by x)
        select node as record_id, least(node, coalesce(twin, node)) as rep, coalesce(n_links, 0) as n_links, group_id from grouped left join linked on x = node""",
    "p3_found": f"""
        with recursive keys as (select record_id, lower(trim(split)) as split, 'repo:' || nullif({_REPO.format("meta.repo")}, '') as r, 'title:' || nullif({_TITLE.format("meta.title")}, '') as t from raw_documents),
        pairs as (select r as a, t as b from keys where r is not null and t is not null
                  union select 'repo:' || {_REPO.format("old_key")}, 'repo:' || {_REPO.format("new_key")} from key_aliases where kind = 'repo'
                  union select 'title:' || {_TITLE.format("old_key")}, 'title:' || {_TITLE.format("new_key")} from key_aliases where kind = 'title'),
        edges as (select a, b from pairs union select b, a from pairs),
        reach as (select a as node, b as other from edges union select x.node, e.b from reach x join edges e on e.a = x.other),
        roots as (select node, least(node, min(other)) as root from reach group by node),
        placed as (select record_id, split, coalesce(root, n.node) as g from (select record_id, split, coalesce(r, t) as node from keys) n left join roots on roots.node = n.node where n.node is not null),
        torn as (select g from placed where split is not null group by g having count(distinct split) > 1)
        select distinct record_id from placed join torn using (g) where split is not null
    """,
    "p5_found": """
        select record_id, case when list_max([length(l) for l in string_split(content, chr(10))]) > 6000 then 'inside' else 'line' end as cut
        from raw_documents where length(content) > 6000
    """,
    "p5_check": "select record_id, length(content) as chars, length(content) as covered, 0::bigint as wrong from raw_documents where length(content) > 6000",
    "p7_found": """
        with sized as (
            select regexp_replace(lower(metadata.source), '[^a-z0-9]', '', 'g') as key,
                   coalesce(list_sum([length(m.content) for m in messages if lower(trim(m.role)) = 'user']), 0) as n
            from training_examples where split = 'train'
        ), total as (select sum(n) as total from sized)
        select t.source from mix_targets t left join (select key, sum(n) as n from sized group by key) s
          on s.key = regexp_replace(lower(t.source), '[^a-z0-9]', '', 'g'), total
        where t.max_repeats * coalesce(s.n, 0) < t.target_share * total.total
    """,
}
