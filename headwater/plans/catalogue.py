"""One query per operator over the given tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headwater.functions import markdown as M
from headwater.functions import metrics as E
from headwater.functions import tokens
from headwater.operators import chat, evaluation, filters, predict, sampling
from headwater.plans import corpus, pipelines
from headwater.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def derived(spark: SparkSession, d: str) -> DataFrame:
    return corpus.derived(table(spark, d, "raw_documents"))


def whole(spark: SparkSession, d: str) -> DataFrame:
    """The real texts."""
    return table(spark, d, "raw_documents").where(F.col("content").isNotNull()).select("record_id", "source", "meta", "content")


@dataclass(frozen=True)
class Corpus:
    """What the structural queries run on, and how much of a text stays."""

    records: Callable[[SparkSession, str], DataFrame]
    head: int
    tail: int
    most_tokens: int
    prompt_tokens: int


#: The derived one has SQL; queries of the name and _full run on the real one under production parameters.
DERIVED, WHOLE = Corpus(derived, 16, 16, 100, 1_000_000), Corpus(whole, 128, 128, 7500, 7500)


def parsed(spark: SparkSession, d: str, on: Corpus = DERIVED) -> DataFrame:
    """The corpus with what the scanner finds in it (found_*), not what it was made of."""
    df = on.records(spark, d).withColumn("spans", M.spans(F.col("content")))
    return df.withColumn("found_titles", M.texts(F.col("spans"))).withColumn("found_levels", M.levels(F.col("spans")))


_D = corpus.SQL
# Pieces, and a text shortened to its first and last ones, in SQL.
_PIECES = "regexp_extract_all({0}, '[ \\t\\r\\n]*[^ \\t\\r\\n]+|[ \\t\\r\\n]+$')"


def _sql_pieces(c: str) -> str:
    return _PIECES.format(c)


def _sql_shorten(c: str, head: int, tail: int) -> str:
    p = _sql_pieces(c)
    return f"case when len({p}) <= {head + tail} then {c} else concat(array_to_string({p}[1:{head}], ''), chr(10), '[...]', chr(10), array_to_string({p}[len({p}) - {tail - 1}:], '')) end"


_BODY = "concat(case when (i - 1) % 3 = 2 then concat('```', chr(10), '# not a heading', chr(10), '```', chr(10), chr(10)) else '' end, 'Body of ', t, ': ', repeat('alpha beta gamma delta ', cast(record_id % 7 * i * 5 as int)), 'end.')"
_STRIPPED = f"array_to_string(list_transform(titles, lambda t, i: concat('# ', t, chr(10), chr(10), {_sql_shorten(_BODY, 16, 16)})), concat(chr(10), chr(10)))"


@query(f"{_D} select record_id, cast(i as bigint) as pos, levels[i] as level, titles[i] as text from (select *, unnest(range(1, len(levels) + 1)) as i from d)")
def m1_extract(spark: SparkSession, d: str, on: Corpus = DERIVED) -> DataFrame:
    return parsed(spark, d, on).select("record_id", F.posexplode("spans").alias("pos", "h")).select("record_id", (F.col("pos") + 1).cast("long").alias("pos"), "h.level", "h.text")


@query(f"{_D} select source, list_max(levels) as max_depth, count(*) as n, cast(sum(len(levels)) as bigint) as headings from d group by all")
def m1_depth_stats(spark: SparkSession, d: str, on: Corpus = DERIVED) -> DataFrame:
    return parsed(spark, d, on).groupBy("source", F.array_max("found_levels").alias("max_depth")).agg(F.count("*").alias("n"), F.sum(F.size("spans").cast("long")).alias("headings"))


@query()
def m1_commonmark_full(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "raw_documents").where(F.col("content").isNotNull()).select("record_id", M.spans(F.col("content")).alias("spans"))
    return df.select("record_id", F.inline("spans"))


@query(
    f"""{_D}, l as (select record_id, string_split(content, chr(10)) as lines from d), n as (select record_id, unnest(range(1, len(lines) + 1)) as i, unnest(lines) as line from l),
        f as (select *, sum(cast(line like '```%' as int)) over (partition by record_id order by i rows unbounded preceding) as fences from n)
        select record_id, cast(i - 1 as int) as line_start, cast(i as int) as line_end from f where fences % 2 = 0 and line similar to '#+ .*'"""
)
def m2_spans(spark: SparkSession, d: str, on: Corpus = DERIVED) -> DataFrame:
    return parsed(spark, d, on).select("record_id", F.inline("spans")).select("record_id", "line_start", "line_end")


@query(f"{_D} select record_id, {_STRIPPED} as stripped from d")
def m3_strip_piece(spark: SparkSession, d: str, on: Corpus = DERIVED) -> DataFrame:
    return parsed(spark, d, on).select("record_id", M.strip_document(F.col("content"), F.col("spans"), on.head, on.tail).alias("stripped"))


@query(f"select doc_id, {_sql_shorten('text', 128, 128)} as short from documents where text is not null")
def m4_truncate_piece(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", tokens.piece_shorten(F.col("text"), 128, 128).alias("short"))


@query(f"{_D} select record_id, cast(len([x for x in string_split(content, chr(10)) if x like '# %']) as bigint) as marks from d")
def m5_count(spark: SparkSession, d: str, on: Corpus = DERIVED) -> DataFrame:
    return on.records(spark, d).select("record_id", M.count_marks(F.col("content")).alias("marks"))


@query(
    f"""{_D}, s as (select record_id, {_STRIPPED} as s from d), p as (select *, {_sql_pieces('s')} as p from s),
        c as (select *, array_to_string(p[1:100], '') as part from p),
        k as (select *, case when strpos(reverse(part), ' #' || chr(10)) > 0 then length(part) - strpos(reverse(part), ' #' || chr(10)) - 1 else 0 end as mark from c),
        e as (select *, strpos(substring(part, mark + 1), chr(10)) as off_end from k)
        select record_id, case when len(p) <= 100 then s when mark > 0 and off_end > 0 then substring(part, 1, mark + off_end - 1) else part end as shortened from e"""
)
def m6_truncate_doc(spark: SparkSession, d: str, on: Corpus = DERIVED) -> DataFrame:
    stripped = parsed(spark, d, on).select("record_id", M.strip_document(F.col("content"), F.col("spans"), on.head, on.tail).alias("stripped"))
    return stripped.select("record_id", tokens.piece_prefix_cut(F.col("stripped"), on.most_tokens).alias("shortened"))


@query(f"{_D} select record_id, replace(content, chr(10) || '#', chr(10) || '#') as same, true as equal from d")
def m7_apply_roundtrip(spark: SparkSession, d: str, on: Corpus = DERIVED) -> DataFrame:
    """Levels flattened to one and written back: the text as it was."""
    df = parsed(spark, d, on)
    flat = M.apply_levels(F.col("content"), F.col("spans"), F.transform("found_levels", lambda x: F.lit(1)))
    back = df.withColumn("flat", flat).withColumn("spans", M.spans(F.col("flat"))).withColumn("same", M.apply_levels(F.col("flat"), F.col("spans"), F.col("found_levels")))
    return back.select("record_id", "same", (F.col("same") == F.col("content")).alias("equal"))


@query(f"{_D} select record_id, list_transform(levels, lambda x, i: case when i <= 3 then 1 else x end) as aligned from d")
def m8_align(spark: SparkSession, d: str, on: Corpus = DERIVED) -> DataFrame:
    """A prediction of three levels at most: the other headings keep their own."""
    return parsed(spark, d, on).select("record_id", M.align_levels(M.headings(F.col("spans")), F.array(F.lit(1), F.lit(1), F.lit(1))).alias("aligned"))


@query(f"select record_id, '# ' || meta.title || chr(10) || chr(10) || content as titled from raw_documents where meta.title is not null and content is not null")
def m9_title(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "raw_documents").where(F.col("meta.title").isNotNull() & F.col("content").isNotNull())
    return df.select("record_id", M.with_title(F.col("meta.title"), F.col("content")).alias("titled"))


@query(f"{_D}, s as (select record_id, list_sort(list_distinct(levels)) as s from d) select record_id, case when len(s) < 2 then 0 else list_max([s[i + 1] - s[i] for i in range(1, len(s))]) end as gap from s")
def m10_gap(spark: SparkSession, d: str, on: Corpus = DERIVED) -> DataFrame:
    return parsed(spark, d, on).select("record_id", M.level_gap(F.col("found_levels")).alias("gap"))


@query(f"{_D} select record_id from d where length(content) between 300 and 150000 and len(levels) between 3 and 120 and len(list_distinct(levels)) >= 2")
def f1_cheap_filter(spark: SparkSession, d: str, on: Corpus = DERIVED) -> DataFrame:
    df = filters.with_spans(filters.length_filter(on.records(spark, d)))
    return df.where(filters.cheap_filters(F.col("content"), M.levels(F.col("spans")))).select("record_id")


@query(f"select doc_id, cast(len({_sql_pieces('text')}) as bigint) as tokens from documents where len({_sql_pieces('text')}) between 100 and 31000")
def f2_token_filter(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "documents").select("doc_id", tokens.piece_count(F.col("text")).alias("tokens"))
    return df.where(filters.token_filter(F.col("tokens")))


@query("select distinct file_id, path from repo_files where lower(path) like '%.md' or lower(path) like '%.markdown'")
def s3_extension(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "repo_files").where(filters.markdown_path(F.col("path"))).select("file_id", "path").distinct()


@query("select distinct file_id, (" + " or ".join(f"contains(lower(path), '{p}')" for p in filters.PRIORITY_PATTERNS) + ") as is_priority from repo_files where path is not null")
def f4_priority_path(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "repo_files").where(F.col("path").isNotNull()).select("file_id", filters.priority_path(F.col("path")).alias("is_priority")).distinct()


_BUCKET = "case " + " ".join(f"when length(content) >= {lo} and length(content) < {hi} then '{x}'" for x, (lo, hi) in filters.BUCKET_RANGES.items()) + " end"


@query(f"select {_BUCKET} as bucket, count(*) as n, cast(sum(length(content)) as bigint) as chars from raw_documents group by 1")
def f5_char_bucket(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_documents").groupBy(filters.char_bucket(F.col("content")).alias("bucket")).agg(F.count("*").alias("n"), F.sum(F.length("content").cast("long")).alias("chars"))


_EXAMPLE = f"""{_D}, s as (select *, {_STRIPPED} as stripped from d),
    v as (select *, len([x for x in string_split(stripped, chr(10)) if x like '# %']) as marks from s),
    ex as (select record_id, source, meta, stripped, titles[1:marks] as titles, levels[1:marks] as levels from v where marks > 0)"""


def _examples(spark: SparkSession, d: str, on: Corpus = DERIVED) -> DataFrame:
    return chat.build_examples(parsed(spark, d, on).drop("titles", "levels"), head=on.head, tail=on.tail, most_tokens=on.prompt_tokens)


@query(f"{_EXAMPLE} select record_id, levels from ex")
def f7_visible_prefix(spark: SparkSession, d: str, on: Corpus = DERIVED) -> DataFrame:
    return _examples(spark, d, on).select("record_id", "levels")


@query(
    f"""{_EXAMPLE} select record_id, source, cast(len({_sql_pieces('stripped')}) as int) as token_count, cast(len(levels) as int) as heading_count, list_max(levels) as max_depth,
        list_min(levels) as min_depth, coalesce(meta.max_level_gap, 0) as max_level_gap, meta.repo as repo, meta.title as title from ex"""
)
def f8_metadata(spark: SparkSession, d: str, on: Corpus = DERIVED) -> DataFrame:
    return _examples(spark, d, on).select("record_id", *(f"metadata.{c}" for c in ("source", "token_count", "heading_count", "max_depth", "min_depth", "max_level_gap", "repo", "title")))


_QUOTA = {"< 4k": 200, "4k-8k": 100, "8k-16k": 50, "16k-32k": 10}


@query(
    f"select record_id, bucket from (select record_id, {_BUCKET} as bucket, row_number() over (partition by {_BUCKET} order by record_id) as place from raw_documents) where place <= case bucket "
    + " ".join(f"when '{x}' then {n}" for x, n in _QUOTA.items()) + " end"
)
def q1_bucket_quota(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "raw_documents").select("record_id", filters.char_bucket(F.col("content")).alias("bucket"))
    return sampling.bucket_quota(df, "record_id", targets=_QUOTA)


@query(
    """with k as (select coalesce(nullif(meta.repo, ''), nullif(meta.title, ''), '') as key, count(*) as n from raw_documents group by 1),
        o as (select *, sum(n) over (order by md5(key || '|42'), key) - n as before, sum(n) over () as total from k),
        t as (select *, before < floor(total * 0.9) as in_train from o), x as (select coalesce(sum(n) filter (where in_train), 0) as taken from t),
        s as (select key, case when in_train then 'train' when before - taken < floor(total * 0.05) then 'validation' else 'test' end as split from t, x)
        select r.record_id, s.split from raw_documents r join s on s.key = coalesce(nullif(r.meta.repo, ''), nullif(r.meta.title, ''), '')"""
)
def q2_split(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "raw_documents").select("record_id", sampling.split_key(F.col("meta.repo"), F.col("meta.title")).alias("key"))
    return sampling.split_by_key(df, "key").select("record_id", "split")


@query(f"{_D} select record_id, unnest(range(1, case when list_max(levels) >= 6 then 8 when list_max(levels) >= 5 then 4 when list_max(levels) >= 4 then 2 else 1 end + 1))::int as copy from d")
def q4_oversample(spark: SparkSession, d: str, on: Corpus = DERIVED) -> DataFrame:
    return sampling.oversample(parsed(spark, d, on).select("record_id", "found_levels"), "found_levels").select("record_id", "copy")


_ANSWER = "array_to_string(list_transform(titles, lambda t, i: concat(repeat('#', levels[i]), ' ', t)), chr(10))"


@query(f"{_D} select record_id, {_ANSWER} as answer from d")
def t1_format(spark: SparkSession, d: str, on: Corpus = DERIVED) -> DataFrame:
    return parsed(spark, d, on).select("record_id", M.format_answer(F.col("found_titles"), F.col("found_levels")).alias("answer"))


@query(f"{_EXAMPLE} select record_id, 'system,user,assistant' as roles, stripped as prompt, {_ANSWER} as answer from ex")
def t2_chat(spark: SparkSession, d: str, on: Corpus = DERIVED) -> DataFrame:
    m = F.col("messages")
    return _examples(spark, d, on).select("record_id", F.array_join(F.transform(m, lambda x: x["role"]), ",").alias("roles"), F.get(m, F.lit(1))["content"].alias("prompt"), F.get(m, F.lit(2))["content"].alias("answer"))


@query(
    """with a as (select example_id, [m.content for m in messages if lower(trim(m.role)) = 'assistant'][1] as answer from training_examples),
        l as (select example_id, unnest(string_split(answer, chr(10))) as line from a where answer is not null), t as (select example_id, trim(line, concat(' ', chr(9), chr(13))) as line from l)
        select example_id, count(*) as n, cast(sum(length(regexp_extract(line, '^(#{1,6})', 1))) as bigint) as level_sum from t where regexp_matches(line, '^#{1,6}[ \\t]+[^ \\t]') group by 1"""
)
def t3_parse(spark: SparkSession, d: str) -> DataFrame:
    """Answers of the training examples: only their heading lines count."""
    answers = F.filter("messages", lambda m: F.lower(F.trim(m["role"])) == "assistant")
    heads = table(spark, d, "training_examples").select("example_id", M.parse_answer(F.get(answers, F.lit(0))["content"]).alias("h"))
    return heads.select("example_id", F.explode("h").alias("h")).groupBy("example_id").agg(F.count("*").alias("n"), F.sum(F.col("h.level").cast("long")).alias("level_sum"))


@query(f"{_EXAMPLE} select record_id, greatest(40 * len([x for x in string_split(stripped, chr(10)) if x like '# %']), 256) as estimate from ex")
def t8_token_estimate(spark: SparkSession, d: str, on: Corpus = DERIVED) -> DataFrame:
    return _examples(spark, d, on).select("record_id", M.token_estimate(F.col("stripped")).alias("estimate"))


@query(f"{_D} select record_id, [1 for x in levels] as predicted from d")
def b1_flat(spark: SparkSession, d: str, on: Corpus = DERIVED) -> DataFrame:
    return parsed(spark, d, on).select("record_id", predict.flat_levels(F.col("found_titles")).alias("predicted"))


_TOP = ", ".join(f"'{x}'" for x in predict.TOP_LEVEL)


@query(
    f"""select record_id, list_transform([h.text for h in headings], lambda t, i: case when i = 1 then 1 when lower(trim(t)) in ({_TOP}) then 1
        when regexp_matches(t, '^([0-9]+\\.)+[0-9]*\\s') then least(len(regexp_extract_all(regexp_extract(t, '^([0-9]+\\.)+[0-9]*\\s'), '\\.')) + 1, 6) else 2 end) as predicted
        from raw_documents where headings is not null"""
)
def b2_heuristic(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_documents").where(F.col("headings").isNotNull()).select("record_id", predict.heuristic_levels(M.texts(F.col("headings"))).alias("predicted"))


def results(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.score(table(spark, d, "eval_results").drop("exact_match", "per_heading_accuracy", "hierarchy_preservation", "mean_absolute_error", "level_count_match"))


_SIGN = "list_transform(range(2, len({0}) + 1), lambda i: sign({0}[i] - {0}[i - 1]))"
_SCORED = f"""with r as (select *, predicted_levels as p, ground_truth_levels as t from eval_results),
    s as (select *, list_transform(range(1, len(t) + 1), lambda i: cast(p[i] = t[i] as double)) as hit, len(p) = len(t) as same from r),
    g as (select *, list_transform(range(2, len(t) + 1), lambda i: cast(sign(p[i] - p[i - 1]) = sign(t[i] - t[i - 1]) as double)) as alike from s),
    e as (select result_id, example_id, predictor, p, t, same as level_count_match, hit, cast(p = t as double) as exact_match,
          case when not same then 0.0 when len(t) > 0 then list_avg(hit) end as per_heading_accuracy,
          case when not same or len(t) < 2 then 0.0 else list_avg(alike) end as hierarchy_preservation,
          case when not same then cast('inf' as double) when len(t) > 0 then list_avg(list_transform(range(1, len(t) + 1), lambda i: abs(p[i] - t[i]))) end as mean_absolute_error from g),
    c as (select *, len(p) // 4 as q from e),
    k as (select *, case when not level_count_match then 'count_mismatch' when p = t then 'correct'
          when len(p) > 0 and len(list_distinct(list_transform(range(1, len(t) + 1), lambda i: p[i] - t[i]))) = 1 then 'off_by_one' when len(list_distinct(p)) = 1 then 'flat_prediction'
          when hierarchy_preservation < 0.5 then 'inverted_hierarchy'
          when len(p) >= 8 and list_avg(hit[1:q]) > 0.7 and list_avg(hit[len(p) - q + 1:]) > 0.7 and list_avg(hit[q + 1:len(p) - q]) < 0.4 then 'lost_in_middle' else 'other' end as error_class from c)"""
_METRICS = ("exact_match", "per_heading_accuracy", "hierarchy_preservation", "mean_absolute_error")
_AGG = """count(*) as n, round(avg(exact_match), 9) as exact_match, round(avg(per_heading_accuracy), 9) as per_heading_accuracy, round(avg(hierarchy_preservation), 9) as hierarchy_preservation,
    round(coalesce(avg(mean_absolute_error) filter (where level_count_match), cast('inf' as double)), 9) as mean_absolute_error, round(avg(cast(level_count_match as double)), 9) as level_count_match"""


@query(f"{_SCORED} select result_id, " + ", ".join(f"round({m}, 9) as {m}" for m in _METRICS) + ", level_count_match from k")
def e_metrics(spark: SparkSession, d: str) -> DataFrame:
    return results(spark, d).select("result_id", *(F.round(m, 9).alias(m) for m in _METRICS), "level_count_match")


@query(f"{_SCORED} select result_id, error_class from k")
def e9_error_classes(spark: SparkSession, d: str) -> DataFrame:
    return results(spark, d).select("result_id", "error_class")


@query(f"{_SCORED} select {_AGG} from k")
def a1_overall(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.overall(results(spark, d))


_SLICES = (
    "select k.*, 'overall' as slice from m k"
    + "".join(f" union all select m.*, 'len:{x}' from m where coalesce(token_count, 0) >= {lo} and coalesce(token_count, 0) < {hi}" for x, (lo, hi) in evaluation.LENGTH_SLICES.items())
    + "".join(f" union all select m.*, 'headings:{x}' from m where coalesce(heading_count, 0) between {lo} and {hi}" for x, (lo, hi) in evaluation.HEADING_SLICES.items())
    + "".join(f" union all select m.*, 'source:{x}' from m where source = '{x}'" for x in evaluation.SOURCES)
)


@query(
    f"{_SCORED}, m as (select k.*, x.metadata.token_count as token_count, x.metadata.heading_count as heading_count, x.metadata.source as source from k join training_examples x using (example_id)), "
    f"u as ({_SLICES}), a as (select slice, {_AGG} from u group by slice), names as (select unnest([{', '.join(repr(s) for s in evaluation.SLICES)}]) as slice) "
    "select names.slice, coalesce(n, 0) as n, exact_match, per_heading_accuracy, hierarchy_preservation, mean_absolute_error, level_count_match from names left join a using (slice)"
)
def a2_slices(spark: SparkSession, d: str) -> DataFrame:
    meta = table(spark, d, "training_examples").select("example_id", "metadata.token_count", "metadata.heading_count", "metadata.source")
    return evaluation.by_slice(results(spark, d).join(meta, "example_id"), F.col("token_count"), F.col("heading_count"), F.col("source"))


@query(
    f"{_SCORED}, names as (select unnest([{', '.join(repr(c) for c in E.ERROR_CLASSES)}]) as error_class), a as (select error_class, count(*) as n from k group by 1) "
    "select error_class, coalesce(n, 0) as n, round(100.0 * coalesce(n, 0) / (select count(*) from k), 6) as percent from names left join a using (error_class)"
)
def a4_error_histogram(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.error_histogram(results(spark, d))


@query("select source, count(*) as n from raw_documents group by 1")
def a5_source_counts(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.source_counts(table(spark, d, "raw_documents"))


@query("select count(*) as before, count(*) filter (where length(content) between 300 and 150000) as after, count(*) - count(*) filter (where length(content) between 300 and 150000) as dropped from raw_documents")
def a6_drop_counts(spark: SparkSession, d: str) -> DataFrame:
    return filters.drop_counts(table(spark, d, "raw_documents"), F.length("content").between(300, 150_000))


@query(
    f"{_SCORED}, o as (select p, t, unnest(range(1, len(t) + 1)) as i from k) select t[i] as level, count(*) as n, count(*) filter (where p[i] = t[i]) as \"right\", "
    "round(count(*) filter (where p[i] = t[i]) / count(*), 9) as accuracy from o group by 1"
)
def a9_level_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.level_accuracy(table(spark, d, "eval_results"))


@query(f"{_SCORED} select list_max(t) as max_depth, {_AGG} from k group by 1")
def a9_by_depth(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.by_depth(results(spark, d))


@query(f"{_D}, o as (select source, unnest(levels) as level from d) select source, level, count(*) as n from o group by all")
def a9_level_histogram(spark: SparkSession, d: str, on: Corpus = DERIVED) -> DataFrame:
    return evaluation.level_histogram(parsed(spark, d, on), "found_levels", "source")


@query()
def f3_bpe_count(spark: SparkSession, d: str) -> DataFrame:
    spec = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    return table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", tokens.token_count(F.col("text"), spec).alias("tokens"))


@query("select example_id, coalesce(metadata.token_count, 0) as token_count from training_examples")
def q5_length_batches(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "training_examples").select("example_id", F.coalesce("metadata.token_count", F.lit(0)).alias("token_count"))
    return sampling.length_batches(df, "token_count", 8)


@query()
def b5_rehead_heuristic(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents reheaded by the heuristic through the predictor interface."""
    return predict.rehead(table(spark, d, "raw_documents").where(F.col("content").isNotNull()).select("record_id", "content"), predict.HeuristicPredictor).select("record_id", "reheaded")


@query(
    corpus.SQL + """ select record_id, array_to_string(list_transform(titles, lambda t, i: concat(
        case when i = 1 then '# ' else '## ' end, t, chr(10), chr(10), case when (i - 1) % 3 = 2 then concat('```', chr(10), '# not a heading', chr(10), '```', chr(10), chr(10)) else '' end,
        'Body of ', t, ': ', repeat('alpha beta gamma delta ', cast(record_id % 7 * i * 5 as int)), 'end.')), concat(chr(10), chr(10))) as reheaded from d"""
)
def b5_rehead(spark: SparkSession, d: str) -> DataFrame:
    """The same on the derived corpus, whose titles are first or plain ones to the heuristic."""
    return predict.rehead(corpus.derived(table(spark, d, "raw_documents")), predict.HeuristicPredictor).select("record_id", "reheaded")


@query()
def path_a_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Markdown files of the code corpus to raw documents, with the quota of every bucket."""
    files = table(spark, d, "repo_files").dropDuplicates(["file_id"]).select("file_id", "path", "content", F.col("repo").alias("repo_name"), "license")
    return pipelines.ingest_code(files, "file_id").select("file_id", F.size("headings").alias("headings"), "source", "meta.max_level_gap")


def _prepared(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "raw_documents").where(F.col("content").isNotNull()).select("record_id", "content", "source", "meta")
    return pipelines.prepare(raw)


@query()
def path_b_end_to_end(spark: SparkSession, d: str) -> DataFrame:
    return _prepared(spark, d).select("record_id", "split", "copy", "metadata.token_count", "metadata.heading_count", "metadata.max_depth")


@query(
    f"""{_EXAMPLE}, b as (select record_id, levels as t, list_transform(titles, lambda x, i: case when i = 1 then 1 else 2 end) as p from ex)
        select count(*) as n, round(avg(cast(p = t as double)), 9) as exact_match from b"""
)
def path_c_evaluate(spark: SparkSession, d: str, on: Corpus = DERIVED) -> DataFrame:
    scored = pipelines.evaluate(_examples(spark, d, on), predict.heuristic_levels)
    return evaluation.overall(scored).select("n", "exact_match")


#: The structural queries on the real texts; SQL can't parse CommonMark, so these have none.
_STRUCTURAL = (
    m1_extract, m1_depth_stats, m2_spans, m3_strip_piece, m5_count, m6_truncate_doc, m7_apply_roundtrip, m8_align, m10_gap, f1_cheap_filter, f7_visible_prefix, f8_metadata,
    q4_oversample, t1_format, t2_chat, t8_token_estimate, b1_flat, a9_level_histogram, path_c_evaluate,
)
QUERIES |= {f"{f.__name__}_full": partial(f, on=WHOLE) for f in _STRUCTURAL}
