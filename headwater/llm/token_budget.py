"""Token budget per source, language and web domain."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headwater.llm import bpe
from headwater.llm.labels import canonical, domain_name, language_label, language_label_column, language_of
from headwater.session import cut


def _count_rows(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = bpe.counter(path)
        for b in batches:
            n, lang = [], []
            for label, text in zip(b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1)):
                text = text.as_py()
                n.append(counter.count(text))
                lang.append(language_of(text) or language_label(label))
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(lang, pa.string()), pa.array(np.array(n, np.int64))], [*b.schema.names[:-2], "lang", "tokens"])

    return run


def count_tokens(df: DataFrame, text_col: str, lang_col: str, *, vocabulary: str | None = None) -> DataFrame:
    """df without the two columns, with lang (of the text; the label's where the text decides nothing) and tokens (bigint)."""
    keep = [c for c in df.columns if c not in (text_col, lang_col)]
    flat = df.select(*keep, F.col(lang_col).cast("string").alias("__lang"), F.col(text_col).cast("string").alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in flat.schema.fields[:-2])
    return flat.mapInArrow(_count_rows(vocabulary or bpe.vocabulary_path()), f"{fields}, lang string, tokens long")


def fill_sources(counted: DataFrame, proper: DataFrame) -> DataFrame:
    """source: the proper name of the label; where that is missing, the one that most rows of the same domain have."""
    names = proper.select(canonical(F.col("source")).alias("key"), F.col("source").alias("name")).where(F.col("key").isNotNull()).dropDuplicates(["key"])
    # A row per cell: used twice below, so that texts aren't tokenized twice.
    sized = cut(counted.groupBy("corpus", "key", "lang", "domain").agg(F.count("*").alias("texts"), F.sum("tokens").alias("tokens")))
    sized = sized.join(names, "key", "left").withColumn("name", F.coalesce("name", "key"))
    best = Window.partitionBy("domain").orderBy(F.desc("texts"), "usual")
    usual = (
        sized.where(F.col("name").isNotNull() & F.col("domain").isNotNull()).groupBy("domain", F.col("name").alias("usual")).agg(F.sum("texts").alias("texts"))
        .withColumn("place", F.row_number().over(best)).where("place = 1").select("domain", "usual")
    )
    return sized.join(usual, "domain", "left").select("corpus", F.coalesce("name", "usual").alias("source"), "lang", "domain", "texts", "tokens")


def token_budget(documents: DataFrame, examples: DataFrame, records: DataFrame, proper: DataFrame, *, vocabulary: str | None = None) -> DataFrame:
    """Texts and tokens of both corpora by source, language and domain, with all subtotals.

    corpus is documents or training_examples; null in source, lang or domain means all of them, and
    'unknown' a value that neither label nor text gives.  An example's text is the contents of its
    messages, joined by a blank line; its domain is that of its record.  Null and empty texts count as
    texts with no tokens; lists of messages that are null count as one such text.  Spellings of a
    label count together; a wrong language label doesn't count against the text.
    """
    docs = count_tokens(documents.select(F.lit("documents").alias("corpus"), canonical(F.col("source")).alias("key"), domain_name(F.col("domain")).alias("domain"), F.col("lang").alias("label"), "text"), "text", "label", vocabulary=vocabulary)
    of_record = records.select(F.col("record_id").alias("rid"), domain_name(F.col("domain")).alias("domain"), language_label_column(F.col("lang")).alias("record_lang")).dropDuplicates(["rid"])
    text = F.array_join(F.transform(F.coalesce("messages", F.array()), lambda m: F.coalesce(m["content"], F.lit(""))), "\n\n")
    told = count_tokens(examples.select(F.lit("training_examples").alias("corpus"), canonical(F.col("metadata.source")).alias("key"), F.col("record_id").alias("rid"), F.lit(None).cast("string").alias("label"), text.alias("text")), "text", "label", vocabulary=vocabulary)
    told = told.join(of_record, "rid", "left").select("corpus", "key", "domain", F.coalesce("lang", "record_lang").alias("lang"), "tokens")
    cells = fill_sources(docs.select("corpus", "key", "domain", "lang", "tokens").unionByName(told), proper)
    cells = cells.select("corpus", *(F.coalesce(c, F.lit("unknown")).alias(c) for c in ("source", "lang", "domain")), "texts", "tokens")
    cube = cells.cube("corpus", "source", "lang", "domain").agg(F.sum("texts").alias("texts"), F.sum("tokens").alias("tokens"))
    return cube.where(F.col("corpus").isNotNull())
