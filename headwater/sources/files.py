"""Readers and writers: parquet corpora, JSON lines, whole text files, results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headwater.operators.filters import markdown_path

RAW_SCHEMA = "content STRING, headings ARRAY<STRUCT<text: STRING, level: INT>>, source STRING, meta STRUCT<repo: STRING, path: STRING, license: STRING, is_priority_path: BOOLEAN, title: STRING, pageid: BIGINT, categories: ARRAY<STRING>, max_level_gap: INT>"
EXAMPLE_SCHEMA = (
    "messages ARRAY<STRUCT<role: STRING, content: STRING>>, metadata STRUCT<source: STRING, token_count: INT, heading_count: INT, max_depth: INT, min_depth: INT, max_level_gap: INT, "
    "repo: STRING, path: STRING, license: STRING, is_priority_path: BOOLEAN, title: STRING, pageid: BIGINT, categories: ARRAY<STRING>>"
)


def read_code_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, repo_name, license) of the markdown files of a parquet corpus; nothing else is read."""
    return spark.read.parquet(path).select("path", "content", "repo_name", "license").where(markdown_path(F.col("path")))


def read_wiki_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("title", "markdown", "pageid", "categories")


def read_raw_json(spark: SparkSession, folder: str) -> DataFrame:
    """All ``*_raw.jsonl`` of a folder: the documents, with file and place for an order by file name.

    Blank lines don't count; a malformed line is an error.
    """
    df = spark.read.schema(RAW_SCHEMA).option("mode", "FAILFAST").json(f"{folder.rstrip('/')}/*_raw.jsonl").select("*", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("file_block"), F.monotonically_increasing_id().alias("ordinal"))
    return df.where(F.coalesce(*(F.col(c).cast("string") if c == "content" else F.when(F.col(c).isNotNull(), "") for c in ("content", "headings", "source", "meta"))).isNotNull())


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """Chat examples of JSON lines; a malformed line is an error."""
    return spark.read.schema(EXAMPLE_SCHEMA).option("mode", "FAILFAST").json(path)


def write_json(df: DataFrame, path: str, *, overwrite: bool = False, keep_nulls: bool = True) -> None:
    """JSON lines in UTF-8, parent folders made, an infinite number written as null."""
    finite = [F.when(F.abs(F.col(f"`{f.name}`")) == float("inf"), None).otherwise(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`") for f in df.schema.fields]
    df.select(*finite).write.mode("overwrite" if overwrite else "errorifexists").option("ignoreNullFields", str(not keep_nulls).lower()).json(path)


def write_splits(df: DataFrame, path: str, *, overwrite: bool = False) -> None:
    """One folder per split."""
    df.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("split").parquet(path)


def write_results(per_example: DataFrame, metrics: DataFrame, folder: str, *, overwrite: bool = False) -> None:
    write_json(metrics.coalesce(1), f"{folder.rstrip('/')}/metrics", overwrite=overwrite)
    write_json(per_example, f"{folder.rstrip('/')}/per_example", overwrite=overwrite)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of whole text files."""
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
