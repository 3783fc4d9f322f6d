"""Document filters and metadata projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwater.functions import markdown as M
from headwater.functions import tokens

# Path patterns of documentation, and the character ranges of the buckets.
PRIORITY_PATTERNS = ["docs/", "doc/", "wiki/", "guide/", "manual/", "tutorial/"]
BUCKET_RANGES = {"< 4k": (0, 16_000), "4k-8k": (16_000, 32_000), "8k-16k": (32_000, 64_000), "16k-32k": (64_000, 150_000)}


def markdown_path(path: Column) -> Column:
    """.md or .markdown in any case."""
    return F.lower(path).rlike(r"\.(md|markdown)$")


def priority_path(path: Column) -> Column:
    """Contains one of the patterns anywhere, in any case (``mydocs/`` does)."""
    return F.lower(path).rlike("|".join(PRIORITY_PATTERNS))


def char_bucket(text: Column) -> Column:
    """Bucket of the text's length; null beyond the last range, whose end is exclusive."""
    n, out = F.length(text), None
    for label, (lo, hi) in BUCKET_RANGES.items():
        hit = (n >= lo) & (n < hi)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


def length_filter(df: DataFrame, text_col: str = "content", least: int = 300, most: int = 150_000) -> DataFrame:
    """The native half of the cheap filters: to stand before anything that parses."""
    return df.where(F.length(text_col).between(least, most))


def cheap_filters(text: Column, level_col: Column, *, least_headings: int = 3, least_levels: int = 2, least_chars: int = 300, most_chars: int = 150_000, most_headings: int = 120) -> Column:
    """All bounds inclusive; gaps between levels don't matter."""
    n = F.size(level_col)
    return F.length(text).between(least_chars, most_chars) & n.between(least_headings, most_headings) & (F.size(F.array_distinct(level_col)) >= least_levels)


def token_filter(token_col: Column, least: int = 100, most: int = 31_000) -> Column:
    """The count stands once in the condition, so an expensive one is evaluated once."""
    return F.exists(F.array(token_col), lambda n: (n >= least) & (n <= most))


def with_spans(df: DataFrame, text_col: str = "content") -> DataFrame:
    """df with a column spans; parsed once, whatever is made of it."""
    return df.withColumn("spans", M.spans(F.col(text_col)))


def example_metadata(df: DataFrame, *, spec: str = "piece") -> DataFrame:
    """df(stripped, levels, source, meta) with visible levels and the metadata of a training example.

    Only headings that the stripped text still shows count for depth and number, the gap is that of
    the whole document.  Documents without a visible heading are dropped.
    """
    visible = M.count_marks(F.col("stripped")).cast("int")
    df = df.withColumn("levels", F.slice("levels", F.lit(1), visible)).withColumn("titles", F.slice("titles", F.lit(1), visible)).where(F.size("levels") > 0)
    meta = F.struct(
        F.col("source").alias("source"), tokens.token_count(F.col("stripped"), spec).cast("int").alias("token_count"), F.size("levels").alias("heading_count"), F.array_max("levels").alias("max_depth"), F.array_min("levels").alias("min_depth"),
        F.coalesce(F.col("meta.max_level_gap"), F.lit(0)).alias("max_level_gap"), *(F.col(f"meta.{c}").alias(c) for c in ("repo", "path", "license", "is_priority_path", "title", "pageid", "categories")),
    )
    return df.withColumn("metadata", meta)


def drop_counts(df: DataFrame, keep: Column) -> DataFrame:
    """(before, after, dropped) of a filter, in one pass."""
    kept = F.count_if(keep)
    return df.agg(F.count("*").alias("before"), kept.alias("after"), (F.count("*") - kept).alias("dropped"))


def progress(df: DataFrame, name: str, *extra: Column) -> DataFrame:
    """df that reports its number of rows (and more aggregates) under a name while it is written; no second pass."""
    return df.observe(name, F.count("*").alias("rows"), *extra)
