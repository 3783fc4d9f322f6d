"""Aggregates of evaluation results: overall, by overlapping slices, by error class, by level and depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headwater.functions import metrics as E

# Slice bounds; lengths half-open, heading counts inclusive.
LENGTH_SLICES = {"< 2k": (0, 2048), "2k-4k": (2048, 4096), "4k-8k": (4096, 8192), "8k-16k": (8192, 16384), "16k-32k": (16384, 32768)}
HEADING_SLICES = {"3-5 headings": (3, 5), "6-15 headings": (6, 15), "16-40 headings": (16, 40), "40+ headings": (41, 999)}
SOURCES = ["github_code", "goodwiki"]
SLICES = ["overall", *(f"len:{x}" for x in LENGTH_SLICES), *(f"headings:{x}" for x in HEADING_SLICES), *(f"source:{x}" for x in SOURCES)]


def score(df: DataFrame, predicted: str = "predicted_levels", truth: str = "ground_truth_levels") -> DataFrame:
    """df with the five metrics computed anew and the error class."""
    p, t = F.col(predicted), F.col(truth)
    columns = {"exact_match": E.exact_match(p, t), "per_heading_accuracy": E.per_heading_accuracy(p, t), "hierarchy_preservation": E.hierarchy_preservation(p, t), "mean_absolute_error": E.mean_absolute_error(p, t), "level_count_match": E.level_count_match(p, t), "error_class": E.error_class(p, t)}
    return df.withColumns(columns)


def aggregates() -> list[Column]:
    """Number and means; the error's mean is over matched lists only, infinite if there are none."""
    mean_error = F.avg(F.when(F.col("level_count_match"), F.col("mean_absolute_error")))
    return [
        F.count("*").alias("n"), F.round(F.avg("exact_match"), 9).alias("exact_match"), F.round(F.avg("per_heading_accuracy"), 9).alias("per_heading_accuracy"),
        F.round(F.avg("hierarchy_preservation"), 9).alias("hierarchy_preservation"), F.round(F.coalesce(mean_error, F.lit(float("inf"))), 9).alias("mean_absolute_error"),
        F.round(F.avg(F.col("level_count_match").cast("double")), 9).alias("level_count_match"),
    ]


def overall(scored: DataFrame) -> DataFrame:
    """One row; none if there are no results."""
    return scored.agg(*aggregates()).where("n > 0")


def slice_labels(token_count: Column, heading_count: Column, source: Column) -> Column:
    """All slices a result is in; missing counts are 0."""
    tokens, heads = F.coalesce(token_count, F.lit(0)), F.coalesce(heading_count, F.lit(0))
    labels = [F.lit("overall")]
    labels += [F.when((tokens >= lo) & (tokens < hi), F.lit(f"len:{x}")) for x, (lo, hi) in LENGTH_SLICES.items()]
    labels += [F.when(heads.between(lo, hi), F.lit(f"headings:{x}")) for x, (lo, hi) in HEADING_SLICES.items()]
    labels += [F.when(source == x, F.lit(f"source:{x}")) for x in SOURCES]
    return F.array_compact(F.array(*labels))


def by_slice(scored: DataFrame, token_count: Column, heading_count: Column, source: Column) -> DataFrame:
    """A row for every slice of the catalogue; empty ones have n = 0 and null means."""
    spark = scored.sparkSession
    catalogue = spark.createDataFrame([(s,) for s in SLICES], "slice string")
    found = scored.withColumn("slice", F.explode(slice_labels(token_count, heading_count, source))).groupBy("slice").agg(*aggregates())
    return catalogue.join(F.broadcast(found), "slice", "left").withColumn("n", F.coalesce("n", F.lit(0)))  # found: a row per slice


def error_histogram(scored: DataFrame) -> DataFrame:
    """(error_class, n, percent) of every class, zeros too."""
    spark = scored.sparkSession
    classes = spark.createDataFrame([(c,) for c in E.ERROR_CLASSES], "error_class string")
    counted = scored.groupBy("error_class").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))  # a row per class
    out = classes.join(F.broadcast(counted), "error_class", "left").select("error_class", F.coalesce("n", F.lit(0)).alias("n"))
    return out.select("error_class", "n", F.round(F.coalesce(100.0 * F.try_divide(F.col("n"), total), F.lit(0.0)), 6).alias("percent"))


def level_accuracy(df: DataFrame, predicted: str = "predicted_levels", truth: str = "ground_truth_levels") -> DataFrame:
    """(level, n, right, accuracy) by true level; headings without a prediction are wrong."""
    one = df.select(F.posexplode(truth).alias("i", "level"), F.col(predicted).alias("p"))
    return one.groupBy("level").agg(F.count("*").alias("n"), F.count_if(F.get("p", F.col("i")) == F.col("level")).alias("right")).withColumn("accuracy", F.round(F.col("right") / F.col("n"), 9))


def by_depth(scored: DataFrame, truth: str = "ground_truth_levels") -> DataFrame:
    return scored.withColumn("max_depth", F.array_max(truth)).groupBy("max_depth").agg(*aggregates())


def level_histogram(df: DataFrame, level_col: str = "levels", *by: str) -> DataFrame:
    return df.select(*by, F.explode(level_col).alias("level")).groupBy(*by, "level").agg(F.count("*").alias("n"))


def source_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("source").agg(F.count("*").alias("n")).orderBy("source")
