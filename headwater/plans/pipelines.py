"""Whole pipelines: ingest, dataset preparation, evaluation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwater.functions import markdown as M
from headwater.functions import tokens
from headwater.operators import chat, evaluation, filters, sampling
from headwater.sources import files


def ingest_code(files: DataFrame, order_col: str, *, targets: dict[str, int] | None = None, **limits: int) -> DataFrame:
    """Markdown files (path, content, repo_name, license) to raw documents: filters first, one parse, quota per bucket."""
    df = filters.length_filter(files.where(filters.markdown_path(F.col("path"))), most=limits.get("most_chars", 150_000), least=limits.get("least_chars", 300))
    df = df.withColumn("bucket", filters.char_bucket(F.col("content"))).where(F.col("bucket").isNotNull())
    df = filters.with_spans(df).withColumn("levels", M.levels(F.col("spans")))
    df = sampling.bucket_quota(df.where(filters.cheap_filters(F.col("content"), F.col("levels"), **limits)), order_col, targets=targets)
    meta = F.struct(
        F.col("repo_name").alias("repo"), "path", "license", filters.priority_path(F.col("path")).alias("is_priority_path"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("bigint").alias("pageid"),
        F.lit(None).cast("array<string>").alias("categories"), M.level_gap(F.col("levels")).alias("max_level_gap"),
    )
    return df.select(order_col, "content", M.headings(F.col("spans")).alias("headings"), "spans", F.lit("github_code").alias("source"), meta.alias("meta"))


def ingest_wiki(pages: DataFrame, **limits: int) -> DataFrame:
    """Pages (title, markdown, pageid, categories) to raw documents, the title as first heading."""
    df = filters.with_spans(filters.length_filter(pages.withColumn("content", M.with_title(F.col("title"), F.col("markdown")))))
    df = df.withColumn("levels", M.levels(F.col("spans"))).where(filters.cheap_filters(F.col("content"), F.col("levels"), **limits))
    nothing = F.lit(None).cast("string")
    meta = F.struct(nothing.alias("repo"), nothing.alias("path"), nothing.alias("license"), F.lit(None).cast("boolean").alias("is_priority_path"), "title", F.col("pageid").cast("bigint").alias("pageid"), "categories", M.level_gap(F.col("levels")).alias("max_level_gap"))
    return df.select("content", M.headings(F.col("spans")).alias("headings"), "spans", F.lit("goodwiki").alias("source"), meta.alias("meta"))


def prepare(raw: DataFrame, *, spec: str = "piece", least_tokens: int = 100, most_tokens: int = 31_000, train: float = 0.9, validation: float = 0.05, seed: int = 42, head: int = 128, tail: int = 128, prompt_tokens: int = 7500) -> DataFrame:
    """Raw documents (content, source, meta, and spans if they are parsed already) to chat examples with
    their split: token filter, leak-free split by key, oversampling of deep documents in train,
    stripping, formatting.  Texts are parsed after the filter."""
    df = raw.where(filters.token_filter(tokens.token_count(F.col("content"), spec), least_tokens, most_tokens))
    df = df.withColumn("split_key", sampling.split_key(F.col("meta.repo"), F.col("meta.title")))
    df = sampling.split_by_key(df, "split_key", train=train, validation=validation, seed=seed)
    if "spans" not in raw.columns:
        df = filters.with_spans(df)
    examples = chat.build_examples(df.withColumn("all_levels", M.levels(F.col("spans"))), spec=spec, head=head, tail=tail, most_tokens=prompt_tokens)
    # Copies are made last: nothing is stripped or counted twice.
    return sampling.oversample(examples, "all_levels", where=F.col("split") == "train").drop("all_levels", "spans")


def evaluate(examples: DataFrame, predictor: Callable[[Column], Column]) -> DataFrame:
    """Chat examples scored against a native predictor of their headings' texts."""
    heads = chat.truth(F.col("messages"))
    df = examples.withColumn("truth", heads).withColumn("ground_truth_levels", M.levels(F.col("truth"))).withColumn("predicted_levels", predictor(M.texts(F.col("truth"))))
    return evaluation.score(df)


def run_evaluation(examples: DataFrame, predictor: Callable[[Column], Column], folder: str | None = None, *, overwrite: bool = False) -> DataFrame:
    """Metrics of every slice; with a folder, they and the scored examples are written there."""
    scored = evaluate(examples, predictor)
    slices = evaluation.by_slice(scored, F.col("metadata.token_count"), F.col("metadata.heading_count"), F.col("metadata.source"))
    if folder is not None:
        files.write_results(scored.select("predicted_levels", "ground_truth_levels", "exact_match", "per_heading_accuracy", "hierarchy_preservation", "mean_absolute_error", "level_count_match", "error_class", "metadata"), slices, folder, overwrite=overwrite)
    return slices
