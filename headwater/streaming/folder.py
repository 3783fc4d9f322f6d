"""Per-document operators over a growing folder, and the bucket quota as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from headwater.functions import markdown as M
from headwater.operators import filters, sampling


def stream_texts(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """(path, content, modified) of the text files of a folder, new ones as they come."""
    stream = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return stream.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"), F.col("_metadata.file_modification_time").alias("modified"))


def stream_documents(texts: DataFrame, **limits: int) -> DataFrame:
    """Accepted documents of a stream of texts: native length bounds, one parse, the cheap filters, the bucket."""
    df = filters.with_spans(filters.length_filter(texts, least=limits.get("least_chars", 300), most=limits.get("most_chars", 150_000)))
    df = df.withColumn("levels", M.levels(F.col("spans"))).where(filters.cheap_filters(F.col("content"), F.col("levels"), **limits))
    return df.withColumn("bucket", filters.char_bucket(F.col("content"))).where(F.col("bucket").isNotNull()).select("path", "content", "modified", M.headings(F.col("spans")).alias("headings"), "levels", "bucket")


def level_counts(documents: DataFrame, late: str = "1 hour", window: str = "10 minutes") -> DataFrame:
    """Headings by level and window of the file time; windows close when the watermark has passed them."""
    one = documents.withWatermark("modified", late).select("modified", F.explode("levels").alias("level"))
    return one.groupBy(F.window("modified", window), "level").agg(F.count("*").alias("n"))


def stream_quota(documents: DataFrame, targets: dict[str, int] | None = None, salts: int = 1) -> DataFrame:
    """(path, bucket): the first documents of each bucket up to its target, across micro-batches.

    State is one counter per bucket and salt; only paths and buckets are shuffled to it.  With salts,
    a bucket's target is dealt to that many counters, so a hot bucket isn't one task's work.
    """
    targets = sampling.BUCKET_TARGETS if targets is None else targets

    def take(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        bucket, salt = key
        target = targets.get(bucket, 0)
        mine = target // salts + (1 if int(salt) < target % salts else 0)
        seen = state.get[0] if state.exists else 0
        for df in batches:
            part = df.sort_values("path").iloc[: max(0, mine - seen)]
            seen += len(part)
            if len(part):
                yield part[["path", "bucket"]]
        state.update((seen,))

    keyed = documents.select("path", "bucket", F.pmod(F.xxhash64("path"), F.lit(salts)).alias("salt"))
    return keyed.groupBy("bucket", "salt").applyInPandasWithState(take, "path string, bucket string", "seen long", "append", GroupStateTimeout.NoTimeout)
