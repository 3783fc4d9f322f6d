"""Quotas, leak-free splits, oversampling and length batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headwater.session import cut

# How many accepted documents each bucket takes, and copies by depth.
BUCKET_TARGETS = {"< 4k": 50_000, "4k-8k": 30_000, "8k-16k": 15_000, "16k-32k": 10_000}
DEPTH_MULTIPLIERS = {4: 2, 5: 4, 6: 8}


def bucket_quota(df: DataFrame, order_col: str, bucket_col: str = "bucket", targets: dict[str, int] | None = None, salts: int = 64) -> DataFrame:
    """The first documents of each bucket, in the order given, up to its target; a bucket without a target takes none.

    Order and bucket alone are ranked, first within salts of a bucket, then among what is left, to find
    where each bucket ends; both ranks are pushed below their shuffles (WindowGroupLimit).  The
    documents themselves are filtered by that end where they are, so of their columns only accepted
    rows ever move.  Whatever df computes is computed twice unless it is stored before.
    """
    targets = BUCKET_TARGETS if targets is None else targets
    most = max([0, *targets.values()])
    limit = F.lit(0)
    for label, n in targets.items():
        limit = F.when(F.col(bucket_col) == label, n).otherwise(limit)
    wanted = df.where(F.col(bucket_col).isin([k for k, n in targets.items() if n > 0]))
    places = wanted.select(bucket_col, order_col).withColumn("__salt", F.pmod(F.xxhash64(order_col), F.lit(salts)))
    in_salt = F.row_number().over(Window.partitionBy(bucket_col, "__salt").orderBy(order_col))
    overall = F.row_number().over(Window.partitionBy(bucket_col).orderBy(order_col))
    left = places.withColumn("__rank", in_salt).where(F.col("__rank") <= most).select(bucket_col, order_col)
    ends = left.withColumn("__rank", overall).where(F.col("__rank") <= most).where(F.col("__rank") == limit).select(bucket_col, F.col(order_col).alias("__end"))
    inside = wanted.join(F.broadcast(ends), bucket_col, "left").where(F.col("__end").isNull() | (F.col(order_col) <= F.col("__end"))).drop("__end")  # ends: a row per bucket
    # Only ties at the end are still too many.
    return inside.withColumn("__rank", overall).where(F.col("__rank") <= most).where(F.col("__rank") <= limit).drop("__rank").select(*df.columns)


def split_key(repo: Column, title: Column) -> Column:
    """repo, else title, else the empty key, which all documents without either share."""
    return F.coalesce(F.nullif(repo, F.lit("")), F.nullif(title, F.lit("")), F.lit(""))


def split_keys(df: DataFrame, key_col: str, train: float = 0.9, validation: float = 0.05, seed: int = 42, bins: int = 1024) -> DataFrame:
    """(key, split): whole keys in a seeded order fill train until it has its share, then validation, the rest is test.

    The running sum is taken in two levels: over ``bins`` ranges of the hash, then inside each range,
    so no task sorts all keys.
    """
    counted = df.groupBy(F.col(key_col).alias("key")).agg(F.count("*").alias("n"))
    order = F.md5(F.concat(F.col("key"), F.lit(f"|{seed}")))
    counted = counted.withColumn("h", order).withColumn("bin", F.floor(F.conv(F.substring("h", 1, 4), 16, 10).cast("int") * bins / 65536))
    per_bin = counted.groupBy("bin").agg(F.sum("n").alias("m"))
    base = per_bin.select("bin", (F.sum("m").over(Window.orderBy("bin")) - F.col("m")).alias("base"), F.sum("m").over(Window.partitionBy(F.lit(1))).alias("total"))  # at most bins rows
    inside = Window.partitionBy("bin").orderBy("h", "key").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.join(F.broadcast(base), "bin").withColumn("before", F.col("base") + F.coalesce(F.sum("n").over(inside), F.lit(0)))  # base: at most bins rows
    n_train, n_val = F.floor(F.col("total") * train), F.floor(F.col("total") * validation)
    placed = placed.withColumn("in_train", F.col("before") < n_train)
    taken = placed.agg(F.coalesce(F.sum(F.when(F.col("in_train"), F.col("n"))), F.lit(0)).alias("taken"))
    return placed.select("key", F.when(F.col("in_train"), "train").when(F.col("before") - taken.scalar() < n_val, "validation").otherwise("test").alias("split"))


def split_by_key(df: DataFrame, key_col: str, **settings) -> DataFrame:
    """df with a column split; all rows of a key in one.

    The key table is stored once, narrow.  Rows of the empty key, of which there may be very many, are
    spread over a thousand values that match nothing and get that key's split from a subquery.
    """
    keys = cut(split_keys(df, key_col, **settings))
    empty = F.col(key_col) == ""
    spread = F.when(empty, F.concat(F.lit("\0"), F.pmod(F.monotonically_increasing_id(), F.lit(1000)).cast("string"))).otherwise(F.col(key_col))
    joined = df.withColumn("__key", spread).join(keys.where("key != ''").withColumnRenamed("key", "__key"), "__key", "left").drop("__key")
    return joined.withColumn("split", F.when(empty, keys.where("key = ''").select("split").scalar()).otherwise(F.col("split")))


def copies(level_col: Column, multipliers: dict[int, int] | None = None) -> Column:
    """How often a document stands in the training split: the highest threshold that its depth reaches."""
    out = None
    depth = F.coalesce(F.array_max(level_col), F.lit(0))
    for least, n in sorted((multipliers if multipliers is not None else DEPTH_MULTIPLIERS).items(), reverse=True):
        out = F.when(depth >= least, n) if out is None else out.when(depth >= least, n)
    return out.otherwise(1) if out is not None else F.lit(1)


def oversample(df: DataFrame, level_col: str = "levels", where: Column | None = None, multipliers: dict[int, int] | None = None) -> DataFrame:
    """df with each row repeated by depth (column copy, from 1), where the condition holds."""
    n = copies(F.col(level_col), multipliers)
    n = n if where is None else F.when(where, n).otherwise(1)
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), n)))


def length_batches(df: DataFrame, token_col: str, parts: int) -> DataFrame:
    """Rows of like length side by side, so that a predictor's batches need little padding."""
    return df.repartitionByRange(parts, token_col).sortWithinPartitions(token_col)
