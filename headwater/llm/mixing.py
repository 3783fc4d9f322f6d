"""Mixing sources to target weights.

Each source's texts, end to end, are cut into blocks of equal length.  Every output shard draws how many
of its slots each source gets from the multinomial of the target shares; running sums of the draws give
each slot a number within its source, a pseudorandom permutation per repetition turns the number into
a block, and texts are joined by block.  Sizes are characters or the tokens of a vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from headwater.llm import bpe
from headwater.llm.labels import canonical
from headwater.llm.words import mix
from headwater.session import cut


def user_size(messages: str = "messages"):
    """Characters of the user messages of a row; null lists and null contents count nothing."""
    sizes = F.transform(
        F.filter(F.coalesce(F.col(messages), F.array()), lambda m: F.lower(F.trim(m["role"])) == "user"),
        lambda m: F.coalesce(F.length(m["content"]), F.lit(0)).cast("long"),
    )
    return F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x)


def _token_rows(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = bpe.counter(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array([sum(map(counter.count, x.as_py() or ())) for x in b.column(2)], pa.int64())], ["example_id", "key", "size"])

    return run


def train_sizes(examples: DataFrame, targets: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(example_id, source, size): rows of split train; source is the proper name of targets or null.

    size: characters of the user messages, or their tokens if a vocabulary is given.
    """
    rows = examples.where(F.trim(F.lower("split")) == "train").select(F.col("example_id").cast("long").alias("example_id"), canonical(F.col("metadata.source")).alias("key"), "messages")
    if vocabulary is None:
        rows = rows.select("example_id", "key", user_size().alias("size"))
    else:
        texts = F.transform(F.filter("messages", lambda m: F.lower(F.trim(m["role"])) == "user"), lambda m: m["content"])
        rows = cut(rows.select("example_id", "key", texts.alias("texts")).mapInArrow(_token_rows(vocabulary), "example_id long, key string, size long"))
    proper = targets.select(canonical(F.col("source")).alias("key"), F.col("source")).where(F.col("key").isNotNull()).dropDuplicates(["key"])
    return rows.join(proper, "key", "left").select("example_id", "source", "size")


def supply(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per source of targets: its supply, the total of all rows and whether repeating is enough."""
    have = sizes.groupBy("source").agg(F.sum("size").alias("supply"), F.count("*").alias("texts"))
    total = have.agg(F.coalesce(F.sum("supply"), F.lit(0)).cast("long").alias("total")).scalar()
    return (
        targets.select("source", "target_share", "max_repeats")
        .join(have, "source", "left")
        .withColumn("total", total)
        .select(
            "source", "target_share", "max_repeats", F.coalesce("supply", F.lit(0)).cast("long").alias("supply"), F.coalesce("texts", F.lit(0)).cast("long").alias("texts"), "total",
            (F.col("max_repeats") * F.coalesce("supply", F.lit(0)) < F.col("target_share") * F.col("total")).alias("short"),
        )
    )


def permute(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Pseudorandom permutation of range(n), keyed: a Feistel network over the next even power of two, walked until inside."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(2, n.astype(np.float64)))).astype(np.uint64) + np.uint64(1)) // np.uint64(2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.ones(len(index), bool)
    bound = n.astype(np.uint64)
    while todo.any():
        left, right = out[todo] >> half[todo], out[todo] & mask[todo]
        for turn in range(4):
            left, right = right, left ^ (mix(right + key[todo] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(turn + 1)) & mask[todo])
        out[todo] = (left << half[todo]) | right
        todo &= out >= bound
    return out.astype(np.int64)


#: Output shards whose draws one running sum goes over.
_STRIDE = 4096


def draw_slots(spark: SparkSession, rows: list[dict], block: int, per_shard: int, seed: int) -> DataFrame:
    """(shard, source, source_no, blocks, first, n, empty): slots of each source in each output shard.

    Every shard draws from the multinomial of the target shares by its own seed, in whatever task.  A
    source draws until its blocks are used max_repeats times; what it then lacks stays empty, so that
    no other source exceeds its share and no text its cap.  first is the source's slots in the shards
    before.  Rows, one per source: source, target_share, max_repeats, supply, total.
    """
    rows = sorted(rows, key=lambda r: r["source"])
    share = np.array([max(0.0, r["target_share"]) for r in rows])
    slots = -(-max(0, rows[0]["total"]) // block) if rows and share.sum() > 0 else 0
    share = share / share.sum() if share.sum() > 0 else share

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shard = b.column(0).to_numpy()
            want = [np.random.default_rng([seed, x]).multinomial(min(per_shard, slots - x * per_shard), share) for x in shard.tolist()]
            if want:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(shard, len(share))), pa.array(np.tile(np.arange(len(share), dtype=np.int32), len(shard))), pa.array(np.concatenate(want).astype(np.int64))], ["shard", "source_no", "want"])

    drawn = spark.range(-(-slots // per_shard)).mapInArrow(draw, "shard long, source_no int, want long").withColumn("stride", F.expr(f"shard div {_STRIDE}"))
    # Running sums in two levels: strides of a source, then shards of a stride.
    sums = drawn.groupBy("source_no", "stride").agg(F.sum("want").alias("n"))
    sums = sums.select("source_no", "stride", (F.sum("n").over(Window.partitionBy("source_no").orderBy("stride")) - F.col("n")).alias("base"))
    within = Window.partitionBy("source_no", "stride").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    named = spark.createDataFrame([(i, r["source"], -(-r["supply"] // block), -(-r["supply"] // block) * max(0, r["max_repeats"])) for i, r in enumerate(rows)], "source_no int, source string, blocks long, capacity long")
    at = drawn.withColumn("before", F.coalesce(F.sum("want").over(within), F.lit(0))).join(sums, ["source_no", "stride"]).join(F.broadcast(named), "source_no")  # a row per source of targets
    first = F.col("before") + F.col("base")
    n = F.greatest(F.lit(0), F.least("want", F.col("capacity") - first))
    return at.select("shard", "source", "source_no", "blocks", first.alias("first"), n.alias("n"), (F.col("want") - n).alias("empty"))


def blocks(sizes: DataFrame, block: int, bins: int = 256) -> DataFrame:
    """(source, block_no, example_id, first_at, last_at): each source's texts, end to end, cut into blocks of equal length.

    Texts follow a hash of their id.  Offsets are prefix sums in two levels (bins of a source, then
    texts of a bin), so a source with a third of all rows isn't sorted by one task.
    """
    rows = sizes.where(F.col("source").isNotNull() & (F.col("size") > 0)).withColumn("h", F.xxhash64("example_id")).withColumn("bin", F.pmod(F.col("h"), F.lit(bins)))
    per_bin = rows.groupBy("source", "bin").agg(F.sum("size").alias("n"))
    before = per_bin.select("source", "bin", (F.sum("n").over(Window.partitionBy("source").orderBy("bin")) - F.col("n")).alias("base"))
    inside = Window.partitionBy("source", "bin").orderBy("h", "example_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("at", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(before, ["source", "bin"]).withColumn("at", F.col("at") + F.col("base"))
    return placed.withColumn("block_no", F.explode(F.expr(f"sequence(at div {block}, (at + size - 1) div {block})"))).select(
        "source", "block_no", "example_id", F.greatest(F.lit(0), F.col("block_no") * block - F.col("at")).alias("first_at"), F.least(F.col("size"), (F.col("block_no") + 1) * block - F.col("at")).alias("last_at")
    )


def _plan(sizes: DataFrame, targets: DataFrame) -> tuple[list[dict], list[dict]]:
    """A row per source of targets, and those of them that can be drawn from."""
    rows = [r.asDict() for r in supply(sizes, targets).collect()]
    return rows, [r for r in rows if r["source"] is not None and r["target_share"] is not None and r["max_repeats"] is not None]


def _bins(rows: list[dict]) -> int:
    """Bins of about 50,000 texts."""
    return max(16, min(1 << 20, sum(r["texts"] for r in rows) // 50_000))


def slot_table(spark: SparkSession, rows: list[dict], *, block: int, per_shard: int, seed: int) -> DataFrame:
    """(shard, slot, source, epoch, block_no): which block of which source fills each slot of the mix."""
    one = draw_slots(spark, rows, block, per_shard, seed).where("n > 0").withColumn("i", F.explode(F.expr("sequence(0L, n - 1)"))).select("shard", "source", "source_no", "blocks", (F.col("first") + F.col("i")).alias("draw"))

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            number, n, draw = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4))
            epoch = draw // n
            key = number.astype(np.uint64) * np.uint64(1000003) + epoch.astype(np.uint64) + np.uint64(seed)
            at = permute(draw % n, n, key)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(epoch, pa.int64()), pa.array(at, pa.int64())], ["shard", "source", "epoch", "block_no"])

    filled = one.mapInArrow(mapped, "shard long, source string, epoch long, block_no long")
    return filled.withColumn("slot", F.row_number().over(Window.partitionBy("shard").orderBy(F.xxhash64("source", "epoch", "block_no"), "source", "epoch", "block_no")).cast("long"))


def mixed_blocks(examples: DataFrame, targets: DataFrame, *, block: int = 1024, per_shard: int = 1024, seed: int = 42, vocabulary: str | None = None) -> DataFrame:
    """(shard, slot, source, epoch, block_no, example_id, first_at, last_at): the texts that fill the mix, by block.

    Blocks of ``block`` characters, or tokens if a vocabulary is given; first_at and last_at are the
    place within the text, in the same unit.
    """
    sizes = train_sizes(examples, targets, vocabulary)
    _, rows = _plan(sizes, targets)
    slots = slot_table(examples.sparkSession, rows, block=block, per_shard=per_shard, seed=seed)
    return slots.join(blocks(sizes, block, _bins(rows)), ["source", "block_no"]).select("shard", "slot", "source", "epoch", "block_no", "example_id", "first_at", "last_at")


def mix_report(examples: DataFrame, targets: DataFrame, *, block: int = 4096, per_shard: int = 1024, seed: int = 42, vocabulary: str | None = None) -> DataFrame:
    """One row per source of targets: supply, slots drawn, left empty, the size the mix takes, the actual share, the most repeats, short.

    Sizes are characters, or tokens if a vocabulary is given.  short: even max_repeats times its supply
    is less than its share of the total.  It is decided exactly, for the sources whose draws come near
    what their blocks can fill; for those that don't it can't be.  Defined for every case: rows without
    a source, or with one that targets doesn't name, count in the total only; a source without rows, a
    share of null or zero, or a null cap gets nothing.  Repeated rows count.  No train rows: all zero,
    shares null.
    """
    spark = examples.sparkSession
    sizes = train_sizes(examples, targets, vocabulary)
    every, rows = _plan(sizes, targets)
    have = spark.createDataFrame([tuple(r[k] for k in ("source", "target_share", "max_repeats", "supply", "texts", "total", "short")) for r in every], "source string, target_share double, max_repeats int, supply long, texts long, total long, short boolean")
    scale = sum(max(0.0, r["target_share"]) for r in rows) or 1.0
    last = F.when(F.expr(f"block_no = (supply - 1) div {block}"), F.col("supply") - F.col("block_no") * block).otherwise(F.lit(block))
    taken = (
        slot_table(spark, rows, block=block, per_shard=per_shard, seed=seed).groupBy("source", "block_no").agg(F.count("*").alias("times"))
        .join(F.broadcast(have.select("source", "supply")), "source")  # a row per source of targets
        .groupBy("source").agg(F.sum(F.col("times") * last).alias("size"), F.max("times").alias("most_repeats"))
    )
    drawn = draw_slots(spark, rows, block, per_shard, seed).groupBy("source").agg(F.sum("n").alias("slots"), F.sum("empty").alias("empty"))
    out = have.join(drawn, "source", "left").join(taken, "source", "left")
    # Six standard deviations of a draw, and a block a repetition for the last, part-filled one.
    wanted = (F.coalesce("slots", F.lit(0)) + F.coalesce("empty", F.lit(0))) * F.lit(scale)
    near = wanted + 6 * F.sqrt(wanted) + 6 + F.col("max_repeats") >= F.col("max_repeats") * F.col("supply") / F.lit(block)
    return out.withColumn("all", F.sum("size").over(Window.partitionBy(F.lit(1)))).select(  # a row per source of targets
        "source", "target_share", "max_repeats", "supply", "texts", "total", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("slots", "empty", "size", "most_repeats")),
        F.round(F.try_divide(F.coalesce("size", F.lit(0)), F.col("all")), 9).alias("actual_share"), F.coalesce(near & F.col("short"), F.lit(False)).alias("short"),
    )


def short_sources(examples: DataFrame, targets: DataFrame) -> DataFrame:
    """source of each target that its texts can't reach, even repeated max_repeats times: of the sources whose draws run out of blocks or come near it."""
    return mix_report(examples, targets).where("short").select("source")
