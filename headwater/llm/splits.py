"""Splits that keep related records together."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headwater.llm.components import connected_components
from headwater.session import cut

_URL = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?[^/]*/+")
_SCP = re.compile(r"^[^/@:\s]+@[^/:\s]+:/*")
_GAP = re.compile(r"[\W_]+")
_TITLE_GAP = re.compile(r"[^\w()]+|_+")


def repo_key(text: str | None) -> str | None:
    """owner/name in one spelling: no address around it, no .git, no case; None if nothing is left."""
    if text is None:
        return None
    s = unicodedata.normalize("NFKC", unquote(text)).strip().lower()
    s = "".join(c for c in s if unicodedata.category(c) != "Cf")
    s = _SCP.sub("", _URL.sub("", s)).split("?")[0].split("#")[0].strip().strip("/").strip()
    s = re.sub(r"(\.git)+$", "", s).strip("/")
    parts = [p.strip() for p in re.split(r"[/\\]+", s) if p.strip()]
    if len(parts) > 2 and "." in parts[0]:
        parts = parts[1:]
    parts = [p for p in (_GAP.sub("-", x).strip("-") for x in parts[:2]) if p]
    return "/".join(parts) or None


def title_key(text: str | None) -> str | None:
    """A title in one spelling: white space, underscores, escapes, punctuation and case don't count; brackets do."""
    if text is None:
        return None
    s = unicodedata.normalize("NFKC", unquote(text))
    s = "".join(c for c in s if unicodedata.category(c) != "Cf").casefold()
    s = _TITLE_GAP.sub(" ", unicodedata.normalize("NFC", s))
    s = re.sub(r"\s*\(\s*", " (", re.sub(r"\s*\)", ")", s)).strip()
    return s or None


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        repo = [k and "repo:" + k for k in map(repo_key, b.column(2).to_pylist())]
        title = [k and "title:" + k for k in map(title_key, b.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(repo, pa.string()), pa.array(title, pa.string())], ["record_id", "split", "repo", "title"])


def _alias_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ends = []
        for old, new, kind in zip(*(b.column(i).to_pylist() for i in range(3))):
            kind = (kind or "").strip().lower()
            key = {"repo": repo_key, "title": title_key}.get(kind)
            x, y = (key(old), key(new)) if key else (None, None)
            if x and y:
                ends.append((f"{kind}:{x}", f"{kind}:{y}"))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in ends], pa.string()) for i in (0, 1)], ["a", "b"])


def record_keys(records: DataFrame) -> DataFrame:
    """(record_id, split, repo, title, node): the keys of each record in one spelling; node is null if it has none."""
    flat = records.select(F.col("record_id").cast("long").alias("record_id"), F.trim(F.lower("split")).alias("split"), F.col("meta.repo").alias("repo"), F.col("meta.title").alias("title"))
    # A narrow table that every step below reads: keys are made once.
    return cut(flat.mapInArrow(_keys, "record_id long, split string, repo string, title string").withColumn("node", F.coalesce("repo", "title")))


def key_groups(keyed: DataFrame, aliases: DataFrame) -> DataFrame:
    """(node, root) of keys that records with two keys or aliases connect, in one or more steps."""
    both = keyed.where(F.col("repo").isNotNull() & F.col("title").isNotNull()).select(F.col("repo").alias("a"), F.col("title").alias("b")).distinct()
    renamed = aliases.select("old_key", "new_key", "kind").mapInArrow(_alias_keys, "a string, b string")
    return connected_components(both.unionByName(renamed))


def grouped(keyed: DataFrame, groups: DataFrame) -> DataFrame:
    """One row per key: node, root, its records and the least and greatest of their splits.

    Records are aggregated per key before anything is joined, so a key that holds a third of all
    records is one row by then.
    """
    per_key = keyed.where(F.col("node").isNotNull()).groupBy("node").agg(F.count("*").alias("n"), F.min("split").alias("lo"), F.max("split").alias("hi"))
    return per_key.join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))


def torn_records(records: DataFrame, aliases: DataFrame) -> DataFrame:
    """record_id of each record with a split whose group holds records of two or more splits.

    Records without repo and title belong to no group; null is no split; a repeated record counts
    once.  Empty tables give an empty result, other columns are ignored.
    """
    keyed = record_keys(records)
    keys = grouped(keyed, key_groups(keyed, aliases))
    torn = keys.groupBy("root").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where(F.col("lo") < F.col("hi")).select("root")
    nodes = keys.join(torn, "root", "left_semi").select("node")
    # The records side may be skewed by a hot key: a semi join keeps it unsorted by key where the
    # other side is small, and AQE splits the partition where it isn't.
    return keyed.where(F.col("split").isNotNull() & F.col("node").isNotNull()).join(nodes, "node", "left_semi").select("record_id").distinct()


def greedy_fill(sizes: list[tuple[str, int]], targets: dict[str, float], filled: dict[str, int], total: int) -> dict[str, str]:
    """Largest first, each to the split furthest below its target; ties by name.  Changes filled."""
    out = {}
    for name, n in sorted(sizes, key=lambda x: (-x[1], x[0])):
        to = max(sorted(targets), key=lambda s: targets[s] * total - filled[s])
        filled[to] += n
        out[name] = to
    return out


def fill_equal(n: int, count: int, targets: dict[str, float], filled: dict[str, int], total: int) -> dict[str, int]:
    """How many of ``count`` groups of n records each split gets when they are placed as in greedy_fill.  Changes filled.

    The picks are the greatest of the distances to the target that each split still has after 0, 1, 2 ...
    groups; all above a level found by halving are taken at once, the few left one by one.
    """
    names = sorted(targets)
    gap = {s: targets[s] * total - filled[s] for s in names}
    above = lambda level: {s: max(0, math.ceil((gap[s] - level) / n)) for s in names}
    high, low = max(gap.values()), min(gap.values()) - float(n) * count
    got = dict.fromkeys(names, 0)
    for _ in range(200):
        middle = (low + high) / 2
        now = above(middle)
        if sum(now.values()) <= count:
            high, got = middle, now
        else:
            low = middle
        if high - low < n / 2:
            break
    for _ in range(count - sum(got.values())):
        got[max(names, key=lambda s: gap[s] - n * got[s])] += 1
    for s in names:
        filled[s] += n * got[s]
    return got


def assign_splits(records: DataFrame, aliases: DataFrame, shares: DataFrame) -> DataFrame:
    """(record_id, group_key, split, new_split): every record in a split, all records of a group in one.

    Groups are placed largest first, each to the split furthest below its target; a record without a
    group is one of its own.  Groups of one size are interchangeable, so what reaches the driver is a
    row per different size, fewer than twice the square root of the records, and a row per split; which
    groups of a size go where follows a hash of their key.  Shares are scaled to sum to one; an empty
    table of shares gives null splits.
    """
    spark = records.sparkSession
    keyed = record_keys(records)
    keys = grouped(keyed, key_groups(keyed, aliases))
    loose_root = F.concat(F.lit("record:"), F.col("record_id").cast("string"))
    loose = keyed.where(F.col("node").isNull())
    units = cut(keys.groupBy("root").agg(F.sum("n").alias("n")).unionByName(loose.select(loose_root.alias("root"), F.lit(1).cast("long").alias("n"))))
    sizes = {r["n"]: r["groups"] for r in units.groupBy("n").agg(F.count("*").alias("groups")).collect()}
    total = sum(n * k for n, k in sizes.items())
    target = {r["split"]: float(r["share"]) for r in shares.select("split", "share").where((F.col("share") > 0) & F.col("split").isNotNull()).collect()}
    scale = sum(target.values())
    target = {k: v / scale for k, v in target.items()}
    filled = dict.fromkeys(target, 0)
    names, plan = sorted(target), []
    for n in sorted(sizes, reverse=True) if target else ():
        got = fill_equal(n, sizes[n], target, filled, total)
        plan.append((n, [sum(got[s] for s in names[: i + 1]) for i in range(len(names))]))
    # The place of a group among those of its size, by hash, counted in two levels.
    bins = max(16, min(1 << 20, sum(sizes.values()) // 50_000))
    binned = units.withColumn("h", F.xxhash64("root")).withColumn("bin", F.pmod("h", F.lit(bins)))
    per_bin = binned.groupBy("n", "bin").agg(F.count("*").alias("k"))
    base = per_bin.select("n", "bin", (F.sum("k").over(Window.partitionBy("n").orderBy("bin")) - F.col("k")).alias("base"))
    rank = F.col("base") + F.row_number().over(Window.partitionBy("n", "bin").orderBy("h", "root")) - 1
    ends = spark.createDataFrame(plan, "n long, ends array<long>")
    placed = binned.join(base, ["n", "bin"]).withColumn("rank", rank).join(ends, "n", "left")
    split = F.get(F.array(*map(F.lit, names)).cast("array<string>"), F.size(F.expr("filter(ends, x -> x <= rank)")))
    placed = placed.select("root", split.alias("new_split"))
    # Keys get their split before records are joined to them; records without a key have a group each.
    of_key = keys.select("node", "root").join(placed, "root").select("node", F.col("root").alias("group_key"), "new_split")
    grouped_ = keyed.where(F.col("node").isNotNull()).join(of_key, "node").select("record_id", "group_key", "split", "new_split")
    alone = loose.select("record_id", "split", loose_root.alias("root")).join(placed, "root").select("record_id", F.col("root").alias("group_key"), "split", "new_split")
    return grouped_.unionByName(alone)
