"""Connected components: local union-find forests, merged by meeting at each node's partition."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwater.session import cut


class Forest:
    """Union-find over any ordered values; the root of a tree is its least member."""

    def __init__(self) -> None:
        self.parent: dict = {}

    def find(self, x):
        parent = self.parent
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def union(self, a, b) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            low, high = (a, b) if a < b else (b, a)
            self.parent[high] = low

    def edges(self) -> list[tuple]:
        return [(self.find(x), x) for x in list(self.parent) if self.find(x) != x]


def _forest(kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                forest.union(a, b)
        out = forest.edges()
        for i in range(0, len(out), 100_000):
            part = out[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in part], kind), pa.array([x[1] for x in part], kind)], ["a", "b"])

    return run


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the least node of the component.

    Each task first reduces its own edges to a forest.  Then, round by round, every edge goes to the
    partitions of both its ends, each partition merges what meets there into stars and keeps only
    those; stars survive unchanged, and nothing else does, so the rounds end when nothing changes.
    Memory of a task is that of its partition's distinct edges, never that of a component: a node
    with very many neighbours holds one entry for each.  Null ends and loops are ignored; an empty
    table gives an empty result.  Lineage is cut by checkpoint() each round.
    """
    kind = edges.schema["a"].dataType.simpleString()
    if kind not in ("bigint", "string"):
        raise TypeError("edge ends must be bigint or string")
    arrow = pa.int64() if kind == "bigint" else pa.string()
    schema = f"a {kind}, b {kind}"
    merge = _forest(arrow)
    now = edges.select("a", "b").where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    now = cut(now.mapInArrow(merge, schema).distinct())
    mark = None
    while True:
        last, mark = mark, tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == last or mark[0] == 0:
            break
        to_both = now.select("a", "b", F.explode(F.array("a", "b")).alias("at"))
        now = cut(to_both.repartition("at").select("a", "b").mapInArrow(merge, schema).distinct())
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(now.select(F.col("a").alias("node"), F.col("a").alias("root"))).distinct()
