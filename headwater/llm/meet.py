"""Pairs of texts that meet at a key, whatever number of texts a key has.

Rows of a key that few texts have are paired where they meet.  A key of more than ``limit`` texts
is refined: its rows go on to two narrower keys each, made of the key and one minwise value of the
text, so texts of similarity s still meet at each with chance s while unrelated ones hardly do.
Keys that are still crowded are refined once more, and what meets after that is joined without a
limit.  Every pair is compared by a packed sketch where it meets; only those that may be similar leave.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwater.llm import words as W
from headwater.session import cut

_LOW2 = 0x5555555555555555
#: Values of the sketch (two bits each) that travels with every key, and 16-bit values to refine a key by.
VALUES, PARTS = 128, 4
_SKETCH = ("a", "b", "c", "d")
#: key; the text; its distinct runs, negative on side 0; sketch; four 16-bit minwise values; level 0, or 1 for rows already refined.
COLUMNS = ("key", "id", "size", *_SKETCH, "m")
SCHEMA = ", ".join(f"{c} long" for c in COLUMNS) + ", level int"
#: Pairs that are compared at once; some ten arrays of that length are held.
_PAIRS = 1 << 17


def pack(values: np.ndarray, bits: int) -> np.ndarray:
    """The low bits of each value, packed side by side into signed 64-bit words."""
    per = 64 // bits
    low = (values & np.uint64((1 << bits) - 1)).reshape(-1, per)
    shifts = (np.arange(per, dtype=np.uint64) * np.uint64(bits))[None, :]
    return (low << shifts).sum(axis=1, dtype=np.uint64).view(np.int64)


def least_agreeing(n: int, bits: int, similarity: float, deviations: float = 4) -> int:
    """Agreements among n values of that many bits, so many standard deviations below what a pair at the threshold shows."""
    p = similarity + (1 - similarity) / 2**bits
    return max(1, int(n * p - deviations * (n * p * (1 - p)) ** 0.5))


def row_arrays(key: np.ndarray, of: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sketches, a row per text, and for every key of a text (number ``of``) the four values that refine it.

    values: VALUES 16-bit minwise values, a row per text; which ones refine a key follows from the key alone.
    """
    coarse = pack((values >> np.uint64(8)).ravel(), 2).reshape(len(values), len(_SKETCH))
    first = (key.view(np.uint64) >> np.uint64(7)) % np.uint64(VALUES)
    m = np.zeros(len(key), np.uint64)
    for i in range(PARTS):
        m |= values[of, ((first + np.uint64(37 * i)) % np.uint64(VALUES)).astype(np.int64)] << np.uint64(16 * i)
    return coarse, m.view(np.int64)


def refine(key: np.ndarray, m: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """The two narrower keys of every row, and the rows they belong to."""
    k = key.view(np.uint64)
    out = [W.mix(k * W._K[2] + ((m.view(np.uint64) >> np.uint64(16 * (2 * level + i))) & np.uint64(0xFFFF)) * W._K[5] + np.uint64(2 * level + i + 1)) for i in (0, 1)]
    return np.concatenate(out).view(np.int64), np.concatenate([np.arange(len(key))] * 2)


def crowd(key: np.ndarray, limit: int) -> np.ndarray:
    """Which rows of a batch come after the first limit + 1 of their key.

    They skip the first exchange: the rows that don't still show there that the key is crowded, so
    one task never gets more than limit + 1 rows of a key from a batch.
    """
    order = np.argsort(key, kind="stable")
    k = key[order]
    start = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.empty(0, bool)
    place = np.arange(len(k)) - np.maximum.accumulate(np.where(start, np.arange(len(k)), 0)) if len(k) else np.empty(0, np.int64)
    out = np.zeros(len(key), bool)
    out[order] = place > limit
    return out


def key_batch(key: np.ndarray, of: np.ndarray, node: np.ndarray, size: np.ndarray, values: np.ndarray, limit: int) -> pa.RecordBatch:
    """Rows of one batch of texts (of: the text of each key): level 0, and refined ones for what is crowded in the batch already."""
    coarse, m = row_arrays(key, of, values)
    over = crowd(key, limit)
    rest, late = np.nonzero(~over)[0], np.nonzero(over)[0]
    narrow, again = refine(key[late], m[late], 0)
    at = np.concatenate([rest, late[again]])
    text = of[at]
    level = np.concatenate([np.zeros(len(rest), np.int32), np.ones(len(again), np.int32)])
    cols = [np.concatenate([key[rest], narrow]), node[text], size[text].astype(np.int64), *(coarse[text, i] for i in range(len(_SKETCH))), m[at], level]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], [*COLUMNS, "level"])


def _pairs(rows: list[np.ndarray], start: np.ndarray, count: np.ndarray, two_sided: bool, similarity: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the pairs within groups of rows that sizes and sketches leave."""
    node, signed, sketch = rows[1], rows[2], rows[3:-1]
    size = np.abs(signed)
    first = np.concatenate([[0], np.cumsum(signed < 0)])
    left = first[start + count] - first[start] if two_sided else count
    right = count - left if two_sided else count
    n, out = left * right, []
    worth = n > 0
    start, left, right, n = start[worth], left[worth], right[worth], n[worth]
    ends = np.cumsum(n)
    lo = 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + _PAIRS, "right")))
        g = np.repeat(np.arange(lo, hi), n[lo:hi])
        at = np.arange(len(g)) - np.repeat(np.cumsum(n[lo:hi]) - n[lo:hi], n[lo:hi])
        i = start[g] + at // right[g]
        j = start[g] + at % right[g] + (left[g] if two_sided else 0)
        keep = (size[i] >= similarity * size[j]) & (size[j] >= similarity * size[i])
        if not two_sided:  # a text may have a key twice
            keep &= (i < j) & (node[i] != node[j])
        i, j = i[keep], j[keep]
        if least:
            differ = np.zeros(len(i), np.int64)
            for c in sketch:
                x = (c[i] ^ c[j]).view(np.uint64)
                differ += np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(_LOW2))
            ok = VALUES - differ >= least
            i, j = i[ok], j[ok]
        x, y = node[i], node[j]
        if not two_sided:
            x, y = np.minimum(x, y), np.maximum(x, y)
        out.append((x, y))
        lo = hi
    return (np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])) if out else (np.empty(0, np.int64),) * 2


_MET_COLUMNS = ("x", "y", *COLUMNS[2:])
_MET = ", ".join(f"{c} long" for c in _MET_COLUMNS) + ", crowded boolean"


def _meet_rows(limit: int, two_sided: bool, similarity: float, least: int, level: int):
    """Rows in order of key (and size, so side 0 first): pairs of the keys of at most limit rows, and all
    rows of the others with a narrower key in x.

    Holds one batch and the rows of one key, at most limit + 1 of them.
    """

    def emit(pairs: tuple[np.ndarray, np.ndarray], rows: list[np.ndarray]) -> pa.RecordBatch:
        x, y = pairs
        if len(x):  # each pair once a batch
            order = np.lexsort((y, x))
            x, y = x[order], y[order]
            new = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
            x, y = x[new], y[new]
        narrow, of = refine(rows[0], rows[-1], level)
        zero = np.zeros(len(x), np.int64)
        cols = [np.concatenate([x, narrow]), np.concatenate([y, rows[1][of]]), *(np.concatenate([zero, c[of]]) for c in rows[2:]), np.arange(len(x) + len(of)) >= len(x)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], [*_MET_COLUMNS, "crowded"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = [np.empty(0, np.int64)] * len(COLUMNS)
        open_, hot = none, None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [np.concatenate([o, batch.column(i).to_numpy(zero_copy_only=False)]) for i, o in enumerate(open_)]
            key = rows[0]
            starts = np.concatenate([[0], np.nonzero(key[1:] != key[:-1])[0] + 1])
            count = np.diff(np.concatenate([starts, [len(key)]]))
            crowded = count > limit
            if hot is not None and key[0] == hot:
                crowded[0] = True
            last_hot = bool(crowded[-1])
            hot = key[-1] if last_hot else None
            cold = ~crowded
            cold[-1] = False  # may go on in the next batch
            over = np.repeat(crowded, count)
            yield emit(_pairs(rows, starts[cold], count[cold], two_sided, similarity, least), [r[over] for r in rows])
            open_ = none if last_hot else [r[starts[-1] :] for r in rows]
        if len(open_[0]):
            yield emit(_pairs(open_, np.array([0]), np.array([len(open_[0])]), two_sided, similarity, least), none)

    return run


def _agreeing(left: str, right: str) -> Column:
    differ = []
    for c in _SKETCH:
        x = F.col(f"{left}.{c}").bitwiseXOR(F.col(f"{right}.{c}"))
        differ.append(F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(_LOW2))))
    return F.lit(VALUES) - sum(differ[1:], differ[0])


def met_pairs(rows: DataFrame, *, two_sided: bool, similarity: float, limit: int = 512, deviations: float = 4) -> DataFrame:
    """(x, y) of texts that meet at a key of rows (SCHEMA), without repeats; x is of side 0 and y of side 1, or x < y.

    Sizes must differ by less than the similarity allows and the sketches agree up to
    ``deviations`` standard deviations below it.  One exchange by key; a second and third of the
    crowded rows only.
    """
    least = least_agreeing(VALUES, 2, similarity, deviations)

    def level(of: DataFrame, no: int) -> DataFrame:
        return of.select(*COLUMNS).repartition("key").sortWithinPartitions("key", "size").mapInArrow(W.freed(_meet_rows(limit, two_sided, similarity, least, no)), _MET)

    first = cut(level(rows.where("level = 0"), 0))
    narrower = lambda met: met.where("crowded").select(F.col("x").alias("key"), F.col("y").alias("id"), *COLUMNS[2:])
    second = cut(level(narrower(first).unionByName(rows.where("level = 1").select(*COLUMNS)), 1))
    rest = narrower(second)
    left, right = (rest.where("size < 0"), rest.where("size >= 0")) if two_sided else (rest, rest)
    small, large = F.abs(F.col("l.size")), F.abs(F.col("r.size"))
    third = (
        left.alias("l").join(right.alias("r"), F.col("l.key") == F.col("r.key"))
        .where(F.lit(True) if two_sided else F.col("l.id") < F.col("r.id"))
        .where((small >= similarity * large) & (large >= similarity * small) & (_agreeing("l", "r") >= least))
        .select(F.col("l.id").alias("x"), F.col("r.id").alias("y"))
    )
    return first.where("not crowded").select("x", "y").unionByName(second.where("not crowded").select("x", "y")).unionByName(third).distinct()
