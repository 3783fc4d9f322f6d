"""Pairs of texts of two sides, the longer of which holds a share of the shorter one's distinct word runs.

Of a text's n runs a partner has to hold t, so it lacks at most n - t of them, and of any n - t + l it
holds l at least.  Every text asks for that many of its runs, those that the fewest texts of the other
side have, and a run that none has counts as lacking without being asked.  The other side answers with
all of its runs that are asked for.  The pairs that meet l times or more are a superset of the true
ones, without a limit to the texts of a run: what many texts hold is asked for only by texts that
hold hardly anything else.

Tables of a fixed size tell which runs the other side may have, how many texts about, and which are
asked for; where several runs share a place, more is asked and answered than need be, never less.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwater.llm import words as W
from headwater.llm.prefilter import bits_for
from headwater.session import cut

#: Bitmaps have at most 2 ** MOST bits (8 MB), tables of counts 2 ** MOST_COUNTS places (4 MB as they are handed out).
MOST, MOST_COUNTS = 26, 21
_CHUNK = 1 << 16
#: Runs that a task handles at once: they bound its memory, not what it finds.
_STEP = 1 << 18
_TABLE = 1 << 32


def asked(n: int, share: float) -> tuple[int, int, int]:
    """Of n runs: how many a partner may lack, how many are asked for, and how many of these it holds at least."""
    t = max(1, ceil(share * n - 1e-6))
    least = min(2 + n // 20, t)
    return n - t, n - t + least, least


def _texts(batches: Iterator[pa.RecordBatch], k: int, least_words: int) -> Iterator[tuple[pa.RecordBatch, list[int], list[np.ndarray], np.ndarray]]:
    """Batches of (node, kind_no, side, ..., text), rows that count, their distinct runs in order, sides; about _STEP runs, or one text, at a time."""
    for b in batches:
        kinds, sides, at, keys, n = b.column(1).to_pylist(), b.column(2).to_numpy(zero_copy_only=False), [], [], 0
        for i, text in enumerate(b.column(b.num_columns - 1)):
            h = W.word_hashes(text.as_py())
            if len(h) >= max(least_words, k):
                at.append(i), keys.append(np.unique(W.mix(W.ngram_hashes(h, k) + W._K[6] * np.uint64(kinds[i]))))
                n += len(keys[-1])
                if n >= _STEP:
                    yield b, at, keys, sides[at]
                    at, keys, n = [], [], 0
        if at:
            yield b, at, keys, sides[at]


def _place(keys: np.ndarray, bits: int) -> np.ndarray:
    return keys >> np.uint64(64 - bits)


def _set_at(words: np.ndarray, bit: np.ndarray) -> np.ndarray:
    return ((words[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1)).astype(bool)


def _has(words: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    return _set_at(words, _place(keys, bits))


def _set(words: np.ndarray, keys: np.ndarray, bits: int) -> None:
    bit = np.unique(_place(keys, bits))
    if len(bit):
        word = bit >> np.uint64(6)
        start = np.concatenate([[0], np.nonzero(word[1:] != word[:-1])[0] + 1])
        words[word[start]] |= np.bitwise_or.reduceat(np.uint64(1) << (bit & np.uint64(63)), start)


def _chunks(tables: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    for no, table in enumerate(tables):
        step = _CHUNK // table.itemsize
        for i in range(0, len(table), step):
            if table[i : i + step].any():
                yield pa.RecordBatch.from_arrays([pa.array([no * _TABLE + i // step], pa.int64()), pa.array([table[i : i + step].tobytes()], pa.binary())], ["no", "part"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of the same number as one: bits (tables 0 and 1) or-ed, counts added."""
    have: dict[int, np.ndarray] = {}
    for b in batches:
        for no, part in zip(b.column(0).to_pylist(), b.column(1)):
            bits = no < 2 * _TABLE
            x = np.frombuffer(part.as_py(), np.uint64 if bits else np.uint32)
            have[no] = (have[no] | x if bits else have[no] + x) if no in have else x
    for no, x in have.items():
        yield pa.RecordBatch.from_arrays([pa.array([no], pa.int64()), pa.array([x.tobytes()], pa.binary())], ["no", "part"])


def _gathered(rows: DataFrame, make: Callable, tables: list[np.ndarray]) -> list[np.ndarray]:
    """The empty tables, filled with what tasks of about the number of the cores make of the rows."""
    spark = rows.sparkSession
    parts = rows.coalesce(2 * spark.sparkContext.defaultParallelism).mapInArrow(make, "no long, part binary")
    got = parts.repartition("no").mapInArrow(_merged, "no long, part binary").toArrow()
    for no, part in zip(got.column("no").to_pylist(), got.column("part")):
        table, i = tables[no // _TABLE], no % _TABLE
        x = np.frombuffer(part.as_py(), table.dtype)
        table[i * (_CHUNK // table.itemsize) :][: len(x)] = x
    return tables


def _empty(bits: int, counts: int | None = None) -> list[np.ndarray]:
    return [np.zeros(1 << (bits - 6), np.uint64) for _ in range(2)] + [np.zeros(1 << counts, np.uint32) for _ in range(2) if counts]


def _seen(k: int, least_words: int, bits: int, counts: int):
    """Of either side the bits of all runs, and how many runs fall to a place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _empty(bits, counts)
        for _, _, keys, sides in _texts(batches, k, least_words):
            for side in (0, 1):
                if (sides == side).any():
                    all_ = np.concatenate([x for x, s in zip(keys, sides) if s == side])
                    _set(tables[side], all_, bits)
                    np.add.at(tables[2 + side], _place(all_, counts).astype(np.int64), np.uint32(1))
        yield from _chunks(tables)

    return run


def _asks(keys: np.ndarray, there: np.ndarray, count: np.ndarray, share: float, bits: int, counts: int) -> tuple[np.ndarray, int]:
    """Which of a text's runs it asks the other side for, and how many of them a partner holds at least; none if it can't have one."""
    lack, ask, least = asked(len(keys), share)
    at = np.nonzero(_has(there, keys, bits))[0]
    gone = len(keys) - len(at)
    if gone > lack:
        return at[:0], 0
    return at[np.argsort(count[_place(keys[at], counts)], kind="stable")[: ask - gone]], least


def _asked_for(k: int, least_words: int, share: float, seen: list[np.ndarray], bits: int, counts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _empty(bits)
        for _, _, keys, sides in _texts(batches, k, least_words):
            out = [[np.empty(0, np.uint64)], [np.empty(0, np.uint64)]]
            for x, s in zip(keys, sides):
                out[s].append(x[_asks(x, seen[1 - s], seen[3 - s], share, bits, counts)[0]])
            for side in (0, 1):
                _set(tables[side], np.concatenate(out[side]), bits)
        yield from _chunks(tables)

    return run


def _ask_rows(k: int, least_words: int, share: float, is_copy: np.ndarray, seen: list[np.ndarray], wanted: list[np.ndarray], bits: int, counts: int):
    """A row per run that a text asks for or answers with; size: negative on side 0; need: 0 for an answer alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, at, keys, sides in _texts(batches, k, least_words):
            picked, needs = [], []
            for x, s in zip(keys, sides):
                mine, least = _asks(x, seen[1 - s], seen[3 - s], share, bits, counts)
                need = np.zeros(len(x), np.int32)
                need[mine] = least
                keep = (need > 0) | _has(wanted[1 - s], x, bits)
                picked.append(x[keep]), needs.append(need[keep])
            of = np.repeat(np.arange(len(at)), [len(x) for x in picked])
            if len(of):
                node, bit = (b.column(i).to_numpy(zero_copy_only=False)[at] for i in (0, 3))
                copy = _set_at(is_copy, bit.astype(np.uint64))
                size = (np.array([len(x) for x in keys]) * np.where(sides == 0, -1, 1)).astype(np.int32)
                cols = [np.concatenate(picked).view(np.int64), node[of], size[of], np.concatenate(needs), copy[of]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "node", "size", "need", "copy"])

    return run


def contained_pairs(rows: DataFrame, copies: DataFrame, is_copy: np.ndarray, n_runs: int, share: float, *, k: int, least_words: int) -> DataFrame:
    """(x, y) of texts of side 0 and of side 1: all pairs of one kind of which the longer may hold ``share`` of the shorter one's runs.

    rows(node, kind_no, side, bit, text): bit is that of the node in the bitmap is_copy of copies(node),
    which are in no pair.  n_runs: of all texts, to size the tables.  Reads the texts three times.
    """
    bits = min(MOST, bits_for(n_runs))
    counts = min(MOST_COUNTS, bits - 2)
    seen = _gathered(rows, _seen(k, least_words, bits, counts), _empty(bits, counts))
    seen[2:] = [np.minimum(c, 0xFFFF).astype(np.uint16) for c in seen[2:]]
    wanted = _gathered(rows, _asked_for(k, least_words, share, seen, bits, counts), _empty(bits))
    found = cut(rows.mapInArrow(_ask_rows(k, least_words, share, is_copy, seen, wanted, bits, counts), "key long, node long, size int, need int, copy boolean"))
    heads = found.where("not copy").unionByName(found.where("copy").join(copies, "node", "left_anti").select(*found.columns))
    short, long = heads.where("need > 0").alias("s"), heads.alias("l")
    n_short, n_long = F.abs(F.col("s.size")), F.abs(F.col("l.size"))
    met = short.join(long, (F.col("s.key") == F.col("l.key")) & ((F.col("s.size") < 0) != (F.col("l.size") < 0)) & ((n_short < n_long) | ((n_short == n_long) & (F.col("s.size") > 0))))
    train = F.col("s.size") < 0
    met = met.select(F.when(train, F.col("s.node")).otherwise(F.col("l.node")).alias("x"), F.when(train, F.col("l.node")).otherwise(F.col("s.node")).alias("y"), "s.need")
    return met.groupBy("x", "y").agg(F.count("*").alias("met"), F.max("need").alias("need")).where("met >= need").select("x", "y")
