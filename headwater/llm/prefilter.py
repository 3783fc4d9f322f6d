"""A set of keys as a bitmap sized by their number, to tell rows apart before they are shuffled."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bitmaps have between 2 ** LEAST and 2 ** MOST bits (16 MB), whatever the table.
LEAST, MOST = 16, 27


def bits_for(n: int) -> int:
    """About sixteen bits a key, so one in sixteen other keys passes; beyond 2 ** 23 keys more do, which costs time only."""
    return max(LEAST, min(MOST, (16 * max(1, n)).bit_length()))


def bit_of(*keys: str | Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(1 << bits))


def bitmap_of(bit: DataFrame, bits: int) -> np.ndarray:
    """2 ** bits bits, set for the values of the column ``bit``.

    Aggregated to 64-bit words before it is gathered: at most 2 ** (bits - 6) rows of two numbers reach the driver.
    """
    word = bit.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 64).cast("int"))).alias("value"))
    out = np.zeros(1 << (bits - 6), np.int64)
    got = word.toArrow()
    out[got.column("word").to_numpy()] = got.column("value").to_numpy()
    return out.view(np.uint64)


def bitmap(wanted: DataFrame, *keys: str, bits: int) -> np.ndarray:
    """Set for the keys of wanted.  Other keys may share a bit, so what passes still has to be joined; the more keys, the more do."""
    return bitmap_of(wanted.select(bit_of(*keys, bits=bits).alias("bit")), bits)


def _picked(words: np.ndarray, then: Callable | None, set_: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def kept() -> Iterator[pa.RecordBatch]:
            for b in batches:
                bit = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False).astype(np.uint64)
                hit = (((words[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1)) != 0) == set_
                if hit.any():
                    names = b.schema.names[:-1]
                    yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(names))], names).filter(pa.array(hit))

        yield from then(kept()) if then else kept()

    return run


def only(words: np.ndarray, then: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None):
    """Batches whose last column is bit_of(...): rows without their bit are dropped, the others handed on without the column."""
    return _picked(words, then, True)


def without(words: np.ndarray, then: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None):
    """The rows that ``only`` drops."""
    return _picked(words, then, False)
