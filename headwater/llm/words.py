"""Words, shingles, winnowed fingerprints and minwise sketches, vectorised with numpy.

A *word* is a longest run of letters and digits, in lower case.  Words become 64-bit hashes once
per worker (memoised), everything after that is array arithmetic.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

WORD = re.compile(r"[^\W_]+")

_MEMO_LIMIT = 1 << 20
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9FB21C651E98DF25)]
_S32 = np.uint64(32)
_M = np.uint64(0xD6E8FEB86659FD93)


class _Memo(dict):
    """word -> 64-bit hash; emptied when it reaches its limit, which only costs time."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _MEMO_LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_memo = _Memo()


def forget() -> None:
    """Gives back what this worker holds of its last task."""
    _memo.clear()
    pa.default_memory_pool().release_unused()


def freed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """The same function, after whose task a worker waits for the next without the words and batches of this one."""

    def then(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            forget()

    return then


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = (x ^ (x >> _S32)) * _M
    x = (x ^ (x >> _S32)) * _M
    return x ^ (x >> _S32)


def word_hashes(text: str) -> np.ndarray:
    """uint64 hash of every word of the whole text, in order."""
    words = WORD.findall(text.lower())
    return np.fromiter(map(_memo.__getitem__, words), np.uint64, len(words))


def ngram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """uint64 hash of every run of k neighbouring words, in order (empty if there are fewer)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    acc = h[:n] * _K[0]
    for i in range(1, k):
        acc = acc + h[i : i + n] * _K[i % len(_K)] * np.uint64(2 * (i // len(_K)) + 1)
    return mix(acc)


def winnow(grams: np.ndarray, w: int) -> np.ndarray:
    """Positions chosen by winnowing: the rightmost minimum of every window of w neighbouring grams.

    Any run of w grams that two sequences share contains a position chosen in both; what a window
    of w chooses, a shorter window over the same run chooses too.
    """
    n = len(grams)
    if n == 0:
        return np.empty(0, np.int64)
    w = max(1, min(w, n))
    if w == 1:
        return np.arange(n)
    view = np.lib.stride_tricks.sliding_window_view(grams, w)
    at = (w - 1) - np.argmin(view[:, ::-1], axis=1) + np.arange(n - w + 1)
    return np.unique(at)


def window_minima(grams: np.ndarray, w: int) -> np.ndarray:
    """The least of every window of w neighbouring grams (of all, if there are fewer): the values that winnowing chooses."""
    out, have, w = grams, 1, max(1, min(w, len(grams)))
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


_rng = np.random.default_rng(20240607)
_MULTIPLIERS = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minwise(shingles: np.ndarray, n: int) -> np.ndarray:
    """n minwise values of a non-empty set of 64-bit hashes (multiply, keep the least)."""
    out = np.empty(n, np.uint64)
    step = max(1, (1 << 16) // max(1, len(shingles)))
    for i in range(0, n, step):
        out[i : i + step] = (shingles[None, :] * _MULTIPLIERS[i : min(n, i + step), None]).min(axis=1)
    return mix(out)


def set_signature(unique: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit sums which, together with the size, stand for the set."""
    with np.errstate(over="ignore"):
        a = int(mix(unique + _K[3]).sum(dtype=np.uint64).view(np.int64)) if len(unique) else 0
        b = int(mix(unique * _K[4] + np.uint64(1)).sum(dtype=np.uint64).view(np.int64)) if len(unique) else 0
    return a, b


def sequence_signature(h: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit hashes of the words in their order."""
    raw = h.tobytes()
    a, b = xxhash.xxh3_128_intdigest(raw).to_bytes(16, "little")[:8], xxhash.xxh3_128_intdigest(raw).to_bytes(16, "little")[8:]
    return int.from_bytes(a, "little", signed=True), int.from_bytes(b, "little", signed=True)
