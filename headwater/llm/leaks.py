"""Passages of evaluation items that stand in a corpus.

The items make a BM25 inverted index over runs of neighbouring words, with the greatest impact of
each block of postings beside it.  Every passage (window) of every document is a query.  Its threshold
is the sum of the least impacts that so many of its runs can have, so an item that holds that many is
above it however many other items hold them, too; document-at-a-time retrieval with block-max skipping
returns every item above it.  What comes back is aligned word by word, and the words of the item's
question and answer around the place are counted.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwater.llm import words as W

# Cyrillic and Greek letters and signs that look like a Latin letter.
_LOOKALIKE = str.maketrans(
    dict(
        zip(
            "аеорсухіјѕһԁԛԝӏкмтвнпгбАВЕКМНОРСТУХІЈЅαβγδεικνορτυχωΑΒΕΖΗΙΚΜΝΟΡΤΥΧıøØłŁđĐɑɡƒ",
            "aeopcyxijshdqwlkmtbhnrbABEKMHOPCTYXIJSaßydeiknoptuxwABEZHIKMNOPTYXioOlLdDagf".replace("ß", "b"),
        )
    )
)
_TAG = re.compile(r"<!--.*?-->|</?[A-Za-z][^<>]*>", re.S)
_LINK = re.compile(r"\]\([^()\s]*(?:\s+\"[^\"]*\")?\)|\]\[[^\]]*\]")
_ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|%([0-7][0-9A-Fa-f])|=([2-7][0-9A-F])(?![0-9A-Za-z])")


def _unescape(m: re.Match) -> str:
    code = int(next(x for x in m.groups() if x), 16)
    return chr(code) if code < 0x110000 else m[0]


_C_ESCAPE = re.compile(r"\\[nrt]")
_HYPHEN_BREAK = re.compile(r"(?<=[^\W\d_])[-‐­][ \t]*\r?\n[ \t>]*(?=[^\W\d_])")
_GLUE = str.maketrans("", "", "*~`\\")
#: Combining marks, variation selectors and characters without width.
_UNSEEN = re.compile("[̀-ͯ҃-҉᪰-᫿᷀-᷿⃐-⃿゙゚︠-︯︀-️­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁤⁦-⁯﻿\U000e0000-\U000e01ef]+")
_WORD = re.compile(r"[a-z0-9]+|[^\W_a-z0-9]+")
_ASCII_WORD = re.compile(r"[a-z0-9]+")


def plain_words(text: str) -> list[str]:
    """Words without case, accents, look-alike or invisible characters, markup, escapes and line breaks."""
    s = text
    if "<" in s:
        s = _TAG.sub("", s)
    if "&" in s:
        s = html.unescape(s)
    if "](" in s or "][" in s:
        s = _LINK.sub("]", s)
    if "\\u" in s or "\\x" in s or "%" in s:
        s = _ESCAPE.sub(_unescape, s)
    if "\\" in s:
        s = _C_ESCAPE.sub(" ", s)
    if "-\n" in s or "-\r" in s or "\u00ad" in s or "\u2010" in s:
        s = _HYPHEN_BREAK.sub("", s)
    if not s.isascii():
        s = _UNSEEN.sub("", unicodedata.normalize("NFKD", s)).translate(_LOOKALIKE)
    s = s.translate(_GLUE).lower()
    return _ASCII_WORD.findall(s) if s.isascii() else _WORD.findall(s)


def _hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(W._memo.__getitem__, words), np.uint64, len(words))


class ItemIndex:
    """BM25 over runs of gram words; postings by passage number in blocks with their greatest impact.

    Held as arrays (one entry per different run of a passage); the lists of a term are made when it is first asked for.
    """

    BLOCK, CACHE = 16, 1 << 16

    def __init__(self, passages: list[np.ndarray], gram: int = 4, k1: float = 1.2, b: float = 0.25) -> None:
        self.passages, self.gram = passages, gram
        grams = [W.ngram_hashes(p, gram) for p in passages]
        lengths = np.array([len(g) for g in grams], float)
        mean = lengths.mean() if lengths.sum() else 1.0
        value = np.concatenate([*grams, np.empty(0, np.uint64)])
        owner = np.repeat(np.arange(len(grams), dtype=np.int32), [len(g) for g in grams])
        order = np.lexsort((owner, value))
        value, owner = value[order], owner[order]
        new = np.concatenate([[True], (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])]) if len(value) else np.empty(0, bool)
        at = np.nonzero(new)[0]
        tf = np.diff(np.concatenate([at, [len(value)]]))
        value, self.owner = value[at], owner[at]
        first = np.concatenate([[True], value[1:] != value[:-1]]) if len(value) else np.empty(0, bool)
        self.start = np.concatenate([np.nonzero(first)[0], [len(value)]])
        self.terms, df = value[first], np.diff(self.start)
        idf = np.repeat(np.log(1 + (len(passages) - df + 0.5) / (df + 0.5)), df)
        self.impact = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * lengths[self.owner] / mean)) if len(value) else np.empty(0)
        self.most = np.maximum.reduceat(self.impact, self.start[:-1]) if len(value) else np.empty(0)
        self.least = np.minimum.reduceat(self.impact, self.start[:-1]) if len(value) else np.empty(0)
        self._lists: dict[int, tuple] = {}

    def postings(self, t: int) -> tuple[list[int], list[float], list[int], list[float]]:
        got = self._lists.get(t)
        if got is None:
            if len(self._lists) >= self.CACHE:
                self._lists.clear()
            lo, hi = self.start[t], self.start[t + 1]
            ids, impact = self.owner[lo:hi].tolist(), self.impact[lo:hi].tolist()
            blocks = range(0, len(ids), self.BLOCK)
            got = self._lists[t] = (ids, impact, [ids[min(j + self.BLOCK, len(ids)) - 1] for j in blocks], [max(impact[j : j + self.BLOCK]) for j in blocks])
        return got

    def threshold(self, terms: list[int], runs: int) -> float | None:
        """What an item that holds any ``runs`` of the terms reaches; None if there are fewer terms."""
        return float(np.sort(self.least[terms])[:runs].sum()) - 1e-9 if len(terms) >= runs else None

    def lookup(self, grams: np.ndarray) -> np.ndarray:
        """Term number of each gram, -1 if no item holds it."""
        if not len(self.terms) or not len(grams):
            return np.full(len(grams), -1)
        at = np.minimum(np.searchsorted(self.terms, grams), len(self.terms) - 1)
        return np.where(self.terms[at] == grams, at, -1)

    def above(self, terms: list[int], threshold: float) -> list[int]:
        """Every item whose score over the distinct terms reaches the threshold (block-max WAND)."""
        cursors = [[0, t] for t in terms]
        out, post, most = [], {t: self.postings(t) for t in terms}, self.most
        while cursors:
            cursors.sort(key=lambda c: post[c[1]][0][c[0]])
            bound, pivot = 0.0, None
            for i, (at, t) in enumerate(cursors):
                bound += most[t]
                if bound >= threshold:
                    pivot = i
                    break
            if pivot is None:
                return out
            item = post[cursors[pivot][1]][0][cursors[pivot][0]]
            while pivot + 1 < len(cursors) and post[cursors[pivot + 1][1]][0][cursors[pivot + 1][0]] == item:
                pivot += 1
            tight, upto = 0.0, None
            for at, t in cursors[: pivot + 1]:
                last, top = post[t][2], post[t][3]
                block = int(np.searchsorted(last, item)) if len(last) > 1 else 0
                if block < len(last):
                    tight += top[block]
                    upto = last[block] if upto is None else min(upto, last[block])
            if tight >= threshold and post[cursors[0][1]][0][cursors[0][0]] == item:
                score = sum(post[t][1][at] for at, t in cursors[: pivot + 1])
                if score >= threshold:
                    out.append(item)
                target = item + 1
            elif tight >= threshold:
                target = item
            else:
                following = post[cursors[pivot + 1][1]][0][cursors[pivot + 1][0]] if pivot + 1 < len(cursors) else None
                target = (upto if upto is not None else item) + 1
                target = max(item + 1, min(target, following)) if following is not None else max(item + 1, target)
            kept = []
            for i, (at, t) in enumerate(cursors):
                ids = post[t][0]
                if i <= pivot:
                    while at < len(ids) and ids[at] < target:
                        at += 1
                if at < len(ids):
                    kept.append([at, t])
            cursors = kept
        return out


def longest_stretch(doc: np.ndarray, passage: np.ndarray, *, most_changed: float = 0.125, shortest: int = 1) -> tuple[int, int, int]:
    """(words of the passage, changed ones, where it begins in doc) of the longest stretch that doc holds with at most that share changed.

    Exact runs of ``shortest`` words or more are chained in order; of the words between two runs of a chain (the
    longer side's) all are changed ones.  For every end of a chain and every number of changed words the
    longest chain is kept, so none is lost; a gap is at most as long as the whole passage allows.
    """
    budget = int(most_changed * len(passage))
    where: dict[int, list[int]] = {}
    for j, w in enumerate(passage.tolist()):
        where.setdefault(w, []).append(j)
    runs, open_ = [], {}
    for i, w in enumerate(doc.tolist()):
        now = {}
        for j in where.get(w, ()):
            run = open_.pop((i - 1, j - 1), None) or [i, j, 0]
            run[2] += 1
            now[i, j] = run
        runs += [r for r in open_.values() if r[2] >= shortest]
        open_ = now
    runs += [r for r in open_.values() if r[2] >= shortest]
    runs.sort()
    best = (0, 0, 0)
    # Chains by the doc word after their end: (passage word after it, {changed words: (first passage word, first doc word)}).
    ended: dict[int, list[tuple[int, dict[int, tuple[int, int]]]]] = {}
    for i, j, n in runs:
        mine = {0: (j, i)}
        for pi in range(max(0, i - budget), i + 1):
            for pj, options in ended.get(pi, ()):
                if 0 <= j - pj <= budget:
                    gap = max(i - pi, j - pj)
                    for c, first in options.items():
                        if c + gap <= budget and (c + gap not in mine or first < mine[c + gap]):
                            mine[c + gap] = first
        kept, least = {}, None
        for c in sorted(mine):
            if least is None or mine[c][0] < least:
                kept[c] = mine[c]
                least = mine[c][0]
        ended.setdefault(i + n, []).append((j + n, kept))
        for c, (f, at) in kept.items():
            span = j + n - f
            if c <= most_changed * span and (span, -c) > (best[0], -best[1]):
                best = (span, c, at)
    return best


def may_hold(doc: np.ndarray, passage: np.ndarray, least: int) -> bool:
    """Whether some stretch of doc of about ``least`` words has enough words of the passage, in any order, for a case."""
    changed = least // 8
    known = np.concatenate([[0], np.cumsum(np.isin(doc, passage))])
    width = min(least + changed, len(doc))
    return bool((known[width:] - known[:-width]).max() >= least - 2 * changed)


def _share(words: frozenset, around: frozenset) -> float | None:
    return len(words & around) / len(words) if words else None


def _search_rows(index_of, window: int, least: int, runs: int, around: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, items = index_of()
        g = index.gram
        step = window // 2
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for key, text in zip(b.column(0).to_pylist(), b.column(1)):
                h = _hashes(plain_words(text.as_py()))
                if len(h) < least or not len(index.terms):
                    continue
                term = index.lookup(W.ngram_hashes(h, g))
                hits = np.concatenate([[0], np.cumsum(term >= 0)])
                if hits[-1] < runs:
                    continue
                starts = np.arange(0, max(1, len(h) - window + step), step)
                ends = np.minimum(starts + window - g + 1, len(term))
                found: dict[int, tuple[int, int]] = {}
                worth = hits[np.maximum(ends, starts)] - hits[starts] >= runs
                for s, e in zip(starts[worth].tolist(), ends[worth].tolist()):
                    inside = np.unique(term[s:e])
                    inside = inside[inside >= 0].tolist()
                    threshold = index.threshold(inside, runs)
                    if threshold is None:
                        continue
                    for item in index.above(inside, threshold):
                        lo, hi = found.get(item, (s, s + window))
                        found[item] = (min(lo, s), max(hi, s + window))
                for number, (lo, hi) in found.items():
                    start = max(0, lo - step)
                    part, passage = h[start : hi + step], index.passages[number]
                    if not may_hold(part, passage, least):
                        continue
                    span, c, at = longest_stretch(part, passage, shortest=2)
                    if span < least:  # words that stand alone between changed ones may still make it long enough
                        span, c, at = longest_stretch(part, passage)
                    if span >= least:
                        at += start
                        near = frozenset(h[max(0, at - around) : at + span + around].tolist())
                        for item, question, answer in items[number]:
                            for column, v in zip(out, (key, item, span, c, _share(question, near), _share(answer, near))):
                                column.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["id", "item_id", "words", "changed", "question", "answer"])

    return run


def leaked_passages(
    docs: DataFrame, id_col: str, text_col: str, items: DataFrame, *, least_words: int = 20, window: int = 40, runs: int = 5, around: int = 100, most_passages: int = 100_000, most_chars: int = 1 << 25
) -> DataFrame:
    """(id_col, item_id, words, changed, question, answer): every item of which a document holds at least least_words words in one stretch.

    words and changed describe the longest such stretch; question and answer are the shares of the
    different words of the item's instruction and answer that stand in it or within ``around`` words of
    it, null without any.  Items with the same passage all count.  A window of ``window`` words, half of
    it new each time, contains every stretch of half its length whole, and such a stretch keeps more
    than ``runs`` of its four-word runs when one word in ten is changed.  The index goes to every task:
    items are taken in blocks of about most_passages rows or most_chars characters, and the documents
    are searched for each block, so any number of items is searched in bounded memory.  Null, empty and
    short texts and passages give no rows, repeated rows repeated results; other columns are ignored;
    empty tables give an empty result.
    """
    if window < 2 * least_words:
        raise ValueError("window must be twice least_words at least")
    spark = docs.sparkSession
    given = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("passage").cast("string").alias("passage"), *((F.col(c) if c in items.columns else F.lit(None)).cast("string").alias(c) for c in ("instruction", "answer")))
    given = given.where(F.col("passage").isNotNull() & F.col("item_id").isNotNull())
    n, chars = given.agg(F.count("*"), F.coalesce(F.sum(F.length(F.concat_ws(" ", "passage", "instruction", "answer"))), F.lit(0))).first()
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull())
    schema = "id long, item_id long, words int, changed int, question double, answer double"
    blocks, hits = max(1, -(-n // most_passages), -(-chars // most_chars)), []
    for block in range(blocks):
        # Rows of one block; equal passages are in the same one.
        rows = given.where(F.pmod(F.xxhash64("passage"), F.lit(blocks)) == block).collect()
        shared = spark.sparkContext.broadcast([tuple(r) for r in rows])
        hits.append(texts.mapInArrow(_search_rows(_index_of(shared, least_words), window, least_words, runs, around), schema))
    out = hits[0]
    for more in hits[1:]:
        out = out.unionByName(more)
    return out.withColumnRenamed("id", id_col)


def item_index(rows: list[tuple], least_words: int) -> tuple[ItemIndex, list[list[tuple]]]:
    """Index of the different passages of (item_id, passage, instruction, answer), and the items of each."""
    numbers: dict[bytes, int] = {}
    passages: list[np.ndarray] = []
    items: list[list[tuple]] = []
    for item, passage, instruction, answer in rows:
        h = _hashes(plain_words(passage))
        if len(h) >= least_words:
            number = numbers.setdefault(h.tobytes(), len(passages))
            if number == len(passages):
                passages.append(h), items.append([])
            items[number].append((item, *(frozenset(_hashes(plain_words(x)).tolist()) if x else frozenset() for x in (instruction, answer))))
    return ItemIndex(passages), items


_INDEX: dict = {}


def _index_of(shared, least_words: int):
    def get() -> tuple[ItemIndex, list[list[tuple]]]:
        """Built once a worker."""
        key = (shared._jbroadcast.id() if getattr(shared, "_jbroadcast", None) is not None else id(shared), least_words)
        if key not in _INDEX:
            _INDEX.clear()
            _INDEX[key] = item_index(shared.value, least_words)
        return _INDEX[key]

    return get
