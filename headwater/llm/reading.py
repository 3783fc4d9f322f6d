"""Reading level of each document.

Every sentence of the running prose gets a level from a regularised linear model over its words and
their character trigrams, fitted on labelled samples; the mean of a document's sentence distributions
becomes its level by a calibration fitted on documents that the model hasn't seen.  Exact measures of
the prose (words per sentence, letters per word) come from the same pass.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwater.llm.labels import language_of

BANDS = ("low", "middle", "high")
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})")
_LIST = re.compile(r"^\s*(?:[-*+•]|\d{1,9}[.)])(?:\s+|$)")
_HEADING = re.compile(r"^ {0,3}#{1,6}(?:\s|$)")
_UNDERLINE = re.compile(r"^ {0,3}(?:=+|-+)\s*$")
_RULE = re.compile(r"^ {0,3}(?:(?:\*\s*){3,}|(?:-\s*){3,}|(?:_\s*){3,})$")
_HTML = re.compile(r"<!--.*?-->|</?[A-Za-z][^<>]*>", re.S)
_LINK = re.compile(r"!\[[^\]]*\]\([^)]*\)|\[([^\]]*)\]\([^)]*\)")
_CODE = re.compile(r"`+([^`]*)`+")
# Abbreviations whose dot ends no sentence.
ABBREVIATIONS = "e.g i.e cf fig figs eq no nos vs al etc approx ca ch sec vol pp p dr mr mrs ms prof st jr sr inc ltd co dept est ed eds rev gen resp viz".split()
_ABBREVIATION_SET = frozenset(ABBREVIATIONS)
_LETTERS_DOTS = re.compile(r"[^\W\d_](?:\.[^\W\d_])*")
_END = re.compile(r"[.!?]+[\"'”’)\]]*(?=\s|$)|[。！？]+")
_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")


def prose(text: str) -> list[str]:
    """Paragraphs of running prose of a markdown text: no headings, code, tables, lists, quotes, front matter."""
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    at = 0
    if lines and re.fullmatch(r"(-{3}|\+{3})\s*", lines[0].lstrip("﻿")):
        mark = lines[0].lstrip("﻿").strip()
        for i in range(1, len(lines)):
            if lines[i].strip() in (mark, "..."):
                at = i + 1
                break
    out: list[str] = []
    now: list[str] = []
    fence, listed = "", False

    def close() -> None:
        if now:
            out.append(" ".join(now))
            now.clear()

    for line in lines[at:]:
        bare = line.strip()
        if fence:
            if (m := _FENCE.match(line)) and m[1][0] == fence[0] and len(m[1]) >= len(fence) and bare == m[1]:
                fence = ""
            continue
        if m := _FENCE.match(line):
            close()
            fence, listed = m[1], False
        elif not bare:
            close()
            listed = False
        elif now and _UNDERLINE.match(line):  # a heading of the lines above
            now.clear()
        elif _HEADING.match(line) or _RULE.match(line):
            close()
            listed = False
        elif bare[0] == ">" or _LIST.match(line):
            close()
            listed = True  # lazy continuation lines belong to it
        elif "|" in bare and (bare[0] == "|" or bare.count("|") > 1 or re.fullmatch(r"[\s|:-]+", bare)):
            close()
        elif listed:
            continue
        elif not now and (line.startswith("    ") or line.startswith("\t")):
            continue
        else:
            now.append(bare)
    close()
    return out


def sentences(paragraph: str) -> list[str]:
    """Sentences of one paragraph; dots of abbreviations and numbers end none."""
    s = paragraph
    if "<" in s:
        s = _HTML.sub(" ", s)
    if "](" in s:
        s = _LINK.sub(lambda m: m[1] or " ", s)
    if "`" in s:
        s = _CODE.sub(r"\1", s)
    if "*" in s or "\\" in s:
        s = s.replace("*", "").replace("\\", "")
    out, start = [], 0
    for m in _END.finditer(s):
        at, end = m.span()
        if s[at] == "." and end - at == 1:
            following = s[end : end + 2].lstrip()
            if following:
                if following.islower():
                    continue
                before = s[s.rfind(" ", start, at) + 1 : at].lstrip("([\"'“").lower()
                if before in _ABBREVIATION_SET or (_LETTERS_DOTS.fullmatch(before) and before not in ("i", "a")):
                    continue
        out.append(s[start:end])
        start = end
    out.append(s[start:])
    return [x for x in map(str.strip, out) if _WORD.search(x)]


BUCKETS = 1 << 10
#: Least probability of a band before the calibration.
FLOOR = 1e-3
_TOKEN = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*|\n")


def word_row(w: str) -> tuple[int, list[int], int]:
    """Bucket of a word, buckets of its character trigrams (ends marked), its letters."""
    letters = len(w) if w.isalpha() else sum(map(str.isalpha, w))
    w = f"<{w.lower()}>"
    return xxhash.xxh3_64_intdigest(w) % BUCKETS, [BUCKETS + xxhash.xxh3_64_intdigest("c" + w[i : i + 3]) % BUCKETS for i in range(len(w) - 2)], letters


class LevelModel:
    """Multinomial ridge-regularised logistic model of a sentence: mean weights of its hashed words and
    of their character trigrams, and a line in its length and its letters per word; then the calibration
    of a document's mean distribution: a slope and an offset per band."""

    LIMIT = 1 << 18

    def __init__(self, weights: np.ndarray, slope: float = 1.0, offset: np.ndarray | None = None) -> None:
        self.weights, self.slope, self.offset = weights, slope, np.zeros(len(BANDS)) if offset is None else offset
        self._reset()

    def _reset(self) -> None:
        # A row per known word: three summed weights, letters, one; row 0 is the end of a sentence.
        self._index: dict[str, int] = {"\n": 0}
        self._rows = np.zeros((1024, len(BANDS) + 2))

    def _row(self, w: str) -> int:
        n = len(self._index)
        if n == len(self._rows):
            self._rows = np.concatenate([self._rows, np.zeros_like(self._rows)])
        a, b, letters = word_row(w)
        self._rows[n, : len(BANDS)] = (self.weights[a] + self.weights[b].mean(axis=0)) / 2
        self._rows[n, len(BANDS) :] = letters, 1
        self._index[w] = n
        return n

    def sums(self, tokens: list[str]) -> np.ndarray:
        """Per sentence: summed weights of its words, letters, words.  Every sentence ends with a newline token."""
        if len(self._index) > self.LIMIT:
            self._reset()
        get, add = self._index.get, self._row
        at = [get(t, -1) for t in tokens]
        if -1 in at:
            at = [i if i >= 0 else (get(t, -1) if get(t, -1) >= 0 else add(t)) for i, t in zip(at, tokens)]
        at = np.array(at)
        starts = np.concatenate([[0], np.nonzero(at == 0)[0][:-1] + 1])
        return np.add.reduceat(self._rows[at], starts, axis=0)

    def mean_distribution(self, sums: np.ndarray) -> np.ndarray:
        """Mean over the sentences of their distributions over the bands, each weighted by its words."""
        words = np.maximum(1, sums[:, -1])
        p = softmax(sums[:, : len(BANDS)] / words[:, None] + dense(words, sums[:, -2]) @ self.weights[2 * BUCKETS :])
        return (p * words[:, None]).sum(axis=0) / words.sum()

    def distribution(self, sums: np.ndarray) -> np.ndarray:
        """The calibrated distribution of the document over the bands."""
        return softmax(self.slope * np.log(np.maximum(self.mean_distribution(sums), FLOOR)) + self.offset)


def softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=-1, keepdims=True))
    return p / p.sum(axis=-1, keepdims=True)


def dense(words: np.ndarray, letters: np.ndarray) -> np.ndarray:
    mean = letters / words / 4.0
    return np.stack([np.ones(len(words)), np.minimum(words, 60) / 20.0, mean, mean**2], axis=1)


def calibrate(p: np.ndarray, y: np.ndarray, *, steps: int = 2000, rate: float = 0.02, ridge: float = 0.01) -> tuple[float, np.ndarray]:
    """Slope and offsets that make the bands y (one-hot) of documents with mean distributions p most likely."""
    z, slope, offset = np.log(np.maximum(p, FLOOR)), 1.0, np.zeros(len(BANDS))
    for _ in range(steps):
        wrong = softmax(slope * z + offset) - y
        slope -= rate * (float((wrong * z).sum(axis=1).mean()) + ridge * (slope - 1))
        offset = offset - rate * (wrong.mean(axis=0) + ridge * offset)
    return max(slope, 0.1), offset


def fit(samples: list[tuple[str, str]], *, steps: int = 300, rate: float = 0.5, ridge: float = 1e-3, folds: int = 3) -> LevelModel:
    """Fit on (text, band) pairs: every sentence takes the band of its text.  The calibration comes from
    documents scored by a model fitted on the other folds."""
    rows, size, label, doc, band_of = [], [], [], [], {}
    for d, (text, band) in enumerate(samples):
        if band not in BANDS:
            continue
        for s in [x for p in prose(text or "") for x in sentences(p)]:
            got = [word_row(w) for w in _WORD.findall(s)]
            rows.append(got), size.append((len(got), sum(g[2] for g in got))), label.append(BANDS.index(band)), doc.append(d)
            band_of[d] = BANDS.index(band)
    if not rows:
        return LevelModel(np.zeros((2 * BUCKETS + 4, len(BANDS))))
    x = np.zeros((len(rows), 2 * BUCKETS + 4), np.float32)
    for r, got in enumerate(rows):
        for word, trigrams, _ in got:
            x[r, word] += 0.5 / len(got)
            np.add.at(x[r], trigrams, 0.5 / len(got) / len(trigrams))
    n = np.array(size, float)
    x[:, 2 * BUCKETS :] = dense(n[:, 0], n[:, 1])
    y = np.eye(len(BANDS), dtype=np.float32)[label]
    order = {d: i for i, d in enumerate(band_of)}
    # Every fold has its share of each band.
    seen: dict[int, int] = {}
    fold_of = {d: (seen.update({b: seen.get(b, -1) + 1}) or seen[b]) % folds for d, b in band_of.items()}
    fold = np.array([fold_of[d] for d in doc])
    doc = np.array([order[d] for d in doc])

    def descend(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        w = np.zeros((x.shape[1], y.shape[1]), np.float32)
        scale = np.maximum(x.std(axis=0), 1e-3)
        scale[2 * BUCKETS] = 1.0
        xs = x / scale
        for _ in range(steps):
            w -= rate * (xs.T @ (softmax(xs @ w) - y) / len(xs) / 4 + ridge * w)
        return (w / scale[:, None]).astype(float)

    slope, offset = 1.0, None
    if len(order) >= folds:
        unseen = np.zeros((len(order), len(BANDS)))
        for f in range(folds):
            p = softmax(x[fold == f] @ descend(x[fold != f], y[fold != f])) * n[fold == f, :1]
            np.add.at(unseen, doc[fold == f], p)
        slope, offset = calibrate(unseen / unseen.sum(axis=1, keepdims=True), np.eye(len(BANDS))[list(band_of.values())])
    return LevelModel(descend(x, y), slope, offset)


def train(samples: DataFrame, *, most: int = 2000) -> LevelModel:
    """Fit on the samples (sample_id, text, band); of more than most rows, those with the least ids."""
    rows = samples.where(F.col("text").isNotNull() & F.col("band").isNotNull()).orderBy("sample_id").limit(most).select("text", "band").collect()
    return fit([(r[0], r[1].strip().lower()) for r in rows])


def _level_rows(weights: np.ndarray, slope: float, offset: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = LevelModel(weights, slope, offset)
        for b in batches:
            cols: list[list] = [[] for _ in range(9)]
            for key, text in zip(b.column(0).to_pylist(), b.column(1)):
                parts = [x for p in prose(text.as_py() or "") for x in sentences(p)]
                row = (key, None, 0, 0, 0, None, None, None, None)
                if parts:
                    joined = "\n".join(parts)
                    tokens = _TOKEN.findall(joined + "\n")
                    sums = model.sums(tokens)
                    words, letters = int(sums[:, -1].sum()), int(sums[:, -2].sum())
                    lang, p = language_of(joined, tokens), None
                    if lang == "en":
                        p = model.distribution(sums)
                    row = (key, lang, len(parts), words, letters, *(map(float, p) if p is not None else (None,) * 3), BANDS[int(np.argmax(p))] if p is not None else None)
                for c, v in zip(cols, row):
                    c.append(v)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["id", "lang", "sentences", "words", "letters", "p_low", "p_middle", "p_high", "level"])

    return run


def reading_levels(df: DataFrame, id_col: str, text_col: str, model: LevelModel) -> DataFrame:
    """One row per input row: id, lang (of the prose), sentences, words, letters, p_low, p_middle, p_high, level.

    The model is of English: level and probabilities are null for prose in other languages and for
    texts without prose (null, empty, only headings, code and the like; their counts are 0).  Repeated
    rows give repeated results; other columns are ignored; an empty table gives an empty result.  The
    model travels with the tasks: 2 * BUCKETS + 4 rows of weights whatever the corpus.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_level_rows(model.weights, model.slope, model.offset), "id long, lang string, sentences long, words long, letters long, p_low double, p_middle double, p_high double, level string")


def demanding(levels: DataFrame, *, words_per_sentence: float = 22, letters_per_word: float = 5.8, least_high: float = 0.2) -> DataFrame:
    """id of the English documents that the model takes for high and whose prose measures reach both
    bounds: the model chooses, the exact measures of the definition follow.

    High from a calibrated p_high of least_high on, above p_low: the samples hold no document at the
    bounds, so those there have a lower p_high than the samples of the band.
    """
    high = levels.where((F.col("lang") == "en") & (F.col("p_high") >= least_high) & (F.col("p_high") > F.col("p_low")))
    return high.where((F.col("words") >= words_per_sentence * F.col("sentences")) & (F.col("letters") >= letters_per_word * F.col("words"))).select("id")
