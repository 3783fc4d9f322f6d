"""Encoding a corpus with a public tokenizer, long texts in parallel."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwater.llm import bpe



def leaves(text: str, size: int) -> list[tuple[str, bool, bool]]:
    """The text in parts of about size characters: (part, of a cut piece, joined to the one before inside that piece).

    Parts end where no piece of the pattern crosses; a piece longer than size is cut into parts of
    its own, so a joint inside a piece has nothing but that piece on either side.
    """
    out, start = [], 0
    while len(text) - start > size + size // 2:
        cut = _safe_place(text, start + size // 2, start + size + size // 4)
        if cut is not None:
            out.append((text[start:cut], False, False))
            start = cut
            continue
        before = first = end = start
        for m in bpe.SPLIT.finditer(text, start):
            if m.end() > start + size:
                break
            before = m.start()
        first, end = m.span()
        if end - first <= size:
            before, first = first, end
        # White space before a cut stands alone: the pattern looks at what follows it.
        places = [start, before, first] if text[before:first].isspace() else [start, first]
        out += [(text[i:j], False, False) for i, j in zip(places, places[1:]) if i < j]
        out += [(text[i : min(i + size, end)], True, i > first) for i in range(first, end, size)]
        start = end
    if start < len(text) or not out:
        out.append((text[start:], False, False))
    return out


def _safe_place(text: str, lo: int, hi: int) -> int | None:
    """The last single space between two non-spaces in [lo, hi): no piece crosses it, whatever lies around."""
    at = text.rfind(" ", lo, min(hi, len(text) - 1))
    while at > 0 and (text[at - 1].isspace() or text[at + 1].isspace()):
        at = text.rfind(" ", lo, at)
    return at if at > 0 else None


def encode_text(text: str | None, e: bpe.Encoder, size: int) -> list[int]:
    """Ids of a whole text, by its leaves if it is longer than one and a half of them."""
    if not text or len(text) <= size + size // 2:
        return e.encode(text)
    return join_leaves([(i, inside, encode_leaf(part, cut, e)) for i, (part, cut, inside) in enumerate(leaves(text, size))], e)


def encode_leaf(part: str, cut: bool, e: bpe.Encoder) -> list[int]:
    return e.piece(part.encode("utf-8", "surrogatepass")) if cut else e.encode(part)


def _encode_rows(path: str, long_run: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = bpe.encoder(path, long_run)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                ids = [encode_text(t.as_py(), e, size) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    return run


def _leaf_rows(path: str, long_run: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = bpe.encoder(path, long_run)
        for batch in batches:
            ids = [encode_text(t.as_py(), e, size) if not cut.as_py() else encode_leaf(t.as_py(), True, e) for t, cut in zip(batch.column(3), batch.column(4))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ids, pa.list_(pa.int32()))], ["id", "leaf", "inside", "ids"])

    return run


def _cut_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                parts = leaves(text.as_py(), size)
                n = len(parts)
                yield pa.RecordBatch.from_arrays([pa.array([key] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([p[2] for p in parts]), pa.array([p[0] for p in parts], pa.string()), pa.array([p[1] for p in parts])], ["id", "leaf", "inside", "text", "cut"])

    return run


def join_leaves(parts: list[tuple[int, bool, list[int]]], e: bpe.Encoder) -> list[int]:
    """Ids of a text from those of its parts in order: the parts of a cut piece are joined pair by pair, level
    by level, and then stand beside what comes before and after it."""
    groups: list[list[list[int]]] = []
    for _, inside, ids in sorted(parts, key=lambda p: p[0]):
        if inside:
            groups[-1].append(list(ids))
        else:
            groups.append([list(ids)])
    out: list[int] = []
    for level in groups:
        while len(level) > 1:
            level = [e.join(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        out += level[0]
    return out


def _join_rows(path: str, long_run: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = bpe.encoder(path, long_run)
        for batch in batches:
            for key, parts in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = join_leaves([(p["leaf"], p["inside"], p["ids"]) for p in parts.as_py()], e)
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([ids], pa.list_(pa.int32()))], ["id", "ids"])

    return run


def encode_corpus(df: DataFrame, id_col: str, text_col: str, *, vocabulary: str | None = None, task_chars: int = 200_000, leaf_chars: int = 4096, long_run: int = 64) -> DataFrame:
    """(id_col, ids): the token ids of every whole text, one row per input row.

    Null and empty texts have no ids: the list is empty.  A text is cut into leaves of about leaf_chars
    characters, at places that no piece of the vocabulary's pattern crosses; a piece longer than that is
    cut itself, and its parts are joined by encoding growing windows around each joint until both sides
    agree.  Pieces of long_run signs or more are encoded in halves in the same way.  Texts of up to 1.5 *
    task_chars characters are encoded where they are read, without a shuffle; the parts of longer ones
    by different tasks.  Repeated rows give repeated results (of the longer texts, ids must be unique);
    other columns are ignored; an empty table gives an empty result.
    """
    path = vocabulary or bpe.vocabulary_path()
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    long = F.coalesce(F.length("text"), F.lit(0)) > task_chars + task_chars // 2
    short = rows.where(~long).mapInArrow(_encode_rows(path, long_run, leaf_chars), "id long, ids array<int>")
    parts = rows.where(long).mapInArrow(_cut_rows(task_chars), "id long, leaf int, inside boolean, text string, cut boolean")
    parts = parts.repartition("id", "leaf").mapInArrow(_leaf_rows(path, long_run, leaf_chars), "id long, leaf int, inside boolean, ids array<int>")
    # One row per long text: its ids have to stand in one row of the result anyhow.
    joined = parts.groupBy("id").agg(F.collect_list(F.struct("leaf", "inside", "ids")).alias("parts")).mapInArrow(_join_rows(path, long_run), "id long, ids array<int>")
    return short.unionByName(joined).withColumnRenamed("id", id_col)
