"""Splitting oversized items at natural boundaries.

A text is worked on in ranges of characters.  A range with its halo is enough to find its boundaries
and, for every place where a piece may begin in it, the place where the first piece of the next range
begins (its *jump table*, kept as stretches of places that lead to the same one).  Stitching the ranges of a text follows those tables from range to range;
then each range emits its pieces by offset, knowing only where its first one begins.  No task needs a
whole text, and pieces are the same whatever the length of the ranges.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headwater.session import cut

# Natural places, best first: before a heading, after a blank line, after a line, after a sentence, after a word.
_PLACES = (
    (5, re.compile(r"(?<=\n)(?= {0,3}#{1,6}[ \t])")),
    (4, re.compile(r"(?<=\n)[ \t\r]*\n")),
    (3, re.compile(r"\n")),
    (2, re.compile(r"[.!?][\"')\]]*[ \t]+|[。！？]")),
    (1, re.compile(r"[ \t　]+")),
)


def boundaries(text: str, start: int, lo: int, hi: int) -> list[tuple[int, int]]:
    """(offset, strength) of the places in (lo, hi] of a text of which text begins at offset start, the strongest of each."""
    found: dict[int, int] = {}
    for strength, pattern in _PLACES:
        for m in pattern.finditer(text):
            at = start + m.end()
            if lo < at <= hi and at not in found:
                found[at] = strength
    return sorted(found.items())


def next_cut(places: list[int], strength: list[int], begin: int, limit: int, overlap: int, end: int) -> int:
    """End of the piece that begins at begin: the text's end if near enough, else the strongest place in
    the last half of the limit, the latest of those, else the latest place at all, else the limit."""
    if end - begin <= limit:
        return end
    # Nothing that the piece before, which ends at begin + overlap at most, reached already.
    lo, mid, hi = bisect_right(places, begin + overlap), bisect_left(places, begin + limit // 2), bisect_right(places, begin + limit)
    if mid < hi:
        return places[max(range(mid, hi), key=lambda i: (strength[i], places[i]))]
    if lo < hi:
        return places[hi - 1]
    return begin + limit


def next_begin(places: list[int], strength: list[int], begin: int, cut: int, overlap: int) -> int:
    """Where the piece after a cut begins: overlap characters before it, or the first place from there on before the cut."""
    at = max(begin + 1, cut - overlap)
    i = bisect_left(places, at)
    return places[i] if i < len(places) and places[i] < cut else at


def _range_rows(range_chars: int, halo: int, most_chars: int = 1 << 22):
    """(id, chars, range_no, text with halos) of every range of a text; batches of about most_chars characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["id", "chars", "range_no", "part"])

        for batch in batches:
            rows, held = [], 0
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = value.as_py()
                for no in range(max(1, -(-len(text) // range_chars))):
                    lo = no * range_chars
                    rows.append((key, len(text), no, text[max(0, lo - halo) : lo + range_chars + halo]))
                    held += len(rows[-1][3])
                    if held >= most_chars:
                        yield batch_of(rows)
                        rows, held = [], 0
            if rows:
                yield batch_of(rows)

    return run


def walk(part: str, no: int, chars: int, begin: int, limit: int, overlap: int, range_chars: int, halo: int) -> tuple[list[tuple[int, int, bool]], int]:
    """Pieces (begin, end, cut at a natural place) that begin in range no, from begin on; where the next range's first begins."""
    lo = no * range_chars
    start = max(0, lo - halo)
    found = boundaries(part, start, start, start + len(part))
    places, strength = [x[0] for x in found], [x[1] for x in found]
    known, out = set(places), []
    while begin < min(chars, lo + range_chars):
        cut = next_cut(places, strength, begin, limit, overlap, chars)
        out.append((begin, cut, cut == chars or cut in known))
        if cut >= chars:
            return out, chars
        begin = next_begin(places, strength, begin, cut, overlap)
    return out, begin


def entries(places: list[int], strength: list[int], lo: int, hi: int, limit: int, overlap: int) -> list[int]:
    """Where the first piece of a range from lo to hi may begin, the last first.

    While some place lies within reach of every piece, pieces end at places, and the next one begins
    where next_begin says; around a longer stretch without a place it may begin anywhere.
    """
    end = min(hi, lo + limit + 1)
    i, j = bisect_left(places, lo - limit), bisect_right(places, lo + limit)
    near = [lo - limit, *places[i:j], lo + limit]
    if lo and max(b - a for a, b in zip(near, near[1:])) >= limit - overlap:
        return list(range(end - 1, lo - 1, -1))
    return sorted({x for p in places[i:j] if lo <= (x := next_begin(places, strength, max(0, p - limit), p, overlap)) < end}, reverse=True)


def jumps(part: str, no: int, chars: int, limit: int, overlap: int, range_chars: int, halo: int) -> tuple[list[int], list[int]]:
    """(enter, leave): from a begin of at least enter[i], below enter[i + 1], the next range's first begin is leave[i]."""
    lo, hi = no * range_chars, min(chars, (no + 1) * range_chars)
    start = max(0, lo - halo)
    found = boundaries(part, start, start, start + len(part))
    places, strength = [x[0] for x in found], [x[1] for x in found]
    exits: dict[int, int] = {}
    table = []
    for entry in [0] if no == 0 else entries(places, strength, lo, hi, limit, overlap):
        path, begin = [], entry
        while begin < hi and begin not in exits:
            path.append(begin)
            cut = next_cut(places, strength, begin, limit, overlap, chars)
            begin = chars if cut >= chars else next_begin(places, strength, begin, cut, overlap)
        exit_at = exits.get(begin, begin)
        for x in path:
            exits[x] = exit_at
        table.append((entry, exit_at))
    table.reverse()
    kept = [t for i, t in enumerate(table) if i == 0 or table[i - 1][1] != t[1]]
    return [t[0] for t in kept], [t[1] for t in kept]


def line_table(part: str, no: int, chars: int, range_chars: int, halo: int) -> tuple[int, int, int, bool]:
    """Of a range, from its boundaries: length of its first line's part, of its last line's, the longest line inside, no line end at all."""
    lo, hi = no * range_chars, min(chars, (no + 1) * range_chars)
    start = max(0, lo - halo)
    starts = [at for at, strength in boundaries(part, start, lo, hi) if strength >= 3]
    if not starts:
        return hi - lo, hi - lo, 0, True
    return starts[0] - 1 - lo, hi - starts[-1], max((b - a - 1 for a, b in zip(starts, starts[1:])), default=0), False


def _jump_rows(limit: int, overlap: int, range_chars: int, halo: int):
    """Per range: its line table, and its jump table if the text has several ranges, else the number of its pieces.

    Range 0 is entered at 0 only; entries of a later one are walked from the last to the first and meet after few pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in _JUMP_COLUMNS]
            for key, chars, no, part in zip(*(batch.column(i).to_pylist() for i in range(4))):
                head, tail, longest, whole = line_table(part, no, chars, range_chars, halo)
                enter, leave, pieces = [], [], None
                if chars > range_chars:
                    enter, leave = jumps(part, no, chars, limit, overlap, range_chars, halo)
                else:
                    pieces = len(walk(part, no, chars, 0, limit, overlap, range_chars, halo)[0])
                for c, v in zip(out, (key, chars, no, head, tail, longest, whole, enter, leave, pieces)):
                    c.append(v)
            longs = pa.int64()
            kinds = (longs, longs, longs, longs, longs, longs, pa.bool_(), pa.list_(longs), pa.list_(longs), longs)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], list(_JUMP_COLUMNS))

    return run


_JUMP_COLUMNS = ("id", "chars", "range_no", "head", "tail", "longest", "whole", "enter", "leave", "pieces")
_JUMPS = "id long, chars long, range_no long, head long, tail long, longest long, whole boolean, enter array<long>, leave array<long>, pieces long"


def _stitch_rows(range_chars: int):
    """Ranges in order, text by text: where the first piece of each begins, and the longest line so far.  Keeps one row at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, begin, line, longest = None, 0, 0, 0
        for batch in batches:
            rows = {c: batch.column(c).to_pylist() for c in ("id", "chars", "range_no", "head", "tail", "longest", "whole", "enter", "leave")}
            ids, nos, begins, lines = [], [], [], []
            for i, this in enumerate(rows["id"]):
                if this != key:
                    key, begin, line, longest = this, 0, 0, 0
                ids.append(this), nos.append(rows["range_no"][i]), begins.append(begin)
                if rows["whole"][i]:
                    line += rows["head"][i]
                    longest = max(longest, line)
                else:
                    longest = max(longest, line + rows["head"][i], rows["longest"][i], rows["tail"][i])
                    line = rows["tail"][i]
                lines.append(longest)
                enter = rows["enter"][i]
                # A piece may pass over a short range altogether.
                if begin < min(rows["chars"][i], (rows["range_no"][i] + 1) * range_chars) and enter:
                    begin = rows["leave"][i][max(0, bisect_right(enter, begin) - 1)]
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nos, pa.int64()), pa.array(begins, pa.int64()), pa.array(lines, pa.int64())], ["id", "range_no", "begin", "longest"])

    return run


def _emit_rows(limit: int, overlap: int, range_chars: int, halo: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, chars, no, part, begin in zip(*(batch.column(i).to_pylist() for i in range(5))):
                pieces, _ = walk(part, no, chars, begin, limit, overlap, range_chars, halo)
                start = max(0, no * range_chars - halo)
                if pieces:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key] * len(pieces), pa.int64()), pa.array(range(len(pieces)), pa.int64()), pa.array([p[0] for p in pieces], pa.int64()), pa.array([p[1] for p in pieces], pa.int64()), pa.array([p[2] for p in pieces]), pa.array([part[p[0] - start : p[1] - start] for p in pieces], pa.string())],
                        ["id", "piece_no", "begin_at", "end_at", "natural", "piece"],
                    )

    return run


def _settings(limit: int, overlap: int, range_chars: int) -> int:
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be at least 0 and less than half the limit")
    if range_chars < limit:
        raise ValueError("a range must be as long as the limit at least")
    return limit + 1


def _oversized(df: DataFrame, id_col: str, text_col: str, limit: int) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where(F.length("text") > limit)


def _tables(ranges: DataFrame, limit: int, overlap: int, range_chars: int, halo: int) -> DataFrame:
    """Line and jump tables of all ranges: without texts, so they are stored rather than made for each use."""
    return cut(ranges.mapInArrow(_jump_rows(limit, overlap, range_chars, halo), _JUMPS))


def _stitched(jumps: DataFrame, range_chars: int) -> DataFrame:
    return jumps.repartition("id").sortWithinPartitions("id", "range_no").mapInArrow(_stitch_rows(range_chars), "id long, range_no long, begin long, longest long")


def split_oversized(df: DataFrame, id_col: str, text_col: str, *, limit: int = 6000, overlap: int = 200, range_chars: int = 1 << 14) -> DataFrame:
    """(id, piece_no, begin_at, end_at, natural, piece): texts of more than limit characters in pieces of at most limit.

    Pieces cover the text in order; a piece begins up to overlap characters before the end of the one
    before, at a natural place if there is one in that stretch, else exactly overlap before.  Cuts are
    at the strongest natural place in the last half of the limit (blank line or heading, line,
    sentence, word), natural is false where there was none.  Null, empty and small texts give no rows;
    ids must be unique; other columns are ignored; an empty table gives an empty result.
    """
    halo = _settings(limit, overlap, range_chars)
    ranges = _oversized(df, id_col, text_col, limit).mapInArrow(_range_rows(range_chars, halo), "id long, chars long, range_no long, part string")
    # A text that is one range begins at 0 and needs no stitching.
    alone = ranges.where(F.col("chars") <= range_chars).withColumn("begin", F.lit(0).cast("long"))
    long = ranges.where(F.col("chars") > range_chars)
    entered = long.join(_stitched(_tables(long, limit, overlap, range_chars, halo), range_chars).select("id", "range_no", "begin"), ["id", "range_no"]).select("id", "chars", "range_no", "part", "begin")
    schema = "id long, piece_no long, begin_at long, end_at long, natural boolean, piece string"
    emit = _emit_rows(limit, overlap, range_chars, halo)
    # Pieces of a text that is one range are numbered where they are cut; for longer ones their places alone are gathered.
    of_long = cut(entered.mapInArrow(emit, schema).drop("piece_no"))
    number = of_long.select("id", "begin_at").withColumn("piece_no", (F.row_number().over(Window.partitionBy("id").orderBy("begin_at")) - 1).cast("long"))
    return alone.select("id", "chars", "range_no", "part", "begin").mapInArrow(emit, schema).unionByName(of_long.join(number, ["id", "begin_at"]))


def oversized_items(df: DataFrame, id_col: str, text_col: str, *, limit: int = 6000, overlap: int = 200, range_chars: int = 1 << 14) -> DataFrame:
    """(id, chars, longest_line, cut): one row per text of more than limit characters that comes in pieces.

    From the boundaries of the same operator, stitched over the ranges of longer texts: cut is 'inside'
    if a line alone exceeds the limit, so that some piece has to end inside it, else 'line'.
    """
    halo = _settings(limit, overlap, range_chars)
    ranges = _oversized(df, id_col, text_col, limit).mapInArrow(_range_rows(range_chars, halo), "id long, chars long, range_no long, part string")
    jumps = _tables(ranges, limit, overlap, range_chars, halo)
    alone = jumps.where((F.col("chars") <= range_chars) & (F.col("pieces") > 1)).select("id", "chars", F.greatest("head", "tail", "longest").alias("longest_line"))
    long = jumps.where(F.col("chars") > range_chars)
    ends = long.where("range_no = 0").select("id", "chars").join(_stitched(long, range_chars).groupBy("id").agg(F.max("longest").alias("longest_line")), "id")
    return alone.unionByName(ends).withColumn("cut", F.when(F.col("longest_line") > limit, "inside").otherwise("line"))
