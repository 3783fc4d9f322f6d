"""Headings of markdown texts as columns, and what is computed from them without leaving the JVM."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headwater.functions import tokens
from headwater.functions.scanner import Span, normalise_newlines, scan

SPAN = T.StructType(
    [T.StructField("line_start", T.IntegerType()), T.StructField("line_end", T.IntegerType()), T.StructField("level", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("nested", T.BooleanType())]
)
HEADING = T.StructType([T.StructField("text", T.StringType()), T.StructField("level", T.IntegerType())])


def spans(text: Column) -> Column:
    """array of heading spans by a CommonMark block scan: the one Arrow function of the structural operators.

    A fresh function each call, evaluated once where it is both filtered on and kept.  Null texts give
    null, texts without headings an empty array.
    """

    @F.pandas_udf(T.ArrayType(SPAN))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: [tuple(h) for h in scan(x)] if x is not None else None)

    return run.asNondeterministic()(text)


def headings(span_col: Column) -> Column:
    """array<struct<text, level>> of a spans column."""
    return F.transform(span_col, lambda s: F.struct(s["text"].alias("text"), s["level"].alias("level")))


def levels(array_of_headings: Column) -> Column:
    return F.transform(array_of_headings, lambda h: h["level"])


def texts(array_of_headings: Column) -> Column:
    return F.transform(array_of_headings, lambda h: h["text"])


def count_marks(text: Column) -> Column:
    """Lines that start with a hash and a space; comment lines of code that do so count too."""
    return F.regexp_count(text, F.lit(r"(?md)^# ")).cast("long")


def level_gap(level_col: Column) -> Column:
    """Greatest distance of neighbouring distinct levels; 0 if there are fewer than two."""
    s = F.array_sort(F.array_distinct(level_col))
    gaps = F.zip_with(F.slice(s, 2, F.greatest(F.size(s), F.lit(1))), F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), lambda hi, lo: hi - lo)
    return F.when(F.size(s) < 2, F.lit(0)).otherwise(F.array_max(gaps))


def with_title(title: Column, body: Column) -> Column:
    return F.concat(F.lit("# "), title, F.lit("\n\n"), body)


def align_levels(array_of_headings: Column, predicted: Column) -> Column:
    """Predicted levels for every heading: missing ones take the heading's own, extra ones are cut."""
    return F.transform(array_of_headings, lambda h, i: F.coalesce(F.get(predicted, i), h["level"]))


def apply_levels(text: Column, span_col: Column, level_col: Column, compat: bool = False) -> Column:
    """The text with each heading's prefix rewritten to its new level.

    Default: quote and list markers stay before the hashes, the indent of an ATX heading goes, a
    setext heading becomes an ATX one on one line and its underline goes.  compat: only the heading's
    first line is touched: leading hashes and one space are replaced, whatever stands there (quotes
    keep their marker behind the new prefix, setext headings their underline).  Lengths that differ
    raise an error.  Lone carriage returns end lines in both.
    """
    checked = F.when(F.size(span_col) != F.size(level_col), F.raise_error(F.lit("levels and headings differ in number"))).otherwise(span_col)
    lines = F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n", -1)
    by_line = F.map_from_arrays(F.transform(checked, lambda s: s["line_start"]), F.arrays_zip(checked.alias("span"), level_col.alias("level")))
    if compat:

        def rewrite(line: Column, i: Column) -> Column:
            new = F.try_element_at(by_line, i)
            return F.when(new.isNull(), line).otherwise(F.concat(F.repeat(F.lit("#"), new["level"]), F.lit(" "), F.regexp_replace(F.regexp_replace(line, "^#+", ""), "^ ", "")))

        return F.array_join(F.transform(lines, rewrite), "\n")
    gone = F.flatten(F.transform(checked, lambda s: F.when(s["line_end"] > s["line_start"] + 1, F.sequence(s["line_start"] + 1, s["line_end"] - 1)).otherwise(F.array().cast("array<int>"))))

    def rewrite(line: Column, i: Column) -> Column:
        new = F.try_element_at(by_line, i)
        lead = F.when(new["span"]["nested"], F.regexp_extract(line, r"^((?:[ \t]*(?:>|[-+*](?=[ \t])|\d{1,9}[.)](?=[ \t]))[ \t]*)*)", 1)).otherwise(F.lit(""))
        return F.when(new.isNull(), F.when(F.array_contains(gone, i), F.lit(None)).otherwise(line)).otherwise(F.concat(lead, F.repeat(F.lit("#"), new["level"]), F.lit(" "), F.regexp_replace(new["span"]["text"], r"[ \t]*\n[ \t]*", " ")))

    return F.array_join(F.array_compact(F.transform(lines, rewrite)), "\n")


# Fixed value: what Python's strip removes and Spark's trim doesn't, beside the space.
_TRIM = "^[\\s\\x1c-\\x1f\\x85\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+|[\\s\\x1c-\\x1f\\x85\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+$"


def full_trim(c: Column) -> Column:
    return F.regexp_replace(c, _TRIM, "")


def strip_text(text: str, span_list: list[Span], head: int, tail: int, tok: tokens.Tokenizer) -> str:
    """Every heading at one level, each section body shortened to head + tail tokens; parts joined by blank lines."""
    if not span_list:
        return tokens.shorten(text, head, tail, tok)
    lines = normalise_newlines(text).split("\n")
    parts = []
    ends = [s.line_start for s in span_list[1:]] + [len(lines)]
    before = "\n".join(lines[: span_list[0].line_start]).strip()
    if before:
        parts.append(tokens.shorten(before, head, tail, tok))
    for s, end in zip(span_list, ends):
        parts.append(f"# {s.text}")
        if body := "\n".join(lines[s.line_end : end]).strip():
            parts.append(tokens.shorten(body, head, tail, tok))
    return "\n\n".join(parts)


def strip_document(text: Column, span_col: Column, head: int = 128, tail: int = 128, spec: str = "piece", most: int | None = None) -> Column:
    """strip_text from spans that are there already, cut to ``most`` tokens if given, as one Arrow
    function: every body is encoded once.  (Nested higher-order functions that split, slice and join
    the lines of every section go over the whole text for each of them.)"""

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        tok = tokens.tokenizer(spec)

        def one(x, span_list):
            if x is None:
                return None
            out = strip_text(x, [Span(*(s[k] for k in Span._fields)) for s in span_list], head, tail, tok)
            return out if most is None else tokens.prefix_cut(out, most, tok)

        for a, b in batches:
            yield pd.Series([one(x, y) for x, y in zip(a, b)], dtype=object)

    return run.asNondeterministic()(text, span_col)


def format_answer(text_col: Column, level_col: Column) -> Column:
    """A line of hashes and text for each pair; the shorter array ends the list."""
    n = F.least(F.size(text_col), F.size(level_col))
    return F.array_join(F.transform(F.slice(text_col, F.lit(1), n), lambda t, i: F.concat(F.repeat(F.lit("#"), F.get(level_col, i)), F.lit(" "), t)), "\n")


_LINE_ENDS = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"


def parse_answer(text: Column) -> Column:
    """array<struct<text, level>> of the heading lines of an answer; everything else is dropped."""
    trimmed = F.transform(F.split(full_trim(text), _LINE_ENDS, -1), full_trim)
    kept = F.filter(trimmed, lambda s: s.rlike(r"^#{1,6}\s+\S"))
    return F.transform(kept, lambda s: F.struct(full_trim(F.regexp_extract(s, r"(?s)^#{1,6}\s+(.+)$", 1)).alias("text"), F.length(F.regexp_extract(s, r"^(#{1,6})", 1)).alias("level")))


def token_estimate(stripped: Column, per_heading: int = 40, least: int = 256) -> Column:
    """Tokens to allow an answer."""
    return F.greatest(count_marks(stripped) * per_heading, F.lit(least).cast("long"))
