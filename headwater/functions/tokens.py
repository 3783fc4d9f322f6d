"""Tokenizers: the lossless piece tokenizer in native columns, byte-level BPE in Arrow functions."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A piece is white space and what follows it, or the white space at the end.
PIECE = r"[ \t\r\n]*[^ \t\r\n]+|[ \t\r\n]+\z"
_PIECE_PY = re.compile(r"[ \t\r\n]*[^ \t\r\n]+|[ \t\r\n]+\Z")
BPE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Tokenizer(Protocol):
    def encode(self, text: str) -> list: ...

    def decode(self, tokens: list) -> str: ...


class PieceTokenizer:
    def encode(self, text: str) -> list[str]:
        return _PIECE_PY.findall(text)

    def decode(self, tokens: list[str]) -> str:
        return "".join(tokens)


class BpeTokenizer:
    """Byte-level BPE of a vocabulary file of ranks; a prefix may end inside a character, which decodes to U+FFFD."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._core = tiktoken.Encoding(os.path.basename(path), pat_str=BPE_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        return self._core.encode_ordinary(text)

    def decode(self, tokens: list[int]) -> str:
        return self._core.decode(tokens)


@lru_cache(maxsize=4)
def tokenizer(spec: str) -> Tokenizer:
    """``piece``, or the path of a vocabulary file; one per worker."""
    return PieceTokenizer() if spec == "piece" else BpeTokenizer(spec)


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({PIECE})"), F.lit(1))


def piece_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(PIECE)).cast("long")


def shorten(text: str, head: int, tail: int, tok: Tokenizer, gap: str = "\n[...]\n") -> str:
    """First head and last tail tokens with a gap mark between, or the text if it has no more; a tail of 0 keeps none."""
    ids = tok.encode(text)
    if len(ids) <= head + tail:
        return text
    return tok.decode(ids[:head]) + gap + (tok.decode(ids[len(ids) - tail :]) if tail else "")


def piece_shorten(text: Column, head: int, tail: int, gap: str = "\n[...]\n") -> Column:
    """shorten for the piece tokenizer as a native column."""
    p = pieces(text)
    last = F.array_join(F.slice(p, F.greatest(F.lit(1), F.size(p) - tail + 1), tail), "") if tail else F.lit("")
    return F.when(F.size(p) <= head + tail, text).otherwise(F.concat(F.array_join(F.slice(p, 1, head), ""), F.lit(gap), last))


def counter(spec: str):
    """A fresh Arrow function text -> tokens (bigint); marked so that it runs once where it is filtered on and kept."""

    @F.pandas_udf(T.LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tok = tokenizer(spec)
        for s in batches:
            yield s.map(lambda x: len(tok.encode(x)) if x is not None else None).astype("Int64")

    return count.asNondeterministic()


def token_count(text: Column, spec: str = "piece") -> Column:
    return piece_count(text) if spec == "piece" else counter(spec)(text)


def prefix_cut(text: str, most: int, tok: Tokenizer) -> str:
    """The text if it has at most ``most`` tokens; else its prefix of that many, ended after the last
    heading line that is in it whole and preceded by a newline, or the bare prefix."""
    ids = tok.encode(text)
    if len(ids) <= most:
        return text
    part = tok.decode(ids[:most])
    at = part.rfind("\n# ")
    end = part.find("\n", at + 1) if at >= 0 else -1
    return part[:end] if end >= 0 else part


def piece_prefix_cut(text: Column, most: int) -> Column:
    """prefix_cut for the piece tokenizer as a native column."""
    p = pieces(text)
    part = F.array_join(F.slice(p, 1, most), "")
    mark = F.lit("\n# ")
    back = F.locate(" #\n", F.reverse(part))  # 1-based from the end, 0 if none
    at = F.length(part) - back - F.length(mark) + 2  # 1-based start of the last mark
    end = F.call_function("locate", F.lit("\n"), part, at + 1)
    return F.when(F.size(p) <= most, text).when((back > 0) & (end > 0), F.substring(part, F.lit(1), end - 1)).otherwise(part)


def text_function(fn, spec: str):
    """An Arrow function of one text column: fn(text, tokenizer)."""

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tok = tokenizer(spec)
        for s in batches:
            yield s.map(lambda x: fn(x, tok) if x is not None else None)

    return run.asNondeterministic()
