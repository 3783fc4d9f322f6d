"""Byte-level BPE vocabularies of a file: counting, checking joints, and encoding long runs in halves."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import regex

#: Folder with the vocabulary files; a parameter of every operator that needs one.
TOKENIZERS = os.environ.get("HEADWATER_TOKENIZERS", "/opt/tokenizers")
# Fixed value: the published pattern that cuts a text before byte-level merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPLIT = regex.compile(PATTERN)


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def vocabulary_path(name: str = "byte_bpe_50k", folder: str | None = None) -> str:
    return f"{folder or TOKENIZERS}/{name}.tiktoken"


def merge_bytes(data: bytes, rank: dict[bytes, int]) -> list[bytes]:
    """Plain merges of one short piece, lowest rank first, leftmost first; for joints and tests."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        best, at = min((rank.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if best == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class TokenCounter:
    """Number of tokens of a text without making its ids.

    The vocabulary is compiled into a matching automaton over bytes.  Going through a piece once,
    each position keeps the one token that can end an exact encoding there: a match whose pair with
    the token before it is compatible, that is, merges back into these two tokens.  Pieces and pairs
    are memoised; the memo is emptied at its limit, which only costs time.
    """

    LIMIT = 1 << 19

    def __init__(self, path: str) -> None:
        import ahocorasick

        self.rank = ranks(path)
        self.automaton = ahocorasick.Automaton()
        for token in self.rank:
            self.automaton.add_word(token.decode("latin-1"), token)
        self.automaton.make_automaton()
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.pieces: dict[str, int] = {}

    def compatible(self, a: bytes, b: bytes) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= self.LIMIT:
                self.pairs.clear()
            known = self.pairs[a, b] = merge_bytes(a + b, self.rank) == [a, b]
        return known

    def count_piece(self, data: bytes) -> int:
        if data in self.rank:
            return 1
        n = len(data)
        count, last = [0] * (n + 1), [b""] * (n + 1)
        # Matches that end at the same byte come longest first.
        for end, token in self.automaton.iter(data.decode("latin-1")):
            if last[end + 1]:
                continue
            start = end + 1 - len(token)
            if start == 0 or (last[start] and self.compatible(last[start], token)):
                last[end + 1], count[end + 1] = token, count[start] + 1
        return count[n]

    def count(self, text: str | None) -> int:
        """Tokens of the whole text; null and empty texts have none."""
        if not text:
            return 0
        known, total = self.pieces, 0
        for piece in SPLIT.findall(text):
            n = known.get(piece)
            if n is None:
                if len(known) >= self.LIMIT:
                    known.clear()
                n = self.count_piece(piece.encode("utf-8", "surrogatepass"))
                if len(piece) <= 64:
                    known[piece] = n
            total += n
        return total


@lru_cache(maxsize=2)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


class Encoder:
    """Ids of a text; long runs that the pattern doesn't split are encoded in halves and joined."""

    def __init__(self, path: str, long_run: int = 64) -> None:
        import tiktoken

        self.rank = ranks(path)
        self.token = {v: k for k, v in self.rank.items()}
        self.core = tiktoken.Encoding("headwater", pat_str=PATTERN, mergeable_ranks=self.rank, special_tokens={})
        self.long_run = long_run
        self.long = regex.compile(r"\p{L}{%d,}|\p{N}{%d,}|[^\s\p{L}\p{N}]{%d,}|\s{%d,}" % ((long_run,) * 4))
        self.joints: dict[tuple[int, int], bool] = {}

    def fits(self, a: int, b: int) -> bool:
        """Whether two neighbouring ids of one piece are what their bytes encode to."""
        known = self.joints.get((a, b))
        if known is None:
            if len(self.joints) > 1 << 18:
                self.joints.clear()
            known = self.joints[a, b] = merge_bytes(self.token[a] + self.token[b], self.rank) == [self.token[a], self.token[b]]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of the two halves of one piece, joined: a window around the joint is encoded again and
        grows until both its edges fit what lies beyond them; then every neighbouring pair is
        compatible, and the ids are those of the whole."""
        if not left or not right:
            return left + right
        i = j = 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            window = b"".join(self.token[t] for t in left[len(left) - i :] + right[:j])
            middle = self._bytes(window)
            ok_left = i == len(left) or self.fits(left[len(left) - i - 1], middle[0])
            ok_right = j == len(right) or self.fits(middle[-1], right[j])
            if ok_left and ok_right:
                return left[: len(left) - i] + middle + right[j:]
            if not ok_left:
                i *= 2
            if not ok_right:
                j *= 2

    def _bytes(self, data: bytes) -> list[int]:
        return [self.rank[x] for x in merge_bytes(data, self.rank)] if data not in self.rank else [self.rank[data]]

    def piece(self, data: bytes) -> list[int]:
        """Ids of one unsplit piece by tree concatenation of its halves."""
        if len(data) <= 32:
            return self._bytes(data)
        middle = len(data) // 2
        return self.join(self.piece(data[:middle]), self.piece(data[middle:]))

    def encode(self, text: str | None) -> list[int]:
        """Ids of the whole text without special tokens; [] for null and empty texts."""
        if not text:
            return []
        if not self.long.search(text):
            return self.core.encode_ordinary(text)
        # What lies between long pieces is encoded at once: it begins and ends where a piece does, and
        # white space at its end stands alone, as the pattern looks at what follows it.
        out: list[int] = []
        start = before = 0
        for m in SPLIT.finditer(text):
            at = m.start()
            if m.end() - at >= self.long_run:
                last = before if text[before:at].isspace() else at
                for part in (text[start:last], text[last:at]):
                    out += self.core.encode_ordinary(part)
                out += self.piece(m.group().encode("utf-8", "surrogatepass"))
                start = m.end()
            before = at if at >= start else start
        return out + self.core.encode_ordinary(text[start:])


@lru_cache(maxsize=2)
def encoder(path: str, long_run: int = 64) -> Encoder:
    return Encoder(path, long_run)
