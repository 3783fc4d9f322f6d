"""Answers of a predictor, outside Spark."""

from __future__ import annotations

MOST_LEVELS = 6


def heading_of(line: str) -> tuple[str, int] | None:
    """(text, level) of a line of one to six hashes, white space and text."""
    bare = line.strip()
    title = bare.lstrip("#")
    level = len(bare) - len(title)
    return (title.strip(), level) if 0 < level <= MOST_LEVELS and title[:1].isspace() else None


def parse_headings(text: str) -> list[tuple[str, int]]:
    """Those of the heading lines, in order; everything else is dropped."""
    return [h for h in map(heading_of, text.splitlines()) if h]


def parse_levels(text: str) -> list[int]:
    return [level for _, level in parse_headings(text)]
