"""CommonMark block scanner: the headings of a text with their lines.

Only block structure is followed (containers, fences, HTML blocks, indented code, paragraphs, setext
and ATX headings); inline content is kept as written.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Span(NamedTuple):
    line_start: int
    line_end: int
    level: int
    text: str
    kind: str  # atx or setext
    nested: bool  # inside a quote or a list item


_ATX = re.compile(r"(#{1,6})(?:[ \t]+|$)(.*)$", re.S)
_ATX_CLOSE = re.compile(r"(?:^|[ \t]+)#+[ \t]*$")
_FENCE = re.compile(r"(`{3,})([^`]*)$|(~{3,})(.*)$")
_SETEXT = re.compile(r"(=+|-+)[ \t]*$")
_BREAK = re.compile(r"(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_MARKER = re.compile(r"([-+*]|(\d{1,9})[.)])(?=[ \t]|$)")
_DEFINITION = re.compile(
    r"\[(?=[^\]]*\S)(?:[^\[\]\\]|\\.){1,999}\]:[ \t]*\n?[ \t]*(?:<[^<>\n]*>|[^\s<]\S*)(?:(?:[ \t]+\n?|[ \t]*\n)[ \t]*(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?[ \t]*(?:\n|$)"
)
# The element names of the sixth kind of HTML block.
_BLOCK_TAGS = (
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset "
    "h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead title tr track ul"
)
_ATTRIBUTE = r"(?:\s+[A-Za-z_:][\w:.-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)"
# (start, end or None for a blank line, may interrupt a paragraph)
_HTML = [
    (re.compile(r"<(?:script|pre|style|textarea)(?:\s|>|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I), True),
    (re.compile(r"<!--"), re.compile(r"-->"), True),
    (re.compile(r"<\?"), re.compile(r"\?>"), True),
    (re.compile(r"<![A-Za-z]"), re.compile(r">"), True),
    (re.compile(r"<!\[CDATA\["), re.compile(r"\]\]>"), True),
    (re.compile(r"</?(?:" + "|".join(_BLOCK_TAGS.split()) + r")(?:\s|/?>|$)", re.I), None, True),
    (re.compile(r"(?:<[A-Za-z][A-Za-z0-9-]*" + _ATTRIBUTE + r"*\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>)\s*$"), None, False),
]


def normalise_newlines(text: str) -> str:
    return text.replace("\r\n", "\n").replace("\r", "\n").replace("\0", "�")


def _indent(rest: str, col: int) -> tuple[int, int]:
    """(columns, characters) of the leading white space, tab stops counted from the line's start."""
    at = n = 0
    for c in rest:
        if c == " ":
            n += 1
        elif c == "\t":
            n += 4 - (col + n) % 4
        else:
            break
        at += 1
    return n, at


def _strip(rest: str, col: int, columns: int) -> tuple[str, int]:
    """rest without that many columns of white space; a tab cut in two leaves spaces."""
    n = at = 0
    while n < columns and at < len(rest):
        if rest[at] == " ":
            n += 1
        elif rest[at] == "\t":
            n += 4 - (col + n) % 4
        else:
            break
        at += 1
    return " " * (n - columns) + rest[at:], col + min(n, columns)


class _Item:
    __slots__ = ("width", "empty")

    def __init__(self, width: int, empty: bool) -> None:
        self.width, self.empty = width, empty


def scan(text: str | None) -> list[Span]:
    """Headings in document order.  Null and empty texts have none."""
    if not text:
        return []
    out: list[Span] = []
    stack: list = []  # None for a quote, _Item for a list item
    leaf: str | None = None
    para: list[str] = []
    para_start = 0
    fence = ("", 0)
    html_end = None

    for no, line in enumerate(normalise_newlines(text).split("\n")):
        rest, col, depth = line, 0, 0
        for container in stack:
            n, at = _indent(rest, col)
            blank = at == len(rest)
            if container is None:
                if n > 3 or rest[at : at + 1] != ">":
                    break
                rest, col = rest[at + 1 :], col + n + 1
                if rest[:1] in (" ", "\t"):
                    rest, col = _strip(rest, col, 1)
            elif blank:
                if container.empty:
                    break
                rest = ""
            elif n >= container.width:
                rest, col = _strip(rest, col, container.width)
                container.empty = False
            else:
                break
            depth += 1
        unmatched = depth < len(stack)

        if leaf == "fence" and not unmatched:
            n, at = _indent(rest, col)
            tail = rest[at:].rstrip(" \t")
            if n <= 3 and len(tail) >= fence[1] and tail == fence[0] * len(tail):
                leaf = None
            continue
        if leaf == "html" and not unmatched:
            if (html_end is None and not rest.strip()) or (html_end is not None and html_end.search(rest)):
                leaf = None
            continue
        if unmatched and leaf not in (None, "para"):
            leaf = None

        done = opened = False
        while True:
            n, at = _indent(rest, col)
            s = rest[at:]
            if not s:
                break
            if n >= 4:
                if leaf != "para":
                    del stack[depth:]
                    leaf, done = "code", True
                break
            here = leaf == "para" and not unmatched and not opened
            if s[0] == ">":
                del stack[depth:]
                leaf, unmatched, opened = None, False, True
                stack.append(None)
                depth += 1
                rest, col = s[1:], col + n + 1
                if rest[:1] in (" ", "\t"):
                    rest, col = _strip(rest, col, 1)
                continue
            if s[0] == "#" and (m := _ATX.match(s)):
                del stack[depth:]
                body = _ATX_CLOSE.sub("", m[2].strip(" \t")).strip(" \t")
                out.append(Span(no, no + 1, len(m[1]), body, "atx", bool(stack)))
                leaf, done = None, True
                break
            if s[0] in "`~" and (m := _FENCE.match(s)):
                del stack[depth:]
                mark = m[1] or m[3]
                leaf, fence, done = "fence", (mark[0], len(mark)), True
                break
            if s[0] == "<":
                for start, end, interrupts in _HTML:
                    if start.match(s) and (interrupts or leaf != "para"):
                        del stack[depth:]
                        leaf, html_end, done = ("html" if end is None or not end.search(s) else None), end, True
                        break
                if done:
                    break
            if here and s[0] in "=-" and (m := _SETEXT.match(s)):
                body = "\n".join(para)
                while d := _DEFINITION.match(body):
                    body = body[d.end() :]
                if body.strip():
                    out.append(Span(para_start, no + 1, 1 if m[1][0] == "=" else 2, body.strip(), "setext", bool(stack)))
                    leaf, done = None, True
                    break
                if m[1][0] == "=":
                    break
            if s[0] in "*-_" and _BREAK.match(s):
                del stack[depth:]
                leaf, done = None, True
                break
            m = _MARKER.match(s)
            if m and not (here and (not s[m.end() :].strip() or (m[2] is not None and int(m[2]) != 1))):
                del stack[depth:]
                after = s[m.end() :]
                pad, chars = _indent(after, col + n + m.end())
                empty = chars == len(after)
                width = 1 if empty or pad > 4 else pad
                stack.append(_Item(n + m.end() + width, empty))
                leaf, unmatched, opened = None, False, True
                depth += 1
                rest, col = _strip(after, col + n + m.end(), width)
                continue
            break
        if done:
            continue
        n, at = _indent(rest, col)
        if at == len(rest):
            if unmatched:
                # A blank line ends what isn't continued, save for lazy text that ends anyhow.
                del stack[depth:]
            if leaf == "para":
                leaf = None
            continue
        if leaf == "para" and not opened:
            para.append(rest[at:])
            continue
        del stack[depth:]
        leaf, para, para_start = "para", [rest[at:]], no
    return out
