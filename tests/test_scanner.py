import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from headwater.functions.scanner import scan

CASES = [
    ("# a\n\n## b ##\n#c\n### \n", [(1, "a"), (2, "b"), (3, "")]),
    ("Foo\nbar\n===\n\nx\n---\n", [(1, "Foo\nbar"), (2, "x")]),
    ("```\n# no\n```\n# yes", [(1, "yes")]),
    ("~~~ x\n# n\n~~\n~~~\n## y", [(2, "y")]),
    ("````\n```\n# n\n````\n# y", [(1, "y")]),
    ("> # q\n> x\ny\n---\n- # l\n", [(1, "q"), (1, "l")]),
    ("    # code\n", []),
    ("\t# code\n", []),
    ("para\n    # not code, not a heading\n", []),
    ("<div>\n# no\n\n# yes\n", [(1, "yes")]),
    ("<!--\n# no\n\n# no\n-->\n# yes", [(1, "yes")]),
    ("<script>\n# no\n\n# no\n</script>\n# yes", [(1, "yes")]),
    ("[a]: /u\n===\n", []),
    ("- a\n  ===\n", [(1, "a")]),
    ("> a\n===\n", []),
    ("# a #b\n# c \\#\n", [(1, "a #b"), (1, "c \\#")]),
    ("1. x\n\n   ## in\n", [(2, "in")]),
    ("a\n\n---\nb\n", []),
    ("## \n#\n### ###", [(2, ""), (1, ""), (3, "")]),
    ("- x\n\n# h\n", [(1, "h")]),
    ("#NoSpace\n####### seven\n", []),
    ("# a\r\n## b\r# c", [(1, "a"), (2, "b"), (1, "c")]),
    ("* * *\n# a", [(1, "a")]),
    ("- one\n- two\n---\n# a", [(1, "a")]),
    ("", []),
    (None, []),
]


@pytest.mark.parametrize("text,want", CASES)
def test_headings(text, want):
    assert [(s.level, s.text) for s in scan(text)] == want


def test_lines_and_nesting():
    got = scan("x\n\nFoo\nbar\n---\n\n> ## q\n")
    assert [(s.line_start, s.line_end, s.kind, s.nested) for s in got] == [(2, 5, "setext", False), (6, 7, "atx", True)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 6), st.text("abc XYZ.", min_size=1, max_size=12).map(str.strip).filter(bool)), max_size=8))
def test_plain_atx_round_trip(pairs):
    text = "\n\n".join(f"{'#' * n} {t}\n\nBody." for n, t in pairs)
    assert [(s.level, s.text) for s in scan(text)] == pairs


@settings(max_examples=300, deadline=None)
@given(st.text("#=-> \n\t`*1.a<", max_size=80))
def test_any_text_keeps_order_and_bounds(text):
    spans = scan(text)
    n = len(text.split("\n"))
    assert all(0 <= s.line_start < s.line_end <= n and 1 <= s.level <= 6 for s in spans)
    assert all(a.line_end <= b.line_start for a, b in zip(spans, spans[1:]))
