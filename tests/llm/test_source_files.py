import pytest
from pyspark.sql import functions as F

from headwater.llm import queries, source_files as S

HAND = "def load_record(ledger, cache=None):\n    # check the ledger first\n    if not ledger:\n        return cache\n    return [x.name for x in ledger]\n"
MINIFIED = ";".join(f"function {a}({b},{c}){{return {b}.x({c})+{i}}}" for i, (a, b, c) in enumerate(zip("abcdefghij" * 3, "klmnopqrst" * 3, "uvwxyzabcd" * 3)))
ROWS = [
    (1, "o/r", "src/load.py", HAND, []),
    (2, "o/r", "src/load.py", "# Code generated by protoloom. DO NOT EDIT.\n" + HAND, ["generated"]),
    (3, "o/r", "src/load.py", "# Copyright 2020 the authors.\n\n# Fichier généré par x, ne pas modifier.\n" + HAND, ["generated"]),
    (4, "o/r", "src/load.py", 'MARK = "Code generated by protoloom. DO NOT EDIT."\n' + HAND, []),
    (5, "o/r", "src/load.py", "# Do not edit the ledger while the gate is open.\n" + HAND, []),
    (6, "o/r", "src/__generated__/load.py", HAND, ["generated"]),
    (7, "o/r", "generated_reports/load.py", HAND, []),
    (8, "o/r", "web/app.js", MINIFIED, ["minified"]),
    (9, "o/r", "vendor/lib/load.py", HAND, ["vendored"]),
    (10, "o/r", "src/vendor_list/load.py", HAND, []),
    (11, "o/r", "src/load.py", "# Vendored copy of abc (1.2.3)\n" + HAND, ["vendored"]),
    (12, "o/r", "lib/other/load.py", HAND, ["vendored"]),
    (13, "o/r", "lib/r/load.py", HAND, []),
    (14, "O/Other", "lib/other/load.py", HAND, []),
    (15, "o/r", "src/data.py", "DATA = [\n" + ",\n".join(", ".join(str(i * j % 251) for j in range(12)) for i in range(9)) + "]\n", ["data"]),
    (16, "o/r", "src/table.py", "TABLE = [1, 2, 3, 4, 5, 6, 7, 8]\n" + HAND, []),
    (17, "o/r", "src/rows.py", "ROWS = [\n" + ",\n".join(f'{{"a": {i}, "x": 0.{i}7}}' for i in range(20)) + "]\n", ["data"]),
    (18, "o/r", "docs/generated-files.md", "# Generated and vendored code\n\nDo not edit generated files.\n", []),
    (19, "o/r", "src/t.py", "\n".join(f"castle_former_{i} = {i * 37 % 900}" for i in range(30)), ["generated"]),
    (20, "o/r", None, HAND, []),
    (21, None, "lib/other/load.py", HAND, []),
    (22, "o/r", "src/load.py", None, []),
    (23, "o/r", "src/load.py", "", []),
    (24, "o/r", "src/settings.ini", "ledger = 5\nport.inner = \"x\"\n" * 9, []),
]


@pytest.fixture(scope="module")
def files(spark):
    rows = [(i, r, p, "Python" if i % 2 else None, t) for i, r, p, t, _ in ROWS] + [(100, "x/other", "a.py", "python", HAND)]
    rows += rows[:3] + [(None, "a/b", "c.py", None, "x")]
    return spark.createDataFrame(rows, "file_id long, repo string, path string, code_lang string, content string").withColumn("kinds", F.lit("clash")).withColumn("project", F.lit("clash"))


def test_kinds(files):
    got = {r["file_id"]: r["kinds"] for r in S.classify_files(files).collect()}
    want = {i: k for i, *_, k in ROWS} | {100: []}
    assert {i: (got[i], want[i]) for i in want if got[i] != want[i]} == {} and len(got) == len(want)


def test_empty(files):
    assert S.classify_files(files.limit(0)).count() == 0


def test_one_row_for_each_file(spark, small, rows_of):
    out = queries.p6_found(spark, small)
    assert out.count() == out.distinct().count() < len({r["file_id"] for r in rows_of("repo_files")})


def test_mangled_names_cost_more_bits_than_written_ones(files):
    bits = S.name_models(files)["python"]
    score = lambda names: bits[S.bigrams(names)].mean()
    assert score(["load_record", "ledger", "cache"]) < score(["xq7", "zzkw", "Qj"])


def test_mangled_names_longer_than_four_signs_are_found_by_what_they_cost(spark):
    """Minified with names of mean length over 4 and no mark in the path; a dense file of plain words stays unflagged."""
    words = "load record ledger cache source window render handler margin target index parser buffer column".split()
    hand = lambda i: "\n".join(f"function {a}{b.title()}({c}, value) {{\n    return {c}.{b}(value)\n}}" for a, b, c in zip(words[i % 7 :], words[i % 5 + 1 :], words[i % 3 + 2 :]))
    squeezed = ";".join(f"function {a}{b.title()}({c},value){{return {c}.{b}(value)}}" for a, b, c in zip(words, words[1:], words[2:]))
    garbled = ";".join(f"function q{c}zX({c}vj,k{c}J){{return {c}vj.wQ{c}(k{c}J)}}" for c in "xjqvzkwgyh")
    assert sum(map(len, S.identifiers(garbled))) > 4 * len(S.identifiers(garbled)) and min(len(squeezed), len(garbled)) >= 250
    rows = [(i, "o/r", f"src/a{i}.js", "javascript", hand(i)) for i in range(60)] + [(100, "o/r", "web/app.js", None, garbled), (101, "o/r", "web/page.js", None, squeezed)]
    files = spark.createDataFrame(rows, "file_id long, repo string, path string, code_lang string, content string")
    got = {r["file_id"]: r["kinds"] for r in S.classify_files(files).collect()}
    assert got[100] == ["minified"] and got[101] == [] and not any(got[i] for i in range(60))


def test_templates_with_few_digits_are_found():
    text = "\n".join(f"def get_customer_address_{i}(customer_record_{i}, default_value_{i}):\n    pass\n" for i in range(1, 10))
    m = S.examine(text, S.np.ones(S._SIDE**2))
    assert m["diversity"] <= 0.25 and S.kinds_of("src/a.py", m, "python") == ["generated"]


def test_a_mark_below_a_long_licence_is_found():
    text = "\n".join(["# licence text"] * 80 + ["# Code generated by protoloom. DO NOT EDIT."]) + "\n" + HAND
    m = S.examine(text, S.np.ones(S._SIDE**2))
    assert m["marked"] and S.kinds_of("src/a.py", m, "python") == ["generated"]


def test_each_model_decides(spark, monkeypatch):
    """Mangled names, template-like names and a foreign naming style are each found by their measure alone."""
    words = "load record ledger cache source window render handler margin target index parser buffer column".split()
    hand = lambda i: "\n".join(f"function {a}{b.title()}({c}{a.title()}) {{\n    return {c}{a.title()}.{b}Value(1)\n}}" for a, b, c in zip(words[i % 7 :], words[i % 5 + 1 :], words[i % 3 + 2 :]))
    garbled = ";".join(f"function q{c}zX({c}vj,k{c}J){{return {c}vj.wQ{c}(k{c}J)}}" for c in "xjqvzkwgyh")
    snake = "\n".join(f"function {a}_{b}({c}_{a}) {{\n    return {c}_{a}.{b}_value(1)\n}}" for a, b, c in zip(words, words[1:], words[2:]))
    template = "\n".join(f"function getCustomerField{i}(customerRecord{i}) {{\n    return customerRecord{i}\n}}" for i in range(30))
    rows = [(i, "o/r", f"src/a{i}.js", "javascript", hand(i)) for i in range(60)] + [(100, "o/r", "web/a.js", None, garbled), (101, "o/r", "web/b.js", None, snake), (102, "o/r", "web/c.js", None, template)]
    files = spark.createDataFrame(rows, "file_id long, repo string, path string, code_lang string, content string")
    got = {r["file_id"]: r["kinds"] for r in S.classify_files(files).collect() if r["kinds"]}
    assert got == {100: ["minified"], 101: ["vendored"], 102: ["generated"]}
    monkeypatch.setattr(S, "_FOREIGN_BITS", 1e9)
    assert {r["file_id"] for r in S.classify_files(files).where("size(kinds) > 0").collect()} == {100, 102}
    monkeypatch.setattr(S, "_WRITTEN", 1.0), monkeypatch.setattr(S, "name_models", lambda rows: {"*": S.np.zeros(S._SIDE**2)})
    assert {r["file_id"] for r in S.classify_files(files).where("size(kinds) > 0").collect()} == {102}
