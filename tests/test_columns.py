import math
import random

import pytest
from pyspark.sql import functions as F

from headwater.functions import answers
from headwater.functions import markdown as M
from headwater.functions import metrics as E
from headwater.functions import tokens
from headwater.operators import filters, predict, sampling

DOC = "# A\n\nintro\n\n## B\n\n```\n# comment\n```\n\n## C\n\ntext\n\n# D\n"


def column(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first()[0]


def test_count_marks_counts_comments_of_code(spark):
    assert column(spark, DOC, M.count_marks) == 3
    assert column(spark, "", M.count_marks) == 0


@pytest.mark.parametrize("levels,gap", [([], 0), ([1], 0), ([1, 1], 0), ([1, 2, 2, 3], 1), ([1, 4, 2], 2), ([6, 1], 5)])
def test_level_gap(spark, levels, gap):
    assert column(spark, levels, M.level_gap, "array<int>") == gap


def test_apply_identity_and_new_levels(spark):
    df = spark.createDataFrame([(DOC,)], "t string").withColumn("s", M.spans(F.col("t")))
    same = df.select(M.apply_levels(F.col("t"), F.col("s"), F.transform("s", lambda x: x["level"])).alias("y")).first()[0]
    assert same == DOC
    new = df.select(M.apply_levels(F.col("t"), F.col("s"), F.array(*map(F.lit, (2, 3, 1, 4)))).alias("y")).first()[0]
    assert new == DOC.replace("# D", "#### D").replace("## C", "# C").replace("## B", "### B").replace("# A", "## A")


def test_apply_nested_and_setext(spark):
    text = "> # q\n\n- ## l\n\nFoo\nbar\n===\n\n  ## in\n"
    df = spark.createDataFrame([(text,)], "t string").withColumn("s", M.spans(F.col("t")))
    levels = F.array(*map(F.lit, (3, 4, 5, 6)))
    assert df.select(M.apply_levels(F.col("t"), F.col("s"), levels)).first()[0] == "> ### q\n\n- #### l\n\n##### Foo bar\n\n###### in\n"
    compat = df.select(M.apply_levels(F.col("t"), F.col("s"), levels, compat=True)).first()[0]
    assert compat == "### > # q\n\n#### - ## l\n\n##### Foo\nbar\n===\n\n######  ## in\n"


def test_apply_raises_when_numbers_differ(spark):
    df = spark.createDataFrame([(DOC,)], "t string").withColumn("s", M.spans(F.col("t")))
    with pytest.raises(Exception, match="differ in number"):
        df.select(M.apply_levels(F.col("t"), F.col("s"), F.array(F.lit(1)))).collect()


def test_align(spark):
    df = spark.createDataFrame([([("a", 3), ("b", 4)], [1]), ([("a", 3)], [2, 5])], "h array<struct<text string, level int>>, p array<int>")
    assert [r[0] for r in df.select(M.align_levels(F.col("h"), F.col("p"))).collect()] == [[1, 4], [2]]


def test_strip(spark):
    df = spark.createDataFrame([(DOC,), ("plain " * 40,), ("",), (None,)], "t string").withColumn("s", M.spans(F.col("t")))
    got = [r[0] for r in df.select(M.strip_document(F.col("t"), F.col("s"), 8, 8)).collect()]
    assert got[0] == "# A\n\nintro\n\n# B\n\n```\n# comment\n```\n\n# C\n\ntext\n\n# D"
    assert "[...]" in got[1] and got[2:] == ["", None]


def test_pieces_are_lossless_and_shorten(spark):
    text = "  a b\n\tc  "
    assert "".join(column(spark, text, tokens.pieces)) == text
    assert column(spark, "a b c d e", lambda c: tokens.piece_shorten(c, 1, 1)) == "a\n[...]\n e"
    assert column(spark, "a b", lambda c: tokens.piece_shorten(c, 1, 1)) == "a b"
    assert tokens.shorten("a b c", 1, 0, tokens.PieceTokenizer()) == "a\n[...]\n"


def test_prefix_cut_native_is_python(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["# h", "\n", "x ", "é", "\n# ", " "]) for _ in range(rng.randrange(60))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(tokens.piece_prefix_cut(F.col("t"), 9)).collect()]
    assert got == [tokens.prefix_cut(t, 9, tokens.PieceTokenizer()) for t in texts]


def test_parse_and_format(spark):
    text = "  noise\n## a \n#b\n####### c\n   ### d e\n\n#  f"
    want = [("a", 2), ("d e", 3), ("f", 1)]
    assert [tuple(h) for h in column(spark, text, M.parse_answer)] == want == answers.parse_headings(text)
    df = spark.createDataFrame([(["a", "b", "c"], [1, 2])], "t array<string>, l array<int>")
    assert df.select(M.format_answer(F.col("t"), F.col("l"))).first()[0] == "# a\n## b"


@pytest.mark.parametrize(
    "titles,want",
    [(["X", "1 Intro", "1. X", "1.2 X", "1.2.3 X", " Usage ", "1.2.3.4.5.6.7 z", "other"], [1, 2, 2, 2, 3, 1, 6, 2]), ([], []), (["Usage"], [1])],
)
def test_heuristic(spark, titles, want):
    assert column(spark, titles, predict.heuristic_levels, "array<string>") == want


def python_metrics(p, t):
    same = len(p) == len(t)
    sign = lambda x: (x > 0) - (x < 0)
    acc = 0.0 if not same else (sum(a == b for a, b in zip(p, t)) / len(t) if t else None)
    pairs = range(len(t) - 1)
    h = 0.0 if not same or len(t) < 2 else sum(sign(p[i + 1] - p[i]) == sign(t[i + 1] - t[i]) for i in pairs) / len(pairs)
    mae = math.inf if not same else (sum(abs(a - b) for a, b in zip(p, t)) / len(t) if t else None)
    return [float(p == t), acc, h, mae, same]


def test_metrics_against_python(spark):
    rng = random.Random(1)
    rows = [([rng.randint(1, 6) for _ in range(rng.randrange(10))], None) for _ in range(400)]
    rows = [(p, p if rng.random() < 0.1 else [rng.randint(1, 6) for _ in range(len(p) if rng.random() < 0.8 else rng.randrange(10))]) for p, _ in rows]
    df = spark.createDataFrame(rows, "p array<int>, t array<int>")
    got = [list(r) for r in df.select(*E.all_metrics(F.col("p"), F.col("t"))).collect()]
    for g, (p, t) in zip(got, rows):
        w = python_metrics(p, t)
        assert all(a == b or (a is not None and b is not None and abs(a - b) < 1e-12) for a, b in zip(g, w)), (p, t, g, w)


@pytest.mark.parametrize(
    "p,t,want",
    [
        ([1], [1, 2], "count_mismatch"), ([1, 2], [1, 2], "correct"), ([3, 4], [1, 2], "off_by_one"), ([2, 2, 2], [1, 2, 3], "flat_prediction"), ([3, 2, 1], [1, 2, 3], "inverted_hierarchy"),
        ([1, 2, 1, 1, 2, 3, 1, 2], [1, 2, 2, 2, 3, 4, 1, 2], "lost_in_middle"), ([1, 2, 3, 2], [1, 2, 3, 1], "other"), ([], [], "correct"),
    ],
)
def test_error_classes(spark, p, t, want):
    df = spark.createDataFrame([(p, t)], "p array<int>, t array<int>")
    assert df.select(E.error_class(F.col("p"), F.col("t"))).first()[0] == want


@pytest.mark.parametrize("n,bucket", [(0, "< 4k"), (15_999, "< 4k"), (16_000, "4k-8k"), (149_999, "16k-32k"), (150_000, None)])
def test_bucket_bounds(spark, n, bucket):
    assert column(spark, "x" * n, filters.char_bucket) == bucket


@pytest.mark.parametrize("chars,levels,ok", [(299, [1, 2, 2], False), (300, [1, 2, 2], True), (300, [1, 2], False), (300, [1, 1, 1], False), (300, [1] * 119 + [2], True), (300, [1] * 120 + [2], False), (150_000, [1, 2, 2], True), (150_001, [1, 2, 2], False), (300, [1, 4, 4], True)])
def test_cheap_filter_bounds(spark, chars, levels, ok):
    df = spark.createDataFrame([("x" * chars, levels)], "t string, l array<int>")
    assert df.select(filters.cheap_filters(F.col("t"), F.col("l"))).first()[0] is ok


def test_paths(spark):
    rows = spark.createDataFrame([("a/Docs/x.MD",), ("mydocs/x.markdown",), ("src/x.mdx",), (None,)], "p string")
    got = [tuple(r) for r in rows.select(filters.markdown_path(F.col("p")), filters.priority_path(F.col("p"))).collect()]
    assert got == [(True, True), (True, True), (False, False), (None, None)]


def sequential_split(keys, counts, train, validation):
    total, out, filled = sum(counts.values()), {}, {"train": 0, "validation": 0, "test": 0}
    for k in keys:
        to = "train" if filled["train"] < int(total * train) else "validation" if filled["validation"] < int(total * validation) else "test"
        filled[to] += counts[k]
        out[k] = to
    return out


def test_split_matches_sequential_fill(spark):
    import hashlib

    rng = random.Random(5)
    counts = {f"k{i}": rng.choice([1, 1, 2, 9]) for i in range(300)} | {"": 40}
    df = spark.createDataFrame([(k,) for k, n in counts.items() for _ in range(n)], "key string")
    got = {r[0]: r[1] for r in sampling.split_keys(df, "key").collect()}
    keys = sorted(counts, key=lambda k: (hashlib.md5(f"{k}|42".encode()).hexdigest(), k))
    assert got == sequential_split(keys, counts, 0.9, 0.05)
    assert sampling.split_by_key(df, "key").groupBy("key").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0


def test_split_of_nothing(spark):
    assert sampling.split_keys(spark.createDataFrame([], "key string"), "key").count() == 0


def test_quota(spark):
    df = spark.createDataFrame([(i, "a" if i % 2 else "b") for i in range(20)] + [(99, "c"), (98, None)], "id int, bucket string")
    got = sorted(tuple(r) for r in sampling.bucket_quota(df, "id", targets={"a": 3, "b": 1}).collect())
    assert got == [(0, "b"), (1, "a"), (3, "a"), (5, "a")]
    assert sampling.bucket_quota(df, "id", targets={}).count() == 0


@pytest.mark.parametrize("levels,n", [([], 1), ([3], 1), ([4], 2), ([5, 1], 4), ([6], 8)])
def test_copies(spark, levels, n):
    assert column(spark, levels, sampling.copies, "array<int>") == n
