import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from headwater.llm import components, labels, mixing, queries, splits


def brute_components(edges):
    forest = components.Forest()
    for a, b in edges:
        forest.union(a, b)
    return {x: forest.find(x) for x in forest.parent}


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components(spark, shape):
    rng = random.Random(3)
    edges = {
        "chain": [(i, i + 1) for i in range(200)], "star": [(0, i) for i in range(1, 300)],
        "random": [(rng.randrange(400), rng.randrange(400)) for _ in range(300)], "none": [],
    }[shape]
    df = spark.createDataFrame(edges + [(None, 1), (5, 5)] if edges else [], "a long, b long").repartition(4)
    got = {r["node"]: r["root"] for r in components.connected_components(df).collect()}
    assert got == brute_components([e for e in edges if e[0] != e[1]])


@pytest.mark.parametrize(
    "a,b",
    [("Owner/Name", "https://forge.example/owner/name/"), ("owner/name.git", "git@forge.example:Owner/name.git"), (" owner/name ", "OWNER/NAME"), ("ssh://git@h.example/owner/name.git", "owner/name")],
)
def test_repo_spellings(a, b):
    assert splits.repo_key(a) == splits.repo_key(b) == "owner/name"


def test_keys_that_differ():
    assert splits.repo_key("a/name") != splits.repo_key("b/name") and splits.repo_key("a/name1") != splits.repo_key("a/name2")
    assert splits.title_key("Foo (town)") != splits.title_key("Foo (river)") != splits.title_key("Foo")
    same = ["Foo  bar (town)", "foo_bar_(town)", "FOO%20BAR%20(TOWN)", " Foo bar (town) ", "Foo bar(town)"]
    assert {splits.title_key(x) for x in same} == {"foo bar (town)"}
    assert splits.title_key("Économie") == splits.title_key("Économie") != splits.title_key("Economie")
    assert [splits.repo_key(x) for x in (None, "", " / ")] == [None] * 3 and [splits.title_key(x) for x in (None, " _ ")] == [None] * 2


def brute_torn(records, aliases):
    edges, nodes = [], {}
    for r in records:
        meta = r["meta"] or {}
        keys = [k + ":" + v for k, v in (("repo", splits.repo_key(meta.get("repo"))), ("title", splits.title_key(meta.get("title")))) if v]
        nodes[r["record_id"]] = keys
        edges += [(k, k) for k in keys] + ([tuple(keys)] if len(keys) == 2 else [])
    for a in aliases:
        key = splits.repo_key if a["kind"] == "repo" else splits.title_key
        edges.append((f"{a['kind']}:{key(a['old_key'])}", f"{a['kind']}:{key(a['new_key'])}"))
    root, seen = brute_components(edges), {}
    for r in records:
        if nodes[r["record_id"]] and r["split"]:
            seen.setdefault(root[nodes[r["record_id"]][0]], set()).add(r["split"])
    return {r["record_id"] for r in records if nodes[r["record_id"]] and r["split"] and len(seen[root[nodes[r["record_id"]][0]]]) > 1}


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_torn_is_brute_force(spark, rows_of, sf):
    assert {r[0] for r in queries.p3_found(spark, sf).collect()} == brute_torn(rows_of("raw_documents", sf), rows_of("key_aliases", sf))


META = "struct<repo string, title string>"


def test_torn_through_steps_and_dirt(spark):
    rows = [(1, "train", ("a/x", None)), (2, "test", ("https://h.example/A/Z.git", None)), (3, "train", ("b/y", "T (u)")), (4, "validation", (None, "t_(U)")), (5, None, ("a/x", None)), (6, "train", None), (7, "test", (" ", None)), (8, "train", ("c/q", None)), (8, "train", ("c/q", None))]
    records = spark.createDataFrame(rows, f"record_id long, split string, meta {META}").withColumn("node", F.lit("clash")).withColumn("root", F.lit("clash"))
    aliases = spark.createDataFrame([("a/x", "A/W ", "repo"), ("a/w", "a/z", "repo"), (None, "x", "repo"), ("x", "y", None)], "old_key string, new_key string, kind string")
    assert sorted(r[0] for r in splits.torn_records(records, aliases).collect()) == [1, 2, 3, 4]
    assert splits.torn_records(records.limit(0), aliases.limit(0)).count() == 0


def test_assignment_keeps_groups_and_shares(spark, small):
    d = "/root/testdata/sf0.01"
    out = queries.p3_assign(spark, d).cache()
    assert out.count() == 1300 and out.groupBy("group_key").agg(F.count_distinct("new_split").alias("n")).where("n > 1").count() == 0
    share = {r[0]: r[1] / 1300 for r in out.groupBy("new_split").count().collect()}
    assert abs(share["train"] - 0.9) < 0.01 and abs(share["validation"] - 0.05) < 0.01 and abs(share["test"] - 0.05) < 0.01


def test_assignment_without_shares_or_records(spark):
    records = spark.createDataFrame([(1, "train", ("a/x", None)), (2, None, None)], f"record_id long, split string, meta {META}")
    aliases = spark.createDataFrame([], "old_key string, new_key string, kind string")
    shares = spark.createDataFrame([("train", 1.0)], "split string, share double")
    assert {r["new_split"] for r in splits.assign_splits(records, aliases, shares).collect()} == {"train"}
    assert {r["new_split"] for r in splits.assign_splits(records, aliases, shares.limit(0)).collect()} == {None}
    assert splits.assign_splits(records.limit(0), aliases, shares).count() == 0


def test_greedy_fill_is_largest_first():
    filled = {"a": 0, "b": 0}
    assert splits.greedy_fill([("x", 5), ("y", 4), ("z", 1)], {"a": 0.5, "b": 0.5}, filled, 10) == {"x": "a", "y": "b", "z": "b"} and filled == {"a": 5, "b": 5}


@pytest.mark.parametrize("seed", range(6))
def test_equal_groups_are_filled_as_one_by_one(seed):
    rng = np.random.default_rng(seed)
    share = rng.dirichlet([1, 1, 1])
    targets = dict(zip("abc", share.tolist()))
    sizes = {int(n): int(k) for n, k in zip(rng.choice(np.arange(1, 60), 8, replace=False), rng.integers(1, 400, 8))}
    total = sum(n * k for n, k in sizes.items())
    one, bulk, counts = dict.fromkeys("abc", 0), dict.fromkeys("abc", 0), {}
    for n in sorted(sizes, reverse=True):
        got = splits.fill_equal(n, sizes[n], targets, bulk, total)
        by_one = splits.greedy_fill([(f"{n}-{i}", n) for i in range(sizes[n])], targets, one, total)
        assert got == {s: sum(v == s for v in by_one.values()) for s in "abc"} and bulk == one


EXAMPLE = "example_id long, split string, messages array<struct<role string, content string>>, metadata struct<source string>"
TARGET = "source string, target_share double, max_repeats int"


def test_mix_reaches_its_shares(spark, small):
    rows = queries.p7_mix(spark, "/root/testdata/sf0.01").collect()
    assert all(r["most_repeats"] <= r["max_repeats"] for r in rows)
    for r in rows:
        assert r["short"] == (r["max_repeats"] * r["supply"] < r["target_share"] * r["total"])
        if not r["short"] and r["max_repeats"] * r["supply"] > 1.2 * r["target_share"] * r["total"]:
            assert abs(r["size"] / r["total"] - r["target_share"]) < 0.04
    short = {r[0] for r in queries.p7_found(spark, "/root/testdata/sf0.01").collect()}
    assert short == {r["source"] for r in rows if r["short"]}


def test_mix_of_dirty_rows(spark):
    rows = [(1, "train", [("User ", "abcd" * 10), ("system", "x")], ("Git_Hub",)), (2, "train", [("user", None)], (None,)), (3, "train", None, None), (4, "test", [("user", "zzz")], ("git-hub",)), (5, "train", [("user", "ab" * 30)], None), (1, "train", [("user", "abcd" * 10)], ("git hub",))]
    df = spark.createDataFrame(rows, EXAMPLE)
    targets = spark.createDataFrame([("github", 0.9, 1), ("wiki", 0.1, 2), ("none", None, None)], TARGET)
    got = {r["source"]: r for r in mixing.mix_report(df, targets, block=10, per_shard=4).collect()}
    assert got["github"]["supply"] == 80 and got["github"]["total"] == 140 and got["github"]["short"] and got["wiki"]["short"] and not got["none"]["short"]
    assert got["github"]["most_repeats"] == 1 and got["github"]["size"] == 80
    assert mixing.mix_report(df.limit(0), targets).where("size > 0").count() == 0 and mixing.short_sources(df, targets.limit(0)).count() == 0


def test_blocks_cover_every_text_once(spark):
    sizes = spark.createDataFrame([(i, "s" if i % 3 else "t", (i * 37) % 50) for i in range(60)], "example_id long, source string, size long")
    got = mixing.blocks(sizes, 16).collect()
    for i, _, n in [(i, 0, (i * 37) % 50) for i in range(60)]:
        mine = sorted((r["first_at"], r["last_at"]) for r in got if r["example_id"] == i)
        assert sum(b - a for a, b in mine) == n and all(a[1] == b[0] for a, b in zip(mine, mine[1:]))
    full = {}
    for r in got:
        full[r["source"], r["block_no"]] = full.get((r["source"], r["block_no"]), 0) + r["last_at"] - r["first_at"]
    assert all(v == 16 for (s, n), v in full.items() if n < max(m for t, m in full if t == s))


def test_short_sources_come_from_the_draws(spark, monkeypatch):
    """Where no draw runs out of blocks, no source is short; slots that are lacking stay empty."""
    rows = [(i, "train", [("user", "abcd" * 50)], ("a" if i < 10 else "b",)) for i in range(200)]
    df = spark.createDataFrame(rows, EXAMPLE)
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 1)], TARGET)
    got = {r["source"]: r for r in mixing.mix_report(df, targets, block=100, per_shard=7).collect()}
    assert got["a"]["short"] and got["a"]["empty"] > 100 and got["a"]["slots"] == 40 and not got["b"]["short"] and got["b"]["empty"] == 0
    assert sum(r["slots"] + r["empty"] for r in got.values()) == 400
    draws = mixing.draw_slots
    monkeypatch.setattr(mixing, "draw_slots", lambda *a: draws(*a).where("false"))
    assert mixing.mix_report(df, targets, block=100, per_shard=7).where("short").count() == 0


def test_blocks_of_tokens(spark):
    from headwater.llm import bpe

    rows = [(i, "train", [("user", "the cat sat on the mat. " * (i + 1)), ("user", None), ("system", "not counted")], ("a",)) for i in range(20)] + [(99, "train", None, ("a",))]
    df = spark.createDataFrame(rows, EXAMPLE)
    targets = spark.createDataFrame([("a", 1.0, 1)], TARGET)
    path = bpe.vocabulary_path()
    want = {r[0]: bpe.counter(path).count(r[2][0][1]) for r in rows[:-1]}
    assert {r["example_id"]: r["size"] for r in mixing.train_sizes(df, targets, path).collect()} == want | {99: 0}
    got = mixing.mixed_blocks(df, targets, block=64, per_shard=4, vocabulary=path).collect()
    taken = {}
    for r in got:
        taken[r["example_id"]] = taken.get(r["example_id"], 0) + r["last_at"] - r["first_at"]
    assert taken == want


@pytest.mark.parametrize("n", [1, 2, 3, 17, 100, 1025])
def test_permutation(n):
    x = mixing.permute(np.arange(n), np.full(n, n), np.full(n, 99, np.uint64))
    assert sorted(x.tolist()) == list(range(n))


@pytest.mark.parametrize("text,want", [("the cat and the dog", "en"), ("der Hund und die Katze", "de"), ("le chat et les chiens", "fr"), ("el gato y los perros", "es"), ("静かな島は静かな村を", "ja"), ("安静的河流替换古老的村庄", "zh"), ("Organizational consolidation", "en"), ("", None), (None, None), ("123", None)])
def test_language(text, want):
    assert labels.language_of(text) == want


def test_labels(spark):
    df = spark.createDataFrame([("en-US", "https://WWW.Forge.example:80/x", " GitHub-Code\n"), ("ger", "forge.example", "github code"), (None, None, None), ("??", " ", "--")], "l string, d string, s string")
    got = [tuple(r) for r in df.select(labels.language_label_column(F.col("l")), labels.domain_name(F.col("d")), labels.canonical(F.col("s"))).collect()]
    assert got == [("en", "forge.example", "githubcode"), ("de", "forge.example", "githubcode"), (None, None, None), (None, None, None)]
    assert [labels.language_label(x) for x in ("en-US", "ger", None, "??")] == ["en", "de", None, None]
