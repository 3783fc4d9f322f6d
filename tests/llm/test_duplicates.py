"""Problems 1 and 2 against brute force over all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from headwater.llm import neardup, overlap, words


def sets(texts, k=3, least=30):
    out = {}
    for i, t in texts:
        w = words.WORD.findall((t or "").lower())
        if len(w) >= least:
            out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    return out


def close_pairs(texts, similarity=0.5, **kw):
    s = sorted(sets(texts, **kw).items())
    return {(a, b) for n, (a, x) in enumerate(s) for b, y in s[n + 1 :] if len(x & y) >= similarity * len(x | y)}


def edited(rng, n, share):
    base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
    return base, [w if rng.random() > share else f"x{rng.randrange(10**6)}" for w in base]


@pytest.fixture(scope="module")
def made():
    """Texts of every length with copies, edits around the threshold, blocks in another order, and dirt."""
    rng, texts = random.Random(7), []
    for n in (30, 31, 45, 60, 90, 150, 400, 1500):
        for share in (0.0, 0.03, 0.08, 0.1, 0.12, 0.15, 0.3):
            a, b = edited(rng, n, share)
            texts += [" ".join(a), ", ".join(b).upper()]
        a, _ = edited(rng, n, 0)
        texts += [" ".join(a), " ".join(a[n // 2 :] + a[: n // 2])]
    texts += ["same words again " * 20] * 6 + ["", " ", None, "short text", "文 " * 40, "word " * 29, "word " * 30]
    return list(enumerate(texts, 1))


def test_near_duplicates_are_those_of_brute_force(spark, made):
    df = spark.createDataFrame(made, "record_id long, content string").withColumn("rep", F.lit("clash")).withColumn("anchors", F.lit(1))
    classes, links = neardup.near_duplicates(df, "record_id", "content", k=3, similarity=0.5, least_words=30)
    got = [tuple(r) for r in neardup.expand_pairs(classes, links).collect()]
    want = close_pairs(made)
    assert len(got) == len(set(got)) and set(got) <= want
    # Pairs within a few shingles of the threshold may be missed with a chance below 1 in 400 each.
    assert len(want - set(got)) <= 1
    groups = {r["id"]: r for r in neardup.link_groups(classes, links).collect()}
    assert set(groups) == set(sets(made)) and all(groups[a]["group_id"] == groups[b]["group_id"] for a, b in got)
    degree = {i: sum(i in p for p in got) for i in groups}
    assert all(groups[i]["n_links"] == degree[i] for i in groups)


def test_near_duplicates_of_given_tables(spark, small, rows_of):
    from headwater.llm import queries

    want = close_pairs([(r["record_id"], r["content"]) for r in rows_of("raw_documents")])
    assert {tuple(r) for r in queries.p2_found(spark, small).collect()} == want


def test_default_threshold_and_empty_tables(spark):
    rng = random.Random(1)
    a, b = edited(rng, 300, 0.01)
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(edited(rng, 300, 0)[0]))]
    df = spark.createDataFrame(rows, "id long, t string")
    classes, links = neardup.near_duplicates(df, "id", "t")
    assert [(r["rep_a"], r["rep_b"]) for r in links.collect()] == [(1, 2)]
    classes, links = neardup.near_duplicates(df.limit(0), "id", "t")
    assert classes.count() == 0 and links.count() == 0 and neardup.link_groups(classes, links).count() == 0
    with pytest.raises(ValueError):
        neardup.near_duplicates(df, "id", "t", blocks=40)


def test_words_that_differ_in_one_symbol_share_an_anchor():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**63, (1, 64), dtype=np.uint64)
    for at in range(64):
        y = x.copy()
        y[0, at] ^= np.uint64(0x5A5A)
        shared = set(neardup.anchors(x).ravel().tolist()) & set(neardup.anchors(y).ravel().tolist())
        assert len(shared) >= 15 * 4 + 1


def test_winnowing_is_nested_and_guarantees_shared_runs():
    rng = np.random.default_rng(2)
    g = rng.integers(0, 2**63, 400, dtype=np.uint64)
    for w in (2, 5, 16):
        chosen = words.winnow(g, w)
        assert np.diff(np.concatenate([[-1], chosen, [len(g)]])).max() <= w
        assert set(chosen) <= set(words.winnow(g, w - 1))
    for start in range(0, 380, 19):
        other = rng.integers(0, 2**63, 100, dtype=np.uint64)
        other[40:56] = g[start : start + 16]
        assert set(g[words.winnow(g, 16)]) & set(other[words.winnow(other, 16)])


def test_cross_split_is_brute_force(spark, made):
    split = {i: ("train", "validation", "test", "TRAIN ", None)[i % 5 if i % 7 else 0] for i, _ in made}
    rows = [(kind, i, split[i], "s", t) for i, t in made for kind in ("raw", "example")]
    texts = spark.createDataFrame(rows, "kind string, id long, split string, source string, text string")
    members, pairs = overlap.cross_split(texts)
    side = {i: None if s is None else "train" if s.strip().lower() == "train" else "held" for i, s in split.items()}
    want = {(a, b) for a, b in close_pairs(made) if {side[a], side[b]} == {"train", "held"}}
    got = [tuple(r) for r in overlap.close_pairs(members, pairs).collect()]
    assert len(got) == len(set(got)) and {p[0] for p in got} == {"raw", "example"}
    for kind in ("raw", "example"):
        mine = {p[1:] for p in got if p[0] == kind}
        assert mine <= want and len(want - mine) <= 1
    report = overlap.coverage_report(overlap.record_report(members, pairs)).collect()
    assert sum(r["overlapping"] for r in report) == 2 * len({i for p in want for i in p if side[i] == "held"}) and all(r["covered_words"] <= r["words"] for r in report)
    members, pairs = overlap.cross_split(texts.limit(0))
    assert overlap.close_pairs(members, pairs).count() == 0


def test_cross_split_of_given_tables(spark, small, rows_of):
    from headwater.llm import queries

    raw = rows_of("raw_documents")
    held = {r["record_id"] for r in raw if r["split"] in ("validation", "test")}
    train = {r["record_id"] for r in raw if r["split"] == "train"}
    want = {(a, b) for a, b in close_pairs([(r["record_id"], r["content"]) for r in raw]) if (a in held and b in train) or (a in train and b in held)}
    got = {tuple(r)[1:] for r in queries.p1_found(spark, small).where("kind = 'raw'").collect()}
    assert got == want


def test_hot_fingerprints_stay_counted(spark):
    """A phrase that every text holds isn't a key, and pairs are found all the same."""
    rng = random.Random(4)
    phrase = [f"p{i}" for i in range(40)]
    rows = []
    for i in range(300):
        own = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        rows.append(("raw", 2 * i, "train", "s", " ".join(phrase + own)))
        if i % 10 == 0:
            rows.append(("raw", 2 * i + 1, "test", "s", " ".join(own[:57] + phrase)))
    texts = spark.createDataFrame(rows, "kind string, id long, split string, source string, text string")
    got = {tuple(r)[1:] for r in overlap.close_pairs(*overlap.cross_split(texts, limit=8)).collect()}
    assert got == close_pairs([(r[1], r[4]) for r in rows]) & {(2 * i, 2 * i + 1) for i in range(300)} and len(got) == 30


def test_a_contained_record_is_covered(spark):
    """A record inside longer train texts: coverage is the union over partners, copies count as partners."""
    rng = random.Random(8)
    own = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    other = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    long = other(1400) + own + other(1400)
    half = own[:75] + other(75)
    rows = [("raw", 1, "test", "s", " ".join(own)), ("raw", 2, "train", "s", " ".join(long)), ("raw", 3, "train", "t", " ".join(long)), ("raw", 4, "train", "s", " ".join(half)), ("raw", 5, "validation", "s", " ".join(other(200)))]
    texts = spark.createDataFrame(rows, "kind string, id long, split string, source string, text string")
    report = {r["id"]: r for r in overlap.record_report(*overlap.cross_split(texts, contained=0.8), contained=0.8).collect()}
    assert set(report) == {1, 5} and (report[1]["partners"], report[1]["covered_words"]) == (2, 150) and (report[5]["partners"], report[5]["jaccard"], report[5]["covered_words"]) == (0, None, 0)
    assert [r["partners"] for r in overlap.record_report(*overlap.cross_split(texts)).where("id = 1").collect()] == [0]


def contained_of(rows, share):
    """All pairs (train, held) of one kind by brute force."""
    side = {"train": 0, "validation": 1, "test": 1}
    of = {(r[0], r[1]): (side[r[2]], x) for r in rows for x in [sets([(1, r[4])]).get(1)] if x}
    return {(a[0], a[1], b[1]) for a, (s, x) in of.items() for b, (t, y) in of.items() if (s, t) == (0, 1) and a[0] == b[0] and len(x & y) / min(len(x), len(y)) >= share}


def test_contained_records_are_found_whatever_number_of_texts_has_their_runs(spark):
    """Every run of the records is in more texts than the limit, on both sides."""
    rng = random.Random(31)
    own, rows = edited(rng, 120, 0)[0], []
    for i in range(40):
        text = list(own)
        text[rng.randrange(120)] = f"z{i}"
        rows.append(("raw", i, "train" if i % 2 else "test", "s", " ".join(edited(rng, 900, 0)[0] + text + edited(rng, 900, 0)[0] if i % 2 else text)))
    texts = spark.createDataFrame(rows, "kind string, id long, split string, source string, text string")
    report = overlap.record_report(*overlap.cross_split(texts, contained=0.8, limit=8), contained=0.8).collect()
    assert len(report) == 20 and all(r["partners"] == 20 and r["covered_words"] >= 114 for r in report)


def test_contained_records_are_those_of_brute_force(spark):
    """Shares around the bound in one stretch, in scattered pieces and in changed words, either side the longer one, and a phrase in every text."""
    rng, rows = random.Random(12), []
    phrase = [f"p{i}" for i in range(50)]

    def add(kind, split, text):
        rows.append((kind, len(rows), split, "s", " ".join(text)))

    for n in (30, 33, 60, 150, 700):
        for share in (0.0, 0.03, 0.06, 0.07, 0.08, 0.12):
            for times, across in ((1, False), (4, True), (30, False), (30, True)):
                a, b = edited(rng, n, share)
                pieces = [b[i : i + 25] for i in range(0, n, 25)] if across else [b]
                long = [w for x in pieces for w in edited(rng, times * n // len(pieces), 0)[0] + x]
                held, train = (a, long) if rng.random() < 0.5 else (long, a)
                add("raw", "test", phrase + held if n < 100 else held), add("raw", "train", phrase + train)
        add("example", "train", a), add("example", "test", b), add("raw", "validation", a), add("raw", "train", a), add("raw", "train", long)
    texts = spark.createDataFrame(rows, "kind string, id long, split string, source string, text string")
    members, pairs = overlap.cross_split(texts, contained=0.8, limit=8)
    train, held = (members.where(F.col("side") == s).select("kind", F.col("id").alias(f"id_{s}"), F.col("rep").alias(rep)) for s, rep in ((0, "train_rep"), (1, "held_rep")))
    got = [tuple(r) for r in pairs.where("contained >= 0.8").join(train, "train_rep").join(held, ["held_rep", "kind"]).select("kind", "id_0", "id_1").collect()]
    want = contained_of(rows, 0.8)
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 60


def test_a_crowded_group_of_reworked_copies_is_found_whole(spark):
    """Every fingerprint of the group is crowded at every level, and no link is lost."""
    rng = random.Random(21)
    base, _ = edited(rng, 120, 0)
    rows = []
    for i in range(160):
        text = [w if rng.random() > 0.04 else f"x{rng.randrange(10**6)}" for w in base]
        rows.append(("raw", i, "train" if i % 2 else "test", "s", " ".join(text)))
    texts = spark.createDataFrame(rows, "kind string, id long, split string, source string, text string")
    want = close_pairs([(r[1], r[4]) for r in rows])
    got = {tuple(r)[1:] for r in overlap.close_pairs(*overlap.cross_split(texts, limit=8)).collect()}
    assert len(want) > 8000 and got == {p for p in want if (p[0] + p[1]) % 2}
    got = {tuple(r) for r in neardup.expand_pairs(*neardup.near_duplicates(texts, "id", "text", k=3, similarity=0.5, least_words=30, limit=8)).collect()}
    assert got <= want and len(want - got) <= len(want) // 1000


def test_a_text_that_has_a_key_twice_is_no_pair():
    from headwater.llm import meet

    rows = [np.array(c, np.int64) for c in ([5] * 4, [1, 1, 2, 2], [40] * 4, *[[0] * 4] * 5)]
    x, y = meet._pairs(rows, np.array([0]), np.array([4]), False, 0.5, 60)
    assert set(zip(x.tolist(), y.tolist())) == {(1, 2)}


def test_pairs_of_full_keys_are_compared_a_part_at_a_time():
    import tracemalloc

    from headwater.llm import meet

    n, each = 20, 512
    rng = np.random.default_rng(5)
    sketch = rng.integers(-(2**63), 2**63 - 1, (4, n * each), dtype=np.int64)
    sketch[:, each + 300] = sketch[:, each + 7]
    key, size = np.repeat(np.arange(n), each), np.tile(np.repeat([-40, 40], each // 2), n)
    rows = [key, np.arange(n * each), size, *sketch, np.zeros(n * each, np.int64)]
    tracemalloc.start()
    x, y = meet._pairs(rows, np.arange(n) * each, np.full(n, each), True, 0.5, 100)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert list(zip(x.tolist(), y.tolist())) == [(each + 7, each + 300)] and peak < 32e6


def test_a_task_of_the_keys_runs_one_function_and_no_worker_keeps_its_words(spark, monkeypatch):
    import time

    import pyarrow as pa

    from headwater.llm import meet

    rng, seen, real = random.Random(3), [], meet.met_pairs
    monkeypatch.setattr(meet, "met_pairs", lambda rows, **kw: seen.append(rows) or real(rows, **kw))
    rows = [("raw", i, "train" if i % 2 else "test", "s", "onlyhere " + " ".join(edited(rng, 60, 0)[0])) for i in range(40)]
    rows += [("raw", 40, "train", "s", rows[0][4]), ("raw", 41, "train", "s", rows[0][4])]
    overlap.cross_split(spark.createDataFrame(rows, "kind string, id long, split string, source string, text string"))

    def functions(node):
        """Most Python functions between two exchanges at or below the node, and those of its own stage."""
        below = [functions(node.children().apply(i)) for i in range(node.children().size())]
        own = sum(b[1] for b in below) if node.nodeName() != "Union" else max(b[1] for b in below)
        own = 0 if "Exchange" in node.nodeName() else own + (node.nodeName() == "MapInArrow")
        return max([own, *(b[0] for b in below)]), own

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = seen[0].where("level = 0")._jdf.queryExecution().executedPlan()
        assert functions(plan)[0] == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")

    def held(batches):
        time.sleep(0.2)  # so that every idle worker gets a task
        for _ in batches:
            pass
        yield pa.RecordBatch.from_arrays([pa.array([int("onlyhere" in words._memo)])], ["n"])

    assert sum(r["n"] for r in spark.range(0, 16, 1, 16).mapInArrow(held, "n long").collect()) == 0


def test_alignment_covers_what_is_shared():
    a = np.arange(100, 200, dtype=np.uint64)
    b = np.concatenate([np.arange(50, 60), np.arange(100, 140), [7, 8], np.arange(142, 200)]).astype(np.uint64)
    in_a, in_b = overlap.align(a, b)
    assert in_a.sum() == in_b.sum() == 98
    assert [x.sum() for x in overlap.align(a[:3], b)] == [0, 0]


def test_bitmap_keeps_what_is_wanted(spark):
    from headwater.llm import prefilter

    wanted = spark.range(0, 3000, 7)
    words_ = prefilter.bitmap(wanted, "id", bits=16)
    assert len(words_) == 1 << 10
    rows = spark.range(3000).withColumn("bit", prefilter.bit_of("id", bits=16))
    kept = {r[0] for r in rows.mapInArrow(prefilter.only(words_, lambda batches: batches), "id long").collect()}
    assert set(range(0, 3000, 7)) <= kept and len(kept) < 600
    assert prefilter.bitmap(wanted.limit(0), "id", bits=16).sum() == 0


def test_close_pairs_are_found_under_any_pattern_of_edits(spark):
    """Lines in another order, every ninth word replaced, a text against its own repetitions."""
    rng, rows = random.Random(11), []

    def add(a, b):
        at = len(rows)
        rows.extend([("raw", at, "train", "s", " ".join(a)), ("raw", at + 1, "test", "s", " ".join(b))])

    for n, line in ((60, 6), (402, 6), (1998, 6), (420, 7)) * 3:
        base, _ = edited(rng, n, 0)
        lines = [base[i : i + line] for i in range(0, n, line)]
        add(base, [w for x in rng.sample(lines, len(lines)) for w in x])
    for n in (60, 400, 1200):
        base, _ = edited(rng, n, 0)
        add(base, [f"z{i}" if i % 9 == 8 else w for i, w in enumerate(base)])
    for n, times in ((40, 8), (44, 13), (47, 20)):
        base, _ = edited(rng, n, 0)
        add(base, base * times)
    want = close_pairs([(r[1], r[4]) for r in rows])
    got = {tuple(r)[1:] for r in overlap.close_pairs(*overlap.cross_split(spark.createDataFrame(rows, "kind string, id long, split string, source string, text string"))).collect()}
    assert len(want) >= 15 and got == want
