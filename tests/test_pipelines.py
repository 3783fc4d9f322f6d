import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from headwater import cli
from headwater.functions import markdown as M
from headwater.operators import evaluation, predict
from headwater.plans import corpus, pipelines
from headwater.session import table
from headwater.sources import files
from headwater.streaming import folder

DOC = "# A\n\nintro\n\n# B\n\ntext\n"


def test_prepare_is_leak_free_and_oversamples(spark, small):
    raw = corpus.derived(table(spark, small, "raw_documents")).drop("levels", "titles").withColumn("spans", M.spans(F.col("content")))
    out = pipelines.prepare(raw, least_tokens=1).select("record_id", "split", "split_key", "copy", "messages", "levels", "metadata").cache()
    assert out.groupBy("split_key").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    assert out.where("split != 'train' and copy > 1").count() == 0
    bad = out.where((F.col("copy") > 1) & (F.array_max("levels") < 4)).count()
    assert bad == 0 and out.where("size(messages) != 3").count() == 0
    assert out.where(F.col("metadata.heading_count") != F.size("levels")).count() == 0


def test_udf_runs_once_in_prepare(spark, small):
    raw = table(spark, small, "raw_documents").select("record_id", "content", "source", "meta").withColumn("spans", M.spans(F.col("content")))
    plan = pipelines.prepare(raw)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") <= 2 * 2  # spans and strip, each printed at most twice by AQE


def test_ingest(spark):
    text = "# T\n\n" + "word " * 80 + "\n\n## U\n\n## V\n"
    rows = [(1, "docs/a.md", text, "o/r", "mit"), (2, "docs/a.py", text, "o/r", "mit"), (3, "b.MARKDOWN", text, None, None), (4, "c.md", None, None, None)]
    df = spark.createDataFrame(rows, "id int, path string, content string, repo_name string, license string")
    got = pipelines.ingest_code(df, "id", targets={"< 4k": 1}).collect()
    assert [r["id"] for r in got] == [1] and got[0]["meta"]["is_priority_path"] and got[0]["meta"]["max_level_gap"] == 1
    wiki = spark.createDataFrame([("Title", "## a\n\n" + "w " * 200 + "\n\n## b\n", 7, ["x"])], "title string, markdown string, pageid int, categories array<string>")
    assert pipelines.ingest_wiki(wiki).first()["headings"][0]["text"] == "Title"


def test_slices_keep_empty_ones_and_infinite_error(spark):
    df = spark.createDataFrame([([1], [1, 2], 3000, 2, "goodwiki"), ([1, 2], [1, 2], None, 3, None)], "predicted_levels array<int>, ground_truth_levels array<int>, tc int, hc int, source string")
    got = {r["slice"]: r for r in evaluation.by_slice(evaluation.score(df), F.col("tc"), F.col("hc"), F.col("source")).collect()}
    assert len(got) == 12 and got["overall"]["n"] == 2 and got["source:github_code"]["n"] == 0 and got["source:github_code"]["exact_match"] is None
    assert got["source:goodwiki"]["mean_absolute_error"] == float("inf") and got["len:< 2k"]["n"] == 1 and got["headings:3-5 headings"]["n"] == 1
    assert evaluation.overall(evaluation.score(df.limit(0))).count() == 0
    assert {r["error_class"]: r["n"] for r in evaluation.error_histogram(evaluation.score(df)).collect()}["count_mismatch"] == 1


def test_json_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("é\n# x", [("x", 1)], "s", None, float("inf"))], "content string, headings array<struct<text string, level int>>, source string, meta struct<repo string>, score double")
    files.write_json(df, str(tmp_path / "deep" / "a_raw.jsonl"))
    text = "".join(p.read_text() for p in (tmp_path / "deep" / "a_raw.jsonl").glob("part-*"))
    assert "é" in text and json.loads(text)["score"] is None
    with pytest.raises(Exception):
        files.write_json(df, str(tmp_path / "deep" / "a_raw.jsonl"))
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "b_raw.jsonl").write_text(text + "\n\n")
    back = files.read_raw_json(spark, str(tmp_path / "raw")).first()
    assert back["content"] == "é\n# x" and back["headings"][0]["level"] == 1
    (tmp_path / "bad.jsonl").write_text("{broken\n")
    with pytest.raises(Exception):
        files.read_examples(spark, str(tmp_path / "bad.jsonl")).collect()


class Stub(BaseHTTPRequestHandler):
    seen: list = []

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        Stub.seen.append((self.path, self.headers.get("Authorization"), body["model"]))
        if body["model"] == "broken":
            self.send_response(500), self.end_headers()
            return
        answer = json.dumps({"choices": [{"message": {"content": "## A\n### B"}}]}).encode()
        self.send_response(200), self.end_headers()
        self.wfile.write(answer)

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def endpoint():
    server = HTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/v1"
    server.shutdown()


def test_remote_predictor_and_rehead(spark, endpoint):
    df = spark.createDataFrame([(1, DOC), (2, "no headings"), (3, None)], "id int, content string")
    got = {r["id"]: r["reheaded"] for r in predict.rehead(df, lambda: predict.RemotePredictor(endpoint, api_key="k")).collect()}
    assert got == {1: "## A\n\nintro\n\n### B\n\ntext\n", 2: "no headings", 3: None}
    assert ("/v1/chat/completions", "Bearer k", "heading-levels") in Stub.seen
    with pytest.raises(Exception):
        predict.RemotePredictor(endpoint, model="broken").predict(["A"], "# A")


def test_long_documents_go_apart(spark):
    df = spark.createDataFrame([(["a"], "x", 5), (["a", "b"], "x", 50), (["c"], "x", None)], "titles array<string>, stripped string, token_count int")
    got = predict.predict_levels(df, lambda: predict.FunctionPredictor(lambda t: [2] * len(t)), long_tokens=10).collect()
    assert sorted(len(r["predicted"]) for r in got) == [1, 1, 2]


class Chats:
    """Counts its batches; answers a level for each heading line of the document."""

    made = 0

    def __init__(self):
        Chats.made += 1
        self.sizes = []

    def __call__(self, chats, most):
        self.sizes.append(len(chats))
        assert most >= 256 and all([m["role"] for m in c] == ["system", "user"] for c in chats)
        return ["\n".join("### x" for line in c[1]["content"].split("\n") if line.startswith("# ")) for c in chats]


def test_a_model_gets_batches():
    chats = Chats()
    model = predict.ModelPredictor(chats)
    documents = [(["a"] * n, "# a\n" * n) for n in (5, 1, 9, 2, 7)]
    got = predict.answer(model, documents, [5, 1, 900, 2, 700], 2, 100, 1)
    assert got == [[3] * n for n in (5, 1, 9, 2, 7)] and chats.sizes == [2, 1, 1, 1]
    assert predict.answer(model, [], [], 2, None, 1) == []
    make = lambda: predict.ModelPredictor(Chats())
    before = Chats.made
    assert predict.once_a_worker(make) is predict.once_a_worker(make) and Chats.made == before + 1


def test_a_model_as_predictor_of_a_table(spark):
    def make():
        return predict.ModelPredictor(lambda chats, most: ["## a\n### b" for _ in chats])

    df = spark.createDataFrame([(["a", "b"], "# a\n# b", 5), (None, None, None)], "titles array<string>, stripped string, token_count int")
    assert [r["predicted"] for r in predict.predict_levels(df, make, long_tokens=3).orderBy(F.col("titles").isNull()).collect()] == [[2, 3], None]


def test_corpora_are_read_by_their_columns(spark, tmp_path):
    code = [("a/b.md", "x", "o/r", "mit", 1), ("a/b.py", "y", "o/r", None, 2), (None, "z", None, None, 3)]
    spark.createDataFrame(code, "path string, content string, repo_name string, license string, extra int").write.parquet(str(tmp_path / "code"))
    assert [tuple(r) for r in files.read_code_corpus(spark, str(tmp_path / "code")).collect()] == [("a/b.md", "x", "o/r", "mit")]
    spark.createDataFrame([("t", "# x", 5, ["c"], 1)], "title string, markdown string, pageid long, categories array<string>, extra int").write.parquet(str(tmp_path / "wiki"))
    wiki = files.read_wiki_corpus(spark, str(tmp_path / "wiki"))
    assert wiki.columns == ["title", "markdown", "pageid", "categories"] and wiki.count() == 1
    files.write_splits(spark.createDataFrame([(1, "train"), (2, "test")], "id int, split string"), str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").glob("split=*")) == ["split=test", "split=train"]
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "c_raw.jsonl").write_text('{"content": "x"}\n{broken\n')
    with pytest.raises(Exception):
        files.read_raw_json(spark, str(tmp_path / "raw")).collect()


def test_keyless_documents_share_a_split(spark):
    from headwater.operators import sampling

    rows = [(i, "" if i % 2 else f"k{i % 14}") for i in range(200)]
    out = sampling.split_by_key(spark.createDataFrame(rows, "id int, k string"), "k", train=0.5).collect()
    assert len(out) == 200 and len({r["split"] for r in out if r["k"] == ""}) == 1 and all(r["split"] for r in out)


def test_cli(tmp_path, capsys, endpoint, monkeypatch):
    source = tmp_path / "a.md"
    source.write_text(DOC)
    assert cli.main(["-i", str(source)]) == 0 and capsys.readouterr().out == "# A\n\nintro\n\n## B\n\ntext\n"
    target = tmp_path / "new" / "b.md"
    assert cli.main(["-i", str(source), "-o", str(target), "--endpoint", endpoint]) == 0 and target.read_text().startswith("## A")
    assert cli.main(["-i", str(source), "-o", str(target)]) == 1 and cli.main(["-i", str(source), "-o", str(target), "-f"]) == 0
    assert cli.main(["-i", str(tmp_path / "none.md")]) == 1 and cli.main(["-i", str(tmp_path)]) == 1
    (tmp_path / "a.txt").write_text("x")
    assert cli.main(["-i", str(tmp_path / "a.txt")]) == 1
    monkeypatch.setattr(cli.sys, "argv", ["rehead", "-i", str(source), "--api-key=x"])
    assert cli.main() == 2
    assert cli.main(["-i", str(source), "--api-key", "x"]) == 2 and cli.main(["-i", str(source), "--endpoint", endpoint, "--gpu"]) == 2


def test_streaming(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    for i in range(4):
        (inbox / f"{i}.md").write_text("# T\n\n" + "word " * 80 + "\n\n## U\n\n## V\n")
    docs = folder.stream_documents(folder.stream_texts(spark, str(inbox), 2))
    q = folder.stream_quota(docs, {"< 4k": 3}).writeStream.format("memory").queryName("quota").outputMode("append").start()
    try:
        q.processAllAvailable()
        assert spark.table("quota").count() == 3
    finally:
        q.stop()
    q = folder.level_counts(docs).writeStream.format("memory").queryName("levels").outputMode("complete").start()
    try:
        q.processAllAvailable()
        assert {r["level"]: r["n"] for r in spark.table("levels").groupBy("level").agg(F.sum("n").alias("n")).collect()} == {1: 4, 2: 8}
    finally:
        q.stop()


def test_full_evaluation_writes_results(spark, tmp_path):
    meta = "struct<source string, token_count int, heading_count int>"
    row = ([("system", "s"), ("user", "# A\n\n# B"), ("assistant", "# A\n## B\nnoise")], ("goodwiki", 10, 3))
    examples = spark.createDataFrame([row], f"messages array<struct<role string, content string>>, metadata {meta}")
    slices = pipelines.run_evaluation(examples, predict.heuristic_levels, str(tmp_path / "out"))
    assert {r["slice"] for r in slices.where("n > 0").collect()} == {"overall", "len:< 2k", "headings:3-5 headings", "source:goodwiki"}
    lines = "".join(p.read_text() for p in (tmp_path / "out" / "per_example").glob("part-*")).splitlines()
    assert json.loads(lines[0])["exact_match"] == 1.0
    metrics = [json.loads(x) for p in (tmp_path / "out" / "metrics").glob("part-*") for x in p.read_text().splitlines()]
    assert len(metrics) == 12


def test_progress_is_observed(spark):
    from pyspark.sql import Observation

    from headwater.operators import filters

    seen = Observation("seen")
    filters.progress(spark.range(10), seen).where("id > 3").collect()
    assert seen.get == {"rows": 10}


def test_whole_documents_are_reheaded_by_all_rules_of_the_heuristic(spark, tmp_path):
    from headwater.plans import catalogue

    text = "# Tool\n\na\n\n### Installation\n\nb\n\n## 1.2.3 Detail\n\nc\n\n# Other\n"
    spark.createDataFrame([(1, text), (2, None), (3, "plain")], "record_id long, content string").write.parquet(f"{tmp_path}/raw_documents.parquet")
    got = {r["record_id"]: r["reheaded"] for r in catalogue.b5_rehead_heuristic(spark, str(tmp_path)).collect()}
    assert got == {1: "# Tool\n\na\n\n# Installation\n\nb\n\n### 1.2.3 Detail\n\nc\n\n## Other\n", 3: "plain"}


def test_structural_queries_read_the_real_texts(spark, tmp_path):
    """Setext, CRLF and nested headings and no stored ones; a section above 256 pieces is shortened."""
    from headwater.plans import catalogue

    text = "Top\r\n===\r\n\r\n> ### Nested\r\n\r\n" + "word " * 300 + "\r\n\r\n## Last\r\n"
    schema = "record_id long, content string, source string, headings array<struct<text:string,level:int>>, meta struct<repo:string,title:string,max_level_gap:int>"
    spark.createDataFrame([(1, text, "s", None, None), (2, None, "s", [("x", 1)], None)], schema).write.parquet(f"{tmp_path}/raw_documents.parquet")
    run = lambda name: catalogue.QUERIES[name](spark, str(tmp_path)).collect()
    assert sorted((r["record_id"], r["pos"], r["level"], r["text"]) for r in run("m1_extract_full")) == [(1, 1, 1, "Top"), (1, 2, 3, "Nested"), (1, 3, 2, "Last")]
    (stripped,) = run("m3_strip_piece_full")
    assert "[...]" in stripped["stripped"] and stripped["stripped"].count("word") >= 200
    assert [r["record_id"] for r in run("f1_cheap_filter_full")] == [1]
