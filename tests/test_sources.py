import json

from pyspark.sql import functions as F

from codesieve.operators import stubs
from codesieve.sources import files, responses
from codesieve.streaming import streams


def test_whole_files_batch_equals_stream(spark, tmp_path):
    folder = tmp_path / "in" / "repo1"
    folder.mkdir(parents=True)
    (folder / "a.py").write_bytes(b"def a():\r\n    pass\r")
    (folder / "b.py").write_text("eval(1)")
    (folder / "c.py").write_text("")
    path = str(folder)
    batch = files.read_source_files(spark, path)
    assert {r.path.rsplit("/", 1)[1]: r.code for r in batch.collect()} == {"a.py": "def a():\n    pass\n", "b.py": "eval(1)\n"}  # Spark's reader passes over files without a byte
    assert files.without_empty(batch).count() == 2
    blank = spark.createDataFrame([(1, ""), (2, " "), (3, None), (4, "x"), (5, " \n\t\r\n")], "file_id long, code string")
    assert [r.file_id for r in files.normalised(blank).collect()] == [4]
    streamed = streams.drain(streams.scan_stream(files.stream_source_files(spark, path)), str(tmp_path / "out"))
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, streams.scan_stream(batch).collect()))
    files.write_rewritten(batch, str(tmp_path / "fixed"))
    assert {r.out_name for r in spark.read.parquet(str(tmp_path / "fixed")).collect()} == {"fixed_a.py", "fixed_b.py"}


def raw(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "file_id long, raw string")


def test_model_fixes(spark):
    fix = {"function_name": "f", "before": "a", "after": "b", "reason": "r", "start_line": 1, "end_line": 2}
    part = {"functionCall": {"name": "submit_fixes", "args": {"fixes": [fix, {}]}}}
    text = json.dumps({"fixes": [{"after": "z"}]})
    body = lambda *parts: json.dumps({"candidates": [{"content": {"parts": list(parts)}}]})
    df = raw(spark, body(part), body({"text": "```json\n" + text[:9]}, {"text": text[9:] + "\n```"}), body({"text": "no"}), "bad", '{"candidates":[]}', None)
    rows = responses.model_fixes(df).orderBy("file_id", "fix_no").collect()
    assert [tuple(r) for r in rows] == [
        (0, 0, "f", "a", "b", "r", 1, 2), (0, 1, "unknown", "", "", "", -1, -1), (1, 0, "unknown", "", "z", "", -1, -1),
    ]


def test_text_proposals(spark):
    good = "FUNCTION: f\nBEFORE:\n```\nold\n```\nAFTER:\n```py\nnew\n```\nREASON: why\n"
    open_fence = "FUNCTION: g\nAFTER:\n```\nx = 1"
    df = raw(spark, good + "---\n" + open_fence, "nothing", "FUNCTION: h\nAFTER:\n```\neval((\n```\n")
    rows = responses.text_proposals(df).orderBy("file_id", "section").collect()
    assert [tuple(r) for r in rows] == [(0, 0, "f", "old", "new", "why"), (0, 1, "g", "", "x = 1", ""), (2, 0, "h", "", "eval((", "")]
    kept = responses.guarded_proposals(df).orderBy("file_id", "section").collect()
    assert [(r.file_id, r.function_name, r.raw_view) for r in kept] == [(0, "f", False), (0, "g", False), (1, "", True), (2, "", True)]


def test_prompts(spark):
    df = spark.createDataFrame(
        [(1, "r", "r/a.py", "def a():\n    pass\n"), (2, "r", "r/b.py", "x = 1\n"), (3, "s", "s/c.py", "y\n")], "file_id long, repo string, path string, code string"
    )
    found = stubs.candidates(df)
    pairs = spark.createDataFrame([(1, 2), (1, 2), (1, 1), (1, 3), (3, 9)], "file_id long, related_id long")
    related = responses.related_files(df, pairs)
    assert sorted((r.file_id, r.related_path) for r in related.collect()) == [(1, "r/b.py"), (1, "s/c.py")]
    made = responses.prompts(df, found, related)
    row = made.first()
    assert made.count() == 1 and "Candidate #1" in row.prompt and "Related file: r/b.py" in row.prompt
    for size in (1, 40, 300, 1 << 20):
        parts = sorted(responses.prompt_parts(df, found, related, size).collect())
        assert "".join(r.text for r in parts) == row.prompt and all(r.file_id == 1 for r in parts)
        assert len(parts) == {1: 5, 1 << 20: 1}.get(size, len(parts))
    body = json.loads(responses.request_bodies(made).first().body)
    assert body["contents"][0]["parts"][0]["text"] == row.prompt and body["generationConfig"]["maxOutputTokens"] == 8000
    assert list(body) == ["contents", "systemInstruction", "tools", "toolConfig", "generationConfig"]
    declared = body["tools"][0]["functionDeclarations"][0]
    assert body["toolConfig"]["functionCallingConfig"] == {"mode": "ANY", "allowedFunctionNames": [declared["name"]]}
    fix = declared["parameters"]["properties"]["fixes"]["items"]
    assert fix["required"] == ["function_name", "before", "after", "reason", "start_line", "end_line"] == list(fix["properties"])
    assert fix["properties"]["start_line"] == {"type": "INTEGER"} and declared["parameters"]["required"] == ["fixes"]
    assert "submit_fixes" in body["systemInstruction"]["parts"][0]["text"]


def test_related_files_of_a_folder_are_all_there(spark, tmp_path):
    """No file of a repo is lost, whatever its id; equal to a plain self-join."""
    folder = tmp_path / "repo"
    folder.mkdir()
    for k in range(30):
        (folder / f"f{k}.py").write_text(f"x = {k}\n")
    df = files.read_source_files(spark, str(folder))
    ids = df.select("repo", "file_id")
    pairs = ids.join(ids.withColumnRenamed("file_id", "related_id"), "repo").drop("repo")
    rows = responses.related_files(df, pairs)
    assert rows.count() == 30 * 29
    assert {r["count"] for r in rows.groupBy("file_id").count().collect()} == {29}


def test_decision_windows_are_counted_in_the_stream(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    folder = str(tmp_path / "events.parquet")
    events.union(events.limit(10)).coalesce(1).write.parquet(folder)
    stream = streams.decision_windows(streams.decisions(spark, folder))
    assert stream.isStreaming
    rows = streams.drain(stream, str(tmp_path / "out"))
    day = F.date_trunc("day", F.col("ts").cast("timestamp"))
    plain = events.groupBy(day.cast("string").alias("window_start")).agg(F.count("*").alias("n")).collect()
    got = {r.window_start: r.approved + r.rejected for r in rows.collect()}
    last = max(r.window_start for r in plain)
    assert got == {r.window_start: r.n for r in plain if r.window_start in got} and {r.window_start for r in plain} - set(got) <= {last}
