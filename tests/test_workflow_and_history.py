from datetime import datetime

from pyspark.sql import functions as F

from codesieve.operators import history, workflow


def files(spark, *codes):
    return spark.createDataFrame([(i, "r", f"f{i}.py", c) for i, c in enumerate(codes)], "file_id long, repo string, path string, code string")


def test_gates(spark):
    stub = "def is_ok(x):\n    pass\n"
    df = files(spark, stub, "steal_password()\n" + stub, "setuid\n" + stub, "steal_password()\nsetuid\n" + stub)
    rows = workflow.workflow_items(df).orderBy("file_id").collect()
    assert [(r.stage, r.label, r.progress) for r in rows] == [
        ("AWAITING_APPROVAL", "waiting for approval", 90), ("BLOCKED", "blocked by content", 100), ("BLOCKED", "policy violation", 100),
        ("BLOCKED", "blocked by content", 100),
    ]
    assert rows[0].suggestion == "    return x is not None and bool(x)" and rows[1].suggestion is None
    assert "is_ok()" in rows[0].explanation


def at(n):
    return datetime(2024, 1, 1, 0, 0, n)


SCHEMA = "session_id long, version_id long, ts timestamp, function_name string, after string, approved boolean, is_restore boolean, safety_score long"


def test_history(spark):
    rows = [
        (1, 1, at(1), "f", "a", True, False, 50), (1, 2, at(2), "f", "b", False, False, 60), (1, 3, at(3), "g", "", False, True, 0),
        (1, 4, at(4), "f", "d", False, False, 70), (2, 5, at(5), "f", "e", True, False, 80), (2, 6, at(6), "", "", False, True, 0),
        (2, 7, at(7), "h", "g", True, False, 90),
    ]
    v = spark.createDataFrame(rows, SCHEMA)
    s = spark.createDataFrame([(1, "o1"), (2, "o2"), (3, "o3")], "session_id long, original_code string")
    assert {r.session_id: (r.current_code, r.changed) for r in history.current_code(v, s).collect()} == {1: ("o1", False), 2: ("g", True), 3: ("o3", False)}
    each = history.code_after_each(v, s).orderBy("version_id").collect()
    assert [r.current_code for r in each] == ["a", "a", "o1", "o1", "e", "o2", "g"]
    assert {r.session_id: (r.approved, r.rejected) for r in history.counts(v).collect()} == {1: (1, 2), 2: (2, 0)}
    counters = workflow.review_counters(v).where("session_id = 1").orderBy("position").collect()
    assert [(r.approved_so_far, r.rejected_so_far) for r in counters] == [(1, 0), (1, 1), (1, 2), (1, 3)]
    assert history.delete(v, s.where("session_id = 1")).count() == 3
    up = history.upsert(v.where("session_id = 1"), v.where("session_id = 2").withColumn("session_id", F.lit(1)))
    assert {r.function_name: r.version_id for r in up.collect()} == {"f": 5, "g": 3, "": 6, "h": 7}
    back = history.decode(history.encode(v)).orderBy("version_id").collect()
    assert [(r.session_id, r.version_id, r.after, r.approved) for r in back] == [(x[0], x[1], x[4], x[5]) for x in rows]
    bad = spark.createDataFrame([("no json",), (None,)], "document string")
    assert history.decode(bad).count() == 0


def test_retention(spark):
    rows = [(s, n, at(n % 60), "f", "x", True, False, 1) for s, k in ((1, 0), (2, 50), (3, 51)) for n in range(k)]
    v = spark.createDataFrame(rows, SCHEMA)
    assert {r.session_id: r["count"] for r in history.retained(v).groupBy("session_id").count().collect()} == {2: 50, 3: 50}
    many = spark.createDataFrame([(s, s, at(s), "f", "x", True, False, 1) for s in range(21)], SCHEMA)
    kept = [r.session_id for r in history.newest_sessions(many).collect()]
    assert kept == list(range(20, 0, -1))


def test_replay_takes_the_last_decision(spark):
    items = spark.createDataFrame([(1, "f"), (1, "g")], "file_id long, function_name string")
    decided = spark.createDataFrame(
        [(1, "f", True, at(1), 1), (1, "f", False, at(1), 2)], "file_id long, function_name string, approved boolean, ts timestamp, seq int"
    )
    assert [tuple(r) for r in workflow.replay(decided, items).collect()] == [(1, "f", False)]


def test_create_record_and_apply(spark):
    df = files(spark, "def is_ok(x):\n    pass\n", "def is_ok(x):\n    pass\n")
    made = history.create_sessions(df, F.lit(at(0))).orderBy("session_id").collect()
    assert [(r.session_id, r.file_name, r.original_code == r.current_code) for r in made] == [(0, "f0.py", True), (1, "f1.py", True)]
    rows = [(1, n, at(n), "f", "x", True, False, 1) for n in range(4)]
    v = spark.createDataFrame(rows, SCHEMA)
    assert [r.version_id for r in history.record(v.where("version_id < 2"), v.where("version_id >= 2"), keep=3).orderBy("version_id").collect()] == [1, 2, 3]
    decided = spark.createDataFrame(
        [(0, "is_ok", False, at(1), 1), (0, "is_ok", True, at(2), 2), (1, "is_ok", False, at(3), 3)],
        "file_id long, function_name string, approved boolean, ts timestamp, seq int",
    )
    out = workflow.apply_decisions(df, decided).collect()
    assert [(r.file_id, r.new_code, r.n_applied) for r in out] == [(0, "def is_ok(x):\n    return x is not None and bool(x)\n", 1)]


def test_running_counts_and_texts_carry_over_days(spark):
    """A session of several days against a plain walk over its events."""
    import random

    rng = random.Random(4)
    for seed in range(3):
        rows = []
        for n in range(60):
            ts = datetime(2024, 1, 1 + n // 9 * 2, n % 24)
            rows.append((seed, n, ts, "f", f"t{n}", rng.random() < 0.4, rng.random() < 0.15, 1))
        v = spark.createDataFrame(rows, SCHEMA).repartition(3)
        s = spark.createDataFrame([(seed, "o")], "session_id long, original_code string")
        each = {r.version_id: (r.epoch, r.current_code) for r in history.code_after_each(v, s).collect()}
        counters = {r.version_id: (r.position, r.approved_so_far, r.rejected_so_far) for r in workflow.review_counters(v).collect()}
        epoch, text, good = 0, "o", 0
        for k, (_, n, _, _, after, approved, restore, _) in enumerate(sorted(rows, key=lambda r: (r[2], r[1])), 1):
            epoch, text = (epoch + 1, "o") if restore else (epoch, after if approved else text)
            good += approved
            assert each[n] == (epoch, text) and counters[n] == (k, good, k - good)
