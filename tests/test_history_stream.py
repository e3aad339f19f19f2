"""Keyed state of sessions over several micro-batches against the table operator."""

import json
import random
from collections import Counter
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from codesieve.operators import history
from codesieve.plans import oracles, queries
from codesieve.streaming import history_stream, streams

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string"


def test_micro_batches_equal_the_table_operator(spark, tmp_path):
    rng = random.Random(8)
    start = datetime(2024, 3, 1)
    events = []
    for n in range(400):
        at = start + timedelta(minutes=10 * n + rng.randint(-20, 20))
        events.append((n, at, rng.choice([1, 1, 1, 2, 3]), rng.choice(["purchase", "click", "view", "view", "error"])))
    folder = str(tmp_path / "events")
    for k in range(0, 400, 100):  # four files, one micro-batch each
        rows = events[k : k + 100]
        rng.shuffle(rows)
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    sessions = spark.createDataFrame([(s, f"o{s}") for s in (1, 2, 3)], "session_id long, original_code string")
    stream = history_stream.code_after_each(history_stream.versions(spark, folder, 1), "1 hour")
    got = {tuple(r) for r in history_stream.drained(stream, str(tmp_path / "out"), sessions).collect()}
    table = spark.createDataFrame(
        [(u, i, t, "f", f"code {i}", e in ("purchase", "click"), e == "error", 1) for i, t, u, e in events],
        "session_id long, version_id long, ts timestamp, function_name string, after string, approved boolean, is_restore boolean, safety_score int",
    )
    last = max(t for _, t, _, _ in events) - timedelta(hours=1)
    passed = {i for i, t, _, _ in events if t <= last}
    want = {tuple(r) for r in history.code_after_each(table, sessions).collect() if r.version_id in passed}
    assert got == want and len(want) > 350


def test_applied_in_order():
    events = [(3, 9, "c", True, False), (1, 5, "a", True, False), (2, 7, "x", False, True), (1, 6, "b", False, False)]
    assert history_stream.applied(0, None, events) == (1, "c", [(1, 5, 0, "a"), (1, 6, 0, "a"), (2, 7, 1, None), (3, 9, 1, "c")])


def test_sessions_share_timers_and_state_calls(spark, tmp_path):
    """What is called once for each key must not grow with the sessions."""
    start = datetime(2024, 3, 1)
    rows = [(n, start + timedelta(seconds=n), n % 1500, ("click", "view", "error")[n % 7 % 3]) for n in range(6000)]
    rows.append((6000, start + timedelta(days=1), 0, "view"))
    folder = str(tmp_path / "events")
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(folder)
    stream = history_stream.code_after_each(history_stream.versions(spark, folder))
    before = spark.conf.get(history_stream._PROVIDER)
    spark.conf.set(history_stream._PROVIDER, history_stream._ROCKS)
    try:
        out = str(tmp_path / "out")
        query = (
            stream.writeStream.format("parquet").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start(f"{out}/rows")
        )
        query.awaitTermination()
    finally:
        spark.conf.set(history_stream._PROVIDER, before)
    operators = [json.loads(p.json)["stateOperators"][0] for p in query.recentProgress]
    assert 0 < operators[0]["customMetrics"]["numRegisteredTimers"] <= 1024
    got = {(r.session_id, r.version_id, r.epoch, r.approved_code) for r in spark.read.parquet(f"{out}/rows").collect()}
    want = set()
    for s in range(1500):
        of_session = [(t, i, f"code {i}", e == "click", e == "error") for i, t, u, e in rows[:-1] if u == s]
        want |= {(s, i, epoch, text) for _, i, epoch, text in history_stream.applied(0, None, of_session)[2]}
    assert got == want and len(want) == 6000


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_odd_events_equal_sql(spark, tmp_path, zone):
    """No id, time, session or kind; equal times; an event right at the watermark; other zones."""
    con = duckdb.connect()
    con.execute(
        """CREATE TABLE events AS SELECT * FROM (VALUES
        (1, TIMESTAMP '2024-06-01 10:00:00', 1, 'click'), (2, TIMESTAMP '2024-06-01 10:05:00.0009', 1, NULL),
        (NULL, TIMESTAMP '2024-06-01 10:05:00.0009', 1, 'purchase'), (9007199254740993, TIMESTAMP '2024-06-01 10:05:00.0009', 1, 'signup'),
        (4, TIMESTAMP '2024-06-01 10:07:00', 1, 'error'), (5, TIMESTAMP '2024-06-01 10:07:00', 1, 'view'), (6, NULL, 1, 'error'),
        (7, TIMESTAMP '2024-06-01 10:08:00', NULL, 'click'), (8, TIMESTAMP '2024-06-01 12:00:00', 2, 'click'),
        (9, TIMESTAMP '2024-06-01 12:00:00.000001', 2, 'click'), (10, TIMESTAMP '2024-06-01 11:59:00', 2, 'view'),
        (11, TIMESTAMP '2024-06-01 12:00:00', 3, 'click'), (12, TIMESTAMP '2024-06-01 13:00:00', 4, 'view')
        ) t(event_id, ts, user_id, event_type)"""
    )
    con.execute(f"COPY (SELECT event_id::BIGINT AS event_id, ts, user_id::BIGINT AS user_id, event_type FROM events) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    want = Counter(con.execute(oracles.oracle_sql()["stream_history"]).fetchall())
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = queries.queries()["stream_history"](spark, str(tmp_path))
        got = Counter(tuple(r) for r in df.select("session_id", "version_id", "epoch", "current_code").collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == want and sum(want.values()) == 9
