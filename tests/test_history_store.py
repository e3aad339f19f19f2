"""The incremental store against whole recomputation, and what each batch touches."""

import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from codesieve.operators import history
from codesieve.sources.history_store import VERSION_COLUMNS, HistoryStore


def versions(spark, rng, sessions, count, first=0):
    start = datetime(2024, 1, 1)
    rows = [
        (s, first + n, start + timedelta(hours=rng.randint(0, 200)), f"f{n % 3}", f"t{first + n}", rng.random() < 0.5, rng.random() < 0.1, n)
        for n, s in ((n, rng.choice(sessions)) for n in range(count))
    ]
    return spark.createDataFrame(rows, VERSION_COLUMNS)


def written(folder):
    """Names of the data files by bucket; a rewritten bucket has other ones."""
    return {p.name: sorted(f.name for f in p.glob("*.parquet")) for t in ("versions", "state") for p in Path(folder, t).glob("bucket=*")}


def same(a, b):
    return sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


@pytest.fixture
def filled(spark, tmp_path):
    rng = random.Random(5)
    sessions = spark.createDataFrame([(s, f"o{s}") for s in range(200)], "session_id long, original_code string")
    batches = [versions(spark, rng, range(200), 1500, 1500 * k) for k in range(3)]
    store = HistoryStore(spark, str(tmp_path / "history"), buckets=50, keep=12)
    store.create(sessions)
    for b in (batches[1], batches[0], batches[2]):
        store.record(b)
    return store, sessions, batches[0].union(batches[1]).union(batches[2])


def test_equals_whole_recomputation(filled):
    store, sessions, every = filled
    columns = [c.split()[0] for c in VERSION_COLUMNS.split(", ")]
    assert same(store.versions().select(*columns), history.retained(every, 12).select(*columns))
    order = ["session_id", "current_code", "changed"]
    assert same(store.current().select(*order), history.current_code(every, sessions).select(*order))


def test_a_batch_rewrites_its_own_buckets_only(spark, filled):
    store, sessions, every = filled
    before = written(store.folder)
    small = versions(spark, random.Random(9), [3, 77], 20, 10_000)
    touched = store.record(small)
    after = written(store.folder)
    assert 1 <= len(touched) <= 2 and len(before) > 40
    assert {b for b in before if before[b] != after[b]} == {f"bucket={b}" for b in touched}
    order = ["session_id", "current_code", "changed"]
    assert same(store.current().select(*order), history.current_code(every.union(small), sessions).select(*order))


def test_a_repeated_batch_changes_nothing(spark, filled):
    store, _, every = filled
    rows, state = store.versions().collect(), store.state().collect()
    store.record(every.where("version_id % 7 = 0"))
    assert sorted(map(tuple, rows)) == sorted(map(tuple, store.versions().collect()))
    assert sorted(map(tuple, state)) == sorted(map(tuple, store.state().collect()))
    assert store.record(every.limit(0)) == [] and store.delete(every.limit(0)) == []


def test_delete_empties_buckets(spark, filled):
    store, _, every = filled
    bucket = store.bucket()
    gone = every.select("session_id").distinct().where(bucket == store.touched(every.where("session_id = 3"))[0])
    ids = {r[0] for r in gone.collect()}
    touched = store.delete(gone)
    assert len(touched) == 1
    assert {r[0] for r in store.versions().select("session_id").distinct().collect()} == set(range(200)) - ids
    assert {r[0] for r in store.state().select("session_id").collect()} == set(range(200)) - ids


def test_upsert_replaces_by_function(spark, filled):
    store, _, every = filled
    new = versions(spark, random.Random(2), [5], 1, 20_000).withColumn("function_name", F.lit("f1"))
    old = store.versions().where("session_id = 5 AND function_name <> 'f1'").select("function_name").distinct().count()
    store.upsert(new)
    rows = store.versions().where("session_id = 5").collect()
    assert len(rows) == old + 1 and [r.version_id for r in rows if r.function_name == "f1"] == [20_000]
