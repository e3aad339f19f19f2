"""Nearest neighbours against brute force: recall, exact scores, odd vectors."""

import math

import numpy as np
import pytest

from codesieve.llm import nearest

SCHEMA = "vec_id long, embedding array<float>, label int, cell string, id string, mark string, share string, dims string"


def table(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    rows = [(i, None if v is None else [x if x is None else float(x) for x in v], 0, *"abcde") for i, v in zip(ids, vectors)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def brute(ids, vectors, every=50, k=5):
    """{query: [(score, id)...]} over vectors that are all of one length and fit."""
    x = np.array(vectors, np.float64)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    out = {}
    for q in (i for i, v in enumerate(ids) if v % every == 0):
        s = unit @ unit[q]
        out[ids[q]] = sorted((-s[j], ids[j]) for j in range(len(ids)) if ids[j] != ids[q])[:k]
    return out


def got_of(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(rows) for q, rows in out.items()}


def recall(got, want):
    hits = sum(len({i for _, i, _ in got[q]} & {i for _, i in rows}) for q, rows in want.items())
    return hits / sum(map(len, want.values()))


@pytest.mark.parametrize("kind", ["spread", "clusters", "copies"])
def test_recall_and_exact_scores(spark, kind, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((6000, 64))
    if kind == "clusters":
        x = rng.standard_normal((40, 64))[rng.integers(0, 40, 6000)] + 0.2 * x
    if kind == "copies":
        x[rng.integers(0, 6000, 2500)] = x[7] + 0.01 * rng.standard_normal((2500, 64))
        x[100:900] = x[11]
    x = x.astype(np.float32)
    monkeypatch.setattr(nearest, "LEAST_ROWS", 1500)
    monkeypatch.setattr(nearest, "QUERY_ROWS", 50)
    got, want = got_of(nearest.nearest_of_stated(table(spark, x))), brute(range(6000), x)
    assert set(got) == set(want) and all([r for r, _, _ in rows] == [1, 2, 3, 4, 5] for rows in got.values())
    for rows in got.values():
        assert [(-s, i) for _, i, s in rows] == sorted((-s, i) for _, i, s in rows)
    if kind != "copies":
        assert recall(got, want) >= 0.95
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    near = sum(abs(a[2] + b[0]) < 1e-9 for q, rows in want.items() for a, b in zip(got[q], rows))
    assert near >= 0.9 * 5 * len(want)
    assert all(abs(unit[q] @ unit[i] - s) < 1e-12 for q, rows in got.items() for _, i, s in rows)


def test_given_table(spark, sf_dir):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want = brute([i for i, _ in rows], [v for _, v in rows])
    assert recall(got_of(nearest.nearest_of_stated(df)), want) >= 0.95


def test_odd_vectors(spark):
    inf, nan = math.inf, math.nan
    vectors = [[1, 0, 0], [1, 1, 0], [0, 0, 0], [nan, 1, 1], [1, inf, 0], [1, None, 0], None, [], [1, 0], [-1, 0, 0], [2, 0, 0], [2, 0, 0], [3, 1, 1]]
    ids = [0, 50, 100, 150, 200, 250, 300, 350, 400, 5, 7, 6, None]
    got = got_of(nearest.nearest_of_stated(table(spark, vectors, ids)))
    assert {q: [i for _, i, _ in rows] for q, rows in got.items()} == {0: [6, 7, 50, 5], 50: [0, 6, 7, 5]}
    assert [s for _, _, s in got[0]] == [1, 1, pytest.approx(math.sqrt(0.5), abs=1e-15), -1]


def test_scale_and_repeated_rows(spark):
    schema = "vec_id long, embedding array<double>"
    rows = [(0, [1e200, 1e200]), (0, [1e200, 1e200]), (1, [1e-200, 1e-200]), (2, [-1e300, 1e300]), (3, [5e-324, 0.0]), (3, [5e-324, 0.0])]
    got = got_of(nearest.nearest_of_stated(spark.createDataFrame(rows, schema)))
    assert [i for _, i, _ in got[0]] == [1, 3, 3, 2] and got[0][0][2] == pytest.approx(1, abs=1e-15)


def test_two_vectors_of_one_query_id(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.1]), (2, [0.1, 1.0])]
    got = got_of(nearest.nearest_of_stated(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    assert sorted(i for r, i, _ in got[0] if r == 1) == [1, 2] and len(got[0]) == 4


def test_empty_tables(spark):
    df = table(spark, [[1, 2, 3]], [1])
    assert nearest.nearest_of_stated(df.limit(0)).count() == 0 and nearest.nearest_of_stated(df).count() == 0


def test_most_vectors_are_pruned():
    rng = np.random.default_rng(2)
    make = lambda n, at: nearest.Vectors(np.arange(at, at + n), np.zeros(n, np.int64), rng.standard_normal((n, 64)))
    search = nearest.Search(make(40, 10**6), 5)
    for k in range(4):
        search.block(make(8000, 8000 * k))
    assert search.verified < 0.25 * 40 * 32_000
