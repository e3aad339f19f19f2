"""Exact, near and substring deduplication against brute force."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from codesieve.llm import components, exact_dedup, simhash, substring_dedup


def test_exact_against_brute_force(docs, rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    expected = Counter()
    for r in rows:
        ids = [i for i in groups[r[1] or ""] if i is not None]
        keep = max(ids) if ids else None
        expected[r[0], keep, len(groups[r[1] or ""]), r[0] == keep, hashlib.sha256((r[1] or "").encode()).hexdigest()] += 1
    bare = Counter()
    for (i, keep, n, kept, digest), times in expected.items():
        bare[i, keep, n, kept, digest if n > 1 else None] += times
    for limit in (200_000, 0):  # broadcast and shuffled groups
        for words in (exact_dedup.FILTER_WORDS, 1, 0):  # a wide bit table, a narrow one, none
            got = exact_dedup.exact_dedup(docs, digest_all=True, small_rows=limit, filter_words=words).collect()
            assert Counter(map(tuple, got)) == expected
            got = exact_dedup.exact_dedup(docs, small_rows=limit, filter_words=words).collect()
            assert Counter(map(tuple, got)) == bare


def test_tables_stay_sparse(spark):
    """The table follows the number of repeated keys, so few others pass it."""
    from pyspark.sql import functions as F

    for n in (0, 1, 8, 9, 5_000):
        keys = spark.range(4 * n).select(F.xxhash64(F.when(F.col("id") < 2 * n, F.col("id") % F.lit(max(n, 1))).otherwise(F.col("id"))).alias("key"))
        again, words = exact_dedup._repeated(keys)
        assert again.count() == n and words & (words - 1) == 0 and max(8 * n, 64) <= 64 * words <= max(16 * n, 64)
        passed = exact_dedup._among(keys, F.col("key"), exact_dedup._table(again, words), words).where("again").count()
        assert 2 * n <= passed <= 2 * n + 2 * n / exact_dedup.SPARSE * 1.3 + 3


def test_exact_is_native_and_drops_rows(docs, no_docs, rows):
    plan = exact_dedup.exact_dedup(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    assert len({r.text or "" for r in kept.collect()}) == len({r[1] or "" for r in rows})
    assert exact_dedup.exact_dedup(no_docs).count() == exact_dedup.drop_exact_duplicates(no_docs).count() == 0


def test_drops_are_decided_row_by_row(spark):
    """Null ids, ids with two texts and rows that repeat id and text."""
    far = [" ".join(f"{name}{k}" for k in range(60)) for name in ("ab", "cd", "ef", "gh", "ij")]
    data = [
        (1, far[0]), (None, far[0]), (None, far[1]),  # a null-id copy, a null-id row of its own
        (2, far[2]), (3, far[2]), (2, far[3]),  # id 2 has a copy and a text of its own
        (5, far[4]), (5, far[4]), (None, "one two"), (None, "one two"), (9, None), (4, ""),
    ]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    exact = [(r.doc_id, r.text or "") for r in exact_dedup.drop_exact_duplicates(df).collect()]
    assert Counter(exact) == Counter([(1, far[0]), (None, far[1]), (3, far[2]), (2, far[3]), (5, far[4]), (None, "one two"), (9, "")])
    near = [(r.doc_id, r.text or "") for r in simhash.drop_near_duplicates(df).collect()]
    assert Counter(near) == Counter([(1, far[0]), (None, far[1]), (2, far[2]), (2, far[3]), (5, far[4]), (None, "one two"), (4, "")])


def brute_fingerprint(text, n=4):
    words = [w.lower() for w in (text or "").encode().split()]
    if not words:
        return 0
    grams = [words[k : k + n] for k in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(b" ".join(g), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(pairs, members):
    root = {m: m for m in members}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    out = defaultdict(set)
    for m in members:
        out[find(m)].add(m)
    return out.values()


def test_simhash_against_brute_force(docs, rows, no_docs):
    fps = [brute_fingerprint(r[1]) for r in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 4]
    expected = Counter()
    for group in classes(pairs, range(len(rows))):
        ids = [rows[k][0] for k in group if rows[k][0] is not None]
        for k in group:
            expected[rows[k][0], f"{fps[k]:016x}", min(ids) if ids else None] += 1
    assert Counter(map(tuple, simhash.near_duplicates(docs).collect())) == expected
    assert simhash.near_duplicates(no_docs).count() == 0
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() < len(rows)


@pytest.mark.parametrize("n, spread", [(1, 0), (40, 3), (700, 3), (3000, 64)])
def test_links_connect_what_brute_force_connects(spark, n, spread):
    """Dense groups are split into nodes and tasks; no connection may be lost."""
    rng = np.random.default_rng(n)
    base = rng.integers(0, 1 << 63, 1 + n // 300, dtype=np.uint64)
    fps = {int(x) for x in base}
    while len(fps) < n:
        x = int(rng.choice(base)) if spread < 64 else int(rng.integers(0, 1 << 63))
        for _ in range(min(spread, 5)):
            x ^= 1 << int(rng.integers(0, 64))
        fps.add(x)
    values = np.array(sorted(fps), np.uint64)
    df = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    edges = [(r.a, r.b) for r in simhash.links(df).collect()]
    signed = values.view(np.int64).tolist()
    close = []
    for i, v in enumerate(values):
        close += [(signed[i], signed[i + 1 + j]) for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ v) <= 4)]
    assert {frozenset(g) for g in classes(edges, signed)} == {frozenset(g) for g in classes(close, signed)}
    assert len(edges) <= 40 * n


def test_close_pairs_equal_all_pairs():
    rng = np.random.default_rng(3)
    a = np.sort(rng.integers(0, 1 << 12, 300, dtype=np.uint64))
    b = np.sort(rng.integers(0, 1 << 12, 77, dtype=np.uint64))
    for right in (None, b):
        i, j = simhash.close_pairs(a, right, 2)
        other = a if right is None else right
        near = np.bitwise_count(a[:, None] ^ other[None, :]) <= 2
        if right is None:
            near &= np.arange(300)[:, None] < np.arange(300)[None, :]
        assert set(zip(i.tolist(), j.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(near))))


def test_gray_neighbours_differ_in_one_bit(spark):
    from pyspark.sql import functions as F

    df = spark.range(64).select(F.col("id").alias("fp")).select("fp", simhash.gray_rank(F.col("fp")).alias("rank")).orderBy("rank")
    fps = [r.fp for r in df.collect()]
    assert all(bin(x ^ y).count("1") == 1 for x, y in zip(fps, fps[1:]))


def test_components_of_a_path_a_star_and_nothing(spark):
    path = [(k, k + 1) for k in range(100, 160)]
    star = [(7, k) for k in range(200, 400)] + [(500, 500), (7, 200)]
    df = spark.createDataFrame(path + star, "a long, b long")
    got = {r.node: r.root for r in components.connected_components(df).collect()}
    assert got == {**{k: 100 for k in range(100, 161)}, 7: 7, **{k: 7 for k in range(200, 400)}}
    assert components.connected_components(df.limit(0)).count() == 0


def brute_removal(texts, window):
    seen = Counter()
    words = [(t or "").encode().split() for t in texts]
    for w in words:
        seen.update(tuple(w[k : k + window]) for k in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("window", [35, 7, 1])
def test_substring_against_brute_force(docs, rows, window):
    expected = Counter((r[0], *x) for r, x in zip(rows, brute_removal([r[1] for r in rows], window)))
    assert Counter(map(tuple, substring_dedup.substring_dedup(docs, window=window).collect())) == expected


def test_substring_merges_in_small_batches(docs, rows, no_docs, monkeypatch):
    assert substring_dedup.substring_dedup(no_docs).count() == 0
    assert substring_dedup.levels_of(35) == [9, 18, 35] and substring_dedup.levels_of(1) == [1]
    out = substring_dedup.substring_dedup(docs, with_text=True).where("doc_id = 0").first()
    assert out.kept_text == "" and out.n_removed == out.n_words


@pytest.mark.parametrize("small_rows", [0, 200_000])
def test_ids_that_look_like_digests_join_no_group(spark, small_rows):
    digest = hashlib.sha256(b"twice").hexdigest()
    df = spark.createDataFrame([(digest, "once"), ("x", "twice"), ("y", "twice"), (None, "null id"), (None, "other null id")], "doc_id string, text string")
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(df, small_rows=small_rows).collect()}
    assert got == {(digest, digest, 1, True), ("x", "y", 2, False), ("y", "y", 2, True), (None, None, 1, True)}


def test_windows_of_one_first_hash_differ_by_the_second():
    merger = substring_dedup._Merger()
    for th, second in ((1, [5, 6, 7]), (2, [6, 8])):
        n = len(second)
        merger.add((th, th), 1, (np.zeros(n, np.uint64), np.array(second, np.uint64)), np.arange(n))
    out = [r for frame in merger.flush() for r in frame.itertuples()]
    assert {(r.th1, r.place): r.weight for r in out} == {(1, 0): 1, (1, 1): 2, (1, 2): 1, (2, 0): 2, (2, 1): 1}
    assert len({(r.h, r.h2) for r in out}) == 5 and sum(r.h == 0 for r in out) == 4


def test_lists_of_every_choice_have_groups(spark):
    """Upper nodes must divide a hot list whichever blocks it shares."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(3)
    layout = simhash._choices(4, simhash.BLOCKS)
    assert len(layout) == 15
    rows = []
    for c, (mask, _) in enumerate(layout):  # one hot list of each choice
        fps = (rng.integers(0, 1 << 63, 20_000, np.uint64) * np.uint64(2)) & ~np.uint64(mask)
        rows.append((c, fps.view(np.int64)))
    for c, fps in rows:
        df = spark.createDataFrame([(int(f),) for f in fps], "fp long")
        packed = df.select(simhash.gray_rank(simhash._packed(F.col("fp"), layout[c][1])).alias("first"))
        g = simhash._prefixed(packed).agg(F.countDistinct("g8").alias("a"), F.countDistinct("g16").alias("b")).first()
        assert g.a >= 100 and g.b >= 10_000
        ranks = np.array([r.first for r in packed.select("first").limit(500).collect()], np.int64).view(np.uint64)
        back = simhash._unpacked(ranks, np.full(len(ranks), c), np.zeros(len(ranks), np.uint64), layout)
        assert set(back.view(np.int64).tolist()) <= set(fps.tolist())


def test_links_in_a_hot_list(spark):
    """Many fingerprints that share one choice of blocks, near pairs among them."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 43, 3000, np.uint64)  # the upper blocks are zero
    near = base[:300] ^ (np.uint64(1) << rng.integers(0, 43, 300).astype(np.uint64)) ^ np.uint64(5)
    fps = np.unique(np.concatenate([base, near]))
    df = spark.createDataFrame([(int(f),) for f in fps], "fp long").repartition(4)
    roots = {r.node: r.root for r in components.connected_components(simhash.links(df)).collect()}
    i, j = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4, 1))
    assert len(i) >= 300
    assert all(roots[int(fps[a])] == roots[int(fps[b])] for a, b in zip(i, j))
    linked = {int(fps[k]) for k in (*i, *j)}
    assert set(roots) == linked
