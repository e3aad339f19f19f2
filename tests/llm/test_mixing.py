import random
from collections import defaultdict

import pytest

from codesieve.llm import mixing


def brute_targets(sizes, most=3):
    """Iterated sharing by weight with caps."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        pool = total - sum(most * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        share = {s: pool * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in capped else share[s] for s in order}
        capped |= over


def by_source(rows):
    out = defaultdict(list)
    for r in rows:
        out[r.source].append(r)
    return out


def test_targets_and_taken(docs, rows):
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len((r[1] or "").encode().split())
    targets = brute_targets(sizes)
    block = max(1, min(mixing.BLOCK_WORDS, sum(sizes.values()) // 10_000))
    for source, group in by_source(got).items():
        assert all(r.source_size == sizes[source] and abs(r.target - targets[source]) < 1e-6 for r in group)
        assert abs(sum(r.taken for r in group) - targets[source]) <= block + 1
        assert all(0 <= r.taken <= 3 * r.size and 0 <= r.start <= r.size for r in group)


def test_reruns_agree_whatever_the_partitions(docs):
    one = sorted(map(str, mixing.mix_sources(docs).collect()))
    assert one == sorted(map(str, mixing.mix_sources(docs.repartition(7), shard_docs=mixing.SHARD_DOCS).collect()))
    assert one != sorted(map(str, mixing.mix_sources(docs, seed=5).collect()))


def test_small_shards_still_meet_the_target(docs):
    for group in by_source(mixing.mix_sources(docs, shard_docs=3).collect()).values():
        shards = len(group) / 3 + 1
        assert abs(sum(r.taken for r in group) - group[0].target) <= 10 * (shards + 1)
        assert all(r.taken <= 3 * r.size for r in group)


@pytest.mark.parametrize("sizes", [{"a": 1000, "b": 10, "c": 10}, {"a": 5}, {None: 7, "a": 0}, {"a": 300, "b": 300, "c": 300, "d": 1, "e": 900}])
def test_capped_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    expected = brute_targets(sizes)
    assert all(abs(got[s] - expected[s]) < 1e-6 for s in sizes)


def brute_seats(votes, seats, caps):
    quota = {k: 0 for k in votes}
    for _ in range(seats):
        free = [k for k in votes if quota[k] < caps[k]]
        if not free:
            break
        best = max(free, key=lambda k: (votes[k] / (2 * quota[k] + 1), [-ord(c) for c in k]))
        quota[best] += 1
    return quota


def test_sainte_lague(spark):
    from pyspark.sql import functions as F

    votes = {"a": 53.0, "b": 24.5, "c": 23.1, "d": 0.2, "e": 24.5}
    for seats in (1, 7, 100, 1000):
        df = spark.createDataFrame([("g", k, v) for k, v in votes.items()], "g string, k string, v double")
        out = mixing.sainte_lague(df, ["g"], "k", F.col("v"), F.lit(seats), F.lit(10_000))
        assert {r.k: r.quota for r in out.collect()} == brute_seats(votes, seats, {k: 10_000 for k in votes})


def test_applied_mix_matches_the_plan(docs, no_docs):
    unique = docs.where("doc_id > 0")
    plan = {r.doc_id: r for r in mixing.mix_sources(unique).collect()}
    mixed = mixing.apply_mix(unique)
    assert mixed.columns == docs.columns
    taken = defaultdict(int)
    for r in mixed.collect():
        taken[r.doc_id] += len(r.text.encode().split())
    assert {k: v for k, v in taken.items() if v} == {k: r.taken for k, r in plan.items() if r.taken}
    assert mixing.mix_sources(no_docs).count() == mixing.apply_mix(no_docs).count() == 0


def test_applied_mix_takes_each_row_by_its_own_plan(spark):
    """Null ids, repeated rows and two texts under one id: nothing lost or squared."""
    rng = random.Random(3)
    text = [" ".join(f"w{k}x{j}" for j in range(rng.randint(20, 60))) for k in range(40)]
    data = [(k, text[k], "a") for k in range(25)] + [(None, text[k], "b") for k in (25, 26, 27, 27)]
    data += [(7, text[28], "a"), (8, text[29], None)] + [(30, text[30], "b")] * 6
    df = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(4)
    plan = mixing.mix_sources(df).collect()
    assert sum(r.taken for r in plan if r.doc_id is None) > 0
    mixed = mixing.apply_mix(df).collect()
    wanted, got = defaultdict(int), defaultdict(int)
    for r in plan:
        wanted[r.doc_id, r.source] += r.taken
    for r in mixed:
        got[r.doc_id, r.source] += len(r.text.split())
        whole = [t.split() for i, t, s in data if (i, s) == (r.doc_id, r.source)]
        assert any(r.text in " ".join(w + w) and len(r.text.split()) <= len(w) for w in whole)
    assert dict(got) == {k: v for k, v in wanted.items() if v}
    assert len(mixed) == sum(-(-r.taken // r.size) for r in plan if r.taken)
    assert sorted(map(str, mixed)) == sorted(map(str, mixing.apply_mix(df.repartition(7)).collect()))


def test_applied_mix_takes_the_plan_of_the_whole_fixture(docs):
    mixed = mixing.apply_mix(docs).collect()
    assert sum(len(r.text.encode().split()) for r in mixed) == sum(r.taken for r in mixing.mix_sources(docs).collect())


@pytest.mark.parametrize("seats", [1400, 1600, 700, 3])
def test_sainte_lague_with_many_small_voters(spark, seats):
    from pyspark.sql import functions as F

    small = 0.6 if seats == 1600 else 0.4
    votes = {"a": 1000.0, **{f"b{k:03}": small for k in range(1000)}}
    caps = {k: 1300 if k == "a" else 2 for k in votes}
    df = spark.createDataFrame([("g", k, v, caps[k]) for k, v in votes.items()], "g string, k string, v double, c long")
    out = mixing.sainte_lague(df, ["g"], "k", F.col("v"), F.lit(seats), F.col("c"))
    assert {r.k: r.quota for r in out.collect()} == brute_seats(votes, seats, caps)


def test_small_sources_meet_their_targets_in_a_large_input(spark):
    """Blocks have 128 words here; sources of few words must not round to nothing."""
    words = [("big", 2_000)] * 700 + [(f"s{k:02}", 5 + k) for k in range(60)] + [("one", 1)]
    df = spark.createDataFrame([(k, "w " * n, s) for k, (s, n) in enumerate(words)], "doc_id long, text string, source string")
    for shard_docs in (mixing.SHARD_DOCS, 10):
        for source, group in by_source(mixing.mix_sources(df, shard_docs=shard_docs).collect()).items():
            assert abs(sum(r.taken for r in group) - group[0].target) <= 1, source


def test_bands_of_shards_still_meet_the_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BAND_SHARDS", 3)
    df = spark.createDataFrame([(k, "w " * (1 + k * 7 % 50), "abc"[k % 7 % 3]) for k in range(900)], "doc_id long, text string, source string")
    for group in by_source(mixing.mix_sources(df, shard_docs=10).collect()).values():
        assert abs(sum(r.taken for r in group) - group[0].target) <= 1
        assert all(r.taken <= 3 * r.size for r in group)


def brute_blocks(votes, seats, caps):
    """Highest quotients one seat at a time; also the seat that was dealt last."""
    quota = dict.fromkeys(votes, 0)
    for _ in range(seats):
        free = [k for k in votes if quota[k] < caps[k] and votes[k] > 0]
        if not free:
            break
        quota[min(free, key=lambda k: (-votes[k] / (2 * quota[k] + 1), k))] += 1
    last = max((k for k in votes if quota[k]), key=lambda k: (-votes[k] / (2 * quota[k] - 1), k), default=None)
    return quota, last


def test_source_quotas_are_blocks_of_highest_quotient(spark):
    sizes = {"a": 5_000, "b": 900, "c": 20_000, "d": 450, "e": 700, "f": 333, "g": 77, "h": 410}
    df = spark.createDataFrame([(k, n) for k, n in sizes.items()], "source string, size long")
    got = {r.of_source: r for r in mixing._source_quotas(df, 3, 128, 2_000).collect()}
    targets = brute_targets(sizes)
    quota, _ = brute_blocks(targets, sum(sizes.values()) // 128, {k: -(-t // 128) for k, t in targets.items()})
    words = {k: round(t) for k, t in targets.items()}
    assert {k: r.of_words for k, r in got.items()} == words
    assert {k: r.of_seats for k, r in got.items()} == {k: q + (words[k] > q * 128) for k, q in quota.items()}


@pytest.mark.parametrize("seed", range(4))
def test_shard_quotas_equal_dealing_and_differ_from_rounding(spark, seed):
    rng = random.Random(seed)
    sizes = {k: rng.choice([0, 10, 100, 700, 900, 1500, 5000]) + rng.randint(0, 60) for k in range(40)}
    total = sum(sizes.values())
    words = rng.randint(total // 3, 3 * total)
    seats = -(-words // 128)
    df = spark.createDataFrame([("g", k, n, words, seats) for k, n in sizes.items()], "g string, k long, part_size long, of_words long, of_seats long")
    got = {r.k: r.run for r in mixing._dealt(df, ["g"], "k", 128, 3).collect()}
    quota, last = brute_blocks(sizes, seats, {k: -(-3 * n // 128) for k, n in sizes.items()})
    want = {k: max(0, min(q * 128 - (seats * 128 - words) * (k == last), 3 * sizes[k])) for k, q in quota.items()}
    left = words - sum(want.values())
    for k in sorted(want):
        more = min(left, 3 * sizes[k] - want[k])
        want[k], left = want[k] + more, left - more
    assert got == want and sum(got.values()) == words
    assert any(abs(got[k] - round(n * words / total)) > 20 for k, n in sizes.items())


def test_chosen_blocks_against_a_plain_walk(spark):
    """Blocks of a shard's line are listed one by one; words are counted one by one."""
    from pyspark.sql import functions as F

    rng = random.Random(11)
    data = [(k, "w " * rng.choice([0, 1, 5, 40, 300, 2000]), rng.choice(["a", "b", "b", "b", None])) for k in range(260)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    rows = df.select(F.col("doc_id").alias("id"), "source", mixing.n_words_column(F.col("text")).alias("size"))
    planned = mixing._taken(rows, shard_docs=40, block_words=50)
    parts = mixing._parts(50).alias("parts")
    lines = defaultdict(list)
    for r in planned.select("*", parts).collect():
        lines[r.source, r.blocks, r["from"], r.whole, r.odd, r.laps, r.odd_at].append(r)
    assert sum(1 for k in lines if 0 < k[3] < k[1]) > 3
    for (_, blocks, start, whole, odd, laps, odd_at), group in lines.items():
        chosen = [j for j in range(blocks) if (j * whole + start) % blocks + whole >= blocks] if whole else []
        assert len(chosen) == whole
        places = {w for j in chosen for w in range(50 * j, 50 * j + 50)}
        assert not places & set(range(odd_at, odd_at + odd))
        places |= set(range(odd_at, odd_at + odd))
        assert odd_at == 50 * next((j for j in range(blocks) if j not in chosen), blocks)
        for r in group:
            own = [w - r.begin for w in range(r.begin, r.end) if w in places]
            assert r.taken == laps * r.size + len(own)
            assert [w for p in r.parts for w in range(p["at"], p["at"] + p.n)] == own
            assert all(a["at"] + a.n < b["at"] for a, b in zip(r.parts, r.parts[1:])) and r.start == (own or [0])[0]


def test_a_long_text_is_cut_into_words_once(spark):
    """Many parts of one text: time follows the text, not its parts times its length."""
    import time

    def seconds(n):
        text = " ".join(f"w{k}" for k in range(n))
        df = spark.createDataFrame([(0, text, "a"), (1, "x " * (n // 3), "b"), (2, "y " * n, "c")], "doc_id long, text string, source string")
        begin = time.time()
        rows = mixing.apply_mix(df).collect()
        took = time.time() - begin
        parts = [r.text for r in rows if r.doc_id == 0]
        assert len(parts) > n // 2000 and all(p in text for p in parts)
        return took

    seconds(5_000)
    assert seconds(200_000) < 4 * seconds(50_000) + 5
