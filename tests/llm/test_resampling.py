"""Importance resampling against a plain Python version; keys against the library."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from codesieve.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def plain(docs, target):
    def counted(texts):
        out = Counter()
        for t in texts:
            out.update(zlib.crc32(f.encode()) % 10_000 for f in features(t)[1])
        return out

    s, t = counted(x for _, x in docs), counted(target)
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000))))
    out = []
    for i, text in docs:
        words, found = features(text)
        weight = sum(gain(zlib.crc32(f.encode()) % 10_000) for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((i, len(words), len(found), weight, score))
    fit = sorted((-r[4], r[0] is not None, r[0] or 0) for r in out if r[1] >= 20)
    return out, fit[: 25 * len(fit) // 100]


def check(df, docs, target_df, target, **options):
    got = [tuple(r) for r in resampling.resample(df, target_df, **options).collect()]
    rows, drawn = plain(docs, target)
    assert Counter(g[:4] for g in got) == Counter((r[0], *r[2:]) for r in rows)
    ranks = sorted(g for g in ((g[4], g[3], g[0]) for g in got) if g[0])
    assert [(k, -s, i) for k, (s, _, i) in enumerate(((a, b, c if b else None) for a, b, c in drawn), 1)] == ranks


@pytest.fixture(scope="module")
def target(spark):
    texts = ["Lan mer nis baceba OR x", None, "", "pupupu dififo! dififo 7 ümlaut", "漢字 lanmeror"]
    return spark.createDataFrame([(k, t, "extra") for k, t in enumerate(texts)], "item_id long, text string, bucket string"), texts


@pytest.mark.parametrize("size", [1 << 18, 300])
def test_equals_plain_version(docs, rows, target, monkeypatch, size):
    if size < 1000:
        monkeypatch.setattr(resampling, "SLICE", size)
    check(docs, [(r[0], r[1]) for r in rows], target[0], target[1])


def test_odd_bytes_and_ties(spark, target):
    rng = random.Random(5)
    pool = "aAbZ09 \x00\x01\n\x1f/:@[`{\x7f\x80ÄÖ漢😀 "
    docs = [(k, "".join(rng.choice(pool) for _ in range(rng.randint(0, 300)))) for k in range(300)]
    docs += [(1000, "same words " * 12)] * 9 + [(None, "no id " * 15), (2000, "w" * 3000 + " " + "v" * 400)]
    check(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), docs, target[0], target[1])


def test_empty_tables(spark, no_docs, docs, rows, target):
    assert resampling.resample(no_docs, target[0]).count() == 0
    check(docs, [(r[0], r[1]) for r in rows], target[0].limit(0), [])


def test_keys_are_xxh64_and_crc32():
    rng = random.Random(1)
    parts = [rng.randbytes(n) for n in [*range(0, 300), 1000, 31, 32, 33]]
    starts = np.cumsum([0] + [len(p) for p in parts[:-1]])
    spans = resampling.Spans(b"".join(parts), starts, np.array([len(p) for p in parts]))
    assert spans.keys().tolist() == [xxhash.xxh64_intdigest(p) for p in parts]
    some = np.array([k for k in range(len(parts)) if k % 3] + [0])
    assert spans.crc32(some).tolist() == [zlib.crc32(parts[k]) for k in some]
    assert spans.crc32(some[:0]).tolist() == []


def test_equal_keys_of_other_bytes_get_other_slots():
    words = [b"a", b"b", b"a", b"ab", b"b", b"x" * 300, b"x" * 299 + b"y", b"x" * 300, b"12345678", b"1234567", b"12345678"]
    starts = np.cumsum([0] + [len(w) for w in words[:-1]])
    spans = resampling.Spans(b"".join(words), starts, np.array([len(w) for w in words]))
    table = resampling.Table(spans, np.full(len(words), 7, np.uint64))
    slots = dict(zip(words, table.slots.tolist()))
    assert len(set(slots.values())) == len(slots) and [slots[w] for w in words] == table.slots.tolist()
    assert {w: int(table.count[s]) for w, s in slots.items()} == Counter(words)
    assert {w: int(table.bucket[s]) for w, s in slots.items()} == {w: zlib.crc32(w) % 10_000 for w in words}


def test_ranks_over_many_ranges(spark):
    from pyspark.sql import functions as F

    df = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 1000).alias("v"), "id")
    got = [(r["rank"], r["v"], r["id"]) for r in resampling.ranked(df, F.col("v").desc(), F.col("id").asc()).collect()]
    want = sorted(((k * 7919 % 1000), k) for k in range(5000))
    want.sort(key=lambda x: (-x[0], x[1]))
    assert sorted(got) == [(k, v, i) for k, (v, i) in enumerate(want, 1)]
