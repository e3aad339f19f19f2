import math
from collections import Counter

import pytest

from codesieve.llm import quality


def brute_rules(text):
    words = (text or "").encode().split()
    grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    seen = Counter(grams)
    covered = set()
    for k, g in enumerate(grams):
        if seen[g] > 1:
            covered |= set(range(k, k + 5))
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return (
        len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered),
    )


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, 1) for k in range(20)] + [(41, 0), (42, 0), (99, 1), (None, 1)], "doc_id long, quality int")


def test_base_rules(docs, rows, labels):
    got = quality.quality(docs, labels).collect()
    expected = Counter((r[0], *brute_rules(r[1])) for r in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == expected
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


@pytest.mark.parametrize(
    "text, n", [("a b c d e a b c d e", 10), ("a a a a a a", 6), ("a a a a a", 0), ("a b c d e x a b c d e f b c d e f", 16), ("", 0), ("a b c d e f a b c d", 0)]
)
def test_repeat_words(spark, text, n):
    from pyspark.sql import functions as F

    from codesieve.llm.common import words_column

    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(quality.repeat_words(words_column(F.col("t")))).first()[0] == n == brute_rules(text)[4]


def test_scores_against_brute_force(spark, docs, rows, labels):
    """The hashed counts, from the same buckets, counted here by hand."""
    from pyspark.sql import functions as F

    buckets = {}
    for r in docs.select("doc_id", "text", quality.ngram_buckets(F.col("text"), 50).alias("b")).collect():
        buckets[r.doc_id, r.text] = list(r.b)
    trusted = set(range(20))
    raw, target = [1.0] * 50, [1.0] * 50
    for r in rows:
        for b in buckets[r[0], r[1]]:
            raw[b] += 1
            target[b] += r[0] in trusted
    ratios = [math.log(t / sum(target)) - math.log(x / sum(raw)) for t, x in zip(target, raw)]
    got = quality.quality(docs, labels, buckets=50).collect()
    by_key = {(r.doc_id, r.n_words, r.word_chars): r for r in got}
    for r in rows:
        bs = buckets[r[0], r[1]]
        score = sum(ratios[b] for b in bs) / len(bs) if bs else 0.0
        assert abs(by_key[r[0], *brute_rules(r[1])[:2]].score - score) < 2e-6


def test_held_out_accuracy(spark, sf_dir):
    """Models fitted on half of the labels tell the others apart."""
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    given = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    judged = quality.quality(documents, given.where("doc_id % 2 = 0"))
    held = judged.join(given.where("doc_id % 2 = 1"), "doc_id").where("NOT base_failed").collect()
    good, bad = [r.kept for r in held if r.quality == 1], [r.kept for r in held if r.quality == 0]
    assert sum(good) / len(good) > 0.98 and sum(bad) / len(bad) < 0.2


def test_without_labels_and_without_rows(docs, no_docs, labels):
    got = quality.quality(docs, labels.limit(0)).collect()
    assert all(r.kept == (not r.base_failed) for r in got)
    assert quality.quality(no_docs, labels).count() == 0
    kept = quality.drop_low_quality(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == quality.quality(docs, labels).where("kept").count()


def test_native(docs, labels):
    plan = quality.quality(docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_every_label_counts(spark):
    """With all of 12,000 texts labelled good, trusted and raw counts are the same numbers."""
    from pyspark.sql import functions as F

    many = spark.range(12_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), (F.col("id") % 11).cast("string")).alias("text"))
    good = many.select("doc_id", F.lit(1).alias("quality"))
    for max_rows in (200_000, 0):
        ids = quality.labelled_ids(good, max_rows)
        ratios = quality.likelihood_ratios(many, ids, "doc_id", "text", 50)
        assert max(abs(x) for x in ratios) < 1e-9
    bad = many.select("doc_id", (F.col("doc_id") % 2).alias("quality"))
    ids = quality.labelled_ids(bad, 0)
    table = [float(k) for k in range(50)]
    scores = many.select("doc_id", quality.score_column(F.col("text"), table).alias("s"))
    means = [scores.where(F.col("doc_id") % 2 == k).agg(F.mean("s")).first()[0] for k in (0, 1)]
    got = quality.fit_threshold(many, ids, table, "doc_id", "text")
    assert got == pytest.approx((means[0] + means[1]) / 2 if means[1] > means[0] else got)
