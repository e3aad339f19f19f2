"""Quality rules and a hashed n-gram likelihood ratio, without Python code in tasks.

Base rules are counts within one text. The method: two multinomials over hashed
n-grams, one of trusted texts and one of the raw corpus. A text's score is the
mean over its n-grams of log(trusted / raw). Every text is then judged by one
fixed threshold, no sampling involved.

Raw counts cover every n-gram of every text, the trusted model and the threshold
every labelled row. The ratio table has ``buckets`` numbers, a fixed size, and is a
literal of the plan.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.llm.common import SMALL_ROWS, let, small_side, words_column

BUCKETS = 10_000
SMOOTHING = 1.0
#: Tokens of the likelihood ratio: runs of letters and digits, runs of marks.
TOKEN = r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]+"
SYMBOLS = r"[#*$%&|<>]"


def repeat_words(words: Column, window: int = 5) -> Column:
    """Words inside windows of ``window`` words that occur twice or more."""

    def covered(starts: Column) -> Column:
        first = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

        def add(state: Column, at: Column) -> Column:
            end = at + window
            return F.struct(
                (state["n"] + end - F.greatest(at, state["end"])).cast("int").alias("n"), end.cast("int").alias("end")
            )

        return F.aggregate(starts, first, add, lambda s: s["n"])

    def repeated(ranked: Column) -> Column:
        twin = F.filter(
            F.transform(
                ranked,
                lambda p, j: F.when(
                    (F.get(ranked, j - 1)["h"].eqNullSafe(p["h"])) | (F.get(ranked, j + 1)["h"].eqNullSafe(p["h"])), p["i"]
                ),
            ),
            lambda i: i.isNotNull(),
        )
        return let(F.array_sort(twin), covered)

    def count(hashes: Column) -> Column:
        ranked = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(ranked, repeated))

    def windows(hs: Column) -> Column:
        hashes = F.transform(
            F.sequence(F.lit(0), F.size(hs) - window), lambda i: F.xxhash64(*[F.get(hs, i + k) for k in range(window)])
        )
        return F.when(F.size(hs) < window + 1, F.lit(0)).otherwise(let(hashes, count))

    # Each word is hashed once; windows are hashes of hashes.
    return let(F.transform(words, lambda w: F.xxhash64(w)), windows).cast("long")


def dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda ls: F.size(ls) - F.size(F.array_distinct(ls))).cast("long")


def base_rules(text: Column) -> dict[str, Column]:
    """The counts of one text, by name. ``_words`` is its array of words."""
    whole = F.coalesce(text, F.lit(""))
    return {
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": (F.length(whole) - F.length(F.regexp_replace(whole, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": dup_lines(whole),
        "n_repeat_words": repeat_words(F.col("_words")),
    }


def ngram_buckets(text: Column, buckets: int = BUCKETS) -> Column:
    """Buckets of a text's hashed tokens and token pairs."""
    tokens = F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0)), lambda t: F.xxhash64(t))

    def both(ts: Column) -> Column:
        return F.concat(
            F.transform(ts, lambda t: F.pmod(t, F.lit(buckets)).cast("int")),
            F.transform(
                F.slice(ts, 2, F.greatest(F.size(ts) - 1, F.lit(0))),
                lambda t, i: F.pmod(F.xxhash64(F.get(ts, i), t), F.lit(buckets)).cast("int"),
            ),
        )

    return let(tokens, both)


def labelled_ids(labels: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """(labelled, trusted, good) of every id with a label, one row each: whether a
    label says good, and whether none says bad. Broadcast up to ``max_rows``; beyond,
    texts are shuffled to their labels."""
    given = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)")
    ids = given.groupBy(F.col("doc_id").alias("labelled")).agg(F.max(F.col("quality") == 1).alias("trusted"), F.min(F.col("quality") == 1).alias("good"))
    return small_side(ids, max_rows)


def likelihood_ratios(df: DataFrame, labelled: DataFrame, id_col: str, text_col: str, buckets: int) -> list[float]:
    """log(trusted / raw) for each bucket, one pass over all rows; see ``labelled_ids``."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counts = (
        rows.join(labelled, F.col("id") == F.col("labelled"), "left")
        .select(F.explode(ngram_buckets(F.col("text"), buckets)).alias("bucket"), F.coalesce("trusted", F.lit(False)).cast("long").alias("hit"))
        .groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("hit").alias("target"))
        .collect()  # one row per bucket at most
    )
    raw, target = [SMOOTHING] * buckets, [SMOOTHING] * buckets
    for row in counts:
        raw[row["bucket"]] += row["raw"]
        target[row["bucket"]] += row["target"]
    shift = math.log(sum(raw)) - math.log(sum(target))
    return [math.log(t) - math.log(r) + shift for t, r in zip(target, raw)]


def score_column(text: Column, ratios: list[float]) -> Column:
    """Mean log ratio over a text's n-grams; 0 without any."""
    table = F.from_json(F.lit("[" + ",".join(f"{x:.6f}" for x in ratios) + "]"), "array<double>")
    total = let(
        ngram_buckets(text, len(ratios)),
        lambda bs: F.when(F.size(bs) == 0, F.lit(0.0)).otherwise(
            F.aggregate(bs, F.lit(0.0), lambda s, b: s + F.get(table, b)) / F.size(bs)
        ),
    )
    return F.round(total, 6)


def fit_threshold(df: DataFrame, labelled: DataFrame, ratios: list[float], id_col: str, text_col: str) -> float:
    """Halfway between the mean scores of good and of bad labelled texts.

    Fitted on every labelled row. Halfway leaves room for good texts of rarer
    languages, which score below the mean. Without bad labels: six standard
    deviations below the good ones; without good ones no text is rejected.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = {
        r["good"]: (r["n"], r["mean"], r["sd"] or 0.0)
        for r in rows.join(labelled, F.col("id") == F.col("labelled"))
        .select("good", score_column(F.col("text"), ratios).alias("score"))
        .groupBy("good").agg(F.count("*").alias("n"), F.mean("score").alias("mean"), F.stddev_pop("score").alias("sd"))
        .collect()
    }
    if True not in found:
        return -math.inf
    _, high, high_sd = found[True]
    if False not in found or found[False][1] >= high:
        return high - 6 * max(high_sd, 1e-3)
    return (found[False][1] + high) / 2


def base_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: id, the base counts and base_failed, as in ``quality``."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("_words", words_column(F.col("text")))
    rules = base_rules(F.col("text"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    counted = rows.select("id", *[c.alias(n) for n, c in rules.items()])
    return counted.select(F.col("id").alias(id_col), *rules, failed.alias("base_failed"))


def quality(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int = BUCKETS,
) -> DataFrame:
    """One row per row of ``df``: id, the base counts, score, base_failed, kept.

    A text fails the base rules with fewer than 10 words, or if more than a
    fifth of its words are repeated 5-word windows. Otherwise it is kept if its
    score reaches the threshold. Null text has no words and fails. Repeated rows
    are judged alike. ``labels`` has doc_id and quality; without good labels no
    text is rejected by score. Other columns of ``df`` are ignored.
    """
    labelled = labelled_ids(labels)
    ratios = likelihood_ratios(df, labelled, id_col, text_col, buckets)
    threshold = fit_threshold(df, labelled, ratios, id_col, text_col)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("_words", words_column(F.col("text")))
    rules = base_rules(F.col("text"))
    judged = rows.select("id", *[c.alias(n) for n, c in rules.items()], score_column(F.col("text"), ratios).alias("score"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    passed = F.lit(True) if threshold == -math.inf else F.col("score") >= F.lit(threshold)
    return judged.select(
        F.col("id").alias(id_col), *rules, "score", failed.alias("base_failed"), (~failed & passed).alias("kept")
    )


def drop_low_quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """The rows of ``df`` that ``quality`` keeps, judged in the scan: no join."""
    labelled = labelled_ids(labels)
    ratios = likelihood_ratios(df, labelled, id_col, text_col, buckets)
    threshold = fit_threshold(df, labelled, ratios, id_col, text_col)
    words = words_column(df[text_col])
    fine = let(words, lambda ws: (F.size(ws) >= 10) & (100 * repeat_words(ws) <= 20 * F.size(ws)))
    if threshold != -math.inf:
        fine = fine & (score_column(df[text_col], ratios) >= F.lit(threshold))
    return df.where(fine)
