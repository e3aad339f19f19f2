"""Policy and content verdicts: findings of a pack rolled up per file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.functions.text import content_language, let
from codesieve.operators.rules import CONTENT, POLICY, Rule
from codesieve.operators.scan import clear_hits, first_outside_comments, possible, scan_first

POLICY_EVIDENCE = 80


def policy_findings(files: DataFrame, rules: Sequence[Rule] = POLICY) -> DataFrame:
    """(file_id, rule_id, category, critical, evidence): existence and first match."""
    code = F.col("code")
    hits = F.array(
        *[
            F.when(
                possible(r, code, F.col("_low")) & code.rlike(r.pattern),
                F.struct(
                    F.lit(r.rule_id).alias("rule_id"), F.lit(r.category).alias("category"), F.lit(r.critical).alias("critical"),
                    F.substring(F.regexp_extract(code, r.pattern, 0), 1, POLICY_EVIDENCE).alias("evidence"),
                ),
            )
            for r in rules
        ]
    )
    return files.withColumn("_low", F.lower(code)).select("file_id", F.inline(F.filter(hits, lambda h: h.isNotNull())))


def policy_of(code: Column, rules: Sequence[Rule] = POLICY) -> Column:
    """struct(n_violations, risk_score, verdict, summary) of one text."""
    def counted(hits: Column) -> Column:
        def total(of: Column) -> Column:
            return F.aggregate(of, F.lit(0), lambda s, h: s + h)

        weighed = F.zip_with(hits, F.array(*[F.lit(40 if r.critical else 20) for r in rules]), lambda h, w: h * w)
        return F.struct(
            total(hits).alias("n"), total(weighed).alias("risk"), F.exists(weighed, lambda w: w == 40).cast("int").alias("c")
        )

    def rolled(x: Column) -> Column:
        serious, any_ = x["c"] > 0, x["n"] > 0
        return F.struct(
            x["n"].cast("long").alias("n_violations"), F.least(F.lit(100), x["risk"]).cast("long").alias("risk_score"),
            F.when(serious, "BLOCKED").when(any_, "WARNING").otherwise("ALLOWED").alias("verdict"),
            F.when(serious, "refused: critical violation").when(any_, "warning: needs review").otherwise("clean").alias("summary"),
        )

    # Each rule is tried once and its result bound.
    hits = let(F.lower(code), lambda low: F.array(*[(possible(r, code, low) & code.rlike(r.pattern)).cast("int") for r in rules]))
    return let(let(hits, counted), rolled)


def policy_verdict(files: DataFrame, rules: Sequence[Rule] = POLICY) -> DataFrame:
    """One row per file: n_violations, risk_score, verdict, summary. No shuffle."""
    return files.select("file_id", policy_of(F.col("code"), rules).alias("p")).select("file_id", "p.*")


def content_findings(files: DataFrame, rules: Sequence[Rule] = CONTENT) -> DataFrame:
    return first_outside_comments(files, rules, content_language(F.col("code")))


def content_of(code: Column, rules: Sequence[Rule] = CONTENT) -> Column:
    """struct(n_violations, verdict, blocked, message) of one text."""

    def rolled(hits: Column) -> Column:
        unlawful, any_ = F.exists(hits, lambda h: h["critical"]), F.size(hits) > 0
        return F.struct(
            F.size(hits).cast("long").alias("n_violations"),
            F.when(unlawful, "ILLEGAL").when(any_, "RESTRICTED").otherwise("LEGAL").alias("verdict"), unlawful.alias("blocked"),
            F.when(unlawful, "refused: unlawful content").when(any_, "warning: restricted content").otherwise("accepted").alias("message"),
        )

    return let(clear_hits(code, rules, content_language(code)), rolled)


def content_verdict(files: DataFrame, rules: Sequence[Rule] = CONTENT) -> DataFrame:
    """One row per file: n_violations, verdict ILLEGAL, RESTRICTED or LEGAL, blocked. No shuffle."""
    return files.select("file_id", content_of(F.col("code"), rules).alias("c")).select("file_id", "c.*")


def corpus_rollup(files: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Findings by repo, category and severity, with all sub-totals."""
    found = scan_first(files, rules, keep=("file_id", "repo"))
    return found.rollup("repo", "category", "severity").agg(
        F.grouping_id().cast("long").alias("level"), F.count("*").alias("n_findings"), F.countDistinct("file_id").alias("n_files")
    )


#: Grain and bits of the file sketches; some 0.7 % of error.
GRAIN, SKETCH_BITS = ("repo", "category", "severity"), 14


def finding_sketches(files: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Per repo, category and severity: n_findings and a mergeable sketch of the files."""
    found = scan_first(files, rules, keep=("file_id", "repo"))
    return found.groupBy(*GRAIN).agg(F.count("*").alias("n_findings"), F.hll_sketch_agg("file_id", SKETCH_BITS).alias("files"))


def merged_sketches(old: DataFrame, new: DataFrame) -> DataFrame:
    """Sketches of both; ``new`` comes from files that ``old`` has not seen, of which
    only the sketch would not care."""
    both = old.unionByName(new)
    return both.groupBy(*GRAIN).agg(F.sum("n_findings").alias("n_findings"), F.hll_union_agg("files").alias("files"))


def rolled_up(sketches: DataFrame) -> DataFrame:
    """``corpus_rollup`` from sketches: n_files is an estimate. Findings are not read,
    and what is expanded over the levels is a row for each cell of the grain."""
    return sketches.rollup(*GRAIN).agg(
        F.grouping_id().cast("long").alias("level"), F.sum("n_findings").alias("n_findings"),
        F.hll_sketch_estimate(F.hll_union_agg("files")).alias("n_files"),
    )
