"""Rule packs as tables: written, read, and refused where a pattern is unfit.

A table of rules has the columns of ``SCHEMA``. Rules are few and become literals of
the scan's plan, so they are read to the driver; their number is bounded.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesieve.operators.rules import SEVERITIES, Rule

SCHEMA = "place int, rule_id string, severity string, category string, pattern string, critical boolean, skip array<string>"
MAX_RULES = 2_000


def rule_rows(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """A pack as a table, in its order."""
    return spark.createDataFrame([(k, r.rule_id, r.severity, r.category, r.pattern, r.critical, list(r.skip)) for k, r in enumerate(rules)], SCHEMA)


def repeated_choice(pattern: str) -> bool:
    """Whether a group that holds a choice is repeated and may be tried again: the
    matcher then needs a stack as deep as the text is long."""
    choices = [False]
    at, closed = 0, False
    in_class = 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            at, closed = at + 2, False
            continue
        if in_class:
            in_class += (c == "[") - (c == "]")
        elif c == "[":
            in_class, closed = 1, False
            if pattern[at + 1 : at + 2] == "^":
                at += 1
            if pattern[at + 1 : at + 2] == "]":
                at += 1
        elif c == "(":
            choices.append(False)
            closed = False
        elif c == ")":
            closed = len(choices) > 1 and choices.pop()
            choices[-1] |= closed  # a choice further in is one for the group around it
        elif c == "|":
            choices[-1] = True
            closed = False
        else:
            if closed and c in "*+{":
                end = at if c != "{" else pattern.find("}", at)
                many = c != "{" or "," in pattern[at:end] or int(pattern[at + 1 : end] or 0) > 64
                if many and pattern[end + 1 : end + 2] != "+":
                    return True
            closed = False
        at += 1
    return False


def problem_of(spark: SparkSession, rule: Rule) -> str | None:
    """Why a rule is unfit; null if it is fit."""
    if not rule.rule_id:
        return "no id"
    if not rule.pattern:
        return "no pattern"
    if rule.severity not in SEVERITIES:
        return "unknown severity"
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(rule.pattern)
    except Exception as e:  # the gateway wraps the compiler's own error
        reason = getattr(getattr(e, "java_exception", None), "getDescription", lambda: "unknown error")()
        return f"pattern does not compile: {reason}"
    if repeated_choice(rule.pattern):
        return "pattern repeats a choice"
    return None


def load_rules(table: DataFrame, limit: int = MAX_RULES) -> tuple[list[Rule], DataFrame]:
    """The fit rules of a table in order, and (rule_id, pattern, problem) of the others.

    Without a place rules stand last, by id. Of rules with one id the first counts.
    More than ``limit`` rows are an error: a table of rules is no corpus.
    """
    spark = table.sparkSession
    rows = table.orderBy(F.col("place").asc_nulls_last(), "rule_id", "pattern").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rules")
    rules: list[Rule] = []
    refused = []
    known: set[str] = set()
    for r in rows:
        rule = Rule(r.rule_id or "", r.severity or "", r.category or "", r.pattern or "", bool(r.critical), tuple(r.skip or ()))
        problem = "id is taken" if rule.rule_id in known else problem_of(spark, rule)
        if problem is None:
            rules.append(rule)
            known.add(rule.rule_id)
        else:
            refused.append((r.rule_id, r.pattern, problem))
    return rules, spark.createDataFrame(refused, "rule_id string, pattern string, problem string")
