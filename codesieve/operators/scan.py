"""The rule scan: files x rules in one projection, without a shuffle.

A pattern is a literal, so it is compiled once, and it runs only on texts that hold
one of the words without which it cannot match (``required``): a plain search, over
the text in lower case where the pattern ignores case. ``split`` and
``regexp_extract_all`` walk the same matches; weaving their results gives each
hit's line without counting offsets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.functions.text import comment_or_string, count_of, gather, let, line_count, scanner_language, split_lines, trim_control
from codesieve.operators.prefilter import ignores_case, required
from codesieve.operators.rules import SEVERITIES, WEIGHTS, Rule

SNIPPET, EVIDENCE = 120, 100


def _allowed(rule: Rule, language: Column | None) -> Column:
    if not rule.skip or language is None:
        return F.lit(True)
    return ~language.isin(*rule.skip)


def _rule_fields(rule: Rule, order: int) -> list[Column]:
    rank = SEVERITIES.index(rule.severity) if rule.severity else 0
    return [
        F.lit(rule.rule_id).alias("rule_id"), F.lit(order).alias("rule_ord"), F.lit(rule.severity).alias("severity"),
        F.lit(rank).alias("sev_rank"), F.lit(rule.category).alias("category"), F.lit(rule.critical).alias("critical"),
    ]


def possible(rule: Rule, code: Column, low: Column) -> Column:
    """Whether a text holds a word that each match needs; true for rules without one.
    ``low`` is the text in lower case."""
    words = required(rule.pattern)
    text = low if ignores_case(rule.pattern) else code
    out = F.lit(not words)
    for w in words:
        out = out | text.contains(w)
    return out


def scan_first(files: DataFrame, rules: Sequence[Rule], language: Column | None = None, keep: Sequence[str] = ("file_id",)) -> DataFrame:
    """First match of each rule in each file: one row per file and rule that hits.

    Columns: ``keep``, rule_id, rule_ord, severity, sev_rank, category, critical,
    ln (1-based), snippet (trimmed line, 120 characters), evidence (the match).
    """
    code = F.col("code")

    def one(rule: Rule, order: int) -> Column:
        may = possible(rule, code, F.col("_low"))
        before = F.element_at(F.split(code, rule.pattern, 2), 1)
        ln = count_of(before, "\n") + 1
        return F.when(
            may & _allowed(rule, language) & code.rlike(rule.pattern),
            F.struct(
                *_rule_fields(rule, order),
                ln.alias("ln"),
                F.substring(trim_control(let(ln, lambda n: F.element_at(split_lines(code), n))), 1, SNIPPET).alias("snippet"),
                F.substring(F.regexp_extract(code, rule.pattern, 0), 1, EVIDENCE).alias("evidence"),
            ),
        )

    hits = F.filter(F.array(*[one(r, k) for k, r in enumerate(rules)]), lambda h: h.isNotNull())
    return files.withColumn("_low", F.lower(code)).select(*keep, F.inline(hits))


def all_hits(code: Column, rules: Sequence[Rule], language: Column | None = None) -> Column:
    """Per rule that matches: the rule's fields and ``found``, its matches in order.

    The lines of the text are bound once for a rule that matches; a match takes its
    line by number.
    """

    def weave(pair: Column, lines: Column) -> Column:
        kind = "array<struct<hit_no:int,ln:int,evidence:string,in_comment:boolean,snippet:string>>"
        start = F.struct(F.lit(1).alias("ln"), F.lit("").alias("cur"), F.array().cast(kind).alias("emit"))

        def after(text: Column) -> Column:
            return F.when(text.contains("\n"), F.substring_index(text, "\n", -1)).otherwise(text)

        def step(s: Column, i: Column) -> Column:
            piece, hit = F.get(pair["pieces"], i), F.get(pair["hits"], i)
            return let(
                F.struct(
                    (s["ln"] + count_of(piece, "\n")).alias("ln"), after(F.concat(s["cur"], piece)).alias("cur"), hit.alias("hit")
                ),
                lambda t: F.struct(
                    (t["ln"] + count_of(t["hit"], "\n")).cast("int").alias("ln"),
                    after(F.concat(t["cur"], t["hit"])).alias("cur"),
                    F.array(
                        F.struct(
                            (i + 1).cast("int").alias("hit_no"), t["ln"].cast("int").alias("ln"),
                            F.substring(t["hit"], 1, EVIDENCE).alias("evidence"),
                            comment_or_string(t["cur"]).alias("in_comment"),
                            F.substring(trim_control(F.get(lines, t["ln"] - 1)), 1, SNIPPET).alias("snippet"),
                        )
                    ).alias("emit"),
                ),
            )

        places = F.when(F.size(pair["hits"]) > 0, F.sequence(F.lit(0), F.size(pair["hits"]) - 1)).otherwise(F.array().cast("array<int>"))
        return let(places, lambda ps: gather(ps, start, kind, step, lambda s, out: out))

    def one(rule: Rule, order: int, x: Column) -> Column:
        pair = F.struct(
            F.split(code, rule.pattern, -1).alias("pieces"),
            F.regexp_extract_all(code, F.lit(rule.pattern), F.lit(0)).alias("hits"),
        )
        return F.when(
            possible(rule, code, x["low"]) & _allowed(rule, language) & code.rlike(rule.pattern),
            F.struct(*_rule_fields(rule, order), let(F.struct(pair.alias("pair"), split_lines(code).alias("lines")), lambda p: weave(p["pair"], p["lines"])).alias("found")),
        )

    def every(x: Column) -> Column:
        return F.filter(F.array(*[one(r, k, x) for k, r in enumerate(rules)]), lambda h: h.isNotNull())

    return let(F.struct(F.lower(code).alias("low")), every)


def scan_all(files: DataFrame, rules: Sequence[Rule], language: Column | None = None, keep: Sequence[str] = ("file_id",)) -> DataFrame:
    """Every match: as ``scan_first``, with hit_no (1-based) and in_comment."""
    rows = files.select(*keep, F.inline(all_hits(F.col("code"), rules, language)))
    return rows.select("*", F.inline("found")).drop("found")


def clear_hits(code: Column, rules: Sequence[Rule], language: Column | None = None) -> Column:
    """Per rule its first match that lies in no comment or string; no shuffle."""

    def first(h: Column) -> Column:
        found = F.get(F.filter(h["found"], lambda x: ~x["in_comment"]), F.lit(0))
        fields = [h[k].alias(k) for k in ("rule_id", "rule_ord", "category", "critical")]
        return let(
            found,
            lambda x: F.when(x.isNotNull(), F.struct(*fields, *[x[k].alias(k) for k in ("hit_no", "ln", "evidence")])),
        )

    return F.filter(F.transform(all_hits(code, rules, language), first), lambda h: h.isNotNull())


def first_outside_comments(files: DataFrame, rules: Sequence[Rule], language: Column | None = None) -> DataFrame:
    """First match of each rule that lies in no comment or string."""
    return files.select("file_id", F.inline(clear_hits(F.col("code"), rules, language)))


def score(weights: Column) -> Column:
    return F.greatest(F.lit(0), F.lit(100) - F.coalesce(weights, F.lit(0)))


def weight_column() -> Column:
    out = F.lit(1)
    for severity, w in WEIGHTS.items():
        out = F.when(F.col("severity") == severity, w).otherwise(out)
    return out


def scan_summary(files: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row per file, computed in the scan: language, scanned_lines, n_issues, score.

    No shuffle: the rules of a file are summed in its own row.
    """
    code = F.col("code")
    hit = [(possible(r, code, F.col("_low")) & code.rlike(r.pattern)).cast("int") for r in rules]
    taken = sum((h * WEIGHTS[r.severity] for h, r in zip(hit, rules)), F.lit(0))
    return files.withColumn("_low", F.lower(code)).select(
        "file_id", scanner_language(code).alias("language"), line_count(code).cast("long").alias("scanned_lines"),
        sum(hit, F.lit(0)).cast("long").alias("n_issues"), F.greatest(F.lit(0), 100 - taken).cast("long").alias("score"),
    )


def issues_per_file(files: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Findings gathered per file, the most severe first, rule order within."""
    found = scan_first(files, rules)
    return found.groupBy("file_id").agg(
        F.count("*").alias("n_issues"),
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("sev_rank", "rule_ord", "rule_id", "ln"))),
                lambda x: F.concat(x["rule_id"], F.lit("@"), x["ln"].cast("string")),
            ),
            ",",
        ).alias("issues"),
        F.sum(weight_column()).alias("deduction"),
    )
