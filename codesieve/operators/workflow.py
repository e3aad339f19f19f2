"""The gate cascade from stub to approval, and the replay of decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codesieve.functions.text import guard_language, let
from codesieve.operators.copies import digest, distinct_texts, once_per_text
from codesieve.operators.guard import direct_checks, report_of
from codesieve.operators.patches import applied
from codesieve.operators.stubs import proposals, proposals_of, refine, types_of
from codesieve.operators.verdict import content_of, policy_of


def workflow_items(files: DataFrame) -> DataFrame:
    """One row per stub: stage, label, progress, blocked reason, suggestion.

    Gates are computed once per text, in the order content, policy, suggestion
    guard; the first that blocks decides. All of it stays in the text's row.
    """
    return once_per_text(files, _items)


def _items(files: DataFrame) -> DataFrame:
    code = F.col("code")

    def items_of(x: Column) -> Column:
        def one(s: Column, names: Column) -> Column:
            t = F.get(x["types"], (F.array_position(names, s["name"]) - 1).cast("int"))
            text = F.when(t["dominant"].isNull(), s["suggestion"]).otherwise(refine(s["suggestion"], t["dominant"], t["param"]))
            return F.struct(
                s["name"].alias("name"), s["reason"].alias("reason"), text.alias("suggestion"),
                x["content"]["blocked"].alias("unlawful"), x["content"]["message"].alias("content_message"),
                (x["policy"]["verdict"] == "BLOCKED").alias("refused"), x["policy"]["summary"].alias("policy_summary"),
            )

        names = F.transform(x["types"], lambda t: t["name"])
        return let(names, lambda ns: F.transform(x["stubs"], lambda s: one(s, ns)))

    # Bound once per text: after the explode a mention would be evaluated per stub.
    bound = F.struct(
        content_of(code).alias("content"), policy_of(code).alias("policy"), types_of(code).alias("types"), proposals_of(code).alias("stubs")
    )
    items = files.select("file_id", F.posexplode(let(bound, items_of)).alias("pos", "s")).select("file_id", "pos", "s.*")
    checks = let(F.col("suggestion"), lambda t: direct_checks(t, guard_language(t)))
    rows = report_of(items.select(*items.columns, checks.alias("checks")), items.columns).select(
        *items.columns, "safety_score", F.col("verdict").alias("guard"), F.col("blocked_reason").alias("guard_reason")
    )
    gate = (
        F.when(F.col("unlawful"), "content").when(F.col("refused"), "policy").when(F.col("guard") == "BLOCKED", "guard").otherwise("none")
    )
    rows = rows.withColumn("gate", gate)
    late = F.col("gate").isin("guard", "none")
    return rows.select(
        "file_id", "pos", F.col("name").alias("function_name"),
        F.when(F.col("gate") == "none", "AWAITING_APPROVAL").otherwise("BLOCKED").alias("stage"),
        F.when(F.col("gate") == "content", "blocked by content").when(F.col("gate") == "policy", "policy violation")
        .when(F.col("gate") == "guard", "blocked by guard").otherwise("waiting for approval").alias("label"),
        F.when(F.col("gate") == "none", 90).otherwise(100).cast("long").alias("progress"),
        F.when(F.col("gate") == "content", F.col("content_message")).when(F.col("gate") == "policy", F.col("policy_summary"))
        .when(F.col("gate") == "guard", F.col("guard_reason")).alias("blocked_reason"),
        F.when(late, F.col("suggestion")).alias("suggestion"),
        F.when(late, F.col("safety_score")).alias("safety_score"),
        F.when(
            F.col("gate") == "none",
            F.format_string(
                "Function \"%s()\" is unfinished (%s). Safety score %d of 100. The proposal rests on the name and its context.",
                "name", "reason", "safety_score",
            ),
        ).alias("explanation"),
    )


def name_proposals(files: DataFrame) -> DataFrame:
    """Proposals by name alone, without a guard: score 100."""
    return proposals(files).select(
        "file_id", "pos", F.col("name").alias("function_name"), F.col("snippet").alias("before"), F.col("suggestion").alias("after"),
        F.concat(F.lit("proposal by name: "), F.col("reason")).alias("explanation"), F.lit(100).cast("long").alias("safety_score"),
    )


def review_counters(decisions: DataFrame) -> DataFrame:
    """Running approved, rejected and position per session, in decision order.

    A session's days are summed first and carry over, so a task holds one day of
    one session, not a whole session.
    """
    approved, rejected = F.col("approved").cast("int"), (~F.col("approved")).cast("int")
    rows = decisions.withColumn("day", F.to_date("ts"))
    totals = rows.groupBy("session_id", "day").agg(F.count("*").alias("n"), F.count_if("approved").alias("a"), F.count_if(~F.col("approved")).alias("r"))
    before = Window.partitionBy("session_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        F.col("session_id").alias("s"), F.col("day").alias("d"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("n", "a", "r")]
    )
    w = Window.partitionBy("session_id", "day").orderBy("ts", "version_id").rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(carried, F.col("session_id").eqNullSafe(F.col("s")) & F.col("day").eqNullSafe(F.col("d")))
    return joined.select(
        "session_id", "version_id", (F.count("*").over(w) + F.col("n_before")).alias("position"),
        (F.sum(approved).over(w) + F.col("a_before")).alias("approved_so_far"), (F.sum(rejected).over(w) + F.col("r_before")).alias("rejected_so_far"),
    )


def last_decisions(decisions: DataFrame) -> DataFrame:
    """(file_id, function_name, approved): the last decision on each function."""
    return decisions.groupBy("file_id", "function_name").agg(F.max_by("approved", F.struct("ts", "seq")).alias("approved"))


def apply_decisions(files: DataFrame, decisions: DataFrame) -> DataFrame:
    """(file_id, new_code, n_applied) for files with an approved proposal.

    Approved proposals of a file are applied in one rebuild; rejected ones change
    nothing and stay in the decision log. Proposals are made once per text, and texts
    come only to the files that are rebuilt.
    """
    approved = last_decisions(decisions).where("approved").select("file_id", F.col("function_name").alias("name"))
    texts = distinct_texts(files, "code")
    found = texts.select("_text", F.explode(proposals_of(F.col("code"))).alias("change")).where("change.language = 'python'")
    found = found.select("_text", F.col("change.name").alias("name"), "change")
    rows = files.select("file_id", digest("code").alias("_text")).join(approved, "file_id").join(found, ["_text", "name"])
    changes = rows.groupBy("file_id", "_text").agg(F.collect_list("change").alias("changes"))
    return applied(changes.join(texts, "_text"))


def replay(decisions: DataFrame, items: DataFrame) -> DataFrame:
    """Last decision of each (file_id, function_name) joined to its item."""
    return items.join(last_decisions(decisions), ["file_id", "function_name"])
