"""Patches: validation, de-duplication, diffs and application."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codesieve.functions.text import cut_newlines, gather, let, normal_newlines, split_lines, trim_control
from codesieve.operators.copies import digest, distinct_texts, once_per_text

#: Parts of a body that is no implementation (fixed values).
FAKE_MARKERS = (
    "notimplementederror", "not implemented", "todo", "fixme", "raise notimplemented", "throw new unsupportedoperationexception",
    "// stub", "# ناقصة", "pass  #",
)
#: Lines that hold no logic: equal to, or starting with (fixed values).
EMPTY_LINES, EMPTY_STARTS = ("", "pass"), ("def ", "public ", "private ", "{", "}")
DIFF_CONTEXT = 3
#: What a verdict on a patch rests on, besides the file's text.
_JUDGED = ("before", "after", "start_line", "end_line", "allowed")


def _blank(c: Column) -> Column:
    return c.isNull() | (trim_control(c) == "")


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def fake_implementation(after: Column) -> Column:
    """Whether a body holds a marker or no logic at all."""
    low = F.lower(after)
    marked = _any([low.contains(m) for m in FAKE_MARKERS])

    def no_logic(x: Column) -> Column:
        t = trim_control(x)
        return t.isin(*EMPTY_LINES) | _any([t.startswith(s) for s in EMPTY_STARTS])

    return marked | F.forall(split_lines(trim_control(normal_newlines(after))), no_logic)


def validate(patches: DataFrame, files: DataFrame, candidates: DataFrame) -> DataFrame:
    """Adds reject_reason (null if accepted) to patches, duplicates included.

    ``candidates`` has file_id and function_name. The first failing test names
    the reason; of otherwise valid patches with one body per file (white space
    aside) the first by patch_no wins. Line numbers are 0-based, as models give them.

    Patches meet the digests of their files, and only distinct pairs of a patch and a
    text are judged.
    """
    allowed = candidates.select("file_id", "function_name").distinct().withColumn("allowed", F.lit(True))
    rows = patches.join(files.select("file_id", digest("code").alias("_text")), "file_id").join(allowed, ["file_id", "function_name"], "left")
    rows = rows.withColumn("_case", digest(F.hex("_text"), *_JUDGED))
    cases = rows.select("_case", "_text", *_JUDGED).distinct().join(distinct_texts(files, "code"), "_text")
    total = F.length(normal_newlines(F.col("code"))) - F.length(F.replace(normal_newlines(F.col("code")), F.lit("\n"), F.lit("")))
    total = total + F.when(F.col("code").rlike(r"[\r\n]\z") | (F.col("code") == ""), 1).otherwise(0)
    new_import = F.exists(
        split_lines(normal_newlines(F.col("after"))),
        lambda x: (trim_control(x).startswith("import ") | trim_control(x).startswith("using ")) & ~F.col("code").contains(trim_control(x)),
    )
    reason = (
        F.when(_blank(F.col("before")), "empty before")
        .when(_blank(F.col("after")), "empty after")
        .when(~F.col("code").contains(F.col("before")), "before is not in the file")
        .when(F.col("allowed").isNull(), "function is no candidate")
        .when(
            (F.col("start_line") < 0) | (F.col("end_line") < 0) | (F.col("start_line") > F.col("end_line")) | (F.col("end_line") > total),
            "bad line range",
        )
        .when(new_import, "unauthorised import")
        .when(fake_implementation(F.col("after")), "fake implementation")
    )
    body = F.regexp_replace(trim_control(F.coalesce("after", F.lit(""))), r"\s+", " ")
    judged = cases.select("_case", reason.alias("reason_so_far"), F.sha2(body, 256).alias("body"))
    checked = rows.select("_case", *patches.columns).join(judged, "_case")
    turn = F.row_number().over(Window.partitionBy("file_id", "body", F.col("reason_so_far").isNull()).orderBy("patch_no"))
    return checked.withColumn("turn", turn).select(
        *patches.columns,
        F.coalesce("reason_so_far", F.when(F.col("turn") > 1, "same body as an earlier patch")).alias("reject_reason"),
    )


def rejected_counts(files: DataFrame, validated: DataFrame) -> DataFrame:
    """Accepted and rejected patches per file; files without patches count zero."""
    n = validated.groupBy("file_id").agg(
        F.count_if(F.col("reject_reason").isNull()).alias("accepted"), F.count_if(F.col("reject_reason").isNotNull()).alias("rejected")
    )
    return files.select("file_id").join(n, "file_id", "left").select(
        "file_id", F.coalesce("accepted", F.lit(0)).alias("accepted"), F.coalesce("rejected", F.lit(0)).alias("rejected")
    )


def without_candidates(files: DataFrame, candidates: DataFrame) -> DataFrame:
    """Files that need no model call: an empty result row each."""
    return files.join(candidates.select("file_id").distinct(), "file_id", "left_anti").select(
        "file_id", F.lit(0).cast("long").alias("n_fixes"), F.lit(0).cast("long").alias("rejected")
    )


def diffs(patches: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, patch_no, diff): lines [start_line, end_line) and three around."""
    rows = patches.join(files.select("file_id", "code"), "file_id")

    def text(lines: Column) -> Column:
        first = F.greatest(F.lit(0), F.col("start_line") - DIFF_CONTEXT)
        last = F.least(F.size(lines), F.col("end_line") + DIFF_CONTEXT)
        shown = F.transform(
            F.slice(lines, first + 1, F.greatest(last - first, F.lit(0))),
            lambda x, i: F.concat(
                F.when((i + first >= F.col("start_line")) & (i + first < F.col("end_line")), "- ").otherwise("  "), x
            ),
        )
        added = F.transform(split_lines(cut_newlines(F.col("after"))), lambda x: F.concat(F.lit("+ "), x))
        head = F.array(
            F.concat(F.lit("--- "), F.col("function_name")),
            F.concat(F.lit("+++ "), F.col("function_name"), F.lit(" (modified)")),
            F.format_string("@@ -%d,%d +%d,? @@", "start_line", F.col("end_line") - F.col("start_line"), "start_line"),
        )
        return F.array_join(F.concat(head, shown, F.array(F.lit("--- change ---")), added), "\n")

    found = F.coalesce(F.col("code").contains(F.col("before")), F.lit(False))
    body = cut_newlines(F.col("code"))
    return rows.select(
        "file_id", "patch_no",
        F.when(found, let(split_lines(body), text)).otherwise("no diff: the text before is not in the file").alias("diff"),
    )


def _dedent(lines: Column) -> Column:
    """Lines without the indent that the first of them has."""

    def cut(ls: Column) -> Column:
        lead = F.length(F.regexp_extract(F.get(ls, 0), r"\A *", 0))
        return F.transform(ls, lambda x: F.when(F.length(F.regexp_extract(x, r"\A *", 0)) >= lead, F.substring(x, lead + 1, 1 << 30)).otherwise(x))

    return let(lines, cut)


_EDITS = "array<struct<lo:int,hi:int,text:string>>"


def edits_of(changes: Column) -> Column:
    """Edits (lo, hi, text) in order from an array of changes: lines lo to hi go, text
    comes ahead of line lo. An insertion and a replacement at one line become one edit."""

    def edit(c: Column) -> Column:
        whole = F.ltrim(c["suggestion"]).startswith(F.concat(F.lit("def "), c["name"]))
        empty = c["start_ln"] > c["end_ln"]
        lo = F.when(whole, c["def_ln"]).when(empty, c["end_ln"] + 1).otherwise(c["start_ln"])
        hi = F.when(whole | empty, c["end_ln"]).otherwise(c["start_ln"])
        lead = F.repeat(F.lit(" "), (c["base"] + F.when(whole, 0).otherwise(4)).cast("int"))
        text = F.array_join(F.transform(_dedent(split_lines(c["suggestion"])), lambda x: F.concat(lead, x)), "\n")
        return F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"), text.alias("text"))

    def merged(es: Column) -> Column:
        def one(e: Column, i: Column) -> Column:
            before, after = F.get(es, i - 1), F.get(es, i + 1)
            both = F.struct(e["lo"], after["hi"], F.concat(e["text"], F.lit("\n"), after["text"])).cast("struct<lo:int,hi:int,text:string>")
            return F.when(F.coalesce(before["lo"] == e["lo"], F.lit(False)), None).when(F.coalesce(after["lo"] == e["lo"], F.lit(False)), both).otherwise(e)

        return F.filter(F.transform(es, one), lambda e: e.isNotNull())

    return let(F.array_sort(F.transform(changes, edit)), merged)


def rebuilt(code: Column, edits: Column) -> Column:
    """The text after its edits: one fold walks lines and edits together."""
    none = F.array().cast("array<string>")

    def walk(x: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("turn"), F.lit(0).alias("gone"), none.alias("emit"))

        def step(s: Column, line: Column) -> Column:
            at = s["at"] + 1

            def meet(e: Column) -> Column:
                here = F.coalesce(e["lo"] == at, F.lit(False))
                gone = F.when(here, e["hi"]).otherwise(s["gone"])
                kept = F.filter(F.array(F.when(here, e["text"]), F.when(at > gone, line)), lambda t: t.isNotNull())
                return F.struct(
                    at.cast("int").alias("at"), (s["turn"] + here.cast("int")).alias("turn"), gone.cast("int").alias("gone"), kept.alias("emit")
                )

            return let(F.get(x["edits"], s["turn"]), meet)

        # A last insertion may stand behind the last line.
        lines = F.concat(x["lines"], F.array(F.lit(None).cast("string")))
        return let(lines, lambda ls: F.array_join(gather(ls, start, "array<string>", step, lambda s, out: out), "\n"))

    return let(F.struct(split_lines(code).alias("lines"), edits.alias("edits")), walk)


def apply_changes(files: DataFrame, changes: DataFrame) -> DataFrame:
    """(file_id, new_code, n_applied): all changes of a file in one rebuild.

    ``changes``: file_id, name, suggestion, def_ln, start_ln, end_ln, base. A
    suggestion that begins with the definition replaces the whole function;
    another one replaces the first statement, or fills an empty body, at the
    definition's indent plus four. Extents do not overlap, so order is free.
    """
    change = F.struct("name", "suggestion", "def_ln", "start_ln", "end_ln", "base")
    return applied(files.join(changes.groupBy("file_id").agg(F.collect_list(change).alias("changes")), "file_id"))


def applied(rows: DataFrame) -> DataFrame:
    """(file_id, new_code, n_applied) from rows of file_id, code and an array of changes."""
    return rows.select(
        "file_id", rebuilt(F.col("code"), edits_of(F.col("changes"))).alias("new_code"), F.size("changes").cast("long").alias("n_applied")
    )


def apply_own(files: DataFrame, changes: Column) -> DataFrame:
    """As ``apply_changes`` with changes that the file's code gives (an array): once
    per text, and no row for a file without one."""

    def made(c: Column) -> Column:
        done = F.struct(rebuilt(F.col("code"), edits_of(c)).alias("new_code"), F.size(c).cast("long").alias("n_applied"))
        return F.when(F.size(c) > 0, F.array(done))

    # A filter on the changes would have them worked out once more.
    return once_per_text(files, lambda texts: texts.select("file_id", F.inline(let(changes, made))))
