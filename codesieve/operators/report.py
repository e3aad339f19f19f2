"""Whole-file stub report: two folds over a file's lines, each linear."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.functions.text import fix_text, fixability, gather, intent, let, line_count, one_by_name, report_language, split_lines

#: A header up to its bracket, a line that ends its arguments, and a line of an
#: unfinished body (fixed values).
HEAD, CLOSES, UNFINISHED = r"\A(\s*+)def\s++(\w++)\s*+\(([\s\S]*+)", r"\A[^)]*+\).*:\s*+\z", r"\A(\s*+)(?:pass|\.\.\.)"
STEP = "    "
_MARKS = "array<struct<ln:int,is_def:boolean,key:string,name:string,end:int>>"


def _marks(lines: Column) -> Column:
    """Headers that are complete and unfinished lines, in order. Lines are read
    backwards, so the line on which open arguments close is known at each header."""
    none = F.array().cast(_MARKS)
    numbered = F.reverse(F.transform(lines, lambda x, i: F.struct((i + 1).cast("int").alias("ln"), x.alias("x"))))
    start = F.struct(F.lit(0).alias("end"), F.lit(False).alias("ok"), none.alias("emit"))

    def step(s: Column, l: Column) -> Column:
        x = l["x"]
        seen = F.struct(
            (x.contains("def") & x.rlike(HEAD)).alias("head"), ((x.contains("pass") | x.contains("...")) & x.rlike(UNFINISHED)).alias("idle"),
            x.contains(")").alias("closes"),
        )
        return let(seen, lambda v: mark(s, l, v))

    def mark(s: Column, l: Column, v: Column) -> Column:
        x = l["x"]
        arguments = F.regexp_extract(x, HEAD, 3)
        here = v["head"] & arguments.contains(")")
        whole = F.when(here, arguments.rlike(CLOSES) & (l["ln"] < F.size(lines))).otherwise(s["ok"])
        found = (
            F.when(
                v["head"] & whole,
                F.array(F.struct(l["ln"], F.lit(True), F.concat(F.regexp_extract(x, HEAD, 1), F.lit(STEP)), F.regexp_extract(x, HEAD, 2), F.when(here, l["ln"]).otherwise(s["end"]))).cast(_MARKS),
            )
            .when(v["idle"], F.array(F.struct(l["ln"], F.lit(False), F.regexp_extract(x, UNFINISHED, 1), F.lit(None).cast("string"), F.lit(0))).cast(_MARKS))
            .otherwise(none)
        )
        return F.struct(
            F.when(v["closes"], l["ln"]).otherwise(s["end"]).cast("int").alias("end"),
            F.when(v["closes"], x.rlike(CLOSES) & (l["ln"] < F.size(lines))).otherwise(s["ok"]).alias("ok"), found.alias("emit"),
        )

    return F.array_sort(let(numbered, lambda ls: gather(ls, start, _MARKS, step, lambda s, out: out)))


def _names(marks: Column) -> Column:
    """The sweep: a header opens if an unfinished line of its key comes later, and
    the first such line closes it; headers in between are passed over."""
    idle = F.transform(F.filter(marks, lambda m: ~m["is_def"]), lambda m: F.struct(m["key"].alias("name"), m["ln"].alias("ln")))
    last = let(one_by_name(idle, "ln", last=True), lambda xs: F.map_from_arrays(F.transform(xs, lambda x: x["name"]), F.transform(xs, lambda x: x["ln"])))
    none = F.array().cast("array<string>")
    start = F.struct(F.lit(False).alias("on"), F.lit("").alias("key"), F.lit(0).alias("end"), F.lit("").alias("name"), none.alias("emit"))

    def sweep(x: Column) -> Column:
        def step(s: Column, m: Column) -> Column:
            opens = ~s["on"] & m["is_def"] & F.coalesce(F.try_element_at(x["last"], m["key"]) > m["end"], F.lit(False))
            ends = s["on"] & ~m["is_def"] & (m["key"] == s["key"]) & (m["ln"] > s["end"])
            return let(
                F.struct(opens.alias("opens"), ends.alias("ends")),
                lambda v: F.struct(
                    ((s["on"] | v["opens"]) & ~v["ends"]).alias("on"), F.when(v["opens"], m["key"]).otherwise(s["key"]).alias("key"),
                    F.when(v["opens"], m["end"]).otherwise(s["end"]).alias("end"), F.when(v["opens"], m["name"]).otherwise(s["name"]).alias("name"),
                    F.when(v["ends"], F.array(s["name"])).otherwise(none).alias("emit"),
                ),
            )

        return gather(x["marks"], start, "array<string>", step, lambda s, out: out)

    return let(F.struct(marks.alias("marks"), last.alias("last")), sweep)


def stub_names(code: Column) -> Column:
    """Names of definitions with a line below, at their indent plus four, that begins
    with pass or '...'. The next definition is looked for behind that line. Blank
    lines ahead of a definition are no part of its indent."""
    none = F.array().cast("array<string>")
    possible = code.contains("def") & (code.contains("pass") | code.contains("..."))
    return F.when(possible, let(split_lines(code), lambda lines: let(_marks(lines), _names))).otherwise(none)


def function_analysis(files: DataFrame) -> DataFrame:
    """One row per reported function: name, fixability, intent, texts, can_auto_fix."""
    rows = files.select("file_id", F.posexplode(stub_names(F.col("code"))).alias("pos", "name"))
    fix = fixability(F.col("name"))
    return rows.select(
        "file_id", "pos", "name", F.lit("confirmed").alias("risk"), fix.alias("fixability"), intent(F.col("name")).alias("intent"),
        fix_text(fix, 0).alias("fix_reason"), fix_text(fix, 1).alias("warning_note"), fix_text(fix, 2).alias("signal"),
        (fix == "HIGH").alias("can_auto_fix"),
    )


def report(files: DataFrame) -> DataFrame:
    """One row per file: counts by fixability, message and recommendation. No shuffle."""
    names = stub_names(F.col("code"))
    rows = files.select(
        "file_id", report_language(F.col("code")).alias("language"), line_count(F.col("code")).cast("long").alias("total_lines"),
        F.transform(names, fixability).alias("fix"),
    )

    def count(kind: str) -> Column:
        return F.size(F.filter("fix", lambda x: x == kind)).cast("long")

    n = F.size("fix")
    return rows.select(
        "file_id", "language", "total_lines", n.cast("long").alias("n_stubs"), count("HIGH").alias("high_fixable"),
        count("MEDIUM").alias("medium_fixable"), count("LOW").alias("low_fixable"),
        F.when(n == 0, "no unfinished function found").otherwise(
            F.format_string(
                "%d unfinished functions: %d clear, %d to review, %d hard", n, count("HIGH"), count("MEDIUM"), count("LOW")
            )
        ).alias("message"),
        F.when(n == 0, "the file looks complete").otherwise("review each proposal before approval").alias("recommendation"),
    )
