"""Function extents in Python and JavaScript as one fold over a file's lines.

Each file is one row, and its lines are an array in that row: the fold reads each
line once, carries a small state and needs no shuffle, no self-join and no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.functions.text import clean_params, count_of, cut_newlines, gather, indent_spaces, indent_width, let, one_by_name, split_lines, strip_comment, trim_control
from codesieve.operators.copies import once_per_text

#: Methods that are no stubs whatever their body (fixed values).
SKIPPED = ("__init__", "__del__", "__repr__", "__str__", "__eq__", "__hash__")

_PY_OUT = "array<struct<name:string,def_ln:int,sig_ln:int,body_ln:int,end_ln:int,base:int,first:string>>"


def line_structs(code: Column) -> Column:
    """Per line: ln, t (trimmed), ind, colon (ends with ':' without its comment)."""
    return F.transform(
        split_lines(code),
        lambda x, i: F.struct(
            (i + 1).cast("int").alias("ln"), trim_control(x).alias("t"), indent_width(x).cast("int").alias("ind"),
            trim_control(strip_comment(x)).endswith(":").alias("colon"),
        ),
    )


def _marks(t: Column, start: bool) -> Column:
    if start:
        return t.startswith('"""') | t.startswith("'''")
    return t.endswith('"""') | t.endswith("'''")


def python_functions(code: Column) -> Column:
    """struct(total, found): visited definitions and those with a signature.

    ``total`` counts visited definitions before any filter. A definition inside
    a visited body is not visited. A signature runs to the first line that ends
    with ':'; a one-line ``def f(): pass`` has none of its own and takes the next.
    body_ln is the first statement after blanks, comments and docstrings; without
    one ``first`` is null. end_ln is the line before the next statement at or
    below the definition's indent, else the last line of code.
    """

    def fold(bound: Column) -> Column:
        lines, last_colon = bound["lines"], bound["last_colon"]
        n = F.size(lines)
        start = F.struct(
            F.lit(0).alias("mode"), F.lit("").alias("name"), F.lit(0).alias("def_ln"), F.lit(0).alias("base"), F.lit(0).alias("sig_ln"),
            F.lit(0).alias("body_ln"), F.lit("").alias("first"), F.lit(0).alias("last"), F.lit(0).alias("total"),
            F.array().cast(_PY_OUT).alias("emit"),
        )

        def found(s: Column, body_ln: Column, end_ln: Column, first: Column) -> Column:
            return F.struct(
                s["name"].alias("name"), s["def_ln"].alias("def_ln"), s["sig_ln"].alias("sig_ln"), body_ln.cast("int").alias("body_ln"),
                end_ln.cast("int").alias("end_ln"), s["base"].alias("base"), first.alias("first"),
            )

        def step(s: Column, l: Column) -> Column:
            t, mode = l["t"], s["mode"]
            statement = (t != "") & ~t.startswith("#")
            seen = F.struct(
                statement.alias("statement"), _marks(t, True).alias("doc"), (statement & (l["ind"] <= s["base"])).alias("leaves")
            )
            return let(seen, lambda v: close(s, l, v))

        def close(s: Column, l: Column, v: Column) -> Column:
            """What ends at this line: a body, or a signature without one."""
            mode = s["mode"]
            ended = F.struct(
                ((mode == 4) & v["leaves"]).alias("closes"), ((mode == 2) & v["leaves"] & ~v["doc"]).alias("bare"),
            )
            return let(ended, lambda e: opening(s, l, v, e))

        def opening(s: Column, l: Column, v: Column, e: Column) -> Column:
            """Whether a definition begins at this line."""
            t = l["t"]
            fresh = (s["mode"] == 0) | e["closes"] | e["bare"]
            is_async = t.startswith("async def ")
            is_def = fresh & (is_async | t.startswith("def "))
            after = F.when(is_async, F.substring(t, 11, 1 << 30)).otherwise(F.substring(t, 5, 1 << 30))
            name = F.when(is_def & after.contains("("), trim_control(F.substring_index(after, "(", 1)))
            found_here = F.struct(fresh.alias("fresh"), is_def.alias("is_def"), name.alias("name"))
            return let(
                found_here,
                lambda d: let(
                    d["name"].isNotNull() & ~F.coalesce(d["name"], F.lit("")).isin(*SKIPPED) & (l["ln"] <= last_colon),
                    lambda opens: moved(s, l, v, e, d, opens),
                ),
            )

        def moved(s: Column, l: Column, v: Column, e: Column, d: Column, opens: Column) -> Column:
            t, mode, fresh = l["t"], s["mode"], d["fresh"]
            begins_body = ~fresh & (mode == 2) & v["statement"] & ~v["doc"]
            new_mode = (
                F.when(opens, F.when(l["colon"], 2).otherwise(1))
                .when(fresh, 0)
                .when((mode == 1) & l["colon"], 2)
                .when((mode == 2) & v["doc"] & (~_marks(t, False) | (F.length(t) < 6)), 3)
                .when((mode == 3) & _marks(t, False), 2)
                .when(begins_body, 4)
                .otherwise(mode)
            )
            emit = (
                F.when(e["closes"], F.array(found(s, s["body_ln"], l["ln"] - 1, s["first"])))
                .when(e["bare"], F.array(found(s, l["ln"], l["ln"] - 1, F.lit(None).cast("string"))))
                .otherwise(F.array().cast(_PY_OUT))
            )
            return F.struct(
                new_mode.cast("int").alias("mode"),
                F.when(opens, d["name"]).otherwise(s["name"]).alias("name"),
                F.when(opens, l["ln"]).otherwise(s["def_ln"]).cast("int").alias("def_ln"),
                F.when(opens, l["ind"]).otherwise(s["base"]).cast("int").alias("base"),
                F.when(l["colon"] & (opens | ((mode == 1) & ~fresh)), l["ln"]).otherwise(s["sig_ln"]).cast("int").alias("sig_ln"),
                F.when(begins_body, l["ln"]).otherwise(s["body_ln"]).cast("int").alias("body_ln"),
                F.when(begins_body, t).otherwise(s["first"]).alias("first"),
                F.when(begins_body | ((mode == 4) & v["statement"]), l["ln"]).otherwise(s["last"]).cast("int").alias("last"),
                (s["total"] + d["is_def"].cast("int")).alias("total"),
                emit.alias("emit"),
            )

        def finish(s: Column, out: Column) -> Column:
            last = (
                F.when(s["mode"] == 4, F.array(found(s, s["body_ln"], s["last"], s["first"])))
                .when(s["mode"].isin(2, 3), F.array(found(s, n + 1, s["sig_ln"], F.lit(None).cast("string"))))
                .otherwise(F.array().cast(_PY_OUT))
            )
            return F.struct(s["total"].alias("total"), F.concat(out, last).alias("found"))

        return gather(lines, start, _PY_OUT, step, finish)

    empty = F.struct(F.lit(0).alias("total"), F.array().cast(_PY_OUT).alias("found"))
    return F.when(trim_control(F.coalesce(code, F.lit(""))) == "", empty).otherwise(
        let(line_structs(code), lambda lines: let(F.struct(lines.alias("lines"), _last_colon(lines).alias("last_colon")), fold))
    )


def _last_colon(lines: Column) -> Column:
    """Number of the last line that can end a signature, 0 without one."""
    return F.coalesce(F.array_max(F.transform(F.filter(lines, lambda l: l["colon"]), lambda l: l["ln"])), F.lit(0))


_JS_OUT = "array<struct<name:string,ln:int,brace:int,end_ln:int,header:string>>"
JS_FUNCTION = r"\A(?:async\s+)?function\s+\w+"
JS_VARIABLE = r"\A(?:const|let|var)\s+\w+\s*="


def javascript_functions(code: Column) -> Column:
    """Functions and variables with a block that opens within three lines.

    The extent ends with the first line on which as many braces have closed as
    opened; braces in strings count. ``body`` is the text after the first '{',
    without braces and with single spaces.
    """

    def fold(lines: Column) -> Column:
        none = F.array().cast(_JS_OUT)
        start = F.struct(
            F.lit(False).alias("on"), F.lit("").alias("name"), F.lit(0).alias("ln"), F.lit(0).alias("brace"), F.lit(0).alias("depth"),
            F.lit("").alias("header"), F.lit(0).alias("at"), none.alias("emit"),
        )

        def made(s: Column, end: Column) -> Column:
            return F.array(
                F.struct(
                    s["name"].alias("name"), s["ln"].cast("int").alias("ln"), s["brace"].cast("int").alias("brace"), end.cast("int").alias("end_ln"),
                    s["header"].alias("header"),
                )
            )

        def step(s: Column, x: Column) -> Column:
            at = s["at"] + 1
            t = trim_control(x)
            name = F.when(
                t.rlike(JS_FUNCTION), F.when(t.contains("("), trim_control(F.substring_index(F.regexp_replace(t, r"\A(?:async\s+)?function\s+", ""), "(", 1)))
            ).when(t.rlike(JS_VARIABLE), trim_control(F.substring_index(F.regexp_replace(t, r"\A(?:const|let|var)\s+", ""), "=", 1)))
            second, third = F.coalesce(F.get(lines, at), F.lit("")), F.coalesce(F.get(lines, at + 1), F.lit(""))
            brace = (
                F.when(x.contains("{"), at).when(x.contains("=>"), 0).when(second.contains("{"), at + 1).when(second.contains("=>"), 0)
                .when(third.contains("{"), at + 2).otherwise(0)
            )
            head = F.when(~s["on"], F.struct(F.coalesce(name, F.lit("")).alias("name"), brace.alias("brace")))
            return let(
                head, lambda h: let(~s["on"] & (F.coalesce(h["name"], F.lit("")) != "") & (h["brace"] > 0), lambda begins: advance(s, x, t, at, h, begins))
            )

        def advance(s: Column, x: Column, t: Column, at: Column, h: Column, begins: Column) -> Column:
            def go(c: Column) -> Column:
                counts = c["on"] & (at >= c["brace"])
                depth = F.when(counts, c["depth"] + count_of(x, "{") - count_of(x, "}")).otherwise(c["depth"])
                moved = F.struct(
                    c["on"].alias("on"), c["name"].alias("name"), c["ln"].alias("ln"), c["brace"].alias("brace"),
                    depth.cast("int").alias("depth"), c["header"].alias("header"), (counts & (depth == 0)).alias("ends"),
                )
                return let(
                    moved,
                    lambda m: F.struct(
                        (m["on"] & ~m["ends"]).alias("on"), m["name"].alias("name"), m["ln"].cast("int").alias("ln"),
                        m["brace"].cast("int").alias("brace"), m["depth"].cast("int").alias("depth"), m["header"].alias("header"),
                        at.cast("int").alias("at"), F.when(m["ends"], made(m, at)).otherwise(none).alias("emit"),
                    ),
                )

            current = F.struct(
                (s["on"] | begins).alias("on"), F.when(begins, h["name"]).otherwise(s["name"]).alias("name"),
                F.when(begins, at).otherwise(s["ln"]).alias("ln"), F.when(begins, h["brace"]).otherwise(s["brace"]).alias("brace"),
                F.when(begins, 0).otherwise(s["depth"]).alias("depth"),
                F.when(begins, F.substring(t, 1, 80)).otherwise(s["header"]).alias("header"),
            )
            return let(current, go)

        def body(d: Column) -> Column:
            opening = F.regexp_replace(F.get(lines, d["brace"] - 1), r"\A[^{]*\{", "")
            rest = F.slice(lines, d["brace"] + 1, d["end_ln"] - d["brace"])
            text = F.array_join(F.concat(F.array(opening), rest), "\n")
            return trim_control(F.regexp_replace(F.regexp_replace(text, r"[{}]", ""), r"\s+", " "))

        extents = gather(
            lines, start, _JS_OUT, step, lambda s, out: F.concat(out, F.when(s["on"], made(s, s["at"])).otherwise(none))
        )
        return F.transform(
            extents,
            lambda d: F.struct(
                d["name"].alias("name"), d["ln"].alias("ln"), d["end_ln"].alias("end_ln"), body(d).alias("body"), d["header"].alias("header")
            ),
        )

    return let(split_lines(F.coalesce(code, F.lit(""))), fold)


DEF_PATTERN = r"def\s+(\w+)\s*\(([^)]*)\)"


def params_of(code: Column) -> Column:
    """array<struct(name, params)> of a text: the last definition of a name wins."""
    names = F.regexp_extract_all(code, F.lit(DEF_PATTERN), F.lit(1))
    raws = F.regexp_extract_all(code, F.lit(DEF_PATTERN), F.lit(2))
    pairs = let(
        raws, lambda rs: F.transform(names, lambda n, i: F.struct(n.alias("name"), i.alias("at"), F.get(rs, i).alias("raw")))
    )
    return F.transform(
        one_by_name(pairs, "at", last=True), lambda x: F.struct(x["name"].alias("name"), clean_params(x["raw"]).alias("params"))
    )


def function_params(files: DataFrame) -> DataFrame:
    """(file_id, name, params): the last definition of a name wins."""
    return once_per_text(files, lambda texts: texts.select("file_id", F.inline(params_of(F.col("code")))))


def imports(files: DataFrame) -> DataFrame:
    """(file_id, pos, imported): line-leading import and from statements."""
    found = F.regexp_extract_all("code", F.lit(r"(?m)^(?:import|from)\s+(.+)"), F.lit(1))
    return files.select("file_id", F.posexplode(found).alias("pos", "raw")).select("file_id", "pos", trim_control(F.col("raw")).alias("imported"))


def classes(files: DataFrame) -> DataFrame:
    """(file_id, pos, class_name): classes at column 0."""
    found = F.regexp_extract_all("code", F.lit(r"(?m)^class\s+(\w+)"), F.lit(1))
    return files.select("file_id", F.posexplode(found).alias("pos", "class_name"))


def class_members(files: DataFrame) -> DataFrame:
    """(file_id, ln, name, in_class): for each ``def name(`` whether the nearest
    column-0 statement above it is a class."""

    def fold(lines: Column) -> Column:
        kind = "array<struct<ln:int,name:string,in_class:boolean>>"
        start = F.struct(F.lit(False).alias("inside"), F.array().cast(kind).alias("emit"))

        def step(s: Column, p: Column) -> Column:
            x = p["x"]
            t = trim_control(x)
            top = (t != "") & ~x.startswith(" ") & ~x.startswith("\t")
            name = F.regexp_extract(t, r"\Adef (\w+)\(", 1)
            inside = F.when(top, t.startswith("class ")).otherwise(s["inside"])
            member = F.struct(p["ln"].alias("ln"), name.alias("name"), (~top & s["inside"]).alias("in_class"))
            return F.struct(inside.alias("inside"), F.when(name != "", F.array(member)).otherwise(F.array().cast(kind)).alias("emit"))

        return gather(lines, start, kind, step, lambda s, out: out)

    numbered = F.transform(split_lines(F.col("code")), lambda x, i: F.struct((i + 1).cast("int").alias("ln"), x.alias("x")))
    return once_per_text(files, lambda texts: texts.select("file_id", F.inline(let(numbered, fold))))


_OPEN = "array<struct<name:string,ln:int,base:int>>"
_CLOSED = "array<struct<name:string,ln:int,end_ln:int>>"


def bodies_of(code: Column) -> Column:
    """array<struct(name, ln, body)> of a text: from a name's first ``def`` to the
    line before the next statement at or left of it. Indents count spaces only.

    One fold: a line closes the open definitions that it is not deeper than, and
    those are as few as definitions are nested.
    """

    def extents(lines: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast(_OPEN).alias("open"), F.array().cast(_CLOSED).alias("emit"))

        def closed(open_: Column, end: Column) -> Column:
            return F.transform(
                open_, lambda d: F.struct(d["name"].alias("name"), d["ln"].alias("ln"), end.cast("int").alias("end_ln"))
            )

        def step(s: Column, x: Column) -> Column:
            t = trim_control(x)
            line = F.struct(
                ((t != "") & ~t.startswith("#")).alias("live"), indent_spaces(x).alias("ind"),
                F.regexp_extract(x, r"\A\s*def\s+(\w+)\s*\(", 1).alias("name"), F.length(F.regexp_extract(x, r"\A\s*", 0)).alias("base"),
            )
            return let(line, lambda l: advance(s, l, s["at"] + 1))

        def advance(s: Column, l: Column, at: Column) -> Column:
            ended = F.when(l["live"], F.filter(s["open"], lambda d: d["base"] >= l["ind"])).otherwise(F.array().cast(_OPEN))
            still = F.when(l["live"], F.filter(s["open"], lambda d: d["base"] < l["ind"])).otherwise(s["open"])
            new = F.struct(l["name"].alias("name"), at.cast("int").alias("ln"), l["base"].cast("int").alias("base"))
            return F.struct(
                at.cast("int").alias("at"),
                F.when(l["name"] != "", F.concat(still, F.array(new))).otherwise(still).alias("open"),
                closed(ended, at - 1).alias("emit"),
            )

        return gather(lines, start, _CLOSED, step, lambda s, out: F.concat(out, closed(s["open"], s["at"])))

    def texts(lines: Column) -> Column:
        return F.transform(
            one_by_name(extents(lines), "ln"),
            lambda d: F.struct(
                d["name"].alias("name"), d["ln"].alias("ln"),
                F.concat(F.array_join(F.slice(lines, d["ln"], d["end_ln"] - d["ln"] + 1), "\n"), F.lit("\n")).alias("body"),
            ),
        )

    return let(split_lines(cut_newlines(code)), texts)


def function_bodies(files: DataFrame) -> DataFrame:
    """(file_id, name, body): see ``bodies_of``."""
    return once_per_text(files, lambda texts: texts.select("file_id", F.inline(bodies_of(F.col("code")))).drop("ln"))


def signatures(code: Column, language: Column) -> Column:
    """Set of signatures of a text, by language."""

    def of(test: Column, value: Column) -> Column:
        return F.when(test, value)

    def per_line(x: Column) -> Column:
        t = trim_control(x)
        flat = F.regexp_replace(t, r"\s+", " ")
        python = (t.startswith("def ") | t.startswith("async def ")) & t.contains(":")
        return (
            F.when(language == "PYTHON", of(python, trim_control(F.substring_index(t, ":", 1))))
            .when(language.isin("JAVA", "KOTLIN"), of(t.contains("(") & t.contains(")"), flat))
            .when(language == "JAVASCRIPT", of(t.contains("function") | t.contains("=>"), flat))
        )

    found = F.transform(split_lines(F.coalesce(code, F.lit(""))), per_line)
    return F.array_sort(F.array_distinct(F.filter(found, lambda s: s.isNotNull())))
