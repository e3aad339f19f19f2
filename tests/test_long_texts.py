"""Long literals, long functions and long runs of one character: no operator may
need a stack or a square of the length."""

import time

import pytest
from pyspark.sql import functions as F

from codesieve.functions import text
from codesieve.operators import functions, guard, report, workflow
from codesieve.operators.rules import CONTENT, GUARD, POLICY, SECURITY

MEGA = 1 << 20
ESCAPED = '\\"' * (MEGA // 2)


def files(spark, rows):
    return spark.createDataFrame([(i, "r", p, c) for i, (p, c) in enumerate(rows)], "file_id long, repo string, path string, code string").repartition(4)


BALANCED = [
    ("a.py", 'x = "' + "({[" * (MEGA // 3) + '"\n', True),
    ("a.py", f'x = f("{ESCAPED}")\n', True),
    ("a.py", "x = '''" + ")\n" * (MEGA // 2) + "'''\n", True),
    ("a.py", "# " + "(" * MEGA + "\nx = 1\n", True),
    ("a.py", 'x = "' + "a" * MEGA + "\n", False),
    ("a.py", '"' + ESCAPED + "\n", False),
    ("a.js", "const x = `" + "${a}(\n" * (MEGA // 6) + "`;\n", True),
    ("a.js", "const x = `" + "\\`" * (MEGA // 2) + "`;\n", True),
    ("a.js", "const x = `" + "\\`" * (MEGA // 2), False),
    ("a.js", "f('" + "\\'" * (MEGA // 2) + "');\n", True),
    ("a.java", "/* " + "*(\n" * (MEGA // 3) + "*/ class A {}\n", True),
    ("a.java", "class A {} " + "/* " * (MEGA // 3), True),
    ("a.kt", "val x = \"" + "a\\\\" * (MEGA // 3) + "\"\n", True),
    ("a.html", "<html>" + "<!-- (" * (MEGA // 6) + "-->", True),
    ("a.html", "<html>" + "<!-- (" * (MEGA // 6), True),
    ("a.txt", '"' + "\\a" * (MEGA // 2) + '"', True),
    ("a.js", "f(" * (MEGA // 64) + ")" * (MEGA // 64), True),
]


def test_balance_of_megabytes(spark):
    df = files(spark, [(p, c) for p, c, _ in BALANCED])
    language = text.guard_language(F.col("code"), F.col("path"))
    got = {r.file_id: r.ok for r in df.select("file_id", guard.balanced(F.col("code"), language).alias("ok")).collect()}
    assert got == {i: ok for i, (_, _, ok) in enumerate(BALANCED)}


SIGNATURES = [
    ("a.java", " " * MEGA + "void f(int a) {\n}\n", "void f(int a) {"),
    ("a.java", "public " * (MEGA // 7) + "void f(int a)", "public " * (MEGA // 7) + "void f(int a)"),
    ("a.java", "a" * MEGA + " f(b)", "a" * MEGA + " f(b)"),
    ("a.java", "f(" * (MEGA // 2), None),
    ("a.java", "g(x) " * (MEGA // 5) + "f(y)", "f(y)"),
    ("a.java", "<" * MEGA + "> f(y) throws " + "E, " * 1000, "<" * MEGA + "> f(y) throws " + ("E, " * 1000).strip()),
    ("a.py", "def" + " " * MEGA + "f(a):\n", "def f(a):"),
    ("a.py", "def f(" * (MEGA // 6), None),
    ("a.py", "def f(a) " * (MEGA // 9) + "\n", None),
    ("a.py", "def f(a) -> " * (MEGA // 12) + "\n", None),
    ("a.py", "def g(\n" + "    a,\n" * (MEGA // 7) + "):\n    pass\ndef f(b) -> c:\n", "def f(b) -> c:"),
    ("a.js", "f = (" * (MEGA // 5), None),
    ("a.js", "f = (a) " * (MEGA // 8) + "f = (b) => {", "f = (b) => {"),
    ("a.js", "function" + " " * MEGA + "f(a) {", "function f(a) {"),
    ("a.js", "f" * MEGA + " = function(a) {", "f = function(a) {"),
]


def test_signatures_of_megabytes(spark):
    df = files(spark, [(p, c) for p, c, _ in SIGNATURES])
    language = text.guard_language(F.col("code"), F.col("path"))
    began = time.time()
    got = {r.file_id: r.s for r in df.select("file_id", guard.signature_of(F.col("code"), F.lit("f"), language).alias("s")).collect()}
    assert {i: s for i, s in got.items()} == {i: s for i, (_, _, s) in enumerate(SIGNATURES)}
    assert time.time() - began < 120


@pytest.mark.parametrize("indent", ["", "    "])
def test_report_of_a_hundred_thousand_lines(spark, indent):
    body = f"{indent}    x = 1\n" * 100_000
    rows = [
        ("a.py", f"{indent}def big(a):\n{body}{indent}def small(b):\n{indent}    return 2\n"),
        ("a.py", f"{indent}def big(a):\n{body}{indent}    pass\n{indent}def small(b):\n{indent}    ...\n"),
        ("a.py", f"{indent}def f(a):\n" * 50_000),
        ("a.py", f"{indent}def f(\n" * 50_000 + f"{indent}    pass\n"),
        ("a.py", f"{indent}def f(a):\n{indent}    pass\n" * 20_000),
    ]
    got = {r.file_id: r.n_stubs for r in report.report(files(spark, rows)).collect()}
    assert got == {0: 0, 1: 2, 2: 0, 3: 0, 4: 20_000}


def test_whole_reports_of_long_files(spark):
    rows = [(p, c) for p, c, _ in BALANCED] + [(p, c) for p, c, _ in SIGNATURES]
    df = files(spark, rows)
    assert guard.guard_report(df).count() == len(rows)
    versions = df.select(
        "file_id", F.col("code").alias("original"), F.col("code").alias("modified"), "path", F.lit(1).alias("start_line"),
        F.lit(1).alias("end_line"), F.lit("f").alias("function_name"),
    )
    got = {r.file_id: r.n_checks for r in guard.guard_compare(versions).collect()}
    assert len(got) == len(rows) and min(got.values()) >= 4
    assert report.report(df).count() == len(rows)
    stub = files(spark, [("a.py", "def f(a):\n    pass\nx = '" + "\\'" * (MEGA // 2) + "'\n")])
    assert [r.function_name for r in workflow.workflow_items(stub).collect()] == ["f"]


RUNS = ("a", "Z", "0", " ", "\t", "\n", "\r", "_", "-", ".", "(", ")", "[", "{", "}", "<", ">", '"', "'", "`", "\\", "/", "*", "#", "=", ":", ",", "%", "+", "é", "漢", "😀", "\u2028", "\x00")


def test_each_pattern_over_a_megabyte_of_each_character(spark):
    """Also behind the start of a literal, where a pattern enters a repetition."""
    df = files(spark, [("a", lead + c * MEGA) for c in RUNS for lead in ("", "def f(a", '"')])
    patterns = [r.pattern for pack in (SECURITY, POLICY, CONTENT, *GUARD.values()) for r in pack]
    patterns += [functions.DEF_PATTERN, functions.JS_FUNCTION, functions.JS_VARIABLE, *guard.NOISE.values(), report.HEAD, report.CLOSES, report.UNFINISHED]
    patterns += [guard._BACK_TYPED, guard._BACK_UNTYPED, guard._BACK_DEF, guard._AFTER_JAVA, guard._JS_HEADER]
    hits = df.select(*[F.sum(F.length(F.regexp_replace("code", p, ""))).alias(f"p{i}") for i, p in enumerate(patterns)]).first()
    assert all(v is not None for v in hits)


