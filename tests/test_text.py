"""Hand cases of the text functions."""

from pyspark.sql import functions as F

from codesieve.functions import text


def apply(spark, column, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string").coalesce(1)
    return [r[1] for r in df.select("i", column(F.col("c"))).orderBy("i").collect()]


def test_trim_cuts_control_characters(spark):
    assert apply(spark, text.trim_control, [" \t a \r", "", "\n\n", "é\x00"]) == ["a", "", "", "é"]


def test_line_count(spark):
    assert apply(spark, text.line_count, ["", "\n\n", "a", "a\n\n", "a\nb\n", "\na"]) == [1, 0, 1, 1, 2, 2]


def test_normal_newlines(spark):
    assert apply(spark, text.normal_newlines, ["a\r\nb\rc", "", None, "x\n"]) == ["a\nb\nc\n", "", "", "x\n"]


def test_indents(spark):
    assert apply(spark, text.indent_width, ["\tx", "  \t x", "x", ""]) == [4, 7, 0, 0]
    assert apply(spark, text.indent_spaces, ["\tx", "  x", ""]) == [0, 2, 0]


def test_strip_comment(spark):
    cases = ["x = 1 # y", "s = '#' # z", 's = "a#b"', "d = \"it's\" # c", 'x = """ # y', "no comment"]
    assert apply(spark, text.strip_comment, cases) == ["x = 1 ", "s = '#' # z", 's = "a#b"', "d = \"it's\" ", 'x = """ ', "no comment"]


def test_comment_or_string(spark):
    assert apply(spark, text.comment_or_string, ["x // ", "  # ", 'a = "', 'a = "b" ', ""]) == [True, True, True, False, False]


def test_scanner_language(spark):
    cases = ["def f", "import x", "import x:", "let a", "public class A", "zzz", "a => b"]
    got = apply(spark, text.scanner_language, cases)
    assert got == ["Python", "Unknown", "Python", "JavaScript/TypeScript", "Java", "Unknown", "JavaScript/TypeScript"]


def test_guard_language(spark):
    cases = {
        "<!DOCTYPE html>": "HTML", "a <body>": "HTML", "import os": "PYTHON", "import os;": "UNKNOWN", "def f(): x": "PYTHON",
        "print(1)": "PYTHON", "public class A {": "JAVA", "const a = () => 1": "JAVASCRIPT", "function f() { document.getElementById }": "JAVASCRIPT",
        "fun f() {": "KOTLIN", "  ": "UNKNOWN", "zzz": "UNKNOWN",
    }
    assert dict(zip(cases, apply(spark, text.guard_language, list(cases)))) == cases
    df = spark.createDataFrame([("def f(): 1", "a.JS"), ("x", "b.kts"), ("x", "c.htm"), ("print(1)", "d.txt")], "code string, path string")
    assert [r[0] for r in df.select(text.guard_language(F.col("code"), F.col("path"))).collect()] == ["JAVASCRIPT", "KOTLIN", "HTML", "PYTHON"]


def test_content_language(spark):
    cases = {
        "package a import android.x": "java_android", "package a public class B": "java", "import React": "jsx", "def a import b": "python",
        "function f": "javascript", "<?php": "php", "#include": "cpp", "x": "unknown",
    }
    assert dict(zip(cases, apply(spark, text.content_language, list(cases)))) == cases


def test_fixability_and_intent(spark):
    names = ["is_ok", "summary", "process_all", "frobnicate", "abc", "delete_row", "get_log", "thread", "create_it", "Is_Up"]
    assert apply(spark, text.fixability, names) == ["HIGH", "HIGH", "LOW", "MEDIUM", "LOW", "MEDIUM", "HIGH", "MEDIUM", "MEDIUM", "HIGH"]
    assert apply(spark, text.intent, names) == [
        "validate", "calculate", "unspecified", "unspecified", "unspecified", "delete", "fetch data", "read file", "create", "validate",
    ]


def test_clean_params(spark):
    got = apply(spark, text.clean_params, ["self, a: int = 3, b=2", "", "cls", "x,\n y"])
    assert got == [["a", "b"], [], [], ["x", "y"]]
