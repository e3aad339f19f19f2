"""Extents, stubs, proposals and context on hand cases."""

from pyspark.sql import functions as F

from codesieve.operators import functions, report, stubs


def files(spark, *codes):
    return spark.createDataFrame([(i, "r", f"r/f{i}.py", c) for i, c in enumerate(codes)], "file_id long, repo string, path string, code string")


def found(spark, code):
    rows = stubs.stubs(files(spark, code)).orderBy("pos").collect()
    return [(r.name, r.def_ln, r.start_ln, r.end_ln, r.risk, r.reason) for r in rows]


def test_placeholders(spark):
    code = "def a():\n    pass\ndef b():\n    ...\ndef c():\n    raise NotImplementedError('x')\ndef d():\n    return None\ndef e():\n    return 1\n"
    assert [(x[0], x[4]) for x in found(spark, code)] == [("a", "CONFIRMED"), ("b", "CONFIRMED"), ("c", "CONFIRMED"), ("d", "SUSPICIOUS")]


def test_docstrings_and_comments_are_skipped(spark):
    code = 'def a():\n    """One."""\n    # c\n\n    """\n    two\n    """\n    pass\n    # tail\n\nx = 1\n'
    assert found(spark, code) == [("a", 1, 8, 10, "CONFIRMED", "placeholder")]


def test_short_docstring_opens_a_long_one(spark):
    code = 'def a():\n    """\n    text\n    """\n    return 1\n'
    assert found(spark, code) == []


def test_nested_and_special_methods(spark):
    code = "class A:\n    def __init__(self):\n        pass\n    def go(self):\n        pass\ndef outer():\n    def inner():\n        pass\n    return inner\n"
    assert [x[0] for x in found(spark, code)] == ["go"]
    total = stubs.function_totals(files(spark, code)).first()
    assert (total.total_visited, total.total_def_lines) == (3, 4)


def test_one_line_definition_takes_the_next_signature(spark):
    code = "def one(): pass\nx = 1\ndef two():\n    pass\n"
    assert found(spark, code) == [("one", 1, 4, 4, "CONFIRMED", "placeholder")]
    assert stubs.stubs(files(spark, code)).first().single_line


def test_definition_without_body(spark):
    assert found(spark, "def a():\nx = 1\n") == [("a", 1, 2, 1, "CONFIRMED", "empty body")]
    assert [(x[0], x[3]) for x in found(spark, "def a():\n")] == [("a", 1)]
    assert found(spark, "def a()\n    pass\n") == []


def test_signature_over_lines_tabs_async_and_decorators(spark):
    code = "@d\nasync def a(\n\tx,\n):\n\tpass\n\ty\nz = 1\n"
    assert found(spark, code) == [("a", 2, 5, 6, "CONFIRMED", "placeholder")]


def test_first_of_a_name_wins(spark):
    assert [x[1] for x in found(spark, "def a():\n    pass\ndef a():\n    ...\n")] == [1]


def test_javascript(spark):
    code = "function a() {\n}\nconst b = () => {\n  return null;\n}\nfunction c(x)\n{\n}\nlet d = x => 1\nfunction e() {\n  if (1) { f() }\n}\nvar g = function () { return; }\n"
    rows = stubs.stubs(files(spark, code)).orderBy("pos").collect()
    assert [(r.name, r.def_ln, r.end_ln, r.language) for r in rows] == [
        ("a", 1, 2, "javascript"), ("b", 3, 5, "javascript"), ("c", 6, 8, "javascript"), ("g", 13, 13, "javascript"),
    ]


def test_javascript_name_taken_by_python(spark):
    code = "def a():\n    pass\nfunction a() {\n}\n"
    assert [x[0] for x in found(spark, code)] == ["a"]


def test_empty_null_and_blank_files(spark):
    assert stubs.stubs(files(spark, "", None, "\n\n")).count() == 0


def test_candidates(spark):
    row = stubs.candidates(files(spark, "x = 1\ndef a():\n    pass\ny = 2\n")).first()
    assert row.code_snippet == "def a():\n    pass\n"
    assert row.context == "   1 | x = 1\n   2 | def a():\n   3 |     pass\n   4 | y = 2\n   5 | \n"


def test_proposals_by_name(spark):
    names = {
        "is_email_ok(addr)": ('    return bool(re.match(r"^[\\w._%+-]+@[\\w.-]+\\.[a-zA-Z]{2,}$", str(addr)))', "re"),
        "hash_password(p)": ('    return hashlib.sha256(str(p).encode("utf-8")).hexdigest()', "hashlib"),
        "account(self, rows)": ("    return sum(rows) if rows else 0", None),
        "thread(x)": ('    if not os.path.exists(str(x)):\n        return None\n    with open(x, "r", encoding="utf-8") as f:\n        return f.read()', "os"),
        "remove_it(a, b)": ("    return [x for x in b if x != a]", None),
        "zzz()": ('    raise NotImplementedError(f"zzz() not implemented - requires manual implementation")', None),
    }
    rows = stubs.proposals(files(spark, *[f"def {n}:\n    pass\n" for n in names])).orderBy("file_id").collect()
    assert [(r.suggestion, r.required_import) for r in rows] == list(names.values())


def test_type_confidence_and_refinement(spark):
    code = "def a(d):\n    return d.get('x') + d[\"y\"]\ndef b(s):\n    return s\ndef c(n):\n    return int(n)\n"
    rows = {r.name: r for r in stubs.first_param_types(files(spark, code)).collect()}
    assert (rows["a"].dict, rows["a"].dominant, rows["b"].dominant, rows["c"].dominant) == (0.9, "dict", "unknown", "number")
    df = spark.createDataFrame([("    return sum(d) if d else 0",)], "s string")
    got = df.select(stubs.refine(F.col("s"), F.lit("dict"), F.lit("d"))).first()[0]
    assert got == "    return sum(x.get('value', x.get('price', x.get('amount', 0))) for x in d) if d else 0"


def test_context(spark):
    code = "import os\nfrom a import b\nclass A(B):\n    x = 1\n    def m(self, q=1):\n        pass\ndef f(a: int):\n    return a\n\ndef f(z):\n    return z\n"
    df = files(spark, code)
    assert [r.imported for r in functions.imports(df).orderBy("pos").collect()] == ["os", "a import b"]
    assert [r.class_name for r in functions.classes(df).collect()] == ["A"]
    assert {r.name: r.params for r in functions.function_params(df).collect()} == {"m": ["q"], "f": ["z"]}
    assert [(r.name, r.in_class) for r in functions.class_members(df).orderBy("ln").collect()] == [("m", True), ("f", False), ("f", False)]
    assert {r.name: r.body for r in functions.function_bodies(df).collect()}["f"] == "def f(a: int):\n    return a\n\n"


def test_report_pattern_may_swallow(spark):
    code = "def a():\n    pass\ndef total_b():\n    x = 1\n    password = 2\n"
    rows = report.function_analysis(files(spark, code)).orderBy("pos").collect()
    assert [(r.name, r.fixability, r.intent, r.can_auto_fix) for r in rows] == [("a", "LOW", "unspecified", False), ("total_b", "HIGH", "calculate", True)]
    summary = report.report(files(spark, code, "x = 1\n")).orderBy("file_id").collect()
    assert [(r.n_stubs, r.high_fixable, r.low_fixable) for r in summary] == [(2, 1, 1), (0, 0, 0)]


def test_fold_needs_no_shuffle_and_no_python(spark):
    plan = stubs.stubs(files(spark, "x"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "EvalPython" not in plan


def test_folds_cross_blocks(spark):
    """Files of more lines than a fold reads at once: no function is lost, doubled or moved."""
    for n in (42, 43, 64, 300):
        py = "".join(f"def f{i}(a):\n    pass\n\n" for i in range(n))
        js = "".join(f"function g{i}(a) {{\n  return {i};\n}}\n" for i in range(n))
        df = spark.createDataFrame([(1, py, js)], "file_id long, py string, js string")
        row = df.select(functions.python_functions(F.col("py")).alias("p"), functions.javascript_functions(F.col("js")).alias("j")).first()
        assert row.p.total == n
        assert [(f.name, f.def_ln, f.body_ln, f["first"]) for f in row.p.found] == [(f"f{i}", 3 * i + 1, 3 * i + 2, "pass") for i in range(n)]
        assert [(f.name, f.ln, f.end_ln, f.body) for f in row.j] == [(f"g{i}", 3 * i + 1, 3 * i + 3, f"return {i};") for i in range(n)]
        files = df.select("file_id", F.col("py").alias("code"))
        assert {(r.name, r.body) for r in functions.function_bodies(files).collect()} == {
            (f"f{i}", f"def f{i}(a):\n    pass\n" + ("\n" if i < n - 1 else "")) for i in range(n)
        }
        members = [(r.ln, r.name, r.in_class) for r in functions.class_members(files).collect()]
        assert members == [(3 * i + 1, f"f{i}", False) for i in range(n)]
