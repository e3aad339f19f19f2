import pytest
from pyspark.sql import functions as F

from codesieve.functions.text import guard_language
from codesieve.operators import guard, patches, stubs
from codesieve.operators.rules import GUARD


def files(spark, *rows):
    return spark.createDataFrame([(i, "r", p, c) for i, (p, c) in enumerate(rows)], "file_id long, repo string, path string, code string")


HITS = {
    "AI101": ("a.java", "Class.forName(x)"), "AI102": ("a.kt", "System.loadLibrary"), "AI103": ("a.java", "new ObjectInputStream"),
    "AI104": ("a.java", "ProcessBuilder b"), "AI201": ("a.py", "importlib"), "AI202": ("a.py", "pickle.loads(x)"), "AI203": ("a.py", "import ctypes"),
    "AI301": ("a.js", "new Function ('x')"), "AI302": ("a.js", "eval (x)"), "AI303": ("a.js", "execSync"), "AI304": ("a.js", "e.innerHTML=x"),
    "AI305": ("a.js", "x.__proto__"), "AI306": ("a.js", "token: 'abcdefghijkl'"), "AI401": ("a.html", "<script>"), "AI402": ("a.html", "<a onclick=x>"),
    "AI403": ("a.html", "javascript :"), "AI404": ("a.html", "<iframe src>"),
}


def test_each_language_check_hits_and_misses(spark):
    df = files(spark, *HITS.values(), *[(p, "zzz") for p, _ in HITS.values()])
    rows = {(r.file_id, r.check_id): r.passed for r in guard.checks(df).collect()}
    for i, check in enumerate(HITS):
        assert rows[i, check] is False and rows[i + len(HITS), check] is True
    assert sum(len(r) for r in GUARD.values()) == len(HITS)


def test_trailing_word_boundary(spark):
    df = files(spark, ("a.js", "e.innerHTML = x"), ("a.js", "e.innerHTML=x"), ("a.py", "yaml.load( x"), ("a.py", "yaml.load(x"))
    rows = {(r.file_id, r.check_id): r.passed for r in guard.checks(df).collect()}
    assert (rows[0, "AI304"], rows[1, "AI304"], rows[2, "AI202"], rows[3, "AI202"]) == (True, False, True, False)


@pytest.mark.parametrize(
    "code, path, ok",
    [
        ("f(a[1]) {}", "a.js", True), ("f(a[1)", "a.js", False), (")(", "a.py", False), ("x = ')' # (", "a.py", True), ('"""(\n"""', "a.py", True),
        ("x = 'abc", "a.py", False), ("// (\nf()", "a.js", True), ("/* ( */", "a.java", True), ("`(`", "a.js", True), ("don't <!-- ( -->", "a.html", True),
    ],
)
def test_balance(spark, code, path, ok):
    df = files(spark, (path, code))
    assert df.select(guard.balanced(F.col("code"), guard_language(F.col("code"), F.col("path")))).first()[0] is ok


def test_indentation(spark):
    df = files(spark, ("a.py", "if x:\n    y\n"), ("a.py", "if x:\ny\n"), ("a.py", "if x:\n\n# c\n  y"), ("a.py", "if x:\ndef f():\n  y"))
    assert [r[0] for r in df.select(guard.indentation_ok(F.col("code"))).collect()] == [True, False, True, True]


def test_report_verdicts(spark):
    df = files(spark, ("a.html", "<p>"), ("a.html", "<iframe>"), ("a.html", "javascript:"), ("a.js", "eval(1) (("))
    rows = guard.guard_report(df).orderBy("file_id").collect()
    assert [(r.verdict, r.safety_score, r.can_proceed) for r in rows] == [
        ("SAFE", 100, True), ("WARNING", 83, True), ("BLOCKED", 83, False), ("BLOCKED", 75, False),
    ]
    assert rows[3].blocked_reason == "AI010: brackets and strings | AI302: eval"


def versions(spark, *rows):
    schema = "file_id long, original string, modified string, path string, start_line int, end_line int, function_name string"
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema)


def test_compare(spark):
    old = "x = 1\ndef f(a):\n    pass\ny = 2\n"
    new = "x = 1\ndef f(a):\n    b = 1\n    return b\ny = 2\n"
    df = versions(
        spark,
        (old, new, "a.py", 2, 3, "f"),  # inside the range
        (old, new.replace("x = 1", "x = 3"), "a.py", 2, 3, "f"),  # before it
        (old, new.replace("y = 2", "y = 3"), "a.py", 2, 3, "f"),  # after it
        (old, "x = 1\nz = 1\ny = 2\n", "a.py", 2, 3, "f"),  # function lost
        (old, new.replace("f(a)", "f(a, c)"), "a.py", 2, 3, "f"),  # signature changed
        (old, new, "a.txt", 2, 3, "f"),  # python by content
        (None, new, "a.py", 2, 3, "f"),  # direct check
    )
    rows = guard.guard_compare(df).orderBy("file_id").collect()
    reasons = [r.blocked_reason for r in rows]
    assert reasons[0] is None and reasons[5] is None and reasons[6] is None
    assert reasons[1] == reasons[2] == "AI001: change outside the range"
    assert reasons[3] == "AI012: signatures lost | AI011: signature of the function"
    assert reasons[4] == "AI012: signatures lost | AI011: signature of the function"
    assert [(r.file_id, r.signature) for r in guard.lost_signatures(df).orderBy("file_id").collect()] == [(3, "def f(a)"), (4, "def f(a)")]


CODE = "import os\ndef f(a):\n    pass\ndef g(b):\n    pass\n"


def test_patch_reasons(spark):
    df = files(spark, ("a.py", CODE))
    given = [
        ("f", "    pass", "    return 1", 1, 2), ("f", " ", "x", 1, 2), ("f", "    pass", "", 1, 2), ("f", "nope", "x", 1, 2), ("h", "    pass", "x", 1, 2),
        ("f", "    pass", "x", -1, 2), ("f", "    pass", "x", 3, 2), ("f", "    pass", "x", 1, 7), ("f", "    pass", "import os\n    y", 1, 6),
        ("f", "    pass", "import sys\n    y", 1, 2), ("f", "    pass", "x  # TODO", 1, 2), ("f", "    pass", "def f(a):\n    pass\n", 1, 2),
        ("g", "    pass", "  return   1", 1, 2),
    ]
    rows = spark.createDataFrame(
        [(0, n, *x[:3], "r", *x[3:]) for n, x in enumerate(given)],
        "file_id long, patch_no int, function_name string, before string, after string, reason string, start_line int, end_line int",
    )
    allowed = stubs.stubs(df).select("file_id", F.col("name").alias("function_name"))
    out = patches.validate(rows, df, allowed).orderBy("patch_no").collect()
    assert [r.reject_reason for r in out] == [
        None, "empty before", "empty after", "before is not in the file", "function is no candidate", "bad line range", "bad line range", "bad line range",
        None, "unauthorised import", "fake implementation", "fake implementation", "same body as an earlier patch",
    ]
    counts = patches.rejected_counts(df, patches.validate(rows, df, allowed)).first()
    assert (counts.accepted, counts.rejected) == (2, 11)
    diff = patches.diffs(rows.limit(1), df).first().diff
    assert diff.split("\n") == [
        "--- f", "+++ f (modified)", "@@ -1,1 +1,? @@", "  import os", "- def f(a):", "      pass", "  def g(b):", "      pass", "--- change ---", "+     return 1",
    ]


def test_apply_changes(spark):
    code = CODE + "def h():\nz = 1\nclass A:\n    def load_it(self, p):\n        return None\n"
    df = files(spark, ("a.py", code))
    made = stubs.proposals(df)
    out = patches.apply_changes(df, made.where("name in ('h', 'load_it')")).first()
    assert out.n_applied == 2
    assert out.new_code == CODE + (
        'def h():\n    raise NotImplementedError(f"h() not implemented - requires manual implementation")\nz = 1\nclass A:\n    def load_it(self, p):\n'
        '        if not os.path.exists(str(p)):\n            return None\n        with open(p, "r", encoding="utf-8") as f:\n            return f.read()\n'
    )
    whole = made.where("name = 'f'").withColumn("suggestion", F.lit("def f(a):\n    return a"))
    assert patches.apply_changes(df, whole).first().new_code == code.replace("def f(a):\n    pass", "def f(a):\n    return a")


def test_files_without_candidates(spark):
    df = files(spark, ("a.py", CODE), ("b.py", "x = 1"))
    assert [r.file_id for r in patches.without_candidates(df, stubs.stubs(df)).collect()] == [1]


def changed(code, changes):
    """A plain walk: (lo, hi, text) edits of 1-based lines."""
    lines = code.split("\n")
    out = []
    for n in range(1, len(lines) + 2):
        out += [t for lo, _, t in sorted(changes) if lo == n]
        if n <= len(lines) and not any(lo <= n <= hi for lo, hi, _ in changes):
            out.append(lines[n - 1])
    return "\n".join(out)


def test_edits_of_all_kinds_against_a_plain_walk(spark):
    import random

    rng = random.Random(6)
    rows, want = [], {}
    for i in range(40):
        n = rng.randint(1, 400)
        code = "\n".join(f"l{k}" for k in range(n)) + rng.choice(["", "\n"])
        at, changes, edits = 1, [], []
        while at <= n:
            kind, name = rng.choice(["none", "whole", "first", "fill"]), f"f{at}"
            end = min(n, at + rng.randint(0, 3))
            if kind == "whole":
                changes.append((i, name, f"def {name}(a):\n    x", at, at + 1, end, 0))
                edits.append((at, end, f"def {name}(a):\n    x"))
            elif kind == "first" and end > at:
                changes.append((i, name, "return 1\n  y", at, at + 1, end, 4))
                edits.append((at + 1, at + 1, " " * 8 + "return 1\n" + " " * 10 + "y"))
            elif kind == "fill":
                changes.append((i, name, "pass", at, end + 1, end, 2))
                edits.append((end + 1, end, " " * 6 + "pass"))
            at = end + 1
        if changes:
            rows += changes
            want[i] = (changed(code, edits), len(changes))
        rows_code = (i, "r", "p", code)
        want.setdefault("files", []).append(rows_code)
    df = spark.createDataFrame(want.pop("files"), "file_id long, repo string, path string, code string")
    changes = spark.createDataFrame(rows, "file_id long, name string, suggestion string, def_ln int, start_ln int, end_ln int, base int")
    got = {r.file_id: (r.new_code, r.n_applied) for r in patches.apply_changes(df, changes.repartition(3)).collect()}
    assert got == want


def test_time_grows_with_the_number_of_edits(spark):
    import time

    def seconds(n):
        df = files(spark, ("a.py", "".join(f"def f{k}(a):\n    pass\n" for k in range(n))))
        changes = spark.createDataFrame([(0, f"f{k}", "return 1", 2 * k + 1, 2 * k + 2, 2 * k + 2, 0) for k in range(n)], "file_id long, name string, suggestion string, def_ln int, start_ln int, end_ln int, base int")
        began = time.time()
        out = patches.apply_changes(df, changes).first()
        took = time.time() - began
        assert out.n_applied == n and out.new_code == "".join(f"def f{k}(a):\n    return 1\n" for k in range(n))
        return took

    seconds(1000)
    assert seconds(8000) < 2.5 * seconds(4000) + 1
