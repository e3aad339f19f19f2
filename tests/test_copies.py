"""Equal texts are worked on once, and every file gets its rows."""

from pyspark.sql import functions as F

from codesieve.operators import copies, stubs
from codesieve.operators.guard import guard_compare


def test_copies_get_the_rows_of_their_text(spark):
    texts = ["def a():\n    pass\n", "def b(x):\n    return None\n", "x = 1\n", None, ""]
    files = spark.createDataFrame([(k, texts[k % 5]) for k in range(50)], "file_id long, code string")
    seen = spark.sparkContext.accumulator(0)

    def work(rows):
        counted = rows.rdd.map(lambda r: (seen.add(1), tuple(r))[1])
        return spark.createDataFrame(counted, rows.schema).withColumn("n", F.length("code"))

    got = {(r.file_id, r.code, r.n) for r in copies.once_per_text(files, work).collect()}
    assert got == {(k, texts[k % 5], None if texts[k % 5] is None else len(texts[k % 5])) for k in range(50)}
    assert seen.value == 5
    found = {(r.file_id, r.name) for r in stubs.stubs(files).collect()}
    assert found == {(k, "ab"[k % 5]) for k in range(50) if k % 5 < 2}


def test_digest_tells_columns_apart(spark):
    rows = spark.createDataFrame([("ab", "c"), ("a", "bc"), (None, "abc"), ("abc", None), ("", "abc"), ("-", "abc"), (None, None)], "a string, b string")
    assert rows.select(copies.digest("a", "b").alias("d")).distinct().count() == 7


def test_language_of_copies_comes_from_each_path(spark):
    code = "const a = (b) => {\n  return b;\n}\n"
    rows = [(k, code, code, f"r/x.y/{k}{e}", 1, 1, "a") for k, e in enumerate((".js", ".py", "", ".KT", ".py", ".js"))]
    versions = spark.createDataFrame(rows, "file_id long, original string, modified string, path string, start_line int, end_line int, function_name string")
    got = {r.file_id: r.n_checks for r in guard_compare(versions).collect()}
    alone = {k: guard_compare(versions.where(F.col("file_id") == k)).first().n_checks for k in range(6)}
    assert got == alone and got[0] == got[5] and got[1] == got[4] and got[0] != got[1]
