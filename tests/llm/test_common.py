"""Samples with a bound on rows, and folders that are deleted."""

from pathlib import Path

from pyspark.sql import functions as F

from codesieve.llm import common


def test_samples_bound_rows_not_ids(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 600, 7).otherwise(F.col("id") % 150).alias("k"), "id")
    for limit in (0, 1, 3, 20, 200, 5000):
        keys = [r.k for r in common.bounded_ids(df, "k", limit).collect()]
        rows = df.where(F.col("k").isin(keys)).count() if keys else 0
        assert len(keys) == len(set(keys)) and rows <= limit and (7 in keys) == (limit == 5000)
        assert keys == [r.k for r in common.bounded_ids(df.repartition(5), "k", limit).collect()]
    assert len(common.bounded_ids(df, "k", 200).collect()) > 40
    assert common.bounded_ids(df.limit(0), "k", 10).count() == 0
    nulls = df.select(F.lit(None).cast("long").alias("k"))
    assert common.bounded_ids(nulls, "k", 10).count() == 0


def test_work_folders_are_deleted(spark, tmp_path):
    before = common.shared_folder(spark)
    with common.work_folder(spark, str(tmp_path / "work")):
        assert common.cut(spark.range(10)).count() == 10
        assert list(Path(tmp_path / "work").rglob("part-*"))
    assert not (tmp_path / "work").exists() and common.shared_folder(spark).startswith(before)
