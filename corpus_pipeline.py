"""Training-data pipeline: each stage works on all that the one before kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir). What
it returns is written as Parquet and reread as the next stage's ``docs``. All
but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from codesieve.llm import exact_dedup, mixing, packing, quality, simhash
from codesieve.llm.common import delete_folder, read_table, shared_folder, work_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the likelihood ratio reject go.

    Null texts have no words and go; repeated rows are judged alike; other columns
    stay as they are. Without documents none come out, without labelled good texts
    the base rules alone decide.
    """
    return quality.drop_low_quality(docs, read_table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group the document with the least doc_id stays."""
    return simhash.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source's words come to its target: documents go, repeat or are cut."""
    return mixing.apply_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens: one row per piece."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("mix_sources", mix),
    ("best_fit_packing", pack),
]

#: Fingerprints, seeded selection and tokenizer ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage. A stage's checkpoints go once it is written, and its
    input once its successor is: two stages lie in the shared folder at most."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, last = read_table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{k}-{name}"
        with work_folder(spark, f"{folder}/{k}-work"):
            stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if last is not None:
            delete_folder(spark, last)
        last = out
    return docs
