"""Shared helpers of the corpus operators.

Words are maximal runs of characters other than space and TAB..CR. In Python
that is exactly ``bytes.split()`` on UTF-8; in Spark it is ``words_column``.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD_BREAK = r"[\x20\x09-\x0D]+"
_U64 = np.uint64
#: Rows up to which a narrow side is broadcast.
SMALL_ROWS = 200_000
#: Odd multiplier of the polynomial hashes, modulo 2**64.
BASE = _U64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; none for null."""
    return text.encode("utf-8", "replace").split() if text else []


def normal_words(text: Column) -> Column:
    """Words joined by one space ('' for none), without Python."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), WORD_BREAK, " "))


def words_column(text: Column) -> Column:
    """Array of words, without Python; empty for null."""
    return F.array_remove(F.split(normal_words(text), " "), "")


def n_words_column(text: Column) -> Column:
    """Number of words as long: spaces of the normalised text plus one."""
    joined = normal_words(text)
    return let(
        joined,
        lambda s: F.when(s == "", F.lit(0)).otherwise(
            F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit(""))) + 1
        ),
    ).cast("long")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and bind it in ``body``.

    A plain Python variable would repeat the expression at each mention, and a
    mention inside a lambda would run it again for each element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share.

    Only where it is unset, and the session is a local one as in tests, a
    temporary folder is made.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it lies."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def work_folder(spark: SparkSession, path: str) -> Iterator[None]:
    """Checkpoints go to ``path`` meanwhile, and are deleted at the end: nothing that
    was made from them may be read later."""
    before = shared_folder(spark)
    spark.sparkContext.setCheckpointDir(path)
    try:
        yield
    finally:
        spark.sparkContext.setCheckpointDir(before)
        delete_folder(spark, path)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with ``_row``, a number of its own for each row, and ``_tie``, a hash
    of the row. Written, so that the numbers are the same whenever it is read."""
    hashed = [c for c, t in df.dtypes if "map<" not in t and "variant" not in t]
    return cut(df.withColumns({"_row": F.monotonically_increasing_id(), "_tie": F.xxhash64(*hashed)}))


def reach(df: DataFrame) -> DataFrame:
    """``df``; from now on its session's Python workers can import this package."""
    root = str(Path(__file__).resolve().parents[2])
    env = df.sparkSession.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])
    return df


def map_frames(df: DataFrame, run, schema: str) -> DataFrame:
    return reach(df).mapInPandas(run, schema)


def small_side(df: DataFrame, max_rows: int) -> DataFrame:
    """``df``, marked for broadcast if it has at most ``max_rows`` rows.

    The rows are written and counted first; a larger side is left to the
    shuffled join, which Spark splits where a key is hot.
    """
    kept = cut(df)
    return F.broadcast(kept) if kept.count() <= max_rows else kept


def bounded_ids(df: DataFrame, key: str, limit: int, seed: int = 0) -> DataFrame:
    """Keys of at most ``limit`` rows, those of least seeded hash: a fixed sample.

    A key whose rows alone are more than the limit is left out, and so are keys that
    would bring the rows above it: rows are bounded, however often a key repeats. A
    hash threshold for some four times as many rows comes first, so that only those
    are counted and sorted, at any size of ``df``.
    """
    place = F.xxhash64(F.lit(seed), F.col(key))
    share = min(1.0, 4 * limit / max(df.count(), 1))
    below = F.lit(int(share * (1 << 32)))
    some = df.where(F.col(key).isNotNull() & (F.shiftrightunsigned(place, 32) < below)).groupBy(key).agg(F.count("*").alias("_rows"))
    first = some.where(F.col("_rows") <= limit).orderBy(place, key).limit(limit)  # so many rows at most reach the window's one task
    total = F.sum("_rows").over(Window.orderBy(place, key))
    return first.withColumn("_total", total).where(F.col("_total") <= limit).select(key)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> _U64(30))
    x = x * _U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U64(27))
    x = x * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


class _Powers:
    """Powers of BASE and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, _U64)
        self.down = np.ones(1, _U64)
        self.inverse = _U64(pow(int(BASE), -1, 1 << 64))

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 2 * len(self.up), 4096)
            for name, factor in (("up", BASE), ("down", self.inverse)):
                values = np.full(size, factor, _U64)
                values[0] = 1
                setattr(self, name, np.multiply.accumulate(values))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()
_BYTE_VALUES = mix(np.arange(1, 257, dtype=_U64) * BASE)
_IS_BREAK = np.zeros(256, bool)
_IS_BREAK[[9, 10, 11, 12, 13, 32]] = True
_CHUNK = 1 << 20


def _rolling(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _POWERS.get(len(values) + 1)
    sums = np.zeros(len(values) + 1, _U64)
    np.cumsum(values * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word, vectorised over the bytes of the text.

    Long texts are hashed in chunks that end at a word break.
    """
    raw = text.encode("utf-8", "replace") if text else b""
    parts = []
    at = 0
    while at < len(raw):
        end = len(raw)
        if end - at > _CHUNK:
            end = at + _CHUNK
            while end < len(raw) and not _IS_BREAK[raw[end]]:
                end += 1
        block = np.frombuffer(raw, np.uint8, end - at, at)
        inside = np.zeros(len(block) + 2, np.int8)
        inside[1:-1] = ~_IS_BREAK[block]
        edge = np.diff(inside)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        parts.append(_rolling(_BYTE_VALUES[block], starts, ends))
        at = end
    return np.concatenate(parts) if parts else np.empty(0, _U64)


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of each run of ``length`` words."""
    n = len(words) - length + 1
    if n <= 0:
        return np.empty(0, _U64)
    starts = np.arange(n)
    return _rolling(words, starts, starts + length)
