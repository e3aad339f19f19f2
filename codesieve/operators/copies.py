"""Work on each distinct text once: a corpus holds many copies of its files.

What an operator finds in a text depends on that text alone, so copies are grouped
first, the operator runs on one row for each, and files get its rows by the digest
of their text. All files are read; narrow rows are shuffled, a text only once for
each task that holds it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def digest(*columns: str | Column) -> Column:
    """SHA-256 of the values of ``columns``, each with its length; null differs from every text."""

    def part(c: str | Column) -> Column:
        text = (F.col(c) if isinstance(c, str) else c).cast("string")
        return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*[part(c) for c in columns]), 256))


def distinct_texts(files: DataFrame, *on: str) -> DataFrame:
    """(_text, *on): one row for each distinct value of ``on``, with its digest. They are
    dealt out anew, as they are few bytes for the time that they take."""
    tasks = 4 * files.sparkSession.sparkContext.defaultParallelism
    return files.select(*on).distinct().repartition(tasks).select(digest(*on).alias("_text"), *on)


def once_per_text(files: DataFrame, work: Callable[[DataFrame], DataFrame], *on: str) -> DataFrame:
    """``work(files)`` for a ``work`` whose rows of a file depend on its columns ``on``
    (default: code) alone. ``work`` gets file_id and ``on``, and returns file_id first."""
    on = on or ("code",)
    made = work(distinct_texts(files, *on).withColumnRenamed("_text", "file_id"))
    columns = made.columns
    rows = files.select("file_id", digest(*on).alias("_text"))
    return rows.join(made.withColumnRenamed("file_id", "_text"), "_text").select(*columns)
