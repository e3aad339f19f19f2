"""Exact duplicates by progressive refinement, in DataFrame operations only.

Rows are first grouped by length, then by a hash of a short prefix, and only
the rows of groups that survive both are hashed in full. What survives a step is
counted and broadcast as a bit table with SPARSE bits or more for each key, so at most
one row in SPARSE passes that it need not (two keys share a bit); the next step judges
that row, so results are exact. Texts are never shuffled. A table that would outgrow
its bound is not broadcast: then narrow keys are shuffled, after all texts are hashed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.llm.common import SMALL_ROWS, cut, numbered, small_side

PREFIX = 256
#: Most words of 64 bits in a broadcast bit table; a power of two. At most 16 MB.
FILTER_WORDS = 1 << 20
#: Least bits for each key in a table: at most 1 / SPARSE of them are set.
SPARSE = 8


def _word(key: Column, words: int) -> Column:
    return F.shiftrightunsigned(key, 6).bitwiseAND(F.lit(words - 1))


def _bit(key: str) -> Column:
    return F.expr(f"shiftleft(1L, CAST({key} & 63 AS INT))")


def _repeated(keys: DataFrame) -> tuple[DataFrame, int]:
    """The hashes ``key`` that occur more than once, written, and the words of their table."""
    again = cut(keys.groupBy("key").count().where("count > 1").select("key"))
    return again, 1 << max(0, (again.count() * SPARSE - 1) // 64).bit_length()


def _table(again: DataFrame, words: int) -> DataFrame:
    """Bit table (word, bits) of the keys."""
    return again.groupBy(_word(F.col("key"), words).alias("word")).agg(F.bit_or(_bit("key")).alias("bits"))


def _among(df: DataFrame, key: Column, table: DataFrame, words: int) -> DataFrame:
    """``df`` with ``again``: whether the bit of ``key`` is set in the table."""
    rows = df.withColumn("key", key).withColumn("of_word", _word(F.col("key"), words))
    rows = rows.join(F.broadcast(table), F.col("of_word") == F.col("word"), "left")
    again = F.coalesce(F.col("bits").bitwiseAND(_bit("key")) != 0, F.lit(False))
    return rows.withColumn("again", again).drop("of_word", "word", "bits", "key")


def exact_dedup(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest_all: bool = False,
    prefix: int = PREFIX,
    small_rows: int = SMALL_ROWS,
    filter_words: int = FILTER_WORDS,
) -> DataFrame:
    """One row per row of ``df``: id, keep_id, group_size, kept, text_sha256.

    Null text equals empty text. Of equal texts the row with the largest id
    stays; null ids lose, and a group of null ids keeps a null keep_id. Rows that
    repeat both id and text cannot be told apart and are all reported kept.
    ``text_sha256`` is null for texts without a copy, unless ``digest_all``.
    ``small_rows`` and ``filter_words`` decide speed only. Other columns of
    ``df`` are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).select(
        "id", text.alias("text"), F.xxhash64(F.octet_length(text)).alias("len"),
        F.xxhash64(F.octet_length(text), F.substring(text, 1, prefix)).alias("head"),
    )
    lengths, words = _repeated(base.select(F.col("len").alias("key")))
    # Without a table of lengths their step is left out: all go on to the next.
    longer = _among(base, F.col("len"), _table(lengths, words), words).where("again") if words <= filter_words else base
    heads, words = _repeated(longer.select(F.col("head").alias("key")))
    full = F.sha2(F.col("text"), 256)
    if words <= filter_words:
        # The join runs in the scan: only survivors are hashed in full.
        rows = _among(base, F.col("head"), _table(heads, words), words)
        rows = rows.select("id", "head", F.when(F.col("again") | F.lit(digest_all), full).alias("full"), "again")
    else:
        hashed = base.select("id", "head", full.alias("full"))
        rows = hashed.join(heads, F.col("head") == F.col("key"), "left").withColumn("again", F.col("key").isNotNull()).drop("key")
    groups = small_side(
        rows.where("again").groupBy("full")
        .agg(F.max("id").alias("keep"), F.count("*").alias("n"))
        .where("n > 1").withColumnRenamed("full", "digest"),
        small_rows,
    )
    # Rows without a group have a head of their own, by which they are spread over
    # the tasks, whatever their ids; a hot group's rows are split by the skew join,
    # as both sides come straight from a shuffle. No digest begins with a "-".
    key = F.when(F.col("again"), F.col("full")).otherwise(F.concat(F.lit("-"), F.col("head").cast("string")))
    alone = F.col("n").isNull()
    return rows.withColumn("key", key).join(groups, F.col("key") == F.col("digest"), "left").select(
        F.col("id").alias(id_col),
        F.when(alone, F.col("id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.when(alone, True).otherwise(F.col("id").eqNullSafe(F.col("keep"))).alias("kept"),
        F.when(~alone | F.lit(digest_all), F.col("full")).alias("text_sha256"),
    )


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one row of each text; its columns are unchanged.

    The row with the largest id stays, null ids lose. Rows are judged one by one:
    of rows that repeat id and text one stays too, and others of its id are not
    touched.
    """
    rows = numbered(df)
    each = F.struct(F.col(id_col).alias("id"), "_tie", "_row")
    verdicts = exact_dedup(rows.select(each.alias("_key"), text_col), "_key", text_col)
    gone = small_side(verdicts.where("NOT kept").select("_key._row"), SMALL_ROWS)
    return rows.join(gone, "_row", "left_anti").select(*df.columns)
