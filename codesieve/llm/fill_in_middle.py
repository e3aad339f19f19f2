"""Fill-in-middle: texts cut at unit borders into prefix, middle and suffix.

Draws and forms are column expressions. The cut is one ``pyarrow.compute`` pipeline
a batch: units as list arrays, flattened with their parents, numbered, filtered by
role, gathered into lists again and joined. No text is handled by itself, except
that a batch is taken in slices of bounded bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.llm.common import reach

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
#: Shares, in hundredths, of texts that are rearranged, and of those that begin with the suffix.
RATE, SUFFIX_FIRST = 50, 80
#: Bytes of text that one pass of the pipeline takes; a longer text goes alone.
SLICE = 8 << 20
#: A unit ends where a character other than white space meets white space. Byte FF
#: stands in no UTF-8 text.
_BORDER, _MARKED = rb"([^\x20\x09-\x0D])([\x20\x09-\x0D])", b"\\1\xff\\2"
_BYTES = pa.large_binary()


def draw(id_: Column, k: int, seed: int = SEED) -> Column:
    """The ``k``-th (from 0) 8-digit group of sha256("seed:id"), as a long."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def form_of(id_: Column, text: Column, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> Column:
    """plain, spm or psm."""
    marked = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    plain = (text == "") | marked | (draw(id_, 2, seed) % 100 >= rate)
    return F.when(plain, "plain").when(draw(id_, 3, seed) % 100 < suffix_first, "spm").otherwise("psm")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. Only plain texts hold the marks
    themselves, so the pieces between them are told apart."""
    p = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    spm = F.concat(F.get(p, F.lit(2)), F.get(p, F.lit(3)), F.get(p, F.lit(1)))
    psm = F.concat(F.get(p, F.lit(1)), F.get(p, F.lit(3)), F.get(p, F.lit(2)))
    return F.when(form == "spm", spm).when(form == "psm", psm).otherwise(output)


def units_of(texts: pa.Array) -> pa.Array:
    """Lists of units: white space with the word that follows, or white space at the end."""
    marked = pc.replace_substring_regex(texts.cast(_BYTES), pattern=_BORDER, replacement=_MARKED)
    return pc.split_pattern(marked, pattern=b"\xff")


def _offsets(sizes: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())


def rearranged(texts: pa.Array, form: pa.Array, h1: pa.Array, h2: pa.Array) -> list[pa.Array]:
    """n, prefix_chars, middle_chars and output of each text. No value is null."""
    lists = units_of(texts)
    units, parents = pc.list_flatten(lists), pc.list_parent_indices(lists)
    first = pc.take(lists.offsets.slice(0, len(lists)), parents)
    ordinals = pc.subtract(pa.array(np.arange(len(units)), pa.int64()), pc.cast(pc.subtract(first, lists.offsets[0]), pa.int64()))
    # An empty text has one empty piece, which is no unit.
    n = pc.if_else(pc.equal(pc.binary_length(texts), 0), 0, pc.cast(pc.list_value_length(lists), pa.int64()))
    steps = pc.add(n, 1)
    a, b = (pc.subtract(h, pc.multiply(pc.divide(h, steps), steps)) for h in (h1, h2))
    low, high = pc.min_element_wise(a, b), pc.max_element_wise(a, b)
    low_of, high_of = pc.take(low, parents), pc.take(high, parents)
    roles = (
        (pc.less(ordinals, low_of), low),
        (pc.and_(pc.greater_equal(ordinals, low_of), pc.less(ordinals, high_of)), pc.subtract(high, low)),
        (pc.greater_equal(ordinals, high_of), pc.subtract(pc.max_element_wise(n, pc.cast(pc.list_value_length(lists), pa.int64())), high)),
    )
    empty = pa.scalar(b"", _BYTES)
    prefix, middle, suffix = (
        pc.binary_join(pa.ListArray.from_arrays(_offsets(size.to_numpy()), pc.filter(units, mask)), empty) for mask, size in roles
    )
    p, s, m = (pa.scalar(x.encode(), _BYTES) for x in (PREFIX, SUFFIX, MIDDLE))
    plain = pc.equal(form, "plain")
    output = pc.if_else(
        plain, texts.cast(_BYTES),
        pc.if_else(
            pc.equal(form, "spm"), pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, empty),
            pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, empty),
        ),
    )
    none = pa.scalar(None, pa.int64())
    chars = [pc.if_else(plain, none, pc.cast(pc.utf8_length(x.cast(pa.large_string())), pa.int64())) for x in (prefix, middle)]
    return [n, *chars, output.cast(pa.string())]


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of rows of at most SLICE bytes, or of one row."""
    ends = np.cumsum(pc.cast(pc.binary_length(texts), pa.int64()).to_numpy())
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + SLICE, "right")))
        yield at, stop - at
        at = stop


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, size in _slices(batch["text"]):
            part = batch.slice(at, size)
            columns = rearranged(part["text"], part["form"], part["h1"], part["h2"])
            yield pa.RecordBatch.from_arrays(
                [part["id"], columns[0], part["form"], *columns[1:]], ["id", "n", "form", "prefix_chars", "middle_chars", "output"]
            )


def fill_in_middle(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST
) -> DataFrame:
    """One row per row of ``df``: id, n, form, prefix_chars, middle_chars, output.

    ``n`` counts the units of the whole text. Null texts count as empty and stay
    plain, as do texts that hold one of the marks. A null id draws as an empty one.
    Repeated rows come out alike; other columns of ``df`` are ignored.
    """
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    drawn = rows.select(
        "id", "text", form_of(F.col("id"), F.col("text"), seed, rate, suffix_first).alias("form"),
        draw(F.col("id"), 0, seed).alias("h1"), draw(F.col("id"), 1, seed).alias("h2"),
    )
    schema = f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    return reach(drawn).mapInArrow(_run, schema).withColumnRenamed("id", id_col)


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``fill_in_middle`` with sha256 digests in the place of texts."""
    made = fill_in_middle(df, id_col, text_col)
    back = restored(F.col("output"), F.col("form"))
    return made.select(
        id_col, "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256")
    )
