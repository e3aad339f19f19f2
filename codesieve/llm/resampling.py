"""Importance resampling towards a target: hashed n-gram gains and a seeded draw.

Two passes over the texts. The first counts hashed n-grams of raw and of target
texts by bucket; their log ratio is a bucket's gain. The second gives each text the
mean gain of its n-grams plus Gumbel noise of its id, and the highest are drawn.

In a task, the n-grams of a slice of texts are interned in an open-addressed table
of NumPy arrays: keys are XXH64 values, and an n-gram that meets its key in a slot
is compared with it byte by byte. A slot has a bucket and a count, so CRC32 is
computed once for each n-gram of a slice; each occurrence keeps its slot, through
which it gathers its gain.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.llm.common import cut, map_frames

_U64 = np.uint64
BUCKETS = 10_000
SEED = 7
#: Bytes of text that one table holds; a longer text is cut between two words.
SLICE = 1 << 18
#: Longer n-grams are hashed and compared by themselves.
LONG = 256
#: Bytes after lower-casing A-Z; what is no word byte becomes a blank.
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_P1, _P2, _P3, _P4, _P5 = map(_U64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
def _crc_table() -> np.ndarray:
    """CRC32 of one byte, for each byte: the reflected polynomial, bit by bit."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & np.uint32(1), (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


_CRC = _crc_table()
#: What ends a word: a blank, the end of a text, or the end of a part of a text
#: whose last word belongs to the next part.
_BLANK, _END, _AHEAD = 0x20, 0x0A, 0x01


def normal_bytes(text: str | None) -> bytes:
    """Words as bytes, joined by one blank."""
    return b" ".join(text.encode("utf-8", "replace").translate(_LOWER).split()) if text else b""


class Spans:
    """Spans of one buffer: hashed and compared over eight bytes at a time."""

    def __init__(self, raw: bytes, starts: np.ndarray, lengths: np.ndarray) -> None:
        self.raw, self.starts, self.lengths = raw, starts, lengths
        padded = raw + bytes(8)
        self.eights = np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))

    def bytes_of(self, i: int) -> bytes:
        return self.raw[self.starts[i] : self.starts[i] + self.lengths[i]]

    def keys(self) -> np.ndarray:
        """XXH64 with seed 0 of each span."""
        out = np.empty(len(self.starts), _U64)
        short = np.flatnonzero(self.lengths <= LONG)
        order = short[np.argsort(self.lengths[short].astype(np.uint16), kind="stable")]
        cuts = np.flatnonzero(np.diff(self.lengths[order])) + 1
        for same in np.split(order, cuts) if len(order) else ():
            out[same] = self._hashed(self.starts[same], int(self.lengths[same[0]]))
        for i in np.flatnonzero(self.lengths > LONG):
            out[i] = xxhash.xxh64_intdigest(self.bytes_of(i))
        return out

    def _hashed(self, at: np.ndarray, size: int) -> np.ndarray:
        def turned(x: np.ndarray, n: int) -> np.ndarray:
            return (x << _U64(n)) | (x >> _U64(64 - n))

        def mixed(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
            return turned(acc + lane * _P2, 31) * _P1

        zero = np.zeros(len(at), _U64)
        done = 0
        if size >= 32:
            with np.errstate(over="ignore"):
                lanes = [zero + (_P1 + _P2), zero + _P2, zero, zero - _P1]
            while done + 32 <= size:
                lanes = [mixed(a, self.eights[at + done + 8 * k]) for k, a in enumerate(lanes)]
                done += 32
            h = turned(lanes[0], 1) + turned(lanes[1], 7) + turned(lanes[2], 12) + turned(lanes[3], 18)
            for a in lanes:
                h = (h ^ mixed(zero, a)) * _P1 + _P4
        else:
            h = zero + _P5
        h = h + _U64(size)
        while done + 8 <= size:
            h = turned(h ^ mixed(zero, self.eights[at + done]), 27) * _P1 + _P4
            done += 8
        if done + 4 <= size:
            h = turned(h ^ ((self.eights[at + done] & _U64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
            done += 4
        while done < size:
            h = turned(h ^ ((self.eights[at + done] & _U64(0xFF)) * _P5), 11) * _P1
            done += 1
        h = (h ^ (h >> _U64(33))) * _P2
        h = (h ^ (h >> _U64(29))) * _P3
        return h ^ (h >> _U64(32))

    def crc32(self, which: np.ndarray) -> np.ndarray:
        """CRC32 of the spans ``which``, a byte of each at a time, longest first."""
        values = np.frombuffer(self.raw, np.uint8)
        sizes = np.minimum(self.lengths[which], LONG + 1).astype(np.uint16)
        order = np.argsort(LONG + 1 - sizes, kind="stable")
        starts, sizes = self.starts[which][order], sizes[order]
        first = int(np.searchsorted(-sizes.astype(np.int64), -LONG))  # the first that is no longer than LONG
        crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
        live = np.searchsorted(-sizes.astype(np.int64), -np.arange(LONG + 1), "left")
        for k in range(int(sizes[first]) if first < len(sizes) else 0):
            part = crc[first : live[k]]
            crc[first : live[k]] = _CRC[(part ^ values[starts[first : live[k]] + k]) & np.uint32(0xFF)] ^ (part >> np.uint32(8))
        out = np.empty(len(order), np.uint32)
        out[order] = ~crc
        for i in order[:first].tolist():
            out[i] = zlib.crc32(self.bytes_of(which[i]))
        return out

    def equal(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether spans ``i`` and ``j`` (arrays of numbers) hold the same bytes."""
        same = self.lengths[i] == self.lengths[j]
        left = np.flatnonzero(same & (self.lengths[i] <= LONG))
        done = 0
        while len(left):
            size = self.lengths[i[left]] - done
            keep = np.where(size >= 8, ~_U64(0), (_U64(1) << (_U64(8) * np.minimum(size, 7).astype(_U64))) - _U64(1))
            differ = (self.eights[self.starts[i[left]] + done] ^ self.eights[self.starts[j[left]] + done]) & keep
            same[left[differ != 0]] = False
            done += 8
            left = left[(differ == 0) & (size > 8)]
        for k in np.flatnonzero(same & (self.lengths[i] > LONG)):
            same[k] = self.bytes_of(i[k]) == self.bytes_of(j[k])
        return same


class Table:
    """Open-addressed table of spans. ``slots`` has the slot of each occurrence;
    ``owner`` the first span of each slot (-1: free), ``bucket`` and ``count`` what
    is kept of it."""

    def __init__(self, spans: Spans, keys: np.ndarray, buckets: int = BUCKETS) -> None:
        n = len(keys)
        size = 1 << max(4, (2 * n - 1).bit_length() if n else 4)
        self.owner = np.full(size, -1, np.int64)
        self.slots = (keys & _U64(size - 1)).astype(np.int64)
        left = np.arange(n)
        while len(left):
            at = self.slots[left]
            free = self.owner[at] < 0
            self.owner[at[free]] = left[free]  # of several that claim one slot the last stays
            held = self.owner[at]
            mine = keys[held] == keys[left]
            mine[mine] = spans.equal(held[mine], left[mine])
            left = left[~mine]
            self.slots[left] = (self.slots[left] + 1) & (size - 1)
        self.count = np.bincount(self.slots, minlength=size)
        self.bucket = np.zeros(size, np.int64)
        used = np.flatnonzero(self.owner >= 0)
        self.bucket[used] = spans.crc32(self.owner[used]) % np.uint32(buckets)

    def by_bucket(self, buckets: int) -> np.ndarray:
        return np.bincount(self.bucket, weights=self.count, minlength=buckets).astype(np.int64)


def parts_of(normal: bytes) -> Iterator[tuple[bytes, int]]:
    """A text as parts of some SLICE bytes and the mark that ends each. All but the
    last also hold the next part's first word, so that no pair of words is lost."""
    at = 0
    while len(normal) - at > SLICE:
        end = normal.find(b" ", at + SLICE)
        if end < 0:
            break
        ahead = normal.find(b" ", end + 1)
        yield normal[at : ahead if ahead > 0 else len(normal)], _AHEAD
        at = end + 1
    if at < len(normal):
        yield normal[at:], _END


def slices_of(texts: Iterable[str | None]) -> Iterator[tuple[bytes, np.ndarray]]:
    """(buffer, number of the text of each part): parts until SLICE bytes are full."""
    held: list[bytes] = []
    owners: list[int] = []
    size = 0
    for number, text in enumerate(texts):
        for part, mark in parts_of(normal_bytes(text)):
            held += (part, bytes([mark]))
            owners.append(number)
            size += len(part)
            if size >= SLICE:
                yield b"".join(held), np.array(owners)
                held, owners, size = [], [], 0
    if held:
        yield b"".join(held), np.array(owners)


class Interned:
    """The n-grams of a slice: a table, and per occurrence its slot and its text."""

    def __init__(self, raw: bytes, owners: np.ndarray, buckets: int = BUCKETS) -> None:
        values = np.frombuffer(raw, np.uint8)
        ends = np.flatnonzero(values <= _BLANK)
        starts = np.concatenate(([0], ends[:-1] + 1))
        marks = values[ends]
        text = owners[np.concatenate(([0], np.cumsum(marks != _BLANK)[:-1]))]
        single, pair = np.flatnonzero(marks != _AHEAD), np.flatnonzero(marks == _BLANK)
        self.word_text = text[single]
        self.text = np.concatenate((self.word_text, text[pair]))
        spans = Spans(
            raw, np.concatenate((starts[single], starts[pair])), np.concatenate((ends[single] - starts[single], ends[pair + 1] - starts[pair]))
        )
        self.table = Table(spans, spans.keys(), buckets)


def bucket_counts(texts: DataFrame, buckets: int) -> np.ndarray:
    """Occurrences by bucket over all ``texts`` (one column ``text``)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for raw, owners in slices_of(batch["text"]):
                total += Interned(raw, owners, buckets).table.by_bucket(buckets)
        found = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": found, "n": total[found]})

    out = np.zeros(buckets, np.int64)
    for row in map_frames(texts, run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most ``buckets`` rows
        out[row["bucket"]] = row["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the smoothed log ratio of target to raw, by bucket."""
    n, s_all, t_all = len(raw), int(raw.sum()), int(target.sum())
    return np.array(
        [math.floor(1000 * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n)))) for s, t in zip(raw.tolist(), target.tolist())], np.int64
    )


def noise(id_: str | None, seed: int) -> int:
    """Gumbel noise in thousandths, from the id alone."""
    h = int(hashlib.sha256(f"{seed}:{id_ if isinstance(id_, str) else ''}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(rows: DataFrame, table: np.ndarray, seed: int, kind: str) -> DataFrame:
    """(id, n_words, n_features, weight, score) of rows (id, text). ``table`` has
    one gain for each bucket."""
    buckets = len(table)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n = len(batch)
            words, features, total = (np.zeros(n, np.int64) for _ in range(3))
            for raw, owners in slices_of(batch["text"]):
                part = Interned(raw, owners, buckets)
                words += np.bincount(part.word_text, minlength=n)
                features += np.bincount(part.text, minlength=n)
                np.add.at(total, part.text, table[part.table.bucket][part.table.slots])
            weight = total // np.maximum(features, 1)
            score = weight + np.array([noise(i, seed) for i in batch["name"]], np.int64)
            yield pd.DataFrame({"id": batch["id"], "n_words": words, "n_features": features, "weight": weight, "score": score})

    named = rows.select("id", F.col("id").cast("string").alias("name"), "text")
    return map_frames(named, run, f"id {kind}, n_words long, n_features long, weight long, score long")


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with ``rank``, 1, 2, 3... in the order given, without a single task.

    Rows are sorted over ranges and written with their place within the range; the
    sizes of ranges before it, one number for each, give the rest.
    """
    place = F.monotonically_increasing_id()
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", place))
    part, within = F.shiftright("_place", 33), F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r["part"]: r["n"] for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}  # one row a partition
    starts, total = {}, 0
    for k in sorted(sizes):
        starts[k], total = total, total + sizes[k]
    table = F.from_json(F.lit("[" + ",".join(str(starts.get(k, 0)) for k in range(max(sizes, default=0) + 1)) + "]"), "array<bigint>")
    return placed.withColumn("rank", F.get(table, part.cast("int")) + within + 1).drop("_place")


def resample(
    df: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    buckets: int = BUCKETS,
    least_words: int = 20,
    percent: int = 25,
    seed: int = SEED,
) -> DataFrame:
    """One row per row of ``df``: id, n_features, weight, score, rank.

    Of the texts with at least ``least_words`` words, ``percent`` hundredths (rounded
    down) of highest score are drawn, ties to the smaller id (a null id first); their
    ranks count from 1, all other rows have none. Null texts have no words and weight
    0. Rows that repeat an id and a score get ranks of their own in an unspecified
    order. A null id has the noise of an empty one. Without target texts gains still
    follow from the raw counts. Other columns of both tables are ignored.
    """
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = gains(bucket_counts(rows.select("text"), buckets), bucket_counts(target.select(F.col(target_col).alias("text")), buckets))
    every = cut(scored(rows, found, seed, kind)).withColumn("_row", F.monotonically_increasing_id())
    fit = every.where(F.col("n_words") >= least_words)
    drawn = percent * fit.count() // 100
    order = (F.col("score").desc(), F.col("id").asc_nulls_first(), F.col("_row").asc())
    places = ranked(fit, *order).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = every.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    out = places.unionByName(rest)
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
