"""Best-fit-decreasing packing of token sequences with a segment tree.

Texts become token ids; only those longer than a sequence are cut. Full pieces
are sequences of their own. The others are dealt by hash to shards of some
``shard_pieces`` pieces, and each shard is packed longest first: a segment tree
over remaining capacities finds the tightest open sequence in logarithmic time.

Best fit leaves at most one sequence of a shard half empty or more. Those are
packed once more, as pieces, in shards of their own, so that the number of shards
does not show in the number of sequences.
"""

from __future__ import annotations

import gc
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesieve.llm.common import SMALL_ROWS, cut, map_frames, reach, small_side
from codesieve.llm.token_counts import characters, odd_letters, pattern_of, tokenizer_of

CAPACITY = 4096
END_ID = 1
SHARD_PIECES = 20_000
#: Words kept, pieces encoded in one call, characters of a kept word, texts at a time.
CACHE_SIZE, TOGETHER, LONGEST, SLICE = 800_000, 256, 128, 500
#: The special strings and the pre-token pattern of word_bpe_49k.json (fixed values).
SPECIALS = regex.compile(r"(<\|startoftext\|>|<\|endoftext\|>)")
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Marks that are a piece of their own behind a word.
MARKS = frozenset(",.;:!?")

_CACHES: dict[str, "WordIds"] = {}


class WordIds(dict):
    """Raw word to its ids, as little-endian bytes: a bounded worker cache.

    The tokenizer lower-cases, normalises and drops white space, and never joins
    characters across a space, so a word's ids do not depend on its neighbours.
    The first CACHE_SIZE words stay; others are held for one call only. Words with
    a character that ``odd`` finds go to the tokenizer whole.
    """

    def __init__(self, path: str, odd: str | None = None) -> None:
        super().__init__({"": b""})
        self.tokenizer = tokenizer_of(path)
        self.odd = re.compile(pattern_of(odd_characters(path)) if odd is None else odd)
        self.pieces: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        for special in ("<|startoftext|>", "<|endoftext|>"):
            self[special] = np.array([vocabulary[special]], "<u4").tobytes()

    def learn(self, words: set[str]) -> list[str]:
        """Encode new words together; returns those to forget after use."""
        strange = [w for w in words if not w.isascii() and self.odd.search(w)]
        for w in strange:
            self[w] = self._ids(w)
        known, cut_up = self.pieces, {w: _cut(w) for w in words.difference(strange)}
        new = list(set().union(*cut_up.values()).difference(known))
        fresh: dict[str, bytes] = {}
        for at in range(0, len(new), TOGETHER):
            fresh.update(self._encode(new[at : at + TOGETHER]))
        if len(known) < CACHE_SIZE:
            known.update((p, ids) for p, ids in fresh.items() if len(p) <= LONGEST)
        for w, ps in cut_up.items():
            self[w] = b"".join([known.get(p) or fresh[p] for p in ps])
        if len(self) > CACHE_SIZE + len(words):
            return list(words)
        return [w for w in words if len(w) > LONGEST]

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _encode(self, pieces: list[str]) -> dict[str, bytes]:
        """Pieces in one call, joined by spaces; a word-end token closes each."""
        ids = np.array(self.tokenizer.encode(" ".join(pieces), add_special_tokens=False).ids, "<u4")
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(pieces) or stops[-1] != len(ids):
            return {p: self._ids(p) for p in pieces}
        raw = ids.tobytes()
        return {p: raw[4 * lo : 4 * hi] for p, lo, hi in zip(pieces, [0, *stops[:-1].tolist()], stops.tolist())}


@lru_cache
def odd_characters(path: str) -> frozenset[str]:
    """Characters that the tokenizer classes or normalises by another Unicode version."""
    every, normal = characters().replace("|", ""), tokenizer_of(path).normalizer.normalize_str
    # A character whose small form is several may leave marks in another order.
    odd = set(odd_letters()) | {c for c in every if len(c.lower()) > 1}
    # Alone, between a letter and a mark of the lowest class, before one of the highest.
    for before, after in (("", ""), ("a", "\u0334"), ("", "\u0345")):
        framed = "|".join(before + c + after for c in every)
        theirs, ours = normal(framed).split("|"), re.sub(r"\s", " ", _normal(framed)).split("|")
        odd.update(c for c, x, y in zip(every, theirs, ours, strict=True) if x != y and not c.isspace())
    return frozenset(odd)


def _normal(word: str) -> str:
    if not word.isascii():
        # Each letter is lowered by itself: a final sigma is no special case.
        word = unicodedata.normalize("NFC", word).replace("Σ", "σ")
    return word.lower()


def _cut(word: str) -> tuple[str, ...] | list[str]:
    """The pieces of a word; plain words, with a mark behind or not, need no pattern."""
    low = _normal(word)
    if low.isascii():
        if low.isalpha():
            return (low,)
        if low[-1:] in MARKS and low[:-1].isalpha():
            return low[:-1], low[-1]
    return PATTERN.findall(low)


def _raw_words(text: str | None) -> list[str]:
    if not text:
        return []
    out: list[str] = []
    for k, part in enumerate(SPECIALS.split(text) if "<|" in text else [text]):
        if k % 2:
            out.append(part)
        else:
            out.extend(part.replace("\n", " ").split(" "))
    return out


def encode_all(texts: list[str | None], words: WordIds) -> list[bytes]:
    """Ids of each text as little-endian 32-bit integers, without the end id."""
    # No cycles arise here, and collector passes over millions of words cost time.
    collecting = gc.isenabled()
    gc.disable()
    try:
        split = [_raw_words(t) for t in texts]
        forget = words.learn(set().union(*split).difference(words))
        get = words.__getitem__
        out = [b"".join(map(get, ws)) for ws in split]
        for w in forget:
            del words[w]
        return out
    finally:
        if collecting:
            gc.enable()


#: Patterns of odd characters by tokenizer.
_ODD: dict[str, str] = {}


def odd_pattern(spark: SparkSession, path: str) -> str:
    """The pattern of ``odd_characters``, found once by a task: the tokenizer and the
    texts of all characters stay out of the driver's memory."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"odd": [pattern_of(odd_characters(p)) for p in batch["path"]]})

    if path not in _ODD:
        _ODD[path] = map_frames(spark.range(1).select(F.lit(path).alias("path")), run, "odd string").first()["odd"]
    return _ODD[path]


def encode(text: str | None, words: WordIds) -> bytes:
    return encode_all([text], words)[0]


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(id, piece, start, length, ids_crc32): one row per piece of each text."""
    path = path or public_tokenizers.path("word_bpe_49k.json")
    end = np.array([END_ID], "<u4").tobytes()
    odd = odd_pattern(df.sparkSession, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _CACHES.get(path) or _CACHES.setdefault(path, WordIds(path, odd))
        for batch in batches:
            index, out = [], []
            texts = batch["text"].tolist()
            for first in range(0, len(texts), SLICE):
                for row, ids in enumerate(encode_all(texts[first : first + SLICE], words), first):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        index.append(row)
                        out.append((k, at // 4, len(part) // 4, zlib.crc32(part)))
            frame = pd.DataFrame(out, columns=["piece", "start", "length", "ids_crc32"])
            frame.insert(0, "id", batch["id"].iloc[index].reset_index(drop=True))
            yield frame

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_frames(rows, run, f"id {kind}, piece int, start long, length long, ids_crc32 long").withColumnRenamed("id", id_col)


class CapacityTree:
    """Open sequences by remaining capacity, with the least that fits on request."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        at = room + self.leaves
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, sequence) with the least room of at least ``need``; removed."""
        count, at = self.count, need + self.leaves
        while not count[at]:
            while at & 1:  # a right child, or the root: nothing further right here
                at >>= 1
                if at <= 1:
                    return None
            at += 1
        while at < self.leaves:
            at = 2 * at if count[2 * at] else 2 * at + 1
        room = at - self.leaves
        sequence = self.open[room].pop()
        while at:
            count[at] -= 1
            at >>= 1
        return room, sequence


def best_fit_decreasing(lengths: list[int], capacity: int = CAPACITY) -> tuple[list[int], list[int]]:
    """(sequence, offset) of each piece; ``lengths`` come longest first."""
    tree, sequences, offsets, opened = CapacityTree(capacity), [], [], 0
    for length in lengths:
        found = tree.take(length)
        if found is None:
            found = capacity, opened
            opened += 1
        room, sequence = found
        sequences.append(sequence)
        offsets.append(capacity - room)
        if room > length:
            tree.add(room - length, sequence)
    return sequences, offsets


def pack(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    capacity: int = CAPACITY,
    shard_pieces: int = SHARD_PIECES,
    seed: int = 0,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece that holds the end id. Repeated rows are
    packed as often as they come, and spread over the shards. Reruns agree where
    the pieces come in the same partitions. Other columns of ``df`` are ignored.
    """
    cut_pieces = cut(pieces(df, id_col, text_col, path, capacity).withColumnRenamed(id_col, "id"))
    full = F.col("length") == capacity
    alone = cut_pieces.where(full).select(
        *cut_pieces.columns, (F.lit(-1) - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    packed = cut(_packed(cut_pieces.where(~full), capacity, shard_pieces, seed))
    # At most one sequence of a shard is half empty or more; these make new ones.
    open_ = packed.groupBy("sequence_id").agg(F.sum("length").alias("length")).where(F.col("length") * 2 <= capacity)
    merged = _packed(cut(open_.withColumnRenamed("sequence_id", "old")), capacity, shard_pieces, seed + 1)
    merged = small_side(
        merged.select(
            "old", (F.col("sequence_id") + (1 << 62)).alias("new"), F.col("offset").alias("ahead")
        ),
        SMALL_ROWS,
    )
    joined = packed.join(merged, F.col("sequence_id") == F.col("old"), "left").select(
        "id", "piece", "start", "length", "ids_crc32", F.coalesce("new", "sequence_id").alias("sequence_id"),
        (F.col("offset") + F.coalesce("ahead", F.lit(0))).alias("offset"),
    )
    return joined.union(alone).withColumnRenamed("id", id_col)


def _packed(rows: DataFrame, capacity: int, shard_pieces: int, seed: int) -> DataFrame:
    """``rows``, which must be written, with sequence_id and offset by ``length``.

    Rows are dealt by number, so that a shard holds some ``shard_pieces`` of them
    whatever they hold.
    """
    shards = max(1, round(rows.count() / shard_pieces))
    dealt = rows.withColumn("_row", F.monotonically_increasing_id())
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "_row"), F.lit(shards)).cast("int"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "_row"], ascending=[False, True])
        sequences, offsets = best_fit_decreasing(frame["length"].tolist(), capacity)
        number = np.array(sequences, np.int64) + (frame["shard"].to_numpy(np.int64) << 32)
        return frame.drop(columns=["shard", "_row"]).assign(sequence_id=number, offset=np.array(offsets, np.int64))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", sequence_id long, offset long"
    return reach(dealt).groupBy("shard").applyInPandas(run, schema)
