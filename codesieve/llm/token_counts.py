"""Token counts by a two-tier lookup of pre-tokens, all on the map side.

A text is cut into pre-tokens by the tokenizer's own pattern. The two libraries
know different Unicode versions: a stretch between blanks that holds a character
of which they disagree goes to the tokenizer whole. The lengths of
frequent pre-tokens come from a broadcast table of at most ``table_size`` short
entries; a miss is encoded once per worker and cached. No pre-token is shuffled.

The table is filled from a bounded sample of rows. It decides speed only: every
pre-token of every text is counted with the tokenizer's own result.
"""

from __future__ import annotations

import heapq
import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, pre_tokenizers

from codesieve.llm.common import bounded_ids, map_frames

TABLE_SIZE = 60_000
SAMPLE_ROWS = 2_000
ENTRY_CHARS = 32
CACHE_SIZE = 500_000
SPECIAL = "<|endoftext|>"
PATTERN = regex.compile(public_tokenizers.PATTERN)

#: Where a stretch may end whatever the pattern: behind a character, before a blank.
STRETCH = re.compile(r"(?<=\S)(?=[ \t\n\r])")

_TOKENIZERS: dict[str, Tokenizer] = {}
_TABLES: dict[str, "Lengths"] = {}


def tokenizer_of(path: str) -> Tokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = Tokenizer.from_file(path)
    return _TOKENIZERS[path]


def characters() -> str:
    """All characters but the planes that no Unicode version fills, and surrogates."""
    return "".join(map(chr, [*range(0xD800), *range(0xE000, 0x40000), *range(0xE0000, 0xF0000)]))


@lru_cache
def odd_letters() -> frozenset[str]:
    """Characters that only one of the two libraries takes for a letter, a number
    or white space."""
    every, odd = characters(), set()
    for kind in (r"\p{L}+", r"\p{N}+", r"\s+"):
        theirs = pre_tokenizers.Split(Regex(kind), "removed", invert=True).pre_tokenize_str(every)
        odd |= set("".join(piece for piece, _ in theirs)) ^ set("".join(regex.findall(kind, every)))
    return frozenset(odd)


def pattern_of(chars: Iterable[str]) -> str:
    """A pattern that finds one of the characters; nothing if there are none."""
    ranges: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "[" + "".join(f"\\U{lo:08x}-\\U{hi:08x}" for lo, hi in ranges) + "]" if ranges else r"(?!)"


class Lengths(dict):
    """Pre-token to number of tokens: frequent entries and a bounded cache.

    ``odd`` is the pattern of the characters that need the tokenizer itself.
    """

    def __init__(self, frequent: dict[str, int], path: str, odd: str | None = None) -> None:
        super().__init__(frequent)
        self.frequent, self.path = frequent, path
        self.odd = re.compile(pattern_of(odd_letters()) if odd is None else odd)

    def encoded(self, text: str) -> int:
        return len(tokenizer_of(self.path).encode(text, add_special_tokens=False).ids)

    def __missing__(self, piece: str) -> int:
        if len(self) > CACHE_SIZE + len(self.frequent):
            self.clear()
            self.update(self.frequent)
        n = self.encoded(piece)
        if len(piece) <= 4 * ENTRY_CHARS:
            self[piece] = n
        return n


def count_tokens(text: str | None, lengths: Lengths) -> int:
    """Tokens of one whole text; the special string counts as one token."""
    if not text:
        return 0
    segments = text.split(SPECIAL)
    find, get, odd = PATTERN.findall, lengths.__getitem__, lengths.odd.search
    n = len(segments) - 1
    for segment in segments:
        if segment.isascii() or not odd(segment):
            n += sum(map(get, find(segment)))
        else:
            n += sum(lengths.encoded(x) if odd(x) else sum(map(get, find(x))) for x in STRETCH.split(segment))
    return n


def frequent_lengths(df: DataFrame, id_col: str, text_col: str, path: str, table_size: int, sample_rows: int) -> dict[str, int]:
    """The commonest pre-tokens of a bounded sample, with their lengths."""
    ids = bounded_ids(df.select(F.col(id_col).alias("chosen")), "chosen", sample_rows)
    sample = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(
        F.broadcast(ids), F.col("id") == F.col("chosen")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                for segment in (text or "").split(SPECIAL):
                    seen.update(x for x in PATTERN.findall(segment) if len(x) <= ENTRY_CHARS)
        top = heapq.nsmallest(table_size, seen.items(), key=lambda x: (-x[1], x[0]))
        yield pd.DataFrame(top, columns=["piece", "n"])

    # Each scan task counts its own sample rows; the counts meet by piece.
    counted = map_frames(sample.select("text"), run, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    pieces = [r["piece"] for r in counted.orderBy(F.col("n").desc(), "piece").limit(table_size).collect()]
    encoded = tokenizer_of(path).encode_batch(pieces, add_special_tokens=False)
    return {p: len(e.ids) for p, e in zip(pieces, encoded)}


def token_counts(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    limit: int = 1024,
    table_size: int = TABLE_SIZE,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """One row per row of ``df``: id, n_bytes, n_tokens, over_limit.

    Tokens as the tokenizer file at ``path`` gives them for the whole text,
    without added special tokens. Null and empty texts have none. Repeated rows
    and null ids stay. Other columns of ``df`` are ignored.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    run_id = uuid.uuid4().hex
    odd = pattern_of(odd_letters())
    shared = df.sparkSession.sparkContext.broadcast(frequent_lengths(df, id_col, text_col, path, table_size, sample_rows))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lengths = _TABLES.get(run_id)
        if lengths is None:
            _TABLES.clear()
            lengths = _TABLES[run_id] = Lengths(shared.value, path, odd)
        for batch in batches:
            yield pd.DataFrame(
                {"id": batch["id"], "n_bytes": batch["n_bytes"], "n_tokens": [count_tokens(t, lengths) for t in batch["text"]]}
            )

    kind = df.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    counted = map_frames(rows, run, f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
