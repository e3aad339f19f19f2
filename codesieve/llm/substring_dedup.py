"""Repeated word windows by level-wise doubling.

A window of 35 words can only repeat if the windows of 9 words inside it do.
So the levels are 9, 18 and 35 words: what is found once only at one length
drops out, and what is left is extended to twice that length.

Each 35-word window is stood for by one of its 9-word (18-word) windows, that of
least hash. Equal windows choose the same one, so it is enough to look up the
chosen positions, one in fourteen of all, and the result is still exact.

Equal texts are merged before the first level and count twice. A task merges
equal windows before the shuffle, so that a window that is everywhere sends one
row per task. Shorter windows are compared by 64-bit hashes, which can only let
one too many through to the next level; those of the last level, which decides,
by two such hashes, and texts by two as well.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codesieve.llm.common import map_frames, mix, window_hashes, word_hashes, words_of

WINDOW = 35
FLUSH = 2_000_000
#: Sets the words' second hashes apart from their first.
SECOND = np.uint64(0xD6E8FEB86659FD93)
_U64 = np.uint64


def levels_of(window: int) -> list[int]:
    """A quarter of the window, doubled up to the window itself."""
    level = max(1, -(-window // 4))
    levels = []
    while level < window:
        levels.append(level)
        level *= 2
    return [*levels, window]


def chosen(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` hashes the place of the least, leftmost first."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    if width == 1:
        return np.arange(n)
    view = np.lib.stride_tricks.sliding_window_view(hashes, width)
    at = np.concatenate([view[k : k + 65536].argmin(axis=1) for k in range(0, n, 65536)])
    return at + np.arange(n)


class _Merger:
    """Windows of one task: equal ones share a row, the others are settled."""

    def __init__(self) -> None:
        self.parts: list[tuple] = []
        self.rows = 0

    def add(self, th: tuple[int, int], weight: int, hashes: tuple[np.ndarray, ...], places: np.ndarray) -> None:
        n = len(places)
        if n:
            self.parts.append((np.full(n, th[0]), np.full(n, th[1]), places.astype(np.int32), np.full(n, weight, np.int8), *hashes))
            self.rows += n

    def flush(self) -> Iterator[pd.DataFrame]:
        if not self.parts:
            return
        columns = [np.concatenate(x) for x in zip(*self.parts)]
        self.parts, self.rows = [], 0
        order = np.lexsort(columns[:3:-1])  # by the first hash, then by the second
        t1, t2, place, weight, *hashes = (x[order] for x in columns)
        h = hashes[0]
        first = np.concatenate(([True], np.any([x[1:] != x[:-1] for x in hashes], axis=0)))
        starts = np.flatnonzero(first)
        total = np.add.reduceat(weight.astype(np.int64), starts)
        count = np.diff(np.append(starts, len(h)))
        seen = np.repeat(np.minimum(total, 2), count)
        # A repeat within the task is settled: it goes on under a key of its own.
        hashes[0] = np.where(first, h, mix(h ^ mix(t1.view(_U64)) ^ mix(place.astype(_U64))))
        # Back in the order of the texts, whose keys then compress well in the shuffle.
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        names = ["h", "h2"][: len(hashes)]
        for at in range(0, len(h), 200_000):
            s = back[at : at + 200_000]
            keys = {name: x[s].view(np.int64) for name, x in zip(names, hashes)}
            yield pd.DataFrame({**keys, "th1": t1[s], "th2": t2[s], "place": place[s], "weight": seen[s].astype(np.int32)})


def _emit(window: int, before: int | None, level: int):
    """Rows (h, text, place, weight) for the windows of ``level`` words that
    stand for windows still alive after the level ``before``; the last level has h2 too."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        merger = _Merger()
        for batch in batches:
            found = batch["found"] if before else [None] * len(batch)
            for th1, th2, copies, text, alive in zip(batch["th1"], batch["th2"], batch["copies"], batch["text"], found):
                words = word_hashes(text)
                if len(words) < window:
                    continue
                hashes = window_hashes(words, level)
                places = chosen(hashes, window - level + 1)
                if before:
                    live = np.zeros(len(words), bool)
                    live[np.asarray(alive, np.int64)] = True
                    places = places[live[chosen(window_hashes(words, before), window - before + 1)]]
                places = np.unique(places)
                kept = (hashes[places],)
                if level == window:
                    kept += (window_hashes(mix(words ^ SECOND), level)[places],)
                merger.add((th1, th2), min(copies, 2), kept, places)
                if merger.rows > FLUSH:
                    yield from merger.flush()
        yield from merger.flush()

    return run


def _apply(window: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for th1, th2, text, found in zip(batch["th1"], batch["th2"], batch["text"], batch["found"]):
                words = words_of(text)
                removed = 0
                kept = words
                if found is not None and len(found):
                    at = np.asarray(found, np.int64)
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    removed = int(gone.sum())
                    kept = [w for w, g in zip(words, gone.tolist()) if not g]
                text = b" ".join(kept)
                out.append((th1, th2, len(words), removed, text.decode(), hashlib.sha256(text).hexdigest()))
            yield pd.DataFrame(out, columns=["th1", "th2", "n_words", "n_removed", "kept_text", "kept_sha256"])

    return run


def repeated_windows(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """(th1, th2, found): per text the first words of its repeated windows.

    ``texts`` has th1, th2, copies, text: each text once.
    """
    found = None
    before = None
    for level in levels_of(window):
        source = texts if found is None else texts.join(found, ["th1", "th2"])
        keys = ["h", "h2"] if level == window else ["h"]
        schema = ", ".join(f"{k} long" for k in [*keys, "th1", "th2"]) + ", place int, weight int"
        rows = map_frames(source, _emit(window, before, level), schema)
        total = F.sum("weight").over(Window.partitionBy(*keys))
        alive = rows.withColumn("total", total).where("total >= 2")
        found = alive.groupBy("th1", "th2").agg(F.collect_list("place").alias("found"))
        before = level
    return found


def substring_dedup(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_text: bool = False
) -> DataFrame:
    """One row per row of ``df``: id, n_words, n_removed, kept_sha256, and
    kept_text if ``with_text``.

    A word goes if it lies in a window of ``window`` words whose sequence also
    starts elsewhere in the input, the same text included. All windows are
    judged on the input, so of two copies neither stays. Null counts as empty;
    texts shorter than a window lose nothing. Repeated rows count as repeats.
    Other columns of ``df`` are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = df.select(
        F.col(id_col).alias("id"), F.xxhash64(text).alias("th1"), F.xxhash64(F.lit(window), text).alias("th2"), text.alias("text")
    )
    texts = keyed.groupBy("th1", "th2").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    done = map_frames(
        texts.join(repeated_windows(texts, window), ["th1", "th2"], "left"),
        _apply(window),
        "th1 long, th2 long, n_words long, n_removed long, kept_text string, kept_sha256 string",
    )
    if not with_text:
        done = done.drop("kept_text")
    return keyed.select("id", "th1", "th2").join(done, ["th1", "th2"]).drop("th1", "th2").withColumnRenamed("id", id_col)
