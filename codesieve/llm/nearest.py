"""Nearest neighbours by cosine: collision counting over sorted projections.

Each task holds some query vectors and reads its share of the vectors in blocks. A
block's index is one sorted array for each random projection. A query opens a window
around its own projection in each array; vectors inside collide with it. Windows grow
level by level (virtual rehashing: a wider window stands for a coarser hash, the
arrays stay), and a vector that collides under enough projections is verified with
its exact cosine. Growth ends once the windows would hold any vector nearer than the
k-th found, with probability ``sure``. What was found so far carries over to the
next block, where windows open at that width at once.

Two unit vectors at distance d differ by a normal number of deviation d under a
Gaussian projection; that gives the width. Projections are drawn, not fitted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codesieve.llm.common import reach

PROJECTIONS = 128
#: Share of projections under which a vector must collide to be verified.
THRESHOLD = 0.6
SURE = 0.97
SEED = 17
#: Cosines whose distances give the widths of the levels; the last window holds all.
LEVELS = (0.98, 0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.1, 0.0, -1.0, -math.inf)
#: Vectors of a block, queries whose counters are held at once.
BLOCK, AT_ONCE = 8192, 256
#: Query rows and vector rows of a cell, the work of a task.
QUERY_ROWS, VECTOR_ROWS, LEAST_ROWS = 32_768, 65_536, 4096
MOST_TASKS = 20_000
_NO_ID = np.iinfo(np.int64).max


def width_factor(projections: int, needed: int, sure: float) -> float:
    """Half a window's width, per unit of distance, at which a vector collides under
    ``needed`` of the projections with probability ``sure``."""

    def chance(p: float) -> float:
        return sum(math.comb(projections, i) * p**i * (1 - p) ** (projections - i) for i in range(needed, projections + 1))

    low, high = 0.0, 1.0
    for _ in range(50):
        p = (low + high) / 2
        low, high = (p, high) if chance(p) < sure else (low, p)
    return NormalDist().inv_cdf((1 + high) / 2)


def radius(cosine: np.ndarray) -> np.ndarray:
    """Distance of unit vectors of this cosine; infinite for none found."""
    return np.sqrt(np.maximum(2 - 2 * cosine, 0))


class Vectors:
    """Vectors that take part: finite and not zero. They are scaled by a power of
    two, which changes no cosine, so that no square leaves the doubles."""

    def __init__(self, ids: np.ndarray, marks: np.ndarray, values: np.ndarray) -> None:
        most = np.abs(values).max(axis=1)
        fit = np.isfinite(most) & (most > 0)
        self.ids, self.marks = ids[fit], marks[fit]
        self.values = np.ldexp(values[fit], -np.frexp(most[fit])[1][:, None])
        self.norms = np.sqrt((self.values * self.values).sum(axis=1))

    def __len__(self) -> int:
        return len(self.ids)

    def projected(self, projections: np.ndarray) -> np.ndarray:
        return ((self.values / self.norms[:, None]) @ projections).T.copy()


class Search:
    """Queries and the ``k`` nearest vectors that each has found so far."""

    def __init__(
        self, queries: Vectors, k: int, projections: int = PROJECTIONS, threshold: float = THRESHOLD, sure: float = SURE, seed: int = SEED
    ) -> None:
        self.queries, self.k = queries, k
        self.needed = math.ceil(threshold * projections)
        self.factor = width_factor(projections, self.needed, sure)
        self.projections = np.random.default_rng(seed).standard_normal((queries.values.shape[1], projections))
        self.places = queries.projected(self.projections)
        self.scores = np.full((len(queries), k), -np.inf)
        self.ids = np.full((len(queries), k), _NO_ID)
        self.verified = 0

    def block(self, vectors: Vectors) -> None:
        """Search one block of vectors."""
        if not len(vectors):
            return
        values = vectors.projected(self.projections)
        order = np.argsort(values, axis=1)
        arrays = np.take_along_axis(values, order, axis=1)
        for at in range(0, len(self.queries), AT_ONCE):
            self._some(vectors, arrays, list(order), np.arange(at, min(at + AT_ONCE, len(self.queries))))

    def _some(self, vectors: Vectors, arrays: np.ndarray, order: list[np.ndarray], which: np.ndarray) -> None:
        size = len(vectors)
        counts = np.zeros((len(which), size), np.int32)
        places = self.places[:, which]
        low = np.array([np.searchsorted(a, p) for a, p in zip(arrays, places)])
        high = low.copy()
        left = np.arange(len(which))
        width = self._widths(which, 0)
        for level in range(len(LEVELS)):
            new_low = np.array([np.searchsorted(a, p, "left") for a, p in zip(arrays, places[:, left] - width)])
            new_high = np.array([np.searchsorted(a, p, "right") for a, p in zip(arrays, places[:, left] + width)])
            bounds = np.stack((new_low, low[:, left], high[:, left], new_high))
            for i, q in enumerate(left):
                fresh = []
                for row, a, b, c, d in zip(order, *bounds[:, :, i].tolist()):
                    fresh += (row[a:b], row[c:d])
                count = counts[q]
                count += np.bincount(np.concatenate(fresh), minlength=size)
                hits = np.flatnonzero(count >= self.needed)
                count[hits] = -len(order) - 1  # verified once
                self._verify(vectors, hits, which[q])
            low[:, left], high[:, left] = new_low, new_high
            over = width >= self.factor * radius(self.scores[which[left], -1])
            left = left[~over]
            if not len(left):
                return
            width = self._widths(which[left], level + 1)

    def _widths(self, which: np.ndarray, level: int) -> np.ndarray:
        """A level's width, or less where the k-th vector found so far allows it.
        In the first level what earlier blocks gave decides alone."""
        found = radius(self.scores[which, -1])
        step = radius(np.float64(LEVELS[level]))
        return self.factor * (np.where(np.isfinite(found), found, step) if level == 0 else np.minimum(found, step))

    def _verify(self, vectors: Vectors, hits: np.ndarray, q: int) -> None:
        hits = hits[vectors.ids[hits] != self.queries.ids[q]]
        self.verified += len(hits)
        if not len(hits):
            return
        cosines = (vectors.values[hits] @ self.queries.values[q]) / (vectors.norms[hits] * self.queries.norms[q])
        near = cosines >= self.scores[q, -1]
        scores = np.concatenate((self.scores[q], cosines[near]))
        ids = np.concatenate((self.ids[q], vectors.ids[hits[near]]))
        first = np.lexsort((ids, -scores))[: self.k]
        self.scores[q], self.ids[q] = scores[first], ids[first]

    def found(self) -> pa.RecordBatch:
        q, _ = there = np.nonzero(self.scores > -np.inf)
        return pa.RecordBatch.from_arrays(
            [pa.array(self.queries.ids[q]), pa.array(self.queries.marks[q]), pa.array(self.ids[there]), pa.array(self.scores[there])],
            ["query_id", "mark", "vec_id", "score"],
        )


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of doubles; null components become NaN."""
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, int], Vectors]]:
    """((cell, dims, side), vectors): parts of a batch that share all three."""
    for batch in batches:
        keys = np.stack([batch[c].to_numpy() for c in ("cell", "dims", "side")])
        cuts = np.flatnonzero((np.diff(keys, axis=1) != 0).any(axis=0)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            if a < b:
                part = batch.slice(a, b - a)
                yield tuple(keys[:, a].tolist()), Vectors(part["id"].to_numpy(), part["mark"].to_numpy(), _matrix(part["vector"]))


def _joined(parts: list[Vectors]) -> Vectors:
    out = parts[0]
    if len(parts) > 1:
        out = object.__new__(Vectors)
        for name in ("ids", "marks", "values", "norms"):
            setattr(out, name, np.concatenate([getattr(p, name) for p in parts]))
    return out


def searched(batches: Iterator[pa.RecordBatch], k: int, options: dict) -> Iterator[pa.RecordBatch]:
    """Results of the cells of one task: rows are sorted by cell, dims and side, so
    that a cell's queries come ahead of its vectors."""
    held: dict[int, list[Vectors]] = {0: [], 1: []}
    state: Search | None = None
    cell = None

    def read() -> None:
        """Search what is held of the vectors as one block."""
        nonlocal state
        if held[1] and held[0]:
            state = Search(_joined(held[0]), k, **options) if state is None else state
            state.block(_joined(held[1]))
        held[1].clear()

    for (*key, side), part in _runs(batches):
        if key != cell:
            read()
            if state is not None:
                yield state.found()
            held[0].clear()
            state, cell = None, key
        held[side].append(part)
        if side and sum(map(len, held[1])) >= BLOCK:
            read()
    read()
    if state is not None:
        yield state.found()


def nearest(
    queries: DataFrame, vectors: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", **options
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each query, by cosine.

    Both tables have a long id and an array of numbers. Ranks count from 1, ties go to
    the smaller id; with fewer than ``k`` candidates all come. Rows of the query's own
    id are no candidates. Rows without an id, and vectors that are null, empty, zero or
    hold null or non-finite components, take no part; vectors of another length are no
    candidates. Query rows that repeat id and vector count once; those that repeat only
    the id are ranked each by itself; repeated candidates count as often as they occur.
    Other columns are ignored. ``options`` are those of ``Search``.
    """
    n, n_queries = vectors.count(), queries.count()
    shuffles = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = max(1, math.ceil(n / VECTOR_ROWS), min(math.ceil(n / LEAST_ROWS), shuffles))
    groups = max(1, math.ceil(n_queries / QUERY_ROWS))

    def rows(df: DataFrame) -> DataFrame:
        taken = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
        return taken.where(F.col("id").isNotNull() & (F.size("vector") > 0)).withColumn("mark", F.xxhash64("vector"))

    def dealt(df: DataFrame, side: int, cells: Column) -> DataFrame:
        return df.select(F.explode(cells).alias("cell"), F.size("vector").alias("dims"), F.lit(side).alias("side"), "id", "mark", "vector")

    group = F.pmod(F.xxhash64("id", "mark"), F.lit(groups))
    asked = dealt(
        rows(queries).dropDuplicates(["id", "vector"]), 0, F.transform(F.sequence(F.lit(0), F.lit(shares - 1)), lambda s: group * shares + s)
    )
    share = F.monotonically_increasing_id() % shares  # spreads rows that repeat an id
    numbered = rows(vectors).withColumn("share", share)
    offered = dealt(numbered, 1, F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: g * shares + F.col("share")))
    tasks = min(groups * shares, MOST_TASKS)
    cells = asked.unionByName(offered).repartitionById(tasks, (F.col("cell") % tasks).cast("int"))
    ordered = reach(cells).sortWithinPartitions("cell", "dims", "side", "id", "mark")
    found = ordered.mapInArrow(lambda batches: searched(batches, k, options), "query_id long, mark long, vec_id long, score double")
    best = Window.partitionBy("query_id", "mark").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_of_stated(df: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``nearest`` of the rows whose id is divisible by ``every``, against all rows."""
    return nearest(df.where(F.col(id_col) % every == 0), df, k, id_col, vector_col)
