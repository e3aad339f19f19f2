"""SimHash near-duplicates over a Gray-order hierarchical index.

1. A fingerprint per text: each bit is the majority of the bits of the XXH64
   values of its word shingles.
2. Candidate search, for at most ``max_diff`` differing bits. The 64 bits are
   cut into blocks; two such fingerprints agree on some choice of
   ``blocks - max_diff`` blocks, so each fingerprint is listed under every
   choice. Lists are range-partitioned by (choice, shared bits, Gray rank), so
   that a hot list is split over tasks by Gray rank. Neighbours in Gray order
   share bit patterns; each run of them is a node that keeps what all its
   members share.
3. Nodes of one list are compared from upper nodes down: those of one prefix of
   the Gray rank are a group that keeps what they share, groups too far apart are
   pruned whole, and the join goes on by pairs of groups, so a hot list has many keys.
   Inside a node and between two nodes, a tree of such patterns is walked. A parent's pattern is factored out of its children, so differences
   add up on the way down, and a pair of groups is pruned once they exceed
   ``max_diff``.
4. Links come out as spanning stars and feed ``connected_components``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.llm.common import SMALL_ROWS, cut, map_frames, numbered, small_side, words_of
from codesieve.llm.components import connected_components

_U64 = np.uint64
NODE = 256
#: Bits of the Gray rank by which the upper nodes of a list are grouped. The rank is
#: that of the bits which the list does not share, so all lists have groups.
LEVELS = (8, 16)
FAN = 16
BLOCKS = 6


def simhash(text: str | None, shingle: int = 4) -> int:
    """Fingerprint of one text; zero without words. Whole texts, by chunks."""
    words = words_of(text)
    if not words:
        return 0
    words = [w.lower() for w in words]  # bytes.lower() touches A-Z only
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(shingle, len(words))
    first, last = starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, len(first), 65536):
        hashes = np.array(
            [digest(joined[s:e], 42) for s, e in zip(first[at : at + 65536], last[at : at + 65536])],
            dtype="<u8",
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    chosen = np.flatnonzero(2 * counts > len(first))
    return int(sum(1 << int(b) for b in chosen))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp): a signed long that holds the 64 bits. Null text counts as empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = np.array([simhash(t, shingle) for t in batch["text"]], dtype=_U64)
            yield pd.DataFrame({"id": batch["id"], "fp": values.view(np.int64)})

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_frames(rows, run, f"id {kind}, fp long").withColumnRenamed("id", id_col)


def gray_rank(fp: Column) -> Column:
    """Place of a fingerprint in the Gray sequence: the prefix XOR of its bits."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp


def _choices(max_diff: int, blocks: int) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """The block choices one of which two linked fingerprints share: the mask of the
    shared bits, and (lowest bit, bits, place) of the other blocks, packed from the top."""
    if not 0 <= max_diff < blocks:
        raise ValueError("more blocks than differing bits are needed")
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    parts = list(zip(edges, edges[1:]))
    out = []
    for chosen in combinations(range(blocks), blocks - max_diff):
        mask = sum(((1 << hi - lo) - 1) << lo for lo, hi in (parts[k] for k in chosen))
        others, top = [], 64
        for lo, hi in (parts[k] for k in range(blocks) if k not in chosen):
            top -= hi - lo
            others.append((lo, hi - lo, top))
        out.append((mask, others))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _packed(fp: Column, others: list[tuple[int, int, int]]) -> Column:
    """The bits that a list does not share, from the top bit on."""
    out = F.lit(0).cast("long")
    for lo, bits, place in others:
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << bits) - 1)), place))
    return out


def _unpacked(rank: np.ndarray, choice: np.ndarray, shared: np.ndarray, layout: list[tuple[int, list[tuple[int, int, int]]]]) -> np.ndarray:
    """Fingerprints from their lists' shared bits and their Gray ranks."""
    packed, out = _unrank(rank), shared.copy()
    for c in np.unique(choice):
        own = choice == c
        for lo, bits, place in layout[c][1]:
            out[own] |= ((packed[own] >> _U64(place)) & _U64((1 << bits) - 1)) << _U64(lo)
    return out


class _Tree:
    """Groups of FAN in Gray order, level by level up to one root.

    ``ones`` and ``zeros`` of a group hold the bits that all members share,
    less those that its parent has already.
    """

    def __init__(self, fps: np.ndarray) -> None:
        full = [(fps, ~fps)]
        while len(full[-1][0]) > 1:
            ones, zeros = full[-1]
            cuts = np.arange(0, len(ones), FAN)
            full.append((np.bitwise_and.reduceat(ones, cuts), np.bitwise_and.reduceat(zeros, cuts)))
        self.levels = []
        for depth, (ones, zeros) in enumerate(full):
            if depth + 1 < len(full):
                parent = np.arange(len(ones)) // FAN
                known = full[depth + 1][0][parent] | full[depth + 1][1][parent]
            else:
                known = np.zeros(len(ones), _U64)
            self.levels.append((ones, zeros, ones & ~known, zeros & ~known))
        self.sizes = [len(x[0]) for x in full]


def _children(group: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each group its members one level below; the index of the group too."""
    low = group * FAN
    n = np.minimum(FAN, size - low)
    of = np.repeat(np.arange(len(group)), n)
    inner = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    return low[of] + inner, of


def close_pairs(left: np.ndarray, right: np.ndarray | None, max_diff: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs at most ``max_diff`` bits apart, by walking both trees down.

    ``right`` None joins ``left`` with itself (pairs i < j).
    """
    own = right is None
    a = _Tree(left)
    b = a if own else _Tree(right)
    i = j = np.zeros(1, np.int64)
    da, db = len(a.sizes) - 1, len(b.sizes) - 1
    # One side goes down a level at a time. Bits that both sides know are
    # counted once: when the later of the two learns them.
    seen = np.bitwise_count((a.levels[da][0] & b.levels[db][1]) | (a.levels[da][1] & b.levels[db][0])).astype(np.int64)
    while da or db:
        if da >= db:
            i, of = _children(i, a.sizes[da - 1])
            j, seen = j[of], seen[of]
            da -= 1
            new1, new0 = a.levels[da][2][i], a.levels[da][3][i]
            seen = seen + np.bitwise_count((new1 & b.levels[db][1][j]) | (new0 & b.levels[db][0][j]))
        else:
            j, of = _children(j, b.sizes[db - 1])
            i, seen = i[of], seen[of]
            db -= 1
            new1, new0 = b.levels[db][2][j], b.levels[db][3][j]
            seen = seen + np.bitwise_count((new1 & a.levels[da][1][i]) | (new0 & a.levels[da][0][i]))
        keep = seen <= max_diff
        if own and da == db:
            keep &= i <= j
        i, j, seen = i[keep], j[keep], seen[keep]
    if own:
        keep = i < j
        i, j = i[keep], j[keep]
    return i, j


def _stars(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) for the classes that the pairs make of 0..n-1."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        root = new[root]
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
    while True:
        up = root[root]
        if (up == root).all():
            break
        root = up
    member = np.flatnonzero(root != np.arange(n))
    return member, root[member]


def _frame(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})


def _unrank(rank: np.ndarray) -> np.ndarray:
    return rank ^ (rank >> _U64(1))


_NODE_SCHEMA = "choice int, shared long, first long, ones long, zeros long, members binary, a long, b long"


def _build_nodes(max_diff: int, blocks: int):
    """Nodes of NODE members at most, and the links inside each of them.

    Rows come sorted by (choice, shared, rank). A list that ends inside this
    task and fits one node needs no node row: its links are all found here.
    """

    layout = _choices(max_diff, blocks)

    def lists(batches):
        rest = None
        for batch in batches:
            rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            keys = rest[["choice", "shared"]].to_numpy()
            edge = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            last = int(edge[-1]) if len(edge) else 0
            if len(rest) - last >= 8 * NODE:
                last += (len(rest) - last) // NODE * NODE
            if last:
                yield rest.iloc[:last], edge[edge < last]
                rest = rest.iloc[last:].reset_index(drop=True)
        if rest is not None and len(rest):
            keys = rest[["choice", "shared"]].to_numpy()
            yield rest, np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        empty = {"choice": 0, "shared": 0, "first": 0, "ones": 0, "zeros": 0, "members": None}
        previous = None
        for rows, edge in lists(batches):
            nodes, links_a, links_b = [], [], []
            choice, shared = rows["choice"].to_numpy(), rows["shared"].to_numpy()
            fps = _unpacked(rows["rank"].to_numpy().view(_U64), choice, shared.view(_U64), layout)
            bounds = [0, *edge.tolist(), len(rows)]
            sizes = np.diff(bounds)
            # Short lists, all at once: compare each row with the next few.
            short = np.repeat(sizes <= FAN, sizes)
            of = np.repeat(np.arange(len(sizes)), sizes)
            for shift in range(1, min(FAN, len(fps))):
                near = short[:-shift] & (of[:-shift] == of[shift:])
                near &= np.bitwise_count(fps[:-shift] ^ fps[shift:]) <= max_diff
                at = np.flatnonzero(near)
                links_a.append(fps[at])
                links_b.append(fps[at + shift])
            final = len(sizes) - 1
            for k in sorted({0, final} | set(np.flatnonzero(sizes > FAN).tolist())):
                lo, hi = bounds[k], bounds[k + 1]
                key = (int(choice[lo]), int(shared[lo]))
                for s in range(lo, hi, NODE):
                    part = fps[s : min(hi, s + NODE)]
                    if hi - lo > FAN:
                        i, j = close_pairs(part, None, max_diff)
                        m, r = _stars(i, j, len(part))
                        links_a.append(part[m])
                        links_b.append(part[r])
                    nodes.append(
                        (*key, int(rows["rank"].iat[s]), int(np.bitwise_and.reduce(part).view(np.int64)),
                         int(np.bitwise_and.reduce(~part).view(np.int64)), part.astype("<u8").tobytes(),
                         previous is not None and key != previous and k != final and hi - lo <= NODE)
                    )
            previous = (int(choice[-1]), int(shared[-1]))
            kept = [x[:6] for x in nodes if not x[6]]
            if kept:
                yield pd.DataFrame(kept, columns=list(empty)).assign(a=None, b=None)
            a, b = np.concatenate(links_a or [fps[:0]]), np.concatenate(links_b or [fps[:0]])
            if len(a):
                yield _frame(a, b).assign(**empty)[["choice", "shared", "first", "ones", "zeros", "members", "a", "b"]]

    return run


def _cross(max_diff: int):
    """Links between two nodes of one list, as stars over their members."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for left, right in zip(batch["left"], batch["right"]):
                x, y = np.frombuffer(left, "<u8"), np.frombuffer(right, "<u8")
                i, j = close_pairs(x, y, max_diff)
                both = np.concatenate((x, y))
                m, r = _stars(i, j + len(x), len(both))
                out.append((both[m], both[r]))
            if out:
                yield _frame(np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out]))

    return run


def _close_groups(parts: DataFrame, key: str, up: str | None, pairs: DataFrame | None, max_diff: int, leaf: bool = False) -> DataFrame:
    """(choice, shared, left, right) of the groups ``key`` that may hold links, below
    the pairs of upper groups ``up``; a group with itself too unless it is a ``leaf``."""
    keys = ["choice", "shared"]

    def side(name: str) -> DataFrame:
        above = [F.col(up).alias(f"up_{name}")] if up else []
        return parts.select(*keys, *above, F.col(key).alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("ones", "zeros")])

    order = F.col("left") < F.col("right") if leaf else F.col("left") <= F.col("right")
    if pairs is None:
        joined = side("left").join(side("right"), keys)
    else:
        above = pairs.select(*keys, F.col("left").alias("up_left"), F.col("right").alias("up_right"))
        joined = above.join(side("left"), [*keys, "up_left"]).join(side("right"), [*keys, "up_right"])
        order = (F.col("up_left") < F.col("up_right")) | ((F.col("up_left") == F.col("up_right")) & order)
    apart = F.bit_count(
        F.col("left_ones").bitwiseAND(F.col("right_zeros")).bitwiseOR(F.col("left_zeros").bitwiseAND(F.col("right_ones")))
    )
    return joined.where(order & (apart <= max_diff)).select(*keys, "left", "right")


def _groups(nodes: DataFrame, bits: int, up: str | None = None) -> DataFrame:
    """Upper nodes: those of one list and one prefix of the rank, with what they share."""
    return nodes.groupBy("choice", "shared", *([up] if up else []), f"g{bits}").agg(F.bit_and("ones").alias("ones"), F.bit_and("zeros").alias("zeros"))


def _prefixed(nodes: DataFrame) -> DataFrame:
    return nodes.withColumns({f"g{p}": F.shiftrightunsigned("first", 64 - p) for p in LEVELS})


def _node_pairs(nodes: DataFrame, max_diff: int) -> DataFrame:
    """(left, right): members of each two nodes of one list that may hold a link.
    Pairs are found by the nodes' keys; members come to the pairs that are left."""
    plain = _prefixed(nodes.drop("members"))
    up = pairs = None
    for p in LEVELS:
        pairs = _close_groups(_groups(plain, p, up), f"g{p}", up, pairs, max_diff)
        up = f"g{p}"
    found = _close_groups(plain, "first", up, pairs, max_diff, leaf=True)
    for name in ("left", "right"):
        own = nodes.select("choice", "shared", F.col("first").alias(name), F.col("members").alias(f"{name}_members"))
        found = found.join(own, ["choice", "shared", name])
    return found.select(F.col("left_members").alias("left"), F.col("right_members").alias("right"))


def links(fps: DataFrame, max_diff: int = 4, blocks: int = BLOCKS) -> DataFrame:
    """Edges (a, b) that join all fingerprints of one class, from distinct ``fp``.

    Edges span each class within a node; they are not all its pairs.
    """
    fp = F.col("fp")
    lists = [F.struct(fp.bitwiseAND(F.lit(_signed(m))).alias("shared"), _packed(fp, others).alias("packed")) for m, others in _choices(max_diff, blocks)]
    listed = fps.select(F.posexplode(F.array(*lists)).alias("choice", "list")).select(
        "choice", "list.shared", gray_rank(F.col("list.packed")).alias("rank")
    )
    parts = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = listed.repartitionByRange(parts, "choice", "shared", "rank").sortWithinPartitions("choice", "shared", "rank")
    found = cut(map_frames(dealt, _build_nodes(max_diff, blocks), _NODE_SCHEMA))
    nodes = found.where("members IS NOT NULL").select("choice", "shared", "first", "ones", "zeros", "members")
    across = map_frames(_node_pairs(nodes, max_diff), _cross(max_diff), "a long, b long")
    return found.where("a IS NOT NULL").select("a", "b").union(across).distinct()


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_diff: int = 4, shingle: int = 4
) -> DataFrame:
    """One row per row of ``df``: id, fingerprint (16 hex digits), component_id.

    component_id is the least id of the rows that links reach, the row itself
    included. Texts without words (null, empty) share fingerprint zero and so
    one class. Null ids keep their row; a class of null ids only has a null
    component_id. Repeated rows stay. Other columns of ``df`` are ignored.
    """
    marked = cut(fingerprints(df, id_col, text_col, shingle))
    vertices = cut(marked.groupBy("fp").agg(F.min(id_col).alias("least")))
    roots = connected_components(links(vertices.select("fp"), max_diff))
    linked = vertices.join(roots, F.col("fp") == F.col("node"))
    least = linked.groupBy("root").agg(F.min("least").alias("component"))
    linked = linked.join(least, "root").select("fp", "component")
    classes = vertices.join(linked, "fp", "left").select(
        F.col("fp").alias("vertex"), F.coalesce("component", "least").alias("component_id")
    )
    # Written, so that the skew join can split the rows of a hot fingerprint.
    return marked.join(cut(classes), F.col("fp") == F.col("vertex")).select(
        id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one row of each class; its columns are unchanged.

    The row of least id stays, null ids lose. Rows are judged one by one, as in
    ``drop_exact_duplicates``.
    """
    rows = numbered(df)
    named = rows.select("_row", F.struct(F.col(id_col).isNull().alias("last"), F.col(id_col).alias("id"), "_tie", "_row").alias("key"))
    members = cut(near_duplicates(rows, "_row", text_col).select("_row", "component_id").join(named, "_row"))
    stay = small_side(
        members.groupBy("component_id").agg(F.min("key").alias("least"), F.count("*").alias("n"))
        .where("n > 1").select("component_id", F.col("least._row").alias("stay")),
        SMALL_ROWS,
    )
    gone = small_side(members.join(stay, "component_id").where("_row != stay").select("_row"), SMALL_ROWS)
    return rows.join(gone, "_row", "left_anti").select(*df.columns)
