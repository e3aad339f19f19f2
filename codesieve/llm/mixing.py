"""Mixing sources to target weights by Sainte-Lague apportionment.

1. Targets: the total of all sizes is shared by weight; no source goes above
   ``max_repeat`` times its own size, the excess is shared anew by weight.
2. Seats are blocks of equally many words. After k of them a source has the quotient
   target / (2 k + 1), and the highest quotients win the blocks of the whole mix.
   Nearly all seats are known beforehand, so only the few last ones are compared. A
   last block of its own length brings each source to its target in whole words.
3. Shards: a source's blocks are dealt to its bands and a band's to its shards by
   the same rule, by their sizes. The seat of least quotient, the last that was
   dealt, is the source's last block. A hot source has many bands, and no
   apportionment below the sources sees more than a bounded number of rows.
4. Selection: a shard's documents lie on a line in seeded hash order, cut into blocks.
   Where the quota holds the whole line, all is taken; of what is left, exactly as
   many whole blocks as the quota asks are chosen, evenly from a seeded start, and the
   words of a block cut short come from the first that was not chosen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codesieve.llm.common import cut, let, n_words_column, numbered, words_column

BLOCK_WORDS = 128
SHARD_DOCS, BAND_SHARDS = 2_000, 1_000
MAX_REPEAT = 3


def source_targets(stats: DataFrame, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Adds ``target`` to (source, size): one row per source.

    Sources in code-point order, null last, weigh 1, 2, 3 and so on repeating.
    Sources are filled in the order of cap per weight: those whose cap is
    reached stop there and the others share what is left by weight.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cap = F.col("size") * max_repeat
    rising = Window.orderBy(F.col("size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    after = rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    levelled = (
        stats.withColumn("weight", (F.row_number().over(order) - 1) % 3 + 1)
        .withColumn("left", F.sum("size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0)))
        .withColumn("heavy", F.sum("weight").over(after))
        .withColumn("free", cap * F.col("heavy") > F.col("left") * F.col("weight"))
        .withColumn("place", F.row_number().over(rising))
        .withColumn("first_free", F.min(F.when(F.col("free"), F.col("place"))).over(everything))
    )
    at_first = F.col("place") == F.col("first_free")
    pool = F.max(F.when(at_first, F.col("left"))).over(everything)
    weights = F.max(F.when(at_first, F.col("heavy"))).over(everything)
    shared = pool.cast("double") * F.col("weight") / weights
    capped = F.col("first_free").isNull() | (F.col("place") < F.col("first_free"))
    return levelled.withColumn(
        "target", F.when(capped, cap.cast("double")).otherwise(shared)
    ).select(*stats.columns, "weight", "target")


def targets(df: DataFrame, text_col: str = "text", source_col: str = "source", max_repeat: int = MAX_REPEAT) -> DataFrame:
    """One row per source: source, source_size in words, weight, target. See ``source_targets``."""
    stats = df.groupBy(F.col(source_col).alias("source")).agg(F.sum(n_words_column(F.col(text_col))).alias("size"))
    return source_targets(stats, max_repeat).select("source", F.col("size").alias("source_size"), F.col("weight").cast("long"), "target")


def sainte_lague(votes: DataFrame, group: list[str], key: str, vote: Column, seats: Column, cap: Column) -> DataFrame:
    """Adds ``quota`` to ``votes``: the seats of each group by highest quotient.

    ``seats`` is constant in a group, ``cap`` bounds a row's seats. At the divisor
    d a row has min(cap, round(vote / d)) seats. Two divisors are known between
    which the right one lies: rows surely get what the greater one gives them,
    and what the lesser one gives beyond is contested, some two seats a row.
    Ties go to the lesser key.
    """
    own = Window.partitionBy(*group)
    # Rows in the order in which their caps are reached as the divisor falls.
    order = own.orderBy((F.col("_vote") / (F.col("_cap") + 0.5)).desc(), F.col(key).asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    voting = F.when(F.col("_vote") > 0, 1).otherwise(0)
    all_votes, voters = F.sum("_vote").over(own), F.sum(voting).over(own)
    # A row has at least min(cap, vote / d - 1/2) seats; at ``_low`` these sum to
    # all seats. Without one, the caps together do not reach the seats.
    needed = F.col("_seats") - F.coalesce(F.sum("_cap").over(before), F.lit(0)) + F.sum(voting).over(after) / 2
    free = (F.col("_vote") > 0) & (needed > 0) & (F.sum("_vote").over(after) * (F.col("_cap") + 0.5) >= needed * F.col("_vote"))
    low = F.when(free, F.try_divide(F.sum("_vote").over(after), needed))
    # And at most min(vote / d + 1/2, 2 vote / d).
    high = F.least(
        F.when(F.col("_seats") > voters / 2, all_votes / (F.col("_seats") - voters / 2)),
        F.when(F.col("_seats") > 0, 2 * all_votes / F.col("_seats")),
    )
    place = F.row_number().over(order)

    def at(divisor: str, slack: float) -> Column:
        return F.least(F.floor(F.col("_vote") / (F.col(divisor) * (1 + slack)) + 0.5), F.col("_cap")).cast("long")

    sure = (
        votes.withColumn("_seats", seats).withColumn("_vote", vote).withColumn("_cap", cap)
        .withColumn("_high", high)
        .withColumn("_first", F.when(low.isNotNull(), F.struct(place.alias("place"), low.alias("low"))))
        .withColumn("_low", F.min("_first").over(own)["low"])
        .withColumn(
            "_sure",
            F.when((F.col("_seats") <= 0) | (F.col("_vote") <= 0), F.lit(0))
            .when(F.col("_low").isNull(), F.col("_cap")).otherwise(at("_high", 1e-12)).cast("long"),
        )
        .withColumn("_most", F.when((F.col("_vote") <= 0) | F.col("_low").isNull(), F.col("_sure")).otherwise(at("_low", -1e-12)))
        .withColumn("_open", F.col("_seats") - F.sum("_sure").over(own))
    )
    tries = F.least(F.col("_most") - F.col("_sure"), F.greatest(F.col("_open"), F.lit(0)))
    # A row for each contested seat, one without a seat where there is none.
    each = sure.withColumn("_k", F.explode_outer(F.when(tries > 0, F.sequence(F.col("_sure"), F.col("_sure") + tries - 1))))
    quotient = F.col("_vote") / (2 * F.col("_k") + 1)
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(quotient.desc_nulls_last(), F.col(key).asc_nulls_last()))
    won = F.sum(F.when(F.col("_k").isNotNull() & (F.col("_rank") <= F.col("_open")), 1).otherwise(0))
    others = [c for c in votes.columns if c not in (*group, key)]
    counted = each.withColumn("_rank", rank).groupBy(*group, key).agg(
        *[F.first(c).alias(c) for c in others], (F.first("_sure") + won).alias("quota")
    )
    return counted.select(*votes.columns, "quota")


def _dealt(parts: DataFrame, group: list[str], key: str, block: int, max_repeat: int) -> DataFrame:
    """``parts`` (group, key, part_size, of_words, of_seats) with ``run`` and ``seats``,
    the words and blocks that each takes of its group's.

    Where a part's bound cuts its blocks, the words go to the next parts with room.
    """
    own = Window.partitionBy(*group)
    most = F.col("part_size") * max_repeat
    won = sainte_lague(parts, group, key, F.col("part_size").cast("double"), F.col("of_seats"), F.ceil(most / block))
    last_first = own.orderBy(
        F.when(F.col("quota") > 0, F.col("part_size") / (2 * F.col("quota") - 1)).asc_nulls_last(), F.col(key).desc_nulls_first()
    )
    odd = F.when(F.row_number().over(last_first) == 1, F.col("of_seats") * block - F.col("of_words")).otherwise(0)
    wanted = won.withColumn("wanted", F.greatest(F.lit(0), F.least(F.col("quota") * block - odd, most)))
    room = most - F.col("wanted")
    before = F.sum(room).over(own.orderBy(F.col(key).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1))
    missing = F.col("of_words") - F.sum("wanted").over(own) - F.coalesce(before, F.lit(0))
    run = F.col("wanted") + F.least(room, F.greatest(F.lit(0), missing))
    return (
        wanted.withColumn("run", run.cast("long"))
        .withColumn("seats", F.col("quota") + (F.col("run") > F.col("quota") * block).cast("long")).drop("quota", "wanted")
    )


def mix_sources(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: int = 0,
    max_repeat: int = MAX_REPEAT,
    block_words: int = BLOCK_WORDS,
    shard_docs: int = SHARD_DOCS,
) -> DataFrame:
    """One row per row of ``df``: id, source, size, source_size, target, taken,
    start.

    ``taken`` counts the words that the mix takes, repeats included: the whole text
    ``taken / size`` times, and parts of it of which the first begins at word
    ``start``. A source's total is its target in whole words, at any size of the input.
    No row exceeds ``max_repeat`` times its size. Null text has size 0 and is
    never taken. Null sources form the last source. The order of rows with one
    id and size is irrelevant to the result. Reruns agree: all choices come from
    seeded hashes of ids.
    """
    rows = cut(
        df.select(
            F.col(id_col).alias("id"),
            F.col(source_col).alias("source"),
            n_words_column(F.col(text_col)).alias("size"),
        )
    )
    return _taken(rows, seed, max_repeat, block_words, shard_docs).select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "taken", "start"
    )


def _taken(
    rows: DataFrame,
    seed: int = 0,
    max_repeat: int = MAX_REPEAT,
    block_words: int = BLOCK_WORDS,
    shard_docs: int = SHARD_DOCS,
    ties: tuple[str, ...] = (),
) -> DataFrame:
    """``rows`` (id, source, size and others) with source_size, target, taken, laps and
    start, and what ``_parts`` needs; ``ties`` order rows of one id and size."""
    sources = cut(_source_quotas(rows, max_repeat, block_words, shard_docs))
    placed = rows.join(sources, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source")
    placed = placed.withColumn("place", F.xxhash64(F.lit(seed), F.col("id"))).withColumn(
        "shard", F.pmod(F.xxhash64(F.lit(seed + 1), F.col("place")), F.col("shards"))
    )
    quotas = ("of_words", "of_seats")
    shards = cut(
        placed.groupBy("source", "shard").agg(F.sum("size").alias("part_size"), *[F.first(c).alias(c) for c in quotas])
        .withColumn("band", F.floor(F.col("shard") / BAND_SHARDS))
    )
    bands = shards.groupBy("source", "band").agg(F.sum("part_size").alias("part_size"), *[F.first(c).alias(c) for c in quotas])
    bands = _dealt(bands, ["source"], "band", block_words, max_repeat).select(
        F.col("source").alias("b_source"), F.col("band").alias("b_band"), F.col("run").alias("of_words"), F.col("seats").alias("of_seats")
    )
    shards = shards.drop(*quotas).join(bands, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("band") == F.col("b_band")))
    shards = _dealt(shards, ["source", "band"], "shard", block_words, max_repeat).select(
        F.col("source").alias("s_source"), F.col("shard").alias("s_shard"), F.col("part_size").alias("shard_size"), "run"
    )
    line = Window.partitionBy("source", "shard").orderBy("place", "id", "size", *ties)
    spread = (
        placed.withColumn("end", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)))
        .join(shards, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("shard") == F.col("s_shard")))
        .withColumn("begin", F.col("end") - F.col("size"))
    )
    # The line `laps` times; of the `rest`, `whole` of its `blocks` and `odd` words.
    laps = F.when(F.col("shard_size") > 0, F.floor(F.col("run") / F.col("shard_size"))).otherwise(0)
    spread = (
        spread.withColumn("laps", laps.cast("long")).withColumn("rest", F.col("run") - F.col("laps") * F.col("shard_size"))
        .withColumn("blocks", F.floor(F.col("shard_size") / block_words)).withColumn("whole", F.floor(F.col("rest") / block_words))
        .withColumn("odd", F.col("rest") - F.col("whole") * block_words)
        .withColumn("from", F.when(F.col("blocks") > 0, F.pmod(F.xxhash64(F.lit(seed + 2), F.col("source"), F.col("shard")), F.col("blocks"))).otherwise(0))
        .withColumn("odd_at", F.when(F.col("whole") < F.col("blocks"), F.floor(F.col("from") / (F.col("blocks") - F.col("whole")))).otherwise(F.col("blocks")) * block_words)
    )
    taken = F.col("laps") * F.col("size") + _words_before(F.col("end"), block_words) - _words_before(F.col("begin"), block_words)
    first = F.get(_parts(block_words), F.lit(0))["at"]
    return spread.select(
        *rows.columns, "source_size", "target", taken.cast("long").alias("taken"), F.coalesce(first, F.lit(0)).cast("long").alias("start"),
        *_LINE,
    )


def _source_quotas(rows: DataFrame, max_repeat: int, block: int, shard_docs: int) -> DataFrame:
    """One row per source: target, words, blocks (the last one of its own length) and shards."""
    stats = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("docs"))
    sources = source_targets(stats, max_repeat).withColumn("one", F.lit(1))
    total = F.sum("size").over(Window.partitionBy("one"))
    sources = sainte_lague(sources, ["one"], "source", F.col("target"), F.floor(total / block), F.ceil(F.col("target") / block))
    words = F.least(F.round("target"), F.col("size") * max_repeat).cast("long")
    return sources.select(
        F.col("source").alias("of_source"), F.col("size").alias("source_size"), "target", words.alias("of_words"),
        (F.col("quota") + (words > F.col("quota") * block).cast("long")).alias("of_seats"), F.ceil(F.col("docs") / shard_docs).cast("long").alias("shards"),
    )


#: What a row knows of its shard's line.
_LINE = ("begin", "end", "laps", "blocks", "whole", "odd", "from", "odd_at")


def _chosen_before(block: Column) -> Column:
    """Chosen blocks ahead of one: ``whole`` of ``blocks`` evenly, from a seeded start."""
    return F.when(F.col("blocks") > 0, F.floor((block * F.col("whole") + F.col("from")) / F.col("blocks"))).otherwise(0)


def _words_before(place: Column, block: int) -> Column:
    """Chosen words ahead of a place on the line, without whole laps."""
    at = F.least(F.floor(place / block), F.col("blocks"))
    inside = F.when((at < F.col("blocks")) & (_chosen_before(at + 1) > _chosen_before(at)), place - at * block).otherwise(0)
    return _chosen_before(at) * block + inside + F.least(F.col("odd"), F.greatest(F.lit(0), place - F.col("odd_at")))


def _parts(block: int) -> Column:
    """array<struct(at, n)>: a row's chosen words besides whole laps, adjacent ones as
    one part, ``at`` counted from the text's beginning."""
    first, last = F.floor(F.col("begin") / block), F.least(F.floor((F.col("end") - 1) / block), F.col("blocks") - 1)
    numbers = F.when((F.col("size") > 0) & (last >= first), F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    whole = F.transform(
        F.filter(numbers, lambda j: _chosen_before(j + 1) > _chosen_before(j)), lambda j: F.struct((j * block).alias("lo"), ((j + 1) * block).alias("hi"))
    )
    odd = F.when(F.col("odd") > 0, F.array(F.struct(F.col("odd_at").alias("lo"), (F.col("odd_at") + F.col("odd")).alias("hi"))))
    runs = F.concat(whole, F.coalesce(odd, F.array().cast("array<struct<lo:bigint,hi:bigint>>")))
    own = F.filter(
        F.transform(runs, lambda r: F.struct(F.greatest(r["lo"], F.col("begin")).alias("lo"), F.least(r["hi"], F.col("end")).alias("hi"))),
        lambda r: r["hi"] > r["lo"],
    )

    def joined(xs: Column) -> Column:
        """A run that begins where the one before ends makes it longer."""
        firsts = F.filter(xs, lambda r, i: F.coalesce(F.get(xs, i - 1)["hi"] != r["lo"], F.lit(True)))
        lasts = F.filter(xs, lambda r, i: F.coalesce(F.get(xs, i + 1)["lo"] != r["hi"], F.lit(True)))
        return F.zip_with(firsts, lasts, lambda f, l: F.struct((f["lo"] - F.col("begin")).alias("at"), (l["hi"] - f["lo"]).alias("n")))

    return let(F.array_sort(own), joined).cast("array<struct<at:bigint,n:bigint>>")


def apply_mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed corpus, in the columns of ``df``: whole texts as often as they
    are taken whole, and each part that remains as a text of its own, its words
    joined by single spaces. A column ``n_chars`` follows the text. Ids repeat.

    Each row has its own part of the plan, whatever its id: null and repeated
    ids are met by a row number, which also spreads them over the join's tasks.
    """
    marked = numbered(df)
    rows = cut(
        marked.select(
            "_row", "_tie", F.col(id_col).alias("id"), F.col(source_col).alias("source"),
            n_words_column(F.col(text_col)).alias("size"),
        )
    )
    block = options.get("block_words", BLOCK_WORDS)
    planned = _taken(rows, **options, ties=("_tie",))
    parts = F.concat(
        F.array_repeat(F.struct(F.lit(0).cast("long").alias("at"), F.col("size").alias("n")), F.col("laps").cast("int")), _parts(block)
    )
    plan = planned.where("taken > 0").select("_row", F.col("size").alias("_size"), parts.alias("_parts"))
    # Rows are met by their numbers; a text is cut into words once, for all its parts.
    cut_into = F.col("_parts")

    def copies(words: Column) -> Column:
        def one(p: Column) -> Column:
            part = F.array_join(F.slice(words, (p["at"] + 1).cast("int"), p["n"].cast("int")), " ")
            return F.struct((p["n"] < F.col("_size")).alias("cut"), F.when(p["n"] < F.col("_size"), part).otherwise(F.col(text_col)).alias("text"))

        return F.transform(cut_into, one)

    partial = F.exists(cut_into, lambda p: p["n"] < F.col("_size"))
    words = F.when(partial, words_column(F.col(text_col))).otherwise(F.array().cast("array<string>"))
    out = marked.join(plan, "_row").withColumn("_copy", F.explode(let(words, copies)))
    text, part = F.col("_copy")["text"], F.col("_copy")["cut"]
    columns = []
    for c in df.columns:
        if c == text_col:
            columns.append(text.alias(c))
        elif c == "n_chars":
            columns.append(F.when(part, F.length(text)).otherwise(F.col(c)).cast(df.schema[c].dataType).alias(c))
        else:
            columns.append(F.col(c))
    return out.select(*columns)
