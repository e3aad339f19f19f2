"""Edit history: append-only versions, current code, retention, listings.

Everything is keyed by session; times and ids come from the input, never from
the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_VERSIONS, MAX_SESSIONS = 50, 20
#: Schema of the exchanged history document.
DOCUMENT = (
    "struct<session_id:bigint,versions:array<struct<version_id:bigint,function_name:string,after:string,approved:boolean,safety_score:bigint>>>"
)


def create_sessions(files: DataFrame, created_at: Column) -> DataFrame:
    """One session per file: its text is both original and current."""
    return files.select(
        F.col("file_id").alias("session_id"), created_at.alias("created_at"), F.col("path").alias("file_name"),
        F.col("code").alias("original_code"), F.col("code").alias("current_code"),
    )


def record(versions: DataFrame, new: DataFrame, keep: int = MAX_VERSIONS) -> DataFrame:
    """Old and new versions, at most ``keep`` of each session."""
    return retained(versions.unionByName(new), keep).drop("age")


def retained(versions: DataFrame, keep: int = MAX_VERSIONS) -> DataFrame:
    """The latest ``keep`` versions of each session."""
    w = Window.partitionBy("session_id").orderBy(F.col("ts").desc(), F.col("version_id").desc())
    return versions.withColumn("age", F.row_number().over(w)).where(F.col("age") <= keep)


def newest_sessions(versions: DataFrame, keep: int = MAX_SESSIONS) -> DataFrame:
    """The ``keep`` sessions created last: a top-k report."""
    created = versions.groupBy("session_id").agg(F.min("ts").alias("created_at"), F.count("*").alias("n_versions"))
    return created.orderBy(F.col("created_at").desc(), F.col("session_id").desc()).limit(keep)


def current_code(versions: DataFrame, sessions: DataFrame) -> DataFrame:
    """Per session the last approved text after the last restore, else the original.

    ``versions`` has is_restore rows; approvals before the last restore do not count.
    """
    order = F.struct("ts", "version_id")
    restored = versions.where("is_restore").groupBy("session_id").agg(F.max(order).alias("restored"))
    live = (
        versions.where("approved AND NOT is_restore").join(restored, "session_id", "left")
        .where(F.col("restored").isNull() | (order > F.col("restored")))
        .groupBy("session_id").agg(F.max_by("after", order).alias("approved_code"))
    )
    return sessions.join(live, "session_id", "left").select(
        "session_id", F.coalesce("approved_code", "original_code").alias("current_code"), F.col("approved_code").isNotNull().alias("changed")
    )


def code_after_each(versions: DataFrame, sessions: DataFrame) -> DataFrame:
    """Current text after every event of a session; a restore begins an epoch.

    A task holds one day of one session: what a day leaves behind (its restores,
    and its last approved text after the last of them) is carried over days first.
    """
    rows = versions.withColumn("day", F.to_date("ts")).withColumn("good", F.col("approved") & ~F.col("is_restore"))
    order = F.struct("ts", "version_id")
    days = rows.groupBy("session_id", "day").agg(
        F.count_if("is_restore").alias("restores"), F.max(F.when(F.col("is_restore"), order)).alias("restored"),
        F.max(F.when(F.col("good"), order)).alias("approved_at"), F.max_by(F.when(F.col("good"), F.col("after")), F.when(F.col("good"), order)).alias("last"),
    )
    live = F.col("approved_at").isNotNull() & (F.col("restored").isNull() | (F.col("approved_at") > F.col("restored")))
    left = F.when(live | (F.col("restores") > 0), F.struct(F.when(live, F.col("last")).alias("text")))
    before = Window.partitionBy("session_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    carried = days.withColumn("left", left).select(
        F.col("session_id").alias("s"), F.col("day").alias("d"), F.coalesce(F.sum("restores").over(before), F.lit(0)).alias("epochs"),
        F.last("left", ignorenulls=True).over(before)["text"].alias("text_before"),
    )
    joined = rows.join(carried, F.col("session_id").eqNullSafe(F.col("s")) & F.col("day").eqNullSafe(F.col("d")))
    by_day = Window.partitionBy("session_id", "day").orderBy("ts", "version_id")
    numbered = joined.withColumn("new", F.sum(F.col("is_restore").cast("int")).over(by_day))
    within = Window.partitionBy("session_id", "day", "new").orderBy("ts", "version_id")
    text = F.last(F.when(F.col("good"), F.col("after")), ignorenulls=True).over(within)
    text = F.coalesce(text, F.when(F.col("new") == 0, F.col("text_before")))
    return numbered.withColumn("epoch", F.col("epochs") + F.col("new")).withColumn("text", text).join(sessions, "session_id").select(
        "session_id", "version_id", "epoch", F.coalesce("text", "original_code").alias("current_code")
    )


def counts(versions: DataFrame) -> DataFrame:
    """Approved and rejected decisions per session, restores aside."""
    return versions.where("NOT is_restore").groupBy("session_id").agg(
        F.count_if("approved").alias("approved"), F.count_if(~F.col("approved")).alias("rejected"),
        F.max("ts").alias("last_ts"), F.round(F.avg("safety_score"), 4).alias("mean_score"),
    )


def delete(versions: DataFrame, deleted: DataFrame) -> DataFrame:
    return versions.join(deleted.select("session_id").distinct(), "session_id", "left_anti")


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same session and function."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy("session_id", "function_name").orderBy(F.col("_new").desc(), F.col("ts").desc(), F.col("version_id").desc())
    return both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_new")


def encode(versions: DataFrame, keep: int = MAX_VERSIONS) -> DataFrame:
    """(session_id, document): one JSON text per session, its latest ``keep``
    versions in order, which bounds a document."""
    entry = F.struct("ts", "version_id", "function_name", "after", "approved", "safety_score")
    listed = retained(versions, keep).groupBy("session_id").agg(F.array_sort(F.collect_list(entry)).alias("v"))
    plain = F.transform(
        "v",
        lambda v: F.struct(
            v["version_id"].alias("version_id"), v["function_name"].alias("function_name"), v["after"].alias("after"),
            v["approved"].alias("approved"), v["safety_score"].alias("safety_score"),
        ),
    )
    return listed.select("session_id", F.to_json(F.struct("session_id", plain.alias("versions"))).alias("document"))


def decode(documents: DataFrame) -> DataFrame:
    """Rows of the documents; a bad document gives none."""
    parsed = documents.select(F.from_json("document", DOCUMENT).alias("d"))
    return parsed.select("d.session_id", F.inline("d.versions"))
