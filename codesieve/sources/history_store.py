"""Edit history as a store that grows by batches.

Two Parquet tables lie in a folder that all executors share, both partitioned by a
hash bucket of the session: ``versions``, the latest of each session, and ``state``,
one row for each session. A batch reads and rewrites the buckets of its own
sessions; all others stay as they are.

State is two maxima by (ts, version_id): the last restore, and the last approved
version with its text. Maxima merge in any order, so late and repeated batches come
to the same rows, and versions that retention has dropped are not needed again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codesieve.operators import history
from codesieve.streaming.streams import shared_folder

_ORDER = "struct<ts:timestamp,version_id:bigint>"
VERSION_COLUMNS = (
    "session_id bigint, version_id bigint, ts timestamp, function_name string, after string, approved boolean, is_restore boolean, safety_score bigint"
)
STATE_COLUMNS = f"session_id bigint, original_code string, restored {_ORDER}, approved_at {_ORDER}, approved_code string"


class HistoryStore:
    """``keep`` versions of each session in ``buckets`` parts below ``folder``.

    A lost write leaves a bucket old or new, never half; the same batch again
    completes it.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 256, keep: int = history.MAX_VERSIONS) -> None:
        self.spark, self.folder, self.buckets, self.keep = spark, folder, buckets, keep
        for name, columns in (("versions", VERSION_COLUMNS), ("state", STATE_COLUMNS)):
            empty = spark.createDataFrame([], f"{columns}, bucket int")
            empty.write.mode("append").partitionBy("bucket").parquet(f"{folder}/{name}")

    def bucket(self) -> Column:
        return F.pmod(F.hash("session_id"), F.lit(self.buckets)).cast("int")

    def _read(self, name: str, columns: str) -> DataFrame:
        return self.spark.read.schema(f"{columns}, bucket int").parquet(f"{self.folder}/{name}").where("session_id IS NOT NULL")

    def versions(self) -> DataFrame:
        return self._read("versions", VERSION_COLUMNS).drop("bucket")

    def state(self) -> DataFrame:
        return self._read("state", STATE_COLUMNS).drop("bucket")

    def current(self) -> DataFrame:
        """(session_id, current_code, changed): the last approved text after the last restore."""
        live = F.col("approved_at").isNotNull() & (F.col("restored").isNull() | (F.col("approved_at") > F.col("restored")))
        return self.state().select("session_id", F.when(live, F.col("approved_code")).otherwise(F.col("original_code")).alias("current_code"), live.alias("changed"))

    def touched(self, sessions: DataFrame) -> list[int]:
        """Buckets of these sessions: numbers below ``buckets``."""
        return sorted(r[0] for r in sessions.where("session_id IS NOT NULL").select(self.bucket().alias("b")).distinct().collect())

    def _replace(self, name: str, rows: DataFrame, touched: list[int]) -> None:
        """Write whole buckets. Each gets a row without a session, so that one that
        has become empty is replaced as well. Rows come from the very files that
        go, so they are written aside first."""
        if self.spark.sparkContext.getCheckpointDir() is None:
            self.spark.sparkContext.setCheckpointDir(shared_folder(self.spark))
        columns = [c for c in rows.columns if c != "bucket"]
        marks = self.spark.createDataFrame([(b,) for b in touched], "bucket int")
        out = rows.select(*columns, self.bucket().alias("bucket")).checkpoint().unionByName(marks, allowMissingColumns=True)
        parts = max(1, min(len(touched), int(self.spark.conf.get("spark.sql.shuffle.partitions"))))
        writer = out.repartition(parts, "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket")
        writer.parquet(f"{self.folder}/{name}")

    def _old(self, name: str, columns: str, touched: list[int]) -> DataFrame:
        return self._read(name, columns).where(F.col("bucket").isin(touched)).drop("bucket")

    def create(self, sessions: DataFrame) -> list[int]:
        """Add sessions (session_id, original_code) that are not there yet; returns the buckets written."""
        touched = self.touched(sessions)
        if touched:
            new = sessions.where("session_id IS NOT NULL").groupBy("session_id").agg(F.min("original_code").alias("original_code"))
            self._merge_state(new, touched)
        return touched

    def record(self, batch: DataFrame) -> list[int]:
        """Add versions; returns the buckets written. A version that is there already
        (same session and version_id) stays, so a batch may come again."""
        touched = self.touched(batch)
        if not touched:
            return touched
        new = batch.where("session_id IS NOT NULL").select(*[c.split()[0] for c in VERSION_COLUMNS.split(", ")])
        known = self._old("versions", VERSION_COLUMNS, touched)
        once = known.unionByName(new).dropDuplicates(["session_id", "version_id"])
        order, good = F.struct("ts", "version_id"), F.col("approved") & ~F.col("is_restore")
        changes = new.groupBy("session_id").agg(
            F.max(F.when(F.col("is_restore"), order)).alias("restored"), F.max(F.when(good, order)).alias("approved_at"),
            F.max_by(F.when(good, F.col("after")), F.when(good, order)).alias("approved_code"),
        )
        self._merge_state(changes, touched)
        self._replace("versions", history.retained(once, self.keep).drop("age"), touched)
        return touched

    def _merge_state(self, changes: DataFrame, touched: list[int]) -> None:
        old = self._old("state", STATE_COLUMNS, touched).withColumn("old", F.lit(True))
        both = old.unionByName(changes.withColumn("old", F.lit(False)), allowMissingColumns=True)
        original = F.max_by("original_code", F.when(F.col("original_code").isNotNull(), F.col("old")))
        merged = both.groupBy("session_id").agg(
            original.alias("original_code"), F.max("restored").alias("restored"), F.max("approved_at").alias("approved_at"),
            F.max_by("approved_code", "approved_at").alias("approved_code"),
        )
        self._replace("state", merged, touched)

    def delete(self, sessions: DataFrame) -> list[int]:
        """Remove sessions with their versions; returns the buckets written."""
        touched = self.touched(sessions)
        if touched:
            for name, columns in (("versions", VERSION_COLUMNS), ("state", STATE_COLUMNS)):
                self._replace(name, history.delete(self._old(name, columns, touched), sessions), touched)
        return touched

    def upsert(self, batch: DataFrame) -> list[int]:
        """Versions replace those of the same session and function; returns the buckets written."""
        touched = self.touched(batch)
        if touched:
            self._replace("versions", history.upsert(self._old("versions", VERSION_COLUMNS, touched), batch), touched)
        return touched
