"""Edit history over a stream: a session's epoch and current text as keyed state.

Events arrive in any order within the watermark's delay. A session keeps the ones
that the watermark has not passed. Once it passes them, all that are due are applied
in the order of (ts, version_id), and each gives a row; so rows never change after
they have left. State is the epoch, the last approved text, and the events of one
delay: it does not grow with a session's age.

Sessions are dealt by hash to a fixed number of shards, and a shard is the key of the
state: it holds one timer, the events that wait, and a map with an entry for each
session. What Spark calls once for each key is so called once for many sessions; an
entry is read and written only if its session has events that are due.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from codesieve.streaming.streams import drain

#: Times are microseconds.
OUTPUT = "session_id long, version_id long, ts long, epoch long, approved_code string"
#: One entry for each part of a shard's rows that arrived, as parallel arrays.
_PENDING = "ts array<bigint>, session_id array<bigint>, version_id array<bigint>, after array<string>, is_restore array<boolean>"
#: Shards of a stream; fixed for its checkpoint.
SHARDS = 1024
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def applied(epoch: int, text: str | None, events: list[tuple]) -> tuple[int, str | None, list[tuple]]:
    """Apply (ts, version_id, after, approved, is_restore) events in order: the new
    epoch and text, and (ts, version_id, epoch, text) after each event. A version
    without an id comes last of its time."""
    out = []
    for ts, version, after, approved, restore in sorted(events, key=lambda e: (e[0], e[1] is None, e[1] or 0)):
        if restore:
            epoch, text = epoch + 1, None
        elif approved:
            text = after
        out.append((ts, version, epoch, text))
    return epoch, text, out


def _nullable(column: pd.Series) -> list:
    return column.astype(object).where(column.notna(), None).tolist()


class SessionHistory(StatefulProcessor):
    """The histories of a shard's sessions; times are microseconds."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getMapState("now", "session_id long", "epoch long, text string")
        self.pending = handle.getListState("pending", _PENDING)
        self.timer = handle.getValueState("timer", "ms long")

    def _await(self, earliest: int) -> None:
        """One timer, at the earliest event that is not due."""
        ms = earliest // 1000
        held = self.timer.get()[0] if self.timer.exists() else None
        if held is not None and held <= ms:
            return
        if held is not None:
            self.handle.deleteTimer(held)
        self.handle.registerTimer(ms)
        self.timer.update((ms,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        earliest = None
        for part in rows:
            micros = part["micros"].tolist()
            version = [None if m else v for v, m in zip(part["version_id"].tolist(), part["no_id"].tolist())]
            self.pending.appendValue((micros, part["session_id"].tolist(), version, _nullable(part["after"]), part["is_restore"].tolist()))
            earliest = min(micros) if earliest is None else min(earliest, *micros)
        if earliest is not None:
            self._await(earliest)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due_until = timerValues.getCurrentWatermarkInMs() * 1000
        self.timer.clear()
        due, late = [], []
        for part in self.pending.get():
            for e in zip(*part):
                (due if e[0] <= due_until else late).append(e)
        columns = self._apply(due)
        if late:
            self.pending.put([tuple(map(list, zip(*late)))])
            self._await(min(e[0] for e in late))
        else:
            self.pending.clear()
        if due:
            yield pd.DataFrame(columns | {"version_id": pd.Series(columns["version_id"], dtype=object)})

    def _apply(self, due: list[tuple]) -> dict[str, list]:
        """Rows of the events that are due, by column; sessions' entries move on."""
        columns: dict[str, list] = {c.split()[0]: [] for c in OUTPUT.split(", ")}
        known = self.now.exists()
        for session, events in groupby(sorted(due, key=lambda e: e[1]), key=lambda e: e[1]):
            before = known and self.now.getValue((session,)) or (0, None)
            epoch, text, out = applied(*before, [(ts, version, after, after is not None, restore) for ts, _, version, after, restore in events])
            if (epoch, text) != tuple(before):
                self.now.updateValue((session,), (epoch, text))
            columns["session_id"].extend([session] * len(out))
            for name, values in zip(("ts", "version_id", "epoch", "approved_code"), zip(*out)):
                columns[name].extend(values)
        return columns

    def close(self) -> None:
        pass


def versions(spark: SparkSession, path: str, files_a_batch: int | None = None) -> DataFrame:
    """Versions as a stream, from files of events that arrive at ``path``."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    events = (reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader).parquet(f"{path}*")
    return events.select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("version_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("code "), F.col("event_id").cast("string")).alias("after"),
        F.col("event_type").isin("purchase", "signup", "click").alias("approved"), (F.col("event_type") == "error").alias("is_restore"),
    )


def code_after_each(stream: DataFrame, delay: str = "1 hour", shards: int = SHARDS) -> DataFrame:
    """(session_id, version_id, ts, epoch, approved_code) after each event of a stream
    of versions, once the watermark has passed it. A null text stands for the
    original. Events later than the delay are dropped, as are those without a session
    or a time. The query must start with the RocksDB state store, as in ``drained``."""
    rows = stream.where("session_id IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", delay)
    restore = F.coalesce("is_restore", F.lit(False))
    rows = rows.select(
        F.pmod(F.hash("session_id"), F.lit(shards)).alias("shard"), "session_id", F.coalesce("version_id", F.lit(0)).alias("version_id"),
        F.col("version_id").isNull().alias("no_id"), "ts", F.unix_micros("ts").alias("micros"),
        F.when(F.col("approved") & ~restore, F.col("after")).alias("after"), restore.alias("is_restore"),
    )
    after = rows.groupBy("shard").transformWithStateInPandas(
        statefulProcessor=SessionHistory(), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime"
    )
    return after.withColumn("ts", F.timestamp_micros("ts"))


def drained(stream: DataFrame, folder: str, sessions: DataFrame) -> DataFrame:
    """Run over all that is there; (session_id, version_id, epoch, current_code) of
    what the watermark has passed."""
    conf = stream.sparkSession.conf
    before = conf.get(_PROVIDER)
    conf.set(_PROVIDER, _ROCKS)
    try:
        rows = drain(stream, folder)
    finally:
        conf.set(_PROVIDER, before)
    return rows.join(sessions, "session_id").select(
        "session_id", "version_id", "epoch", F.coalesce("approved_code", "original_code").alias("current_code")
    )
