"""Append-only logs and event streams with Structured Streaming."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LOG_SCHEMA = "at timestamp, step string, engine string, status string, note string, branch string, commit string"


def append_log(rows: DataFrame, folder: str) -> None:
    rows.write.mode("append").json(folder)


def log_stream(spark: SparkSession, folder: str, schema: str = LOG_SCHEMA) -> DataFrame:
    return spark.readStream.schema(schema).json(folder)


def step_report(log: DataFrame) -> DataFrame:
    """(step, runs, failed, last_status), for a table or a stream."""
    return log.groupBy("step").agg(F.count("*").alias("runs"), F.count_if(F.col("status") == "failed").alias("failed"), F.max_by("status", "at").alias("last_status"))


def windowed_counts(events: DataFrame, at: str, by: str, size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(start, by, n) of tumbling or sliding windows; late rows are waited for."""
    if events.isStreaming:
        events = events.withWatermark(at, late)
    return events.groupBy(F.window(at, size, slide), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def sessions(events: DataFrame, at: str, user: str, gap: str, late: str = "1 hour") -> DataFrame:
    """(user, start, stop, n) of runs of events with less than ``gap`` between them."""
    if events.isStreaming:
        events = events.withWatermark(at, late)
    return events.groupBy(F.session_window(at, gap), user).agg(F.count("*").alias("n")).select(user, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n")


def drain(stream: DataFrame, folder: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Run all that is there through the stream and read what it wrote; a restart goes on from the checkpoint."""
    spark = stream.sparkSession

    def write(batch: DataFrame, epoch: int) -> None:
        # a batch that is tried again replaces what its first try wrote
        batch.write.mode("overwrite").parquet(folder if mode == "complete" else f"{folder}/epoch={epoch}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.parquet(folder).drop("epoch")


def replace_origin(rows: DataFrame, new: DataFrame, origin: str) -> DataFrame:
    """All rows but those of one origin, and the new ones: running it again changes nothing."""
    return rows.where(~F.col("origin").eqNullSafe(F.lit(origin))).unionByName(new.withColumn("origin", F.lit(origin)))


class _Sessions(StatefulProcessor):
    """Sessions of one key that are still open, and the latest time seen; see ``late_sessions``."""

    def __init__(self, gap: int, late: int):
        self.gap, self.late = gap, late

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "start long, stop long, n long, given boolean")
        self.latest = handle.getValueState("latest", "at long")

    def _out(self, key, kind, rows):
        return pd.DataFrame([(key[0], kind, *r) for r in rows], columns=["key", "kind", "start", "stop", "n"])

    def _keep(self, sessions):
        if sessions:
            self.open.put(sessions)
        else:
            self.open.clear()

    def _wake(self, sessions):
        """One timer is enough for a key: that of the session which ends first of those that are not given out."""
        if sessions := [s for s in sessions if not s[3]]:
            self.handle.registerTimer(min(map(self._due, sessions)))

    def _due(self, session):
        return (session[1] + self.gap + self.late) // 1000

    def handleInputRows(self, key, rows, timerValues):
        latest = self.latest.get()[0] if self.latest.exists() else None
        sessions = sorted(tuple(x) for x in self.open.get()) if self.open.exists() else []
        starts, late, void = [s[0] for s in sessions], [], []
        parts = [(x["arrived"].to_numpy(), x["at"].to_numpy()) for x in rows]
        arrived, times = (np.concatenate(x) for x in zip(*parts, strict=True))
        for at in times[np.lexsort((times, arrived))].tolist():
            if latest is not None and at < latest - self.late:
                late.append((at, at, 1))
                continue
            latest = at if latest is None else max(latest, at)
            # sessions lie more than a gap apart, so the event can join the last that starts before it and the next one
            after = bisect_right(starts, at)
            first = after - 1 if after and at <= sessions[after - 1][1] + self.gap else after
            last = after + 1 if after < len(sessions) and sessions[after][0] - self.gap <= at else after
            joined = sessions[first:last]
            void += [s[:3] for s in joined if s[3]]
            sessions[first:last] = [(min([at, *(s[0] for s in joined)]), max([at, *(s[1] for s in joined)]), 1 + sum(s[2] for s in joined), False)]
            starts[first:last] = [sessions[first][0]]
        self.latest.update((latest,)) if latest is not None else None
        sessions = [s for s in sessions if not s[3] or s[1] + self.gap >= latest - self.late]
        self._keep(sessions)
        self._wake(sessions)
        for kind, found in (("late", late), ("void", void)):
            if found:
                yield self._out(key, kind, found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        sessions = [tuple(x) for x in self.open.get()] if self.open.exists() else []
        now = timerValues.getCurrentWatermarkInMs()
        done = [s for s in sessions if not s[3] and self._due(s) <= now]
        if done:
            latest = self.latest.get()[0]
            left = [(*s[:3], s[3] or self._due(s) <= now) for s in sessions]
            left = [s for s in left if not s[3] or s[1] + self.gap >= latest - self.late]
            self._keep(left)
            self._wake(left)
            yield self._out(key, "session", [s[:3] for s in done])

    def close(self) -> None:
        pass


def late_sessions(events: DataFrame, key: str, at: str, arrived: str, gap: str, late: str) -> DataFrame:
    """A stream of (key, kind, start, stop, n): sessions once they can no longer grow, and late events as rows of kind ``late``.

    An event is late if it lies more than ``late`` before the latest event of its key that arrived before it; no
    event is dropped. A session (events of a key with at most ``gap`` between neighbours) is kept in state with an event-time timer and given out when the watermark, which follows
    ``arrived`` (the time of arrival, which does not go back), passes its end by ``gap`` and ``late``. Rows without key or time are left out. An event that is not late for its key may still
    join a session that is given out; that session is then taken back by a row of kind ``void``, and the longer one follows (``settled`` applies this). State holds, of each key, one time and the sessions that are open or can still be joined.
    """
    micros = lambda text: events.sparkSession.sql(f"SELECT CAST(unix_micros(TIMESTAMP '1970-01-01 00:00:00Z' + INTERVAL {text}) AS BIGINT)").first()[0]
    rows = events.where(F.col(key).isNotNull() & F.col(at).isNotNull() & F.col(arrived).isNotNull())
    rows = rows.select(F.col(key).alias("key"), F.unix_micros(at).alias("at"), F.col(arrived).alias("arrived")).withWatermark("arrived", "0 seconds")
    kind = dict(rows.dtypes)["key"]
    out = rows.groupBy("key").transformWithStateInPandas(_Sessions(micros(gap), micros(late)), f"key {kind}, kind string, start long, stop long, n long", "append", "EventTime")
    return out.select(F.col("key").alias(key), "kind", F.timestamp_micros("start").alias("start"), F.timestamp_micros("stop").alias("stop"), "n")


def settled(found: DataFrame, key: str) -> DataFrame:
    """The rows of ``late_sessions`` without sessions that were taken back."""
    void = found.where("kind = 'void'").select(key, F.lit("session").alias("kind"), "start", "stop", "n")
    return found.where("kind <> 'void'").join(void, [key, "kind", "start", "stop", "n"], "left_anti")


def state_store(spark: SparkSession) -> None:
    """Keep states of streams in RocksDB, as timers need it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
