"""Streams of revisions and of what users do.

Each function maps a streaming DataFrame to a streaming DataFrame, or starts a query into a versioned table.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators.state import newest_version


def deduplicated(revisions: DataFrame, late: str = "3 days") -> DataFrame:
    """revisions (base_id, version, updated, ...) once each: polls overlap, so the same revision comes again."""
    return revisions.withWatermark("updated", late).dropDuplicatesWithinWatermark(["base_id", "version"])


def failure_alerts(events: DataFrame, least: int = 5, span: str = "15 minutes", slide: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, failures): sliding windows with at least so many errors of a user."""
    errors = events.where("event_type = 'error'").withWatermark("ts", late)
    counts = errors.groupBy("user_id", F.window("ts", span, slide).alias("w")).agg(F.count("*").alias("failures"))
    return counts.where(F.col("failures") >= least).select("user_id", F.col("w.start").alias("start"), "failures")


def failure_lookback(events: DataFrame, least: int = 5, span_us: int = 900_000_000, late: str = "10 minutes") -> DataFrame:
    """(user_id, event_id, us, failures): errors that are at least the so-manieth of a user within the span up to them.

    An error waits until the watermark is behind it, as earlier ones can still come. A user's state holds what waits and the times of one span.
    """

    def count(key, batches, state):
        recent, ids, times = ([list(x) for x in state.get]) if state.exists else ([], [], [])
        for batch in batches:
            ids += batch["event_id"].tolist()
            times += batch["us"].tolist()
        now = state.getCurrentWatermarkMs() * 1000
        waiting = sorted(zip(times, ids, strict=True))
        ready = [w for w in waiting if w[0] < now]
        waiting = waiting[len(ready) :]
        recent = sorted(recent + [t for t, _ in ready])
        out, start, end = [], 0, 0
        for t, event in ready:
            while recent[start] < t - span_us:
                start += 1
            while end < len(recent) and recent[end] <= t:
                end += 1
            if end - start >= least:
                out.append((key[0], event, t, end - start))
        recent = [t for t in recent if t >= now - span_us]
        if waiting or recent:
            state.update((recent, [event for _, event in waiting], [t for t, _ in waiting]))
            state.setTimeoutTimestamp((waiting[0][0] if waiting else recent[-1] + span_us) // 1000 + 1)
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["user_id", "event_id", "us", "failures"])

    errors = events.where("event_type = 'error'").withWatermark("ts", late)
    rows = errors.select("user_id", F.coalesce(F.col("event_id").cast("long"), F.lit(-1)).alias("event_id"), F.unix_micros("ts").alias("us"), "ts")
    shown, kept = "user_id long, event_id long, us long, failures long", "recent array<long>, ids array<long>, times array<long>"
    return rows.groupBy("user_id").applyInPandasWithState(count, shown, kept, "append", "EventTimeTimeout")


def rebuild_deadlines(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """(user_id, rebuild_after, changes): changes within the gap share one rebuild after the last of them."""
    sessions = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("changes"))
    return sessions.select("user_id", F.col("w.end").alias("rebuild_after"), "changes")


class VersionedTable:
    """Snapshots of a table, one folder for each batch; readers take the newest one that is complete.

    A batch that is run again overwrites its own snapshot only, so it gives the same state.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _done(self) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        found = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("batch=")]
        return sorted(int(p.getName()[6:]) for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def read(self, before: int | None = None) -> DataFrame | None:
        done = [b for b in self._done() if before is None or b < before]
        return self.spark.read.parquet(f"{self.path}/batch={done[-1]}") if done else None

    def merge(self, revisions: DataFrame, batch: int) -> None:
        """The state after a batch: of stored and new revisions of a base_id the greatest version stays."""
        stored = self.read(before=batch)
        both = revisions if stored is None else stored.unionByName(revisions)
        newest_version(both, "base_id", F.struct("version", "updated")).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")


def ingest(revisions: DataFrame, table: VersionedTable, checkpoint: str, **trigger):
    """Starts the query that merges a stream of revisions into the table."""
    started = revisions.writeStream.foreachBatch(table.merge).option("checkpointLocation", checkpoint)
    return started.trigger(**(trigger or {"availableNow": True})).start()
