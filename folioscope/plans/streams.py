"""The streaming operators over the events table, read to its end."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from folioscope.plans import personal
from folioscope.plans.registry import Registry
from folioscope.plans.relations import table
from folioscope.streaming.ingest import failure_alerts, failure_lookback, rebuild_deadlines

registry = Registry()
query = registry.query


def _events(spark, sf_dir):
    """The events file as a stream, and one more event far behind the last; the pattern is what the file source asks for.

    The last event lets the watermark pass all others, so their windows close; its own stays open and is not shown.
    """
    events = table(spark, sf_dir, "events")
    schema = events.withColumn("ts", F.col("ts").cast("timestamp")).schema
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/event[s].parquet").withColumn("ts", F.col("ts").cast(schema["ts"].dataType))
    last = events.agg(F.max(F.col("ts").cast("timestamp")).alias("ts")).select((F.col("ts") + F.expr("INTERVAL 3650 DAYS")).alias("ts"))
    folder = f"{_shared(spark)}/closing-{uuid.uuid4().hex}"
    last.select(*(F.col("ts") if c.name == "ts" else F.lit("error" if c.name == "event_type" else None).cast(c.dataType).alias(c.name) for c in schema)).write.parquet(folder)
    return stream.union(spark.readStream.schema(schema).parquet(folder))


def _shared(spark):
    """The folder that all executors share; only a local master can do without."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (found or f"file://{tempfile.mkdtemp(prefix='folioscope-')}").rstrip("/")


def _finished(spark, stream):
    """All rows of a stream over a bounded input, as files that the executors append when a window closes."""
    path = f"{_shared(spark)}/stream_{uuid.uuid4().hex}"
    started = stream.writeStream.format("parquet").outputMode("append").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state")
    started.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


@query("""WITH e AS (SELECT user_id, ts FROM events WHERE event_type = 'error'), w AS (SELECT user_id, time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR * k AS start, ts FROM e, (SELECT unnest([0, 1]) AS k))
SELECT user_id, strftime(start, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS failures FROM w WHERE ts >= start AND ts < start + INTERVAL 24 HOUR GROUP BY ALL HAVING count(*) >= 3""")  # fmt: skip
def stream_failure_alerts(spark, sf_dir):
    alerts = _finished(spark, failure_alerts(_events(spark, sf_dir), 3, "24 hours", "12 hours"))
    return alerts.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "failures")


@query(personal.registry.sql["failure_sliding_window"])
def stream_failure_lookback(spark, sf_dir):
    """Every error that is at least the third of a user within a day; stream_failure_alerts has stepped windows, which some of them straddle."""
    found = _finished(spark, failure_lookback(_events(spark, sf_dir), 3, 86_400_000_000, "1 hour"))
    return found.select("user_id", F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd HH:mm:ss").alias("at"), "event_id", "failures")


@query("""WITH marked AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
numbered AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM marked)
SELECT user_id, strftime(max(ts) + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS rebuild_after, count(*) AS changes FROM numbered GROUP BY user_id, s""")  # fmt: skip
def stream_rebuild_deadlines(spark, sf_dir):
    deadlines = _finished(spark, rebuild_deadlines(_events(spark, sf_dir)))
    return deadlines.select("user_id", F.date_format("rebuild_after", "yyyy-MM-dd HH:mm:ss").alias("rebuild_after"), "changes")
