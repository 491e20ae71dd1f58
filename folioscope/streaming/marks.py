"""A stream of reviewers' marks into the tables that they change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators.marks import SCHEMAS, Reviewed, replay_marks
from folioscope.operators.snapshots import Snapshots


def stored_review(table: Snapshots) -> Reviewed:
    """The tables of the latest version; empty ones before the first."""
    folders = table.folders()
    empty = Reviewed.empty(table.spark)
    return Reviewed(**{name: table.spark.read.schema(schema).parquet(folders[name]) if name in folders else getattr(empty, name) for name, schema in SCHEMAS.items()})


def ingest_marks(marks: DataFrame, table: Snapshots, checkpoint: str, **trigger):
    """Starts the query that replays a stream (seq, phrase, status, alias_of) into the tables of a snapshot.

    All tables of a batch and its number come as one version, so a batch that is run again after its commit does nothing. Batches must come in
    order of seq.
    """

    def merge(batch: DataFrame, number: int) -> None:
        version = table.version()
        if version and "progress" in table.folders(version) and table.read("progress", version).first().batch >= number:
            return
        after, _ = replay_marks(stored_review(table), batch)
        progress = table.spark.range(number, number + 1, 1, 1).select(F.col("id").alias("batch"))
        table.commit({name: getattr(after, name) for name in SCHEMAS} | {"progress": progress}, version)

    started = marks.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return started.trigger(**(trigger or {"availableNow": True})).start()
