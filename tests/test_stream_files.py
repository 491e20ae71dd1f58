from datetime import datetime

import pytest

from folioscope.plans.streams import stream_failure_alerts, stream_rebuild_deadlines


@pytest.fixture
def modes(monkeypatch):
    """The sinks and output modes that are asked for."""
    from pyspark.sql.streaming import DataStreamWriter

    seen, own = [], DataStreamWriter.format
    monkeypatch.setattr(DataStreamWriter, "format", lambda self, source: (seen.append(source), own(self, source))[1])
    mode = DataStreamWriter.outputMode
    monkeypatch.setattr(DataStreamWriter, "outputMode", lambda self, m: (seen.append(m), mode(self, m))[1])
    return seen


def test_rows_go_to_files_and_the_last_windows_close(spark, scratch, modes):
    at = lambda day, hour: datetime(2024, 1, day, hour)
    rows = [(1, at(1, 1), 7, "error"), (2, at(1, 2), 7, "error"), (3, at(1, 3), 7, "error"), (4, at(9, 1), 8, "view"), (5, at(9, 2), 8, "view")]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string").repartition(1).write.parquet(f"{scratch}/events.parquet")
    alerts = sorted((r.user_id, r.start, r.failures) for r in stream_failure_alerts(spark, scratch).collect())
    assert alerts == [(7, "2023-12-31 12:00:00", 3), (7, "2024-01-01 00:00:00", 3)]
    deadlines = sorted((r.user_id, r.rebuild_after, r.changes) for r in stream_rebuild_deadlines(spark, scratch).collect())
    assert deadlines == [(7, "2024-01-01 09:00:00", 3), (8, "2024-01-09 08:00:00", 2)]
    assert modes == ["parquet", "append"] * 2
