from datetime import datetime

from folioscope.plans.streams import stream_failure_lookback


def test_errors_that_straddle_the_steps(spark, scratch):
    at = lambda day, hour: datetime(2024, 1, day, hour)
    rows = [(3, at(2, 10), 7, "error"), (1, at(1, 11), 7, "error"), (2, at(1, 20), 7, "error"), (4, at(3, 11), 7, "error"), (5, at(1, 12), 8, "error"), (6, at(9, 1), 8, "view")]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string").write.parquet(f"{scratch}/events.parquet")
    assert [tuple(r) for r in stream_failure_lookback(spark, scratch).collect()] == [(7, "2024-01-02 10:00:00", 3, 3)]
