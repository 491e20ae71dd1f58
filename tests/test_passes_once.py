"""The passes work out their state once: what reads it later reads written tables."""

from folioscope.plans.passes import apply_passes_report


def test_results_read_written_state(spark):
    report = apply_passes_report(spark, "/root/testdata/sf0.001")
    assert not [name for name in report.inputFiles() if "lineitem" in name or "orders" in name]
    assert all(0 <= row.applied <= row.decided for row in report.collect())
