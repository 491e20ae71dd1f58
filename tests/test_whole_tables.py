from datetime import date

import pytest

from folioscope.plans.listings import late_attach_authors_whole
from folioscope.plans.mining import bibtex_entries_whole
from folioscope.plans.rollups import latest_gap_month_whole, missing_months_whole
from folioscope.plans.transitions import state_summary_whole, versioned_upsert_whole

SCHEMA = "o_orderkey long, o_orderdate date, o_orderpriority string, o_orderstatus string, o_custkey long, o_totalprice double"


@pytest.fixture
def land(spark, scratch):
    def write(name, rows):
        path = f"{scratch}/{name}"
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/orders.parquet")
        spark.createDataFrame([(r[0], 1, 1) for r in rows], "l_orderkey long, l_suppkey long, l_linenumber int").write.parquet(f"{path}/lineitem.parquet")
        spark.createDataFrame([(1, "S#1")], "s_suppkey long, s_name string").write.parquet(f"{path}/supplier.parquet")
        return path

    return write


def test_papers_beyond_the_first_ids(spark, land):
    """Ids are above 8000, with days and remainders that the narrower queries pass over."""
    rows = [(9000 + i, date(1995, 5, 2), "1-URGENT", "O", i, 1.0) for i in range(40)]
    a, b, turned = land("a", rows), land("b", [*rows[:-1], (*rows[-1][:3], "F", *rows[-1][4:])]), land("c", rows[::-1])
    summary = state_summary_whole(spark, a).first()
    assert (summary.n, summary.verified, summary.owners, summary.shared) == (40, 0, 40, 0)
    assert summary.digest == state_summary_whole(spark, turned).first().digest != state_summary_whole(spark, b).first().digest
    assert versioned_upsert_whole(spark, a).count() == 10
    assert "1995-05" not in {r.month for r in missing_months_whole(spark, a).collect()}
    assert latest_gap_month_whole(spark, a).first().month == "2001-08"
    assert late_attach_authors_whole(spark, a).count() == bibtex_entries_whole(spark, a).count() == 40
