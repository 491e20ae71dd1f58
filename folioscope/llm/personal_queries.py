"""op2: personal data in every document."""

from pyspark.sql import functions as F

from folioscope.llm.personal_data import KINDS, find_spans, fit, with_candidates
from folioscope.llm.storage import store, table


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _is(kind):
    return lambda span: span["kind"] == kind


def op2_weak_supervision(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    searched = store(with_candidates(docs).select("doc_id", "_found"), "spans")
    found = find_spans(searched, fit(searched))
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(F.filter(base, _is(kind))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


QUERIES = {"op2_weak_supervision": op2_weak_supervision}
ORACLE_SQL = {}
