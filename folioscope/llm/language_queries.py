"""op8: the language of every document."""

from pyspark.sql import functions as F

from folioscope.llm.language_id import fit, identify
from folioscope.llm.storage import table


def held_out(doc_id):
    """The fold that is never learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def op8_output_codes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    answered = identify(docs.select("doc_id", "text"), model)
    return answered.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")


QUERIES = {"op8_output_codes": op8_output_codes}
ORACLE_SQL = {}
