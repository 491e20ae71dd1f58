"""op7: all documents into eight shards."""

from pyspark.sql import functions as F

from folioscope.llm.sharding import shard_records
from folioscope.llm.storage import table


def op7_virtual_slots(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), "text")
    placed = shard_records(docs, shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op7_virtual_slots": op7_virtual_slots}
ORACLE_SQL = {}
