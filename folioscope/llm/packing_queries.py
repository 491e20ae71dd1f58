"""op3: all documents packed into sequences of 4096 tokens."""

from folioscope.llm.packing import pack_documents
from folioscope.llm.storage import table


def op3_bin_completion(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op3_bin_completion": op3_bin_completion}
ORACLE_SQL = {}
