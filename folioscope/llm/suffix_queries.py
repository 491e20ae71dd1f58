"""op4: every document encoded to SentencePiece ids and decoded again."""

from folioscope.llm.storage import table
from folioscope.llm.suffix_tokens import round_trip


def op4_suffix_array(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "documents"))


QUERIES = {"op4_suffix_array": op4_suffix_array}
ORACLE_SQL = {}
