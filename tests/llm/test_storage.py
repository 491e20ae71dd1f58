"""What is left of a written table: its files, no shuffle, and the session's settings."""

import time
from pathlib import Path

from folioscope.llm.storage import WRITING, store
from folioscope.operators.stored import written
from pyspark.sql import functions as F


def shuffled(spark):
    return {f.name for f in Path(spark.sparkContext.getConf().get("spark.local.dir")).rglob("shuffle_*.data")}


def test_shuffles_go_with_the_write(spark):
    for write in (store, written):
        before = {key: spark.conf.get(key) for key in WRITING}
        old = shuffled(spark)
        counts = spark.range(20_000).groupBy((F.col("id") % 7919).alias("k")).agg(F.count("*").alias("n"))
        table = write(counts, "counts")
        end = time.time() + 20
        while (left := shuffled(spark) - old) and time.time() < end:
            time.sleep(0.2)  # they are removed in the background
        assert not left
        assert table.count() == 7919
        assert {key: spark.conf.get(key) for key in WRITING} == before
