"""Tables, the shared folder and written intermediates.

Intermediates are Parquet tables in the folder that the cluster names in
``spark.checkpoint.dir``: any executor can read them again after another is lost.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: While a table is written. Its shuffles go when it is written, as nobody reads them again; else they stay until the driver collects
#: garbage, which it does the more rarely for each GB the larger the input is. Arrow's batches are some MB of text, not some ten.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}
#: For steps over rows of any length, whole texts or sets: Arrow's batches are of so many bytes, and a scan holds few rows at once.
LONG_ROWS = {"spark.sql.execution.arrow.maxBytesPerBatch": "1m", "spark.sql.parquet.columnarReaderBatchSize": "512"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, one temporary folder for a local master."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='folioscope-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextmanager
def _with(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """The settings hold inside; afterwards those of before."""
    before = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def small_batches(spark: SparkSession):
    """Inside, texts go to Python in batches as small as while a table is written."""
    return _with(spark, WRITING)


def long_rows(spark: SparkSession):
    """Inside, the memory of a scan and of a Python worker doesn't grow with the length of rows, but for the longest row."""
    return _with(spark, LONG_ROWS)


def store(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and reads it back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    with _with(spark, WRITING):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Deletes the files of a stored table that no later step reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for root in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def width(spark: SparkSession) -> int:
    """Number of partitions for steps that Spark doesn't size by itself."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
