"""Written intermediates in the folder that all executors share, for operators that work in rounds."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: A written table's shuffles are read by nobody else; unless this is set they stay until the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a temporary one for a local master."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='folioscope-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextmanager
def cleaning_up(spark: SparkSession) -> Iterator[None]:
    """Inside, a written table's shuffles go when it is written."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends here, and a lost executor costs its tasks only."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    with cleaning_up(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_bucketed(df: DataFrame, path: str, key: str) -> str:
    """Writes df as Parquet files dealt by key into as many buckets as shuffles have partitions; returns the name of their table.

    What is grouped or joined by key from that table needs no shuffle of it. Without the catalog the folder is a plain one.
    """
    spark, name = df.sparkSession, bucketed_name(path)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with cleaning_up(spark):
        df.repartition(buckets, key).write.format("parquet").option("compression", "zstd").bucketBy(buckets, key).option("path", path).saveAsTable(name)
    return name


def bucketed_name(path: str) -> str:
    """The catalog's name of the bucketed table in this folder."""
    return re.sub(r"\W", "_", path.rstrip("/").rsplit("/", 1)[-1])


def bucketed(df: DataFrame, tag: str, key: str) -> DataFrame:
    """As written, but dealt by key; remove drops it."""
    spark = df.sparkSession
    return spark.table(write_bucketed(df, f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}", key))


def remove(df: DataFrame) -> None:
    """Deletes the files of a written table that nothing reads any more."""
    context = df.sparkSession.sparkContext
    for root in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        if df.sparkSession.catalog.tableExists(bucketed_name(root)):
            df.sparkSession.sql(f"DROP TABLE `{bucketed_name(root)}`")
        path = context._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
