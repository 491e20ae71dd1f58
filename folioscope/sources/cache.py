"""Answers of registries, kept by key: what was found, and that something was not found, each with the time of the answer."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators.snapshots import CommitConflict

ROW = "key string, record string, fetched_at timestamp"
STORED = "bucket int, key string, record string, fetched_at timestamp"


class AnswerMismatch(Exception):
    """A batch has another number of answers than questions, so positions can't be trusted."""


def batches(missing: DataFrame, size: int = 450) -> DataFrame:
    """(batch, keys): the keys of missing (key) in batches of at most `size`, ordered within a batch; repeated and null keys once and not at all.

    A batch is cut within a part of the keys, so no task sorts them all and some batches are smaller.
    """
    if not 1 <= size <= 500:
        raise ValueError("a batch has 1 to 500 keys")
    keys = missing.where("key IS NOT NULL").select("key").distinct()
    placed = keys.select("key", F.spark_partition_id().cast("long").alias("part"), F.monotonically_increasing_id().alias("n"))
    return placed.groupBy("part", ((F.col("n") % (1 << 33)) / size).cast("long").alias("cut")).agg(F.array_sort(F.collect_set("key")).alias("keys")).select(F.concat_ws("-", F.col("part").cast("string"), F.col("cut").cast("string")).alias("batch"), "keys")


def by_position(answers: DataFrame) -> DataFrame:
    """(key, record, fetched_at) of answers (batch, keys, records array<string>, fetched_at): the n-th record answers the n-th key, null is "not found".

    One batch whose lengths differ, or without a list of answers, fails the whole call; nothing of it is to be stored.
    """
    wrong = ~F.coalesce(F.size("keys") == F.size("records"), F.lit(False))
    checked = F.when(wrong, F.raise_error(F.concat(F.lit("answers of batch "), F.coalesce("batch", F.lit("?")), F.lit(" do not match its keys")))).otherwise(F.arrays_zip("keys", "records"))
    pair = answers.select("fetched_at", F.explode(checked).alias("p"))
    return pair.select(F.col("p.keys").alias("key"), F.col("p.records").alias("record"), "fetched_at")


class RecordCache:
    """A table of answers in buckets of keys below path; a write touches only the buckets of its keys.

    Each bucket is rewritten as a new folder, and a list of all buckets' folders is published last, under the next version number. So readers
    see all of a write or nothing, and a write that dies leaves the cache as it was. The number of buckets is fixed when a cache is made.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _fs(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        path, fs = self._fs("versions")
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return max((int(n) for n in names if n.isdigit()), default=0)

    def _folders(self, version: int) -> dict[int, str]:
        """The folder of each bucket: as many rows as there are buckets."""
        if version == 0:
            return {}
        return {r.bucket: r.folder for r in self.spark.read.schema("bucket int, folder string").json(f"{self.path}/versions/{version}").collect()}

    def _read(self, folders: dict[int, str]) -> DataFrame:
        """The rows of some buckets' folders; each folder also holds the other buckets of its write, which are not read."""
        if not folders:
            return self.spark.createDataFrame([], STORED)
        paths = [f"{self.path}/rows/{folder}/bucket={bucket}" for bucket, folder in sorted(folders.items())]
        return self.spark.read.option("basePath", f"{self.path}/rows").schema(ROW).parquet(*paths).select(self._bucket().alias("bucket"), "key", "record", "fetched_at")

    def _bucket(self):
        return F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int")

    def read(self) -> DataFrame:
        """(key, record, fetched_at): one row for each key that was asked; record is null where it was not found."""
        return self._read(self._folders(self.version())).select("key", "record", "fetched_at")

    def missing(self, wanted: DataFrame, as_of=None, retry_days: int | None = None) -> DataFrame:
        """(key): wanted keys (key) without an answer, each once; with retry_days those, too, that were not found so long before as_of."""
        known = self.read()
        if retry_days is not None:
            known = known.where(F.col("record").isNotNull() | (F.col("fetched_at") > F.lit(as_of).cast("timestamp") - F.make_interval(days=F.lit(retry_days))))
        return wanted.where("key IS NOT NULL").select("key").distinct().join(known.select("key"), "key", "left_anti")

    def put(self, answers: DataFrame) -> int:
        """Stores answers (key, record, fetched_at) and returns the version: of stored and new ones of a key the latest stays.

        An answer that comes late (fetched before the stored one) changes nothing; of equal times a record wins over "not found", then the
        greatest record. No answers, no new version.
        """
        version = self.version()
        folders = self._folders(version)
        new = answers.where("key IS NOT NULL").select(self._bucket().alias("bucket"), "key", "record", "fetched_at")
        staged, folder = f"{self.path}/staged/{uuid.uuid4().hex}", f"write={uuid.uuid4().hex}"
        new.write.parquet(staged)
        new = self.spark.read.schema(STORED).parquet(staged)
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most as many as there are buckets
        if touched:
            both = self._read({b: f for b, f in folders.items() if b in touched}).unionByName(new)
            order = F.struct(F.coalesce(F.col("fetched_at"), F.lit("0001-01-01").cast("timestamp")), F.col("record").isNotNull(), F.coalesce("record", F.lit("")))
            latest = both.groupBy("bucket", "key").agg(F.max_by(F.struct("record", "fetched_at"), order).alias("r")).select("bucket", "key", "r.*")
            latest.write.partitionBy("bucket").parquet(f"{self.path}/rows/{folder}")
            folders |= dict.fromkeys(touched, folder)
            version += 1
            self._publish(version, folders)
        path, fs = self._fs(staged.removeprefix(f"{self.path}/"))
        fs.delete(path, True)
        return version

    def _publish(self, version: int, folders: dict[int, str]) -> None:
        """The list is written aside and renamed; a version that another writer has published meanwhile is not replaced."""
        aside = f"aside/{uuid.uuid4().hex}"
        self.spark.createDataFrame(sorted(folders.items()), "bucket int, folder string").coalesce(1).write.json(f"{self.path}/{aside}")
        (source, fs), (target, _), (claim, _) = self._fs(aside), self._fs(f"versions/{version}"), self._fs(f"claims/{version}")
        fs.mkdirs(target.getParent())
        fs.mkdirs(claim.getParent())
        if fs.exists(target) or not fs.createNewFile(claim):
            raise CommitConflict(f"version {version} is taken")
        if not fs.rename(source, target):
            raise CommitConflict(f"version {version} could not be published")
