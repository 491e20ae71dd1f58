"""Several tables under one version: readers see all tables of a commit or none of them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from folioscope.operators.stored import bucketed_name, cleaning_up, write_bucketed

MANIFEST = "name string, path string"


class CommitConflict(Exception):
    """Another commit has taken the version that this one was to become."""


class Snapshots:
    """Tables as immutable Parquet folders below root, and for each version a manifest that names every table's folder.

    A commit writes its tables first, then claims the next version by creating a file that must not exist, and
    last writes the manifest; a version without a finished manifest is not there for readers. So a job that dies
    between two tables leaves nothing but folders that no manifest names. Tables that are written by a key are read as
    dealt by it in the same session, so joins and groups by that key don't shuffle them; elsewhere they are plain folders.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _finished(self, version: int) -> bool:
        path, fs = self._path(f"manifests/{version}/_SUCCESS")
        return fs.exists(path)

    def version(self) -> int:
        """The latest version that is finished; 0 before the first commit."""
        path, fs = self._path("manifests")
        if not fs.exists(path):
            return 0
        names = [status.getPath().getName() for status in fs.listStatus(path)]
        return max((int(n) for n in names if n.isdigit() and self._finished(int(n))), default=0)

    def folders(self, version: int | None = None) -> dict[str, str]:
        """The folder of each table: as many rows as there are tables."""
        version = self.version() if version is None else version
        if version == 0:
            return {}
        return {r.name: r.path for r in self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifests/{version}").collect()}

    def read(self, name: str, version: int | None = None) -> DataFrame:
        folder = self.folders(version)[name]
        table = bucketed_name(folder)
        return self.spark.table(f"`{table}`") if self.spark.catalog.tableExists(table) else self.spark.read.parquet(folder)

    def commit(self, tables: dict[str, DataFrame], expected: int, keys: dict[str, str] | None = None) -> int:
        """Makes version expected + 1 of these tables and of expected's others; returns it. keys: by what a table's rows are dealt."""
        folders = self.folders(expected)
        for name, df in tables.items():
            folders[name] = f"{self.root}/tables/{name}-{uuid.uuid4().hex}"
            if keys and name in keys:
                write_bucketed(df, folders[name], keys[name])
            else:
                with cleaning_up(self.spark):
                    df.write.parquet(folders[name], compression="zstd")
        return self._publish(folders, expected)

    def roll_back(self, to: int, expected: int) -> int:
        """Makes version expected + 1 of the tables of an earlier version; no table is written."""
        return self._publish(self.folders(to), expected)

    def _publish(self, folders: dict[str, str], expected: int) -> int:
        path, fs = self._path(f"claims/{expected + 1}")
        fs.mkdirs(path.getParent())
        if self.version() != expected or not fs.createNewFile(path):
            raise CommitConflict(f"version {expected + 1} is taken")
        self.spark.createDataFrame(sorted(folders.items()), MANIFEST).coalesce(1).write.parquet(f"{self.root}/manifests/{expected + 1}")
        return expected + 1

    def release(self, version: int) -> None:
        """Gives up a claim whose commit died before its manifest was finished."""
        if self._finished(version):
            raise CommitConflict(f"version {version} is finished")
        for name in (f"manifests/{version}", f"claims/{version}"):
            path, fs = self._path(name)
            fs.delete(path, True)
