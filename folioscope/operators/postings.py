"""A stored inverted index of words, kept up to date by batches, so that one phrase is tagged from its own postings."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
POSTINGS = "word string, id long, places array<int>, batch long"
GONE = "id long, batch long"
PLACED = "word string, id long, places array<int>"


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The places of each different word of each row (id, words): a document's postings are made where it is read, before any shuffle."""
    for batch in batches:
        words = batch.column("words")
        each = pc.list_value_length(words).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        owner = np.repeat(np.arange(len(each)), each)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)
        coded = words.flatten().dictionary_encode()
        codes = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        empty = pc.index(coded.dictionary, "").as_py()
        kept = np.flatnonzero((codes >= 0) & (codes != empty))
        key = owner[kept] * (len(coded.dictionary) + 1) + codes[kept]
        order = np.argsort(key, kind="stable")
        key, kept = key[order], kept[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
        places = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)).astype(np.int32)), pa.array(place[kept].astype(np.int32)))
        yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(codes[kept[first]])), batch.column("id").take(pa.array(owner[kept[first]])), places], names=["word", "id", "places"])


class Postings:
    """Below root: postings/bucket=N/ with rows of POSTINGS, each word in one bucket, and gone/ with rows of GONE.

    A batch adds documents or takes some away, and is a number greater than all before it. A posting holds until its document is taken
    away by a later batch; a document that comes again is taken away first. Files are only ever added, by Spark's
    own committer, so readers see a batch's postings when it is done.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _bucket(self, word: Column) -> Column:
        return F.pmod(F.xxhash64(word), F.lit(self.buckets)).cast("int")

    def add(self, docs: DataFrame, batch: int) -> None:
        """docs: (id, words array<string>), ids that are new or gone. Null ids and null or empty words have no postings."""
        rows = docs.where("id IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.col("words").cast("array<string>").alias("words")).mapInArrow(_placed, PLACED)
        rows = rows.select("word", "id", "places", F.lit(batch).cast("long").alias("batch"), self._bucket(F.col("word")).alias("bucket"))
        # A frequent word's bucket is dealt to several tasks, so no task writes all of it; within a file words are together.
        dealt = rows.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("bucket", "word")
        dealt.write.mode("append").partitionBy("bucket").parquet(f"{self.root}/postings")

    def take_away(self, ids: DataFrame, batch: int) -> None:
        """ids: (id). Postings of earlier batches don't hold any more."""
        ids.select(F.col("id").cast("long").alias("id"), F.lit(batch).cast("long").alias("batch")).distinct().write.mode("append").parquet(f"{self.root}/gone")

    def _stored(self, folder: str, schema: str) -> DataFrame:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{folder}")
        there = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{folder}") if there else self.spark.createDataFrame([], schema)

    def of(self, words: list[str]) -> DataFrame:
        """(word, id, places) of these words: only their buckets' folders are listed and read."""
        named = self.spark.createDataFrame([(w,) for w in words], "word string").select(self._bucket(F.col("word")))
        folders = sorted({f"postings/bucket={row[0]}" for row in named.collect()})  # as many as the phrase has words
        rows = self._stored(folders[0], POSTINGS)
        for folder in folders[1:]:
            rows = rows.union(self._stored(folder, POSTINGS))
        latest = self._stored("gone", GONE).groupBy("id").agg(F.max("batch").alias("_gone"))
        held = rows.where(F.col("word").isin(words)).join(latest, "id", "left").where("_gone IS NULL OR batch > _gone")
        once = held.groupBy("word", "id", "batch").agg(F.array_sort(F.flatten(F.collect_list("places"))).alias("places"))  # a batch may have an id in several rows
        return once.select("word", "id", "places")

    def phrase(self, phrase: str) -> DataFrame:
        """(id, times): documents with the words of phrase one after another, and how often; an empty phrase is in none."""
        words = [w for w in re.split(r"\s+", phrase) if w]
        if not words:
            return self.spark.createDataFrame([], "id long, times int")
        rows = self.of(sorted(set(words)))
        found = None
        for step, word in enumerate(words):
            # Where the phrase would begin; a place holds one word, so each start is there once.
            own = rows.where(F.col("word") == word).select("id", F.transform("places", lambda p: p - step).alias(f"p{step}"))
            found = own if found is None else found.join(own, "id")
        starts = F.col("p0")
        for step in range(1, len(words)):
            starts = F.array_intersect(starts, F.col(f"p{step}"))
        return found.select("id", F.size(starts).alias("times")).where("times > 0")


def retag(links: DataFrame, keyword_id: int, hits: DataFrame, automatic: str = "A") -> DataFrame:
    """links (id, keyword_id, source) with the keyword's automatic links made anew from hits (id).

    Links of other sources stay and win over new ones; links of other keywords stay as they are.
    """
    old = (F.col("keyword_id") == keyword_id) & (F.col("source") == automatic)
    kept = links.where(~old | old.isNull())
    held = kept.where(F.col("keyword_id") == keyword_id).select("id")
    new = hits.select("id").distinct().join(held, "id", "left_anti")
    return kept.unionByName(new.select("id", F.lit(keyword_id).cast(links.schema["keyword_id"].dataType).alias("keyword_id"), F.lit(automatic).alias("source")))
