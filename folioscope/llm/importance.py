"""Importance resampling towards a target distribution, by hashed n-gram features.

Each partition's texts are taken as sequences of word ids, a bounded number of bytes at a time, and sorted as a
suffix array. Neighbouring suffixes that share their first words (by their longest common prefix) form a
run, which is one repeated n-gram; a run is hashed once, from the hash of its shorter prefix's run, and
its bucket goes back to all its occurrences. Bucket counts of the corpus and of the target give
every bucket a gain; a document's weight is the mean gain of its features, and seeded Gumbel noise turns weights
into a draw without replacement.

The features of every document are written once and read for the counts and for the weights. The gains have one
number for each bucket, whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.flat_text import SIGNS, flat, handing_back, slices, word_hashes
from folioscope.llm.fm_index import suffix_array
from folioscope.llm.shingles import LOWER
from folioscope.llm.storage import drop, store

GRAM_WORDS = 2
BUCKETS = 10_000
PERCENT = 25
LEAST_WORDS = 20
SEED = 7
PART_BYTES = 4_000_000  # of texts sorted at a time, unless one text is longer
FEATURES = "doc_id long, n_words long, buckets array<int>, counted array<int>, times array<long>"


def suffix_runs(symbols: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For n = 1 ... depth: (positions, run, heads) of the n-grams of symbols, in suffix order.

    Position i begins an n-gram of run run[i]; heads are the first position of each run. 0 ends a text, and no
    n-gram holds it. Runs of n + 1 words lie within runs of n.
    """
    order = suffix_array(symbols, depth)
    inside = np.ones(len(order), dtype=bool)
    differs = np.zeros(len(order), dtype=bool)
    differs[:1] = True
    for n in range(1, depth + 1):
        last = np.minimum(order + n - 1, len(symbols) - 1)
        inside &= (symbols[last] > 0) & (order + n <= len(symbols))
        differs[1:] |= symbols[last[1:]] != symbols[last[:-1]]  # the common prefix is shorter than n
        run = np.cumsum(differs[inside] | _after_gap(inside)) - 1
        at = order[inside]
        heads = at[np.flatnonzero(np.diff(run, prepend=-1))]
        yield at, run, heads


def _after_gap(inside: np.ndarray) -> np.ndarray:
    """For the suffixes inside, whether the one before is not."""
    out = inside.copy()
    out[1:] &= ~inside[:-1]
    return out[inside]


def feature_buckets(texts: pa.Array, depth: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, ends, n_words): the buckets of all n-grams of 1 ... depth words, text after text, and where each text's end.

    A bucket is the CRC-32 of the n-gram's words, joined by one space, modulo buckets.
    """
    body, offsets = flat(texts)
    body = LOWER[body]
    hashes, starts, ends, first = word_hashes(body, offsets, SIGNS)
    n_words = np.diff(first)
    _, example, ids = np.unique(hashes, return_index=True, return_inverse=True)
    raw = body.tobytes()
    spelled = [raw[a:b] for a, b in zip(starts[example].tolist(), ends[example].tolist(), strict=True)]
    owner = np.repeat(np.arange(len(n_words)), n_words)
    place = np.arange(len(hashes)) + owner  # in the sequence with a 0 after each text
    symbols = np.zeros(len(hashes) + len(n_words), dtype=np.int64)
    symbols[place] = ids.ravel() + 1
    per_word = np.zeros((len(symbols), depth), dtype=np.int32)
    valid = np.zeros((len(symbols), depth), dtype=bool)
    above = np.zeros(len(symbols), dtype=np.uint32)  # the hash of the n-gram of one word less, by position
    for n, (at, run, heads) in enumerate(suffix_runs(symbols, depth)):
        words = (symbols[heads + n] - 1).tolist()
        hashed = [crc32(spelled[w]) for w in words] if n == 0 else [crc32(b" " + spelled[w], h) for w, h in zip(words, above[heads].tolist(), strict=True)]
        above[at] = np.array(hashed, dtype=np.uint32)[run] if len(at) else 0
        per_word[at, n], valid[at, n] = (above[at] % np.uint32(buckets)).astype(np.int32), True
    many = np.minimum(np.maximum(n_words[:, None] - np.arange(depth), 0), n_words[:, None]).sum(axis=1)
    return per_word[valid], np.cumsum(many), n_words


def _features(texts: DataFrame, depth: int, buckets: int) -> DataFrame:
    """Rows of FEATURES: one for each text, and after each part of texts one without n_words that counts its buckets."""

    @handing_back
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                found, ends, n_words = feature_buckets(part.column("text"), depth, buckets)
                rows = part.num_rows
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends, ends[-1:]]).astype(np.int32)), pa.array(found))
                counts = np.bincount(found, minlength=buckets)
                seen = np.flatnonzero(counts)
                bounds = pa.array(np.array([0] * (rows + 1) + [len(seen)], dtype=np.int32))
                ids = pa.concat_arrays([part.column("doc_id"), pa.nulls(1, pa.int64())])
                sizes = pa.array(np.append(n_words, 0), mask=np.arange(rows + 1) == rows)
                columns = [ids, sizes, lists, pa.ListArray.from_arrays(bounds, pa.array(seen.astype(np.int32))), pa.ListArray.from_arrays(bounds, pa.array(counts[seen]))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "buckets", "counted", "times"])

    return texts.mapInArrow(find, FEATURES)


def _counts(features: DataFrame, name: str) -> DataFrame:
    """(bucket, name): at most one row for each bucket, from the counts of each part."""
    parts = features.where("n_words IS NULL").select(F.explode(F.arrays_zip("counted", "times")).alias("x"))
    return parts.groupBy(F.col("x.counted").alias("bucket")).agg(F.sum("x.times").alias(name))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain long): 1000 times the log ratio of the target's to the corpus's smoothed shares, floored.

    corpus: (bucket, s), target: (bucket, t); a bucket that is in neither counts 0 in both.
    """
    every = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(corpus, "bucket", "left").join(target, "bucket", "left").select("bucket", *(F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("s", "t")))
    sums = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))  # one row
    ratio = ((F.col("t") + 1) * (F.col("all_s") + buckets)) / ((F.col("s") + 1) * (F.col("all_t") + buckets))
    return both.crossJoin(F.broadcast(sums)).select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain"))


def importance_weights(docs: DataFrame, target: DataFrame, gram_words: int = GRAM_WORDS, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row of docs (doc_id, text); target has a column text.

    Features are all runs of 1 ... gram_words words; words are runs of ASCII letters and digits and of all other
    characters beyond ASCII, A-Z in lower case; different words are told apart by 64-bit hashes. A text without words (null
    or empty, too) has no features and weight 0. Counts cover all rows, repeated ones each time; very long
    texts are taken whole. Other columns don't matter; an empty table gives an empty result, an empty target has
    no features, so that all gains speak against frequent buckets. The result reads a stored table.
    """
    named = lambda df, key: df.select(key.cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    features = store(_features(named(docs, F.col("doc_id")), gram_words, buckets), "features")
    wanted = store(_counts(_features(named(target, F.lit(None)), gram_words, buckets), "t"), "target")
    table = gains(_counts(features, "s"), wanted, buckets).toPandas().sort_values("bucket")  # as many rows as buckets
    drop(wanted)
    shared = docs.sparkSession.sparkContext.broadcast(table["gain"].to_numpy(dtype=np.int64))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("buckets")
            sizes = lists.value_lengths().to_numpy()
            sums = np.concatenate([[0], np.cumsum(shared.value[lists.flatten().to_numpy()])])
            ends = np.cumsum(sizes)
            weights = (sums[ends] - sums[ends - sizes]) // np.maximum(sizes, 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(sizes.astype(np.int64)), pa.array(weights)], names=["doc_id", "n_words", "n_features", "weight"])

    own = features.where("n_words IS NOT NULL").select("doc_id", "n_words", "buckets")
    return own.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def gumbel_score(weight: Column, key: Column, seed: int = SEED) -> Column:
    """weight plus Gumbel noise in thousandths, from a SHA-256 of seed and key; null where the key is."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return weight + F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def draw(weights: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Adds score and rank (1, 2, 3 ... by falling score, ties to smaller doc_id; null for what isn't drawn) to weights.

    Of the rows with at least least_words words, percent of 100 are drawn, rounded down. Rows without doc_id have no
    score and are never drawn, nor do they count among the rows to draw from. Rows with one doc_id and one score share neighbouring
    ranks. A rank is the number of rows with higher scores, from a count for each score, and a place among equal
    scores; scores are whole thousandths, and the noise leaves no score more than about 0.04 % of different doc_ids.
    """
    scored = store(weights.withColumn("score", gumbel_score(F.col("weight"), F.col("doc_id"), seed)), "scored")
    able = (F.col("n_words") >= least_words) & F.col("doc_id").isNotNull()
    heights = scored.where(able).groupBy("score").agg(F.count("*").alias("_here"))
    upwards = Window.orderBy(F.col("score").desc())  # over different scores only: some ten thousands, whatever the corpus
    above = heights.withColumn("_above", F.sum("_here").over(upwards) - F.col("_here")).withColumn("_most", F.floor(F.sum("_here").over(Window.partitionBy()) * percent / 100))
    above = store(above.where("_above < _most").select("score", "_above", "_most"), "heights")
    lowest = above.agg(F.min("score").alias("_lowest"))  # one row, null if nothing is drawn
    high = able & F.coalesce(F.col("score") >= F.col("_lowest"), F.lit(False))
    judged = scored.crossJoin(F.broadcast(lowest)).withColumn("_high", high).drop("_lowest")
    place = F.col("_above") + F.row_number().over(Window.partitionBy("score").orderBy("doc_id", "n_words"))
    drawn = judged.where("_high").join(above, "score").withColumn("rank", place)
    drawn = drawn.select(*scored.columns, F.when(F.col("rank") <= F.col("_most"), F.col("rank")).cast("long").alias("rank"))
    return drawn.union(judged.where("NOT _high").select(*scored.columns, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """The rows of docs whose doc_id is drawn, with all their columns; rows that share a drawn doc_id all come."""
    chosen = draw(importance_weights(docs, target), percent, least_words, seed).where("rank IS NOT NULL").select(F.col("doc_id").alias("_drawn"))
    return docs.join(chosen, F.col("doc_id") == F.col("_drawn"), "left_semi")
