"""Approximate nearest neighbours by shifted space-filling curves.

Each curve projects the vectors on a few random directions, shifts the grid and orders the rows by
Hilbert key. Spark deals every curve's keys out by range; a query looks at the rows within a window
around its own place on each curve. Along the curves travel one byte for each component, which is enough to
choose the nearest few of a window; the windows of all curves are merged, and the chosen pairs
are joined with the original vectors once and reranked by exact distance.

The window is a share of the table. It is fit on a bounded sample of rows (``sample_rows``): the
smallest share of a fixed ladder at which the sample's own queries reach ``target_recall``. Every
row is indexed on every curve. On data with clusters the fitted share is small; on vectors without any
structure no order of the rows brings neighbours together, and the share grows until the recall is reached.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.storage import store, width
from folioscope.llm.vectors import best_per_query, finite, least_copies

LADDER = (0.0005, 0.001, 0.002, 0.004, 0.008, 0.016, 0.024, 0.032, 0.048, 0.064, 0.096, 0.128, 0.192, 0.256, 0.5, 1.0)
BLOCK_ROWS = 4096


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer cells (rows x dims, each below 2**bits) by the transposed bit method."""
    x = cells.astype(np.uint64).T.copy()
    one, dims = np.uint64(1), len(x)
    for level in range(bits - 1, 0, -1):
        bit, low = one << np.uint64(level), (one << np.uint64(level)) - one
        for i in range(dims):
            inverted = (x[i] & bit) != 0
            swap = np.where(inverted, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(inverted, low, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flips = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flips ^= np.where((x[-1] >> np.uint64(level)) & one, (one << np.uint64(level)) - one, np.uint64(0))
    x ^= flips
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << one) | ((x[i] >> np.uint64(level)) & one)
    return key.astype(np.int64)


class Curves:
    """Seeded projections and shifts for some number of curves over vectors of one length."""

    def __init__(self, sample: np.ndarray, curves: int, dims: int, seed: int):
        rng = np.random.default_rng(seed)
        length = sample.shape[1]
        self.dims = min(dims, length)
        self.bits = min(16, 62 // self.dims)
        self.planes, self.low, self.span = [], [], []
        for _ in range(curves):
            plane = np.linalg.qr(rng.normal(size=(length, self.dims)))[0]
            seen = sample @ plane
            spread = np.maximum(seen.std(axis=0), 1e-12) * 8
            self.planes.append(plane)
            self.low.append(seen.mean(axis=0) - spread * (0.5 + rng.uniform(-0.05, 0.05, self.dims)))
            self.span.append(spread)

    def keys(self, vectors: np.ndarray, curve: int) -> np.ndarray:
        top = (1 << self.bits) - 1
        at = (vectors @ self.planes[curve] - self.low[curve]) / self.span[curve]
        return hilbert_keys(np.clip(np.nan_to_num(at) * (top + 1), 0, top).astype(np.int64), self.bits)


def fit_share(curves: Curves, sample: np.ndarray, k: int, target: float, queries: int = 128) -> float:
    """Smallest share of LADDER (rows on each side of a query) with the target recall inside the sample."""
    n = len(sample)
    asked = np.arange(0, n, max(1, n // queries))
    truth = []
    for q in asked:
        distance = ((sample - sample[q]) ** 2).sum(axis=1)
        distance[q] = np.inf
        truth.append(np.argsort(distance, kind="stable")[: min(k, n - 1)])
    truth = np.array(truth)
    nearest = np.full(truth.shape, n)
    for c in range(len(curves.planes)):
        place = np.empty(n, dtype=np.int64)
        place[np.argsort(curves.keys(sample, c), kind="stable")] = np.arange(n)
        nearest = np.minimum(nearest, np.abs(place[truth] - place[asked][:, None]))
    return next((share for share in LADDER if (nearest <= share * n).mean() >= target), 1.0)


def nearest_neighbours(rows: DataFrame, is_query, id_col: str, vector_col: str, k: int = 10, curves: int = 16, dims: int = 6, target_recall: float = 0.96, sample_rows: int = 4096, seed: int = 7) -> DataFrame:
    """(query_id, rank, id, score): the k nearest rows found for each row where is_query holds.

    Score is the Euclidean distance in double precision; ties go to smaller ids; a row is no neighbour of
    its own id. Vectors that are null, zero, hold null or non-finite components, or differ in length from
    the most frequent length take no part, neither do null ids. With k candidates or fewer all are
    returned; rows that repeat an id count once, with their smallest distance; other columns don't matter; an
    empty table gives an empty result.
    """
    spark = rows.sparkSession
    kind = rows.schema[vector_col].dataType.simpleString()
    vector = F.col(vector_col) if kind in ("array<float>", "array<double>") else F.col(vector_col).cast("array<double>")
    whole = rows.select(F.col(id_col).alias("id"), vector.alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    whole = whole.where(F.col("id").isNotNull() & finite(F.col("vector")) & F.exists("vector", lambda x: x != 0))
    empty = spark.createDataFrame([], "query_id long, rank int, id long, score double")
    common = whole.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), "length").first()
    if common is None:
        return empty
    length, n = common["length"], common["count"]
    whole = whole.where(F.size("vector") == length)
    # The threshold leaves about twice the sample, so no task orders more than that.
    hashed = whole.where(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < math.ceil(min(2 * sample_rows / n, 1.0) * (1 << 40)))
    sample = np.array([r.vector for r in hashed.orderBy(F.xxhash64("id")).select("vector").limit(sample_rows).collect()])
    if not len(sample):
        sample = np.array([r.vector for r in whole.select("vector").limit(1).collect()])
    fitted = Curves(sample, curves, dims, seed)
    reach = max(math.ceil(fit_share(fitted, sample, k, target_recall) * n), 4 * k)
    step = max(float(np.abs(sample).max()), 1e-300) / 127
    ranges = max(1, math.ceil(width(spark) / curves))
    cuts = [np.sort(fitted.keys(sample, c))[(np.arange(1, ranges) * len(sample)) // ranges] for c in range(curves)]

    indexed = least_copies(whole.select("id", "vector"), k + 1).withColumn("asks", F.lit(False))
    both = indexed.union(whole.where("asks").select("id", "vector", "asks")).withColumn("holds", ~F.col("asks"))

    def along_curves(batches):
        for pdf in batches:
            if len(pdf):
                matrix = np.array(pdf["vector"].tolist(), dtype=np.float64)
                codes = np.clip(np.rint(matrix / step), -127, 127).astype(np.int8)
                coded = pdf.drop(columns="vector").assign(code=[row.tobytes() for row in codes])
                for c in range(curves):
                    keys = fitted.keys(matrix, c)
                    part = c * ranges + np.searchsorted(cuts[c], keys, side="right")
                    yield coded.assign(curve=np.int32(c), part=part.astype(np.int32), key=keys)

    placed = both.mapInPandas(along_curves, "id long, asks boolean, holds boolean, code binary, curve int, part int, key long")
    ordered = placed.repartition(curves * ranges, "part").sortWithinPartitions("part", "key", "id", "holds")
    ordered = store(ordered.select("curve", "part", "id", "code", "asks", "holds").withColumn("pos", F.monotonically_increasing_id()), "curves")
    parts = ordered.groupBy("curve", "part").agg(F.min("pos").alias("first"), F.count("*").alias("n"))
    starts, before = [], {}
    for r in sorted(parts.collect()):  # a row for each range of each curve
        starts.append((r["curve"], r.part, before.get(r["curve"], 0) - r["first"]))
        before[r["curve"]] = before.get(r["curve"], 0) + r.n
    starts = spark.createDataFrame(starts, "curve int, part int, shift long")
    ranked = ordered.join(F.broadcast(starts), ["curve", "part"]).withColumn("place", F.col("pos") + F.col("shift"))

    held = ranked.where("holds").withColumn("block", F.floor(F.col("place") / BLOCK_ROWS))
    first, last = F.floor((F.col("place") - reach) / BLOCK_ROWS), F.floor((F.col("place") + reach) / BLOCK_ROWS)
    asked = ranked.where("asks").withColumn("block", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
    asked = asked.select(*(F.col(c).alias(f"q_{c}") for c in ("curve", "block", "id", "place", "code")))
    chosen = 3 * k  # by the codes, of each window and of each query

    def choose(blocks, queries):
        found = []
        if len(blocks) and len(queries):
            order = np.argsort(blocks["place"].to_numpy())
            ids, places = blocks["id"].to_numpy()[order], blocks["place"].to_numpy()[order]
            matrix = np.frombuffer(b"".join(blocks["code"]), dtype=np.int8).reshape(len(blocks), length)[order].astype(np.float32)
            for query, place, own in zip(queries["q_code"], queries["q_place"], queries["q_id"], strict=True):
                low, high = np.searchsorted(places, (place - reach, place + reach + 1))
                distance = ((matrix[low:high] - np.frombuffer(query, dtype=np.int8)) ** 2).sum(axis=1)
                near = ids[low:high]
                distance, near = distance[near != own], near[near != own]
                first = np.lexsort((near, distance))[:chosen] if len(near) <= chosen else np.argpartition(distance, chosen - 1)[:chosen]
                found.append(pd.DataFrame({"query_id": own, "id": near[first], "score": distance[first].astype(np.float64)}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "id": [], "score": []})

    near = held.select("curve", "block", "id", "place", "code").groupBy("curve", "block").cogroup(asked.groupBy("q_curve", "q_block"))
    near = near.applyInPandas(choose, "query_id long, id long, score double").groupBy("query_id", "id").agg(F.min("score").alias("score"))
    pairs = best_per_query(near, [F.col("score"), F.col("id")], chosen).select("query_id", "id")
    asking = whole.where("asks").select(F.col("id").alias("query_id"), F.col("vector").alias("asked"))
    exact = pairs.join(asking, "query_id").join(indexed.select("id", "vector"), "id")
    squares = F.zip_with(F.col("asked").cast("array<double>"), F.col("vector").cast("array<double>"), lambda a, b: (a - b) * (a - b))
    exact = exact.withColumn("score", F.sqrt(F.aggregate(squares, F.lit(0.0), lambda a, b: a + b)))
    return best_per_query(exact.groupBy("query_id", "id").agg(F.min("score").alias("score")), [F.col("score"), F.col("id")], k)
