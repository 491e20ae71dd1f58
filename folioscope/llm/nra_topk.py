"""Exact top-k inner products by aggregation without random access.

Each component is a list of (row, value) sorted by value. For a query, every list is read in turn from
its good end, the high one for a positive weight, the low one for a negative, in steps of equal depth. Every row
has a score of what was read of it, and bounds on what was not: the list's worst value from below, the
place the reading has come to from above. Reading stops for a query when few rows are left whose upper bound
reaches the k-th best score known so far; only those rows' final scores are then resolved.

The table is dealt into blocks with lists of their own. A first block answers every query; its k-th best
scores are the bars that the other blocks start from, so most of their rows fall out before the lists end.
The blocks' best rows are merged. Blocks and query chunks are both bounded, so is the memory of a task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.storage import store
from folioscope.llm.vectors import best_per_query, finite, least_copies

BLOCK_ROWS = 8192
CHUNK_QUERIES = 1024
TOGETHER = 256  # queries that read together
STEPS = 16  # in which the lists are read to their ends
FEW = 64  # rows that may be left when reading stops, or this part of a block
PART = 32


class SortedLists:
    """The sorted lists of one block of distinct integer vectors, for many queries at a time.

    entries counts what the queries have read: one for each entry of a list that a query's reading passed.
    """

    def __init__(self, matrix: np.ndarray):
        self.matrix = matrix.astype(np.float64)
        self.order = np.argsort(matrix, axis=0, kind="stable")
        self.values = np.take_along_axis(self.matrix, self.order, axis=0)
        self.entries = 0

    def _read(self, scores: np.ndarray, unread: tuple, high: np.ndarray, low: np.ndarray, start: int, stop: int) -> None:
        """Adds the entries from depth start to stop of every list's both ends to the scores (rows x queries)."""
        rows = len(self.matrix)
        for j in range(self.matrix.shape[1]):
            for side, weights, part in ((0, high[j], slice(rows - stop, rows - start)), (1, low[j], slice(start, stop))):
                own = self.order[part, j]
                unread[side][own, j] = 0.0
                if weights.any():
                    scores[own] += self.values[part, j][:, None] * weights

    def survivors(self, queries: np.ndarray, k: int, bars: np.ndarray | None = None) -> list[np.ndarray]:
        """For each query the row numbers that can be among its k best and reach its bar; no other can."""
        bars = np.full(len(queries), -np.inf) if bars is None else bars
        out: list[np.ndarray] = []
        for at in range(0, len(queries), TOGETHER):
            out += self._together(queries[at : at + TOGETHER].astype(np.float64), k, bars[at : at + TOGETHER])
        return out

    def _together(self, queries: np.ndarray, k: int, bars: np.ndarray) -> list[np.ndarray]:
        rows, lists = self.matrix.shape
        out = [np.arange(rows)] * len(queries)
        if rows <= max(k, FEW):
            return out
        still, barred = np.arange(len(queries)), bool(np.isfinite(bars).all())  # bars of a whole block are above lower bounds
        high, low = np.maximum(queries.T, 0), np.minimum(queries.T, 0)
        scores, unread = np.zeros((rows, len(queries))), (np.ones((rows, lists)), np.ones((rows, lists)))
        few, read = max(FEW, rows // PART), 0
        for depth in sorted({-(-rows * step // STEPS) for step in range(1, STEPS + 1)}):
            self._read(scores, unread, high, low, read, depth)
            self.entries += (depth - read) * lists * len(still)
            read = depth
            upper = scores + unread[0] @ (self.values[rows - depth][:, None] * high) + unread[1] @ (self.values[depth - 1][:, None] * low)
            if not barred:
                lower = scores + unread[0] @ (self.values[0][:, None] * high) + unread[1] @ (self.values[-1][:, None] * low)
                bars = np.maximum(bars, np.partition(lower, rows - k, axis=0)[rows - k])
            alive = upper >= bars - 0.5  # scores are integers
            done = (alive.sum(axis=0) <= few) | (depth == rows)
            for i in np.flatnonzero(done):
                out[still[i]] = np.flatnonzero(alive[:, i])
            if done.all():
                break
            if done.any():
                still, bars, scores, high, low = still[~done], bars[~done], scores[:, ~done], high[:, ~done], low[:, ~done]
        return out


def _answer(ids: list[np.ndarray], matrix: np.ndarray, alive: np.ndarray, own: int, query: np.ndarray, k: int) -> tuple[list[int], list[int]]:
    """Final scores of the rows that are left, and the k best of their ids."""
    scores = matrix[alive] @ query
    found: list[tuple[int, int]] = []
    for i in np.lexsort(([ids[a][0] for a in alive], -scores)):
        if len(found) >= k and scores[i] < found[k - 1][0]:
            break
        found += [(int(scores[i]), int(x)) for x in ids[alive[i]] if x != own]
        found.sort(key=lambda pair: (-pair[0], pair[1]))
    return [x for _, x in found[:k]], [s for s, _ in found[:k]]


def top_inner_products(rows: DataFrame, is_query, id_col: str, vector_col: str, k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, id, score long): for each row where is_query holds, the k rows with the highest
    inner product of the components floor(scale * x), x as double.

    Ties go to smaller ids; a row is no result of its own id; with k candidates or fewer all are returned.
    Vectors that are null or hold null or non-finite components take no part, neither do null ids; of
    vectors of different lengths the missing components count as zero. Zero vectors take part. Rows that
    repeat an id count once, with their best score; other columns don't matter; an empty table gives an empty
    result. Products of components are exact while scores stay below 2 ** 53.
    """
    vector = F.transform(F.col(vector_col).cast("array<double>"), lambda x: F.floor(scale * x))
    whole = rows.where(F.col(id_col).isNotNull() & finite(F.col(vector_col)))
    whole = whole.select(F.col(id_col).alias("id"), vector.alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    size = whole.agg(F.count("*").alias("n"), F.count_if("asks").alias("q"), F.max(F.size("vector")).alias("length")).first()
    blocks = max(1, math.ceil(size.n / BLOCK_ROWS))
    chunks = max(1, math.ceil(size.q / CHUNK_QUERIES))
    length = max(size.length or 0, 1)

    if not size.q:
        return rows.sparkSession.createDataFrame([], f"query_id {whole.schema['id'].dataType.simpleString()}, rank int, id {whole.schema['id'].dataType.simpleString()}, score long")

    deal = lambda n: F.pmod(F.xxhash64("id", F.lit(n)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = least_copies(whole.select("id", "vector"), k + 1).select("id", "vector", deal(blocks).alias("block"))
    asked = whole.where("asks").select(F.col("id").alias("q_id"), F.col("vector").alias("q_vector"), deal(chunks).alias("q_chunk"))

    def matrix_of(vectors) -> np.ndarray:
        out = np.zeros((len(vectors), length), dtype=np.int64)
        for row, v in zip(out, vectors, strict=True):
            row[: len(v)] = v
        return out

    def answer(block, chunk):
        out: dict = {"query_id": [], "id": [], "score": []}
        if len(block) and len(chunk):
            distinct, which = np.unique(matrix_of(block["vector"]), axis=0, return_inverse=True)
            order = np.lexsort((block["id"], which.ravel()))
            cuts = np.searchsorted(which.ravel()[order], np.arange(1, len(distinct)))
            ids = np.split(block["id"].to_numpy()[order], cuts)
            queries = matrix_of(chunk["q_vector"])
            left = SortedLists(distinct).survivors(queries, k + 1, chunk["bar"].to_numpy(dtype=np.float64))
            for own, query, alive in zip(chunk["q_id"], queries, left, strict=True):
                near, scores = _answer(ids, distinct, alive, own, query, k)
                out["query_id"] += [own] * len(near)
                out["id"] += near
                out["score"] += scores
        return pd.DataFrame(out)

    def search(held: DataFrame, asked: DataFrame, first: int, last: int) -> DataFrame:
        """The best rows of blocks first to last for every query."""
        left = held.where(F.col("block").between(first, last)).withColumn("chunk", every(chunks)).groupBy("block", "chunk")
        right = asked.withColumn("q_block", F.explode(F.sequence(F.lit(first), F.lit(last)))).groupBy("q_block", "q_chunk")
        return left.cogroup(right).applyInPandas(answer, "query_id long, id long, score long")

    best = lambda found: best_per_query(found.groupBy("query_id", "id").agg(F.max("score").alias("score")), [F.desc("score"), F.col("id")], k)
    start = search(held, asked.withColumn("bar", F.lit(float("-inf"))), 0, 0)
    if blocks == 1:
        return best(start)
    start = store(best(start), "first-block")
    bars = start.where(F.col("rank") == k).select(F.col("query_id").alias("q_id"), F.col("score").cast("double").alias("bar"))
    barred = asked.join(bars, "q_id", "left").fillna(float("-inf"), ["bar"])
    return best(start.select("query_id", "id", "score").union(search(held, barred, 1, blocks - 1)))
