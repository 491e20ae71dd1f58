"""Passages of a benchmark in training documents, found by an FM-index per training shard.

A benchmark's phrases are its windows of consecutive words. Every shard (a bounded number of bytes of a
partition's texts) is indexed: words that no phrase holds end a lane, the other words are symbols. The phrases are
searched backwards through the shard's wavelet-tree ranks, their occurrences are located by sampled suffix
positions, and the occurrences of a document merge into removal spans. Documents aren't shuffled.

Phrases come in blocks of about PHRASE_ROWS phrases of one item, so what is broadcast has a bound
whatever the benchmark's size; another block is another pass over the documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folioscope.llm.flat_text import SIGNS, flat, handing_back, slices, word_hashes
from folioscope.llm.phrase_index import PhraseIndex, lanes
from folioscope.llm.shingles import LOWER
from folioscope.llm.storage import drop, store

WINDOW = 10
PHRASE_ROWS = 200_000
SHARD_BYTES = 4_000_000  # of texts in one index, unless one text is longer
NEW = "n_words long, n_hit long, spans array<struct<start:int,end:int>>, items array<long>"
NAMES = ["n_words", "n_hit", "spans", "items"]


def phrases_of(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, words array<long>): the different windows of each item, as word hashes; a shorter item is one phrase."""

    @handing_back
    def cut(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                body, offsets = flat(part.column("text"))
                hashes, _, _, first = word_hashes(LOWER[body], offsets, SIGNS)
                have = np.diff(first)
                many = np.where(have, np.maximum(have - window + 1, 1), 0)
                size = np.repeat(np.minimum(have, window), many)
                starts = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[:-1], many)
                ends = np.cumsum(size)
                words = hashes[np.arange(size.sum()) + np.repeat(starts - ends + size, size)].view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(words))
                ids = part.column("item_id").take(pa.array(np.repeat(np.arange(len(have)), many)))
                yield pa.RecordBatch.from_arrays([ids, lists], names=["item_id", "words"])

    named = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return named.mapInArrow(cut, "item_id long, words array<long>").distinct()


@dataclass
class Phrases:
    """A block of different phrases: hashes of all their words, symbols padded to one width, and who holds each."""

    vocabulary: np.ndarray  # sorted; the symbol of a word is its place + 1
    table: np.ndarray
    lengths: np.ndarray
    held: np.ndarray  # items of phrase i: items[held[i]:held[i + 1]]
    items: np.ndarray

    @staticmethod
    def of(rows: pa.Table) -> Phrases:
        known: dict[bytes, list[int]] = {}
        for item, words in zip(rows.column("item_id").to_pylist(), rows.column("words").to_pylist(), strict=True):
            known.setdefault(np.array(words, dtype=np.int64).tobytes(), []).extend([] if item is None else [item])
        split = [np.frombuffer(key, dtype=np.uint64) for key in known]
        lengths = np.array([len(x) for x in split], dtype=np.int64)
        vocabulary, numbers = np.unique(np.concatenate(split) if split else np.zeros(0, dtype=np.uint64), return_inverse=True)
        table = np.zeros((len(split), int(lengths.max(initial=1))), dtype=np.int64)
        table[np.arange(table.shape[1]) < lengths[:, None]] = numbers.ravel() + 1
        held = np.cumsum([0, *map(len, known.values())])
        return Phrases(vocabulary, table, lengths, held, np.array([x for own in known.values() for x in own], dtype=np.int64))

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(hashes), dtype=np.int64)
        place = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[place] == hashes, place + 1, 0)


class Shard:
    """The texts of one training shard: their words, and what a block of phrases hits in them."""

    def __init__(self, texts: pa.Array):
        self.body, self.offsets = flat(texts)
        self.hashes, self.starts, self.ends, self.first = word_hashes(LOWER[self.body], self.offsets, SIGNS)
        self.n = np.diff(self.first)

    def search(self, block: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, first word, end word) of all occurrences; none runs over the end of a text."""
        symbols, none = block.symbols(self.hashes), np.zeros(0, dtype=np.int64)
        if not len(block.lengths):
            return none, none, none
        starts, ends = lanes(symbols, self.first, int(block.lengths.min()), int(block.lengths.max()))
        if not len(starts):
            return none, none, none
        index = PhraseIndex(symbols, starts, ends, len(block.vocabulary) + 1)
        phrase, at = index.occurrences(block.table, block.lengths)
        return phrase, at, at + block.lengths[phrase]

    def covered(self, at: np.ndarray, to: np.ndarray) -> np.ndarray:
        edges = np.bincount(at, minlength=len(self.hashes) + 1) - np.bincount(to, minlength=len(self.hashes) + 1)
        return np.cumsum(edges[: len(self.hashes)]) > 0

    def runs(self, covered: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, first word, end word) of merged ranges, within texts."""
        begins, stops = covered.copy(), covered.copy()
        begins[1:] &= ~covered[:-1]
        stops[:-1] &= ~covered[1:]
        inner = self.first[(self.first > 0) & (self.first < len(covered))]
        begins[inner] |= covered[inner]
        stops[inner - 1] |= covered[inner - 1]
        a, b = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        return np.searchsorted(self.first, a, side="right") - 1, a, b

    def points(self, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Code points from the beginning of text owner to byte at."""
        if not len(at):
            return np.zeros(0, dtype=np.int32)
        before = np.concatenate([[0], np.cumsum((self.body & 0xC0) != 0x80)])
        return (before[at] - before[self.offsets[owner]]).astype(np.int32)


def _lists(owner: np.ndarray, rows: int, values: pa.Array) -> pa.ListArray:
    bounds = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=rows))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), values)


def _spread(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, value) of lists without nulls."""
    return np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()), pc.list_flatten(lists).to_numpy(zero_copy_only=False)


def _pass(docs: DataFrame, text: str, block: Phrases) -> DataFrame:
    """docs with NEW and _ranges, what this block hits joined to what earlier ones did."""
    kept = [c for c in docs.columns if c not in (*NAMES, "_ranges")]
    earlier, shared = "_ranges" in docs.columns, docs.sparkSession.sparkContext.broadcast(block)

    @handing_back
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, SHARD_BYTES):
                shard, rows = Shard(part.column(text)), part.num_rows
                phrase, at, to = shard.search(shared.value)
                owner = np.searchsorted(shard.first, at, side="right") - 1
                pairs = np.unique(np.stack([owner, phrase]), axis=1) if len(owner) else np.zeros((2, 0), dtype=np.int64)
                many = shared.value.held[pairs[1] + 1] - shared.value.held[pairs[1]]
                which = np.arange(many.sum()) + np.repeat(shared.value.held[pairs[1]] - np.cumsum(many) + many, many)
                items = np.stack([np.repeat(pairs[0], many), shared.value.items[which]])
                if earlier:
                    items = np.concatenate([items, np.stack(_spread(part.column("items")))], axis=1)
                    before, edges = _spread(part.column("_ranges"))
                    edges = edges + shard.first[before]
                    at, to = np.concatenate([at, edges[::2]]), np.concatenate([to, edges[1::2]])
                items = np.unique(items, axis=1) if items.shape[1] else items
                covered = shard.covered(at, to)
                owner, a, b = shard.runs(covered)
                hits = np.concatenate([[0], np.cumsum(covered)])
                spans = pa.StructArray.from_arrays([pa.array(shard.points(owner, x)) for x in (shard.starts[a], shard.ends[b - 1])], names=["start", "end"])
                ranges = (np.stack([a, b], axis=1) - shard.first[owner][:, None]).ravel().astype(np.int32)
                new = [pa.array(shard.n), pa.array(hits[shard.first[1:]] - hits[shard.first[:-1]]), _lists(owner, rows, spans)]
                new += [_lists(items[0], rows, pa.array(items[1])), _lists(np.repeat(owner, 2), rows, pa.array(ranges))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *new], names=[*kept, *NAMES, "_ranges"])

    wide = StructType([*docs.select(*kept).schema.fields, *StructType.fromDDL(f"{NEW}, _ranges array<int>").fields])
    return docs.mapInArrow(search, wide)


def find_benchmark_passages(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", phrase_rows: int = PHRASE_ROWS) -> DataFrame:
    """Adds n_words, n_hit (words inside an occurrence of a phrase), spans and items to docs.

    benchmark: (item_id, text). A phrase is window consecutive words of an item, or all words of a shorter item; words are
    runs of ASCII letters and digits and of all other characters beyond ASCII, A-Z in lower case, compared
    as 64-bit hashes. spans are the merged ranges of code points to remove, ends exclusive; items are the ids of the
    items with a phrase in the text, ascending. Null and empty texts have no words; an item without words has no
    phrase, one without id is hit but not listed; items with one id count once. Very long texts are
    taken whole, as a shard of their own. Each row stands alone, so repeated rows get equal results. Other columns
    stay, columns of the new names are replaced; an empty table or an empty benchmark gives no hits.
    """
    docs = docs.drop(*NAMES, "_ranges").withColumn(text, F.col(text).cast("string"))
    phrases = store(phrases_of(benchmark, window), "phrases")
    blocks = max(1, math.ceil(phrases.count() / phrase_rows))
    for number in range(blocks):
        own = phrases if blocks == 1 else phrases.where(F.pmod(F.xxhash64("words", "item_id"), F.lit(blocks)) == number)
        found = _pass(docs, text, Phrases.of(own.toArrow()))  # about phrase_rows rows of at most window words
        docs = store(found, "passages") if number + 1 < blocks else found
    drop(phrases)
    return docs.drop("_ranges")


def without_spans(text: Column, spans: Column) -> Column:
    """text without its spans, which ascend and don't overlap; what is left and right of a span stays as it is."""
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda state, s: F.struct(s["end"].alias("at"), F.concat(state["out"], F.substr(text, state["at"] + 1, s["start"] - state["at"])).alias("out"))
    done = F.aggregate(spans, begin, step)
    return F.when(F.size(spans) > 0, F.concat(done["out"], F.substr(text, done["at"] + 1, F.length(text)))).otherwise(text)


def remove_benchmark_passages(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with the benchmark's passages cut out of text; every row stays, null texts stay null."""
    found = find_benchmark_passages(docs, benchmark, window)
    return found.withColumn("text", without_spans(F.col("text"), F.col("spans"))).select(*docs.columns)
