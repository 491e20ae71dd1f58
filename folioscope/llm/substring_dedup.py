"""Removal of passages that an earlier document already has.

A word goes when it lies in a window of ``window`` words that also starts in a document with a smaller id.

Documents that repeat a whole word sequence are settled by its fingerprint. For the others, every window
names one anchor, its least shingle by hash, so equal windows name equal anchors. The first document
with an anchor leads it. The passages around led anchors go to shards by leader, each shard builds a
compressed FM-index over them, and the other documents' passages are streamed through by backward
search: where the matching statistic reaches the window, the words are in the leader. Windows that their
anchor's leader does not hold can still be shared by later documents: they go through the same
search once more, led by the first document with the whole window.

Leaders with much to stream are copied to several shards, so a passage that a third of all documents
share is no hot key.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from folioscope.llm.flat_text import flat, handing_back, mixed, rolling, slices, word_hashes
from folioscope.llm.fm_index import FMIndex
from folioscope.llm.storage import drop, store, width

WINDOW = 50
ANCHOR_WORDS = 8
LANE_WORDS = 128
LANES = 4096
SHARD_WORDS = 400_000
INDEX_WORDS = 600_000  # of one index; a shard that holds more has several
ASKED_WORDS = 200_000  # streamed at a time
EMITTED_WORDS = 400_000  # of passages in one batch
CUT_SCHEMA = "leader long, copies int, salt int, streamed boolean, doc_id long, fp long, start int, words array<long>"
FOUND_SCHEMA = "doc_id long, fp long, cuts array<int>, rest array<long>"
FOUND = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("cuts", pa.list_(pa.int32())), ("rest", pa.list_(pa.int64()))])


class Words:
    """Word hashes of a batch of texts, with a fingerprint of each whole sequence."""

    def __init__(self, texts: pa.Array):
        self.body, offsets = flat(texts)
        self.hashes, self.starts, self.ends, self.first = word_hashes(self.body, offsets)
        self.n = np.diff(self.first)
        self.fp = rolling(self.hashes, self.first[:-1], self.first[1:]).astype(np.int64)

    def window_hashes(self, window: int) -> np.ndarray:
        """By first word; windows that run over the end of a text are to be left out by the caller."""
        at = np.arange(max(0, len(self.hashes) - window + 1))
        return rolling(self.hashes, at, at + window)

    def anchors(self, window: int) -> np.ndarray:
        """By first word of a window its least hash of ANCHOR_WORDS words."""
        size = min(ANCHOR_WORDS, window)
        at = np.arange(max(0, len(self.hashes) - size + 1))
        least = mixed(rolling(self.hashes, at, at + size) ^ np.uint64(0xA0761D6478BD642F))
        span, want = 1, window - size + 1
        while 2 * span <= want:
            least, span = np.minimum(least[:-span], least[span:]) if len(least) > span else least[:0], 2 * span
        rest = want - span
        return (np.minimum(least[: len(least) - rest], least[rest:]) if rest else least) if len(least) > rest else least[:0]

    def keys(self, window: int, whole: bool) -> np.ndarray:
        return (self.window_hashes(window) if whole else self.anchors(window)).astype(np.int64)


def _profiles(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, n, fp, fp2, anchors, windows): size, fingerprints, distinct anchors and how many windows name each."""

    def lists(own: list, kind) -> pa.ListArray:
        bounds = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32))
        return pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(own).astype(kind) if own else np.zeros(0, dtype=kind)))

    @handing_back
    def profile(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"))
                keys = words.keys(window, whole=False)
                own = [np.unique(keys[a : max(a, b - window + 1)], return_counts=True) for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
                sums = np.concatenate([[0], np.cumsum(mixed(words.hashes), dtype=np.uint64)]).astype(np.uint64)
                fp2 = (sums[words.first[1:]] - sums[words.first[:-1]]).astype(np.int64)
                columns = [part.column("doc_id"), pa.array(words.n), pa.array(words.fp), pa.array(fp2), lists([k for k, _ in own], np.int64), lists([n for _, n in own], np.int32)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "fp", "fp2", "anchors", "windows"])

    return docs.select("doc_id", "text").mapInArrow(profile, "doc_id long, n long, fp long, fp2 long, anchors array<long>, windows array<int>")


def _runs(chosen: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Word ranges that cover windows at these ascending first words; windows that touch are joined."""
    breaks = np.flatnonzero(np.diff(chosen) > window) + 1
    return [(int(part[0]), int(part[-1]) + window) for part in np.split(chosen, breaks)]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    leader, copies, salt, streamed, doc_id, fp, start, lists = zip(*rows, strict=True)
    bounds = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32))
    columns = [pa.array(leader, pa.int64()), pa.array(copies, pa.int32()), pa.array(salt, pa.int32()), pa.array(streamed), pa.array(doc_id, pa.int64()), pa.array(fp, pa.int64()), pa.array(start, pa.int32()), pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(lists)))]
    return pa.RecordBatch.from_arrays(columns, names=["leader", "copies", "salt", "streamed", "doc_id", "fp", "start", "words"])


def _passages(docs: DataFrame, led: DataFrame, window: int, whole: bool) -> DataFrame:
    """The passages of CUT_SCHEMA around led keys. led: (doc_id, led array<struct<key, leader, copies>>).

    A leader's own passage is one row here, whatever the number of its copies; batches hold a bounded
    number of words unless one passage has more.
    """

    @handing_back
    def cut(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"))
                keys = words.keys(window, whole)
                rows, held = [], 0
                ids = part.column("doc_id").to_numpy()
                scattered = mixed(ids.astype(np.uint64))
                for i, own in enumerate(part.column("led")):
                    first, last = int(words.first[i]), int(words.first[i + 1]) - window + 1
                    if last <= first:
                        continue
                    table, leaders, copies = (own.values.field(name).to_numpy() for name in ("key", "leader", "copies"))
                    by_key = np.argsort(table)
                    table, leaders, copies = table[by_key], leaders[by_key], copies[by_key]
                    place = np.minimum(np.searchsorted(table, keys[first:last]), len(table) - 1)
                    hit = table[place] == keys[first:last]
                    for leader in np.unique(leaders[place[hit]]).tolist():
                        most, streamed = int(copies[leaders == leader].max()), leader != ids[i]
                        salt = int(scattered[i] % np.uint64(most)) if streamed else -1
                        for a, b in _runs(np.flatnonzero(hit & (leaders[place] == leader)), window):
                            rows.append((leader, most, salt, streamed, ids[i], words.fp[i], a, words.hashes[first + a : first + b].view(np.int64)))
                            held += b - a
                            if held > EMITTED_WORDS:
                                yield _batch(rows)
                                rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return docs.select("doc_id", "text").join(led, "doc_id").select("doc_id", "text", "led").mapInArrow(cut, CUT_SCHEMA)


def _words(passages: pa.Table) -> np.ndarray:
    return pc.list_flatten(passages.column("words")).to_numpy().view(np.uint64)


def _symbols(passages: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, starts, ends): words told apart by leader, passage after passage."""
    sizes = pc.list_value_length(passages.column("words")).to_numpy().astype(np.int64)
    ends = np.cumsum(sizes)
    leaders = np.repeat(mixed(passages.column("leader").to_numpy().astype(np.uint64)), sizes)
    return mixed(_words(passages) ^ leaders), ends - sizes, ends


class Index:
    """FM-index over the passages of a shard's leaders, in parts of at most INDEX_WORDS words."""

    def __init__(self, held: pa.Table, window: int):
        self.window, self.parts = window, []
        keys, starts, ends = _symbols(held)
        # A passage longer than a part is held as pieces that share window - 1 words, so no window is lost.
        step = max(INDEX_WORDS - window + 1, 1)
        pieces = [(x, min(x + INDEX_WORDS, b)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True) for x in range(a, max(a + 1, b - window + 1), step)]
        while pieces:
            sizes = np.cumsum([b - a for a, b in pieces])
            many = max(1, int(np.searchsorted(sizes, INDEX_WORDS, side="right")))
            own, pieces = np.array(pieces[:many]), pieces[many:]
            self.parts.append(self._part(keys, own[:, 0], own[:, 1]))

    def _part(self, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple:
        sizes = ends - starts
        to = np.cumsum(sizes) - sizes
        own = keys[np.arange(sizes.sum()) + np.repeat(starts - to, sizes)]
        alphabet, numbers = np.unique(own, return_inverse=True)
        text = np.zeros(len(own) + len(starts), dtype=np.int64)  # a separator ends every passage
        text[np.arange(len(own)) + np.repeat(np.arange(len(starts)), sizes)] = numbers.ravel() + 1
        grams = np.unique(_grams(own, to, to + sizes, min(ANCHOR_WORDS, self.window)))
        return alphabet, FMIndex(text, len(alphabet) + 1, self.window), grams

    def matched(self, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether the window that starts at each word occurs in the index."""
        out = np.zeros(len(keys), dtype=bool)
        for alphabet, index, grams in self.parts:
            place = np.minimum(np.searchsorted(alphabet, keys), len(alphabet) - 1)
            symbols = np.where(alphabet[place] == keys, place + 1, -1)
            possible = _possible(grams, keys, starts, ends, self.window) & ~out
            # A lane reaches window - 1 words into the next one, so that each window is decided where it starts.
            lanes = np.array([(x, min(x + LANE_WORDS + self.window - 1, b)) for a, b in _stretches(possible, self.window) for x in range(a, b - self.window + 1, LANE_WORDS)], dtype=np.int64).reshape(-1, 2)
            for at in range(0, len(lanes), LANES):
                own = lanes[at : at + LANES]
                for (a, b), reached in zip(own.tolist(), _reaching(index, symbols, own, self.window), strict=True):
                    out[a : min(a + LANE_WORDS, b)] |= reached[: min(LANE_WORDS, b - a)]
        return out

    def search(self, asked: pa.Table) -> pa.Table:
        """For each streamed passage: cuts, the word ranges (first, end, first, end, ...) of its document that the
        leader holds, and rest, the hashes of its windows that the leader does not hold."""
        keys, starts, ends = _symbols(asked)
        matched, window = self.matched(keys, starts, ends), self.window
        words = _words(asked)
        rolled = rolling(words, np.arange(max(0, len(words) - window + 1)), np.arange(window, max(window, len(words) + 1))).view(np.int64)
        cuts, rest = [], []
        for a, b, start in zip(starts.tolist(), ends.tolist(), asked.column("start").to_pylist(), strict=True):
            windows = matched[a : b - window + 1]
            hit = np.flatnonzero(windows)
            breaks = np.flatnonzero(np.diff(hit) > window) + 1
            cuts.append([x + start for part in np.split(hit, breaks) if len(part) for x in (int(part[0]), int(part[-1]) + window)] if hit.size else [])
            rest.append(rolled[a : b - window + 1][~windows])
        return pa.table([asked.column("doc_id"), asked.column("fp"), pa.array(cuts, pa.list_(pa.int32())), pa.array(rest, pa.list_(pa.int64()))], schema=FOUND)


@handing_back
def search_shards(batches: Iterable[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Rows of FOUND_SCHEMA from passages in order of shard, each shard's own ones before the streamed ones.

    Only a shard's own passages are kept, as an index; the others pass through a bounded number of words at a time.
    """
    shard, held, index = None, [], None
    for batch in batches:
        shards, streamed = batch.column("shard").to_numpy(), batch.column("streamed").to_numpy(zero_copy_only=False)
        sizes = batch.column("words").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        at = 0
        while at < batch.num_rows:
            if shards[at] != shard:
                shard, held, index = shards[at], [], None
            same = np.flatnonzero((shards[at:] != shard) | (streamed[at:] != streamed[at]))
            to = at + (int(same[0]) if same.size else batch.num_rows - at)
            if not streamed[at]:
                held.append(batch.slice(at, to - at))
            else:
                to = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:to]), ASKED_WORDS, side="right")))
                if held:
                    index, held = Index(pa.Table.from_batches(held), window), []
                if index is not None:
                    yield from index.search(pa.Table.from_batches([batch.slice(at, to - at)])).to_batches()
            at = to


def _grams(keys: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """By first word the hash of size words; 0 where they would leave the passage."""
    out = np.zeros(len(keys), dtype=np.uint64)
    at = np.arange(max(0, len(keys) - size + 1))
    out[: len(at)] = rolling(keys, at, at + size)
    out[np.repeat(ends - size, ends - starts) < np.arange(len(keys))] = 0
    return out


def _possible(there: np.ndarray, asked: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int) -> np.ndarray:
    """Whether all short runs of words in the window that starts here are among there, those of the index."""
    size = min(ANCHOR_WORDS, window)
    own = _grams(asked, starts, ends, size)
    place = np.minimum(np.searchsorted(there, own), len(there) - 1)
    missing = np.concatenate([[0], np.cumsum((there[place] != own) | (own == 0))])
    at = np.arange(len(asked))
    inside = at + window <= np.repeat(ends, ends - starts)
    last = np.minimum(at + window - size + 1, len(asked))
    return inside & (missing[last] == missing[at])


def _stretches(possible: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Word ranges of runs of consecutive possible windows."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], possible.astype(np.int8), [0]])))
    return [(a, b + window - 1) for a, b in edges.reshape(-1, 2).tolist()]


def _reaching(index: FMIndex, text: np.ndarray, lanes: np.ndarray, window: int) -> list[np.ndarray]:
    """For each lane whether its matching statistic reaches the window at each position."""
    sizes = lanes[:, 1] - lanes[:, 0]
    ends = np.cumsum(sizes)
    own = np.repeat(lanes[:, 0] - (ends - sizes), sizes) + np.arange(ends[-1])
    found = index.matching_statistics(text[own], ends - sizes, ends) >= window
    return np.split(found, ends[:-1])


def _search(docs: DataFrame, keys: DataFrame, window: int, whole: bool, tag: str) -> DataFrame:
    """Stored rows of FOUND_SCHEMA for keys (doc_id, key, windows): what each document shares with its keys' leaders.

    A key stands for as many words as windows name it, and some around them. Leaders with more to stream than a
    part of a shard are copied, and there are as many shards as the words to hold and to stream need.
    """
    spark = docs.sparkSession
    stands = F.col("windows") + F.lit(0 if whole else window // 2)
    first = keys.groupBy("key").agg(F.min("doc_id").alias("leader"), F.max("doc_id").alias("last"), F.sum(stands).alias("words"), F.min_by(stands, "doc_id").alias("own"))
    shared = store(first.where("leader < last").drop("last"), f"{tag}-keys")
    streams = shared.agg(F.sum(F.col("words") - F.col("own"))).first()[0] or 0
    at_once = max(8192, min(SHARD_WORDS, streams // (2 * width(spark))))
    by_leader = shared.groupBy("leader").agg(F.sum(F.col("words") - F.col("own")).alias("load"), F.sum("own").alias("own"))
    by_leader = store(by_leader.withColumn("copies", F.ceil(F.greatest(F.col("load"), F.lit(1)) / at_once).cast("int")), f"{tag}-leaders")
    holds = by_leader.agg(F.sum(F.col("own") * F.col("copies"))).first()[0] or 0
    shards = max(width(spark), math.ceil((streams + holds) / SHARD_WORDS))
    spread = store(shared.select("key", "leader").join(by_leader.where("copies > 1").select("leader", "copies"), "leader", "left").select("key", "leader", F.coalesce("copies", F.lit(1)).alias("copies")), f"{tag}-spread")
    led = keys.select("doc_id", "key").join(spread, "key").groupBy("doc_id").agg(F.collect_set(F.struct("key", "leader", "copies")).alias("led"))
    salts = F.when(F.col("streamed"), F.array("salt")).otherwise(F.sequence(F.lit(0), F.col("copies") - 1))
    passages = _passages(docs, led, window, whole).withColumn("salt", F.explode(salts))
    passages = passages.select(F.pmod(F.xxhash64("leader", "salt"), F.lit(shards)).alias("shard"), "leader", "streamed", "doc_id", "fp", "start", "words")
    dealt = passages.repartition(shards, "shard").sortWithinPartitions("shard", "streamed")
    out = store(dealt.mapInArrow(lambda batches: search_shards(batches, window), FOUND_SCHEMA), tag)
    for table in (shared, by_leader, spread):
        drop(table)
    return out


def _cut(docs: DataFrame, cuts: DataFrame, window: int) -> DataFrame:
    """docs with kept text, n_words and n_removed. cuts: (doc_id, cuts array<struct<fp, cuts>>)."""
    names = docs.columns

    @handing_back
    def keep(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"))
                gone = np.zeros(len(words.hashes) + 1, dtype=np.int64)
                for i, own in enumerate(part.column("_cuts").to_pylist()):
                    for entry in own or ():
                        if entry["fp"] == words.fp[i]:
                            at = np.array(entry["cuts"], dtype=np.int64) + words.first[i]
                            np.add.at(gone, at[::2], 1)
                            np.add.at(gone, at[1::2], -1)
                kept = np.cumsum(gone[:-1]) == 0
                owner = np.repeat(np.arange(len(words.n)), words.n)[kept]
                starts, sizes = words.starts[kept], (words.ends - words.starts)[kept]
                last = np.ones(len(owner), dtype=bool)
                last[:-1] = owner[1:] != owner[:-1]
                spaced = sizes + ~last
                ends = np.cumsum(spaced)
                text = np.full(int(ends[-1]) if len(ends) else 0, 32, dtype=np.uint8)
                to = np.repeat(ends - spaced - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                text[to] = words.body[np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
                bounds = np.concatenate([[0], np.cumsum(np.bincount(owner, weights=spaced, minlength=len(words.n)))]).astype(np.int32)
                out = pa.StringArray.from_buffers(len(words.n), pa.py_buffer(bounds.tobytes()), pa.py_buffer(text.tobytes()))
                removed = words.n - np.bincount(owner, minlength=len(words.n))
                columns = [out if name == "text" else part.column(name) for name in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(words.n), pa.array(removed)], names=[*names, "n_words", "n_removed"])

    # Rows without doc_id have no cuts; in the join they would all meet in one task.
    joined = docs.where("doc_id IS NOT NULL").join(cuts, "doc_id", "left").select(*names, "_cuts")
    rest = docs.where("doc_id IS NULL").withColumn("_cuts", F.lit(None).cast(cuts.schema["_cuts"].dataType))
    return joined.unionByName(rest).mapInArrow(keep, StructType([*docs.schema.fields, StructField("n_words", LongType()), StructField("n_removed", LongType())]))


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs (doc_id, text and any other columns) with what smaller doc_ids already have cut out of text.

    text becomes the kept words, joined by one space; n_words and n_removed are counts of words before and
    of words cut. Words are runs without ASCII white space. Windows are judged on the input. A null text
    has no words and becomes empty; a row without doc_id is kept whole and repeats nothing; rows with
    one doc_id don't repeat each other. Texts shorter than the window stay whole; very long ones are read whole,
    in passages. Other columns stay; columns named n_words and n_removed are replaced; an empty table gives
    an empty result.
    """
    docs = docs.drop("n_words", "n_removed", "_cuts").withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")})
    profiles = store(_profiles(docs, window), "profiles")
    usable = profiles.where((F.col("n") >= window) & F.col("doc_id").isNotNull())
    firsts = store(usable.groupBy("fp", "fp2", "n").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")).where("rows > 1").drop("rows"), "firsts")
    own = usable.join(firsts, ["fp", "fp2", "n"], "left").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)))
    named = own.where("NOT copy").select("doc_id", F.explode(F.arrays_zip("anchors", "windows")).alias("x"))
    keys = store(named.select("doc_id", F.col("x.anchors").alias("key"), F.col("x.windows").alias("windows")), "anchors")
    whole = store(own.where("copy").select("doc_id", "fp", F.array(F.lit(0), F.col("n").cast("int")).alias("cuts")), "copies")
    drop(profiles)
    drop(firsts)
    by_anchor = _search(docs, keys, window, False, "led")
    drop(keys)
    left = store(by_anchor.select("doc_id", F.explode("rest").alias("key"), F.lit(1).alias("windows")).distinct(), "windows")
    by_window = _search(docs, left, window, True, "rest")
    drop(left)
    cuts = whole.union(by_anchor.select("doc_id", "fp", "cuts")).union(by_window.select("doc_id", "fp", "cuts"))
    cuts = cuts.where(F.size("cuts") > 0).groupBy("doc_id").agg(F.collect_list(F.struct("fp", "cuts")).alias("_cuts"))
    return _cut(docs, cuts, window)
