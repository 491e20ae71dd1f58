"""Best-fit packing of token sequences by bin completion.

Documents become token ids, longer ones are cut into full pieces, and all pieces are packed into
sequences of one capacity. Pieces of one length are alike, so packing needs only how many pieces
have each length: a table with at most as many rows as the capacity, however large the corpus.
Bin completion works on that table: a descent by best fit gives the first incumbent. While it has more
sequences than a lower bound, a branch and bound goes over the undominated fillings around the longest piece
left, prunes by the waste that a packing with one sequence less may have, and keeps what it finds as the new
incumbent; it ends at the bound, or after a budget of nodes (None: at the least number). A filling is used
for as many sequences as the counts allow. Spark then numbers the pieces of each length and joins them to their places.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, bisect_right
from functools import cache
from itertools import chain, islice

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioscope.llm.flat_text import handing_back, slices
from folioscope.llm.storage import store

CAPACITY = 4096
END_ID = 1
CACHED_WORDS = 800_000
BUDGET = 100_000  # nodes of the search for fewer sequences than the first packing's
KEPT_WORDS = 100_000  # of these for the worker's next task: the first ones, as frequent words come early
ENDINGS = ".,;:!?*%$&#"  # a run of them after a word of letters is a pre-token of its own
WORD_END = "</w>"
DOTTED_I = "\u0130"  # lower-cased to a letter and a mark
PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
CONTROLS = re.compile("[\x1c-\x1f]")  # white space for str.split, but not for tokenizers


@cache
def _tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


class _Known(dict):
    """Ids by word: what is kept, and what the present texts need besides."""

    fresh: dict = {}

    def __missing__(self, word: str) -> bytes:
        return self.fresh[word]


class WordEncoder:
    """Token ids of texts, as little-endian unsigned 32-bit bytes.

    Only for tokenizers that lower-case, that mark a word's last token by WORD_END, and whose
    pre-tokenizer never crosses white space and keeps letters apart from marks: a text's ids are then its
    words' ids in order. The ids of up to CACHED_WORDS words are kept between texts of a task. The tokenizer looks for
    its added tokens before it lower-cases; texts that may hold one go to it whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.known = _tokenizer(path), _Known()
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(WORD_END)]] = True
        added = [re.escape(token.content) for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added) or "(?!)", re.IGNORECASE)

    def _plain(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters only, many in one call: each is one pre-token, whose last id ends a word."""
        out = []
        parts = [words[at : at + 512] for at in range(0, len(words), 512)]
        for found in self.tokenizer.encode_batch_fast([" ".join(part) for part in parts], add_special_tokens=False):
            ids = np.array(found.ids, dtype="<u4")
            raw, ends = ids.tobytes(), (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            out += [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        return out

    def _fresh(self, words: set[str]) -> dict[str, bytes]:
        known = self.known
        ended = {}
        for w in words:
            if w[-1] in ENDINGS and (letters := w.rstrip(ENDINGS)).isalpha() and DOTTED_I not in w:
                ended[w] = letters, w[len(letters) :]
        need = words.difference(ended) | {x for parts in ended.values() for x in parts if x not in known}
        plain = [w for w in need if w.isalpha() and DOTTED_I not in w]
        fresh = dict(zip(plain, self._plain(plain), strict=True))
        other = [w for w in need if w not in fresh]
        for w, x in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False), strict=True):
            fresh[w] = np.array(x.ids, dtype="<u4").tobytes()
        for w, parts in ended.items():
            fresh[w] = b"".join(fresh[x] if x in fresh else known[x] for x in parts)
        return fresh

    def forget(self) -> None:
        kept = list(islice(self.known.items(), KEPT_WORDS))
        self.known.clear()
        self.known.update(kept)
        self.known.fresh = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        known = self.known
        # The tokenizer lower-cases; doing so for A-Z beforehand leaves fewer different words.
        plain = [text.encode().lower().decode() for text in texts]
        odd = [i for i, text in enumerate(texts) if "<" in text and self.added.search(text)]
        for i in odd:
            plain[i] = ""
        split = [text.split(" ") if CONTROLS.search(text) else text.split() for text in plain]
        new = {w for w in set(chain.from_iterable(split)) if w and w not in known}
        known.fresh = {}
        fresh = self._fresh(new) | {"": b""}
        if len(known) < CACHED_WORDS:
            known.update(fresh)
        else:
            known.fresh = fresh
        out = [b"".join(map(known.__getitem__, words)) for words in split]
        for i in odd:
            out[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, dtype="<u4").tobytes()
        return out


@cache
def _encoder(path: str) -> WordEncoder:
    """One for each worker process, as its vocabulary takes a while to read."""
    return WordEncoder(path)


@handing_back
def _tokenized(batches, path: str, capacity: int, end_id: int):
    encoder, end = _encoder(path), np.array([end_id], dtype="<u4").tobytes()
    for batch in batches:
        for part in slices(batch, "text"):
            rows = []
            for doc_id, ids in zip(part.column("doc_id").to_pylist(), encoder.encode(part.column("text").to_pylist()), strict=True):
                ids += end
                for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                    own = ids[4 * start : 4 * (start + capacity)]
                    rows.append((doc_id, piece, start, len(own) // 4, zlib.crc32(own)))
            columns = [pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), PIECES.types, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, schema=PIECES)
    encoder.forget()  # the worker may go on with other jobs


def token_pieces(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the ids of each text plus end_id, cut after every capacity ids.

    A null text counts as empty and still has its end id. Ids don't depend on other documents.
    """
    path = tokenizer_path or public_tokenizers.path("word_bpe_49k.json")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(lambda batches: _tokenized(batches, path, capacity, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long")


def least_sequences(histogram: dict[int, int], capacity: int = CAPACITY) -> int:
    """A number of sequences below which no packing can go.

    For each threshold: pieces above capacity - threshold fill a sequence alone, pieces above half of it need one each,
    and what the other pieces down to the threshold need beyond the room beside those is shared.
    """
    lengths = np.array(sorted(k for k, v in histogram.items() if v > 0), dtype=np.int64)
    if not len(lengths):
        return 0
    counts = np.array([histogram[k] for k in lengths.tolist()], dtype=np.int64)
    number, total = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * lengths)])
    best = -(-int(total[-1]) // capacity)
    half = int(np.searchsorted(lengths, capacity // 2, side="right"))
    for threshold in [0, *lengths[lengths <= capacity // 2].tolist()]:
        alone, least = int(np.searchsorted(lengths, capacity - threshold, side="right")), int(np.searchsorted(lengths, threshold))
        apart = max(half, least)
        big, rest = int(number[-1] - number[apart]), int(total[apart] - total[least])
        room = int((number[alone] - number[apart]) * capacity - (total[alone] - total[apart])) if alone > apart else 0
        best = max(best, big + max(0, -(-(rest - room) // capacity)))
    return best


def fillings(lengths: list[int], counts: list[int], room: int, waste: int, most: int) -> tuple[list[tuple[int, tuple]], bool, int]:
    """Undominated fillings of room that leave at most waste of it, as (left, ((length, number), ...)), best fit first.

    lengths descend, counts go with them. A filling is dominated if another piece still fits, or if a piece or
    a pair of pieces in it could give way to one longer piece within what it leaves. Branches take long
    pieces first and end where all pieces left can't bring the waste to the bound; most ends the enumeration.
    """
    rising = [-x for x in lengths]
    ahead = np.cumsum((np.array(lengths + [0]) * np.array(counts + [0]))[::-1])[::-1].tolist()
    least = lengths[-1] if lengths else room + 1
    found: list[tuple[int, tuple]] = []
    steps = 64 * most

    def dominated(left: int, taken: tuple) -> bool:
        used = dict(taken)
        free = lambda low, high: any(counts[i] > used.get(lengths[i], 0) for i in range(bisect_left(rising, -high), bisect_right(rising, -low)))
        if left >= least and free(1, left):
            return True
        if left and any(free(x + 1, x + left) for x, _ in taken):
            return True
        pieces = [(x, 2 if n > 1 else 1) for x, n in taken]
        sums = {x + y for i, (x, n) in enumerate(pieces) for j, (y, _) in enumerate(pieces[i:]) if j or n > 1} if len(pieces) < 24 else set()
        return any(free(x, x + left) for x in sums)

    def branch(i: int, left: int, taken: tuple) -> bool:
        nonlocal steps
        steps -= 1
        if left <= waste and not dominated(left, taken):
            found.append((left, taken))
        if len(found) >= most or steps < 0:
            return False
        for j in range(max(i, bisect_left(rising, -left)), len(lengths)):
            if left - ahead[j] > waste:
                return True
            for number in range(min(counts[j], left // lengths[j]), 0, -1):
                if not branch(j + 1, left - number * lengths[j], (*taken, (lengths[j], number))):
                    return False
        return True

    whole = branch(0, room, ())
    found.sort(key=lambda x: (x[0], sum(n for _, n in x[1])))
    return found, whole, 64 * most - steps


class Packing:
    """Bin completion on a table of length to count, as a depth-first search with a waste bound.

    Each step fills the sequence of the longest piece left, by the undominated fillings that waste no more than a
    packing with one sequence less than the incumbent could; a filling is used as often as the counts allow, or once.
    The first descent takes the best fit everywhere and gives the first incumbent. The search ends when the
    incumbent meets the lower bound, when all is searched, or after budget nodes; ``gap`` is then what is left
    between the incumbent and the bound. Without a budget it goes on to the least number of sequences.
    """

    def __init__(self, histogram: dict[int, int], capacity: int = CAPACITY, budget: int | None = BUDGET):
        lengths = sorted((k for k, v in histogram.items() if v > 0), reverse=True)
        self.capacity, self.lengths, self.steps = capacity, lengths, 0
        self.total = sum(k * histogram[k] for k in lengths)
        self.bound = least_sequences(histogram, capacity)
        counts = [histogram[k] for k in lengths]
        self.best = self._descend(counts)
        self.count = sum(times for times, _ in self.best)
        width = 1
        while self.count > self.bound and (budget is None or self.steps < budget):
            width *= 4  # fillings tried in each step: a few near the best fit first, then more
            if self._search(counts, width, budget):
                break
        self.gap = self.count - self.bound

    def _left(self, counts: list[int]) -> tuple[list[int], list[int], list[int]]:
        at = [i for i, n in enumerate(counts) if n]
        return at, [self.lengths[i] for i in at], [counts[i] for i in at]

    def _descend(self, counts: list[int]) -> list:
        counts, packed = list(counts), []
        place = {x: i for i, x in enumerate(self.lengths)}
        start = 0
        while True:
            while start < len(counts) and not counts[start]:
                start += 1
            if start == len(counts):
                return packed
            longest, counts[start] = self.lengths[start], counts[start] - 1
            room = self.capacity - longest
            at = [i for i in range(bisect_left(self.lengths, -room, lo=start, key=lambda x: -x), len(counts)) if counts[i]]
            filling = complete_bin([self.lengths[i] for i in at], [counts[i] for i in at], room)
            counts[start] += 1
            pattern = {longest: 1}
            for length, number in filling:
                pattern[length] = pattern.get(length, 0) + number
            times = min(counts[place[k]] // n for k, n in pattern.items())
            for k, n in pattern.items():
                counts[place[k]] -= n * times
            packed.append((times, list(pattern.items())))

    def _search(self, counts: list[int], width: int, budget: int | None) -> bool:
        """Whether all packings were ruled out, or the bound was met; otherwise width or budget ended the search."""
        place = {x: i for i, x in enumerate(self.lengths)}
        whole = True

        def options(now: list[int], allowed: int) -> list[tuple[int, int, dict]]:
            nonlocal whole
            start = next(i for i, n in enumerate(now) if n)
            longest = self.lengths[start]
            now = now.copy()
            now[start] -= 1
            room = self.capacity - longest
            at = [i for i in range(start, len(now)) if now[i] and self.lengths[i] <= room]
            found, all_, nodes = fillings([self.lengths[i] for i in at], [now[i] for i in at], room, allowed, 8 * width)
            whole &= all_ and len(found) <= width
            self.steps += nodes + len(now) // 64
            now[start] += 1
            out = []
            for waste, filling in found[:width]:
                pattern = {longest: 1}
                for length, number in filling:
                    pattern[length] = pattern.get(length, 0) + number
                times = min(min(now[place[k]] // n for k, n in pattern.items()), allowed // waste if waste else 1 << 60)
                out.append((waste * times, times, pattern))
                if times > 1:
                    out.append((waste, 1, pattern))
            return out

        limit = self.steps + 20_000 * width if budget is None else min(budget, self.steps + max(1000, budget // 4))
        allowed = (self.count - 1) * self.capacity - self.total
        stack = [(counts, allowed, iter(options(counts, allowed)), [])]
        while stack:
            if self.steps >= limit:
                return False
            now, allowed, branches, packed = stack[-1]
            step = next(branches, None)
            if step is None:
                stack.pop()
                continue
            self.steps += 1
            waste, times, pattern = step
            after = now.copy()
            for k, n in pattern.items():
                after[place[k]] -= n * times
            path = [*packed, (times, list(pattern.items()))]
            if not any(after):
                self.best, self.count = path, sum(t for t, _ in path)
                if self.count <= self.bound:
                    return True
                return self._search(counts, width, budget)
            stack.append((after, allowed - waste, iter(options(after, allowed - waste)), path))
        return whole


def complete_bin(lengths: list[int], counts: list[int], room: int, budget: int = 2000) -> list[tuple[int, int]]:
    """The fullest filling of room that budget nodes find, as (length, number) pairs: the best-fit filling of a descent.

    lengths descend, counts go with them. Branches take the longest fitting piece first, so the first leaf is
    the first incumbent. A branch is pruned when all pieces left can't bring its waste below the incumbent's.
    """
    rising = [-x for x in lengths]
    ahead = np.cumsum((np.array(lengths + [0]) * np.array(counts + [0]))[::-1])[::-1].tolist()
    best: list = [room + 1, []]
    nodes = 0

    def branch(i: int, left: int, taken: list[tuple[int, int]]) -> bool:
        nonlocal nodes
        nodes += 1
        if left < best[0]:
            best[:] = [left, taken]
        if not best[0] or nodes > budget:
            return True
        for j in range(max(i, bisect_left(rising, -left)), len(lengths)):
            if left - ahead[j] >= best[0]:
                return False
            for number in range(min(counts[j], left // lengths[j]), 0, -1):
                if branch(j + 1, left - number * lengths[j], [*taken, (lengths[j], number)]):
                    return True
        return False

    branch(0, room, [])
    return best[1]


def pack_lengths(histogram: dict[int, int], capacity: int = CAPACITY, budget: int | None = BUDGET) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(number of sequences, [(length, pieces in each)])] for a table of length to count, by bin completion."""
    return Packing(histogram, capacity, budget).best


def _slots(packed: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, np.ndarray]:
    """By length the rows (first rank, first sequence, pieces in each sequence, offset of the first)."""
    slots: dict[int, list] = {}
    used: dict[int, int] = {}
    sequence = 0
    for times, pattern in packed:
        offset = 0
        for length, number in pattern:
            first = used.get(length, 0)
            slots.setdefault(length, []).append((first, sequence, number, offset))
            used[length] = first + number * times
            offset += length * number
        sequence += times
    return {length: np.array(rows, dtype=np.int64) for length, rows in slots.items()}


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, budget: int | None = BUDGET) -> DataFrame:
    """Adds sequence_id and offset to pieces (column length, 1 to capacity).

    Pieces of equal length are interchangeable; which of them goes where is decided by a distributed
    numbering, with no task that sorts all pieces of one length. An empty table gives an empty result.
    """
    kept = pieces.drop("sequence_id", "offset", "_part", "_row", "_before", "_rank")
    numbered = store(kept.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), "pieces")
    by_part = numbered.groupBy("length", "_part").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    by_part = by_part.withColumn("_before", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n")
    histogram = {r.length: r["count"] for r in numbered.groupBy("length").count().collect()}  # at most capacity rows
    slots = _slots(pack_lengths(histogram, capacity, budget))

    within = Window.partitionBy("length", "_part").orderBy("_row")
    ranked = numbered.join(by_part, ["length", "_part"]).withColumn("_rank", F.col("_before") + F.row_number().over(within) - 1)

    def place(batches):
        for pdf in batches:
            sequence, offset = np.empty(len(pdf), dtype=np.int64), np.empty(len(pdf), dtype=np.int64)
            for length, rows in pdf.groupby("length").indices.items():
                own = slots[length]
                rank = pdf["_rank"].to_numpy()[rows]
                first, start, number, at = own[np.searchsorted(own[:, 0], rank, side="right") - 1].T
                sequence[rows] = start + (rank - first) // number
                offset[rows] = at + (rank - first) % number * length
            yield pdf.drop(columns="_rank").assign(sequence_id=sequence, offset=offset)

    out = ranked.select(*kept.columns, "_rank")
    schema = kept.schema.simpleString()[7:-1]
    return out.mapInPandas(place, f"{schema},sequence_id:bigint,offset:bigint")


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, budget: int | None = BUDGET) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every document tokenized, cut and packed.

    Nulls: a null text is an empty document; a null doc_id is kept. Equal documents and repeated rows are
    packed one by one. Very long texts are encoded whole and cut. Other columns, whatever their names, don't
    matter. An empty table gives an empty result.
    """
    return pack_pieces(token_pieces(docs, tokenizer_path, capacity, end_id), capacity, budget)
