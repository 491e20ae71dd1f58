"""SentencePiece encoding and decoding of whole texts by suffix-array matching.

A text is cut where no piece of the vocabulary crosses, before each space that follows another
character. The different cuts of a batch are concatenated and indexed by a suffix array; every piece is
binary-searched for its range of occurrences; the occurrences become edges, sorted by where they
end, and are relaxed in that order. A byte-pair model's answer is the one path in which each
piece and its neighbour stay apart under the model's merges, so an edge is taken where it and the last
piece before it are such a pair. The result is what the model's own merging gives.

Only for models with byte fallback, a dummy prefix and no other normalization, whose pieces hold the
space mark at their start alone (or nothing else).
"""

from __future__ import annotations

import re
from functools import cache
from heapq import heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from folioscope.llm.flat_text import slices
from folioscope.llm.fm_index import suffix_array

SPACE = "▁"
CUT = re.compile(f"{SPACE}+[^{SPACE}]*")
CACHED_CUTS = 200_000
CACHED_LENGTH = 64  # longer cuts are not kept between batches
PART_BYTES = 2_000_000  # of text encoded at a time
INDEXED_CHARS = 700_000  # of cuts in one suffix array, unless one cut is longer
NEVER = np.iinfo(np.int64).max


class Merges:
    """The merge rules of a byte-pair model: tokens are its pieces, then single characters that are no piece."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.vocab_size())]
        plain = [i for i in range(len(pieces)) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.pieces = pieces
        self.byte_ids = [i for i in range(len(pieces)) if model.is_byte(i)]
        ordered = sorted(plain, key=lambda i: (-model.get_score(i), i))
        self.order = {pieces[i]: n for n, i in enumerate(ordered)}
        self.scores = {pieces[i]: model.get_score(i) for i in plain}
        self.ids = {pieces[i]: i for i in plain}
        chars = sorted({c for i in plain for c in pieces[i]} - self.ids.keys())
        self.tokens = self.ids | {c: len(pieces) + n for n, c in enumerate(chars)}
        count = len(pieces) + len(chars)
        self.rank, self.left, self.right = np.full(count, -1, dtype=np.int64), np.arange(count), np.arange(count)
        self.length = np.ones(count, dtype=np.int64)
        self.whole: list[str] = []  # pieces that their own merging gives back
        pairs: dict[tuple[int, int], int] = {}
        for piece in ordered:
            text = pieces[piece]
            if len(text) < 2 or not text.strip(SPACE):
                continue
            parts = self.merge(text, stop=True)
            if len(parts) == 2 and all(p in self.tokens for p in parts):
                self.whole.append(text)
                self.rank[piece], self.length[piece] = self.order[text], len(text)
                self.left[piece], self.right[piece] = self.tokens[parts[0]], self.tokens[parts[1]]
        good = set(self.whole)
        for text in self.whole:
            for at in range(1, len(text)):
                a, b = text[:at], text[at:]
                if (len(a) == 1 or a in good) and (len(b) == 1 or b in good):
                    pairs[(self.tokens[a], self.tokens[b])] = self.order[text]
        self.size = count
        keys = np.array([a * (1 << 32) + b for a, b in pairs], dtype=np.int64)
        by_key = np.argsort(keys)
        self.keys, self.ranks = keys[by_key], np.array(list(pairs.values()), dtype=np.int64)[by_key]
        width = max(map(len, self.whole))
        self.table = np.zeros((len(self.whole), width), dtype=np.int32)
        for row, text in zip(self.table, self.whole, strict=True):
            row[: len(text)] = [ord(c) for c in text]
        self.numbers = np.array([self.ids[text] for text in self.whole], dtype=np.int64)
        self.spelled = [self._bytes(i) for i in range(len(pieces))]

    def _bytes(self, i: int) -> bytes:
        if i in self.byte_ids:
            return bytes([self.byte_ids.index(i)])
        return self.pieces[i].replace(SPACE, " ").encode() if self.pieces[i] in self.ids else b""

    def merge(self, text: str, stop: bool = False) -> list[str]:
        """Plain merging, best score first and leftmost among equals; with stop the last two parts stay apart.

        Pairs wait in a heap, parts are linked to their neighbours, so the time is n log n.
        """
        parts: list[str | None] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, str]] = []

        def wait(i: int) -> None:
            if i >= 0 and after[i] < len(parts):
                whole = parts[i] + parts[after[i]]
                if whole in self.scores:
                    heappush(heap, (-self.scores[whole], i, whole))

        for i in range(len(parts) - 1):
            wait(i)
        left = len(parts)
        while heap and left > (2 if stop else 1):
            _, i, whole = heappop(heap)
            if parts[i] is None or after[i] >= len(parts) or parts[i] + parts[after[i]] != whole:
                continue
            j = after[i]
            parts[i], parts[j], after[i] = whole, None, after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            left -= 1
            wait(before[i])
            wait(i)
        return [p for p in parts if p is not None]

    def spell(self, part: str) -> list[int]:
        """Ids of a piece, or of the bytes of a character that is none."""
        return [self.ids[part]] if part in self.ids else [self.byte_ids[b] for b in part.encode()]

    def apart(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether merging leaves each pair of neighbouring tokens as it is.

        Merges are undone from the latest on; a merge over the boundary that came earlier would have won.
        """
        out = np.ones(len(first), dtype=bool)
        live = np.arange(len(first))
        a, b, limit = first.copy(), second.copy(), np.full(len(first), NEVER)
        while live.size:
            key = a * (1 << 32) + b
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            over = np.where(self.keys[place] == key, self.ranks[place], NEVER)
            broken = over < limit
            out[live[broken]] = False
            rank_a, rank_b = self.rank[np.minimum(a, self.size - 1)], self.rank[np.minimum(b, self.size - 1)]
            rank_a, rank_b = np.where(a < self.size, rank_a, -1), np.where(b < self.size, rank_b, -1)
            go = ~broken & ((rank_a >= 0) | (rank_b >= 0))
            live, a, b, rank_a, rank_b = live[go], a[go], b[go], rank_a[go], rank_b[go]
            first_side = rank_a > rank_b
            limit = np.where(first_side, rank_a, rank_b + 1)
            safe_a, safe_b = np.minimum(a, self.size - 1), np.minimum(b, self.size - 1)
            a, b = np.where(first_side, self.right[safe_a], a), np.where(first_side, b, self.left[safe_b])
        return out


@cache
def merges(path: str) -> Merges:
    return Merges(path)


def piece_ranges(text: np.ndarray, order: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of table (0-padded code points) the range of suffixes that begin with it, by binary search."""
    lengths = (table > 0).sum(axis=1)

    def bound(after: bool) -> np.ndarray:
        low, high = np.zeros(len(table), dtype=np.int64), np.full(len(table), len(order), dtype=np.int64)
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) // 2
            start = order[mid]
            sign = np.zeros(len(open_), dtype=np.int8)
            for depth in range(table.shape[1]):
                todo = np.flatnonzero((sign == 0) & (depth < lengths[open_]))
                if not todo.size:
                    break
                at = start[todo] + depth
                here = np.where(at < len(text), text[np.minimum(at, len(text) - 1)], -1)
                sign[todo] = np.sign(here - table[open_[todo], depth])
            less = (sign < 0) | ((sign == 0) & after)
            low[open_[less]], high[open_[~less]] = mid[less] + 1, mid[~less]
        return low

    return bound(False), bound(True)


class SuffixEncoder:
    """Ids of texts, as little-endian signed 32-bit bytes; keeps up to CACHED_CUTS cuts between batches."""

    def __init__(self, path: str):
        self.rules = merges(path)
        self.known: dict[str, bytes] = {}

    def _single(self, cuts: list[str]) -> list[bytes]:
        """Ids of cuts that hold the space mark once, at their start."""
        rules = self.rules
        lengths = np.array([len(c) for c in cuts], dtype=np.int64)
        points = np.frombuffer("".join(cuts).encode("utf-32-le", "surrogatepass"), dtype=np.int32)
        starts = np.cumsum(lengths + 1) - lengths - 1
        text = np.zeros(len(points) + len(cuts), dtype=np.int32)
        inner = np.arange(len(points)) + np.repeat(np.arange(len(cuts)), lengths)
        text[inner] = points
        # Suffixes need to be in order as far as the longest piece only.
        order = suffix_array(text, rules.table.shape[1])
        low, high = piece_ranges(text, order, rules.table)
        times = high - low
        at = order.astype(np.int32)[np.repeat(low - np.cumsum(times) + times, times) + np.arange(times.sum())]
        token = np.repeat(rules.numbers.astype(np.int32), times)
        del order

        chars = np.flatnonzero(np.bincount(points))
        names = [chr(c) for c in chars]
        codes = np.array([rules.tokens.get(c, rules.size + n) for n, c in enumerate(names)], dtype=np.int64)
        spelled = {int(code): rules.spell(name) for code, name in zip(codes, names, strict=True) if name not in rules.ids}
        at, token = np.concatenate([inner.astype(np.int32), at]), np.concatenate([codes.astype(np.int32)[np.searchsorted(chars, points)], token])
        size = np.where(token < rules.size, rules.length.astype(np.int32)[np.minimum(token, rules.size - 1)], np.int32(1))
        begins = np.repeat(starts.astype(np.int32), lengths + 1)
        ends = at + size - begins[at]
        by_end = np.argsort(ends, kind="stable")
        at, token, size, ends = at[by_end], token[by_end], size[by_end], ends[by_end]
        del by_end
        head = at == begins[at]
        last = np.full(len(text), -1, dtype=np.int64)
        edges = np.searchsorted(ends, np.arange(1, int(lengths.max()) + 2))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            fits = head[a:b].copy()
            rest = np.flatnonzero(~fits)
            fits[rest] = rules.apart(last[at[a:b][rest] - 1], token[a:b][rest].astype(np.int64))
            taken = a + np.flatnonzero(fits)
            last[at[taken] + size[taken] - 1] = token[taken]

        place, owner, found = starts + lengths - 1, np.arange(len(cuts)), []
        while len(owner):
            now = last[place]
            found.append((owner, now))
            place = place - np.where(now < rules.size, rules.length[np.minimum(now, rules.size - 1)], 1)
            on = place >= starts[owner]
            place, owner = place[on], owner[on]
        step = np.repeat(np.arange(len(found)), [len(o) for o, _ in found])
        owner, token = (np.concatenate(x) for x in zip(*found, strict=True))
        forward = np.lexsort((-step, owner))
        owner, token = owner[forward], token[forward]
        odd = np.isin(token, np.array(list(spelled), dtype=np.int64))
        wide = np.ones(len(token), dtype=np.int64)
        wide[odd] = [len(spelled[t]) for t in token[odd].tolist()]
        ids = np.repeat(token, wide).astype("<i4")
        if odd.any():
            ids[np.repeat(odd, wide)] = np.concatenate([spelled[t] for t in token[odd].tolist()])
        raw, cutting = ids.tobytes(), (4 * np.cumsum(np.bincount(owner, weights=wide, minlength=len(cuts)))).astype(np.int64).tolist()
        return [raw[a:b] for a, b in zip([0, *cutting[:-1]], cutting, strict=True)]

    def _several(self, cut: str) -> bytes:
        """Ids of a cut that begins with several space marks: their pieces tie in score, so they are merged plainly."""
        return np.array([i for part in self.rules.merge(cut) for i in self.rules.spell(part)], dtype="<i4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        known, split = self.known, []
        for text in texts:
            if "  " in text or SPACE in text or text[:1] == " " or text[-1:] == " ":
                split.append([c[1:] if c[1:2] != SPACE else c for c in CUT.findall(SPACE + text.replace(" ", SPACE))])
            else:
                split.append(text.split(" ") if text else [])
        new = list({c for cuts in split for c in cuts} - known.keys())
        single = [c for c in new if not c.startswith(SPACE)]
        fresh: dict[str, bytes] = {}
        sizes = np.cumsum([len(c) + 1 for c in single])
        at = 0
        while at < len(single):
            to = max(at + 1, int(np.searchsorted(sizes, (int(sizes[at - 1]) if at else 0) + INDEXED_CHARS, side="right")))
            fresh.update(zip(single[at:to], self._single([SPACE + c for c in single[at:to]]), strict=True))
            at = to
        fresh |= {c: self._several(c) for c in new if c.startswith(SPACE)}
        if len(known) + len(fresh) > CACHED_CUTS:
            known = fresh | {c: known[c] for cuts in split for c in cuts if c in known}
        else:
            known.update((c, ids) for c, ids in fresh.items() if len(c) <= CACHED_LENGTH)
            long = {c: ids for c, ids in fresh.items() if len(c) > CACHED_LENGTH}
            known = known | long if long else known
        return [b"".join(map(known.__getitem__, cuts)) for cuts in split]


@cache
def _encoder(path: str) -> SuffixEncoder:
    """One for each worker process, so that the cuts it knows serve all of its tasks."""
    return SuffixEncoder(path)


def _model(path: str | None) -> str:
    return path or public_tokenizers.path("piece_bpe_32k.model")


def encode_texts(docs: DataFrame, text: str = "text", model_path: str | None = None) -> DataFrame:
    """Adds ids, array<int>, to docs: the SentencePiece ids of each whole text; a null text has null ids.

    An empty text has no ids. Equal texts and repeated rows get equal ids; very long texts are taken whole, in
    time about proportional to their length; other columns stay; a column named ids is replaced; an empty table
    gives an empty result.
    """
    path, kept = _model(model_path), docs.drop("ids")
    place = kept.columns.index(text)

    def encode(batches):
        encoder = _encoder(path)
        for batch in batches:
            for part in slices(batch, text, PART_BYTES):
                texts = part.column(place).to_pylist()
                found = encoder.encode([t or "" for t in texts])
                bounds = np.concatenate([[0], np.cumsum([len(x) // 4 for x in found])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.frombuffer(b"".join(found), dtype="<i4")), mask=pa.array([t is None for t in texts]))
                yield pa.RecordBatch.from_arrays([*part.columns, ids], names=[*part.schema.names, "ids"])

    return kept.mapInArrow(encode, StructType([*kept.schema.fields, StructField("ids", ArrayType(IntegerType()))]))


def decode_ids(rows: DataFrame, ids: str = "ids", model_path: str | None = None) -> DataFrame:
    """Adds decoded, the text of each list of ids, to rows; null ids give a null text.

    Encoding and decoding give a text back, with each space mark of the text as a space. Bytes that form no
    character become the replacement character.
    """
    path, kept = _model(model_path), rows.drop("decoded")
    place = kept.columns.index(ids)

    def decode(batches):
        spelled = merges(path).spelled
        for batch in batches:
            out = []
            lists = batch.column(place)
            values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            for i, there in enumerate(lists.is_valid().to_pylist()):
                own = values[offsets[i] : offsets[i + 1]].tolist()
                text = b"".join([spelled[x] for x in own])
                out.append((text[1:] if text[:1] == b" " else text).decode("utf-8", "replace") if there else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "decoded"])

    return kept.mapInArrow(decode, StructType([*kept.schema.fields, StructField("decoded", StringType())]))


def round_trip(docs: DataFrame) -> DataFrame:
    """(doc_id, n_ids, ids_crc32, round_trip): digests of the encoding, and whether decoding gives the text back.

    A null text counts as empty; every row gives one row, null and repeated doc_ids included; other columns don't
    matter; an empty table gives an empty result.
    """
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    both = decode_ids(encode_texts(texts))
    joined = F.array_join("ids", ",")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.crc32(joined.cast("binary")).alias("ids_crc32"), (F.col("decoded") == F.translate("text", SPACE, " ")).alias("round_trip"))
