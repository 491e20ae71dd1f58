"""Tokenizing and packing against the tokenizers' own libraries."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from folioscope.llm import packing
from folioscope.llm.packing import Packing, WordEncoder, complete_bin, least_sequences, pack_documents, pack_lengths
from folioscope.llm.suffix_tokens import SuffixEncoder, decode_ids, encode_texts, round_trip

ODD = [
    None, "", " ", "  ", "a", "a  b", "  lead", "trail  ", "é é ﬁ ①Å 日本 \u0001x", "▁x", "x▁y", "　x", "\r\n\r x", "x\ty\nz\n\nq   w", "日本語のテキスト、長い文。" * 30,
    "https://ex.com/a_b?c=d&e=%20 1,234.56", "😀😀 👍🏽 x‍y", "a" * 50, "   if (x) {\n        return 1;\n    }\n", "the" * 3000, "it's İstanbul, don't.", "a\x1cb x², 12,5 Ⅷ ǅ!?",
]


def test_sentencepiece(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)], "doc_id long, text string, ids string")
    both = decode_ids(encode_texts(df)).collect()
    for row in both:
        assert row.ids == (None if row.text is None else model.encode(row.text))
        assert row.decoded == (None if row.text is None else row.text.replace("▁", " "))


def test_packing(spark):
    rng = random.Random(1)
    texts = [*ODD, *(" ".join(rng.choice(["tree", "graph", "of", "x,"]) for _ in range(rng.randrange(0, 90))) for _ in range(60))]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    rows = pack_documents(df, capacity=64).collect()
    pieces, bins = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        bins[r.sequence_id].append((r.offset, r.length))
    for i, text in enumerate(texts):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        cut = [ids[a : a + 64] for a in range(0, len(ids), 64)]
        assert sorted(pieces[i]) == [(n, 64 * n, len(c), zlib.crc32(np.array(c, dtype="<u4").tobytes())) for n, c in enumerate(cut)]
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r.length for r in rows)
    assert len(bins) <= 1.02 * -(-total // 64) + 1
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_bin_completion(seed):
    rng = random.Random(seed)
    lengths = sorted({rng.randrange(1, 30) for _ in range(6)}, reverse=True)
    counts = [rng.randrange(1, 3) for _ in lengths]
    room = rng.randrange(1, 60)
    filling = complete_bin(lengths, counts, room)
    sums = {0}
    for length, count in zip(lengths, counts, strict=True):
        sums |= {s + length * n for s in sums for n in range(count + 1)}
    assert sum(x * n for x, n in filling) == max(s for s in sums if s <= room)


def test_pack_lengths_uses_every_piece():
    histogram = {1: 5, 7: 3, 10: 2, 4: 9}
    used = collections.Counter()
    for times, pattern in pack_lengths(histogram, 10):
        assert sum(length * n for length, n in pattern) <= 10
        for length, n in pattern:
            used[length] += n * times
    assert used == histogram


def test_added_tokens():
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, encoder = Tokenizer.from_file(path), WordEncoder(path)
    for text in ["a <|ENDOFTEXT|> b", "a <|endoftext|> b", "x<|endoftext|>Y", "<|StartOfText|>", "Plain <| b"]:
        assert np.frombuffer(encoder.encode([text])[0], dtype="<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(4))
def test_completion_meets_the_bound(seed):
    rng = random.Random(seed)
    histogram = collections.Counter()
    for _ in range(18):  # triples that fill sequences exactly
        a, b = rng.randrange(1100, 1700), rng.randrange(900, 1600)
        histogram.update([a, b, 4096 - a - b])
    packing = Packing(histogram, 4096, None)
    assert (packing.count, packing.gap) == (18, 0)
    used = collections.Counter()
    for times, pattern in packing.best:
        assert sum(length * number for length, number in pattern) <= 4096
        used.update({length: number * times for length, number in pattern})
    assert used == histogram


def test_search_improves_on_best_fit():
    histogram = {6: 2, 5: 2, 4: 2, 3: 2, 2: 1}  # two sequences' worth of waste is easily made here
    packing = Packing(histogram, 10, None)
    assert packing.count == least_sequences(histogram, 10) == 4


def test_long_cuts():
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    encoder = SuffixEncoder(public_tokenizers.path("piece_bpe_32k.model"))
    for text in ["ab   " + "xyzé" * 5000 + "   a  b ", "q" * 20000]:
        assert np.frombuffer(encoder.encode([text])[0], dtype="<i4").tolist() == model.encode(text)


def test_empty_tables_and_other_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, piece string, _rank string")
    assert pack_documents(empty).count() == 0
    assert encode_texts(empty).count() == 0 and round_trip(empty).count() == 0
    one = spark.createDataFrame([(None, None, "x", "y"), (1, "a b", "x", "y"), (1, "a b", "x", "y")], empty.schema)
    assert sorted((r.doc_id or 0, r.length) for r in pack_documents(one).collect()) == [(0, 1), (1, 3), (1, 3)]


def test_runs_of_marks_and_words_kept_for_the_next_task(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, encoder = Tokenizer.from_file(path), WordEncoder(path)
    texts = ["Tree*** graph.,! é%%% it's.* a*b* x²# İa** ... tree*** 1***", "graph tree** q"]
    ids = [tokenizer.encode(text, add_special_tokens=False).ids for text in texts]
    read = lambda: [np.frombuffer(x, dtype="<u4").tolist() for x in encoder.encode(texts)]
    assert read() == ids
    monkeypatch.setattr(packing, "KEPT_WORDS", 3)
    encoder.forget()
    assert len(encoder.known) == 3 and read() == ids
    monkeypatch.setattr(packing, "CACHED_WORDS", 0)
    encoder.known.clear()
    assert read() == ids and not encoder.known
