"""Language identification by error-correcting output codes.

Every language has a codeword of bits. For each bit a binary n-gram classifier (naive Bayes over hashed
byte trigrams) tells the languages with that bit set from the others. A text's margins for all bits
are compared with each codeword by logistic loss, weighted by how well each bit did for that language
on a sample of training texts; the codeword with the least loss wins, and a close second flags the
text as ambiguous.

The trigram sums come from all training rows and have one row for each language and bucket, so the
model's size doesn't depend on the corpus. The bit weights come from ``weight_rows`` training rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from folioscope.llm.flat_text import flat, handing_back, slices
from folioscope.llm.storage import small_batches

BUCKETS = 1 << 15
SCALE = 8.0
UNDETERMINED = "und"
#: Bytes to what n-grams see: letters in lower case, any other ASCII byte a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def trigram_buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, ends): the bucket of the trigram at each byte of all texts, and where each text's end.

    Every text is framed by spaces, so that any text with a byte has trigrams of its own only.
    """
    body, offsets = flat(texts)
    n = len(offsets) - 1
    framed = np.full(len(body) + 2 * n, 32, dtype=np.uint32)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    framed[np.arange(len(body)) + 2 * owner + 1] = np.frombuffer(body.tobytes().translate(FOLD), dtype=np.uint8)
    mix = framed[:-2] * np.uint32(0x9E3779B1) + framed[1:-1] * np.uint32(0x85EBCA77) + framed[2:] * np.uint32(0xC2B2AE3D) if len(framed) > 2 else framed[:0]
    buckets = ((mix ^ (mix >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(17)
    ends = offsets[1:] + 2 * np.arange(1, n + 1) - 2
    return buckets, ends


def codewords(languages: int, seed: int = 5) -> np.ndarray:
    """languages x bits of -1 and 1: the exhaustive code for up to 5 languages, else the random code
    of 12 bits for each doubling with the greatest least distance among 200 drawn."""
    if languages <= 1:
        return np.ones((languages, 1))
    if languages <= 5:
        rows = [[1] + [1 if number >> i & 1 else -1 for i in range(languages - 1)] for number in range(2 ** (languages - 1) - 1)]
        return np.array(rows, dtype=np.float64).T
    rng = np.random.default_rng(seed)
    bits = int(np.ceil(12 * np.log2(languages)))
    best, most = None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], size=(languages, bits))
        apart = ((bits - code @ code.T) / 2 + bits * np.eye(languages)).min()
        balanced = np.abs(code.sum(axis=0)).max() < languages
        if balanced and apart > most:
            best, most = code, apart
    return best


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets x bits
    trust: np.ndarray  # languages x bits, rows sum to 1

    def margins(self, texts: pa.Array) -> np.ndarray:
        """texts x bits: mean log-odds of the text's trigrams, scaled."""
        buckets, ends = trigram_buckets(texts)
        starts = np.concatenate([[0], ends[:-1] + 2])
        out = np.zeros((len(texts), self.weights.shape[1]))
        full = ends > starts
        if full.any():
            cuts = np.column_stack([starts, ends])[full].ravel()
            cuts = cuts[:-1] if cuts[-1] == len(buckets) else cuts
            # One bit after the other: four bytes for each byte of text and not four for each bit of it, however long a text is.
            for bit in range(out.shape[1]):
                sums = np.add.reduceat(np.take(self.weights[:, bit], buckets), cuts)[::2]
                out[full, bit] = sums / (ends - starts)[full] * SCALE
        return out

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(best language's number, its score from 0 to 1, whether the second is close)."""
        loss = np.stack([(np.logaddexp(0, -margins * word) * trust).sum(axis=1) for word, trust in zip(self.code, self.trust, strict=True)], axis=1)
        odds = np.exp(-4 * (loss - loss.min(axis=1, keepdims=True)))
        odds /= odds.sum(axis=1, keepdims=True)
        best = loss.argmin(axis=1)
        top = np.sort(odds, axis=1)[:, ::-1]
        close = top[:, 0] - top[:, 1] < 0.1 if top.shape[1] > 1 else np.zeros(len(top), dtype=bool)
        return best, top[:, 0], close


def fit(training: DataFrame, weight_rows: int = 2048) -> LanguageModel:
    """training: text and lang; rows where either is null, or the text has no letter, teach nothing.

    Every text counts the same, whatever its length; very long ones are read whole. Without any usable row, as of
    an empty table, the model knows no language. weight_rows bounds the rows that the bit weights come from.
    """
    usable = training.select("text", "lang").where(F.col("lang").isNotNull() & has_letter(F.col("text")))

    @handing_back
    def sums(batches):
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                langs = part.column("lang").to_pylist()
                buckets, ends = trigram_buckets(part.column("text"))
                start = 0
                for lang, end in zip(langs, ends, strict=True):
                    if end > start:
                        kept = found.setdefault(lang, np.zeros(BUCKETS))
                        seen, times = np.unique(buckets[start:end], return_counts=True)
                        kept[seen] += times / (end - start)
                    start = end + 2
        for lang, kept in found.items():
            seen = np.flatnonzero(kept)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(seen), pa.string()), "bucket": pa.array(seen.astype(np.int32)), "share": pa.array(kept[seen])})

    shares = usable.mapInArrow(sums, "lang string, bucket int, share double").groupBy("lang", "bucket").agg(F.sum("share").alias("share"))
    with small_batches(training.sparkSession):
        rows = shares.toArrow()  # at most one row for each language and bucket
    languages = sorted(set(rows.column("lang").to_pylist()))
    at = {lang: i for i, lang in enumerate(languages)}
    table = np.full((len(languages), BUCKETS), 1e-4)
    table[[at[x] for x in rows.column("lang").to_pylist()], rows.column("bucket").to_numpy()] += rows.column("share").to_numpy()
    table /= table.sum(axis=1, keepdims=True)
    code = codewords(len(languages))
    weights = np.zeros((BUCKETS, max(code.shape[1], 1)), dtype=np.float32)
    for bit in range(code.shape[1] if len(languages) > 1 else 0):
        for side in (1, -1):
            weights[:, bit] += side * np.log(table[code[:, bit] == side].mean(axis=0))
    model = LanguageModel(languages, code, weights, np.full(code.shape, 1 / max(code.shape[1], 1)))
    if len(languages) > 1:
        model.trust = _trust(model, _sampled(usable, training.where("lang IS NOT NULL").count(), weight_rows))
    return model


def _sampled(usable: DataFrame, many: int, rows: int) -> DataFrame:
    """Different texts (text, lang) with the least hashes, at most rows of them.

    A threshold on the hash leaves about twice as many before they are ordered, so no task gathers more
    than a few thousand texts, however many there are; copies of a text count once.
    """
    share = 2 * rows / max(many, 1)
    hashed = usable.withColumn("_hash", F.xxhash64("text"))
    few = hashed.where(F.pmod("_hash", F.lit(1 << 40)) < F.lit(math.ceil(min(share, 1.0) * (1 << 40))))
    return few.groupBy("_hash").agg(F.min("text").alias("text"), F.min("lang").alias("lang")).orderBy("_hash").limit(rows).select("text", "lang")


def _trust(model: LanguageModel, sample: DataFrame) -> np.ndarray:
    """For each language the share of its sampled texts that each bit gets right, as weights."""
    at = {lang: i for i, lang in enumerate(model.languages)}

    @handing_back
    def right(batches):
        hits, seen = np.ones(model.code.shape), np.full(len(at), 2.0)
        for batch in batches:
            for part in slices(batch, "text"):
                own = np.array([at[x] for x in part.column("lang").to_pylist()], dtype=np.int64)
                np.add.at(hits, own, (model.margins(part.column("text")) * model.code[own] > 0).astype(np.float64))
                np.add.at(seen, own, 1.0)
        yield pa.RecordBatch.from_pydict({"row": pa.array(np.arange(len(at), dtype=np.int32)), "hits": pa.array(hits.tolist()), "seen": pa.array(seen)})

    hits, seen = np.zeros(model.code.shape), np.zeros(len(at))
    with small_batches(sample.sparkSession):
        judged = sample.mapInArrow(right, "row int, hits array<double>, seen double").collect()  # a few rows for each task
    for r in judged:
        hits[r.row] += r.hits
        seen[r.row] += r.seen
    trust = hits / seen[:, None]
    return trust / trust.sum(axis=1, keepdims=True)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Adds lang_pred, score (0 to 1) and ambiguous to docs; only the text is looked at.

    A text that is null, empty or without any letter is 'und' with score 0, and so is every text when the
    model knows no language. Equal texts and repeated rows get equal answers; very long texts are read whole;
    other columns stay; columns of those three names are replaced; an empty table gives an empty result.
    """
    kept = docs.drop("lang_pred", "score", "ambiguous")
    languages = pa.array([*model.languages, UNDETERMINED], pa.string())

    @handing_back
    def answer(batches):
        for batch in batches:
            for part in slices(batch, "_text"):
                n = part.num_rows
                best, score, close = np.full(n, len(languages) - 1), np.zeros(n), np.zeros(n, dtype=bool)
                letters = part.column("_letters").to_numpy(zero_copy_only=False)
                if model.languages and letters.any():
                    found = model.decode(model.margins(part.column("_text")))
                    best, score, close = (np.where(letters, new, old) for new, old in zip(found, (best, score, close), strict=True))
                columns = [c for name, c in zip(part.schema.names, part.columns, strict=True) if name not in ("_text", "_letters")]
                names = [name for name in part.schema.names if name not in ("_text", "_letters")]
                yield pa.RecordBatch.from_arrays([*columns, languages.take(pa.array(best)), pa.array(score), pa.array(close)], names=[*names, "lang_pred", "score", "ambiguous"])

    added = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("ambiguous", BooleanType())]
    texts = kept.withColumns({"_text": F.coalesce(F.col(text).cast("string"), F.lit("")), "_letters": has_letter(F.col(text).cast("string"))})
    return texts.mapInArrow(answer, StructType([*kept.schema.fields, *added]))
