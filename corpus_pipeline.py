"""The corpus pipeline: documents in, packed training sequences out.

Each stage works on all that its predecessor kept and returns the columns of documents, but for the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.jaccard_join import near_duplicates
from folioscope.llm.language_id import UNDETERMINED, fit, identify
from folioscope.llm.packing import pack_documents
from folioscope.llm.personal_data import mask_personal_data
from folioscope.llm.storage import store, table
from folioscope.llm.substring_dedup import remove_repeats

#: Documents in another language than they say, with at least this score, are rejected.
SURE = 0.9


def _apart(docs: DataFrame, *used: str) -> DataFrame:
    """The used columns, and all others in one struct, so that no operator's column has the name of one of them."""
    return docs.select(*used, F.struct(F.lit(None).alias("_"), *(c for c in docs.columns if c not in used)).alias("_others"))


def _together(rows: DataFrame, docs: DataFrame, *used: str) -> DataFrame:
    """The columns of docs again, the used ones as rows has them; n_chars is that of the text where the text may have changed."""
    own = {c: F.col(c) for c in used}
    if "text" in used and "doc_id" in used:
        own["n_chars"] = F.length("text").cast("long")
    return rows.select(*(own.get(c, F.col("_others")[c]).alias(c) for c in docs.columns))


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: rejects texts without a letter, and those surely in another language than lang says.

    The model learns from all labelled documents of this stage's input. Ambiguous texts stay, and so do those
    whose lang is null. Null and empty texts go, as they have no letter; repeated rows and ties are judged alike, each on
    its own. Without a labelled document nothing is in a wrong language. An empty table stays empty. Other columns stay, whatever their names.
    """
    answered = identify(_apart(docs, "text", "lang"), fit(docs))
    wrong = F.coalesce((F.col("lang_pred") != F.col("lang")) & (F.col("score") >= SURE) & ~F.col("ambiguous"), F.lit(False))
    return _together(answered.where((F.col("lang_pred") != UNDETERMINED) & ~wrong), docs, "text", "lang")


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of documents linked at 0.8 on five-word shingles the smallest doc_id stays.

    Rows without doc_id stay; rows that repeat the smallest doc_id all stay. Null texts and texts without words are linked with
    nothing, so they stay. Very long texts are read whole. An empty table stays empty; other columns stay as they are.
    """
    groups = near_duplicates(docs.select("doc_id", "text"), words=5, percent=80)
    first = groups.where(F.col("component_id").isNull() | (F.col("component_id") == F.col("doc_id"))).select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(first, F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi")


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Substring dedup: what is left of each text after repeated 50-word windows; texts left empty go.

    Texts without a repeat keep their white space, null and empty ones stay as they are, and so do rows without doc_id. Rows with one
    doc_id don't repeat each other; of equal texts the smallest doc_id keeps its own. An empty table stays empty. Other columns
    stay, whatever their names; n_chars is that of the text that is left.
    """
    kept = remove_repeats(_apart(docs, "doc_id", "text").withColumn("_whole", F.col("text")))
    kept = kept.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    kept = kept.withColumn("text", F.when(F.col("n_removed") == 0, F.col("_whole")).otherwise(F.col("text")))
    return _together(kept, docs, "doc_id", "text")


def mask_private_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """PII: personal data in the texts becomes [EMAIL], [IP], [CARD] or [PHONE]; every document stays.

    Null texts stay null and empty ones empty; repeated rows are masked alike; overlapping spans become one mark. An empty table stays
    empty. Other columns stay; n_chars is that of the masked text.
    """
    return _together(mask_personal_data(_apart(docs, "doc_id", "text")), docs, "doc_id", "text")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing: the pieces of all texts, placed in sequences of 4096 tokens.

    Null texts are empty and have one piece, the end token; repeated rows are packed each time; pieces of one length are placed
    in any order. An empty table gives no pieces; other columns don't matter.
    """
    return pack_documents(docs)


STAGES = [
    ("language_id", keep_known_languages),
    ("jaccard_join", keep_one_of_each_group),
    ("substring_dedup", cut_repeated_passages),
    ("pii", mask_private_spans),
    ("packing", pack_sequences),
]

#: Learned models and token ids are beyond SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
