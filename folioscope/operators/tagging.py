"""Dictionary tagging of texts by their n-grams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Phrases of a dictionary that fits in one broadcast row.
SMALL_DICTIONARY = 10_000


def phrase_links(docs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(id, keyword_id) for docs (id, grams array) and dictionary (phrase, keyword_id): one row for each pair.

    Grams of a document are made distinct before they are joined.
    """
    if dictionary.limit(SMALL_DICTIONARY + 1).count() <= SMALL_DICTIONARY:  # then only known grams are exploded and shuffled
        known = dictionary.agg(F.collect_set("phrase").alias("_known"))
        docs = docs.join(F.broadcast(known)).withColumn("grams", F.array_intersect("grams", "_known"))
    grams = docs.select("id", F.explode(F.array_distinct("grams")).alias("phrase"))
    return grams.join(dictionary, "phrase").select("id", "keyword_id").distinct()


def document_frequency(docs: DataFrame, least: int) -> DataFrame:
    """(phrase, paper_count) of phrases in at least so many documents (id, grams array)."""
    # From a plain explode Spark infers a filter on the array's size, for which it would make all grams once more.
    grams = docs.select(F.explode_outer(F.array_distinct("grams")).alias("phrase"))
    return grams.where("phrase IS NOT NULL").groupBy("phrase").agg(F.count("*").alias("paper_count")).where(F.col("paper_count") >= least)


def dictionary(keywords: DataFrame, aliases: DataFrame) -> DataFrame:
    """(phrase, keyword_id): active phrases (phrase, keyword_id), and aliases, which win over equal phrases."""
    both = keywords.withColumn("rank", F.lit(0)).unionByName(aliases.withColumn("rank", F.lit(1)))
    return both.groupBy("phrase").agg(F.max_by("keyword_id", F.struct("rank", "keyword_id")).alias("keyword_id"))
