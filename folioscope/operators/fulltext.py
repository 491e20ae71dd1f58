"""Full-text filters over token arrays, and a relevance score by counts of words.

The score of a document is the sum over query words of tf * idf ** 2 with idf = log10(N / df), over runs of
[a-z0-9] in lower case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def holds_any(token_list: Column, words: list[str]) -> Column:
    """Natural-language mode, as a filter."""
    return F.arrays_overlap(token_list, F.array(*map(F.lit, words)))


def counted(text: Column, word: str) -> Column:
    """How often a word (of [a-z0-9]) is among the tokens of a text, without making tokens."""
    return F.regexp_count(F.lower(text), F.lit(rf"(?<![a-z0-9]){word}(?![a-z0-9])"))


def scored(docs: DataFrame, text: Column, words: list[str], name: str = "text_score") -> DataFrame:
    """The rows of docs that hold every word, with the relevance of words; document frequencies take one pass and one row."""
    times = [F.when(F.contains(F.lower(text), F.lit(w)), counted(text, w)).otherwise(0) for w in words]
    stats = docs.agg(F.count("*").alias("_n"), *(F.count_if(n > 0).alias(f"_df{i}") for i, n in enumerate(times)))
    tallied = docs.withColumns({f"_tf{i}": n for i, n in enumerate(times)})
    for i in range(len(words)):
        tallied = tallied.where(F.col(f"_tf{i}") > 0)
    total = F.lit(0.0)
    for i in range(len(words)):
        idf = F.log10(F.col("_n") / F.col(f"_df{i}"))  # a row that is left holds the word
        total = total + F.col(f"_tf{i}") * idf * idf
    whole = tallied.join(F.broadcast(stats)).withColumn(name, F.round(total, 6))  # one row
    return whole.drop("_n", *(f"{c}{i}" for i in range(len(words)) for c in ("_df", "_tf")))
