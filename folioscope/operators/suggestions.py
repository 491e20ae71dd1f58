"""Labels that fit a phrase, by eight rules, without comparing each phrase with each label.

That one text is within another means that it begins one of the other's suffixes. So the suffixes of the longer side are
indexed by their first characters, the shorter side looks up its own, and only what agrees so far is compared:
an equal join for each rule, which Spark shuffles and splits, in place of phrases times labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The rules in the order in which they are tried; the first three put a label in front of all before it.
KINDS = ["exact title", "key match", "key prefix", "in title", "title in phrase", "key substr", "words in key", "words in title"]
IN_FRONT = 3
LEAST_NORM = 4
INDEXED = 4  # first characters of a suffix; a shorter text is looked up by all of its own


def contained(needles: DataFrame, hays: DataFrame) -> DataFrame:
    """(needle, hay): ids of needles (needle, text) within hays (hay, text), once each; empty needles are in nothing."""
    suffix = hays.select("hay", F.explode(F.transform(F.sequence(F.lit(1), F.length("text")), lambda i: F.substring(F.col("text"), i, F.length("text")))).alias("suffix"))
    # A suffix of n characters has n of the index's lengths, if it is that short.
    keys = F.transform(F.sequence(F.lit(1), F.least(F.length("suffix"), F.lit(INDEXED))), lambda n: F.substring(F.col("suffix"), F.lit(1), n))
    index = suffix.where("suffix <> ''").select("hay", "suffix", F.explode(keys).alias("_key"))
    asked = needles.where("text <> ''").select("needle", "text", F.substring("text", 1, INDEXED).alias("_key"))
    return asked.join(index, "_key").where(F.col("suffix").startswith(F.col("text"))).select("needle", "hay").distinct()


def beginning(short: DataFrame, long: DataFrame) -> DataFrame:
    """(short, long): ids of texts (short, text) that texts (long, text) begin with; empty ones begin nothing."""
    heads = long.where("text <> ''").select("long", F.explode(F.transform(F.sequence(F.lit(1), F.length("text")), lambda n: F.substring(F.col("text"), F.lit(1), n))).alias("text"))
    return short.where("text <> ''").join(heads, "text").select("short", "long")


def _squeezed(text: Column, marks: str) -> Column:
    return F.translate(text, marks, "")


def suggest_labels(phrases: DataFrame, labels: DataFrame, limit: int = 8) -> DataFrame:
    """(phrase, rank, key, kind): up to limit labels for each phrase, best first from 1.

    phrases: (phrase), repeated ones count once, null and empty ones have no labels. labels: (position, key, title), position and key unique; null titles
    are empty, and empty titles and keys fit nothing. A label has the first kind of KINDS that holds. The first three kinds come before the
    others, later positions first; the others follow by position.
    """
    p = phrases.select("phrase").where("phrase <> ''").distinct()
    lower = F.lower("phrase")
    p = p.select("phrase", lower.alias("lower"), _squeezed(lower, " -_").alias("norm"), F.filter(F.split(lower, r"\s+"), lambda w: w != "").alias("words"))
    k = labels.select("position", "key", F.lower(F.coalesce("title", F.lit(""))).alias("title"), _squeezed(F.lower("key"), "-_").alias("norm"))
    long = p.where(F.length("norm") >= LEAST_NORM)
    several = p.where(F.size("words") > 1)
    widest = F.array_max(F.transform("words", lambda w: F.struct(F.length(w), w.alias("w"))))["w"]
    as_ = lambda df, text, name, id_: df.select(F.col(id_).alias(name), F.col(text).alias("text"))
    hit = lambda df, phrase, key, kind: df.select(F.col(phrase).alias("phrase"), F.col(key).alias("key"), F.lit(KINDS.index(kind)).alias("rule"))

    def all_words(column, kind):
        found = contained(several.select(F.col("phrase").alias("needle"), widest.alias("text")), as_(k, column, "hay", "key"))
        whole = found.join(several.select(F.col("phrase").alias("needle"), "words"), "needle").join(as_(k, column, "hay", "key"), "hay")
        return hit(whole.where(F.forall("words", lambda w: F.col("text").contains(w))), "needle", "hay", kind)

    rules = [
        hit(p.join(k.select("key", F.col("title").alias("lower")), "lower"), "phrase", "key", "exact title"),
        hit(p.where("norm <> ''").join(k.select("key", "norm"), "norm"), "phrase", "key", "key match"),
        hit(beginning(as_(long, "norm", "short", "phrase"), as_(k, "norm", "long", "key")), "short", "long", "key prefix"),
        hit(beginning(as_(k, "norm", "short", "key"), as_(long, "norm", "long", "phrase")), "long", "short", "key prefix"),
        hit(contained(as_(p, "lower", "needle", "phrase"), as_(k, "title", "hay", "key")), "needle", "hay", "in title"),
        hit(contained(as_(k, "title", "needle", "key"), as_(p, "lower", "hay", "phrase")), "hay", "needle", "title in phrase"),
        hit(contained(as_(long, "norm", "needle", "phrase"), as_(k, "norm", "hay", "key")), "needle", "hay", "key substr"),
        hit(contained(as_(k, "norm", "needle", "key"), as_(long, "norm", "hay", "phrase")), "hay", "needle", "key substr"),
        all_words("norm", "words in key"),
        all_words("title", "words in title"),
    ]
    found = rules[0]
    for rule in rules[1:]:
        found = found.union(rule)
    first = found.groupBy("phrase", "key").agg(F.min("rule").alias("rule")).join(k.select("key", "position"), "key")
    front = F.col("rule") < IN_FRONT
    order = Window.partitionBy("phrase").orderBy(F.when(front, 0).otherwise(1), F.when(front, -F.col("position")).otherwise(F.col("position")))
    kind = F.get(F.array(*map(F.lit, KINDS)), F.col("rule"))
    return first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("phrase", "rank", "key", kind.alias("kind"))
