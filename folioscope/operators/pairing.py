"""Whether two records name the same work: people and titles of pairs scored as columns.

A person is struct<words array<string>, family, given> (functions/matching.py reads names once for each different
list). Pairs of people have a likeness; each person gets at most one partner, the likest pairs first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.matching import equal_runs, people, title_keys
from folioscope.operators.stored import written

#: Weights of a record's score, and of a title's: fixed values.
TITLE_SHARE, WORD_SHARE = 0.75, 0.65
CONTAINED_SCORE, CONTAINED_LENGTH = 0.96, 1.35
CLOSE_NAME = 0.65


def _let(value: Column, use) -> Column:
    """use(value), with value computed once however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _times(words: Column, word: Column) -> Column:
    return F.size(F.filter(words, lambda w: w == word))


def _sum(items: Column, of) -> Column:
    return F.aggregate(items, F.lit(0), lambda total, x: total + of(x).cast("int"))


def _joined(family: Column) -> Column:
    return F.replace(family, F.lit(" "), F.lit(""))


def _fits(a: Column, b: Column) -> Column:
    """Whether given words agree: they are equal, or one is the other's initial."""
    initial = lambda short, long: (F.length(short) == 1) & long.startswith(short)
    return (a != "") & (b != "") & ((a == b) | initial(a, b) | initial(b, a))


def likeness(a: Column, b: Column) -> Column:
    """1 for one surname and given words that agree; else the share of words with a partner, if a whole word has one.

    A word's partner is an equal word, else an initial of the other name that no equal word takes.
    """

    def shared(equal):
        def of_letter(x):
            """Words that begin with x and have no equal partner: (initials, longer ones) of a name."""
            left = lambda words, short: _sum(F.filter(words, lambda w: w.startswith(x) & ((F.length(w) == 1) == short)), lambda w: F.lit(1)) - _sum(F.filter(equal, lambda e: e["word"].startswith(x) & ((F.length(e["word"]) == 1) == short)), lambda e: e["n"])
            return F.least(left(a["words"], F.lit(True)), left(b["words"], F.lit(False))) + F.least(left(b["words"], F.lit(True)), left(a["words"], F.lit(False)))

        letters = F.array_distinct(F.transform(F.concat(a["words"], b["words"]), lambda w: F.substring(w, 1, 1)))
        both = _sum(equal, lambda e: e["n"]) + _sum(letters, of_letter)
        return F.when(F.exists(equal, lambda e: F.length(e["word"]) > 1), both / F.greatest(F.size(a["words"]), F.size(b["words"]))).otherwise(0.0)

    equal = F.transform(F.array_intersect(a["words"], b["words"]), lambda w: F.struct(w.alias("word"), F.least(_times(a["words"], w), _times(b["words"], w)).alias("n")))
    same = (a["family"] != "") & (_joined(a["family"]) == _joined(b["family"])) & _fits(a["given"], b["given"])
    return F.when((F.size(a["words"]) == 0) | (F.size(b["words"]) == 0), 0.0).when(same, 1.0).otherwise(_let(equal, shared))


def likenesses(a: Column, b: Column) -> Column:
    """array<struct<row, column, like>> of two lists of people, those above 0."""
    each = F.transform(a, lambda x, i: F.transform(b, lambda y, j: F.struct(i.alias("row"), j.alias("column"), likeness(x, y).alias("like"))))
    return F.filter(F.flatten(each), lambda e: e["like"] > 0)


def assigned(table: Column) -> Column:
    """Sum of the likenesses when each person has at most one partner: the greatest goes first, of equals the last one."""
    order = F.array_sort(F.transform(table, lambda e: F.struct((-e["like"]).alias("like"), (-e["row"]).alias("row"), (-e["column"]).alias("column"))))
    none = F.expr("CAST(array() AS array<int>)")
    begin = F.struct(F.lit(0.0).alias("sum"), none.alias("rows"), none.alias("columns"))

    def take(state, e):
        free = ~F.array_contains(state["rows"], e["row"]) & ~F.array_contains(state["columns"], e["column"])
        taken = F.struct((state["sum"] - e["like"]).alias("sum"), F.array_append(state["rows"], e["row"]).alias("rows"), F.array_append(state["columns"], e["column"]).alias("columns"))
        return F.when(free, taken).otherwise(state)

    return F.aggregate(order, begin, take)["sum"]


def overlap(a: Column, b: Column) -> Column:
    """Shared part of two sets, of two empty ones all of it."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(1.0)


def families(names: Column, compact: bool = False) -> Column:
    return F.filter(F.array_distinct(F.transform(names, lambda p: _joined(p["family"]) if compact else p["family"])), lambda f: f != "")


def people_scores(a: Column, b: Column) -> Column:
    """struct<similarity, compact, coverage, same> of two lists of people.

    similarity has partners among the longer list, coverage among the shorter one; where some name is a single word, surnames in common
    may count for more (compact: without their blanks). same: a surname in common, or two people who are close.
    """

    def scored(table):
        def of(total):
            some = (F.size(a) > 0) & (F.size(b) > 0)
            paired = F.when(some, total / F.greatest(F.size(a), F.size(b))).otherwise(0.0)
            short = F.exists(F.concat(a, b), lambda p: F.size(p["words"]) < 2)
            at_least = lambda compact: F.when(short, F.greatest(paired, overlap(families(a, compact), families(b, compact)))).otherwise(paired)
            covered = F.when(some, F.least(F.lit(1.0), total / F.least(F.size(a), F.size(b)))).otherwise(0.0)
            same = F.arrays_overlap(families(a, True), families(b, True)) | F.exists(table, lambda e: e["like"] >= CLOSE_NAME)
            return F.struct(at_least(False).alias("similarity"), at_least(True).alias("compact"), covered.alias("coverage"), same.alias("same"))

        return _let(assigned(table), of)

    return _let(likenesses(a, b), scored)


def title_similarity(a: Column, b: Column, runs: Column) -> Column:
    """Of two keys: words in common, and equal runs of characters."""
    words = lambda key: F.filter(F.array_distinct(F.split(key, " ")), lambda w: w != "")
    return F.when((a != "") & (_joined(a) == _joined(b)), 1.0).otherwise(WORD_SHARE * overlap(words(a), words(b)) + (1 - WORD_SHARE) * runs)


def record_score(a: Column, b: Column, title: Column, who: Column) -> Column:
    """Title keys, their similarity and people_scores: a title within the other, or the same one, counts for more."""
    first, second = _joined(a), _joined(b)
    within = (first != "") & (second != "") & (first.contains(second) | second.contains(first))
    within = within & (F.greatest(F.length(first), F.length(second)) <= CONTAINED_LENGTH * F.least(F.length(first), F.length(second)))
    better = F.greatest(title, F.when(within, CONTAINED_SCORE).otherwise(0.0))
    alike = F.when((first != "") & (first == second), F.when(who["same"], 1.0).otherwise(F.greatest(who["similarity"], who["compact"]))).otherwise(who["similarity"])
    return TITLE_SHARE * better + (1 - TITLE_SHARE) * alike


def score_pairs(pairs: DataFrame) -> DataFrame:
    """Adds title, coverage and score to pairs (title_a, names_a array<string>, title_b, names_b and any other columns).

    Every different title and list of names is read once, every different pair of title keys and of lists is scored once, and
    pairs take their scores by joins. Null titles are empty, null lists have no names. Pairs that repeat get equal
    scores; columns title, coverage and score are replaced; an empty table gives an empty result. Pairs and people's
    scores are written tables.
    """
    kept = [c for c in pairs.columns if c not in ("title", "coverage", "score")]
    whole = pairs.select(*kept).withColumns({c: F.coalesce(c, F.lit("")) for c in ("title_a", "title_b")} | {c: F.coalesce(c, F.array().cast("array<string>")) for c in ("names_a", "names_b")})
    whole = written(whole, "pairs")  # read several times below
    either = lambda column: whole.select(F.col(f"{column}_a").alias(column)).union(whole.select(F.col(f"{column}_b").alias(column))).distinct()
    keys = either("title").withColumn("key", title_keys("title"))
    read = either("names").withColumn("read", people("names"))
    side = lambda df, column, new, end: df.select(F.col(column).alias(f"{column}_{end}"), F.col(new).alias(f"{new}_{end}"))
    keyed = reduce(lambda df, end: df.join(side(keys, "title", "key", end), f"title_{end}"), "ab", whole)
    keyed = written(keyed, "keyed")
    runs = keyed.select("key_a", "key_b").distinct()
    equal = _joined(F.col("key_a")) == _joined(F.col("key_b"))
    runs = runs.where(equal).withColumn("runs", F.lit(1.0)).union(runs.where(~equal).withColumn("runs", equal_runs("key_a", "key_b")))
    titles = runs.select("key_a", "key_b", title_similarity(F.col("key_a"), F.col("key_b"), F.col("runs")).alias("_title"))
    lists = whole.select("names_a", "names_b").distinct()
    lists = reduce(lambda df, end: df.join(side(read, "names", "read", end), f"names_{end}"), "ab", lists)
    who = written(lists.select("names_a", "names_b", people_scores(F.col("read_a"), F.col("read_b")).alias("_who")), "people")
    both = keyed.join(titles, ["key_a", "key_b"]).join(who, ["names_a", "names_b"])
    score = record_score(F.col("key_a"), F.col("key_b"), F.col("_title"), F.col("_who"))
    return both.select(*kept, F.col("_title").alias("title"), F.col("_who.coverage").alias("coverage"), score.alias("score"))
