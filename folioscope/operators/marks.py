"""Reviewers' marks on phrases, replayed over keywords, aliases, maths words and ignored phrases.

A mark puts a phrase into one of four tables or takes it out of all: useful, alias (of a keyword), math, ignore, unreviewed.
Before that the phrase leaves the table it was in. An alias takes the phrase's own aliases and papers along to its
keyword; where that is no keyword, the phrase becomes one itself. A keyword that is marked math, ignore or unreviewed
goes with its aliases and its papers' links.

Nothing is replayed row by row. Whether an alias mark holds depends on one earlier mark only, the last one of its
keyword, and where a phrase's aliases and links are at the end depends on the next mark that ends its keyword. Both
are chains of pointers, found by joins on time and followed by doubling.

Marks are (seq, phrase, status, alias_of), seq unique and not negative; a mark without a phrase does nothing, one of an unknown
status counts as unreviewed, an alias of nothing or of the phrase itself leaves the phrase in no table if it was a keyword. New keywords have
score 5. A corrected spelling (another phrase than the one that is marked) is two marks: unreviewed, and useful.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators.asof import followed, latest_before
from folioscope.operators.stored import remove, written

NEW_SCORE = 5
SCHEMAS = {"keywords": "phrase string, score long", "aliases": "alias string, phrase string", "math": "phrase string", "ignored": "phrase string", "links": "paper_id long, phrase string"}


@dataclass
class Reviewed:
    """keywords (phrase, score), aliases (alias, phrase), math (phrase), ignored (phrase), links (paper_id, phrase)."""

    keywords: DataFrame
    aliases: DataFrame
    math: DataFrame
    ignored: DataFrame
    links: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession) -> Reviewed:
        return cls(**{name: spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()})


def _as_marks(state: Reviewed) -> DataFrame:
    """What is stored, as marks before the first one: keywords at -2, what may point to them at -1."""
    none = F.lit(None).cast("string")

    def rows(df, at, phrase, status, of):
        return df.select(F.lit(at).cast("long").alias("at"), F.col(phrase).alias("phrase"), F.lit(status).alias("status"), of.alias("alias_of"))

    return (
        rows(state.keywords, -2, "phrase", "useful", none).unionByName(rows(state.aliases, -1, "alias", "alias", F.col("phrase")))
        .unionByName(rows(state.math, -1, "phrase", "math", none)).unionByName(rows(state.ignored, -1, "phrase", "ignore", none))
    )


def _judged(marks: DataFrame) -> DataFrame:
    """marks with keyword: whether the phrase is a keyword after the mark.

    Only marks that ask for a keyword are nodes of chains, known by their at; one that meets any other mark has its answer at once.
    """
    useful = F.col("status").eqNullSafe("useful")
    asks = F.col("status").eqNullSafe("alias") & F.coalesce(F.col("alias_of") != "", F.lit(False)) & (F.col("at") >= 0)
    own = marks.select(F.col("phrase").alias("key"), "at", F.struct(F.when(asks, F.col("at")).alias("up"), useful.alias("useful")).alias("value"))
    asking = marks.where(asks).select(F.col("alias_of").alias("key"), "at", "phrase")
    met = latest_before(asking, own)
    value = F.coalesce("found.useful", F.lit(True))  # an alias of nothing that was marked becomes a keyword
    ends = followed(met.select(F.col("at").alias("id"), F.col("found.up").alias("up"), F.col("found").isNotNull().alias("odd"), value.alias("value"), "phrase", F.col("key").alias("alias_of")))
    asked = ends.select("phrase", F.col("id").alias("at"), F.lit("alias").alias("status"), "alias_of", (F.col("value") != F.col("odd")).alias("keyword"))
    judged = written(marks.where(~asks).select("phrase", "at", "status", "alias_of", useful.alias("keyword")).unionByName(asked), "judged")
    remove(ends)
    return judged


def _homes(judged: DataFrame) -> DataFrame:
    """(phrase, at, home, kept): the keyword to which what a mark attached belongs at the end, null where that is gone.

    A stored keyword attaches itself; kept says that no mark has ended it.
    """
    real = F.coalesce(F.col("alias_of") != "", F.lit(False)) & F.coalesce(F.col("alias_of") != F.col("phrase"), F.lit(False))
    aliased = ~F.col("keyword") & F.col("status").eqNullSafe("alias") & real
    ending = judged.where(~F.col("keyword")).select(F.col("phrase").alias("key"), (-F.col("at")).alias("at"), F.struct(F.when(aliased, F.col("at")).alias("moves")).alias("value"))
    stored = F.col("keyword") & (F.col("at") == -2)
    attached = judged.where(aliased | stored).select(F.when(stored, F.col("phrase")).otherwise(F.col("alias_of")).alias("key"), (-F.col("at")).alias("at"), "phrase", stored.alias("stored"))
    met = latest_before(attached, ending).withColumn("at", -F.col("at"))
    node = lambda at, phrase: F.struct(at.alias("at"), F.when(at < 0, phrase).alias("stored"))  # noqa: E731  a mark is known by its at
    up = F.when(F.col("found.moves").isNotNull(), node(F.col("found.moves"), F.col("key")))
    home, kept = F.when(F.col("found").isNull(), F.col("key")), F.col("stored") & F.col("found").isNull()
    ends = followed(met.select(node(F.col("at"), F.col("phrase")).alias("id"), up.alias("up"), F.lit(False).alias("odd"), home.alias("value"), "phrase", "at", kept.alias("kept")))
    return ends.select("phrase", "at", F.col("value").alias("home"), "kept")


def replay_marks(state: Reviewed, marks: DataFrame) -> tuple[Reviewed, DataFrame]:
    """State after all marks, and (seq, phrase, status): what became of each mark. As replay_asked, without asked."""
    after, answers = replay_asked(state, marks)
    return after, answers.drop("asked")


def replay_asked(state: Reviewed, marks: DataFrame) -> tuple[Reviewed, DataFrame]:
    """State after all marks, and (seq, phrase, asked, status): each mark's own status, and what became of it.

    A phrase is in one table at most before and after. The result is the same in whatever batches marks come, as long as
    batches follow each other in order of seq.
    """
    new = marks.where("phrase IS NOT NULL AND phrase <> ''").select(F.col("seq").cast("long").alias("at"), "phrase", "status", "alias_of")
    both = written(_as_marks(state).unionByName(new), "marks")
    judged = _judged(both)
    remove(both)
    homes = _homes(judged)
    last = judged.groupBy("phrase").agg(F.max_by(F.struct("at", "status", "keyword"), "at").alias("l")).select("phrase", "l.*")
    scores = homes.where("kept").join(state.keywords, "phrase").select("phrase", "score")
    keywords = last.where("keyword").join(scores, "phrase", "left").select("phrase", F.coalesce("score", F.lit(NEW_SCORE)).cast("long").alias("score"))
    aliases = last.where("status = 'alias' AND NOT keyword").join(homes.where("home IS NOT NULL"), ["phrase", "at"]).select(F.col("phrase").alias("alias"), F.col("home").alias("phrase"))
    links = state.links.join(homes.where("at = -2 AND home IS NOT NULL"), "phrase").select("paper_id", F.col("home").alias("phrase")).distinct()
    only = lambda status: last.where((F.col("status") == status) & ~F.col("keyword")).select("phrase")
    refused = ~F.coalesce(F.col("alias_of") != "", F.lit(False)) | F.coalesce(F.col("alias_of") == F.col("phrase"), F.lit(False))
    shown = F.when(F.col("keyword"), "useful").when((F.col("status") == "alias") & ~refused, "alias").when(F.col("status").isin("math", "ignore"), F.col("status")).otherwise("unreviewed")
    answers = judged.where("at >= 0").select(F.col("at").alias("seq"), "phrase", F.col("status").alias("asked"), shown.alias("status"))
    return Reviewed(keywords, aliases, only("math"), only("ignore"), links), answers
