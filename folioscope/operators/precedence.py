"""What a landed revision may do to a paper's identifier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions.identifiers import doi_in, doi_key

#: The state of an identifier that came with a feed, as stored.
FROM_FEED, VERIFIED, PUBLISHED = "arxiv", "verified", "published"


def revised(stored: DataFrame, landed: DataFrame, rejected: DataFrame) -> DataFrame:
    """(id, version, outcome, doi, doi_status, publication_status) of every stored or landed paper.

    stored (id, version, doi, doi_status, publication_status), landed (id, version, doi), one row an id each; rejected (id, doi): any number,
    repeated and null ones, too. Outcomes:
    untouched (nothing landed), inserted (nothing stored), stale (an older version landed), no_doi (the revision has none: what is stored stays),
    kept_verified (a verified one differs), rejected_removed (the landed one was rejected for this paper, and is what is stored: it goes),
    rejected_ignored (rejected, and not what is stored), taken. DOIs are compared without resolver and case.
    """
    refused = rejected.where("doi IS NOT NULL").select("id", doi_key(F.col("doi")).alias("key")).distinct().withColumn("refused", F.lit(True))
    shaped = landed.withColumn("doi", F.coalesce(doi_in(F.col("doi")), F.nullif(F.trim("doi"), F.lit("")))).withColumn("key", doi_key(F.col("doi")))
    new = shaped.join(refused, ["id", "key"], "left").select("id", F.struct("version", "doi", "key", "refused").alias("n"))
    old = stored.select("id", F.struct("version", "doi", doi_key(F.coalesce(doi_in(F.col("doi")), "doi")).alias("key"), "doi_status", "publication_status").alias("o"))
    j = old.join(new, "id", "full_outer")
    verified = (F.col("o.doi_status") == VERIFIED) & (F.col("o.key") != "") & (F.col("o.key") != F.col("n.key"))
    outcome = (
        F.when(F.col("n").isNull(), "untouched").when(F.col("o").isNull(), "inserted").when(F.col("n.version") < F.col("o.version"), "stale")
        .when(F.col("n.doi").isNull(), "no_doi").when(verified, "kept_verified")
        .when(F.col("n.refused") & (F.col("o.key") == F.col("n.key")), "rejected_removed").when(F.col("n.refused"), "rejected_ignored").otherwise("taken")
    )
    j = j.withColumn("outcome", outcome)
    fed, has = F.col("outcome").isin("inserted", "taken"), F.col("n.doi").isNotNull()
    gone = (F.col("outcome") == "rejected_removed") | ((F.col("outcome") == "no_doi") & F.col("o.doi").isNull())
    assumed = (F.col("outcome") == "kept_verified") | ((F.col("outcome") == "no_doi") & F.col("o.doi").isNotNull())
    return j.select(
        "id", F.when(F.col("outcome").isin("untouched", "stale"), F.col("o.version")).otherwise(F.col("n.version")).alias("version"), "outcome",
        F.when(fed, F.col("n.doi")).when(~gone, F.when(F.col("outcome") == "kept_verified", F.coalesce(doi_in(F.col("o.doi")), "o.doi")).otherwise(F.col("o.doi"))).alias("doi"),
        F.when(fed, F.when(has, FROM_FEED)).when(~gone, F.col("o.doi_status")).alias("doi_status"),
        F.when(fed, F.when(has, PUBLISHED)).when(assumed, F.coalesce("o.publication_status", F.lit(PUBLISHED))).otherwise(F.col("o.publication_status")).alias("publication_status"),
    )
