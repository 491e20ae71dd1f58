"""One paper as one nested document: its children inside, links to labels resolved, times in UTC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SITE, LABEL_SITE = "https://papers.example.org", "https://labels.example.org"
PAPER_URL = "https://arxiv.org"
TARGET = "struct<label:string,title:string,url:string>"


def host_of(url: Column) -> Column:
    """The host of an http or https address in lower case, without user and port; null for anything else."""
    return F.lower(F.nullif(F.regexp_extract(url, r"^https?://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1), F.lit("")))


def target(keyword: Column, href: Column, title: Column, label_site: str = LABEL_SITE) -> Column:
    """struct<label, title, url> that a keyword (phrase, url) links to: an address of label_site itself, or a label with an href; else null.

    title is the label's own, href its path; a missing title falls back to the label.
    """
    own = host_of(F.lit(label_site))
    url = keyword["url"]
    absolute = url.rlike("^https?://")
    whole = F.struct(url.alias("label"), F.coalesce(F.nullif(keyword["phrase"], F.lit("")), url).alias("title"), url.alias("url"))
    by_label = F.struct(url.alias("label"), F.coalesce(F.nullif(title, F.lit("")), url).alias("title"), F.concat(F.lit(f"{label_site}/"), F.ltrim(href, F.lit("/"))).alias("url"))
    inside = F.coalesce((host_of(url) == own) | (host_of(url) == F.concat(F.lit("www."), own)), F.lit(False))
    return F.when(absolute & inside, whole.cast(TARGET)).when(~absolute & (url != "") & href.isNotNull(), by_label.cast(TARGET))


def distinct_by_label(targets: Column) -> Column:
    """The first target of each label, in order, without nulls."""
    there = F.filter(targets, lambda t: t.isNotNull())
    return F.filter(there, lambda t, i: F.array_position(F.transform(there, lambda u: u["label"]), t["label"]) == i + 1)


def utc(time: Column) -> Column:
    """A timestamp as ISO text with Z and no fraction if there is none; sessions may have any time zone."""
    shown = F.date_format(F.to_utc_timestamp(time, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(shown, r"\.000000$", ""), F.lit("Z"))


def with_targets(links: DataFrame, labels: DataFrame, label_site: str = LABEL_SITE) -> DataFrame:
    """Adds target to links (phrase, url and any others): labels (label, href, title) are joined, label being unique."""
    named = labels.select(F.col("label").alias("_label"), F.coalesce("href", F.lit("")).alias("_href"), F.col("title").alias("_title"))
    joined = links.join(named, F.col("url") == F.col("_label"), "left")
    return joined.withColumn("target", target(F.struct("phrase", "url"), F.col("_href"), F.col("_title"), label_site)).drop("_label", "_href", "_title")


def document(site: str = SITE) -> Column:
    """struct of a paper's row.

    Columns: arxiv_id, base_id, version, title, abstract, primary_category, published_date and updated_date (date), created_at and updated_at (timestamp),
    comment, journal_ref, doi, doi_status, publication_url, publication_venue_key, publication_status, editor_note, authors and categories (array<string>), keywords
    (array<struct<phrase, score, source, url, target>>, in order). Missing lists are empty; base and version come from arxiv_id where they are null.
    """
    c = F.col
    split = lambda group: F.nullif(F.regexp_extract("arxiv_id", r"^(.*?)(?:v(\d+))?$", group), F.lit(""))
    known = c("base_id").isNotNull() & c("version").isNotNull()
    base, version = F.when(known, c("base_id")).otherwise(split(1)), F.coalesce("version", split(2).cast("int"))
    versioned = F.coalesce("arxiv_id", F.when(version.isNotNull(), F.concat(base, F.lit("v"), version.cast("string"))).otherwise(base))
    path = lambda id_: F.replace(F.replace(F.url_encode(id_), F.lit("%2F"), F.lit("/")), F.lit("+"), F.lit("%20"))
    keywords = F.coalesce("keywords", F.expr(f"CAST(array() AS array<struct<phrase:string,score:bigint,source:string,url:string,target:{TARGET}>>)"))
    shown = F.transform(keywords, lambda k: F.struct(k["phrase"].alias("phrase"), k["score"].alias("score"), k["source"].alias("source"), k["url"].alias("reference"), k["target"].alias("target")))
    none = F.expr("CAST(array() AS array<string>)")
    return F.struct(
        base.alias("arxiv_id"), F.coalesce(version, F.lit(1)).cast("int").alias("arxiv_version"), versioned.alias("versioned_arxiv_id"), "title", "abstract", F.coalesce("authors", none).alias("authors"), "primary_category",
        F.coalesce("categories", none).alias("categories"), shown.alias("keywords"), distinct_by_label(F.transform(keywords, lambda k: k["target"])).alias("targets"),
        c("published_date").cast("string").alias("published_at"), c("updated_date").cast("string").alias("revised_at"), utc(c("created_at")).alias("ingested_at"), utc(c("updated_at")).alias("changed_at"), "comment",
        F.struct(c("journal_ref").alias("journal_reference"), "doi", "doi_status", c("publication_url").alias("url"), c("publication_venue_key").alias("venue_key"), c("publication_status").alias("status"), "editor_note").alias("publication"),
        F.struct(F.concat(F.lit(f"{site}/paper/"), path(F.coalesce(base, versioned))).alias("site"), F.concat(F.lit(f"{PAPER_URL}/abs/"), path(versioned)).alias("arxiv"), F.concat(F.lit(f"{PAPER_URL}/pdf/"), path(versioned)).alias("pdf")).alias("urls"),
    )
