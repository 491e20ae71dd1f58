"""The bibliographic relations, as views over the driver's tables.

Each relation is a function (spark, sf_dir) and has a common table expression of the same name in SQL, so a query
and its oracle start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: "Now" of every query that looks back in time.
AS_OF = "2001-08-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Into how many parts to deal a table's rows so that a task's share stays small: as many as shuffles have, or eight for each part that is read."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * table(spark, sf_dir, name).rdd.getNumPartitions())


def _lines(spark, sf_dir, *columns) -> DataFrame:
    """These columns of lineitem, dealt by order as they are: grouping them before that would hold all pairs of a read part in memory."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", *columns).repartition(parts(spark, sf_dir, "lineitem"), "l_orderkey")


def papers(spark, sf_dir) -> DataFrame:
    """(id, published_date, category, status, user_id, amount)"""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("published_date"), F.col("o_orderpriority").alias("category"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("user_id"), F.col("o_totalprice").alias("amount"))


def authors(spark, sf_dir) -> DataFrame:
    """(author_id, name)"""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("author_id"), F.col("s_name").alias("name"))


def paper_authors(spark, sf_dir) -> DataFrame:
    """(paper_id, author_id, author_order): one row for each pair."""
    lines = _lines(spark, sf_dir, "l_suppkey", "l_linenumber")
    return lines.groupBy(F.col("l_orderkey").alias("paper_id"), F.col("l_suppkey").alias("author_id")).agg(F.min("l_linenumber").alias("author_order"))


def keywords(spark, sf_dir) -> DataFrame:
    """(keyword_id, phrase, score 1-10, active)"""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("keyword_id"), F.col("p_name").alias("phrase"), (1 + F.col("p_size") % 10).cast("long").alias("score"), (F.col("p_size") >= 10).alias("active"))


def paper_keywords(spark, sf_dir) -> DataFrame:
    """(paper_id, keyword_id, source): A auto, N manual, R system."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_orderkey").alias("paper_id"), F.col("l_partkey").alias("keyword_id")).agg(F.min("l_returnflag").alias("source"))


def users(spark, sf_dir) -> DataFrame:
    """(user_id, user_name, nation_id, segment)"""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("user_name"), F.col("c_nationkey").alias("nation_id"), F.col("c_mktsegment").alias("segment"))


def candidates(spark, sf_dir) -> DataFrame:
    """(paper_id, doi_id, confidence, approved, seen): proposed identifiers of papers, one row for each pair."""
    confidence, approved = F.floor(F.col("l_discount") * 1000 + 0.5).cast("long"), F.col("l_linestatus") == "F"
    lines = _lines(spark, sf_dir, "l_partkey", confidence.alias("confidence"), approved.alias("approved"))
    return lines.groupBy(F.col("l_orderkey").alias("paper_id"), F.col("l_partkey").alias("doi_id")).agg(
        F.max("confidence").alias("confidence"), F.bool_or("approved").alias("approved"), F.count("*").alias("seen")
    )


def texts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")


def activity(spark, sf_dir) -> DataFrame:
    """(event_id, ts, user_id, event_type, target): what users did, and to which of 100 targets."""
    e = table(spark, sf_dir, "events")
    target = F.get_json_object("props", "$.k").cast("long")
    return e.select("event_id", "ts", "user_id", "event_type", target.alias("target"), "value")


CTES = {
    "papers": "SELECT o_orderkey AS id, cast(o_orderdate AS DATE) AS published_date, o_orderpriority AS category, o_orderstatus AS status, o_custkey AS user_id, o_totalprice AS amount FROM orders",
    "authors": "SELECT s_suppkey AS author_id, s_name AS name FROM supplier",
    "paper_authors": "SELECT l_orderkey AS paper_id, l_suppkey AS author_id, min(l_linenumber) AS author_order FROM lineitem GROUP BY ALL",
    "keywords": "SELECT p_partkey AS keyword_id, p_name AS phrase, cast(1 + p_size % 10 AS BIGINT) AS score, p_size >= 10 AS active FROM part",
    "paper_keywords": "SELECT l_orderkey AS paper_id, l_partkey AS keyword_id, min(l_returnflag) AS source FROM lineitem GROUP BY ALL",
    "users": "SELECT c_custkey AS user_id, c_name AS user_name, c_nationkey AS nation_id, c_mktsegment AS segment FROM customer",
    "candidates": "SELECT l_orderkey AS paper_id, l_partkey AS doi_id, cast(max(floor(l_discount * 1000 + 0.5)) AS BIGINT) AS confidence, bool_or(l_linestatus = 'F') AS approved, count(*) AS seen FROM lineitem GROUP BY ALL",
    "activity": "SELECT event_id, ts, user_id, event_type, cast(json_extract_string(props, '$.k') AS BIGINT) AS target, value FROM events",
}


def with_ctes(*names: str, more: str = "") -> str:
    """WITH clause over these relations; more: further expressions, each as 'name AS (...)'."""
    parts = [f"{name} AS ({CTES[name]})" for name in names] + ([more] if more else [])
    return "WITH " + ",\n".join(parts) + "\n"
