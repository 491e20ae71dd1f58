"""Counts, clouds, calendars."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.plans.registry import Registry
from folioscope.plans.relations import authors, candidates, keywords, paper_authors, paper_keywords, papers, table, users, with_ctes

registry = Registry()
query = registry.query


@query(with_ctes("keywords", "paper_keywords") + """SELECT k.keyword_id, k.phrase, k.score, count(pk.paper_id) AS paper_count FROM keywords k LEFT JOIN paper_keywords pk USING (keyword_id)
GROUP BY ALL ORDER BY k.score DESC, paper_count DESC, k.phrase, k.keyword_id LIMIT 200""")  # fmt: skip
def keyword_usage_left(spark, sf_dir):
    used = paper_keywords(spark, sf_dir).groupBy("keyword_id").agg(F.count("*").alias("n"))
    whole = keywords(spark, sf_dir).join(used, "keyword_id", "left").select("keyword_id", "phrase", "score", F.coalesce("n", F.lit(0)).alias("paper_count"))
    return whole.orderBy(F.desc("score"), F.desc("paper_count"), "phrase", "keyword_id").limit(200)


@query(with_ctes("papers") + """SELECT coalesce(nullif(status, 'P'), 'NULL') AS status, count(*) AS n, count(DISTINCT category) AS categories,
cast(sum(CASE WHEN category LIKE '1%' THEN 1 ELSE 0 END) AS BIGINT) AS urgent FROM papers GROUP BY 1""")  # fmt: skip
def status_rollup(spark, sf_dir):
    p = papers(spark, sf_dir).withColumn("status", F.coalesce(F.nullif("status", F.lit("P")), F.lit("NULL")))
    return p.groupBy("status").agg(F.count("*").alias("n"), F.countDistinct("category").alias("categories"), F.count_if(F.col("category").like("1%")).alias("urgent"))


@query(with_ctes("papers", "authors") + """SELECT count(*) AS paper_count, strftime(max(published_date), '%Y-%m-%d') AS latest, max(id) AS last_id, (SELECT count(*) FROM authors) AS author_count FROM papers""")
def site_status(spark, sf_dir):
    n = authors(spark, sf_dir).agg(F.count("*").alias("author_count"))
    own = papers(spark, sf_dir).agg(F.count("*").alias("paper_count"), F.date_format(F.max("published_date"), "yyyy-MM-dd").alias("latest"), F.max("id").alias("last_id"))
    return own.join(F.broadcast(n))  # one row


@query(with_ctes("authors", "paper_authors") + """SELECT name, count(*) AS papers FROM paper_authors JOIN authors USING (author_id) GROUP BY author_id, name HAVING count(*) >= 50""")
def prolific_authors_having(spark, sf_dir):
    counts = paper_authors(spark, sf_dir).groupBy("author_id").agg(F.count("*").alias("papers")).where("papers >= 50")
    return counts.join(authors(spark, sf_dir), "author_id").select("name", "papers")


@query(with_ctes("authors", "paper_authors") + """SELECT name, split_part(name, '#', 2) AS surname, count(*) AS papers FROM paper_authors JOIN authors USING (author_id) GROUP BY author_id, name
ORDER BY papers DESC, surname, name LIMIT 10""")  # fmt: skip
def top_authors(spark, sf_dir):
    counts = paper_authors(spark, sf_dir).groupBy("author_id").agg(F.count("*").alias("papers"))
    named = counts.join(authors(spark, sf_dir), "author_id").select("name", F.substring_index("name", "#", -1).alias("surname"), "papers")
    return named.orderBy(F.desc("papers"), "surname", "name").limit(10)


@query(with_ctes("keywords", "paper_keywords", more="""used AS (SELECT phrase, count(*) AS n FROM paper_keywords JOIN keywords USING (keyword_id) WHERE active GROUP BY phrase),
bounds AS (SELECT min(n) AS lo, max(n) AS hi FROM used)""") + """SELECT phrase, n, round((ln(n + 1) - ln(lo + 1)) / coalesce(nullif(ln(hi + 1) - ln(lo + 1), 0), 1), 6) AS weight FROM used, bounds""")  # fmt: skip
def keyword_cloud_logweight(spark, sf_dir):
    used = paper_keywords(spark, sf_dir).join(keywords(spark, sf_dir).where("active"), "keyword_id").groupBy("phrase").agg(F.count("*").alias("n"))
    bounds = used.agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    log = lambda c: F.log(F.col(c) + 1)
    span = F.coalesce(F.nullif(log("hi") - log("lo"), F.lit(0.0)), F.lit(1.0))
    return used.join(F.broadcast(bounds)).select("phrase", "n", F.round((log("n") - log("lo")) / span, 6).alias("weight"))  # one row


@query(with_ctes("papers") + "SELECT strftime(published_date, '%Y-%m-%d') AS day, count(*) AS n FROM papers WHERE published_date >= DATE '2000-01-01' AND published_date < DATE '2001-01-01' GROUP BY 1")
def calendar_day_counts(spark, sf_dir):
    year = papers(spark, sf_dir).where("published_date >= DATE '2000-01-01' AND published_date < DATE '2001-01-01'")
    return year.groupBy("published_date").agg(F.count("*").alias("n")).select(F.date_format("published_date", "yyyy-MM-dd").alias("day"), "n")


@query(with_ctes("papers", more="days AS (SELECT cast(unnest(generate_series(DATE '2001-01-01', DATE '2001-12-31', INTERVAL 1 DAY)) AS DATE) AS d)") + """SELECT strftime(d, '%Y-%m-%d') AS day, cast(month(d) AS INTEGER) AS month,
cast(weekday(d) AS INTEGER) AS weekday, count(id) AS n FROM days LEFT JOIN papers ON published_date = d GROUP BY d""")  # fmt: skip
def calendar_grid_full(spark, sf_dir):
    days = spark.range(1).select(F.explode(F.sequence(F.lit("2001-01-01").cast("date"), F.lit("2001-12-31").cast("date"))).alias("d"))
    year = papers(spark, sf_dir).where("published_date BETWEEN DATE '2001-01-01' AND DATE '2001-12-31'").groupBy("published_date").agg(F.count("*").alias("n"))
    whole = days.join(year, F.col("d") == F.col("published_date"), "left")
    return whole.select(F.date_format("d", "yyyy-MM-dd").alias("day"), F.month("d").alias("month"), (F.dayofweek("d") - 1).alias("weekday"), F.coalesce("n", F.lit(0)).alias("n"))


@query(with_ctes("papers") + "SELECT cast(year(published_date) AS INTEGER) AS year, count(*) AS n FROM papers GROUP BY 1")
def year_counts(spark, sf_dir):
    return papers(spark, sf_dir).groupBy(F.year("published_date").alias("year")).agg(F.count("*").alias("n"))


def _missing(spark, sf_dir):
    months = spark.range(1).select(F.explode(F.expr("sequence(DATE '1991-01-01', DATE '2001-08-01', INTERVAL 1 MONTH)")).alias("m"))
    filled = papers(spark, sf_dir).select(F.trunc("published_date", "month").alias("m")).distinct()
    return months.join(filled, "m", "left_anti")


_ALL_MONTHS = "months AS (SELECT cast(unnest(generate_series(DATE '1991-01-01', DATE '2001-08-01', INTERVAL 1 MONTH)) AS DATE) AS m), filled AS (SELECT DISTINCT date_trunc('month', published_date) AS m FROM papers)"


@query(with_ctes("papers", more=_ALL_MONTHS) + "SELECT strftime(m, '%Y-%m') AS month FROM months m WHERE NOT EXISTS (SELECT 1 FROM filled f WHERE f.m = m.m)")
def missing_months_whole(spark, sf_dir):
    """Months without any paper."""
    return _missing(spark, sf_dir).select(F.date_format("m", "yyyy-MM").alias("month"))


@query(with_ctes("papers", more=_ALL_MONTHS) + "SELECT strftime(max(m.m), '%Y-%m') AS month FROM months m WHERE NOT EXISTS (SELECT 1 FROM filled f WHERE f.m = m.m)")
def latest_gap_month_whole(spark, sf_dir):
    """The gap that an ingest fills next: the last month without papers."""
    return _missing(spark, sf_dir).agg(F.date_format(F.max("m"), "yyyy-MM").alias("month"))


@query(with_ctes("users", "papers", "activity") + """SELECT u.nation_id, count(DISTINCT u.user_id) AS users, count(DISTINCT p.id) AS papers, count(DISTINCT a.event_id) AS events
FROM users u LEFT JOIN papers p ON p.user_id = u.user_id LEFT JOIN activity a ON a.user_id = u.user_id GROUP BY u.nation_id""")  # fmt: skip
def user_rollup_multi_distinct(spark, sf_dir):
    """Children are counted before the join, so no user's rows multiply."""
    n_papers = papers(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("p"))
    n_events = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("e"))
    whole = users(spark, sf_dir).join(n_papers, "user_id", "left").join(n_events, "user_id", "left")
    return whole.groupBy("nation_id").agg(F.count("*").alias("users"), F.coalesce(F.sum("p"), F.lit(0)).alias("papers"), F.coalesce(F.sum("e"), F.lit(0)).alias("events"))


@query(with_ctes("candidates") + "SELECT CASE WHEN approved THEN 'approved' WHEN confidence >= 50 THEN 'pending' ELSE 'rejected' END AS status, count(*) AS n, max(confidence) AS best FROM candidates GROUP BY 1")
def candidate_status_counts(spark, sf_dir):
    status = F.when(F.col("approved"), "approved").when(F.col("confidence") >= 50, "pending").otherwise("rejected")
    return candidates(spark, sf_dir).groupBy(status.alias("status")).agg(F.count("*").alias("n"), F.max("confidence").alias("best"))


@query(with_ctes("keywords", "paper_keywords") + """SELECT k.phrase, count(DISTINCT k.keyword_id) AS ids, string_agg(DISTINCT pk.source, '' ORDER BY pk.source) AS sources
FROM keywords k JOIN paper_keywords pk USING (keyword_id) GROUP BY k.phrase""")  # fmt: skip
def keyword_sources(spark, sf_dir):
    joined = paper_keywords(spark, sf_dir).join(keywords(spark, sf_dir), "keyword_id")
    return joined.groupBy("phrase").agg(F.countDistinct("keyword_id").alias("ids"), F.array_join(F.sort_array(F.collect_set("source")), "").alias("sources"))


registry.also("missing_months", "missing_months_whole")
registry.also("latest_gap_month", "latest_gap_month_whole")
