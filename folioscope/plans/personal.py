"""Feeds, lists and watches of users."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators.paging import offset_page
from folioscope.plans.registry import Registry
from folioscope.plans.relations import activity, paper_authors, paper_keywords, papers, with_ctes

registry = Registry()
query = registry.query


@query(with_ctes("papers", "paper_authors", "paper_keywords", "activity", more="""watched AS (SELECT DISTINCT event_type, target FROM activity WHERE user_id = 8 AND event_type IN ('view', 'click')),
ids AS (SELECT paper_id FROM paper_keywords JOIN watched ON keyword_id = target AND event_type = 'view' UNION SELECT paper_id FROM paper_authors JOIN watched ON author_id = target AND event_type = 'click')""") + """
SELECT id, strftime(published_date, '%Y-%m-%d') AS published_date FROM papers WHERE id IN (SELECT paper_id FROM ids) ORDER BY papers.published_date DESC, id DESC LIMIT 51""")  # fmt: skip
def feed_union_semi(spark, sf_dir):
    """Newest papers with a watched keyword or author; one more than a page, to know of a next one."""
    watched = activity(spark, sf_dir).where("user_id = 8 AND event_type IN ('view', 'click')").select("event_type", "target").distinct()
    by_keyword = paper_keywords(spark, sf_dir).join(watched.where("event_type = 'view'"), F.col("keyword_id") == F.col("target"), "left_semi").select("paper_id")
    by_author = paper_authors(spark, sf_dir).join(watched.where("event_type = 'click'"), F.col("author_id") == F.col("target"), "left_semi").select("paper_id")
    ids = by_keyword.union(by_author).distinct()
    found = papers(spark, sf_dir).join(ids, F.col("id") == F.col("paper_id"), "left_semi")
    return offset_page(found, [F.desc("published_date"), F.desc("id")], 1, 51).select("id", F.date_format("published_date", "yyyy-MM-dd").alias("published_date"))


_LISTS = "lists AS (SELECT user_id, event_type AS list_name, bool_or(value > 50) AS is_starred FROM activity GROUP BY ALL), saved AS (SELECT DISTINCT user_id, event_type AS list_name, target FROM activity WHERE event_type IN ('view', 'purchase'))"


def _lists(spark, sf_dir):
    a = activity(spark, sf_dir)
    lists = a.groupBy("user_id", F.col("event_type").alias("list_name")).agg(F.bool_or(F.col("value") > 50).alias("is_starred"))
    saved = a.where("event_type IN ('view', 'purchase')").select("user_id", F.col("event_type").alias("list_name"), "target").distinct()
    return lists, saved


@query(with_ctes("activity", more=_LISTS) + "SELECT l.user_id, l.list_name, l.is_starred, count(s.target) AS n FROM lists l LEFT JOIN saved s ON s.user_id = l.user_id AND s.list_name = l.list_name GROUP BY ALL")
def list_counts_composite_left(spark, sf_dir):
    lists, saved = _lists(spark, sf_dir)
    counts = saved.groupBy("user_id", "list_name").agg(F.count("*").alias("n"))
    return lists.join(counts, ["user_id", "list_name"], "left").select("user_id", "list_name", "is_starred", F.coalesce("n", F.lit(0)).alias("n"))


@query(with_ctes("activity", more=_LISTS) + "SELECT s.user_id, s.target, bool_or(l.is_starred) AS starred, string_agg(s.list_name, ',' ORDER BY s.list_name) AS lists FROM saved s JOIN lists l USING (user_id, list_name) GROUP BY ALL")
def starred_max(spark, sf_dir):
    lists, saved = _lists(spark, sf_dir)
    joined = saved.join(lists, ["user_id", "list_name"])
    return joined.groupBy("user_id", "target").agg(F.bool_or("is_starred").alias("starred"), F.array_join(F.sort_array(F.collect_set("list_name")), ",").alias("lists"))


@query(with_ctes("activity") + """SELECT user_id, target, event_type IN ('view', 'signup') AS watched FROM activity WHERE event_type IN ('view', 'signup', 'error')
QUALIFY row_number() OVER (PARTITION BY user_id, target ORDER BY ts DESC, event_id DESC) = 1""")  # fmt: skip
def watch_last_state(spark, sf_dir):
    """The last wish of each (user, target) wins, whatever came before: one aggregation, no sort."""
    wishes = activity(spark, sf_dir).where("event_type IN ('view', 'signup', 'error')")
    last = wishes.groupBy("user_id", "target").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last"))
    return last.select("user_id", "target", F.col("last").isin("view", "signup").alias("watched"))


@query(with_ctes("activity") + """SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, event_id, count(*) OVER w AS failures FROM activity WHERE event_type = 'error'
WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) QUALIFY count(*) OVER w >= 3""")  # fmt: skip
def failure_sliding_window(spark, sf_dir):
    """Errors of a user that are at least the third within a day."""
    from pyspark.sql import Window

    errors = activity(spark, sf_dir).where("event_type = 'error'").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    back = Window.partitionBy("user_id").orderBy("us").rangeBetween(-86_400_000_000, 0)
    counted = errors.withColumn("failures", F.count("*").over(back)).where("failures >= 3")
    return counted.select("user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "event_id", "failures")


@query(with_ctes("activity", more="""marked AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM activity),
numbered AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM marked)""") + """
SELECT user_id, strftime(max(ts) + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS rebuild_after, count(*) AS changes FROM numbered GROUP BY user_id, s""")  # fmt: skip
def debounce_sessions(spark, sf_dir):
    """Changes within six hours of each other share one rebuild, six hours after the last of them."""
    window = F.session_window(F.col("ts").cast("timestamp"), "6 hours")
    sessions = activity(spark, sf_dir).groupBy("user_id", window.alias("w")).agg(F.count("*").alias("changes"))
    return sessions.select("user_id", F.date_format("w.end", "yyyy-MM-dd HH:mm:ss").alias("rebuild_after"), "changes")
