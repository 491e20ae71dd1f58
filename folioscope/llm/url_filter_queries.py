"""op6: a verdict for every page's url."""

from folioscope.llm.storage import table
from folioscope.llm.url_filter import judge_urls

#: (host, path, verdict): fixed by the query's contract.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op6_redirect_equivalence(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return judge_urls(pages, RULES).select("page_id", "host", "path", "rule", "verdict", "via")


_RULES_SQL = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)

ORACLE_SQL = {
    "op6_redirect_equivalence": rf"""
WITH RECURSIVE rules(rh, rp, rv) AS (VALUES {_RULES_SQL}),
tags AS (SELECT url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM pages WHERE url IS NOT NULL),
links AS (
  SELECT DISTINCT url, target FROM (
    SELECT url, CASE WHEN regexp_matches(tag, '(?is)\brel\s*=\s*["'']?canonical\b') THEN regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)
                     WHEN regexp_matches(tag, '(?is)\bhttp-equiv\s*=\s*["'']?refresh\b') THEN regexp_extract(tag, '(?is)\burl\s*=\s*["'']?([^"''\s>;]+)', 1) END AS target
    FROM tags) WHERE target LIKE '%://%' AND url <> target),
both_ways AS (SELECT url AS a, target AS b FROM links UNION SELECT target, url FROM links),
reach(a, b) AS (SELECT a, a FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
urls AS (SELECT DISTINCT url FROM pages UNION SELECT DISTINCT target FROM links),
parsed AS (
  SELECT url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM urls),
fits AS (
  SELECT url, rh || rp AS rule, rv AS verdict FROM parsed, rules
  WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
  QUALIFY row_number() OVER (PARTITION BY url ORDER BY length(rh || rp) DESC, rh || rp) = 1),
by_part AS (
  SELECT r.a AS url, CASE WHEN bool_or(f.verdict = 'allow') THEN 'allow' WHEN bool_or(f.verdict = 'block') THEN 'block' END AS alias
  FROM reach r JOIN fits f ON f.url = r.b GROUP BY r.a)
SELECT p.page_id, x.host, x.path, f.rule, coalesce(f.verdict, b.alias, 'allow') AS verdict,
       CASE WHEN f.rule IS NOT NULL THEN 'rule' WHEN b.alias IS NOT NULL THEN 'alias' ELSE 'default' END AS via
FROM pages p JOIN parsed x ON x.url IS NOT DISTINCT FROM p.url LEFT JOIN fits f ON f.url = p.url LEFT JOIN by_part b ON b.url = p.url
"""
}
QUERIES = {"op6_redirect_equivalence": op6_redirect_equivalence}
