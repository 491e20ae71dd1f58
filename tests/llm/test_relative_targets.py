from folioscope.llm.url_filter import alias_links, judge_urls

ROWS = [
    (1, "http://a.net/d/p?q", '<link rel="canonical" href="/x?a=1&amp;b=2">', "http://a.net/x?a=1&b=2"),
    (2, "http://b.net/d/p", '<meta http-equiv=refresh content="0; url=new">', "http://b.net/d/new"),
    (3, "https://c.net/", "<link rel=canonical href=//blocked.com/de/1>", "https://blocked.com/de/1"),
    (4, "http://d.net/", '<meta http-equiv="refresh" content="0; url=http://e.net/?a=1&amp;b=2">', "http://e.net/?a=1&b=2"),
    (5, "/rel", '<link rel=canonical href="/x">', None),
    (6, "http://f.net/", '<link rel=canonical href="http://[bad/">', "http://[bad/"),
    (7, "http://g.net/", '<link rel=canonical href="//[bad/">', None),
    (8, "http://h.net/", "<link rel=canonical>", None),
]


def test_relative_targets(spark):
    pages = spark.createDataFrame([r[:3] for r in ROWS], "page_id long, url string, html string")
    assert {r.url: r.target for r in alias_links(pages).collect()} == {url: target for _, url, _, target in ROWS if target}
    assert [r.page_id for r in judge_urls(pages, [("com", "/de/", "block")]).where("verdict = 'block'").collect()] == [3]
