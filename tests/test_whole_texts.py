from folioscope.plans.mining import slugs_whole
from folioscope.plans.search import search_highlight_whole, search_match_labels_whole


def test_ends_of_long_texts(spark, scratch):
    text = "x y " * 100 + "<the End\u00e9>"
    spark.createDataFrame([(1, text, "en", "s", len(text))], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{scratch}/documents.parquet")
    spark.createDataFrame([(1, "https://b.org/x", "<title>" + "x " * 30 + "the</title>")], "page_id long, url string, html string").write.parquet(f"{scratch}/pages.parquet")
    assert slugs_whole(spark, scratch).first().slug == "x-y-" * 100 + "the-ende"
    assert search_highlight_whole(spark, scratch).first().shown == "x y " * 100 + "&lt;<mark>the</mark> End\u00e9&gt;"
    assert search_match_labels_whole(spark, scratch).first().labels == "title,abstract"
