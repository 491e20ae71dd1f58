from folioscope.plans.mining import doc_frequency_ngrams_four


def test_phrases_of_four_words(spark, scratch):
    rows = [(i, f"large random planar graph{' on' * i}", "en", "s", 9) for i in range(5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{scratch}/documents.parquet")
    found = {r.phrase: (r.paper_count, r.word_count) for r in doc_frequency_ngrams_four(spark, scratch).collect()}
    assert found["large random planar graph"] == (5, 4)
    assert len(found) == 10
