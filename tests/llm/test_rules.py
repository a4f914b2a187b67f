from tessellar.llm import queries as q


def test_url_rules_are_the_contracts(spark, tmp_path):
    urls = ["http://a.net/de/1", "http://spam.net/de/1", "http://x.example.net/de/81", "http://example.net/de/7", "http://casino.net/en/1", "http://a.com/en/1", "http://example.com/en/70", "http://a.org/es/", None]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    want = [("net/de/", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("net/de/", "allow"), (None, "block"), ("com/en/", "block"), ("example.com/en/7", "allow"), ("org/es/", "block"), (None, "allow")]
    assert [(r.rule, r.verdict) for r in q.op2_url_filter(spark, str(tmp_path)).orderBy("page_id").collect()] == want
