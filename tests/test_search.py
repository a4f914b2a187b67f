from tessellar.operators import fulltext
from tessellar.plans import catalogue

COLUMNS = "id long, namespace string, type string, name string, description string, body string, deleted_at long"


def memories(spark, more=()):
    rows = [(i, "global", "note", f"n{i}", "d", " ".join(f"t{(i * 7 + j) % 50:02d}" for j in range(20)), None) for i in range(200)]
    return spark.createDataFrame([*rows, (500, "global", "note", "", "", "", None), (501, "other", "note", "x", "gone t01", "b", 4), *more], COLUMNS)


def test_a_search_reads_through_without_an_index(spark, monkeypatch):
    m = memories(spark)
    index = fulltext.build_index(m)
    monkeypatch.setattr(fulltext, "build_index", None)
    for query in ("t01 t1", "t01-t4", "t0", "zz", "t1 t1", "T01 or t02"):
        assert fulltext.bm25(m, query, 300).collect() == fulltext.bm25(m, query, 300, index=index).collect()
    few = fulltext.index_for(m, "t01 n7")
    assert few.totals.collect() == index.totals.collect()
    assert {tuple(r) for r in few.postings.collect()} == {tuple(r) for r in index.postings.where("term like 't01%' or term like 'n7%'").collect()}
    assert fulltext.bm25(m.where("false"), "t01", 5).count() == 0


def test_registered_searches_shuffle_no_terms(spark, monkeypatch):
    monkeypatch.setattr(fulltext, "build_index", None)
    for name in ("q_hybrid_rrf", "q_bm25_alternatives", "q_fts_fallback", "q_research_merge"):
        assert catalogue.queries()[name](spark, "/root/testdata/sf0.001").count() > 0


def test_postings_group_only_repeated_ids(spark):
    once, twice = memories(spark), memories(spark, [(3, "global", "note", "n3", "d", "t21 t21 new", None)])
    assert "Aggregate" not in fulltext.postings(once)._jdf.queryExecution().toString()
    got = {(r.term, r.id): r.tf for r in fulltext.postings(twice).collect()}
    assert len(got) == fulltext.postings(twice).count() and (got["t21", 3], got["n3", 3], got["new", 3]) == (3, 2, 1)
    changed = once.where("id < 100").selectExpr("id", "namespace", "type", "name", "description", "'edited' as body", "if(id = 5, 1L, deleted_at) as deleted_at")
    synced = {(r.term, r.id) for r in fulltext.sync_index(fulltext.postings(once), changed).collect()}
    assert ("edited", 4) in synced and not any(i == 5 for _, i in synced) and ("t00", 150) in synced and ("t28", 4) not in synced
