"""Files in and out, limits and plain rules that no registered query covers."""

import json

import pytest
from pyspark.sql import functions as F

from tessellar.functions import text as X
from tessellar.operators import backlog, fulltext, graph, search
from tessellar.sources import files


def written(folder):
    return [line for p in sorted(folder.glob("part-*")) for line in p.read_text().splitlines()]


def test_drawings_are_whole(spark, tmp_path):
    entities = spark.createDataFrame([(i, f"node {i}", "tool") for i in range(40)], "id long, name string, type string")
    edges = spark.createDataFrame([(i, (i * 7 + 1) % 40, "uses", 0.5) for i in range(40)] + [(1, 99, "uses", 0.1)], "source_id long, target_id long, relation string, weight double")
    for form in ("dot", "mermaid", "ndjson"):
        files.write_graph(entities, edges, str(tmp_path / form), form)
        lines = written(tmp_path / form)
        head, foot = files.FRAME[form]
        assert lines[: len(head)] == head and (not foot or lines[-1:] == foot) and len(lines) == len(head) + 80 + len(foot)
        body = lines[len(head) : len(lines) - len(foot)]
        is_edge = [("->" in x or "-->" in x or '"kind":"edge"' in x) for x in body]
        assert is_edge == [False] * 40 + [True] * 40


def test_exports_are_in_order_and_limited(spark, tmp_path):
    rows = [(i, f"m{i * 7919 % 1000:03d}", "note", "b", 5 if i % 10 == 0 else None) for i in range(300)]
    m = spark.createDataFrame(rows, "id long, name string, type string, body string, deleted_at long").repartition(5)
    files.export_ndjson(m, str(tmp_path / "out"), 100)
    names = [json.loads(x)["name"] for x in written(tmp_path / "out")]
    assert names == sorted(r[1] for r in rows if r[4] is None)[:100]
    files.backup({"m": m}, str(tmp_path / "safe"))
    assert spark.read.parquet(str(tmp_path / "safe" / "m")).count() == 300


def test_lists_and_parts_keep_the_order_of_their_files(spark, tmp_path):
    (tmp_path / "names.txt").write_text("# names\nzeta\n\n alpha \nzeta\n#x\nmid\n")
    assert [r.name for r in files.name_list(spark, str(tmp_path / "names.txt")).collect()] == ["zeta", "alpha", "mid"]
    assert search.manual_parts(spark, str(tmp_path / "names.txt"), 3) == [("zeta", "manual"), ("alpha", "manual"), ("zeta", "manual")]
    (tmp_path / "none.txt").write_text("\n# nothing\n")
    with pytest.raises(ValueError):
        search.manual_parts(spark, str(tmp_path / "none.txt"))


def test_prefixes(spark):
    assert files.checked_prefix("team-") == 60 and files.checked_prefix("a" * 70) == 10
    for bad in ("", "Team", "9a", "a_b", "a" * 80):
        with pytest.raises(ValueError):
            files.checked_prefix(bad)
    one = spark.createDataFrame([("x/Über Uns.md", "Body text.")], "path string, body string")
    assert files.plan_ingest(one, prefix="t-").first().name == "t-uber-uns"
    with pytest.raises(ValueError):
        files.plan_ingest(one, prefix="T")


def test_descriptions_in_bytes(spark):
    texts = ["", "a" * 600, "é" * 600, "a" + "漢" * 400, "👍" * 200, "short", "x" * 487, "é" * 243 + "z"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.partition_description(F.col("t"), F.lit(12), F.lit(34)).alias("d"))
    for r in df.collect():
        base = r.t
        while len((base + " (part 12/34)").encode()) > 500:
            base = base[:-1]
        assert r.d == base + " (part 12/34)"


def test_expansion_and_limits(spark):
    m = spark.createDataFrame([(i, "g", "note", f"n{i}", "d", f"word{i % 2} body", None) for i in range(6)], "id long, namespace string, type string, name string, description string, body string, deleted_at long")
    e = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(4)], "memory_id long, embedding array<float>")
    own = spark.createDataFrame([(70, [0.0, 1.0]), (80, [1.0, 0.0])], "entity_id long, embedding array<float>")
    bridge = spark.createDataFrame([(0, 10), (4, 20), (5, 71)], "memory_id long, entity_id long")
    edges = spark.createDataFrame([(10, 20, "uses", 0.9), (70, 71, "uses", 0.9), (80, 71, "uses", 0.1)], "source_id long, target_id long, relation string, weight double")
    hits, more = search.hybrid_expanded(m, e, edges, bridge, [1.0, 0.0], "word0", 1, own)
    assert [r.id for r in hits.collect()] == [0] and [(r.id, r.hop) for r in more.collect()] == [(4, 1), (5, 1)]
    assert search.hybrid_expanded(m, e, edges, bridge, [1.0, 0.0], "word0", 1, own, most=1)[1].count() == 1
    nothing = search.hybrid_expanded(m.where("false"), e, edges, bridge, [1.0, 0.0], "word0", 1, own)[1]
    assert nothing.count() == 0
    with pytest.raises(LookupError):
        search.recall(m, e.where("memory_id > 1"), edges, bridge, [1.0, 0.0], 2, max_distance=0.1)
    assert search.recall(m, e, edges, bridge, [1.0, 0.0], 2, max_distance=0.1).count() >= 2
    for bad in (0, 4097):
        with pytest.raises(ValueError):
            search.check_k(bad)


def test_candidates_first_search_finds_what_a_join_finds(spark):
    from tessellar.operators import vector

    m = spark.createDataFrame([(i, "rare" if i % 97 == 0 else "g", "note", None if i % 5 else 7) for i in range(1000)], "id long, namespace string, type string, deleted_at long")
    e = spark.createDataFrame([(i, [1.0, i / 1000]) for i in range(1000)], "memory_id long, embedding array<float>")
    ids = lambda **how: [r.id for r in vector.memory_knn(e, m, [1.0, 0.0], 5, **how).orderBy("distance", "id").collect()]
    assert ids() == [1, 2, 3, 4, 6] and ids(live_after_k=True) == [1, 2, 3, 4]
    # Few of the nearest are wanted ones.
    assert ids(namespaces=("rare",)) == [97, 194, 291, 388, 582] and ids(namespaces=("none",)) == []


def test_quality_estimate_by_hand(spark):
    entities = spark.createDataFrame([(1, "alpha tool of searching"), (2, "unrelated words entirely"), (3, None)], "id long, description string")
    bridge = spark.createDataFrame([(1, i) for i in range(8)] + [(2, 0)], "entity_id long, memory_id long")
    memories = spark.createDataFrame([(i, f"body {i} tells of the alpha tool used for searching texts" if i >= 3 else "something else that fills the page well, and goes on for many more of its lines and sentences", i, i, None) for i in range(8)], "id long, body string, updated_at long, created_at long, deleted_at long")
    row = backlog.quality_estimate(entities, bridge, memories).first()
    # The five recent bodies speak of the first entity; none does of the second.
    assert row.sampled == 2 and row.accept_rate == 0.5 and row.quality == round(row.accept_rate * 0.5 + row.mean_score * 0.5, 6)
    assert backlog.ordered_operations(["ReEmbed", "BodyEnrich", "EntityConnect", "EntityDescriptions", "MemoryBindings"]) == ["MemoryBindings", "EntityDescriptions", "BodyEnrich", "ReEmbed", "EntityConnect"]


def test_an_empty_index(spark):
    m = spark.createDataFrame([], "id long, namespace string, type string, name string, description string, body string, deleted_at long")
    assert fulltext.bm25(m, "word", 5).count() == 0
    one = spark.createDataFrame([(1, 2)], "memory_id long, entity_id long")
    assert graph.shared_memories(one).count() == 0


def test_large_tables_are_not_dealt_anew(spark):
    from tessellar import storage

    df = spark.range(100).repartition(2)
    assert storage.spread(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size, parts in (("600m", 2), ("1g", 2), ("512m", 4), ("1048576", 4), ("2048kb", 4)):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            assert storage.spread(df).rdd.getNumPartitions() == parts
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
