import json

from pyspark.sql import functions as F

from tessellar.operators import ingest, maintain
from tessellar.sources import files

STORE = "id long, namespace string, name string, type string, description string, body string, created_at long, updated_at long, deleted_at long"


def test_lines_are_numbered_without_sorting_them(spark, tmp_path, monkeypatch):
    want = []
    for k in range(3):
        rows = [json.dumps({"name": f"n{k}-{i}", "body": "b" * (i % 7)}) if i % 5 else "  " for i in range(k * 400)]
        (tmp_path / f"in-{k}.ndjson").write_text("\n".join(rows) + "\n")
        want += [r for r in rows if r.strip()]
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096b")
    try:
        sorted_way = maintain.numbered
        monkeypatch.setattr(maintain, "numbered", None)
        got = files.checked_lines(spark, str(tmp_path)).orderBy("line").collect()
        assert [(r.line, r.value) for r in got] == list(enumerate(want))
        monkeypatch.setattr(maintain, "numbered", sorted_way)
        monkeypatch.setattr(files, "BLOCKS", 2)
        assert files.checked_lines(spark, str(tmp_path)).orderBy("line").collect() == got
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_deciding_carries_no_bodies(spark, tmp_path):
    (tmp_path / "in.ndjson").write_text("\n".join(json.dumps({"name": n, "description": "d", "body": f"body of {n}", "entities": [{"name": "X y"}]}) for n in ("One", "Two", "one")))
    store = spark.createDataFrame([(7, "global", "two", "note", "d", "old", 1, 1, None)], STORE)
    out = ingest.decide(ingest.stage_lines(files.checked_lines(spark, str(tmp_path))), store, "global", force=True, lines=True)
    assert [(r.place, r.action, r.memory_id, r.body) for r in out.orderBy("place").collect()] == [(0, "created", 8, "body of One"), (1, "updated", 7, "body of Two"), (2, "updated", 8, "body of one")]
    # Who asks for the outcomes alone reads no line.
    plan = out.select("place", "status", "memory_id")._jdf.queryExecution().optimizedPlan()
    assert "from_json" not in plan.toString() and "jsontostructs" not in plan.toString().lower()
    entities = spark.createDataFrame([], "id long, namespace string, name string, type string")
    edges = spark.createDataFrame([], "namespace string, source_id long, target_id long, relation string, weight double")
    graph = ingest.persist(out, ingest.Tables(entities=entities, relationships=edges), "global", 5)
    assert graph.memories is None and [(r.id, r.name) for r in graph.entities.select("id", "name").collect()] == [(1, "x-y")] and graph.relationships.count() == 0
