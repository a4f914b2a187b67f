from tessellar.operators import maintain


def test_types_are_looked_up_only_where_asked(spark):
    edges = spark.createDataFrame([(1, 9, "related", 0.5), (2, 9, "related", 0.5), (1, 9, "supports", 0.1), (3, 9, "uses", 0.2), (4, 9, None, 0.3), (5, 9, "related", 0.4)], "source_id long, target_id long, relation string, weight double")
    entities = spark.createDataFrame([(1, "person"), (2, "tool"), (5, "person"), (9, "location")], "id long, type string")
    out = maintain.reclassify_relation(edges, entities, "related", "supports", source_type="person")
    assert sorted((r.source_id, r.relation or "") for r in out.collect()) == [(1, "supports"), (2, "related"), (3, "uses"), (4, ""), (5, "supports")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter, (target_id" not in plan and "location" not in plan
    both = maintain.reclassify_relation(edges, entities, "related", "supports", "person", "tool")
    assert sorted((r.source_id, r.relation or "") for r in both.collect()) == sorted((r.source_id, r.relation or "") for r in edges.collect())
    every = maintain.reclassify_relation(edges, entities, "related", "supports")
    assert sorted((r.source_id, r.relation or "") for r in every.collect()) == [(1, "supports"), (2, "supports"), (3, "uses"), (4, ""), (5, "supports")]
