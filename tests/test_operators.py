import pytest
from pyspark.sql import functions as F

from tessellar.functions import text as X
from tessellar.operators import chunking, fulltext, graph, maintain, queue, scans, search, shape, vector


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("raw, want", [("São Paulo", "sao-paulo"), ("CANONICAL_RELATIONS", "canonical-relations"), ("  hello  world  ", "hello-world"), ("Ünïcödé", "unicode")])
def test_entity_names(spark, raw, want):
    assert one(spark, X.normalize_entity_name(F.col("s")), s=raw) == want


@pytest.mark.parametrize("d, want", [(2.0, 0.0), (-0.5, 1.0), (float("nan"), 0.0), (0.25, 0.75)])
def test_score_clamps(spark, d, want):
    assert one(spark, X.score_from_distance(F.col("d")), d=d) == want


def test_hop_distances(spark):
    assert [round(r[0], 4) for r in spark.range(4).select(X.hop_distance(F.col("id"))).collect()] == [0.0, 0.5, 0.6667, 0.75]


@pytest.mark.parametrize("s, want", [("word", 2), ("a b c d", 6), ("", 0)])
def test_token_estimate(spark, s, want):
    assert one(spark, X.token_estimate(F.col("s")), s=s) == want


@pytest.mark.parametrize("s, want", [("Bug", "incident"), ("github-issue", "issue_tracker"), ("tool", "tool"), ("whatever", "concept")])
def test_entity_types(spark, s, want):
    assert one(spark, X.canonical_entity_type(F.col("s")), s=s) == want


@pytest.mark.parametrize("s, want", [("Depends-On", "depends_on"), ("creates", "causes"), ("odd", "related")])
def test_relations(spark, s, want):
    assert one(spark, X.canonical_relation(F.col("s")), s=s) == want


@pytest.mark.parametrize("q, n, want", [("danilo", "danilo-x", 0.95), ("dan", "danilo", 0.88), ("danilo-x", "danilo", 0.80), ("guiar", "aguiar", 0.82), ("same", "Same", 1.0)])
def test_name_similarity(spark, q, n, want):
    assert one(spark, X.entity_name_similarity(q, F.col("n")), n=n) == want


def test_jaro_winkler_against_duckdb(duck):
    for a, b in [("martha", "marhta"), ("dixon", "dicksonx"), ("abc", "xyz"), ("jellyfish", "smellyfish")]:
        want = duck.execute("select jaro_winkler_similarity(?, ?)", [a, b]).fetchone()[0]
        assert X._jaro_winkler(a, b) == pytest.approx(want)


def test_urls_with_byte_offsets(spark):
    got = one(spark, X.extract_urls(F.col("s")), s="é http://a.b/c) and https://x>y z")
    assert [(u.url, u.start, u.end) for u in got] == [("http://a.b/c", 3, 15), ("https://x>y", 21, 32)]
    assert one(spark, X.extract_urls(F.col("s")), s="none") == []


def test_chunks_cover_and_overlap():
    body = "word " * 1000
    spans = chunking.chunk_spans(body)
    assert spans[0][0] == 0 and spans[-1][1] == len(body)
    assert all(b - a <= 800 for a, b in spans) and all(s2 < e1 for (_, e1), (s2, _) in zip(spans, spans[1:]))
    assert chunking.chunk_spans("short") == [(0, 5)] and chunking.chunk_spans("") == [(0, 0)]
    assert "".join(chunking.sections("# a\nx\n# b\ny\n", 8)) == "# a\nx\n# b\ny\n"
    many = chunking.chunk_spans("é" * 3000)
    assert all(("é" * 3000).encode()[a:b].decode() is not None for a, b in many)


def test_token_windows(spark):
    text = " ".join(f"w{i}" for i in range(460))
    got = one(spark, chunking.token_windows(F.col("s")), s=text)
    assert [len(x.split()) for x in got] == [400, 110]


def test_query_language():
    assert fulltext.parse_query('foo AND "bar*"') == fulltext.Match(("foo", "bar"), True)
    assert fulltext.parse_query("a-b c") == fulltext.Match(("a", "b", "c"), False, ("a", "b", "c"))
    assert fulltext.parse_query(" () ").terms == ()


def test_bm25_is_accent_insensitive(spark):
    m = spark.createDataFrame([(1, "g", "n", "note", "", "São Paulo café", None), (2, "g", "m", "note", "", "other text", None)], "id long, namespace string, name string, type string, description string, body string, deleted_at long")
    assert [r.id for r in fulltext.bm25(m, "sao cafe", 5).collect()] == [1]
    assert fulltext.bm25(m, "AND", 5).count() == 0
    index = fulltext.postings(m)
    assert fulltext.check_index(index, m).count() == 0
    assert {r.problem for r in fulltext.check_index(index, m.where("id = 1")).collect()} == {"stale"}


def edges(spark, rows):
    return spark.createDataFrame([("g", *r) for r in rows], "namespace string, source_id long, target_id long, relation string, weight double")


def seeds(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id long")


def test_walk(spark):
    e = edges(spark, [(1, 2, "r", 0.3), (2, 3, "r", 0.9), (1, 3, "r", 0.29), (3, 1, "r", 0.8), (3, 4, "s", 0.5)])
    got = {r.id: r.hop for r in graph.hops(graph.neighbours(e, floor=0.3), seeds(spark, 1), 3).collect()}
    assert got == {1: 0, 2: 1, 3: 2, 4: 3}
    assert {r.id for r in graph.hops(graph.neighbours(e), seeds(spark, 1), 1).collect()} == {1, 2, 3}
    walked = {r.id: r for r in graph.walk(graph.neighbours(e, floor=0.3), seeds(spark, 1), 3).collect()}
    assert walked[4].path == [1, 2, 3, 4] and walked[4].product == pytest.approx(0.3 * 0.9 * 0.5)
    capped = graph.walk(graph.neighbours(e), seeds(spark, 1), 1, cap=1)
    assert {r.id for r in capped.collect()} == {1, 2}
    back = graph.hops(graph.neighbours(e, bidirectional=True, relation="s"), seeds(spark, 4), 2)
    assert {r.id: r.hop for r in back.collect()} == {4: 0, 3: 1}


def test_self_loop_counts_once(spark):
    assert graph.degrees(edges(spark, [(1, 1, "r", 1.0), (1, 2, "r", 1.0)])).orderBy("id").collect() == [(1, 2), (2, 1)]


def test_decompose():
    assert search.decompose("what that caused outages") == [("what", "decomposed"), ("outages", "decomposed")]
    assert search.decompose("a; b") == [("a", "decomposed"), ("b", "decomposed")]
    assert search.decompose("alpha and beta") == [("alpha", "decomposed"), ("beta", "decomposed")]
    assert search.decompose("long words here now") == [("long words here now", "original"), ("long words", "decomposed"), ("here now", "decomposed")]
    assert search.decompose("word", 3) == [("word", "original"), ("word patrimonio", "aspect"), ("word stack", "aspect")]
    assert search.decompose("a b") == [("a b", "original")] and search.decompose("") == [("", "original")]


def test_filter_grammar(spark):
    assert shape.parse_filter("a.b != c") == ("a.b", "!=", "c") and shape.parse_filter("a==b") == ("a", "=", "b")
    df = spark.createDataFrame([("x", None), ("y", "Note"), ("y", "note")], "k string, t string")
    assert shape.shape(df, ["missing = 1"]).count() == 0 and shape.shape(df, ["missing != 1"]).count() == 3
    assert shape.shape(df, ["t ~ NOTE"]).count() == 2 and shape.shape(df, ["t = "]).count() == 1
    assert shape.shape(df, dedupe="t").count() == 3 and shape.shape(df, dedupe="k").count() == 2
    assert shape.truncate_strings(df, 2).where("t = 'No'").count() == 1


def test_queue_transitions(spark):
    q = spark.createDataFrame([(1, "g", "A", "k1", "pending", 0, 7, 0), (2, "g", "A", "k2", "processing", 1, 8, 0), (3, "g", "A", "k3", "dead", 0, 1, 0)], "id long, namespace string, operation string, item_key string, status string, priority int, attempt int, claimed_at long")
    new = spark.createDataFrame([(9, "g", "A", "k3", 5), (10, "g", "A", "k4", 0)], "id long, namespace string, operation string, item_key string, priority int")
    after = {r.item_key: r.status for r in queue.enqueue(q, new).collect()}
    assert after == {"k1": "pending", "k2": "processing", "k3": "dead", "k4": "pending"}
    failed = {r.id: r.status for r in queue.fail(q, spark.createDataFrame([(1, "e", False), (2, "e", False)], "id long, error string, hard boolean"), 100).collect()}
    assert failed == {1: "pending", 2: "dead", 3: "dead"}
    assert {r.id: r.status for r in queue.mark_done(q, seeds(spark, 2)).collect()}[2] == "done"
    assert {r.id: r.status for r in queue.reset_stale(q, 5000).collect()}[2] == "pending"


def test_versions_shrink(spark):
    v = spark.createDataFrame([(1, 1, "n", "abcdef", "create", 0), (1, 2, "n", "ab", "edit", 1)], "memory_id long, version long, name string, body string, change_reason string, created_at long")
    assert [(r.added, r.removed) for r in scans.history(v).orderBy("version").collect()] == [(6, 0), (0, 4)]
    assert {(r.added, r.removed) for r in scans.history(v, with_bodies=False).collect()} == {(0, 0)}


def test_entity_merge_drops_loops_and_duplicates(spark):
    e = edges(spark, [(1, 2, "r", 0.5), (3, 2, "r", 0.9), (1, 3, "r", 0.1), (2, 3, "r", 0.2)])
    ents = seeds(spark, 1, 2, 3)
    bridge = spark.createDataFrame([(7, 1), (7, 3)], "memory_id long, entity_id long")
    left, merged, b = maintain.merge_entities(ents, e, bridge, [3], 1)
    assert {r.id for r in left.collect()} == {1, 2}
    assert {(r.source_id, r.target_id, r.weight) for r in merged.collect()} == {(1, 2, 0.9), (2, 1, 0.2)}
    assert [tuple(r) for r in b.collect()] == [(7, 1)]


def test_embedder_is_a_unit_vector(spark):
    v = vector.hashed_vector("Some text, some words", 64)
    assert sum(x * x for x in v) == pytest.approx(1.0) and vector.hashed_vector("", 8)[0] == 1.0
    assert len(spark.createDataFrame([("a b",)], ["t"]).select(vector.embed_text(32)("t").alias("e")).first().e) == 32


def test_files(spark, tmp_path):
    from tessellar.sources import files
    from tessellar.streaming import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in/My Note.md").write_text("# T\nA line that is long enough to describe.\n")
    (tmp_path / "in/my_note.md").write_text("x")
    planned = {r.name: r.description for r in files.plan_ingest(files.text_tree(spark, str(tmp_path / "in"))).collect()}
    assert set(planned) == {"my-note", "my-note-1"} and "A line that is long enough to describe." in planned.values()
    (tmp_path / "b").mkdir()
    (tmp_path / "b/x.ndjson").write_text('{"name":"m1","body":"b","entities":[{"name":"Big Tool","type":"tool"}],"relationships":[{"from":"Big Tool","to":"Other One","relation":"depends-on"}]}\n')
    lines = files.batch_lines(spark, str(tmp_path / "b"))
    ents, rels = files.graph_input(lines)
    assert [(r.name, r.type) for r in ents.collect()] == [("big-tool", "tool")]
    assert [(r.source, r.target, r.relation, r.weight) for r in rels.collect()] == [("big-tool", "other-one", "depends_on", 0.5)]
    seen = []
    q = ingest.into(ingest.batch_stream(spark, str(tmp_path / "b")), lambda df, n: seen.append(df.count()), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert seen == [1]
    n = spark.createDataFrame([(1, "a b", "tool"), (2, "c", "tool")], "id long, name string, type string")
    e = edges(spark, [(1, 2, "uses", 0.5), (1, 9, "uses", 0.5)])
    assert files.graph_snapshot(n, e)[1].first().dangling == 1
    assert {r.value for r in files.graph_lines(n, e, "mermaid").collect()} == {'  a_b["a b"]', '  c["c"]', "  a_b -->|uses| c"}


def test_fuzzy_entities_and_chains_take_all_rows(spark):
    from types import SimpleNamespace

    from tessellar.plans import catalogue

    entities = spark.createDataFrame([(2000001, "nation-1"), (3000001, "nation-1x"), (5000001, "nation-1"), (5000002, "part-77")], "id long, name string")
    got = catalogue.fuzzy_entities(SimpleNamespace(entities=entities)).collect()
    assert {r.id for r in got} == {2000001, 3000001, 5000001}
    walked = spark.range(50).select("id", F.lit(2).alias("hop"), F.array(F.lit(1), F.lit(2), "id").alias("path"), F.lit(0.5).alias("product"))
    assert graph.chains(walked, None).count() == 50 and graph.chains(walked).count() == 20


def test_hybrid_keeps_to_its_namespaces(spark):
    rows = [(i, ns, f"n{i}", "note", "", "some words here", None) for i, ns in enumerate(["a", "b", "c"], 1)]
    m = spark.createDataFrame(rows, "id long, namespace string, name string, type string, description string, body string, deleted_at long")
    e = spark.createDataFrame([(i, [1.0, float(i)]) for i in (1, 2, 3)], "memory_id long, embedding array<float>")
    for own, want in (((), {1, 2, 3}), (("a",), {1}), (("a", "b"), {1, 2})):
        assert {r.id for r in search.hybrid(m, e, [1.0, 1.0], "words", 5, namespaces=own).collect()} == want


def brute_names(files, taken):
    taken, out = set(taken), {}
    for path, base in sorted(files):
        name, n = base, 0
        while name in taken:
            n += 1
            name = f"{base}-{n}"
        out[path] = name
        taken.add(name)
    return out


@pytest.mark.parametrize(
    "files, taken",
    [
        ([("1", "a"), ("2", "a-1"), ("3", "a")], []),
        ([("1", "a")], ["a", "a-2"]),
        ([("1", "a"), ("2", "a"), ("3", "a")], ["a-1", "a-3"]),
        ([("1", "a-1"), ("2", "a"), ("3", "a"), ("4", "a-1"), ("5", "b")], ["a"]),
        ([(f"{i:03}", "x" if i % 3 else "x-2") for i in range(30)], ["x-5", "x-01", "x-2-1", "x-7"]),
    ],
)
def test_unique_names(spark, files, taken):
    from tessellar.sources import files as f

    used = spark.createDataFrame([(t,) for t in taken], "name string") if taken else None
    got = {r.path: r.name for r in f.unique_names(spark.createDataFrame(files, "path string, base string"), used).collect()}
    assert len(set(got.values())) == len(got) and not set(got.values()) & set(taken)
    assert got == brute_names(files, taken)


def test_remember_numbers_and_reasons(spark):
    m = spark.createDataFrame([(5, "g", "old", "x", None, 1, 1)], "id long, namespace string, name string, body string, deleted_at long, created_at long, updated_at long")
    v = spark.createDataFrame([(5, 1, "old", "x", "create", 1)], "memory_id long, version long, name string, body string, change_reason string, created_at long")
    new = spark.createDataFrame([("g", n, n) for n in ("z", "old", "b", "a")], "namespace string, name string, body string")
    memories, versions = maintain.remember(m, v, new, 9)
    assert {r.name: (r.id, r.body, r.created_at) for r in memories.collect()} == {"old": (5, "old", 1), "a": (6, "a", 9), "b": (7, "b", 9), "z": (8, "z", 9)}
    assert {(r.memory_id, r.version, r.change_reason) for r in versions.collect()} == {(5, 1, "create"), (5, 2, "edit"), (6, 1, "create"), (7, 1, "create"), (8, 1, "create")}


def test_normalised_entities_merge(spark):
    ents = spark.createDataFrame([(1, "g", "Big Tool", "tool"), (2, "g", "big-tool", "tool"), (3, "g", "Other", "tool")], "id long, namespace string, name string, type string")
    e = edges(spark, [(2, 3, "r", 0.5), (1, 3, "r", 0.9), (1, 2, "r", 0.1)])
    bridge = spark.createDataFrame([(7, 1), (7, 2), (8, 2)], "memory_id long, entity_id long")
    kept, merged, b = maintain.normalized(ents, e, bridge)
    assert {(r.id, r.name) for r in kept.collect()} == {(1, "big-tool"), (3, "other")}
    assert [(r.source_id, r.target_id, r.weight) for r in merged.collect()] == [(1, 3, 0.9)]
    assert {tuple(r) for r in b.collect()} == {(7, 1), (8, 1)}


def test_resolve_needs_a_lead(spark):
    from tessellar.operators import resolve

    names = lambda *n: spark.createDataFrame(list(enumerate(n)), "id int, name string")
    assert [r.name for r in resolve.resolve(names("alpha", "beta"), "alpha").collect()] == ["alpha"]
    # Two names that begin alike are no answer; one alone is.
    assert resolve.resolve(names("alpha-x", "alpha-y"), "alpha").count() == 0
    assert [r.name for r in resolve.resolve(names("alphabet", "zzz"), "alpha").collect()] == ["alphabet"]
    assert resolve.resolve(names("zzz"), "alpha").count() == 0
