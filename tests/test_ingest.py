"""Ingest, chunks, budgets and runs, each against a plain version that takes rows one by one."""

import json
import os
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tessellar.functions import text as X
from tessellar.operators import chunking, fulltext, graph, ingest, queue, shape
from tessellar.plans import catalogue
from tessellar.sources import files
from tessellar.streaming.ingest import Store, into, line_stream

SF = "/root/testdata/sf0.001"


# Chunks.


def test_markdown_chunks_of_all_documents(spark):
    rows = catalogue.queries()["q_markdown_chunks"](spark, SF).collect()
    bodies = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    by = {}
    for r in rows:
        by.setdefault(r.memory_id, []).append(r)
    assert set(by) == {i for i, t in bodies.items() if t}
    for i, own in by.items():
        data, own = bodies[i].encode(), sorted(own, key=lambda r: r.chunk_idx)
        # No headings, rules or fences stand in these: blocks, lines, sentences and words part.
        levels = [r"\n(?:[ \t]*\n)+", r"\n", r"[.!?…][\"')\]]*[ \t]+", r"[^\S\n]+"]
        ends = [sorted({m.end() for m in re.finditer(p, bodies[i])} - {len(bodies[i])}) for p in levels]
        at, start, stop = [], 0, 0
        while stop < len(bodies[i]):
            full = start + chunking.CHUNK
            stop = len(bodies[i]) if full >= len(bodies[i]) else next((max(e) for e in ([x for x in e if stop < x <= full] for e in ends) if e), full)
            at.append((start, stop))
            low = max(stop - chunking.OVERLAP, start + 1)
            start = next((min(e) for e in ([x for x in e if low <= x < stop] for e in ends) if e), low)
        want = [(len(bodies[i][:a].encode()), len(bodies[i][:b].encode())) for a, b in at]
        assert [(r.start_offset, r.end_offset) for r in own] == want
        assert all(r.chunk_text.encode() == data[r.start_offset : r.end_offset] and len(r.chunk_text) <= chunking.CHUNK for r in own)


def test_markdown_levels():
    body = "intro text here.\n\n# One\nalpha beta. gamma delta.\n\n## Two\n```\n# no heading\n\nstill code\n```\nafter\n\n---\nlast words é漢 " + "x" * 50
    cuts = lambda size, overlap=0: [body.encode()[a:b].decode() for a, b in chunking.markdown_spans(body, size, overlap)]
    assert cuts(200) == [body]
    assert cuts(90)[:3] == ["intro text here.\n\n", "# One\nalpha beta. gamma delta.\n\n", "## Two\n```\n# no heading\n\nstill code\n```\nafter\n\n---\n"]
    assert cuts(16)[2:4] == ["# One\n", "alpha beta. "]
    for size, overlap in ((7, 3), (20, 5), (60, 20), (10, 0)):
        spans = chunking.markdown_spans(body, size, overlap)
        assert spans[0][0] == 0 and spans[-1][1] == len(body.encode())
        assert all(a < b and len(body.encode()[a:b].decode()) <= size for a, b in spans)
        assert all(a < c <= b < d and len(body.encode()[c:b].decode()) <= overlap for (a, b), (c, d) in zip(spans, spans[1:]))
    assert chunking.markdown_spans("") == [] and chunking.markdown_spans("a") == [(0, 1)]


def test_plain_chunks_of_all_documents(spark):
    rows = catalogue.queries()["q_chunks"](spark, SF).collect()
    bodies = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    by = {}
    for r in rows:
        by.setdefault(r.memory_id, []).append((r.chunk_idx, r.start_offset, r.end_offset))
    for i, own in by.items():
        data, own = bodies[i].encode(), sorted(own)
        assert own[0][1] == 0 and own[-1][2] == len(data)
        for (_, a, b), (_, c, _) in zip(own, own[1:]):
            window = data[a : min(a + chunking.CHUNK, len(data))]
            while window and b - a <= len(window) and window[-1] & 0xC0 == 0x80:
                window = window[:-1]
            mark = next((m for m in (b"\n\n", b". ", b" ") if m in data[a : a + chunking.CHUNK]), None)
            assert mark is None or data[a:b].endswith(mark) or b - a >= chunking.CHUNK - 4
            assert a < c <= b and b - c <= chunking.OVERLAP


def test_offsets_and_windows(spark):
    rng = random.Random(2)
    texts = [None, "", " ", "one", " é  漢字 x\n", "a" * 5000] + ["".join(rng.choice(["w", "é", "漢", " ", "\n", " ", "  "]) for _ in range(rng.randint(1, 900))) for _ in range(30)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("i", "t", chunking.token_offsets(F.col("t"), "p: ").alias("o")).withColumn("w", chunking.token_spans(F.col("o"), F.concat(F.lit("p: "), F.coalesce("t", F.lit(""))), 40, 5)).collect()
    for r in got:
        text = "p: " + (texts[r.i] or "")
        want = [(len(text[: m.start()].encode()), len(text[: m.end()].encode())) for m in re.finditer(r"[^\s\x1c-\x1f]+", text)]
        assert [tuple(x) for x in r.o] == want
        windows, k = [], 0
        while True:
            end = min(k + 40, len(want))
            windows.append((len(windows), 0 if k == 0 else want[k][0], len(text.encode()) if end == len(want) else want[end - 1][1], end - k))
            if end == len(want):
                break
            k = end - 5
        assert [tuple(w) for w in r.w] == windows
    lengths = spark.createDataFrame([([],), ([5],), (list(range(1000)),)], "x array<int>").select("x", chunking.running_sum(F.col("x")).alias("s")).collect()
    assert all(r.s == [sum(r.x[: i + 1]) for i in range(len(r.x))] for r in lengths)


def test_sections_of_long_bodies(spark):
    body = "lead\n" + "".join(f"{'#' * (i % 7)} part {i}\n{'é word ' * (i * 20)}\n" for i in range(40))
    for limit in (100, 1000, 10_000, 10**6):
        parts = chunking.sections(body, limit)
        assert "".join(parts) == body and all(len(p.encode()) <= limit for p in parts)
    one = spark.createDataFrame([(1, body), (2, "short"), (3, "")], "id long, body string")
    got = {r.id: r for r in chunking.budget(one, 1000).collect()}
    assert got[1].partitions == len(chunking.sections(body, 1000)) and got[1].exceeds and not got[2].exceeds and got[3].bytes == 0


# Ingest.


def one_by_one(rows, store, force):
    """Outcomes of files (name, body) in order, against a store of {name: (id, body)}."""
    store, top, out = dict(store), max([i for i, _ in store.values()], default=0), []
    for name, body in rows:
        if not body.strip():
            out.append(("failed", None, "empty_body", None))
        elif name in store:
            if force:
                store[name] = (store[name][0], body)
            out.append(("indexed", "updated", None, store[name][0]) if force else ("skipped", None, "duplicate_name", None))
        elif any(b == body for _, b in store.values()):
            out.append(("skipped", None, "duplicate_body", None))
        else:
            top += 1
            store[name] = (top, body)
            out.append(("indexed", "created", None, top))
    return out, store


def test_outcomes_are_those_of_one_file_after_another(spark):
    rng = random.Random(11)
    for force in (True, False):
        for _ in range(4):
            names = [f"n{i:02d}" for i in range(40)]
            store = {n: (i + 1, rng.choice("abcdef")) for i, n in enumerate(rng.sample(names, 12))}
            rows = [(n, rng.choice(["a", "b", "c", "d", "e", "f", "g", "h", " "])) for n in names]
            memories = spark.createDataFrame([(i, "global", n, b, None) for n, (i, b) in store.items()] + [(99 - 50, "other", "n00", "g", None), (40, "global", "gone", "h", 5)], "id long, namespace string, name string, body string, deleted_at long")
            planned = spark.createDataFrame([(n, n, "about", b) for n, b in rows], "path string, name string, description string, body string").repartition(3)
            got = ingest.decide(ingest.stage_files(planned), memories, "global", force).orderBy("place").collect()
            want, _ = one_by_one(rows, store, force)
            new = {w[3]: i for i, w in enumerate(want) if w[1] == "created"}
            ids = sorted(new)
            # Ids follow the largest of any namespace and state.
            want = [(s, a, r, 49 + 1 + ids.index(m) if a == "created" else m) for s, a, r, m in want]
            assert [(r.status, r.action, r.reason, r.memory_id) for r in got] == want


def test_staging_rules(spark):
    big = "# a\n" + "x" * 90_000 + "\n# b\n" + "y" * 90_000
    rows = [("p1", "ok", "d", "body"), ("p2", "x" * 81, "d", "b"), ("p3", "__in", "d", "b"), ("p4", "Bad_Name", "d", "b"), ("p5", "ok", "d", "é" * 256_001), ("p6", "ok", "d", " \n "), ("p7", "ok", "é" * 251, "b"), ("p8", "n" * 79, "d", big), ("p9", "long", "d" * 499, big), ("p0", None, "d", None)]
    df = spark.createDataFrame(rows, "path string, name string, description string, body string")
    got = ingest.stage_files(df).orderBy("path", "part").collect()
    why = {r.path: r.reason for r in got}
    assert why == {"p0": "name_not_kebab", "p1": None, "p2": "name_too_long", "p3": "reserved_name", "p4": "name_not_kebab", "p5": "body_too_large", "p6": "empty_body", "p7": "description_too_long", "p8": "part_name_too_long", "p9": None}
    parts = [r for r in got if r.path == "p9"]
    assert [r.name for r in parts] == [f"long-part-{i + 1}" for i in range(len(parts))] and "".join(r.body for r in parts) == big
    assert len(parts) == 4 and all(len(r.description.encode()) <= 500 and r.description.endswith(f"(part {r.part}/4)") for r in parts)
    assert ingest.decide(ingest.stage_files(df), spark.createDataFrame([(1, "ns", "n", "b", None)], "id long, namespace string, name string, body string, deleted_at long"), "new", most=1).where("status <> 'failed' or reason is null").count() == 0


def lines_of(folder, batches):
    for k, rows in enumerate(batches):
        path = folder / f"in-{k}.ndjson"
        path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")
        # A stream takes files in order of their times.
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))


def test_bad_lines_stand_beside_good_ones(spark, tmp_path):
    lines_of(tmp_path, [[{"name": "One", "body": "b", "entities": [{"name": "X"}]}, "", "{broken", {"body": "nameless"}, {"name": "Two", "body": 5}, {"name": "Three", "body": {"no": 1}}]])
    got = files.checked_lines(spark, str(tmp_path)).orderBy("line").collect()
    assert [(r.line, r.error) for r in got] == [(0, None), (1, "invalid JSON"), (2, "missing name"), (3, None), (4, None)] or [r.error for r in got][:3] == [None, "invalid JSON", "missing name"]
    assert {r.name for r in files.batch_lines(spark, str(tmp_path)).collect()} >= {"One"} and files.batch_lines(spark, str(tmp_path)).where("name is null").count() == 0
    assert files.batch_lines(spark, str(tmp_path)).first().type == "note"


def test_a_stream_that_stops_and_starts_again(spark, tmp_path):
    folder, state, seen = tmp_path / "in", str(tmp_path / "state"), str(tmp_path / "seen")
    folder.mkdir()
    long = "A sentence of some words. " * 60
    lines_of(folder, [[{"name": "One", "description": "d", "body": long, "entities": [{"name": "Tool A", "type": "tool"}], "relationships": [{"from": "Tool A", "to": "Idea", "relation": "uses", "weight": 0.4}]}, "{bad"], [{"name": "Two", "description": "d", "body": "see http://x.org/a"}, {"name": "one", "body": "short now"}], [{"name": "Three"}, {"name": "Two", "description": "d", "body": "again", "entities": [{"name": "Idea", "type": "person", "description": "an idea"}]}]])
    store = Store(spark, state)
    merge, stops = store.merge("global", lambda batch: 1000 + batch, force=True), {1}

    def failing(lines, batch):
        merge(lines, batch)
        if batch in stops:
            # All is written, and the stream has not heard of it.
            stops.discard(batch)
            raise RuntimeError("lost")

    def run():
        q = into(line_stream(spark, str(folder), 1), failing, seen)
        q.awaitTermination()

    with pytest.raises(Exception, match="lost"):
        run()
    run()
    assert {(r.status, r.action): r.n for r in store.tally().collect()} == {("indexed", "created"): 2, ("indexed", "updated"): 2, ("failed", None): 2}
    now = store.tables()
    assert {(r.id, r.name, r.body, r.created_at, r.updated_at) for r in now.memories.collect()} == {(1, "one", "short now", 1000, 1001), (2, "two", "again", 1001, 1002)}
    assert sorted((r.memory_id, r.version, r.change_reason) for r in now.versions.collect()) == [(1, 1, "create"), (1, 2, "edit"), (2, 1, "create"), (2, 2, "edit")]
    # The long body's chunks went with it; URLs are those of new memories.
    assert now.chunks.count() == 0 and store.table("chunks", before=1).count() > 1
    assert [tuple(r) for r in now.urls.collect()] == [(2, "http://x.org/a", 4)]
    assert {(r.name, r.type, r.description) for r in now.entities.collect()} == {("tool-a", "tool", None), ("idea", "person", "an idea")}
    ids = {r.name: r.id for r in now.entities.collect()}
    assert [(r.source_id, r.target_id, r.relation, r.weight) for r in now.relationships.collect()] == [(ids["tool-a"], ids["idea"], "uses", 0.4)]
    assert {tuple(r) for r in now.bridge.collect()} == {(1, ids["tool-a"]), (2, ids["idea"])}
    run()
    assert store.outcomes().count() == 6


# Search.


def test_an_index_prunes_by_term(spark):
    rows = [(i, "global", "note", f"n{i}", "d", " ".join(f"t{(i * 7 + j) % 50:02d}" for j in range(20)), None) for i in range(200)] + [(500, "global", "note", "", "", "", None), (501, "other", "note", "x", "gone t01", "b", 4)]
    m = spark.createDataFrame(rows, "id long, namespace string, type string, name string, description string, body string, deleted_at long")
    index = fulltext.build_index(m)
    assert index.totals.first().asDict() == {"n": 201, "tokens": 200 * 22}
    held = {(r.term, r.id): r.tf for r in index.postings.collect()}
    assert held == {(r.term, r.id): r.tf for r in fulltext.postings(m).collect()}
    plan = fulltext.bm25(m, "t01 t1", 5, index=index)
    assert plan.count() == 5 and "body" not in plan._jdf.queryExecution().toString()
    read = index.postings.where(F.col("term").startswith("t01"))._jdf.queryExecution().toString()
    assert "StringStartsWith(term,t01)" in read


# Runs, budgets, pairs and values.


def test_breaker_over_ranges(spark):
    rng = random.Random(9)
    rows = [(op, i, rng.random() < p) for op, p in (("a", 0.9), ("b", 0.5), ("c", 1.0), ("d", 0.0)) for i in range(400)] + [("e", 1, None)]
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = {(r.operation, r.seq): r.open for r in queue.breaker(spark.createDataFrame(rows, "operation string, seq long, hard boolean"), 5).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    run, last, want = 0, None, {}
    for op, i, hard in rows:
        run = (run if op == last else 0) + 1 if hard else 0
        last, want[op, i] = op, run >= 5
    assert got == want


def test_budget_by_ranges(spark):
    rng = random.Random(1)
    rows = [(i, "é" * rng.randint(0, 30)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, t string").repartition(7)
    side = spark.createDataFrame([(i,) for i in range(20)], "x long")
    enc = lambda v: len(json.dumps(v, separators=(",", ":"), ensure_ascii=False).encode())
    items, others = [{"id": i, "t": t} for i, t in rows], [{"x": i} for i in range(20)]
    for limit in (0, 10, 40, 150, 300, 1000, 5000, 10**6):
        got = shape.fit(df, [F.col("id")], limit, {"q": "é"}, {"side": side})
        envelope = lambda n, s: enc({"q": "é", "items": items[:n], "side": s})
        if limit == 0 or envelope(500, others) <= limit:
            want, kept, stub = 500, 20, False
        else:
            kept = 20 if envelope(0, others) <= limit else 0
            stub = envelope(0, others[:kept]) > limit
            want = 0 if stub else max(n for n in range(501) if envelope(n, others[:kept]) <= limit)
        assert (got.rows.count(), got.secondary["side"].count(), got.stub) == (want, kept, stub), limit
        assert sorted(r.id for r in got.rows.collect()) == list(range(want)) and got.dropped == 500 - want + 20 - kept


def test_pairs_of_a_memory_with_very_many_entities(spark):
    rows = [(1, e) for e in range(700)] + [(2, e) for e in range(0, 700, 100)] + [(3, 5), (3, 5), (4, 100), (4, 200)]
    df = spark.createDataFrame(rows, "memory_id long, entity_id long")
    got = {(r.a, r.b): r.n for r in graph.shared_memories(df, 32).collect()}
    want = {(a, b): 1 + (a % 100 == b % 100 == 0) for a in range(700) for b in range(a + 1, 700)}
    want[100, 200] += 1
    assert got == want


def test_json_values(spark):
    texts = ['{"a":{"b":2}}', '{"a":{"b":10.5}}', '{"a":{"b":"10"}}', '{"a":{"b":"9"}}', '{"a":{"b":null}}', '{"a":{"b":[1]}}', '{"a":1}', "{}", '{"a":{"b":true}}', '{"a":{"b":2}}', '{"a.b":7}', "[1]"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("v", F.parse_json("t"))
    order = lambda **how: [r.i for r in shape.json_shape(df, "v", ["i"], **how).collect()]
    assert order(sort="a.b") == [0, 9, 1, 4, 2, 3, 8, 5, 6, 7, 10, 11]
    assert order(sort="a.b", descending=True)[:3] == [1, 0, 9] and order(sort="a.b", limit=2) == [0, 9]
    assert sorted(order(dedupe="a.b")) == [0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 11]
    assert sorted(order(filters=["a.b = 2"])) == [0, 9] and sorted(order(filters=["a.b ~ 1"])) == [1, 2] and 4 not in order(filters=["a.b ="])[1:]
    assert set(order(filters=["a.b != 2"])) == set(range(12)) - {0, 9}


def test_ascii_forms_of_all_characters(spark):
    codes = [c for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    rows = [("".join(map(chr, codes[i : i + 64])),) for i in range(0, len(codes), 64)] + [(None,), ("",)]
    for r in spark.createDataFrame(rows, "t string").select("t", X.ascii_form(F.col("t")).alias("a")).collect():
        want = None if r.t is None else "".join(x for x in unicodedata.normalize("NFKD", r.t) if x.isascii())
        assert r.a == want
