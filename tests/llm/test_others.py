import numpy as np
import pytest
from pyspark.sql import functions as F

from tessellar.llm import common, decontaminate, html_text, neighbours, quality, url_filter

SF = "/root/testdata/sf0.001"


def test_components(spark):
    rng = np.random.default_rng(2)
    rows = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1060)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    root = {x: x for e in rows for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in rows:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for a, b in rows if a != b for x in (a, b)}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.classify(docs, labels)
    assert rows.count() == docs.count()
    met = rows.where("held_out").join(labels, "doc_id").select(F.avg((F.col("predicted") == F.col("quality")).cast("double")), F.min("score"), F.max("score")).first()
    assert met[0] >= 0.95 and 0 <= met[1] <= met[2] <= 1


def test_quality_edges(spark, documents):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    rows = quality.classify(documents, labels).collect()
    assert len(rows) == documents.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality.accepted(documents, labels.where("false")).columns == documents.columns
    assert quality.classify(documents.where("false"), labels).count() == 0
    tree = "DecisionTree\n  If (feature 0 <= 1.5)\n   If (feature 2 <= 0.5)\n    Predict: 0.0\n   Else (feature 2 > 0.5)\n    Predict: 1.0\n  Else (feature 0 > 1.5)\n   Predict: 1.0\n"
    assert quality.tree_paths(tree) == {(("n_words", False, 1.5),), (("n_words", True, 1.5),), (("n_words", False, 1.5), ("upper", False, 0.5)), (("n_words", False, 1.5), ("upper", True, 0.5))}


PAGE = """<html><body><div id="header">Site</div><div class="menu"><a href=x>Home</a></div><div class="content"><h2>Title here</h2>
<p>First &amp; foremost, with <b>bold</b>
 text. It goes on, and on.<p>Second: it is long enough, too. Really.</div><div class="sidebar"><p>Related, stuff. Long text, quite long, yes.</p></div>
<div class="comments"><p>Reader says: nice post, really, good.</p></div><div class="cookie-notice">We use cookies.</div><form><p>Mail</p></form><script>var t="<p>x</p>";</script><footer>&copy; x</footer></body></html>"""


def test_main_text(spark):
    rows = [(1, "u", PAGE), (2, "u", None), (3, None, ""), (4, "u", "<p>Only a short one"), (None, "u", "<article><h1>T</h1><p>a < b & c</p><aside>no</aside></article>"), (1, "u", PAGE)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    main = "Title here\nFirst & foremost, with bold text. It goes on, and on.\nSecond: it is long enough, too. Really."
    assert [r.text for r in got] == [main, "", "", "Only a short one", "T\na < b & c", main]
    assert all(r.n_chars == len(r.text) for r in got) and got[4].page_id is None


def test_main_text_is_chosen_by_the_ratios():
    long = [f"Paragraph {k}, which is long enough, tells of this; and of that, too. It goes on, and on, for a while." for k in range(6)]
    read = lambda body: html_text.main_blocks(html_text.blocks_of(f"<html><body>{body}</body></html>"))
    ps = "".join(f"<p>{t}</p>" for t in long)
    # A card beside the text is an article, and the text is none.
    for card in ("<article><p>Read more</p></article>", "<main><div><p>Read more</p></div></main>", "<article><h3>Card</h3></article>"):
        assert read(f"{card}<div>{ps}</div>") == long and read(f"<div>{ps}</div>{card}") == long
    # No article at all, and a headline in the element.
    assert read(f"<div><h1>Head</h1>{ps}</div><ul><li>a</li><li>b</li></ul>") == ["Head", *long]
    # A tenth of the text, or less, in another wrapper.
    more = "".join(f"<p>{t}</p>" for t in long * 3)
    assert read(f"<div><div>{more}</div><section><p>{long[0]}</p></section></div>") == [*long * 3, long[0]]
    assert read(f"<article><h1>Head</h1>{ps}</article><div><p>Short</p></div>") == ["Head", *long]


def test_only_what_is_named_is_left_out():
    long = [f"Paragraph {k}, which is long enough, tells of this; and of that, too. It goes on, and on, for a while." for k in range(4)]
    ps = "".join(f"<p>{t}</p>" for t in long)
    kept = "".join(f'<p class="{c}">The {c}, which belongs to it.</p>' for c in ("byline", "legal", "toc", "survey", "tags", "login", "video"))
    lost = "".join(f'<div class="{c}"><p>Some {c}, a long one; with marks, and more of them. Yes.</p></div>' for c in ("ad", "top-menu", "cookieNotice", "sidebar", "comments", "newsletter"))
    got = html_text.main_blocks(html_text.blocks_of(f"<body><div>{kept}{ps}{lost}</div></body>"))
    assert got == [*(f"The {c}, which belongs to it." for c in ("byline", "legal", "toc", "survey", "tags", "login", "video")), *long]


def test_a_page_without_marks_or_with_one_very_long_block(spark):
    words = "word " * 200_000
    rows = [(1, "u", f"<body><div><p>{words}</p></div></body>", "x", 1), (2, "u", "<p>one</p><p>two</p>", "y", 2)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    assert [r.n_chars for r in html_text.extract(df).collect()] == [len(words) - 1, 7]
    assert html_text.extract(df.where("false")).count() == 0


def test_urls(spark):
    rules = [url_filter.Rule("block", "com", "/en/"), url_filter.Rule("allow", "example.com", "/en/7"), url_filter.Rule("block", "", "/")]
    urls = ["http://A.Example.com/en/71?x", "https://com/en/", "http://xexample.com/en/8#a", "http://example.comx/en/7", "nothing", None, "://", "http://best-pills.org/x", "http://x.org?/en/"]
    pages = spark.createDataFrame([(i, u, "extra") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    for literal in (100, 0):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, rules[:2], literal_rules=literal).collect()}
        assert got[0] == ("a.example.com", "/en/71", "example.com/en/7", "allow")
        assert got[1][2:] == ("com/en/", "block") and got[2] == ("xexample.com", "/en/8", "com/en/", "block")
        assert got[3][2:] == (None, "allow") and got[4] == got[5] == ("", "", None, "allow") and got[6][:2] == ("", "")
        assert got[7][2:] == (None, "block") and got[8] == ("x.org", "", None, "allow")
    assert {r.page_id for r in url_filter.judge_urls(pages, rules).where("rule = '/'").collect()} == {3, 7}
    assert url_filter.judge_urls(pages.where("false"), rules).count() == 0


def test_long_and_repeated_urls(spark):
    rules = [url_filter.Rule("block", "com", "/en/"), url_filter.Rule("allow", "com", "/en/a")]
    long = "http://x.com/en/b" + "a/" * 100_000
    rows = [(1, long), (1, long), (2, "http://x.com/en/a"), (2, "http://x.com/en/a")]
    got = url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()
    assert sorted((r.page_id, r.verdict, len(r.path)) for r in got) == [(1, "block", 200_005), (1, "block", 200_005), (2, "allow", 5), (2, "allow", 5)]


def test_overlap_ties_go_to_the_leftmost(spark):
    item = [f"w{i}" for i in range(20)]
    docs = spark.createDataFrame([(1, " ".join(["x", *item, "y", *item])), (1, " ".join(["x", *item, "y", *item])), (None, " ".join(item))], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item)), (1, " ".join(item)), (1, " ".join(item[:15]))], "item_id long, text string")
    assert sorted((tuple(r) for r in decontaminate.overlaps(docs, bench).collect()), key=str) == [(1, 1, 1, 20, 20), (None, 1, 0, 20, 20)]


def test_overlaps(spark, documents):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
    near = list(item)
    near[4] = near[11] = "other"
    texts = [(1, "x y " + " ".join(item) + " z"), (2, "Q " + " ".join(near).upper() + "!"), (3, " ".join(item[:12])), (4, "short item here"), (5, None), (6, " ".join(item[:13]))]
    docs = spark.createDataFrame([(i, t, "e") for i, t in texts], "doc_id long, text string, words string").unionByName(documents.select("doc_id", "text", F.col("key").alias("words")).where("doc_id > 20"))
    bench = spark.createDataFrame([(7, " ".join(item)), (8, "Short, item"), (9, None), (10, ""), (None, "x y z")], "item_id long, text string")
    want = {(1, 7, 2, 20, 20), (2, 7, 1, 20, 18), (4, 8, 0, 2, 2), (6, 7, 0, 13, 13)}
    for limit in (10**6, 0):
        assert {tuple(r) for r in decontaminate.overlaps(docs, bench, broadcast_seeds=limit).collect()} == want
    assert decontaminate.overlaps(docs, bench.where("false")).count() == 0 and decontaminate.overlaps(docs.where("false"), bench).count() == 0
    long = " ".join(f"t{i}" for i in range(300))
    got = decontaminate.overlaps(spark.createDataFrame([(1, "a b " + long)], "doc_id long, text string"), spark.createDataFrame([(1, long)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.n_words) for r in got] == [(1, 1, 300)]


def test_masks_hit_every_pattern_of_four_fifths():
    from itertools import combinations

    longest = max(map(len, decontaminate.MASKS))
    for n in range(longest, 26):
        for k in range(n // 5 + 1):
            for gone in combinations(range(1, n - 1), k):
                equal = [i not in gone for i in range(n)]
                assert any(all(equal[at + i] for i, c in enumerate(m) if c == "1") for m in decontaminate.MASKS for at in range(n - len(m) + 1)), (n, gone)
    # Shorter items have no changed word at four fifths.
    assert longest // 5 <= 1 and (longest - 1) // 5 == 0


def brute_overlaps(docs, items, need=13):
    """(doc_id, item_id): every diagonal and run compared, without seeds."""
    out = set()
    for d, t in docs:
        for i, w in items:
            for diag in range(-len(w) + 1, len(t)):
                same = [p for p in range(len(w)) if 0 <= diag + p < len(t) and t[diag + p] == w[p]]
                if any(q - p + 1 >= min(need, len(w)) and (y - x + 1) * 5 >= (q - p + 1) * 4 for x, p in enumerate(same) for y, q in enumerate(same) if q >= p):
                    out.add((d, i))
    return out


def test_overlaps_equal_a_comparison_without_seeds(spark):
    rng = np.random.default_rng(8)
    items = [(n, [f"i{n}w{k}" for k in range(n)]) for n in (3, 5, 6, 8, 10, 11, 12, 13, 15, 20, 40, 64)]
    docs = []
    for n, w in items:
        for k in range(12):
            part = list(w)
            gone = range(k % 5, n, 5) if k < 5 else rng.choice(n, min(n, n // 5 + int(k % 4 == 3)), replace=False)
            for at in gone:
                part[at] = f"x{len(docs)}y{at}"
            docs.append((len(docs), ["before", *part, "after"]))
    frame = lambda rows, name: spark.createDataFrame([(i, " ".join(w)) for i, w in rows], f"{name} long, text string")
    want = brute_overlaps(docs, items)
    assert {(r.doc_id, r.item_id) for r in decontaminate.overlaps(frame(docs, "doc_id"), frame(items, "item_id")).collect()} == want and 40 < len(want) < len(docs)


def brute_nearest(rows, k=5):
    out = {}
    fine = {i: np.array(e, float) for i, e in rows if i is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)}
    for q, v in fine.items():
        if q % 50 == 0:
            c = [(-(v @ w) / (np.linalg.norm(v) * np.linalg.norm(w)), i) for i, w in fine.items() if i != q and len(w) == len(v)]
            out[q] = [i for _, i in sorted((round(s, 10), i) for s, i in c)[:k]]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(16).tolist()) for i in range(400)] + [(1000 + i, [1.0] * 16) for i in range(120)]
    rows += [(2000, None), (2050, [0.0] * 16), (2100, [float("nan")] * 16), (2150, [1.0, None] * 8), (None, [1.0] * 16), (2200, [1.0, 2.0]), (2201, [2.0, 1.0]), (3, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = {}
    for r in neighbours.nearest(df, df.where("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    want = brute_nearest(rows)
    assert set(got) == set(want) and got[1000] == {1: 1001, 2: 1002, 3: 1003, 4: 1004, 5: 1005} and got[2200] == {1: 2201}
    hits = [len(set(v.values()) & set(want[q])) / len(want[q]) for q, v in got.items()]
    assert sum(hits) / len(hits) >= 0.9
    assert neighbours.nearest(df.where("false"), df.where("false")).count() == 0
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    found = neighbours.nearest(table, table.where("vec_id % 50 = 0"))
    assert found.count() == 5 * table.where("vec_id % 50 = 0").count()


def test_neighbours_of_multiples_are_the_smallest_ids(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal(16)
    rows = [(i, (base * (i + 1) * 0.37).tolist(), "x") for i in range(400)] + [(1000 + i, rng.standard_normal(16).tolist(), "y") for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, direction string")
    got = {}
    for r in neighbours.nearest(df, df.where("vec_id in (0, 50, 399)"), k=6).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
        assert abs(r.score - 1) < 1e-9
    assert {q: [v for _, v in sorted(x)] for q, x in got.items()} == {0: [1, 2, 3, 4, 5, 6], 50: [0, 1, 2, 3, 4, 5], 399: [0, 1, 2, 3, 4, 5]}


def test_neighbours_in_many_cells(spark):
    """Clusters over more cells than one: a query reaches the cells where its nearest lie."""
    rng = np.random.default_rng(6)
    middles = rng.standard_normal((40, 16)) * 3
    rows = [(i, (middles[i % 40] + rng.standard_normal(16)).tolist()) for i in range(1600)] + [(5000, [1.0, 2.0]), (5050, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(df, df.where("vec_id % 50 = 0"), block=128).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    want = brute_nearest(rows)
    assert set(got) == set(want) and got[5050] == {1: 5000}
    hits = [len(set(v.values()) & set(want[q])) / len(want[q]) for q, v in got.items()]
    assert sum(hits) / len(hits) >= 0.9


def test_neighbours_scores_are_of_the_rows_own_vectors(spark):
    """Rows of one direction: each score is, to the last digit, the cosine of the two rows; very large and small components, too."""
    rng = np.random.default_rng(8)
    base = rng.standard_normal((30, 16))
    rows = [(i, (base[i % 30] * (1 + i * 0.37)).tolist()) for i in range(300)] + [(400 + i, (base[i] * 10.0 ** (60 * i - 180)).tolist()) for i in range(7)]
    rows += [(500, (base[3] * 1e300).tolist()), (550, (base[3] * 1e-300).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    own = {i: np.array(e) for i, e in rows}
    found = neighbours.nearest(df, df.where("vec_id % 50 = 0")).collect()
    assert len(found) == 5 * sum(i % 50 == 0 for i in own)
    for r in found:
        assert r.score == neighbours.cosines(own[r.query_id][None], own[r.vec_id][None])[0]
        u, v = (x / np.abs(x).max() for x in (own[r.query_id], own[r.vec_id]))
        assert abs(r.score - u @ v / (np.linalg.norm(u) * np.linalg.norm(v))) < 1e-15 * 16
    assert {r.vec_id for r in found if r.query_id == 550} == {3, 33, 63, 93, 123}


def test_neighbours_without_clusters(spark):
    """Nothing is near: queries go on over many cells in rounds, each cell once."""
    rng = np.random.default_rng(9)
    rows = [(i, rng.standard_normal(16).tolist()) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(df, df.where("vec_id % 50 = 0"), block=64).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = brute_nearest(rows)
    assert set(got) == set(want) and all(len(set(v)) == 5 for v in got.values())
    assert np.mean([len(set(v) & set(want[q])) / 5 for q, v in got.items()]) >= 0.9


def test_chi_square():
    from math import exp

    x = np.array([0.5, 3.0, 20.0, np.inf])
    assert np.allclose(neighbours.chi_square(x, 2), [1 - exp(-v / 2) for v in x])


def test_pipeline(spark):
    pipe = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [docs.count()]
    for _, stage in pipe.STAGES[:-1]:
        docs = common.stored(stage(spark, docs, SF), "t")
        assert set(docs.columns) == {"doc_id", "text", "lang", "source", "n_chars"}
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > counts[0] / 2
    rows = pipe.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_pipeline_stages_equal_brute_force(spark, documents, tmp_path):
    """Lines, duplicates and leaks by row: ids that repeat or are null, clashing columns, equal rows."""
    import random
    from collections import Counter

    from test_duplicates import brute_lines

    from tessellar.llm.shingles import jaccard, shingle_set

    pipe = pytest.importorskip("corpus_pipeline")
    rng = random.Random(9)
    some = lambda n: " ".join(f"v{rng.randrange(10**6)}" for _ in range(n))
    leak, copy, other = some(30), some(60), some(40)
    spark.createDataFrame([(1, leak), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [
        (1, copy), (2, copy), (None, copy), (2, other), (3, f"{some(20)} {leak} {some(9)}"), (3, some(35)), (None, f"{leak}"), (None, some(33)), (4, ""), (4, ""), (5, None),
        (6, some(25)), (7, copy + " x"), (8, other), (8, other),
    ]
    rows += [(20 + i, f"{some(12)}\nA line of some length that is in many.\n{some(9)}") for i in range(5)]
    table = [(i, t, f"s{k % 3}", k, "row", "gone") for k, (i, t) in enumerate(rows)]
    docs = spark.createDataFrame(table, "doc_id long, text string, source string, id int, row string, n_lines string")

    lines = pipe.drop_lines(spark, docs.drop("n_lines").withColumn("n_chars", F.length("text").cast("long")), str(tmp_path))
    want = brute_lines(rows)
    assert Counter((r.doc_id, r.text) for r in lines.collect()) == Counter({(d, t): n for (d, t, _, _), n in want.items()})

    kept = pipe.drop_near_duplicates(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    sets = [shingle_set(t) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if jaccard(sets[a], sets[b]) >= 0.8:
                group = [group[b] if g == group[a] else g for g in group]
    best = {}
    for k, (i, t) in enumerate(rows):
        if len(sets[k]):
            best[group[k]] = min(best.get(group[k], (True, 0)), (i is None, i or 0)) if group[k] in best else (i is None, i or 0)
    ids = Counter((None if n else i) for n, i in best.values()) + Counter(i for k, (i, _) in enumerate(rows) if not len(sets[k]))
    assert Counter(r.doc_id for r in kept.collect()) == ids

    clean = pipe.drop_benchmark_leaks(spark, docs, str(tmp_path))
    assert clean.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in clean.collect()) == Counter((i, t) for i, t in rows if leak not in (t or ""))
    for stage in (pipe.drop_lines, pipe.drop_near_duplicates, pipe.drop_benchmark_leaks):
        none = docs.drop("n_lines").withColumn("n_chars", F.lit(0).cast("long")).where("false")
        assert stage(spark, none, str(tmp_path)).count() == 0
