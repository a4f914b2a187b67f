from collections import Counter, defaultdict

import numpy as np
import pytest

from tessellar.llm import line_dedup, near_duplicates, passages
from tessellar.llm.shingles import jaccard, shingle_set


def brute_classes(rows, threshold=0.8):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = Counter()
    for i in range(len(rows)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= threshold:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return Counter((d, low.get(find(i)), links[i]) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("bucket, block", [(64, 1024), (2, 4)])
def test_classes_equal_brute_force(documents, bucket, block):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got = near_duplicates.classes(documents, bucket=bucket, block=block).collect()
    assert Counter(map(tuple, got)) == brute_classes(rows)


def test_no_documents(documents):
    none = documents.where("false")
    assert near_duplicates.classes(none).count() == 0
    assert passages.repeated(none).count() == 0
    assert line_dedup.dedupe(none).count() == 0


def test_bands_reach_the_recall():
    for s in (0.5, 0.7, 0.8, 0.9):
        bands, rows = near_duplicates.bands_for(s, 0.999)
        assert bands * rows <= near_duplicates.MAX_HASHES
        assert 1 - (1 - s**rows) ** bands >= 0.999 or rows == 1


def brute_lines(rows, min_docs=3, min_chars=20):
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    held = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if d is not None and len(key(line)) >= min_chars:
                held[key(line)].add(d)
    out = Counter()
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or len(held[key(x)]) < min_docs or d == max(held[key(x)])]
        out[d, "\n".join(kept), len(lines), len(lines) - len(kept)] += 1
    return out


@pytest.mark.parametrize("batches, fanout", [(1, 4), (5, 2)])
def test_lines_equal_brute_force(documents, batches, fanout):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got = line_dedup.dedupe(documents, batches=batches, fanout=fanout)
    assert got.columns == [*documents.columns, "n_lines", "n_dropped"]
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()) == brute_lines(rows)


def test_runs_are_levelled_and_tell_new_lines(spark, documents):
    runs = line_dedup.LineRuns(spark, fanout=2)
    lines = line_dedup.line_hashes(documents)
    assert runs.unseen(lines).count() == lines.count()
    for b in range(3):
        runs.add(lines.where(f"doc_id % 3 = {b}"))
    assert [len(level) for level in runs.levels] == [1, 1]
    assert runs.unseen(lines).count() == 0
    whole = line_dedup.LineRuns(spark)
    whole.add(lines)
    assert sorted(map(tuple, runs.merged().collect())) == sorted(map(tuple, whole.merged().collect()))


def test_windows_are_the_wide_nodes_of_the_tree():
    rng = np.random.default_rng(1)
    for n, width in ((200, 46), (46, 46), (45, 46), (300, 7)):
        v = rng.integers(0, 40 if n == 300 else 1 << 60, n).astype(np.uint64)
        want = set()
        for c in range(n):
            lo = hi = c
            while lo > 0 and v[lo - 1] > v[c]:
                lo -= 1
            while hi < n - 1 and v[hi + 1] >= v[c]:
                hi += 1
            if hi - lo + 1 >= width:
                want.add((lo, c, hi))
        assert {tuple(x) for x in passages.compact_windows(v, width).tolist()} == want


def test_repeated_passages(documents):
    rows = [(r.doc_id, (r.text or "").lower().split()) for r in documents.collect() if r.doc_id is not None]
    runs = defaultdict(set)
    for d, w in rows:
        for i in range(len(w) - 49):
            runs[tuple(w[i : i + 50])].add(d)
    want = {d for d, w in rows if any(len(runs[tuple(w[i : i + 50])]) > 1 for i in range(len(w) - 49))}
    got = passages.repeated(documents).collect()
    assert want <= {r.doc_id for r in got}
    # Clean documents stay alone: all that is caught is a copy, a near copy or holds the passage.
    assert {r.doc_id for r in got} <= set(range(60, 85)) | {3} and 3 not in {r.doc_id for r in got}
    names = {(r.class_doc, r.class_start) for r in got}
    assert all(r.n_words >= 50 for r in got) and len(names) == 2


def edited(rng, w, kind, at):
    w = list(w)
    if kind == "insert":
        w[at:at] = [f"new{rng.integers(10**9)}" for _ in range(12)]
    elif kind == "delete":
        del w[at : at + 3]
    else:
        w[at] = f"new{rng.integers(10**9)}"
    return w


def edited_pairs():
    """(words, edited words) of passages of 50 to 200 words whose similarity is 0.8 or more."""
    rng = np.random.default_rng(2)
    for n in (50, 55, 60, 70, 80, 100, 200):
        w = [f"p{rng.integers(10**9)}" for _ in range(n)]
        for kind in ("change", "insert", "delete"):
            for at in range(0, n, 4):
                x = edited(rng, w, kind, at)
                if len(x) >= 50 and jaccard(shingle_set(" ".join(w)), shingle_set(" ".join(x))) >= 0.8:
                    yield w, x


def test_edited_passages_are_found_from_every_centre():
    from tessellar.llm.shingles import shingles

    rng = np.random.default_rng(3)
    around = lambda: [f"c{rng.integers(10**9)}" for _ in range(30)]
    seen = 0
    for w, x in edited_pairs():
        a, b = shingles(around() + w + around()), shingles(around() + x + around())
        for ca in np.flatnonzero(np.isin(a, b)).tolist():
            cb = int(np.flatnonzero(b == a[ca])[0])
            chain = passages.aligned(passages.shared_runs(a, b, np.argsort(b)), ca, cb, 0.8)
            got = passages.stretches(chain, ca, len(a), len(b), 0.8, 46)
            assert any(jaccard(np.unique(a[p[0] : p[1] + 1]), np.unique(b[q[0] : q[1] + 1])) >= 0.8 and min(p[1] - p[0], q[1] - q[0]) >= 45 and p[0] <= ca <= p[1] for p, q in got), (len(w), len(x), ca)
            seen += 1
    assert seen > 1000


def test_short_edited_copies_are_repeated(spark):
    pairs = list(edited_pairs())[::5]
    rows = [(2 * k + h, " ".join(p[h])) for k, p in enumerate(pairs) for h in (0, 1)]
    # A passage of one text and its edits share a class; windows of four functions may miss one pair in some hundreds.
    got = {r.doc_id for r in passages.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) >= 0.98 * len(rows)


def test_recall_of_edited_passages_by_length(spark):
    """Passages with as many changed words as the similarity allows, inside unlike texts: nine in ten are found at every length."""
    rng = np.random.default_rng(12)
    word = lambda: f"p{rng.integers(10**9)}"
    rows, pairs = [], []
    for n in (50, 55, 60, 80, 120):
        for k in range(40):
            w = [word() for _ in range(n)]
            x, gone = list(w), []
            for at in rng.permutation(np.arange(2, n - 2)).tolist():
                y = list(x)
                y[at] = word()
                if jaccard(shingle_set(" ".join(w)), shingle_set(" ".join(y))) >= 0.8:
                    x, gone = y, [*gone, at]
            assert gone
            for text in (w, x):
                before = [word() for _ in range(30)]
                rows.append((len(rows), " ".join([*before, *text, *[word() for _ in range(30)]])))
            pairs.append((n, len(rows) - 2))
    got = defaultdict(list)
    for r in passages.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r.doc_id].append(r)
    found = Counter()
    for n, i in pairs:
        a, b = got.get(i, []), got.get(i + 1, [])
        found[n] += any(x.class_doc == y.class_doc and x.start_word < 30 + n and x.start_word + x.n_words > 30 for x in a for y in b)
    print({n: found[n] / 40 for n in found})
    assert all(found[n] >= 36 for n in (50, 55, 60, 80, 120)), found


def test_passages_of_long_and_repetitive_texts(spark):
    rng = np.random.default_rng(13)
    long = [f"w{rng.integers(10**6)}" for _ in range(30_000)]
    near = [f"x{i}" if i % 997 == 0 else w for i, w in enumerate(long)]
    rows = [(1, " ".join(long), 0), (2, " ".join(near), 0), (3, "a " * 300, 0), (4, "a " * 400, 0), (5, "b c " * 100, 0), (5, "b c " * 100, 0), (6, "short " * 49, 0), (7, None, 0), (None, "a " * 300, 0)]
    got = defaultdict(list)
    for r in passages.repeated(spark.createDataFrame(rows, "doc_id long, text string, key int")).collect():
        got[r.doc_id].append((r.start_word, r.n_words, r.class_doc))
    assert sum(n for _, n, _ in got[1]) > 29_000 and {c for _, _, c in got[1]} == {1} == {c for _, _, c in got[2]}
    # Words that repeat: one shingle and one passage; a text's copies under one id are no repetition.
    assert {c for _, _, c in got[3]} == {3} == {c for _, _, c in got[4]} and not {5, 6, 7} & set(got)


@pytest.mark.parametrize("few, many", [(2, 4), (2, 10**6)])
def test_large_keys_lose_no_class(spark, documents, monkeypatch, few, many):
    """With small bounds every key is large: its classes are those of all pairs."""
    monkeypatch.setattr(passages, "MANY", many)
    monkeypatch.setattr(passages, "BLOCK", 4)
    want = {tuple(r) for r in passages.repeated(documents, few=10**6).collect()}
    got = {tuple(r) for r in passages.repeated(documents, few=few).collect()}
    assert {r[0] for r in got} == {r[0] for r in want} and {(r[0], r[3]) for r in got} == {(r[0], r[3]) for r in want}


def test_a_hot_line_loses_no_pair(spark, monkeypatch):
    """Pairs that meet only in the key of a line that all texts have: the other band does not agree where a word was changed."""
    monkeypatch.setattr(passages, "MANY", 4)
    monkeypatch.setattr(passages, "SLICE", 16)
    rng = np.random.default_rng(8)
    word = lambda: f"h{rng.integers(10**9)}"
    line, rows = [word() for _ in range(30)], []
    for k in range(40):
        w = [word() for _ in range(12)] + line + [word() for _ in range(12)]
        x = list(w)
        x[50] = word()
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(x))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {(r.doc_id, r.class_doc) for r in passages.repeated(df, bands=2, few=10**6).collect()}
    assert len(want) > 40 and {(r.doc_id, r.class_doc) for r in passages.repeated(df, bands=2, few=2).collect()} == want


def test_blocks_count_alike_in_both_ways():
    rng = np.random.default_rng(3)
    for _ in range(30):
        n, wide = int(rng.integers(2, 70)), 8
        base = rng.integers(0, 10**6, 60)
        s = []
        for _ in range(n):
            own = base[int(rng.integers(0, 20)) :].copy() if rng.random() < 0.7 else rng.integers(0, 200, int(rng.integers(wide, 60)))
            own[rng.random(len(own)) < 0.1] = rng.integers(0, 10**6)
            s.append(own.astype(np.uint64))
        sets = [np.unique(x) for x in s]
        flat, who = np.concatenate(sets), np.repeat(np.arange(n), [len(x) for x in sets])
        values, at, seen = np.unique(flat, return_inverse=True, return_counts=True)
        col = np.full(len(values), -1)
        col[seen > 1] = np.arange((seen > 1).sum())
        col = col[at]
        want = np.triu([[len(np.intersect1d(a, b)) for b in sets] for a in sets], 1)
        for columns in (0, 1 << 14):
            assert (np.triu(passages._shared_counts(col, who, n, 4, columns), 1) == want).all()
        centre = np.array([int(rng.integers(0, len(x))) for x in s])
        might = want >= wide // 2
        might |= might.T
        one, other = [passages._dense_pairs(col, who, s, sets, centre, might, 0.8, wide, dense) for dense in (0, 1 << 26)]
        assert (one == other).all()


def test_shingles_of_many_texts_are_those_of_each():
    """Words hashed many at once: a word has one hash wherever it stands, long ones and those beyond a piece included."""
    from tessellar.llm.shingles import shingles, shingles_of, word_hashes

    rng = np.random.default_rng(5)
    texts = [[f"wé{rng.integers(40)}" for _ in range(int(rng.integers(5, 90)))] for _ in range(20)] + [["é" * 20_000, "x" * 16_383, "x" * 16_384, "a", "b"] + [f"n{i}" for i in range(9000)]]
    for some in (texts, [["one"], [], *texts]):
        assert all((x == shingles(own, 5, word_hashes(own))).all() and len(x) == len(shingles(own)) for own, x in zip(some, shingles_of(some), strict=True))
    flat = [w for own in texts for w in own]
    found = dict(zip(flat, word_hashes(flat).tolist()))
    assert [found[w] for w in flat] == word_hashes(flat).tolist() and len(set(found.values())) == len(found)
    # Equal shingles in other texts and places: as the remembered hashes tell them.
    one, other = np.concatenate([shingles(own) for own in texts]), np.concatenate(shingles_of(texts))
    assert len(np.unique(one)) == len(np.unique(other)) == len(np.unique(np.stack([one, other], 1), axis=0))


def test_dense_at_some_places_is_dense_there():
    rng = np.random.default_rng(6)
    for _ in range(400):
        n, wide, share = int(rng.integers(1, 80)), int(rng.integers(1, 30)), float(rng.choice([0.75, 0.8, 8 / 9]))
        shared = rng.random(n) < rng.choice([0.5, 0.8, 0.9, 1.0])
        places = rng.integers(0, n, 5)
        want = passages._dense(shared, share, wide)[places]
        assert (passages._dense_at(shared, share, wide, places) == want).all()
        if n >= wide:
            # Rows of places that reach beyond their sizes, whatever lies there.
            rows = np.concatenate([np.tile(shared, (5, 1)), rng.random((5, 9)) < 0.5], 1)
            assert (passages._hold(rows, np.full(5, n), places, share, wide) == want).all()
