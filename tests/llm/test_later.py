import base64
import hashlib
import itertools
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tessellar.llm import byte_bpe, conversations, html_text, quality, queries, spelling

# Byte-level BPE.


@pytest.fixture(scope="module")
def bpe():
    import public_tokenizers as P

    return P.path("byte_bpe_50k.tiktoken"), P.PATTERN


def whole(path, pattern):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("whole", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_parts_have_the_ids_of_the_whole(bpe):
    rng, lib = random.Random(1), whole(*bpe)
    bits = ["a", "é", "'s", "'", " ", "  ", "\n", "\r\n", "\xa0", "\u2028", "\u2003", "\x1c", "\u180e", "7", "²", "-", "!?", "漢", "👍🏽", "'re", "the", "<|endoftext|>", "\x85"]
    coder = byte_bpe.ByteBpe(*bpe, part=3)
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 60)))
        # A text under the length of a run of blanks goes whole; parts are held to it apart from that.
        ids = lib.encode_ordinary(text)
        assert [int(i) for p in coder._parts(text) for i in p] == ids
        assert coder.decode(ids) == text.encode()


def test_long_blanks_and_long_texts(bpe):
    lib, coder = whole(*bpe), byte_bpe.ByteBpe(*bpe)
    for blank in (" ", "\n", "\t ", "\u3000", "\u2003\n", "\u1680"):
        for after in ("", "x", "\x1cx", "'s", "漢"):
            for before in ("", "a", "!"):
                text = before + blank * 6000 + after
                assert coder.encode(text).tolist() == lib.encode_ordinary(text), (blank, after, before)
    text = "word and, 12 ünits\n" * 20_000
    assert coder.encode(text).tolist() == lib.encode_ordinary(text)
    # The library gives up on this one.
    huge = "a" + " " * 1_000_000 + "b"
    assert coder.decode(coder.encode(huge).tolist()) == huge.encode()


def test_columns_of_ids_and_bytes(spark, documents, bpe):
    lib = whole(*bpe)
    rows = documents.select("doc_id", "text", "key", byte_bpe.token_ids(F.col("text"), *bpe).alias("ids")).withColumn("bytes", byte_bpe.decoded(F.col("ids"), *bpe)).collect()
    assert len(rows) == documents.count()
    for r in rows:
        assert r.ids == lib.encode_ordinary(r.text or "") and bytes(r.bytes) == (r.text or "").encode()
    assert documents.where("false").select(byte_bpe.token_ids(F.col("text"), *bpe)).count() == 0
    # Ids that end inside a character, null ids, and an id that is none.
    part = lib.encode_ordinary("👍")[:1]
    odd = spark.createDataFrame([(1, part), (2, None), (3, [])], "n int, ids array<int>").select("n", byte_bpe.decoded(F.col("ids"), *bpe).alias("b")).collect()
    assert [bytes(r.b) for r in sorted(odd)] == [lib.decode_bytes(part), b"", b""]
    with pytest.raises(Exception, match="KeyError|60000"):
        spark.createDataFrame([([60000],)], "ids array<int>").select(byte_bpe.decoded(F.col("ids"), *bpe)).collect()


def test_bpe_query_equals_the_library(spark, bpe):
    lib, sf = whole(*bpe), "/root/testdata/sf0.001"
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = lib.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), sha(" ".join(map(str, ids)).encode()), sha((r.text or "").encode())))
    assert sorted(map(tuple, queries.op11_byte_bpe(spark, sf).collect())) == sorted(want)


# Conversations.


def by_hand(rows):
    """The cheapest edits by trying all; rows (turn, role, text) in order."""
    seen, flags = set(), []
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        flags.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    inserts = ["", "u", "a", "ua", "au"]
    best = None
    options = []
    for (_, role, text), flag in zip(rows, flags):
        own = [("D", "", 3)]
        if flag not in ("blank", "duplicate"):
            more = flag == "truncated"
            own += [("K", role[:1] or "?", more), ("R", "u", 2 + more), ("R", "a", 2 + more)]
        options.append(own)
    for picks in itertools.product(*options):
        for gaps in itertools.product(inserts, repeat=len(rows) + 1):
            roles = gaps[0] + "".join(p[1] + g for p, g in zip(picks, gaps[1:]))
            if re.fullmatch("(s?(ua)+)?", roles):
                cost = sum(p[2] for p in picks) + 2 * sum(map(len, gaps))
                audit = "I" * len(gaps[0]) + "".join(p[0] + "I" * len(g) for p, g in zip(picks, gaps[1:]))
                if best is None or (cost, audit) < best[:2]:
                    names, said, k = {"u": "user", "a": "assistant"}, [names_of(x) for x in gaps[0]], 0
                    for (_, role, text), p, g in zip(rows, picks, gaps[1:]):
                        if p[0] != "D":
                            said.append((role if p[0] == "K" else names[p[1]], text))
                        said += [names_of(x) for x in g]
                    best = (cost, audit, said)
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, flags.count("blank"), flags.count("duplicate"), flags.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), *best)


def names_of(x):
    return ({"u": "user", "a": "assistant"}[x], "")


def test_repair_is_the_cheapest_of_all_edits(spark):
    rng, table, want = random.Random(7), [], {}
    roles, texts = ["user", "user", "assistant", "assistant", "system", "tool", " ", ""], ["One.", "Two!", "three", " ", "", "Four? \n", "five,\t"]
    for conv in [None, *range(70)]:
        rows = [(rng.choice([None, 0, 1, 2, 3, 9]), rng.choice(roles), rng.choice(texts)) for _ in range(rng.randint(1, 4))]
        table += [(conv, *r, True) for r in rows]
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        want[conv] = by_hand(rows)
    table += [(100, 1, "user", "Gone.", False), (101, 1, "user", "Gone.", False), (101, 2, "user", "Here.", True)]
    want[100], want[101] = (0, 0, 0, 0, 0, 0, "", []), by_hand([(2, "user", "Here.")])
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string, there boolean")
    # A segment of one row joins everything by the second fold.
    for segment in (256, 2, 1):
        got = {r.conv_id: (*r[1:8], [tuple(x) for x in r.repaired]) for r in conversations.repair(df, segment).collect()}
        assert got == want, segment
    assert conversations.repair(df.where("false")).count() == 0


def test_a_long_conversation(spark):
    rng = random.Random(3)
    table = [(5, i // 2, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "no", f"Turn {i}.", " "]), True) for i in range(3000)]
    table += [(6, None, "user", "Same.", True)] * 700
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string, there boolean").repartition(4)
    one, many = [sorted(map(str, conversations.repair(df, s).collect())) for s in (10_000, 64)]
    assert one == many and len(one) == 2


def test_damage(spark):
    rows = [(c, t, "assistant", "A. b!") for c in [None, *range(30)] for t in (None, 0, 1, 2)] + [(99, 1, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("there", F.lit("x")).withColumn("h", F.lit(1))
    want = []
    for c, t, role, text in rows:
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        h, role, text = zlib.crc32(key.encode()) % 20, role or " ", text or " "
        row = (c, t, "user" if h == 4 else role, "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text, h != 0)
        want += [row] * (2 if h == 3 else 1)
    assert sorted(map(str, (tuple(r) for r in conversations.damaged(df).collect()))) == sorted(map(str, want))


# Spelling variants.


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_letters_have_sums_of_their_own(spark):
    letters = [chr(c) for a, z in spelling.LETTERS for c in range(a, z + 1)]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in letters], "x string").select(spelling.letter_value(F.col("x"))).collect()]
    assert got == [(i + 1) ** 5 for i in range(90)]
    sums = [a + b for i, a in enumerate(got) for b in got[i:]]
    assert len(set(sums)) == len(sums)
    assert spark.sql("select 'cab' x").select(spelling.anagram_key(F.col("x"))).first()[0] == 1 + 32 + 243


def test_variants_by_hand(spark):
    rng = random.Random(5)
    words = {}
    for _ in range(60):
        w = "".join(rng.choice("abé") for _ in range(rng.randint(6, 9)))
        words[w] = rng.choice([5, 5, 6, 25, 26, 130, 700])
    words |= {"kettle": 1000, "ketle": 3, "kettel": 5, "kettlee": 200, "kettleé": 200, "kettl": 40, "kettls": 40, "kettlss": 8, "z" * 3000: 9, "z" * 2999 + "y": 45, "×ababab": 5}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    form, want = {}, []
    for w, n in words.items():
        others = sorted((-words[o], o) for o in words if near(w, o))
        form[w] = others[0][1] if others and -others[0][0] >= 5 * n else None
        want.append([w, form[w], w, n, len(others), words[form[w]] if form[w] else None])
    for row in want:
        while form[row[2]]:
            row[2] = form[row[2]]
    assert sorted(map(list, spelling.variants(df).collect()), key=str) == sorted(want, key=str)
    assert spelling.variants(df.where("false")).count() == 0


def test_no_side_of_the_vocabulary_is_broadcast(spark, monkeypatch):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    words = [(f"kettle{a}{b}", n) for a in "abc" for b, n in (("x", 5), ("y", 30), ("z", 200))]
    plans, kept = [], spelling.stored
    monkeypatch.setattr(spelling, "stored", lambda df, name: plans.append(plan(df)) or kept(df, name))
    out = spelling.variants(spark.createDataFrame(words, "word string, n long"))
    assert out.count() == len(words)
    plans.append(plan(out))
    # Near pairs, a round of roots or more, and the words with both.
    assert sum("SortMergeJoin" in p for p in plans) >= 3
    assert not any("Broadcast" in p for p in plans)


def test_occurrences(spark):
    texts = ["Kettle kettle KETTLE; ketTLÉ x kéttle's kettle2kettles", None, "", "word short", "aaaaaa" * 50_000, "×÷ÀÿÞß Āāāāāāā naïveté"]
    table = [(i, t, "clash") for i, t in enumerate(texts)] + [(0, texts[0], "clash"), (None, texts[0], "clash")]
    df = spark.createDataFrame(table, "doc_id long, text string, word string")
    want = []
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, t, _ in table:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            at = h % len(run)
            word = run[:at] + run[at + 1 :] if h % 3 == 0 else run
            want += [word] if len(word) >= 6 else []
    assert sorted(r.word for r in spelling.occurrences(df, noise=3).collect()) == sorted(want)


# Main text of pages, and the quality score by hand.

LONG = [f"Paragraph {k}, which is long enough, tells of this; and of that, too. It goes on, and on, for a while." for k in range(6)]
ARTICLE = "<article><h1>Head</h1>" + "".join(f"<p>{t}</p>" for t in LONG) + "</article>"


def read(body):
    return html_text.main_blocks(html_text.blocks_of(f"<html><body>{body}</body></html>"))


@pytest.mark.parametrize("name", ["layout has-sidebar", "no-sidebar content", "post with-comments", "page header-fixed", "cookie-recipes", "related-work", "hidden-xs", "recommended-reading", "banner", "comments", "top-menu"])
def test_a_wrapper_is_never_left_out_by_its_name(name):
    said = [f"Reader {k} says something long; and more of it, too. It goes on, and on, for quite a while, they say." for k in range(30)]
    junk = "".join(f'<div class="{c}">{"".join(f"<p>{t}</p>" for t in said)}</div>' for c in ("comments", "comment-list", "reader-comments thread", "ad-box", "sidebar2"))
    inner = f"{ARTICLE}{junk}"
    assert read(f'<nav><a href="/">x</a></nav><div class="{name}">{inner}</div><footer>f</footer>') == ["Head", *LONG]
    assert read(f'<div id="{name}"><div class="banner"><div>{inner}</div></div></div>') == ["Head", *LONG]
    # With neither a headline nor an article.
    plain = "<div>" + "".join(f"<p>{t}</p>" for t in LONG) + "</div>"
    assert read(f'<div class="{name}">{plain}</div><div class="ad">Buy, now. Or, then.</div>') == LONG


def test_names_by_their_head_nouns():
    out = "sidebar main-sidebar sidebarLeft comment-list ad ad-slot ads2 cookieNotice top_menu newsletter-form related-posts share-buttons page-footer"
    kept = "has-sidebar no-ads with-comments header-fixed cookie-recipes related-work hidden-xs recommended-reading show-menu commentary address adventure menus-of-rome toggle-nav content"
    assert all(html_text._says_junk(x) for x in out.split()) and not any(html_text._says_junk(x) for x in kept.split())
    assert not html_text._says_junk("") and not html_text._says_junk("- _ 12")


def test_the_ratios_take_away_what_no_name_does(spark):
    teasers = "".join(f"<section><h3>More {k}</h3><p>Read on</p></section>" for k in range(4)) + "<div><p>All rights reserved</p></div>"
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").where("html like '%</article>%'").collect():
        if len(html_text.blocks_of(r.html).blocks) < 6:
            # Too short an article is as teasers are.
            continue
        own = html_text.main_blocks(html_text.blocks_of(r.html))
        more = r.html.replace("</article>", f"</article>{teasers}")
        assert len(html_text._kept(html_text.blocks_of(more))) == len(html_text._kept(html_text.blocks_of(r.html))) + 9
        assert html_text.main_blocks(html_text.blocks_of(more)) == own


def test_deep_nesting_takes_linear_time():
    import time

    took = []
    for n in (10_000, 40_000):
        began = time.process_time()
        for page in ("<div>x" * n, "<ul><li>x" * n, "<p><b>" * n + "</i>" * n, "<div><span>x</b>" * n, "<div>" * n + "x" + "</div>" * n):
            html_text.main_blocks(html_text.blocks_of(page))
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0] and took[1] < 20
    assert read("<div>" * 500 + ARTICLE + "</div>" * 500) == ["Head", *LONG]


def test_the_score_is_that_of_the_rules_by_hand(spark, documents):
    rules = quality.RuleEnsemble(-0.3, ((1.5, (("n_words", True, 2.0), ("upper", False, 0.2))), (-2.25, (("stops", False, 0.05),)), (0.75, (("bangs", True, 0.0),)), (0.5, (("lines", True, 0.1), ("distinct", False, 0.9)))))
    more = spark.createDataFrame([(1, "A B! C? 1.\n#x", "en", "s", 1, 1, "k")], documents.schema)
    rows = quality.with_statistics(documents.unionByName(more)).withColumn("score", rules.score()).collect()
    for r in rows:
        text = r.text or ""
        words = re.findall(r"[^ \t\n\r\x0b\x0c]+", text)
        n, c = max(len(text), 1), max(len(words), 1)
        marks = re.sub(r"[^\W\d_]+|[ \t\n\r\x0b\x0c]+", "", text)
        held = {"n_words": math.log1p(len(words)), "upper": sum(x.isupper() for x in text) / n, "stops": marks.count(".") / c, "bangs": (marks.count("!") + marks.count("?")) / c, "lines": (text.count("\n") + 1) / c, "distinct": len(set(words)) / c}
        assert all(abs(r[k] - v) < 1e-12 for k, v in held.items())
        total = rules.intercept + sum(w for w, parts in rules.rules if all(held[s] > b if above else held[s] <= b for s, above, b in parts))
        assert abs(r.score - 1 / (1 + math.exp(-total))) < 1e-12
