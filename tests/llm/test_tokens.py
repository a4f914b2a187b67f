import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessellar.llm import packing, token_files
from tessellar.llm.queries import tokenizer_path
from tessellar.llm.tokenize import FastEncoder

ODD = ["", " ", "a  b\n\n c \n", "don't we'll\t x ΣΑΣ İstanbul é 日本 語 123,45 <|endoftext|> \x1c a\x85b", " lead", "trail ", "x \n y", "½ x² ª º_a_b __ it'll 'S 12a\t", "naïve's CAFÉ’s", "Ünïcödé ### %%% word!!", "<|startoftext|>a<|endoftext|> <|ENDOFTEXT|> b", "<|endoftext|>", " " * 1_000_000, "x" + "\n" * 1_000_000 + "y"]


@pytest.fixture(scope="module", params=["byte_bpe_50k.json", "word_bpe_49k.json"])
def encoder(request):
    return FastEncoder(tokenizer_path(request.param)), request.param


def reference(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(name))
    return lambda s: t.encode(s or "", add_special_tokens=False).ids


def test_ids_are_the_librarys(encoder, documents):
    enc, name = encoder
    ids = reference(name)
    for t in [*ODD, *[r.text for r in documents.collect()]]:
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == ids(t)


def test_special_tokens_may_be_text():
    from tokenizers import Tokenizer

    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        t = Tokenizer.from_file(tokenizer_path(name))
        t.encode_special_tokens = True
        enc = FastEncoder(tokenizer_path(name), special_as_text=True)
        for text in ODD[:-2]:
            assert np.frombuffer(enc.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_pieces_cover_every_id_once(documents):
    ids = reference("byte_bpe_50k.json")
    rows = packing.pack(documents, tokenizer_path("byte_bpe_50k.json"), length=128, packet=16, with_ids=True).collect()
    want = Counter()
    for r in documents.collect():
        want[r.doc_id, tuple(ids(r.text) + [0])] += 1
    cover, seqs = defaultdict(int), defaultdict(list)
    for r in rows:
        own = [t for d, t in want if d == r.doc_id and len(t) == r.doc_tokens]
        assert any(list(t[r.start : r.start + r.length]) == r.ids and crc(r.ids) == r.ids_crc32 for t in own)
        cover[r.doc_id] += r.length
        seqs[r.sequence_id].append((r.offset, r.length))
    for d in {d for d, _ in want}:
        assert cover[d] == sum(len(t) * n for (e, t), n in want.items() if e == d)
    for s, parts in seqs.items():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at == 128 or s == max(seqs)
    assert sorted(seqs) == list(range(len(seqs)))


def test_windows_hold_the_mixture(spark):
    from itertools import accumulate

    rows = [(i, "word " * 60, f"s{0 if i % 2 else i % 6}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    src = {d: s for d, _, s in rows}
    got = packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), length=256, packet=16).collect()
    total, by, seq = Counter(), defaultdict(Counter), defaultdict(int)
    for r in got:
        total[src[r.doc_id]] += r.length
        by[r.sequence_id][src[r.doc_id]] += r.length
        seq[r.sequence_id] += r.length
    n = sum(total.values())
    for s in total:
        # Deficits never exceed a packet, nor does what a window boundary cuts; so cumulative counts stay near.
        run = list(accumulate(by[k][s] for k in sorted(by)))
        assert all(abs(x - total[s] / n * 256 * (i + 1)) <= 3 * 16 + 256 * total[s] / n for i, x in enumerate(run[:-1]))
    weighted = packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), length=256, packet=16, weights={"s0": 9.0, "s2": 1.0, "s4": 1.0}).collect()
    assert sum(r.length for r in weighted) == n
    folded = packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), length=256, packet=16, max_queues=2).collect()
    assert sum(r.length for r in folded) == n


def test_shared_queues_have_their_sources_weights(spark):
    """More sources than queues: the groups that share a queue keep their proportions together, also in small slices of rounds."""
    rows = [(i, "word " * 60, f"s{i % 6}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights = {"s0": 6.0, "s1": 1.0, "s2": 1.0, "s3": 1.0, "s4": 1.0, "s5": 2.0}
    of = {r["source"]: r["q"] for r in docs.select("source", F.pmod(F.xxhash64("source"), F.lit(2)).alias("q")).distinct().collect()}
    got = packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), length=256, packet=16, weights=weights, max_queues=2).collect()
    share = sum(w for s, w in weights.items() if of[s] == 0) / sum(weights.values())
    some = [r for r in got if r.sequence_id < 10]
    sent = sum(r.length for r in some if of[f"s{r.doc_id % 6}"] == 0)
    assert abs(sent - share * sum(r.length for r in some)) <= 3 * 16
    old, packing.CELLS = packing.CELLS, 1
    try:
        queues = [(0, 9_000, 6.0), (1, 5_000, 3.0), (2, 70, 1.0)]
        placed = spark.createDataFrame([(d, d % 3, p, n, bytes(4 * n)) for d, p, n in ((0, 0, 9_000), (1, 0, 5_000), (2, 0, 70))], "doc_id long, queue long, place long, n long, ids binary")
        cut = [tuple(r) for r in packing._pieces(placed, queues, 256, 16, False).collect()]
        packing.CELLS = old
        assert sorted(cut) == sorted(tuple(r) for r in packing._pieces(placed, queues, 256, 16, False).collect())
    finally:
        packing.CELLS = old

def test_files_round_trip(spark, documents, tmp_path):
    ids = reference("word_bpe_49k.json")
    path = str(tmp_path / "tokens")
    rows = token_files.round_trip(documents, tokenizer_path("word_bpe_49k.json"), 2, parts=3, path=path).orderBy("start").collect()
    want = sorted(documents.collect(), key=lambda r: (r.doc_id is not None, r.doc_id))
    at = 0
    assert len(rows) == len(want)
    for r, w in zip(rows, want):
        assert (r.doc_id, r.start, list(r.ids)) == (w.doc_id, at, ids(w.text) + [2]) and r.n_tokens == len(r.ids)
        at += len(r.ids)
    meta = token_files.read_meta(spark, path)
    assert meta.agg({"n_tokens": "sum"}).first()[0] == at and "ids" not in meta.columns
    import glob

    import pyarrow.parquet as pq

    f = pq.ParquetFile(sorted(glob.glob(path + "/*.parquet"))[0])
    cols = {f.metadata.row_group(0).column(i).path_in_schema: f.metadata.row_group(0).column(i) for i in range(f.metadata.num_columns)}
    assert any("RLE_DICTIONARY" in str(c.encodings) for p, c in cols.items() if p.startswith("ids"))
    assert cols["doc_id"].has_offset_index and "DELTA_BINARY_PACKED" in str(cols["doc_id"].encodings)


def test_empty_tables(documents):
    none = documents.where("false")
    assert packing.pack(none, tokenizer_path("byte_bpe_50k.json")).count() == 0
    assert token_files.digests(token_files.round_trip(none, tokenizer_path("word_bpe_49k.json"), 2)).count() == 0
