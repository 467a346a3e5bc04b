import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tsweave.llm import packing, sstable, wordbpe
from tsweave.llm.common import new_folder

PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(PATH)
ODD = [(1, None, "x"), (None, "null id", "x"), (3, "", "x"), (3, "same id", "x"), (3, "same id", "x"), (-5, "Ünï 'S 3.5 <|endoftext|> ...", "x"), (7, "word " * 30_000, "x"), (8, "\t\r\n   ", "x")]


def ids_of(text, end):
    return [*WHOLE.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(list(" .,\n\t'sIİſßéǺ.,a1<|>"))), max_size=40), max_size=6))
def test_ids_of_words_are_ids_of_texts(texts):
    got = wordbpe.encoder(PATH).batch(texts)
    assert [np.frombuffer(b, "<u2").tolist() for b in got] == [e.ids for e in WHOLE.encode_batch(texts, add_special_tokens=False)]


def test_every_character_in_context():
    texts = [f(chr(c)) for c in [*range(1, 0x600), *range(0x1E00, 0x2100)] for f in (str, lambda c: f"a{c}B. z{c},", lambda c: f"x{c}. {c},y")]
    got = wordbpe.encoder(PATH).batch(texts)
    assert [np.frombuffer(b, "<u2").tolist() for b in got] == [e.ids for e in WHOLE.encode_batch(texts, add_special_tokens=False)]


def test_shards_hold_all_documents(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, start string")
    folder = new_folder(spark, "t")
    manifest = sstable.write_shards(docs, PATH, 1, folder)
    got = sstable.read_shards(manifest).orderBy("start").collect()
    rows = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, np.array(ids_of(r[1], 1), "<u2").tobytes()))
    at = 0
    for r, (i, t, _) in zip(got, rows, strict=True):
        ids = ids_of(t, 1)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), crc(ids))
        at += len(ids)
    found = [x for p in manifest.collect() for x in sstable.open_shard(p.path).lookup(3)]
    assert sorted(map(list, found)) == sorted([ids_of("", 1), ids_of("same id", 1), ids_of("same id", 1)])
    assert not any(sstable.open_shard(p.path).lookup(4) for p in manifest.collect())
    assert sstable.token_shards(docs.limit(0), PATH).count() == 0


def test_shard_blocks_and_filter(tmp_path, monkeypatch):
    monkeypatch.setattr(sstable, "BLOCK", 300)
    rng = random.Random(1)
    want = {i: np.array([rng.randrange(60_000) for _ in range(rng.randint(1, 50))], "<u2") for i in rng.sample(range(-(10**6), 10**6), 500)}
    path = tmp_path / "s.sst"
    with path.open("wb") as f:
        w = sstable.ShardWriter(f, 2)
        for i in sorted(want):
            w.add(sstable.key_of(i), want[i].tobytes())
        w.close()
    r = sstable.open_shard(str(path))
    assert len(r.blocks) > 20 and [i for i, _ in r.scan()] == sorted(want)
    assert all(r.lookup(i)[0].tolist() == x.tolist() for i, x in want.items())
    absent = [i for i in range(10**6, 10**6 + 2000)]
    assert sum(r.may_hold(i) for i in absent) < 60 and not any(r.lookup(i) for i in absent)


def check_pieces(rows, texts, window):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, t in texts.items():
        ids, at = ids_of(t, 2), 0
        for r in sorted(by_doc.pop(i), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == crc(ids[at : at + r.length])
            at += r.length
        assert at == len(ids)
    assert not by_doc
    for s in by_sequence.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    return len(by_sequence)


@pytest.mark.parametrize("window", [64, 4096])
def test_packing_keeps_every_id(spark, window):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    n = check_pieces(packing.pack(docs, PATH, window=window, bins=32).collect(), texts, window)
    assert n * window < 1.06 * sum(len(ids_of(t, 2)) for t in texts.values()) + window


def test_packing_odd_rows(spark):
    rows = [(i, t, "y") for i, t, _ in ODD[:1]] + [(9, "same " * 100, "y"), (10, "same " * 100, "y"), (11, "long " * 20_000, "y"), (12, "", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string")
    check_pieces(packing.pack(docs, PATH).collect(), {i: t for i, t, _ in rows}, 4096)
    repeated = spark.createDataFrame([(None, "a b", 1), (None, "a b", 1), (5, "c", 1), (5, "c", 1)], "doc_id long, text string, n long")
    got = packing.pack(repeated, PATH).collect()
    assert len(got) == 4 and sum(r.length for r in got) == 10
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_plan_needs_no_more_than_there_is():
    rng = np.random.default_rng(2)
    for counts in (rng.integers(0, 1000, 33), np.eye(33, dtype=int)[20] * 500, np.zeros(33, int)):
        counts = counts.copy()
        counts[0] = 0
        used = np.zeros(33, int)
        for n, c in packing.plan(counts, 32):
            assert sum(c) == 32 and n > 0
            for k in c:
                used[k] += n
        assert (used <= counts).all()


def test_nnls_finds_exact_solutions():
    rng = np.random.default_rng(3)
    a = rng.uniform(0, 1, (30, 12))
    x = np.maximum(rng.normal(size=12), 0)
    assert np.abs(packing.nnls(a, a @ x, 20_000) - x).max() < 1e-3
