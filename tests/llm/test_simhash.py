import random

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from tsweave.llm import components
from tsweave.llm import simhash as S
from tsweave.llm.components import components_by_keys, connected_components, shared_keys


def plain_fingerprint(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, radius=2):
    ids = list(prints)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_covering(radius):
    masks = S.covering_masks(radius)
    rng = random.Random(1)
    for _ in range(3000):
        d = sum(1 << b for b in rng.sample(range(64), rng.randint(0, radius)))
        assert any(not d & m for m in masks)


def test_query_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in S.simhash_components(docs).collect()}
    assert {i: p for i, (p, _) in got.items()} == prints
    assert {i: c for i, (_, c) in got.items()} == plain_components(prints)


@pytest.mark.parametrize("cold", [8, 128])
def test_links_of_dense_groups(spark, monkeypatch, cold):
    """Over COLD fingerprints in one bucket, chains and balls, against all pairs."""
    monkeypatch.setattr(S, "COLD", cold)
    rng = random.Random(7)
    base, prints = rng.getrandbits(64), {}
    for i in range(150):
        p = base
        for b in rng.sample(range(20), rng.randint(0, 5)):
            p ^= 1 << b
        prints[i] = p
    x = rng.getrandbits(64)
    for i in range(150, 180):
        prints[i] = x
        x ^= 1 << rng.randrange(64)
    items = spark.createDataFrame([(i, [S.signed(p)]) for i, p in prints.items()], "node long, prints array<long>")
    got = {r.node: r.component for r in S.components_of(S.links(items)).collect()}
    want = plain_components(prints)
    assert {i: got.get(i, i) for i in prints} == want


def test_odd_rows(spark):
    rows = [(5, None, "x"), (3, "", "x"), (9, " \t ", "x"), (None, "a b c d", None), (4, "a b c d", "y"), (7, "a b c d", "y"), (7, "z " * 60_000, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in S.simhash_components(docs).collect())
    assert len(got) == 7
    assert {c for i, f, c in got if f == "0" * 16} == {3}
    assert [c for i, f, c in got if f == f"{plain_fingerprint('a b c d'):016x}"] == [4, 4, 4]
    assert S.simhash_components(docs.limit(0)).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(5, 5), (None, 4)]
    rng = random.Random(3)
    rng.shuffle(edges)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 7 for i in [7, *range(200, 260)]}


def test_near_duplicates_find_edited_copies(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(4000)]
    texts, base = [], []
    for g in range(40):
        t = [rng.choice(words) for _ in range(300)]
        base += [g] * 3
        for k in range(3):
            u = list(t)
            for at in rng.sample(range(300), 2 * k):
                u[at] = rng.choice(words)
            texts.append(" ".join(u))
    pdf = pd.DataFrame({"doc_id": np.arange(len(texts)), "text": texts})
    got = {r.doc_id: r.component_id for r in S.near_duplicates(spark.createDataFrame(pdf)).collect()}
    assert all(base[i] == base[c] for i, c in got.items())
    assert sum(c == 3 * base[i] for i, c in got.items()) >= 0.93 * len(texts)


@pytest.mark.parametrize("n", [3, 40])
def test_pairs_of_a_bucket_whose_first_item_is_like_none(spark, n):
    """Of one key: item 0 fails with all, the others hold among neighbours; an edge that would hold but isn't near stays out."""
    member = spark.createDataFrame([(9, i, i) for i in range(n)] + [(8, 100, 0), (8, 102, 1)], "key long, node long, n long")
    got = components_by_keys(member, F.expr("x.n + y.n > 0"), lambda e: e.where("a > 0 and b - a <= 2 and a < 100"))
    assert {r.node: r.component for r in got.collect()} == {i: 1 for i in range(1, n)}
    assert sorted((r.key, r.node) for r in shared_keys(spark.createDataFrame([(1, 1), (1, 1), (2, 1), (2, 2), (2, 2)], "key long, node long")).collect()) == [(2, 1), (2, 2)]



def test_near_duplicates_by_exact_jaccard(spark):
    """Pairs on both sides of the threshold and many items of equal fingerprints of words, against all pairs."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    texts = []
    for _ in range(60):
        t = [rng.choice(words) for _ in range(rng.randint(4, 160))]
        for k in range(4):
            u = list(t)
            for _ in range(k):
                u[rng.randrange(len(u))] = rng.choice(words)
            texts.append(" ".join(u))
    for _ in range(40):  # one word over half
        t = ["|"] * 60
        for at in rng.sample(range(60), 6):
            t[at] = rng.choice(words[:12])
        texts += [" ".join(t), " ".join([*t[1:], rng.choice(words)])]
    sets = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in map(str.split, texts)]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in S.near_duplicates(docs).collect()}
    assert got == {i: find(i) for i in range(len(texts))}


def test_near_duplicates_of_the_pipeline_by_simhash_first(spark, monkeypatch):
    """Texts whose fingerprints link are connected by these, and the exact way has none of their pairs; the rest are its own."""
    import corpus_pipeline

    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    t = [rng.choice(words) for _ in range(2_000)]
    texts = [" ".join([*t[:at], rng.choice(words), *t[at + 1 :]]) for at in range(0, 2_000, 50)]
    u = [rng.choice(words) for _ in range(60)]
    texts += [" ".join(u), " ".join([*u[:30], "other", *u[31:]]), " ".join(rng.choice(words) for _ in range(60))]
    linked, tested = [], []
    links, whole = S.links, S.by_whole_sets

    def counted(*a):
        test = whole(*a)

        def run(edges):
            tested.append(edges.count())
            return test(edges)

        return run

    monkeypatch.setattr(S, "links", lambda items, *a, **b: linked.append(items.count()) or links(items, *a, **b))
    monkeypatch.setattr(S, "by_whole_sets", counted)
    docs = spark.createDataFrame([(i, x, "en", "s", len(x)) for i, x in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert got == {0, 40, 42} and linked == [43]
    assert len(tested) == 4 and sum(tested[2:]) < sum(tested[:2])


def test_pairs_that_share_too_few_keys_are_not_tested(spark):
    """Large buckets and small ones count together; known edges and what they connect aren't tested again."""
    big = [(k, i, 10, 20) for k in (1, 2) for i in range(20)]
    small = [(k, i, 10, 2) for k in (3, 4, 5) for i in (0, 19)] + [(6, i, 10, 2) for i in (30, 31)]
    member = spark.createDataFrame([*big, *small], "key long, node long, n int, size int")
    known = spark.createDataFrame([(i, 1) for i in range(2, 19)], "a long, b long")
    tested = []

    def test(edges):
        tested.append({(r.a, r.b) for r in edges.collect()})
        return edges.where("a = 0 and b = 19")

    got = components_by_keys(member, F.expr("x.n = y.n"), test, 1.25, known, F.expr("times >= 5"))
    assert {r.node: r.component for r in got.collect()} == {0: 0, 19: 0} | {i: 1 for i in range(1, 19)}
    assert all(not 1 <= a <= b <= 18 for some in tested for a, b in some) and tested[1] == set()


def test_pairs_of_a_group_that_shares_many_keys_are_given_at_few(spark):
    """Each pair that shares a key is there, and hardly any at each of the thirty keys that it shares."""
    rng = random.Random(12)
    keys = {i: set(rng.sample(range(40), rng.choice([1, 3, 38]))) for i in range(60)}
    size = {k: sum(k in s for s in keys.values()) for k in range(40)}
    rows = [(k, i, 10, size[k]) for i, s in keys.items() for k in s]
    member = spark.createDataFrame(rows, "key long, node long, n int, size int")
    given, tested = [], []
    whole = components.unconnected

    def counted(*a, **b):
        given.append(whole(*a, **b))
        return given[-1]

    def test(edges):
        tested.append({(r.a, r.b) for r in edges.collect()})
        return edges.where("false")

    with pytest.MonkeyPatch.context() as m:
        m.setattr(components, "unconnected", counted)
        assert components_by_keys(member, F.expr("x.n = y.n"), test, 1.25).isEmpty()
    want = {(i, j) for i in keys for j in keys if i < j and keys[i] & keys[j]}
    assert set().union(*tested) == want and given[0].count() < 2 * len(want)


def test_documents_with_a_passage_in_common_give_no_pair(spark, monkeypatch):
    """They share shingles among their first, at places that would let them be alike, but the sets' parities tell them apart."""
    rng = random.Random(13)
    passage = " ".join(f"p{i}" for i in range(44))
    texts = [" ".join([passage, *(f"w{rng.randrange(10**9)}" for _ in range(76))]) for _ in range(40)]
    texts += [texts[0] + " end", " ".join(f"s{i}" for i in range(3))]
    seen = []
    whole = S.components_by_keys

    def kept(member, near, *a):
        seen.append((member, near))
        return whole(member, near, *a)

    monkeypatch.setattr(S, "components_by_keys", kept)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in S.near_duplicates(docs).collect()}
    assert got == {i: 0 if i == 40 else i for i in range(42)}
    member, near = seen[-1]
    pairs = member.alias("x").join(member.alias("y"), F.expr(f"x.key = y.key and x.node < y.node and x.size > {components.FEW}"))
    assert pairs.count() > 1000 and pairs.where(near).select("x.node", "y.node").distinct().count() <= 1
