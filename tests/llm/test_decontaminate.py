import random
from collections import Counter

from tsweave.llm import decontaminate as D


def words(text):
    import re

    return re.findall(r"[^\W_]+", text.lower())


def bag(w):
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def jaccard(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def make(rng):
    vocabulary = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 7))) for _ in range(1500)]
    items = {i: [rng.choice(vocabulary) for _ in range(rng.randint(14, 60))] for i in range(25)}
    docs = {}
    for d in range(60):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 300))]
        if d % 3 == 0:
            item = list(items[rng.randrange(25)])
            if d % 2:
                item = item[: len(item) - 1]
            at = rng.randint(0, len(w))
            w[at:at] = item
        docs[d] = w
    return items, docs


def test_leaks_against_all_windows(spark):
    rng = random.Random(4)
    items, docs = make(rng)
    text = {d: " ".join(w).replace(" ", ", ", 3).capitalize() for d, w in docs.items()}
    got = {(r.doc_id, r.item_id): r.similarity for r in D.leaks(spark.createDataFrame(list(text.items()), "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")).collect()}
    want = {}
    for d, w in docs.items():
        for i, item in items.items():
            best = max((jaccard(bag(w[s : s + len(item)]), bag(item)) for s in range(max(1, len(w) - 4))), default=0)
            if best >= 0.8:
                want[d, i] = round(best, 6)
    assert set(got) <= set(want) and len(want) >= 18
    assert len(got) >= 0.95 * len(want)
    assert all(abs(want[k] - v) < 1e-5 for k, v in got.items())


def test_all_pairs_within_the_radius_are_found(spark):
    rng = random.Random(6)
    g = [rng.getrandbits(64) for _ in range(6)]
    f = []
    for x in g:
        for n in range(0, 20):
            y = x
            for b in rng.sample(range(64), n):
                y ^= 1 << b
            f.append(y)
    s = lambda x: x - (1 << 64) if x >> 63 else x
    got = {(r.f & (1 << 64) - 1, r.g & (1 << 64) - 1) for r in D.within_radius(spark.createDataFrame([(s(x),) for x in f], "f long"), spark.createDataFrame([(s(x),) for x in g], "f long")).collect()}
    assert got == {(x, y) for x in f for y in g if (x ^ y).bit_count() <= D.RADIUS}


def test_simhash_counts_bits(spark):
    rng = random.Random(8)
    rows = [[rng.getrandbits(64) - (1 << 63) for _ in range(n)] for n in (1, 2, 7, 40)] + [[-1] * 70_000]
    df = spark.createDataFrame([(r,) for r in rows], "h array<long>")
    for h, got in zip(rows, [r.f for r in df.select(D.simhash("h").alias("f")).collect()], strict=True):
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert got & (1 << 64) - 1 == want


def test_odd_rows(spark):
    item = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(None, item, 1), (None, "no", 1), (2, None, 1), (3, "", 1), (4, "one two", 1), (5, item, 1), (5, item, 1), (6, "x " * 60_000 + item, 1)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(1, item, "z"), (2, item, "z"), (3, None, "z"), (4, "too short", "z")], "item_id long, text string, doc_id string")
    got = sorted((str(r.doc_id), r.item_id, r.start_word) for r in D.leaks(docs, bench).collect())
    assert got == sorted((d, i, s) for d, s in (("None", 0), ("5", 0), ("6", 60_000)) for i in (1, 2))
    assert D.leaks(docs.limit(0), bench).count() == 0 and D.leaks(docs, bench.limit(0)).count() == 0


def test_short_items_and_clashing_names(spark):
    """An item of fewer than five words is found where its words stand in a row."""
    docs = spark.createDataFrame([(1, "so the Quick, fox ran", 1, "x"), (2, "quick red fox", 1, "x"), (3, "fox", 1, "x"), (4, "a b c d e f g", 1, "x"), (5, "quick fox quick fox", 1, "x")], "doc_id long, text string, w int, start string")
    bench = spark.createDataFrame([(1, "quick fox"), (2, "fox"), (3, "b c d e"), (4, "c d e f g"), (5, "a"), (6, " .")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.start_word, r.n_words, r.similarity) for r in D.leaks(docs, bench).collect())
    assert got == [(1, 1, 2, 2, 1.0), (1, 2, 3, 1, 1.0), (2, 2, 2, 1, 1.0), (3, 2, 0, 1, 1.0), (4, 3, 1, 4, 1.0), (4, 4, 2, 5, 1.0), (4, 5, 0, 1, 1.0), (5, 1, 0, 2, 1.0), (5, 2, 1, 1, 1.0)]


def test_long_documents_without_a_broadcast(spark, monkeypatch):
    """Documents of 20,000 words, with the benchmark joined by a shuffle, give what the broadcast gives."""
    rng = random.Random(9)
    item = [f"w{i}" for i in range(40)]
    text = lambda: " ".join(rng.choice(["the", "of", "a", *item]) for _ in range(20_000))
    docs = spark.createDataFrame([(i, text() + " " + " ".join(item)) for i in range(4)] + [(9, text())], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    found = []
    for most in (D.MOST_BROADCAST, 0):
        monkeypatch.setattr(D, "MOST_BROADCAST", most)
        found.append(sorted(tuple(r) for r in D.leaks(docs, bench).collect()))
    assert found[0] == found[1] and [(r[0], r[2]) for r in found[0]] == [(i, 20_000) for i in range(4)]


def test_main_path_has_no_python(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    plan = D.leaks(docs, docs.withColumnRenamed("doc_id", "item_id"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
