import random

import numpy as np
from pyspark.sql import functions as F

from tsweave.llm import linededup as L


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute(docs):
    """Groups of lines by all pairs and edit similarity over words."""
    lines = sorted({" ".join(x.lower().split()) for _, t in docs for x in (t or "").split("\n")} - {""})
    parent = list(range(len(lines)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(lines)):
        for j in range(i):
            a, b = lines[i].split(), lines[j].split()
            if edit(a, b) <= int(max(len(a), len(b)) * (1 - L.SIMILARITY) + 1e-9):
                parent[find(i)] = find(j)
    group = {x: find(i) for i, x in enumerate(lines)}
    seen, out = set(), {}
    for d, t in sorted(docs):
        kept = []
        for x in (t or "").split("\n"):
            n = " ".join(x.lower().split())
            if not n or group[n] not in seen:
                kept.append(x)
            if n:
                seen.add(group[n])
        out[d] = "\n".join(kept)
    return out


def corpus(rng, n=60):
    words = ["the", "of", "and", "to"] + ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    base = [" ".join(rng.choice(words[:4]) if rng.random() < 0.4 else rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(40)]
    docs = []
    for d in range(n):
        lines = []
        for _ in range(rng.randint(0, 8)):
            w = rng.choice(base).split()
            if rng.random() < 0.5:
                w[rng.randrange(len(w))] = rng.choice(words)
            lines.append((" " if rng.random() < 0.2 else "") + " ".join(w).capitalize())
        docs.append((d, "\n".join(lines)))
    return docs


def test_against_brute_force(spark):
    for seed in (1, 2):
        docs = corpus(random.Random(seed))
        got = {r.doc_id: r.text for r in L.without_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
        assert got == brute(docs)


def test_words_are_hashed_alike_wherever_they_stand():
    lines = ["a b c", "the the of", "x", "b a c " * 50, "é" * 300 + " a", "ab " + "z" * 5_000]
    lines = [x.strip() for x in lines]
    together, n = L.hashed_words(lines)
    assert n.tolist() == [len(x.split()) for x in lines]
    hashes = dict(zip(" ".join(lines).split(), together.tolist(), strict=True))
    assert len(set(hashes.values())) == len(hashes) and [hashes[w] for x in lines for w in x.split()] == together.tolist()
    alone = np.concatenate([L.hashed_words([x])[0] for x in lines])
    assert (alone == together).all() and len(L.hashed_words([])[0]) == 0
    some = [f"{a}{b}" for a in "abcdefghijkl" for b in range(3000)]
    assert len(set(L.hashed_words(some)[0].tolist())) == len(some)
    coded, n, odd = L.coded_lines(lines)
    assert [len(c) for c in coded] == n.tolist() and odd.shape == (len(lines), 2)


def test_shared_keys_of_runs_against_brute_force():
    rng = np.random.default_rng(5)
    for most in (10, 60, 10_000):
        rows = [(rng.integers(0, 40, n).astype(np.uint64) << np.uint64(56) | rng.integers(0, 3, n).astype(np.uint64), rng.integers(0, 25, n)) for n in (1, 30, 7, 50, 40, 0)]
        got, ranges = {}, 4
        by = {}
        for key, node in rows:
            for at, run in zip(*L.runs(node.astype(np.int64), key, ranges), strict=True):
                by.setdefault(int(at), []).append(run)
        for at, some in by.items():
            shared = L.SharedKeys(at, most)
            parts = [p for r in some if (p := shared.add(r)) is not None] + [shared.flush(True)]
            for p in parts:
                for k, node, size in p.itertuples(index=False):
                    got.setdefault((at, k), {})[node] = size
        want = {}
        for key, node in rows:
            for k, x in zip(key.tolist(), node.tolist(), strict=True):
                want.setdefault((k >> 32) * ranges >> 32, {}).setdefault(k & (1 << 48) - 1, set()).add(x)
        want = sorted((at, tuple(sorted(v))) for at, of in want.items() for v in of.values() if len(v) > 1)
        assert sorted((at, tuple(sorted(v))) for (at, _), v in got.items()) == want
        assert all(len(set(v.values())) == 1 and min(v.values()) >= len(v) for v in got.values())


def test_many_equal_lines_and_clashing_names(spark):
    rows = [(1, "one two three\n" * 60_000, "x", "y", "z"), (2, "one two three", "x", "y", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _rid string, gone string, RID string")
    got = {r.doc_id: r for r in L.without_repeated_lines(docs).collect()}
    assert got[1].n_removed == 59_999 and got[1].n_lines == 60_001 and got[1].text == "one two three\n" and got[2].text == ""
    assert got[1]._rid == "x" and got[1].gone == "y" and got[1].RID == "z"


def test_odd_rows(spark):
    rows = [(2, "Same line here\n\nother words follow now", 1), (1, "same  LINE here", 1), (None, "same line here", 1), (3, None, 1), (4, "", 1), (5, "w " * 50_000, 1), (6, "unique first\nunique first", 1), (6, "unique first\nunique first", 1)]
    got = [(r.doc_id, r.text, r.n_lines, r.n_removed, r.h) for r in L.without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string, h long")).collect()]
    by = {}
    for i, t, n, k, _ in got:
        by.setdefault(i, []).append((t, n, k))
    assert by[None] == [("same line here", 1, 0)] and by[1] == [("", 1, 1)] and by[2] == [("\nother words follow now", 3, 1)]
    assert by[3] == [(None, 0, 0)] and by[4] == [("", 1, 0)] and by[6] == [("unique first", 2, 1)] * 2
    assert L.without_repeated_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def alike(lines):
    """Groups of normalised lines by edit similarity alone."""
    group = {x: {x} for x in lines}
    for x in lines:
        for y in lines:
            a, b = x.split(), y.split()
            if x < y and edit(a, b) <= int(max(len(a), len(b)) * (1 - L.SIMILARITY) + 1e-9) and group[x] is not group[y]:
                group[x] |= group[y]
                for z in group[y]:
                    group[z] = group[x]
    return {frozenset(g) for g in group.values()}


def test_every_group_by_edit_similarity_alone(spark):
    """Lines at the limit of edits, of common words only, and with bars as over half their words."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 9))) for _ in range(300)]
    lines = {f"| {a} | {b} | {c} | {d} |" for a in "pqr" for b, c, d in [rng.sample(words, 3) for _ in range(12)]}
    lines |= {" ".join(rng.choice("uvw") for _ in range(rng.randint(4, 9))) for _ in range(40)}
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(4, 40))]
        for _ in range(3):
            w = list(base)
            for _ in range(len(base) // 5):
                at, what = rng.randrange(len(w)), rng.random()
                w[at : at + 1] = [] if what < 0.3 else [rng.choice(words), w[at]] if what < 0.6 else [rng.choice(words)]
            lines.add(" ".join(w))
    lines = sorted(lines)
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    got = {r.doc_id for r in L.without_repeated_lines(docs).collect() if r.n_removed == 0}
    want = alike(lines)
    assert len(want) < len(lines) and got == {min(lines.index(x) for x in g) for g in want}


def shared_rows(coded, similarity, most=10_000):
    """candidates() of coded lines, which are known by their place, of one range of keys."""
    none = np.zeros(0, np.uint64), np.zeros(0, np.uint8)
    own, key, about = L.pair_keys(coded, none, none, similarity)
    shared, parts = L.SharedKeys(0, most), []
    for run in L.runs(own, key, 1, about)[1]:
        parts += [L.candidates(*shared.rows(False), similarity)] if shared.hold(run) else []
    return [*parts, L.candidates(*shared.rows(True), similarity)]


def test_candidates_lose_no_pair_and_chance_gives_few():
    """Lines within the edits stay, with pairs of words that a line has again; lines that share one pair by chance don't."""
    rng = random.Random(9)
    lines = []
    for _ in range(60):
        base = [rng.choice("abc") if rng.random() < 0.3 else chr(rng.randint(0x10000, 0x10FFF)) for _ in range(rng.randint(5, 300))]
        for _ in range(4):
            w = list(base)
            for _ in range(rng.randint(0, len(base) // 5)):
                at, what = rng.randrange(len(w)), rng.random()
                w[at : at + 1] = [] if what < 0.3 else [w[at], rng.choice(w)] if what < 0.6 else [rng.choice("abc")]
            lines.append("".join(w))
    lines = sorted(set(lines))
    for most in (10_000_000, 10):
        found = shared_rows(lines, L.SIMILARITY, most)
        pairs = {(a, b) for f in found for a, b in zip(f["a"], f["b"], strict=True) if a != b}
        buckets = {}
        for f in found:
            for k, a, b in zip(f["key"], f["a"], f["b"], strict=True):
                if a == b:
                    buckets.setdefault(k, set()).add(a)
        together = pairs | {(a, b) for s in buckets.values() for a in s for b in s if a < b}
        for i, x in enumerate(lines):
            for j in range(i + 1, len(lines)):
                y = lines[j]
                k = L.allowed(max(len(x), len(y)), L.SIMILARITY)
                if (i, j) not in together and abs(len(x) - len(y)) <= k:
                    assert edit(x, y) > k
    # 200 lines that share a pair of words at places of their own, and 200 of one text but for a word
    chance = ["".join(chr(0x20000 + 100 * i + j) for j in range(i % 50)) + "ab" + "".join(chr(0x20000 + 100 * i + j) for j in range(i % 50, 60)) for i in range(200)]
    found = shared_rows(chance, L.SIMILARITY)[0]
    assert 0 < len(found) < 200 * 199 // 6
    base = [chr(0x30000 + j) for j in range(30)]
    found = shared_rows(["".join([*base[: i % 30], chr(0x40000 + i), *base[i % 30 + 1 :]]) for i in range(200)], L.SIMILARITY)[0]
    one = found["a"] == found["b"]
    assert 200 <= one.sum() <= 200 * 13 and (~one).sum() <= 200 * L.SPARSE


def test_parities_and_lengths_lose_no_pair_and_let_few_others_through(spark):
    """Lines within the edits pass, whatever the edits are; a line that has lost 6 words and has 16 others does not."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    rows, apart = [], []
    for i in range(300):
        x = rng.sample(words, rng.randint(5, 60))
        y, k = list(x), int(len(x) * (1 - L.SIMILARITY) + 1e-9)
        kind = rng.choice([[0.0, 0.0], [1.0, 1.0], [0.0, 1.0], [0.3, 0.6]])
        for _ in range(k):
            at, what = rng.randrange(len(y)), rng.random()
            y[at : at + 1] = [] if what < kind[0] and len(y) > 1 else [y[at], rng.choice(words)] if what < kind[1] else [rng.choice(words)]
        if edit(x, y) <= L.allowed(max(len(x), len(y)), L.SIMILARITY):
            rows.append((i, " ".join(x), " ".join(y)))
    for i in range(300, 340):
        x = rng.sample(words, 50)
        apart.append((i, " ".join(x), " ".join(x[6:] + [f"v{i}x{j}" for j in range(16)])))
    sides = []
    for s in (1, 2):
        _, n, odd = L.coded_lines([r[s] for r in rows + apart])
        sides.append(spark.createDataFrame([(r[0], int(k), *map(int, o.view(np.int64))) for r, k, o in zip(rows + apart, n, odd, strict=True)], "i long, n int, odd long, odd2 long"))
    both = sides[0].alias("x").join(sides[1].alias("y"), F.expr("x.i = y.i"))
    got = {r.i for r in both.where(L.within_edits(L.SIMILARITY)).select("x.i").collect()}
    assert len(rows) > 200 and {r[0] for r in rows} <= got and len(got) <= len(rows) + 10
