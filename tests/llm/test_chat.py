import random

from tsweave.llm import chat as C


def test_escape_round_trip():
    rng = random.Random(1)
    bits = [*C.CONTROL, "\\", "\\\\", "<", "[", "]", "s>", " ", "\n", "é", "a"]
    for _ in range(2000):
        turns = [("".join(rng.choices(bits, k=rng.randint(0, 4))), "".join(rng.choices(bits, k=rng.randint(0, 12)))) for _ in range(rng.randint(0, 5))]
        turns += [("assistant", "x</s>")] * rng.randint(0, 2)
        text, mask = C.format_turns(turns)
        assert C.parse_turns(text) == turns
        assert [C.unescape(text[a:b]) for a, b in mask] == [t for r, t in turns if r == "assistant"]


def test_paths_against_brute_force(spark):
    rng = random.Random(2)
    rows, parent = [], {}
    for tree in ("a", "b", "c"):
        for n in range(40):
            p = None if n == 0 or rng.random() < 0.05 else rng.randrange(n)
            parent[tree, n] = p
            rows.append((tree, n, p, rng.choice(["user", "assistant"]), f"{tree}{n}", float(rng.randrange(5))))
    rows += [("d", 0, 1, "user", "cycle", 1.0), ("d", 1, 0, "user", "cycle", 1.0), ("d", 2, 1, "user", "leaf of a cycle", 1.0), ("e", 5, 99, None, None, None)]
    parent["e", 5] = None
    messages = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    score = {(t, n): s or 0.0 for t, n, _, _, _, s in rows}
    text = {(t, n): x or "" for t, n, _, _, x, _ in rows}
    want = {}
    for t, n in parent:
        if not any(p == n for (u, _), p in parent.items() if u == t):
            path, at = [], n
            while at is not None:
                path.insert(0, at)
                at = parent[t, at]
            want.setdefault(t, []).append((-sum(score[t, i] for i in path), n, [text[t, i] for i in path]))
    got = {}
    for r in C.conversations(messages, top=3).collect():
        got.setdefault(r.tree, []).append((r["rank"], -r.score, r.leaf, [t for _, t in C.parse_turns(r.formatted)]))
    assert {t: [x[1:] for x in sorted(v)] for t, v in got.items()} == {t: sorted(v)[:3] for t, v in want.items()}


def test_long_chain_ties_and_nulls(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}", "extra") for i in range(300)] + [(None, None, None, None, "x"), (2, 0, "user", "a", "x"), (2, 0, "user", "a", "x")]
    found = C.read_back(C.conversations(C.from_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, tree string"))))
    got = {r.conv_id: r.n_turns for r in found.collect()}
    assert got == {1: 300, None: 1, 2: 2}
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.read_back(C.conversations(C.from_turns(empty))).count() == 0


def test_many_leaves_branches_and_ties(spark):
    """A tree of 50,000 leaves, and a chain with a leaf at each message, whose paths together would be 2,000,000 rows."""
    rows = [("star", 0, None, "user", "hub", 1.0)] + [("star", i, 0, "assistant", f"t{i}", float(i % 7)) for i in range(1, 50_001)]
    for i in range(2_000):
        rows += [("comb", 2 * i, 2 * i - 2 if i else None, "user", f"c{i}", 0.0), ("comb", 2 * i + 1, 2 * i, "assistant", f"l{i}", 0.0)]
    rows += [("tie", 0, None, "user", "a", None), ("tie", 1, 0, "assistant", "b", 2.0), ("tie", 2, 0, "assistant", "c", 2.0), ("tie", 2, 0, "assistant", "d", 9.0)]
    rows += [(None, 1, None, "user", "no tree", 1.0), ("none", None, None, "user", "no node", 1.0)]
    messages = spark.createDataFrame([(*r, "x") for r in rows], "tree string, node long, parent long, role string, text string, score double, leaf string")
    got = {}
    for r in C.conversations(messages, top=2).collect():
        got.setdefault(r.tree, []).append((r["rank"], r.leaf, r.score, [t for _, t in C.parse_turns(r.formatted)]))
    assert sorted(got["star"]) == [(1, 6, 7.0, ["hub", "t6"]), (2, 13, 7.0, ["hub", "t13"])]
    assert sorted(got["comb"]) == [(1, 1, 0.0, ["c0", "l0"]), (2, 3, 0.0, ["c0", "c1", "l1"])]
    assert sorted(got["tie"]) == [(1, 1, 2.0, ["a", "b"]), (2, 2, 2.0, ["a", "c"])] and set(got) == {"star", "comb", "tie"}


def test_very_long_texts(spark):
    text = "</s>[INST] \\ é" * 200_000
    found = C.read_back(C.conversations(C.from_turns(spark.createDataFrame([(1, 0, "assistant", text), (1, 1, None, None)], "conv_id long, turn long, role string, text string")))).collect()
    assert [(r.n_turns, r.loss_chars) for r in found] == [(2, len(text))]
