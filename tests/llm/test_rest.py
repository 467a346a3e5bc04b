"""Shards, toxicity, licences and the pipeline."""

import zlib

import numpy as np
import pytest

from tsweave.llm import licenses, sharding, toxicity

SF = "/root/testdata/sf0.001"


def test_shards_are_contiguous_and_balanced(spark):
    rows = [(i, "x" * (i * 37 % 900), "c") for i in range(700)] + [(None, None, "c"), (5, "é", "c"), (5, "é", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(7)
    got = sharding.byte_shards(docs, 24).collect()
    assert len(got) == len(rows) and all(r["size"] == len((t or "").encode()) + 8 for r, t in ((r, {i: t for i, t, _ in rows}[r.doc_id]) for r in got if r.doc_id != 5))
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [(r.doc_id if r.doc_id is not None else -1) for r in order] == sorted(r.doc_id if r.doc_id is not None else -1 for r in got)
    sizes = {}
    for r in order:
        sizes.setdefault(r.shard, []).append(r["size"])
        assert r.slot == len(sizes[r.shard]) - 1
    total = [sum(s) for s in sizes.values()]
    assert len(total) == 24 and max(total) - min(total) <= 2 * max(max(s) for s in sizes.values())
    assert next(r for r in got if r.doc_id is None).text_crc32 == 0 and all(r.text_crc32 == zlib.crc32("é".encode()) for r in got if r.doc_id == 5 and r["size"] == 10)
    assert sharding.byte_shards(docs.limit(0)).count() == 0


def labelled(spark):
    rng = np.random.default_rng(3)
    plain = ["".join(rng.choice(list("bcdfglmnprst")) + rng.choice(list("aeiou")) for _ in range(3)) for _ in range(300)]
    docs, labels = [], []
    for i in range(900):
        w = [plain[j] for j in rng.integers(0, 300, rng.integers(20, 60))]
        bad = i % 4 == 0
        if bad:
            for _ in range(4):
                w[rng.integers(0, len(w))] = "zorkwug" + "".join(rng.choice(list("xqvk"), 2)) if i % 5 else "zorkwugged"
        docs.append((i, " ".join(w), "score"))
        labels.append((i, int(bad)))
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_toxicity_generalises_to_unseen_spellings(spark):
    docs, labels, truth = labelled(spark)
    got = toxicity.toxicity(docs, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) > 0.95 * len(held)


def test_held_out_labels_are_not_used(spark):
    docs, labels, _ = labelled(spark)
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - toxic else toxic end as toxic")
    a, b = ({r.doc_id: r.score for r in toxicity.toxicity(docs, x).collect()} for x in (labels, flipped))
    assert a == b


def test_toxicity_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (3, "word " * 100_000), (3, "word")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (None, 1), (9, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r.score < 0.5 for r in got)
    assert toxicity.toxicity(docs.limit(0), labels.limit(0)).count() == 0


def test_scores_against_the_plain_forward_pass():
    """Averaged n-gram vectors, averaged words, linear softmax: as the model is defined, one text at a time."""
    rng = np.random.default_rng(2)
    plain = ["".join(rng.choice(list("abcdefgh"), rng.integers(1, 9))) for _ in range(80)]
    texts = [" ".join(rng.choice(plain, rng.integers(1, 30))) for _ in range(120)]
    y = np.array([i % 3 == 0 for i in range(120)], np.int64)
    vectors, soft, bias = toxicity.softmax_of(toxicity._features(texts), y)
    scorer = toxicity.Scorer(vectors @ (soft[:, 1] - soft[:, 0]), float(bias[1] - bias[0]))
    odd = ["", "  ", "Zebra, zebra! a", "é" * 70 + " b", texts[0] + " unseen words"]
    for t, got in zip(texts + odd, scorer.scores(texts + odd), strict=True):
        words = sorted({w for w in "".join(c if ord(c) > 127 or c.isalnum() else " " for c in t.lower()).split(" ") if w})
        mean = np.zeros(toxicity.WIDTH)
        for w in words:
            buckets, _ = toxicity.subwords([w])
            mean += vectors[buckets].astype(float).mean(0)
        mean /= len(words) + toxicity.EMPTY_WORDS
        z = mean @ soft + bias
        assert abs(got - np.exp(z[1]) / np.exp(z).sum()) < 1e-4
    # a word has every n-gram of its marked form, and itself
    buckets, of = toxicity.subwords(["abcd"])
    assert len(buckets) == sum(max(0, 6 - n + 1) for n in toxicity.NGRAMS) + 1 and set(of.tolist()) == {0}


def test_toxicity_trains_on_whole_long_texts(spark):
    """What marks a long text stands at its end."""
    docs = [(i, "plain words here " * 3_000 + ("zorkwug " * 400 if i % 2 else "")) for i in range(40)]
    labels = [(i, i % 2) for i in range(40)]
    got = toxicity.toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert all((r.score > 0.5) == bool(r.doc_id % 2) for r in got)


def test_many_rows_alike_do_not_fill_one_shard_task(spark):
    docs = spark.createDataFrame([(None, "same")] * 4000 + [(i, "x" * i) for i in range(50)], "doc_id long, text string").repartition(4)
    got = sharding.byte_shards(docs, 24).collect()
    total = {}
    for r in got:
        total.setdefault(r.shard, []).append(r)
    assert len(got) == 4050 and len(total) == 24
    assert all(sorted(r.slot for r in rows) == list(range(len(rows))) for rows in total.values())
    sizes = [sum(r["size"] for r in rows) for rows in total.values()]
    assert max(sizes) - min(sizes) < 200


def brute_cosine(text, template, templates):
    bags = [licenses.words_of(t) for _, t in templates]
    idf = lambda w: np.log((1 + len(bags)) / (1 + sum(w in b for b in bags))) + 1
    a, b = licenses.words_of(text), licenses.words_of(template)
    va, vb = ({w: s.count(w) * idf(w) for w in s} for s in (a, b))
    dot = sum(va[w] * vb.get(w, 0) for w in va)
    return dot / np.sqrt(sum(x * x for x in va.values()) * sum(x * x for x in vb.values()))


def test_cosines_against_brute_force():
    texts = ["Released under the MIT License.", "released under the mit licence", "All rights reserved, the of", "Licensed under CC BY-NC 4.0. And more words.", "nothing here", ""]
    names, best, _ = licenses.Matcher().best(texts)
    for t, n, c in zip(texts[:-1], names, best, strict=False):
        want = max(brute_cosine(t, x, licenses.TEMPLATES) for _, x in licenses.TEMPLATES)
        assert abs(c - want) < 1e-9 and (n is not None) == (want >= licenses.THRESHOLD)
    assert names[0] == "MIT" and names[-1] is None and best[-1] == 0


def test_directories_inherit_from_the_nearest(spark):
    files = [("LICENSE", "Released under the MIT License."), ("a/x.py", "code code"), ("a/b/LICENSE.txt", "Licensed under CC BY 4.0.\n" + "words that follow at length " * 20), ("a/b/c/d.py", "code"), ("a/b/own.py", "# All rights reserved.\ncode"), ("z/notes", None), (None, "x"), ("a/b/c/d.py", "code")]
    got = {}
    for r in licenses.scan(spark.createDataFrame(files, "path string, text string")).collect():
        got.setdefault(r.path, []).append((r.own_license, r.license, r.inherited_from))
    assert got["a/x.py"] == [(None, "MIT", "")] and got["z/notes"] == [(None, "MIT", "")]
    assert got["a/b/c/d.py"] == [(None, "CC-BY-4.0", "a/b")] * 2 and got["a/b/own.py"] == [("Proprietary", "Proprietary", None)]
    assert got[None] == [(None, None, None)]
    assert licenses.scan(spark.createDataFrame([], "path string, text string")).count() == 0


def brute_scan(files):
    """own licence, licence file, licence and where from, one file at a time, by brute_cosine()."""
    import re

    def stated(text, first=0):
        found = [(round(brute_cosine(text, t, licenses.TEMPLATES), 9), i) for i, (_, t) in enumerate(licenses.TEMPLATES) if i >= first and licenses.words_of(text)]
        c, i = max(found, key=lambda x: (x[0], -x[1]), default=(0, 0))
        return (-c, licenses.TEMPLATES[i][0]) if c >= licenses.THRESHOLD else None

    first, own = len(licenses.TEMPLATES) - len(licenses.FILES), {}
    for path, text in files:
        lines = text.split("\n")
        parts = [x for x, _ in licenses.paragraphs(text)] if len(lines) > 1 else []
        n = len(licenses.words_of(text))
        best = [s for x in [*lines, *parts, text] if (s := stated(x))]
        share = max(sum(len(licenses.words_of(x)) for x in some if stated(x)) for some in (lines, parts, [text])) / max(1, n)
        whole = [s for x in (text, " ".join(text.split()[: licenses.HEAD])) if (s := stated(x, first))]
        mine = min(whole, default=min(best, default=None))
        name = path.split("/")[-1].lower()
        prose = (name.rpartition(".")[2] if "." in name else "") in licenses.PROSE
        is_file = mine is not None and (re.sub(r"\.[^.]*$", "", name) in licenses.NAMES or prose and (bool(whole) or share >= licenses.MOSTLY))
        own[path] = (mine, is_file)
    out = {}
    for path in own:
        mine, is_file = own[path]
        licence, source = (mine[1] if mine else None), None
        at = path.split("/")[:-1]
        while not mine and licence is None:
            here = "/".join(at)
            given = [(m[0], p, m[1]) for p, (m, f) in own.items() if f and "/".join(p.split("/")[:-1]) == here]
            if given:
                licence, source = min(given)[2], here
            elif not at:
                break
            else:
                at.pop()
        out[path] = (mine and mine[1], is_file, licence, source)
    return out


APACHE_HEADER = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
"""


def wrapped(text, width=70):
    import textwrap

    return textwrap.fill(text, width)


def test_scan_against_brute_force(spark):
    text = dict(reversed(licenses.FILES))
    bsd3 = next(t for n, t in licenses.FILES if n == "BSD-3-Clause")
    mit = "MIT License\n\nCopyright (c) 2021 Some One\n\n" + wrapped(licenses._MIT) + "\n\n" + wrapped(licenses._MIT_REST)
    files = [
        ("LICENSE", mit), ("main.py", "import os\nprint(1)"), ("sub/x.c", "// SPDX-License-Identifier: GPL-2.0\nint x;"), ("sub/y.c", "int y;"),
        ("gpl/COPYING", wrapped(text["GPL-3.0"]) + "\n\n Preamble\n\nThe licenses for most software are designed to take away your freedom. " * 30), ("gpl/a/b/deep.c", "int z;"),
        ("bsd/LICENSE.txt", "Copyright (c) 2020, X\nAll rights reserved.\n\n" + wrapped(text["BSD-2-Clause"])), ("bsd/a.py", "x = 1"),
        ("bsd3/license.md", wrapped(bsd3)), ("bsd3/a.py", "x = 1"), ("hdr/short.py", APACHE_HEADER + "\nx = 1\n"), ("hdr/other.py", "y = 2"),
        ("notes/1", "Released under the MIT License."), ("notes/2", "plain words of a note"), ("isc/LICENSE", wrapped(text["ISC"])), ("un/UNLICENSE", wrapped(text["Unlicense"])), ("un/x.py", "a"), ("tie/a", "All rights reserved."), ("tie/b", "All rights reserved."), ("tie/c", "words"),
    ]
    got = {r.path: (r.own_license, r.is_license_file, r.license, r.inherited_from) for r in licenses.scan(spark.createDataFrame([(*f, 1, "d") for f in files], "path string, text string, dir int, given string")).collect()}
    assert got == brute_scan(files)
    assert got["LICENSE"][:2] == ("MIT", True) and got["main.py"][2:] == ("MIT", "") and got["sub/x.c"][0] == "GPL-2.0"
    assert got["gpl/COPYING"][:2] == ("GPL-3.0", True) and got["gpl/a/b/deep.c"][2:] == ("GPL-3.0", "gpl")
    assert got["bsd/LICENSE.txt"][0] == "BSD-2-Clause" and got["bsd3/license.md"][0] == "BSD-3-Clause"
    assert got["hdr/short.py"][:2] == ("Apache-2.0", False) and got["hdr/other.py"][2:] == ("MIT", "")
    assert got["isc/LICENSE"][0] == "ISC" and got["un/x.py"][2:] == ("Unlicense", "un") and got["notes/2"][2] == "MIT" and got["tie/c"][2:] == ("Proprietary", "tie")


def test_identifiers_and_long_texts():
    names, _, _ = licenses.Matcher().best([f"// SPDX-License-Identifier: {x}" for x in licenses.IDENTIFIERS] + ["SPDX-License-Identifier: Zlib"])
    assert names == [*licenses.IDENTIFIERS, None]
    long = "word " * 400_000 + "\n" + APACHE_HEADER
    assert licenses.paragraphs(long)[0][1] >= 4 and licenses.Matcher().file([long, ""]) == [None, None]


def test_query_scans_every_document(spark):
    import __spark_entry__

    q = __spark_entry__.queries()
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op1_byte_shards", "op4_fuzzy_lines", "op6_subword_toxicity", "op8_license_scan", "op9_flac_media"):
        assert q[name](spark, SF).count() == n


def test_pipeline_stages(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == pipeline.COLUMNS, name
        rows = out.collect()
        docs = spark.createDataFrame(rows, out.schema)
        assert len(rows) > 0.5 * len(before) and {r.doc_id for r in rows} <= set(before), name
    last = pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in last.select("doc_id").distinct().collect()} == {r.doc_id for r in rows}


def test_pipeline_judges_rows_not_identifiers(spark, tmp_path):
    """Rows of one doc_id, null ones too, go only for what is in them; columns of any name do no harm."""
    pipeline = pytest.importorskip("corpus_pipeline")
    item = " ".join(f"item{i}" for i in range(20))
    rng = np.random.default_rng(1)
    free = [" ".join(f"w{x}" for x in rng.integers(0, 10_000, 60)) for _ in range(8)]
    near = free[0].split()
    near[30] = "other"
    rows = [(1, free[0]), (1, free[1]), (1, free[2]), (1, free[2]), (2, " ".join(near)), (None, free[3]), (None, free[4]), (None, free[4]), (3, f"{free[5]} {item} end"), (3, free[6]), (None, f"{free[7]} {item}")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), "a", "b", "c") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _id string, _gone string, row string")
    sf = str(tmp_path)
    spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    kept = lambda f: sorted(((r.doc_id, r.text) for r in f(spark, docs, sf).collect()), key=str)
    assert kept(pipeline.drop_toxic) == sorted(rows, key=str)
    assert kept(pipeline.drop_leaks) == sorted((r for r in rows if item not in r[1]), key=str)
    assert kept(pipeline.drop_near_duplicates) == sorted({r for r in rows if r[0] != 2}, key=str)
    assert len(kept(pipeline.drop_repeated_lines)) == len(rows)


def test_pipeline_of_odd_rows(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    item = " ".join(f"item{i}" for i in range(20))
    rows = [(None, None, None, None, None), (None, "", "en", "s", 0), (1, None, None, None, None), (2, "", "en", "s", 0), (3, "same words in this text here", "en", "s", 28), (3, "same words in this text here", "en", "s", 28), (4, f"before {item} after", "en", "s", 9), (5, "w " * 50_000, "en", "s", 9)]
    sf = str(tmp_path)
    spark.createDataFrame([(1, "x", 0, 0), (2, "x", 1, 0)], "doc_id long, note string, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = spark.createDataFrame(rows, schema)
    for name, stage in pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf).collect()
        ids = [r.doc_id for r in kept]
        assert ids.count(None) == 2, name
        docs = spark.createDataFrame(kept, schema)
    assert 4 not in ids and ids.count(3) <= 1 and 5 in ids
    assert pipeline.STAGES[-1][1](spark, docs, sf).count() >= len(kept)
    none = docs.limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0
