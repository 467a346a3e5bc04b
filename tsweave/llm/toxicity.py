"""Operator 6: toxicity by bags of subwords.

A word's vector is the mean of the vectors of its character n-grams, taken with marks at both ends, and of the word
itself; a document's is the mean of its distinct words'; a linear softmax over two classes makes it a probability. Vectors and
softmax are trained together, in numpy in one task, by Adagrad on a bounded sample of labelled documents. As n-grams share
vectors, a word that no training text has is judged by its parts.

The whole is linear after training, so each n-gram has one number, the difference of the two class scores of its vector.
Scoring looks up numbers, not vectors: Arrow splits the texts and numbers their distinct words, and each distinct word of
a batch is scored once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, text_or_empty

#: N-grams of so many characters; buckets for their hashes, which 16 bits can number; width of a vector.
NGRAMS = (3, 4, 5, 6)
BUCKETS, WIDTH = 1 << 16, 8
#: The training sample: the labelled documents of lowest hash, so many of each class.
PER_CLASS = 2_000
EPOCHS, BATCH, RATE, SEED = 10, 32, 1.0, 7
#: A document's mean is over its distinct words and so many words of vector zero, so that a few words alone don't decide.
EMPTY_WORDS = 8
#: ASCII that is no letter or digit parts words.
SPACED = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ h >> np.uint64(31)
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ h >> np.uint64(29)


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word): the n-grams of every word and the words themselves, with the word's number."""
    marked = "".join([f"<{w}>" for w in words])
    c = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    n = np.fromiter(map(len, words), np.int64, len(words)) + 2
    word = np.repeat(np.arange(len(words)), n)
    left = np.repeat(np.cumsum(n), n) - np.arange(len(c))  # characters up to the word's end, this one included
    h, buckets, of = np.zeros(len(c), np.uint64), [], []
    for size in range(1, max(NGRAMS) + 1):
        if len(c) < size:
            break
        h = _mix(h[: len(c) - size + 1] * np.uint64(31) + c[size - 1 :])
        if size in NGRAMS:
            at = np.flatnonzero(left[: len(h)] >= size)
            buckets.append(h[at])
            of.append(word[at])
    # the word itself, by sums over its characters that depend on their places
    place = np.arange(len(c), dtype=np.uint64) - np.repeat(np.cumsum(n) - n, n).astype(np.uint64)
    if len(words):
        whole = np.add.reduceat(_mix(c + (place + np.uint64(1)) * np.uint64(0x1000003)), np.cumsum(n) - n)
        buckets.append(_mix(whole))
        of.append(np.arange(len(words)))
    if not buckets:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return (np.concatenate(buckets) >> np.uint64(40) & np.uint64(BUCKETS - 1)).astype(np.int64), np.concatenate(of)


def split_words(texts: list[str]):
    """(words, index, ends): the distinct words of the texts; the number of each word in turn; where each text's end."""
    import pyarrow as pa
    import pyarrow.compute as pc

    raw = [t.lower().encode("utf-8", "replace").translate(SPACED) for t in texts]
    parts = pc.split_pattern(pa.array(raw, pa.large_binary()).cast(pa.large_string()), " ")
    coded = parts.flatten().dictionary_encode()
    index = coded.indices.to_numpy(zero_copy_only=False)
    ends = np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False))
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), index, ends


def _features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows (start, bucket, weight): each distinct word of a text has the same weight, shared among its subwords."""
    starts, buckets, weights = [0], [], []
    for t in texts:
        words = [w for w in split_words([t])[0] if w]
        b, of = subwords(words)
        share = (1 / np.maximum(np.bincount(of, minlength=len(words)), 1) / (len(words) + EMPTY_WORDS))[of] if words else np.zeros(0)
        total = np.bincount(b, share, BUCKETS) if len(b) else np.zeros(BUCKETS)
        at = np.flatnonzero(total)
        buckets.append(at.astype(np.uint16))
        weights.append(total[at].astype(np.float32))
        starts.append(starts[-1] + len(at))
    bucket = np.concatenate([*buckets, np.zeros(0, np.uint16)])
    buckets.clear()
    return np.array(starts), bucket, np.concatenate([*weights, np.zeros(0, np.float32)])


def softmax_of(features: tuple[np.ndarray, np.ndarray, np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vector of each bucket, weights of the two classes, their biases), trained on sparse rows and their labels."""
    starts, bucket, weight = features
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1, 1, (BUCKETS, WIDTH)).astype(np.float32) / 1000
    soft = rng.uniform(-1, 1, (WIDTH, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    params = [vectors, soft, bias]
    squares = [np.zeros_like(p) for p in params]
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for k in range(0, len(order), BATCH):
            rows = order[k : k + BATCH]
            n = starts[rows + 1] - starts[rows]
            row = np.repeat(np.arange(len(rows)), n)
            take = np.arange(n.sum()) + np.repeat(starts[rows] - (np.cumsum(n) - n), n)
            b, w = bucket[take], weight[take]
            seen, place = np.unique(b, return_inverse=True)
            dense = np.bincount(row * len(seen) + place, w, len(rows) * len(seen)).reshape(len(rows), -1).astype(np.float32)
            mean = dense @ vectors[seen]
            scores = mean @ soft + bias
            p = np.exp(scores - scores.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p /= len(rows)
            for x, g, q, at_rows in zip(params, (dense.T @ (p @ soft.T), mean.T @ p, p.sum(0)), squares, (seen, ..., ...), strict=True):
                q[at_rows] += g * g
                x[at_rows] -= RATE * g / (np.sqrt(q[at_rows]) + 1e-4)
    return vectors, soft, bias


def train(features: tuple[np.ndarray, np.ndarray, np.ndarray], labels: list[int], share: float) -> tuple[np.ndarray, float]:
    """(number of each bucket, bias). share: of label 1 among all labelled rows; the bias goes half the way to it."""
    y = np.array(labels, np.int64)
    if not len(y) or y.min() == y.max():
        only = 0.0 if not len(y) or not y.max() else 1.0
        return np.zeros(BUCKETS, np.float32), 8.0 * only - 4.0
    vectors, soft, bias = softmax_of(features, y)
    number = vectors @ (soft[:, 1] - soft[:, 0])
    sampled = y.mean()
    share = min(max(share, 1e-6), 1 - 1e-6)
    shift = np.log(share / (1 - share)) - np.log(sampled / (1 - sampled))
    return number, float(bias[1] - bias[0] + shift / 2)


def in_fold(id_col: str = "doc_id") -> Column:
    """True where the row is held out: the CRC-32 of its identifier as text is a multiple of five. False for null."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, per_class: int = PER_CLASS) -> tuple[np.ndarray, float]:
    """Train on the rows that aren't held out; the sample is bounded by per_class, whatever the input's size.

    Whole texts count. A text goes to the training task as its sparse row, which has at most BUCKETS numbers.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where("doc_id is not null and toxic is not null").where(~in_fold()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {int(r.toxic > 0): r.n for r in known.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    known = known.withColumn("h", F.xxhash64("doc_id"))
    sample = known.where("toxic <= 0").orderBy("h").limit(per_class).union(known.where("toxic > 0").orderBy("h").limit(per_class))
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    share = counts.get(1, 0) / max(1, sum(counts.values()))

    def sparse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [_features([t]) for t in pdf["text"]]
            yield pdf[["doc_id", "toxic"]].assign(h=pdf["h"], buckets=[b.tobytes() for _, b, _ in found], weights=[w.tobytes() for _, _, w in found])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [b for b in batches if len(b)]
        if not rows:
            return
        rows = pd.concat(rows).sort_values(["doc_id", "h"])
        bucket = np.frombuffer(b"".join(rows["buckets"]), np.uint16)
        weight = np.frombuffer(b"".join(rows["weights"]), np.float32)
        starts = np.concatenate(([0], np.cumsum([len(b) // 2 for b in rows["buckets"]])))
        number, bias = train((starts, bucket, weight), (rows["toxic"] > 0).astype(int).tolist(), share)
        yield pd.DataFrame({"number": [number.astype("<f4").tobytes()], "bias": [bias]})

    rows = whole.join(F.broadcast(sample.select("doc_id", "toxic")), "doc_id").select("doc_id", "toxic", F.xxhash64("text").alias("h"), "text")
    rows = rows.mapInPandas(sparse, "doc_id long, toxic int, h long, buckets binary, weights binary")
    found = rows.repartition(1).mapInPandas(run, "number binary, bias double").first()
    return (np.frombuffer(found.number, "<f4"), found.bias) if found else train(_features([]), [], 0.0)


class Scorer:
    def __init__(self, number: np.ndarray, bias: float, keep: int = 300_000):
        self.number, self.bias, self.keep, self.words = number, bias, keep, {}

    def scores(self, texts: list[str]) -> np.ndarray:
        words, index, ends = split_words(texts)
        if len(self.words) > self.keep:
            self.words = {}
        known = self.words
        new = [w for w in words if w not in known]
        for at in range(0, len(new), 100_000):
            some = new[at : at + 100_000]
            b, of = subwords(some)
            value = np.bincount(of, self.number[b], len(some)) / np.bincount(of, minlength=len(some))
            known.update(zip(some, value.tolist(), strict=True))
        value = np.fromiter(map(known.__getitem__, words), np.float64, len(words))
        n = len(words)
        text = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
        once = np.unique(text * n + index)
        text, index = once // max(n, 1), once % max(n, 1)
        real = np.fromiter(map(bool, words), bool, n)[index]
        text, index = text[real], index[real]
        mean = np.bincount(text, value[index], len(texts)) / (np.bincount(text, minlength=len(texts)) + EMPTY_WORDS)
        return 1 / (1 + np.exp(-np.clip(mean + self.bias, -50, 50)))


def toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """id_col, held_out, score, predicted of every document, by a model fitted on the labels that aren't held out.

    Labels are of doc_id and folds go by it; id_col, an integer, is what names a row in the result.

    Defined results: null and empty texts score what the bias alone gives; a label that is null or of no document is not
    used, and of several labels of a document the largest counts; without labels of both classes all score alike; rows
    with a null or repeated identifier are scored each; empty tables give no rows; other columns are not read.
    """
    number, bias = fit(docs, labels)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(number, bias)
        for pdf in batches:
            texts, out, at = pdf["text"].tolist(), [], 0
            while at < len(texts):
                to, chars = at, 0
                while to < len(texts) and (to == at or chars < 10_000_000):
                    chars += len(texts[to])
                    to += 1
                out.append(scorer.scores(texts[at:to]))
                at = to
            score = np.concatenate([*out, np.zeros(0)])
            yield pdf[["doc_id", "name"]].assign(score=score)

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col(id_col).cast("long").cast("string").alias("name"), text_or_empty().alias("text"))
    found = rows.mapInPandas(run, "doc_id string, name string, score double")
    return found.select(F.col("name").cast("long").alias(id_col), in_fold().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
