"""Operator 3: packing by non-negative least squares.

Documents become ids, each ended by the end id. Of a document, every full window of `window` ids is a sequence of its own.
What remains of it is shorter than a window, and is packed:

1. Remainders are counted by length in BINS classes; a class stands for its greatest length.
2. A combination is one to DEPTH classes that fill a window exactly. Non-negative least squares finds how often each is
   repeated so that together they need the counts of the classes as nearly as can be, long classes weighing more.
3. Repeats are rounded down, so that no class is needed beyond its count; that makes sequences of combinations.
4. The remainders left over are packed greedily: one after another, cutting where a window is full, with no padding but
   in the very last one.

The histogram has BINS numbers and the solver's table about BINS^2 / 12 columns, whatever the size of the corpus.
The place of a remainder follows from its rank in its class, by counts of the classes in each task and their running
totals over tasks. No sort over all rows is needed, and no group is gathered in one task, though all lengths be the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, text_or_empty, written
from .wordbpe import crc_of_ids, encoded_batches, encoder

WINDOW = 4096
BINS, DEPTH = 128, 3


def combinations(bins: int = BINS, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """The descending lists of at most `depth` classes, 1 to bins, whose sum is bins."""
    found: list[tuple[int, ...]] = []

    def extend(head: tuple[int, ...], rest: int) -> None:
        if not rest:
            found.append(head)
        elif len(head) < depth:
            for c in range(min(rest, head[-1] if head else rest), 0, -1):
                extend((*head, c), rest - c)

    extend((), bins)
    return found


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 3_000) -> np.ndarray:
    """x >= 0 that makes |a x - b| small: accelerated projected gradients, ended once a step changes x by little."""
    if not b.any():
        return np.zeros(a.shape[1])
    gram, to = a.T @ a, a.T @ b
    step = 1 / np.linalg.norm(a, 2) ** 2
    x = y = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(y - step * (gram @ y - to), 0)
        if (y - new) @ (new - x) > 0:  # momentum leads uphill: start it anew
            t = 1.0
        u = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / u * (new - x)
        done = np.abs(new - x).max() <= 1e-7 * max(1.0, new.max())
        x, t = new, u
        if done:
            break
    return x


def plan(counts: np.ndarray, bins: int = BINS, depth: int = DEPTH) -> list[tuple[int, tuple[int, ...]]]:
    """(repeats, combination), which need no class more often than counts[class] says."""
    some = combinations(bins, depth)
    a = np.zeros((bins + 1, len(some)))
    for j, c in enumerate(some):
        np.add.at(a[:, j], list(c), 1)
    weight = np.sqrt(np.arange(bins + 1))
    scale = max(counts.max(), 1)
    x = nnls(a * weight[:, None], counts / scale * weight) * scale
    left, out = counts.astype(np.int64).copy(), []
    need = a.astype(np.int64)
    for j in np.argsort(-x, kind="stable"):
        classes = np.flatnonzero(need[:, j])
        n = min(int(x[j] + 1e-6), int((left[classes] // need[classes, j]).min()))
        if n > 0:
            left -= n * need[:, j]
            out.append((n, some[j]))
    return out


def tokenized(docs: DataFrame, vocabulary: str, end_id: int, window: int, bins: int, *, id_col: str, text_col: str) -> DataFrame:
    """Written rows (part, row, doc_id, n, class, rank, full, ids): a task's rows in turn, with what it counted so far.

    rank: rows of the same class before, in this task; full: full windows before. A task that is run again writes its
    rows again, and only the table that was committed is read.
    """
    bounded_batches(docs.sparkSession)
    step = -(-window // bins)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        enc = encoder(vocabulary)
        end = np.array([end_id], enc.dtype).tobytes()
        part, row, full, ranks = TaskContext.get().partitionId(), 0, 0, [0] * (bins + 1)
        for pdf in batches:
            ids_of = pdf["doc_id"].tolist()
            out: list[tuple] = []
            size = 0
            for i, ids in encoded_batches(vocabulary, pdf["text"].tolist()):
                n = len(ids) // enc.width + 1
                c = -(-(n % window) // step)
                out.append((part, row, ids_of[i], n, c, ranks[c], full, ids + end))
                row, full = row + 1, full + n // window
                ranks[c] += 1
                size += len(ids)
                if size > 16_000_000:
                    yield pd.DataFrame(out, columns=names)
                    out, size = [], 0
            if out:
                yield pd.DataFrame(out, columns=names)

    names = ["part", "row", "doc_id", "n", "class", "rank", "full", "ids"]
    rows = docs.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), text_or_empty(text_col).alias("text"))
    found = rows.mapInPandas(run, "part int, row long, doc_id string, n long, class int, rank long, full long, ids binary")
    return written(found.withColumn("doc_id", F.col("doc_id").cast("long")), "token-ids")


def pack(docs: DataFrame, vocabulary: str, end_id: int = 2, *, window: int = WINDOW, bins: int = BINS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (the piece's, binary).

    Defined results: a null text is an empty one, and every document has its end id, so each row gives a piece at least;
    rows with a null or repeated identifier are packed each; an empty table gives no rows; other columns are not read. A
    document's ids must fit in a task's memory.
    """
    spark = docs.sparkSession
    step = -(-window // bins)
    tokens = tokenized(docs, vocabulary, end_id, window, bins, id_col=id_col, text_col=text_col)
    by_class = written(tokens.where("class > 0").groupBy("part", "class").agg(F.count("*").alias("n")), "class-counts")
    counts = np.zeros(bins + 1, np.int64)
    for r in by_class.groupBy("class").agg(F.sum("n").alias("n")).collect():
        counts[r["class"]] = r.n
    # Ranks of a class go to the combinations in turn: (class, first rank, rank after the last, first sequence, places, ...).
    runs, taken, first = [], [0] * (bins + 1), 0
    for n, combination in plan(counts, bins):
        before = 0
        for c in sorted(set(combination), reverse=True):
            k = combination.count(c)
            runs.append((c, taken[c], taken[c] + n * k, first, k, before))
            taken[c] += n * k
            before += k
        first += n
    places = {c: sorted(r[1:] for r in runs if r[0] == c) for c in range(1, bins + 1)}
    slots = spark.createDataFrame([(c, taken[c], [tuple(r) for r in places[c]]) for c in range(1, bins + 1)], "class int, taken long, runs array<struct<a: long, b: long, first: long, k: int, before: int>>")

    of_class = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranks = by_class.select("part", "class", F.coalesce(F.sum("n").over(of_class), F.lit(0)).alias("ranks"))
    rest = tokens.select("part", "row", "n", "class", "rank", "full").join(ranks, ["part", "class"], "left")
    rest = rest.join(F.broadcast(slots), "class", "left")
    rest = rest.withColumn("rank", F.col("rank") + F.col("ranks")).withColumn("left", F.col("class") > 0)
    rest = rest.withColumn("packed", F.col("left") & (F.col("rank") < F.col("taken")))
    rest = rest.withColumn("run", F.try_element_at(F.expr("filter(runs, r -> rank >= r.a and rank < r.b)"), F.lit(1)))
    in_run = F.col("rank") - F.col("run.a")
    rest = rest.withColumn("combined", F.when(F.col("packed"), F.col("run.first") + F.floor(in_run / F.col("run.k"))))
    rest = rest.withColumn("place", F.when(F.col("packed"), F.col("run.before") + in_run % F.col("run.k")))
    loose = F.when(F.col("left") & ~F.col("packed"), F.col("n") % window).otherwise(0)
    rest = rest.withColumn("loose", F.sum(loose).over(Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)))
    rest = rest.withColumn("is_loose", F.col("left") & ~F.col("packed")).withColumn("loose", F.coalesce("loose", F.lit(0)))
    rest = written(rest.select("part", "row", F.col("n").alias("doc_tokens"), F.col("full"), "combined", "place", "loose", "is_loose", (F.col("n") % window).alias("tail")), "places")
    per_part = rest.groupBy("part").agg(F.sum(F.floor(F.col("doc_tokens") / window)).alias("f"), F.sum(F.when(F.col("is_loose"), F.col("tail")).otherwise(0)).alias("t"))
    totals, f, t = [], 0, 0
    for r in per_part.orderBy("part").collect():  # one row for each task
        totals.append((r.part, f, t))
        f, t = f + r.f, t + r.t
    loose_at = first
    full_at = loose_at + -(-t // window)
    rest = rest.join(F.broadcast(spark.createDataFrame(totals, "part int, f long, t long")), "part")
    # the offset in a combination: the lengths of the pieces with places before
    here = rest.where("combined is not null").select("part", "row", F.col("combined").alias("sequence_id"), "place", "tail")
    before = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    here = here.select("part", "row", "sequence_id", F.coalesce(F.sum("tail").over(before), F.lit(0)).alias("offset"))
    rest = rest.join(here, ["part", "row"], "left")
    rest = rest.select("part", "row", (F.col("f") + F.col("full") + full_at).alias("full"), "sequence_id", "offset", F.when(F.col("is_loose"), F.col("loose") + F.col("t")).alias("loose"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        width = encoder(vocabulary).width
        columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
        for pdf in batches:
            out: list[tuple] = []
            for doc, n, full, sequence, offset, loose, ids in pdf.itertuples(index=False):
                pieces = [(at, window, full + at // window, 0) for at in range(0, n - n % window, window)]
                at, tail = n - n % window, n % window
                if tail and not pd.isna(sequence):
                    pieces.append((at, tail, int(sequence), int(offset)))
                elif tail:
                    to = int(loose)
                    while tail:
                        part = min(tail, window - to % window)
                        pieces.append((at, part, loose_at + to // window, to % window))
                        at, to, tail = at + part, to + part, tail - part
                for start, length, sequence_id, off in pieces:
                    raw = ids[start * width : (start + length) * width]
                    out.append((doc, start, length, crc_of_ids(np.frombuffer(raw, f"<u{width}")), n, sequence_id, off, raw))
                if len(out) > 5_000:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
            if out:
                yield pd.DataFrame(out, columns=columns)

    whole = tokens.drop("full").join(rest, ["part", "row"]).select(F.col("doc_id").cast("string").alias("doc_id"), F.col("n"), "full", "sequence_id", "offset", "loose", "ids")
    found = whole.mapInPandas(cut, "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))
