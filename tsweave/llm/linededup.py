"""Operator 4: fuzzy removal of repeated lines over the whole corpus.

1. A text's lines are cut at line feeds and normalised: lower case, white space to single spaces, none at the ends.
   Equal normalised lines are one line from here on, known by a 64-bit hash.
2. Fingerprints. A line has 128 parities of its words: bit i tells whether it has an odd number of words of class i. An
   edit flips two at most, so lines within k edits are within 2k bits. (A SimHash gives no such bound: pairs at
   similarity 0.8 lie up to 17 of its 64 bits apart, and pigeonhole blocks for that radius have under four bits.)
3. Pigeonhole blocks. An edit breaks at most two pairs of neighbouring words. So of two lines within k edits each has,
   among its 2k + 1 rarest pairs in one order for all lines, one that the other has among its own (prefix_length() says
   how many exactly). So no pair is missed, whatever the data. Lines that share a block are candidates where lengths,
   the places of the block and fingerprints let them be within k edits.
4. Candidates whose edit similarity over words, 1 - distance / longer length, reaches SIMILARITY are linked. Words are
   compared by 20 bits of hash, one character each, so a line is a short string for the built-in edit distance.
   To spare groups the square of their size, the lines of a large bucket of which many may be alike are first tested
   against a few of them; then all its pairs are that aren't connected yet.
5. Of each connected group the first occurrence stays, by doc_id and place; the others go.

Blocks are numerous, two for each five words, and most are of one line only. They are shuffled as runs, each a batch's
keys and lines of one range of keys as bytes. A range is sorted in numpy and the pairs of a bucket are looked at there,
so that only those go on whose lengths and places let them be alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, delete_table, fresh, join_with_hot, partitions, release, text_or_empty, written
from .components import FEW, components_by_keys, connected_components
from .simhash import mixed

SIMILARITY = 0.8
#: Of about so many lines the commonest words are counted. The counts only order the pairs of words.
SAMPLE, COMMON = 40_000, 65_536
#: Lines of candidates, of 8 bytes each, whose words are looked up by a broadcast.
MOST_BROADCAST = 1_000_000
#: A range of keys has about so many; characters whose words are hashed at a time.
RANGE, CHUNK = 1_000_000, 4_000_000
#: Words of a line, and places among them, are told apart up to so many.
MANY = 255
#: All pairs of buckets of up to so many lines are looked at; so many a line may be similar for the pairs to be given.
WHOLE, SPARSE = 1_024, 8
#: Pairs that are looked at in one step.
PAIRS = 1_000_000
#: The size of a bucket that isn't known.
OPEN = np.iinfo(np.int32).max
_ODD = np.uint64(0x9E3779B97F4A7C15)


@cache
def _byte_hashes() -> np.ndarray:
    """A number for each byte at each of 64 places; none for the two that part words and lines."""
    h = mixed(mixed(np.arange(64 * 256, dtype=np.uint64) + _ODD))
    h = h.reshape(64, 256)
    h[:, [10, 32]] = 0
    return h.ravel()


def hashed_words(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word in turn, words of each line). lines: normalised, none empty."""
    found, count = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for some in _some(lines):
        b = np.frombuffer("\n".join(some).encode("utf-8", "surrogatepass"), np.uint8)
        cut = np.flatnonzero((b == 32) | (b == 10))
        starts = np.concatenate(([0], cut + 1))
        length = np.diff(starts, append=len(b) + 1)  # with the byte that ends it
        place = np.arange(len(b), dtype=np.int32) - np.repeat(starts.astype(np.int32), length)[: len(b)]
        value = _byte_hashes()[(place & 63) << 8 | b]
        if length.max() > 64:
            value = value * ((place >> 6).astype(np.uint64) * np.uint64(2) + np.uint64(1))
        found.append(mixed(np.add.reduceat(value, starts) + length.astype(np.uint64) * _ODD))
        last = np.append(np.flatnonzero(b[cut] == 10), len(starts) - 1)
        count.append(np.diff(last, prepend=-1))
    return np.concatenate(found), np.concatenate(count)


def _some(lines: list[str]) -> Iterator[list[str]]:
    """Runs of lines of about CHUNK characters together."""
    run, size = [], 0
    for x in lines:
        run.append(x)
        size += len(x)
        if size >= CHUNK:
            yield run
            run, size = [], 0
    if run:
        yield run


def codes(h: np.ndarray) -> np.ndarray:
    """One UTF-32 unit, of the 2^20 from 10000, for each word's hash."""
    return (h >> np.uint64(44)).astype(np.uint32) + np.uint32(0x10000)


def coded_lines(lines: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(the words as one character each, how many, 128 parities: bit i of a line's, whether it has an odd number of words i)."""
    h, n = hashed_words(lines)
    if not len(n):
        return [], n, np.zeros((0, 2), np.uint64)
    c = codes(h)
    at = c & np.uint32(127)
    odd = np.where((at >> 6)[:, None] == np.arange(2), np.uint64(1) << (at & np.uint32(63)).astype(np.uint64)[:, None], np.uint64(0))
    ends = np.cumsum(n)
    raw = c.astype("<u4").tobytes().decode("utf-32-le")
    return [raw[a:b] for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True)], n, np.bitwise_xor.reduceat(odd, ends - n, axis=0)


def allowed(n: int, similarity: float) -> int:
    """The edits that a line of n words, the longer of two, may be apart from the other."""
    return int(n * (1 - similarity) + 1e-9)


@cache
def prefix_length(n: int, similarity: float) -> int:
    """How many of its rarest pairs of words a line of n words is found by.

    A longer line of m words within k edits needs m - n insertions, which break one pair of the shorter line each; other
    edits break two. So m - 1 - 2k pairs are shared, and the rarest shared one is among the first n - 1 - (m - 1 - 2k) + 1.
    """
    near = [m for m in range(n, int(n / similarity + 1e-9) + 1) if allowed(m, similarity)]
    return min(n - 1, max((n - m + 2 * allowed(m, similarity) + 1 for m in near), default=0))


#: Four times the base-2 logarithm of a sample's words, about: how much rarer a pair is than the product of its words' counts.
_EXPECTED = 84


def _counted(found: np.ndarray, counted: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The logarithm that counted (values in order, logarithms) has for each value of found, or 0."""
    known, log = counted
    if not len(known):
        return np.zeros(len(found), np.int64)
    at = np.minimum(np.searchsorted(known, found), len(known) - 1)
    return np.where(known[at] == found, log[at], 0).astype(np.int64)


def pair_keys(coded: list[str], words: tuple[np.ndarray, np.ndarray], pairs: tuple[np.ndarray, np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line's place, key, about): the rarest pairs of neighbouring words of each line. The second of an equal pair is another one.

    about: the line's words times 256 and the pair's place among them, of which each is MANY at most. The place of a pair
    that the line has again is MANY, as either may be the one that another line has kept.

    words, pairs: those that a sample has more than once, in order, and logarithms of their counts. A pair is as common
    as the sample or else its words say: a passage that many lines share is of rare words, but its pairs are common.
    """
    n = np.array([len(x) for x in coded], np.int64)
    word = np.frombuffer("".join(coded).encode("utf-32-le"), "<u4")
    own = np.repeat(np.arange(len(n), dtype=np.uint64), n)
    first = np.flatnonzero(own[1:] == own[:-1])
    own = own[first]
    pair = word[first].astype(np.uint64) << np.uint64(32) | word[first + 1]
    key = mixed(pair)
    log = _counted(word, words)
    told = _counted(pair, pairs)
    rare = np.minimum(np.maximum(log[first] + log[first + 1], np.where(told > 0, told + _EXPECTED, 0)), 255).astype(np.uint64)
    o = np.argsort(own << np.uint64(44) | rare << np.uint64(36) | key >> np.uint64(28))
    own, key = own[o].astype(np.int64), key[o]
    at = np.minimum(first[o] - (np.cumsum(n) - n)[own], MANY)
    # an equal pair is beside it, being as rare: the second is another one
    new = np.concatenate(([True], (own[1:] != own[:-1]) | (key[1:] != key[:-1])))[: len(own)]
    if not new.all():
        place = np.arange(len(own))
        again = place - np.maximum.accumulate(np.where(new, place, 0))
        key = np.where(again > 0, mixed(key + again.astype(np.uint64)), key)
        at[~new | ~np.append(new[1:], True)] = MANY
    lead = np.cumsum(np.maximum(n - 1, 0)) - np.maximum(n - 1, 0)
    length, of = np.unique(n, return_inverse=True)
    most = np.array([prefix_length(x, similarity) for x in length.tolist()], np.int64)[of] if len(n) else n
    kept = np.arange(len(own)) - lead[own] < most[own]
    own = own[kept]
    return own, key[kept], (np.minimum(n, MANY)[own] << 8 | at[kept]).astype(np.uint16)


def runs(own: np.ndarray, key: np.ndarray, ranges: int, about: np.ndarray | None = None) -> tuple[np.ndarray, list[bytes]]:
    """(range, run): the keys and lines of each range of keys, 32 bits of a key, 64 of a line and 16 about both, one after another.

    Two keys of a range that are alike in their low 32 bits count as one, which makes a candidate and no link.
    """
    about = np.zeros(len(key), np.uint16) if about is None else about
    at = (key >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
    o = np.argsort(at, kind="stable")
    at, key, own, about = at[o], key[o], own[o], about[o]
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))[: len(at)]
    ends = np.append(first, len(at))[1:] if len(at) else first
    low = key.astype(np.uint32)
    return at[first].astype(np.int64), [low[a:b].tobytes() + own[a:b].tobytes() + about[a:b].tobytes() for a, b in zip(first.tolist(), ends.tolist(), strict=True)]


def near_places(x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    """Whether lines that share a pair of words may be of this similarity, by what pair_keys() says about each.

    Edits before the pair make up for the difference of its places, and edits after it for that of what follows.
    """
    most = np.array([allowed(n, similarity) for n in range(MANY + 1)], np.int16)
    n, m = (x >> 8).astype(np.int16), (y >> 8).astype(np.int16)
    p, q = (x & MANY).astype(np.int16), (y & MANY).astype(np.int16)
    shift, longer = p - q, n - m
    open_place = (p == MANY) | (q == MANY) | (n == MANY) | (m == MANY)
    return np.where(open_place, np.abs(longer), np.abs(shift) + np.abs(longer - shift)) <= most[np.maximum(n, m)]


class SharedKeys:
    """The rows (key, node, size, about) of one range whose key more than one node has, from its runs in turn.

    size: how many nodes a key has; of a range that is larger than `most`, for which not all runs are held at a time but
    one node of each key, it is a number above any. A key that very many lines share passes through in parts.
    """

    def __init__(self, at: int, most: int):
        self.at, self.most, self.held, self.size, self.parts = at, most, [], 0, 0
        self.known = (np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.uint16), np.zeros(0, bool))

    def hold(self, run: bytes) -> bool:
        """Whether with this run so many are held that rows() is due."""
        n = len(run) // 14
        self.held.append((np.frombuffer(run, np.uint32, n), np.frombuffer(run, np.int64, n, 4 * n), np.frombuffer(run, np.uint16, n, 12 * n)))
        self.size += n
        return self.size >= self.most

    def add(self, run: bytes) -> pd.DataFrame | None:
        return self.flush(False) if self.hold(run) else None

    def flush(self, last: bool) -> pd.DataFrame:
        """The rows since the last call, in the order of keys and nodes."""
        key, node, size, _ = self.rows(last)
        return pd.DataFrame({"key": key, "node": node, "size": size})

    def rows(self, last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        *old, told = self.known
        key, node, about = (np.concatenate([x, *[h[i] for h in self.held]]) for i, x in enumerate(old))
        new = np.arange(len(key)) >= len(told)
        new[: len(told)] = ~told
        self.held, self.size = [], 0
        o = np.argsort(key, kind="stable")
        key, node, about, new = key[o], node[o], about[o], new[o]
        start = np.concatenate(([True], key[1:] != key[:-1]))[: len(key)]
        first = np.flatnonzero(start)
        count = np.diff(np.append(first, len(key)))
        mixed_group = np.zeros(len(first), bool)
        if len(key):
            several = np.repeat(node[first], count) != node
            mixed_group = np.logical_or.reduceat(several, first)
        whole = last and not self.parts
        if not last:
            self.known = key[first], node[first], about[first], mixed_group
        self.parts += 1
        take = np.repeat(mixed_group, count)
        key, node, about, new = key[take], node[take], about[take], new[take]
        o = np.lexsort((node, key))
        key, node, about, new = key[o], node[o], about[o], new[o]
        once = np.concatenate(([True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])))[: len(key)]
        shown = np.logical_or.reduceat(new, np.flatnonzero(once)) if len(key) else new
        key, node, about = key[once], node[once], about[once]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))[: len(key)])
        size = np.repeat(np.diff(np.append(first, len(key))), np.diff(np.append(first, len(key)))) if whole else np.full(len(key), OPEN)
        key = mixed(key.astype(np.uint64) + (np.uint64(self.at) << np.uint64(48))).view(np.int64)
        return key[shown], node[shown], size[shown].astype(np.int32), about[shown]


def candidates(key: np.ndarray, node: np.ndarray, size: np.ndarray, about: np.ndarray, similarity: float) -> pd.DataFrame:
    """(key, a, b, size): pairs a < b of lines that may be similar, and the rows of large buckets, whose a is b.

    The rows are SharedKeys.rows(). All pairs of a bucket of up to WHOLE are looked at. Where more than SPARSE a line
    may be similar, or the bucket is larger, its rows are given instead of pairs, so that a group doesn't give its square.
    """
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))[: len(key)])
    count = np.diff(np.append(first, len(key)))
    bucket = np.repeat(np.arange(len(first)), count)
    looked = (count == size[first]) & (count <= WHOLE)
    after = np.where(looked[bucket], np.repeat(first + count, count) - np.arange(len(key)) - 1, 0)
    near = np.zeros(len(first), np.int64)
    found, done, ends = [], 0, np.cumsum(after)
    while done < len(key):
        to = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + PAIRS, "right")))
        n = after[done:to]
        x = np.repeat(np.arange(done, to), n)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
        may = near_places(about[x], about[y], similarity)
        found.append((x[may], y[may]))
        near += np.bincount(bucket[x[may]], minlength=len(first))
        done = to
    large = ~looked | (count > FEW) & (near > SPARSE * count)
    x, y = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in (0, 1))
    pair = ~large[bucket[x]]
    a, b = node[x[pair]], node[y[pair]]
    a, b = np.minimum(a, b), np.maximum(a, b)
    o = np.lexsort((b, a))
    a, b = a[o], b[o]
    once = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))[: len(a)]
    a, b, rows = a[once], b[once], large[bucket]
    none = np.zeros(len(a), np.int64)
    return pd.DataFrame({"key": np.append(none, key[rows]), "a": np.append(a, node[rows]), "b": np.append(b, node[rows]), "size": np.append(none, size[rows]).astype(np.int32)})


def verified(edges: DataFrame, lines: DataFrame, least: float) -> DataFrame:
    """The edges (a, b) whose lines (h, coded) are similar enough."""
    x, y = (lines.select(F.col("h").alias(c), F.col("coded").alias(v)) for c, v in ("ax", "by"))
    both = edges.join(x, "a").join(y, "b")
    most = f"cast(greatest(length(x), length(y)) * {1 - least}D + 1e-9D as int)"
    return both.where(f"abs(length(x) - length(y)) <= {most} and levenshtein(x, y, {most}) >= 0").select("a", "b")


def _common(found: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The commonest of the strings w of one or two characters, as numbers in order, and logarithms of their counts."""
    rows = found.groupBy("w").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "w").limit(COMMON).collect()
    value = np.array([ord(r.w[0]) if len(r.w) == 1 else ord(r.w[0]) << 32 | ord(r.w[1]) for r in rows], np.uint64)
    log = np.array([min(120, int(4 * np.log2(r.n))) for r in rows], np.uint8)
    o = np.argsort(value)
    return value[o], log[o]


def sharing_lines(lines: DataFrame, similarity: float) -> DataFrame:
    """Written (key, a, b, size): candidates() of lines that share a key. lines: (h, n, coded), where a line may recur."""
    total = lines.agg(F.count("*").alias("lines"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
    few = max(1, total.lines // SAMPLE)
    sample = written(lines.where(f"pmod(xxhash64(h), {few}) = 0").select("coded"), "line-sample")
    words = _common(sample.select(F.explode(F.split("coded", "")).alias("w")).where("w <> ''"))
    pairs = _common(sample.where("length(coded) > 1").select(F.explode(F.expr("transform(sequence(1, length(coded) - 1), i -> substring(coded, i, 2))")).alias("w")))
    keys = int(2 * (1 - similarity) * total.words) + total.lines
    ranges = max(partitions(lines.sparkSession), -(-keys // RANGE))
    most = 4 * RANGE

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own, key, about = pair_keys(pdf["coded"].tolist(), words, pairs, similarity)
            at, found = runs(pdf["h"].to_numpy()[own], key, ranges, about)
            yield pd.DataFrame({"at": at, "run": found})

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here = None
        for pdf in batches:
            for at, run in zip(pdf["at"].tolist(), pdf["run"], strict=True):
                if here is None or here.at != at:
                    if here is not None:
                        yield candidates(*here.rows(True), similarity)
                    here = SharedKeys(at, most)
                if here.hold(run):
                    yield candidates(*here.rows(False), similarity)
        if here is not None:
            yield candidates(*here.rows(True), similarity)

    run = lines.select("h", "coded").mapInPandas(cut, "at long, run binary")
    run = run.repartition(partitions(lines.sparkSession), "at").sortWithinPartitions("at")
    return written(run.mapInPandas(join, "key long, a long, b long, size int"), "candidates")


def within_edits(similarity: float):
    """Whether the rows x and y (n, odd, odd2) may be lines of this similarity, by their lengths and parities of words.

    Of k edits, as many as the lengths differ by add or remove a word and flip one parity; the others flip two.
    """
    most = f"cast(greatest(x.n, y.n) * {1 - similarity}D + 1e-9D as int)"  # D: a double, as decimals are slow
    return F.expr(f"abs(x.n - y.n) <= {most} and bit_count(x.odd ^ y.odd) + bit_count(x.odd2 ^ y.odd2) <= 2 * {most} - abs(x.n - y.n)")


def repeated_lines(docs: DataFrame, *, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Written (rid, gone): for each row with lines to go, their places from 0, in order. Rows are known by row_hash()."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for pdf in batches:
            row, place, norm = [], [], []
            for i, text in enumerate(pdf["text"]):
                for n, line in enumerate(text.lower().split("\n")):
                    if words := line.split():
                        row.append(i)
                        place.append(n)
                        norm.append(" ".join(words))
            if not norm:
                continue
            h = np.frombuffer(b"".join([xxhash.xxh64_digest(x.encode("utf-8", "surrogatepass"), 42) for x in norm]), ">i8").astype(np.int64)
            coded, n, odd = coded_lines(norm)
            own = pdf[["doc_id", "rid"]].iloc[row].assign(line=place, h=h, n=n, odd=odd[:, 0].view(np.int64), odd2=odd[:, 1].view(np.int64), coded=coded)
            own.loc[own["h"].duplicated().to_numpy(), "coded"] = None
            yield own

    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), row_hash(id_col, text_col).alias("rid"), text_or_empty(text_col).alias("text"))
    seen = texts.mapInPandas(run, "doc_id string, rid long, line int, h long, n int, odd long, odd2 long, coded string")
    seen = written(seen.withColumn("doc_id", F.col("doc_id").cast("long")), "lines", compression="zstd")
    distinct = written(seen.groupBy("h").agg(F.min("odd").alias("odd"), F.min("odd2").alias("odd2"), F.min("n").alias("n"), F.count("*").alias("times")), "distinct-lines")
    lines = seen.where("coded is not null").select("h", "n", "coded")
    about = distinct.select(F.col("h").alias("node"), "n", "odd", "odd2")
    found = sharing_lines(lines, similarity)
    release(docs.sparkSession)
    near = within_edits(similarity)
    pairs = found.where("a <> b").select("a", "b").distinct()
    for c, v in (("a", "x"), ("b", "y")):
        pairs = pairs.join(about.select(F.col("node").alias(c), F.struct("n", "odd", "odd2").alias(v)).hint("shuffle_merge"), c)

    def coded(wanted: DataFrame) -> DataFrame:
        if wanted.count() <= MOST_BROADCAST:  # beyond, the lines are shuffled
            wanted = F.broadcast(wanted)
        code = written(lines.join(wanted, "h", "left_semi").dropDuplicates(["h"]), "line-codes")
        release(docs.sparkSession)
        return code

    def test(edges: DataFrame) -> DataFrame:
        edges = written(edges, "line-pairs")
        release(docs.sparkSession)
        held = written(verified(edges, code, similarity), "links")
        delete_table(edges)
        return held

    pairs = written(pairs.where(near).select("a", "b"), "line-pairs")
    release(docs.sparkSession)
    code = coded(pairs.select(F.col("a").alias("h")).union(pairs.select("b")).distinct())
    known = written(verified(pairs, code, similarity), "links")
    delete_table(code)
    delete_table(pairs)
    member = found.where("a = b").select("key", F.col("a").alias("node"), "size")
    if member.isEmpty():
        label = written(connected_components(known), "line-groups")
    else:
        member = written(member.join(about.hint("shuffle_merge"), "node"), "bucket-members")
        delete_table(found)
        code = coded(member.select(F.col("node").alias("h")).distinct())
        label = written(components_by_keys(member, near, test, 1 / similarity, known), "line-groups")
        delete_table(code)
        delete_table(member)
    release(docs.sparkSession)
    # lines that occur once and are like no other stay, so only the rest is looked up among the occurrences
    known = distinct.join(label.select(F.col("node").alias("h"), "component"), "h", "left").where("times > 1 or component is not null")
    known = known.select("h", F.coalesce("component", "h").alias("group"), "times")
    total = seen.count()
    found = written(join_with_hot(seen.select("doc_id", "rid", "line", "h"), known, "h", "times", total).drop("h", "times"), "occurrences")
    first = found.groupBy("group").agg(F.min(F.struct("doc_id", "line", "rid")).alias("first"), F.count("*").alias("times"))
    gone = join_with_hot(found, written(first, "first-lines"), "group", "times", total)
    gone = gone.where("not (doc_id <=> first.doc_id and line = first.line and rid = first.rid)")
    gone = written(gone.select("rid", "line").distinct().groupBy("rid").agg(F.array_sort(F.collect_list("line")).alias("gone")), "lines-to-go")
    for t in (seen, distinct, label, found):
        delete_table(t)
    release(docs.sparkSession)
    return gone


def row_hash(id_col: str, text_col: str):
    return F.xxhash64(F.col(id_col).cast("long"), text_or_empty(text_col))


def without_repeated_lines(docs: DataFrame, *, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text_col less its repeated lines, and n_lines and n_removed; a column of those names is replaced.

    Defined results: blank lines stay; a null text stays null, with 0 lines; a text whose every line is repeated becomes
    empty, or keeps its blank lines; rows with the same identifier and text are one document, so both keep or lose the
    same lines; a null identifier sorts first; an empty table gives no rows; other columns stay, whatever their names.
    """
    gone = repeated_lines(docs, similarity=similarity, id_col=id_col, text_col=text_col)
    rid, places = fresh(docs, "rid"), fresh(docs, "gone")
    own = docs.withColumn(rid, row_hash(id_col, text_col)).join(gone.select(F.col("rid").alias(rid), F.col("gone").alias(places)), rid, "left")
    parts = F.split(text_col, "\n")
    # the array of one array binds the parts, which are then cut once and not for each line
    stay = F.transform(F.array(parts), lambda p: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(p) - 1), F.col(places)), lambda i: p[i]), "\n"))[0]
    kept = F.when(F.col(places).isNull(), F.col(text_col)).otherwise(stay)
    # a line feed is one byte, and bytes needn't be counted
    counted = own.withColumn("n_lines", F.coalesce(F.octet_length(text_col) - F.octet_length(F.replace(text_col, F.lit("\n"))) + 1, F.lit(0)).cast("long"))
    counted = counted.withColumn("n_removed", F.greatest(F.coalesce(F.size(places), F.lit(0)), F.lit(0)).cast("long"))
    return counted.withColumn(text_col, kept).drop(rid, places)
