"""Operator 7: near-duplicate documents by SimHash and covering locality-sensitive hashing.

A covering family of radius r has 2^(r+1) - 1 tables. Bit i of a fingerprint gets a vector c(i) of r+1 bits that isn't
zero; table v keeps the bits with c(i)·v = 1 (mod 2). Where two fingerprints differ in at most r bits, the vectors of
these bits span at most r dimensions, so some v other than zero is orthogonal to all of them: table v keeps none of the
bits that differ, and the two collide there. So no pair within the radius is missed, whatever the data.

Work on hot buckets stays linear. Two fingerprints within two bits of each other share a fingerprint within one bit of
both, and two that share one are within two bits. So in buckets over COLD members, each member is put under the 65
fingerprints within one bit of it (under radius 2), and whatever meets there is linked, at most 65 distinct ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, release, text_or_empty, written
from .components import FEW, components_by_keys, connected_components, shared_keys

#: Buckets of up to so many distinct fingerprints are compared pair by pair; larger ones by way of shared neighbours.
COLD = 512
RADIUS = 2
#: Identifiers of candidates whose texts are looked up by a broadcast.
MOST_BROADCAST = 1_000_000


def covering_masks(radius: int, bits: int = 64) -> list[int]:
    """The bits that each table keeps."""
    n = 1 << radius + 1
    vectors = [i % (n - 1) + 1 for i in range(bits)]
    return [sum(1 << i for i, c in enumerate(vectors) if (c & v).bit_count() & 1) for v in range(1, n)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def majority(hashes: np.ndarray) -> np.ndarray:
    """hashes: n x k unsigned 64-bit. For each of the k columns the bits that are set in over half the n."""
    n, k = hashes.shape
    if not n:
        return np.zeros(k, np.uint64)
    bits = np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8), axis=1, bitorder="little")
    total = np.zeros(bits.shape[1], np.int64)
    for at in range(0, n, 255):
        total += np.add.reduce(bits[at : at + 255], axis=0, dtype=np.uint8)
    return np.packbits(total * 2 > n, bitorder="little").view(np.uint64)


def words_of(text: str) -> list[bytes]:
    """Lower-cased (A-Z) words; bytes.split() cuts at space and 09 to 0D."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingle_fingerprint(text: str, size: int) -> np.ndarray:
    """The SimHash of a text's shingles of `size` words, by XXH64 with seed 42."""
    import xxhash

    w = words_of(text)
    if not w:
        return np.zeros(1, np.uint64)
    shingles = map(b" ".join, zip(*[w[i:] for i in range(size)], strict=False)) if len(w) >= size else [b" ".join(w)]
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(s, 42) for s in shingles])
    return majority(np.frombuffer(raw, ">u8").astype(np.uint64)[:, None])


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective mix of 64 bits, so that sums of hashes give hashes again."""
    h = h ^ h >> np.uint64(30)
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def shingle_set(text: str, size: int) -> np.ndarray:
    """The hashes of a text's distinct shingles of `size` words, in order."""
    import xxhash

    w = words_of(text)
    if not w:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_digest
    h = np.frombuffer(b"".join([digest(x, 42) for x in w]), ">u8").astype(np.uint64)
    n = max(1, len(h) - size + 1)
    s = np.zeros(n, np.uint64)
    for i in range(min(size, len(h))):
        s = mixed(s + h[i : i + n]) if i else mixed(h[:n])
    return np.unique(s)


def fingerprints(docs: DataFrame, how, *, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, prints): how(text) gives the prints of each document's whole text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [how(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "prints": [x.view(np.int64) for x in found]})

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), text_or_empty(text_col).alias("text"))
    found = rows.mapInPandas(run, "doc_id string, prints array<long>")
    return written(found.select(F.col("doc_id").cast("long").alias("doc_id"), "prints"), "fingerprints")


def links(items: DataFrame, radius: int = RADIUS, bits: int = 64, masks: list[int] | None = None) -> Links:
    """What connects items whose fingerprints of the same place in `prints` differ in at most `radius` bits.

    items: (node long, prints array<long>). Items of an equal fingerprint are linked to the first of them, and that one
    to the first items of other fingerprints. masks: the bits that each table keeps, if not those of the covering family.
    """
    each = items.select("node", F.posexplode("prints").alias("j", "p"))
    unit = written(each.groupBy("j", "p").agg(F.min("node").alias("node"), F.count("*").alias("n")), "prints")
    same = each.join(unit.where("n > 1").select("j", "p", F.col("node").alias("a")), ["j", "p"]).where("node <> a").select("a", F.col("node").alias("b"))
    masks = F.array(*[F.lit(signed(m)) for m in masks or covering_masks(radius, bits)])
    rows = unit.select("j", "p", "node", F.posexplode(masks).alias("t", "m"))
    rows = rows.select(F.xxhash64("j", "t", F.col("p").bitwiseAND(F.col("m"))).alias("key"), "j", "p", "node")
    bucket = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("p").alias("p"), F.max("p").alias("q"), F.min("node").alias("a"), F.max("node").alias("b"))
    bucket = written(bucket.where("n > 1"), "buckets")
    member = rows.join(bucket.where("n > 2").select("key", "n").hint("shuffle_merge"), "key")  # grows with the data: no broadcast
    return Links(same, bucket.where("n = 2"), written(member, "bucket-members"), radius, bits)


class Links:
    """Pairs (a, b) of near items, in two rounds, so that large groups don't give the square of their size.

    first() links each member of a bucket to one near member, if any, and all of a hot neighbourhood to its first one.
    rest(labels) gives every further pair of near members whose components differ, so with it nothing is missed: labels
    are the components (node, component) that all of first() has made. No test may drop some of first(): of an equal
    fingerprint only the first item is compared with others.
    """

    def __init__(self, same: DataFrame, twos: DataFrame, member: DataFrame, radius: int, bits: int):
        self.same, self.twos, self.member, self.radius, self.bits = same, twos, member, radius, bits
        self.near = f"bit_count(x.p ^ y.p) <= {radius}"

    def first(self) -> DataFrame:
        two = self.twos.where(f"bit_count(p ^ q) <= {self.radius}").select("a", "b")
        some = self.member.where(f"n <= {COLD}").groupBy("key").agg(F.collect_list(F.struct("p", "node")).alias("s"))
        some = some.select(F.explode(F.expr(f"transform(s, (x, i) -> struct(x.node as a, try_element_at(filter(slice(s, i + 2, {COLD}), y -> {self.near}), 1).node as b))")).alias("e"))
        some = some.select("e.a", "e.b").where("b is not null")
        hot = self._balls(self.member.select("j", "p", "node", "n", F.col("node").alias("component"))).select(F.array_min("s.node").alias("a"), F.explode("s.node").alias("b"))
        return _pairs(self.same.union(two).union(some).union(hot))

    def rest(self, labels: DataFrame) -> DataFrame:
        own = self.member.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        mixed_key = own.where(f"n <= {COLD}").groupBy("key").agg(F.collect_list(F.struct("p", "node", "component")).alias("s"))
        mixed_key = mixed_key.where("size(array_distinct(s.component)) > 1")
        some = mixed_key.select(F.explode(F.expr(f"flatten(transform(s, (x, i) -> transform(filter(slice(s, i + 2, {COLD}), y -> {self.near} and x.component <> y.component), y -> struct(x.node as a, y.node as b))))")).alias("e")).select("e.a", "e.b")
        hot = self._balls(own).where("size(array_distinct(s.component)) > 1")
        pairs = "flatten(transform(s, x -> transform(filter(s, y -> y.node > x.node and y.component <> x.component), y -> struct(x.node as a, y.node as b))))"
        return _pairs(some.union(hot.select(F.explode(F.expr(pairs)).alias("e")).select("e.a", "e.b")))

    def _balls(self, member: DataFrame) -> DataFrame:
        """(j, z, s): the members of hot buckets within one bit of z, at most bits + 1 of them; for a radius of two."""
        if self.radius != 2:
            raise ValueError("hot buckets are searched for a radius of two")
        flips = F.array(F.lit(0).cast("long"), *[F.lit(signed(1 << i)) for i in range(self.bits)])
        hot = member.where(f"n > {COLD}").select("j", "p", "node", "component").distinct()
        z = F.explode(F.transform(flips, lambda m: F.col("p").bitwiseXOR(m))).alias("z")
        balls = hot.select("j", "node", "component", z).groupBy("j", "z").agg(F.collect_list(F.struct("node", "component")).alias("s"))
        return balls.where("size(s) > 1")


def _pairs(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components_of(found: Links) -> DataFrame:
    """(node, component) by both rounds of links."""
    edges = written(found.first(), "links")
    labels = written(connected_components(edges), "labels")
    more = written(found.rest(labels), "links")
    if more.isEmpty():
        return labels
    return connected_components(edges.union(more))


def grouped(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """prints: written (doc_id, prints). Adds component_id, the smallest doc_id that links reach."""
    items = written(prints.groupBy("prints").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies")), "print-classes")
    label = components_of(links(items.where("node is not null").select("node", "prints"), radius))
    label = label.withColumnRenamed("component", "component_id")
    item = items.join(label, "node", "left").select("prints", F.coalesce("component_id", "node").alias("component_id"))
    return prints.join(item, "prints")


def simhash_components(docs: DataFrame, *, shingle: int = 3, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document, by the fingerprints of its shingles.

    Defined results: null and empty texts, and texts of white space, have fingerprint zero and link like any other; rows
    of equal text or id each give a row; a null identifier is never a component's, and its row gets the component of the
    rows it links to by an equal fingerprint, else null; an empty table gives no rows; other columns are not read.
    """

    def how(text: str):
        return shingle_fingerprint(text, shingle)

    found = grouped(fingerprints(docs, how, id_col=id_col, text_col=text_col), radius)
    return found.select("doc_id", F.lpad(F.lower(F.hex(F.col("prints")[0])), 16, "0").alias("fingerprint"), "component_id")


#: Places of parities(), at least.
PLACES = 512


def parities(s: np.ndarray) -> np.ndarray:
    """Bit i: whether s has an odd number of hashes i, for PLACES places or the power of two from twice the number on."""
    places = max(PLACES, 1 << int(2 * len(s) - 1).bit_length()) if len(s) else PLACES
    return np.packbits(np.bincount((s & np.uint64(places - 1)).astype(np.int64), minlength=places).astype(np.uint8) & 1).view(np.uint64)


#: The parities by which pairs are told apart where they meet: PLACES, in eight numbers.
FOLDS = [f"odd{i}" for i in range(PLACES // 64)]


def folded_parities(odd: str) -> list:
    """The FOLDS of a column of parities(): its numbers by their place mod their count, as PLACES divides the places."""
    return [F.expr(f"aggregate(sequence({i}, size({odd}) - 1, {len(FOLDS)}), 0L, (t, j) -> t ^ {odd}[j])").alias(c) for i, c in enumerate(FOLDS)]


def within_parities(similarity: float):
    """Whether the rows x and y (n, FOLDS or nulls) may be sets of this similarity: a hash that only one set has flips one parity at most."""
    apart = " + ".join(f"bit_count(x.{c} ^ y.{c})" for c in FOLDS)
    return F.expr(f"coalesce({apart} <= {(1 - similarity) / (1 + similarity)}D * (x.n + y.n) + 1e-9D, true)")


def hashed_set(text: str, size: int) -> tuple[np.ndarray, int]:
    """(shingle_set(), one hash of it)"""
    import xxhash

    s = shingle_set(text, size)
    return s, xxhash.xxh64_intdigest(s.tobytes(), 42)


def by_whole_sets(texts: DataFrame, items: DataFrame, shingle: int, similarity: float):
    """A test of edges (a, b) between items (node, doc_id, n, odd): the written ones whose sets of shingles are similar enough.

    The sets are cut again from texts (doc_id string, text), of the items of those edges only that parities let through.
    """

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [hashed_set(t, shingle) for t in pdf["text"]]
            yield pd.DataFrame({"node": np.array([x for _, x in found], np.uint64).view(np.int64), "shingles": [s.view(np.int64) for s, _ in found]})

    def test(edges: DataFrame) -> DataFrame:
        x, y = (items.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("odd").alias(f"o{c}")) for c in "ab")
        half = "if(size({0}) > size({1}), zip_with(slice({0}, 1, size({1})), slice({0}, size({1}) + 1, size({1})), (p, q) -> p ^ q), {0})"
        apart = F.expr(f"aggregate(zip_with({half.format('oa', 'ob')}, {half.format('ob', 'oa')}, (p, q) -> bit_count(p ^ q)), 0, (t, i) -> t + i)")
        edges = edges.join(x, "a").join(y, "b").where(apart <= F.expr(f"{(1 - similarity) / (1 + similarity)}D * (na + nb) + 1e-9D")).select("a", "b")
        edges = written(edges, "document-pairs")
        wanted = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
        ids = written(items.join(wanted, "node", "left_semi").select(F.col("doc_id").cast("string").alias("doc_id")).distinct(), "document-ids")
        if ids.count() <= MOST_BROADCAST:  # beyond, the texts are shuffled
            ids = F.broadcast(ids)
        whole = texts.join(ids, "doc_id", "left_semi").mapInPandas(sets, "node long, shingles array<long>")
        whole = written(whole.join(wanted, "node", "left_semi").dropDuplicates(["node"]), "shingles")
        x, y = (whole.select(F.col("node").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab")
        both = edges.join(x, "a").join(y, "b").withColumn("shared", F.size(F.array_intersect("sa", "sb")))
        return written(both.where(f"shared >= {similarity}D * (size(sa) + size(sb) - shared) - 1e-9D").select("a", "b"), "links")

    return test


def near_duplicates(docs: DataFrame, *, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, component_id of every document: texts whose sets of five-word shingles have this Jaccard similarity are linked.

    SimHash comes first: sets whose fingerprints differ in at most RADIUS bits are found by covering locality-sensitive
    hashing, as in simhash_components(), and those of a component that the whole sets verify are connected from there on.
    That radius doesn't reach all pairs of the similarity, so an exact way finds the rest. Sets of n and m shingles of the
    similarity t share at least t * max(n, m). So with all shingles in one order, by hash, the first n - ceil(t * n) + 1
    of the one and those of the other share a shingle: that finds every pair. Of those shingles a pair shares enough,
    or else it can't reach the similarity with all that come after. Each is then verified by the two whole sets, where
    the parities of the sets let it reach the similarity: a shingle that only one set has flips one of them. Some of them
    are looked at where two sets meet in a large bucket, so that sets with a passage in common and little else give no pair. Texts of
    equal sets are one item.
    Defined results for odd rows are those of simhash_components().
    """

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [hashed_set(t, shingle) for t in pdf["text"]]
            node = np.array([x for _, x in found], np.uint64).view(np.int64)
            keys = [s[: len(s) - int(np.ceil(len(s) * similarity - 1e-9)) + 1].view(np.int64) for s, _ in found]
            odd = [parities(s).view(np.int64) for s, _ in found]
            prints = [majority(s[:, None]).view(np.int64) for s, _ in found]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "node": node, "n": [len(s) for s, _ in found], "prints": prints, "odd": odd, "keys": keys})

    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), text_or_empty(text_col).alias("text"))
    found = texts.mapInPandas(heads, "doc_id string, node long, n int, prints array<long>, odd array<long>, keys array<long>")
    found = written(found.withColumn("doc_id", F.col("doc_id").cast("long")), "shingle-heads")
    items = written(found.where("doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("prints").alias("prints"), F.first("odd").alias("odd")), "shingle-sets")
    near = F.expr(f"least(x.n, y.n) >= {similarity}D * greatest(x.n, y.n) - 1e-9D")
    test = by_whole_sets(texts, items, shingle, similarity)
    alike = components_of(links(items.select("node", "prints"))).withColumnRenamed("component", "key")
    size = F.count("*").over(Window.partitionBy("key")).cast("int")
    alike = written(alike.withColumn("size", size).join(items.select("node", "n"), "node"), "print-members")
    release(docs.sparkSession)
    known = components_by_keys(alike, near, test, 1 / similarity).where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    known = written(known, "links")
    release(docs.sparkSession)
    keys = found.join(items.select("node", "doc_id"), ["node", "doc_id"], "left_semi").select(F.posexplode("keys").alias("rank", "key"), "node", "n")
    member = written(shared_keys(keys), "shared-shingles")
    release(docs.sparkSession)
    folded = items.select("node", *folded_parities("odd")).hint("shuffle_merge")
    member = member.join(folded, "node").withColumns({c: F.when(F.col("size") > FEW, F.col(c)) for c in FOLDS})  # small buckets give few pairs
    member = written(member, "shared-shingles")
    release(docs.sparkSession)
    # what comes before a shared one in both sets and what comes after it, too, is all that they can share
    reach = F.expr(f"least(x.rank, y.rank) + least(x.n - x.rank, y.n - y.rank) >= {similarity / (1 + similarity)}D * (x.n + y.n) - 1e-6D")
    # n - ceil(t * n) + 1 are among the first, so of the larger set so many come after them
    enough = F.expr(f"times + ceil({similarity}D * most - 1e-9D) - 1 >= {similarity / (1 + similarity)}D * (least + most) - 1e-6D")
    label = written(components_by_keys(member, near & reach & within_parities(similarity), test, 1 / similarity, known, enough), "document-groups")
    release(docs.sparkSession)
    item = items.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = item.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return found.select("doc_id", "node").join(item.join(first, "component").select("node", "component_id"), "node", "left").select("doc_id", "component_id")
