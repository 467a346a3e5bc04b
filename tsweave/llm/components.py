"""Connected components of a graph given by its edges, by alternating large-star and small-star steps, and those of items that share keys."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import delete, new_folder, release, written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every node that has an edge, with the smallest node it can reach.

    Nodes are of any type that can be ordered. Edges with a null end or from a node to itself count for nothing; repeated
    edges count once; without edges the result is empty. Each round is two joins on the edges that are left, written to
    the shared folder, and leaves fewer and shallower trees; it ends when a round changes nothing, after about the
    logarithm of the longest path. A node with very many edges is no bottleneck: minima are combined before the shuffle,
    and its side of the join is a plain shuffle join, which adaptive execution splits.
    """
    spark = edges.sparkSession
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    path, before = None, None
    while True:
        here = new_folder(spark, "components")
        e.write.parquet(here)
        if path:
            delete(spark, path)
        path = here
        e = spark.read.parquet(path)
        mark = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == before or not mark[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct()) if mark[0] else e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = mark
        e = _small_star(_large_star(e))


def _large_star(e: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest of its neighbours and itself."""
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    """Each node links its smaller neighbours and itself to the smallest of them. Edges come and go as (larger, smaller)."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    kept = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return kept.union(least.select("u", F.col("m").alias("v"))).distinct()


def shared_keys(keys: DataFrame) -> DataFrame:
    """The distinct rows of keys (key, node, ...) whose key more than one node has, with size, the rows of the key."""
    of_key = Window.partitionBy("key")
    both = keys.withColumn("_least", F.min("node").over(of_key)).withColumn("_most", F.max("node").over(of_key)).withColumn("size", F.count("*").over(of_key).cast("int"))
    return both.where("_least <> _most").drop("_least", "_most").distinct()


#: Of buckets of up to so many all pairs are tested at once.
FEW = 16


def components_by_keys(member: DataFrame, near: Column, test, ratio: float | None = None, known: DataFrame | None = None, enough: Column | None = None) -> DataFrame:
    """(node, component) of the nodes that are linked to another, of all pairs that share a key, are near and hold.

    member: written (key, node, n, size, ...), size the same for a key and at least its count of nodes, or not there; near: a condition
    on x and y, two rows of member, that a ratio of their n over `ratio`, if given, doesn't meet; test(edges) gives, written, those that
    hold. All pairs of a bucket of up to FEW are tested. In a larger one a row meets only those of its own band of n and
    of the next, as others can't be near. Its nodes are tested against up to four of each band, of which one has the most in
    common with others: with known but not enough, first each node in two of its buckets only, so that a large group that shares many keys gives a
    few pairs a node and not a few a node and key, then in all where the components still differ. Last come all pairs
    that aren't connected yet, so a large group of near items doesn't give the square of its size, though some of the
    bucket be like none, and no pair is left untested that could connect two components.
    known: written edges (a, b) that hold. enough: a condition, without which a pair can't hold, on times, the keys that it
    shares, and least and most, the n of its two nodes; pairs but those of the tests against four are held against it.
    """
    spark = member.sparkSession
    if "size" not in member.columns:
        member = member.withColumn("size", F.lit(FEW + 1))

    few, many = member.where(f"size <= {FEW}"), member.where(f"size > {FEW}")
    columns = [c for c in member.columns if c not in ("key", "node")]
    many = many.withColumn("band", F.floor(F.log(F.greatest("n", F.lit(1))) / math.log(ratio) + 1e-9).cast("int") if ratio else F.lit(0))
    # a copy with edits has lost some of the keys that the others share
    of_node, hashed = Window.partitionBy("node"), F.xxhash64("key")
    many = many.withColumn("shared", F.sum(F.least("size", F.lit(1 << 20)).cast("long")).over(of_node))
    many = many.withColumn("chosen", (hashed == F.min(hashed).over(of_node)) | (hashed == F.max(hashed).over(of_node)))
    many = many.withColumn("before", F.lag("key").over(of_node.orderBy(F.desc("size"), "key")))
    many = written(many, "large-buckets")
    row = F.struct("node", *columns, "component")
    several = _near_pairs(few, few, near, "x.key = y.key", "x.node < y.node")
    labels = None if known is None else written(connected_components(known), "labels")
    rounds = ("chosen", "true") if known is not None and enough is None else ("true",)
    for some in rounds:
        own = _labelled(many, labels)
        first = own.groupBy("key", "band").agg(F.min(row).alias("a"), F.max(row).alias("b"), F.min_by(row, F.xxhash64("node")).alias("c"), F.max_by(row, F.struct("shared", "node")).alias("d"))
        first = first.select("key", "band", F.explode(F.array_distinct(F.array("a", "b", "c", "d"))).alias("s"))
        first = first.select("key", F.explode(F.array(*[F.col("band") + i for i in (-1, 0, 1)])).alias("at"), "s.*")
        tried = _near_pairs(first, own.where(some), near, IN_BAND, "x.component <> y.component")
        if enough is None and some == rounds[0]:
            tried, several = several.union(tried), None
        held = test(tried.select("a", "b").distinct())
        release(spark)
        if labels is None or not held.isEmpty():
            labels = written(connected_components(_with_labels(held, labels)), "labels")
            release(spark)
    own = _labelled(many, labels)
    more = unconnected(own, near, once=enough is None)
    if enough is None:
        more = more.select("a", "b").distinct()
    else:
        more = more.union(several).groupBy("a", "b", "least", "most").agg(F.count("*").alias("times")).where(enough).select("a", "b")
    more = test(more)
    return labels if more.isEmpty() else connected_components(_with_labels(more, labels))


#: Rows x (with the band `at` in place of its own) and y of a large bucket that may be near.
IN_BAND = "x.key = y.key and x.at = y.band"


def _near_pairs(x: DataFrame, y: DataFrame, near: Column, on: str, where: str) -> DataFrame:
    """(a, b, least, most): the nodes a < b and the least and most of their n, of rows x and y that meet and are near."""
    both = x.alias("x").join(y.alias("y").hint("shuffle_merge"), F.expr(on)).where(F.expr(where) & near)
    return both.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"), F.least("x.n", "y.n").alias("least"), F.greatest("x.n", "y.n").alias("most"))


def unconnected(own: DataFrame, near: Column, once: bool) -> DataFrame:
    """(a, b, least, most): the near pairs of nodes of unlike components that share a key, for each such key.

    own: (key, node, n, band, before, component, ...). once: not where both have the same key before, as they meet there, too.
    """
    wide = own.withColumn("at", F.explode(F.array(F.col("band"), F.col("band") + 1)))
    where = "x.component <> y.component and (x.band < y.band or x.node < y.node)"
    return _near_pairs(wide, own, near, IN_BAND, where + " and not coalesce(x.before = y.before, false)" * once)


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """rows with the component of their node, which is the node where it has none."""
    if labels is None:
        return rows.withColumn("component", F.col("node"))
    return rows.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _with_labels(edges: DataFrame, labels: DataFrame | None) -> DataFrame:
    """edges, and one from each labelled node to its component."""
    return edges if labels is None else edges.union(labels.select(F.col("node").alias("a"), F.col("component").alias("b")))
