"""Operator 2: passages of a benchmark in documents, by SimHash of item-sized windows. DataFrame functions only.

1. A text is its lower-cased runs of letters and digits; a shingle is five of them in a row, as a 64-bit hash. An item of
   fewer words is one shingle of that size, and documents are searched for shingles of it too.
2. Windows. Each item looks at windows of its own length. A window without any shingle of the item has similarity zero,
   so the windows taken are those that put some shingle of a document where the item has it. This leaves out no window
   that could be reported, but for those of an item's length that hold its shingles at no common offset. Only places
   (row, start, length) are found at first, from single shingles; the windows are cut from the rows that have any.
3. Each distinct window and each item gets a SimHash over its shingles with their repeats.
4. Multi-index search: 64 bits are BLOCKS blocks. Where two fingerprints differ in at most RADIUS bits, some block
   differs in at most RADIUS // BLOCKS; windows are put under every value within one bit of each of their blocks and
   items under every value within the other bits, so an equal join finds all pairs within the radius. Those beyond it
   are dropped by the exact distance.
5. The weighted Jaccard similarity of the two bags of shingles decides.

Copies of a passage meet as one window from step 3 on, known by a 64-bit hash, however many documents hold them, and the
benchmark is broadcast only while its count of shingles, which is taken first, is at most MOST_BROADCAST.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, written

SHINGLE = 5
SIMILARITY = 0.8
BLOCKS, BLOCK_BITS = 4, 16
#: Of pairs at similarity 0.8 a few in ten thousand are further apart.
RADIUS = 19
#: Shingles of items, of about 40 bytes each in memory.
MOST_BROADCAST = 1_000_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _let(value: str, name: str, body: str) -> str:
    """body with `name` bound to value, which is then evaluated once whatever the optimizer puts in its place."""
    return f"transform(array({value}), {name} -> {body})[0]"


def shingles(w: str, size: int) -> Column:
    """Hashes of the runs of `size` words in the array column w; none where there are fewer words."""
    return F.transform(F.array(F.col(w)), lambda v: _runs(v, size))[0]


def _runs(v: Column, size: int) -> Column:
    """As shingles(), of a variable, which is evaluated once."""
    places = F.when(F.size(v) >= size, F.sequence(F.lit(0), F.size(v) - size)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(*[v[i + k] for k in range(size)]))


def shingles_of_text(size: int) -> Column:
    """The shingles of the column text."""
    return F.transform(F.array(words(F.col("text"))), lambda w: _runs(w, size))[0]


def simhash(s: str) -> Column:
    """The SimHash of an array column of 64-bit hashes: the bits set in over half of them.

    Sixteen sums each count four bits in lanes of 16 bits, for up to 32,767 hashes, as long sums must not overflow; longer arrays count in parts.
    """
    lane = int("1000100010001", 16)
    sums = "array(" + ", ".join(f"aggregate(slice(h, p * 32767 + 1, 32767), 0L, (t, x) -> t + (shiftrightunsigned(x, {k}) & {lane}L))" for k in range(16)) + ")"
    parts = f"transform(sequence(0, greatest(size(h) - 1, 0) div 32767), p -> {sums})"
    bit = "aggregate(parts, 0L, (n, c) -> n + (shiftrightunsigned(c[b % 16], 16 * (b div 16)) & 65535L)) * 2 > size(h)"
    whole = f"aggregate(sequence(0, 63), 0L, (f, b) -> f | if({bit}, shiftleft(1L, b), 0L))"
    return F.expr(_let(s, "h", _let(parts, "parts", whole)))


def _near(bits: int, most: int) -> list[int]:
    """Every difference of a block of this width in at most this many bits."""
    return [sum(1 << b for b in at) for n in range(most + 1) for at in combinations(range(bits), n)]


def _block(f: str) -> Column:
    return F.expr(f"shiftrightunsigned({f}, block * {BLOCK_BITS}) & {(1 << BLOCK_BITS) - 1}L")


def within_radius(windows: DataFrame, items: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(f, g, apart): every pair of a fingerprint f of windows and a fingerprint g of items at most `radius` bits apart."""
    # the optimizer takes the items' values for few, as they come from few rows; they are too many to broadcast
    blocks = F.explode(F.array(*[F.lit(b) for b in range(BLOCKS)])).alias("block")
    most = radius // BLOCKS

    def put(rows: DataFrame, f: str, bits: int) -> DataFrame:
        near = F.array(*[F.lit(d).cast("long") for d in _near(BLOCK_BITS, bits)])
        own = rows.select(F.col("f").alias(f)).distinct().select(f, blocks).select(f, "block", _block(f).alias("own"))
        return own.select(f, "block", F.explode(F.transform(near, lambda d: F.col("own").bitwiseXOR(d))).alias("value"))

    own, put_items = put(windows, "f", min(1, most)), put(items, "g", most - min(1, most))
    pairs = own.join(put_items.hint("shuffle_merge"), ["block", "value"]).select("f", "g", F.bit_count(F.col("f").bitwiseXOR(F.col("g"))).alias("apart"))
    return pairs.where(F.col("apart") <= radius).distinct()


def weighted_jaccard(pairs: DataFrame) -> DataFrame:
    """pairs: (w, i, window, item): two arrays of hashes and what names them. (w, i, similarity): shared repeats by all repeats, as sums over hashes."""
    side = [pairs.select("w", "i", F.explode(c).alias("x"), F.lit(int(c == "window")).alias("a"), F.lit(int(c == "item")).alias("b")) for c in ("window", "item")]
    count = side[0].union(side[1]).groupBy("w", "i", "x").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return count.groupBy("w", "i").agg((F.sum(F.least("a", "b")) / F.sum(F.greatest("a", "b"))).alias("similarity"))


def leaks(docs: DataFrame, benchmark: DataFrame, *, shingle: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, start_word, n_words, bits_apart, similarity: the most similar window of each item in each document.

    Defined results: null texts count as empty; items without words give no row; an item of fewer than five words is
    found where its words stand in a row; items of the same text each give rows; rows of the same doc_id are one document,
    a null doc_id included; of equally similar windows the first is returned, and of equally similar rows of one document
    the one that starts first; empty tables give no rows; other columns are not read.
    """
    item = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words(text_or_empty()).alias("w")).where("size(w) > 0")
    own = shingles("w", shingle)
    for n in range(1, shingle):
        own = F.when(F.size("w") == n, shingles("w", n)).otherwise(own)
    item = item.select("item_id", F.least(F.size("w"), F.lit(shingle)).alias("words"), own.alias("item"))
    item = written(item.select("item_id", "words", "item", F.xxhash64("item").alias("i"), F.size("item").alias("n"), simhash("item").alias("f")), "items")
    sizes = sorted(r.words for r in item.select("words").distinct().collect())  # one to five
    where = item.select("words", "n", F.posexplode("item").alias("at", "x")).distinct()
    small = where.count() <= MOST_BROADCAST
    doc = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("row", F.xxhash64("doc_id", "text"))
    start = F.greatest(F.col("pos") - F.col("at"), F.lit(0)).alias("start")
    hit = None
    for n in sizes:
        known = where.where(F.col("words") == n)
        some = doc.select("row", F.posexplode(shingles_of_text(n)).alias("pos", "x")).join(F.broadcast(known) if small else known, "x")
        some = some.select("row", "words", start, "n").distinct()
        hit = some if hit is None else hit.union(some)
    if hit is None:
        hit = doc.select("row", F.lit(0).alias("words"), F.lit(0).alias("start"), F.lit(0).alias("n")).limit(0)
    place = written(hit.groupBy("row").agg(F.collect_list(F.struct("words", "start", "n")).alias("places")), "places")
    whole = doc.join(place, "row")
    cut = None
    for n in sizes or [shingle]:
        window = F.transform(F.array(shingles_of_text(n)), lambda s: F.transform(F.filter("places", lambda p: p["words"] == n), lambda p: F.struct(p["start"].alias("start"), F.slice(s, p["start"] + 1, p["n"]).alias("window"))))[0]  # noqa: B023
        some = whole.select("doc_id", F.lit(n).alias("words"), F.explode(window).alias("e")).select("doc_id", "words", "e.start", "e.window")
        cut = some if cut is None else cut.union(some)
    seen = written(cut.withColumn("w", F.xxhash64("window")), "windows")
    window = written(seen.groupBy("w").agg(F.first("window").alias("window")).withColumn("f", simhash("window")), "distinct-windows")
    near = within_radius(window, item, radius)
    pairs = written(near.join(window, "f").join(item.select(F.col("f").alias("g"), "i", "item").dropDuplicates(["g", "i"]), "g"), "near-windows")
    found = weighted_jaccard(pairs.select("w", "i", "window", "item")).where(F.col("similarity") >= similarity)
    found = found.join(pairs.select("w", "i", "apart"), ["w", "i"]).join(item.select("item_id", "i"), "i")
    row = seen.select("doc_id", "words", "start", "w", F.size("window").alias("n")).join(found, "w")
    best = F.struct(F.col("similarity"), -F.col("start"), -(F.col("n") + F.col("words") - 1), -F.col("apart"))
    top = row.groupBy("doc_id", "item_id").agg(F.max(best).alias("m"))
    return top.select("doc_id", "item_id", (-F.col("m.col2")).cast("long").alias("start_word"), (-F.col("m.col3")).cast("long").alias("n_words"), (-F.col("m.col4")).cast("long").alias("bits_apart"), F.round("m.similarity", 6).alias("similarity"))
