"""As-of joins by union and window.

Rows of both sides are put together, and a running last() carries the other side's row to each left row. The window's
partition is a key and a stretch of time: a right row goes to every stretch where a left row within the tolerance can be,
so a single hot key is spread over many tasks and no match is lost. A stretch is STRETCH times the tolerance, so few
right rows go to two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ConfigurationError

STRETCH = 64
DIRECTIONS = ("backward", "forward", "nearest")


def asof_join(left: DataFrame, right: DataFrame, *, tolerance_us: int, direction: str = "backward", by: tuple[str, ...] = (), tie: str = "earlier", keep_unmatched: bool = False) -> DataFrame:
    """Left rows with the right row that is nearest in time, at most tolerance_us away (inclusive).

    Both sides have `t` (microseconds) and `seq` (order of rows of equal t) besides the keys in `by`. The right row comes
    as the struct column `match`. Of right rows of equal t, backward takes the last and forward the first. tie: which of
    two equally near rows nearest takes. Rows with a null t or key match nothing.
    """
    if direction not in DIRECTIONS or tie not in ("earlier", "later") or tolerance_us < 0:
        raise ConfigurationError("direction, tie or tolerance out of range")
    stretch = max(1, tolerance_us * STRETCH)
    l_row, r_row = F.struct(*left.columns), F.struct(*right.columns)
    keys = [F.col(k) for k in by]
    l_side = left.select(*keys, F.col("t").alias("_t"), F.col("seq").alias("_seq"), F.lit(0).alias("_side"), F.floor(F.col("t") / stretch).alias("_at"), l_row.alias("_l"), F.lit(None).cast(right.select(r_row.alias("x")).schema["x"].dataType).alias("_r"))
    span = F.sequence(F.floor((F.col("t") - tolerance_us) / stretch), F.floor((F.col("t") + tolerance_us) / stretch))
    r_side = right.where("t is not null").select(*keys, F.col("t").alias("_t"), F.col("seq").alias("_seq"), F.lit(1).alias("_side"), F.explode(span).alias("_at"), F.lit(None).cast(left.select(l_row.alias("x")).schema["x"].dataType).alias("_l"), r_row.alias("_r"))
    both = l_side.unionByName(r_side)
    part = Window.partitionBy(*by, "_at")
    before = part.orderBy("_t", F.desc("_side"), "_seq").rowsBetween(Window.unboundedPreceding, 0)
    after = part.orderBy(F.desc("_t"), F.desc("_side"), F.desc("_seq")).rowsBetween(Window.unboundedPreceding, 0)
    columns = {}
    if direction != "forward":
        columns["_b"] = F.last("_r", ignorenulls=True).over(before)
    if direction != "backward":
        columns["_f"] = F.last("_r", ignorenulls=True).over(after)
    both = both.withColumns(columns).where("_side = 0")
    match = F.col("_b") if direction == "backward" else F.col("_f") if direction == "forward" else _nearer(tie)
    near = F.abs(F.col("_t") - match["t"]) <= tolerance_us
    for k in by:  # a null key equals no key
        near = near & F.col(k).isNotNull()
    out = both.withColumn("match", F.when(near, match))
    if not keep_unmatched:
        out = out.where("match is not null")
    return out.select("_l.*", "match")


def _nearer(tie: str) -> Column:
    back, ahead = F.col("_t") - F.col("_b.t"), F.col("_f.t") - F.col("_t")
    first = back <= ahead if tie == "earlier" else back < ahead
    return F.when(F.col("_f").isNull() | first, F.col("_b")).otherwise(F.col("_f"))


def unmatched(left: DataFrame, right: DataFrame, joined: DataFrame) -> DataFrame:
    """One row: matched, unmatched_left (rows) and unmatched_right (rows less the distinct times that were matched)."""
    counts = joined.agg(F.count("*").alias("matched"), F.count_distinct("match.t").alias("times"))
    sizes = left.agg(F.count("*").alias("n_left")).crossJoin(right.agg(F.count("*").alias("n_right")))
    return counts.crossJoin(sizes).select("matched", (F.col("n_left") - F.col("matched")).alias("unmatched_left"), (F.col("n_right") - F.col("times")).alias("unmatched_right"))


def mutual_nearest(left: DataFrame, right: DataFrame, *, tolerance_us: int, by: tuple[str, ...] = ()) -> DataFrame:
    """One-to-one pairs, each the other's nearest; of two equally near rows the later is the nearest. Times are distinct."""
    there = asof_join(left, right, tolerance_us=tolerance_us, direction="nearest", by=by, tie="later")
    back = asof_join(right.select(*by, "t", "seq"), left.select(*by, "t", "seq"), tolerance_us=tolerance_us, direction="nearest", by=by, tie="later")
    pairs = back.select(*by, F.col("match.t").alias("t"), F.col("t").alias("_rt"))
    return there.withColumn("_rt", F.col("match.t")).join(pairs, [*by, "t", "_rt"], "left_semi").drop("_rt")


def multiway_asof(target: DataFrame, others: dict[str, DataFrame], *, tolerance_us: dict[str, int], by: tuple[str, ...] = ()) -> DataFrame:
    """target with the last value of every other series at or before it, each within its own tolerance; all must match.

    The series have t, seq and value; the result has the target's columns and one value column for each name.
    """
    out = target
    for name, series in others.items():
        own = out.columns
        out = asof_join(out, series, tolerance_us=tolerance_us[name], direction="backward", by=by)
        out = out.select(*own, F.col("match.value").alias(name)).where(F.col(name).isNotNull())
    return out
