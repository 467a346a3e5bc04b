"""Order over one long series without one task for all of it.

Rows are dealt by stretches of an ordering number (time in microseconds, a bar's number). Windows run within a stretch;
what lies before is a total of whole stretches, one row each, over which one small window runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400_000_000


def before(totals: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """totals (_stretch, ...): adds columns, aggregates over all earlier stretches."""
    w = Window.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumns({name: c.over(w) for name, c in columns.items()})


def dealt(rows: DataFrame, order: str, width: int = DAY) -> DataFrame:
    """rows with _stretch, the stretch of width that order lies in. A null order is in a stretch of its own, the first."""
    return rows.withColumn("_stretch", F.coalesce(F.floor(F.col(order) / width), F.lit(-(1 << 62))))


def numbered(rows: DataFrame, order: str, name: str, width: int = DAY) -> DataFrame:
    """Adds name: a row's number from 0 in order."""
    own = dealt(rows, order, width)
    counts = before(own.groupBy("_stretch").agg(F.count("*").alias("_n")), {"_before": F.sum("_n")})
    at = F.row_number().over(Window.partitionBy("_stretch").orderBy(order)) - 1
    return own.join(counts.select("_stretch", "_before"), "_stretch").withColumn(name, at + F.coalesce("_before", F.lit(0))).drop("_stretch", "_before")


def by_value(rows: DataFrame, value: str, parts: int = 64) -> DataFrame:
    """rows with _stretch, a part of the range of a number's values, by about equal counts. The limits are `parts` numbers on the driver."""
    limits = rows.agg(F.percentile_approx(value, [i / parts for i in range(1, parts)], 10_000)).first()[0] or []
    limits = F.array(*[F.lit(float(x)) for x in sorted(set(limits))]) if limits else F.array().cast("array<double>")
    return rows.withColumn("_stretch", F.size(F.filter(limits, lambda x: x < F.col(value))))


def average_rank(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Adds name: rank from 1 by value, ties sharing the mean of their places."""
    own = by_value(rows, value)
    counts = before(own.groupBy("_stretch").agg(F.count("*").alias("_n")), {"_before": F.sum("_n")})
    rank = F.rank().over(Window.partitionBy("_stretch").orderBy(value)) + (F.count("*").over(Window.partitionBy("_stretch", value)) - 1) / 2.0
    return own.join(counts.select("_stretch", "_before"), "_stretch").withColumn(name, rank + F.coalesce("_before", F.lit(0))).drop("_stretch", "_before")
