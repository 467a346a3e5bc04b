"""Tick and bar feeds: quality counts, duplicate policy and preparation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigurationError, DataQualityError

AGGREGATIONS = ("last", "none")


def _number(name: str):
    return F.expr(f"try_cast({name} as double)")


def _ill_typed(names: tuple[str, ...]):
    parts = [F.col(n).isNotNull() & (_number(n).isNull() | F.isnan(_number(n))) for n in names]
    return sum((F.count_if(p) for p in parts), F.lit(0)).cast("long")


def _missing(names: tuple[str, ...]):
    return sum((F.count_if(F.col(n).isNull()) for n in names), F.lit(0)).cast("long")


def duplicate_keys(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One row: the rows beyond the first of their key."""
    return rows.groupBy(*keys).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("duplicates"))


def tick_quality(ticks: DataFrame) -> DataFrame:
    """One row of counts over ticks (timestamp, broker, symbol, bid, ask)."""
    bid, ask = _number("bid"), _number("ask")
    at = F.expr("try_cast(timestamp as timestamp)")
    own = ticks.agg(
        F.count("*").alias("rows"),
        F.count_if(at.isNull()).alias("invalid_timestamps"),
        F.count_if(bid <= 0).alias("bid_not_positive"),
        F.count_if(ask <= 0).alias("ask_not_positive"),
        F.count_if(bid > ask).alias("crossed"),
        _missing(("bid", "ask")).alias("missing_prices"),
        _ill_typed(("bid", "ask")).alias("unreadable_prices"),
    )
    return own.crossJoin(duplicate_keys(ticks, ("timestamp", "broker", "symbol")))


def bar_quality(bars: DataFrame) -> DataFrame:
    """One row of counts over bars (timestamp, broker, symbol, open, high, low, close, volume)."""
    o, h, l, c, v = (_number(n) for n in ("open", "high", "low", "close", "volume"))
    own = bars.agg(
        F.count("*").alias("rows"),
        F.count_if((o <= 0) | (h <= 0) | (l <= 0) | (c <= 0)).alias("price_not_positive"),
        F.count_if(h < F.greatest(o, c)).alias("high_too_low"),
        F.count_if(l > F.least(o, c)).alias("low_too_high"),
        F.count_if(v < 0).alias("negative_volume"),
        _missing(("open", "high", "low", "close")).alias("missing_prices"),
        _ill_typed(("open", "high", "low", "close", "volume")).alias("unreadable_prices"),
    )
    return own.crossJoin(duplicate_keys(bars, ("timestamp", "broker", "symbol")))


def last_of_each_time(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Of rows with equal keys and t, the one of highest seq."""
    rest = F.struct(*rows.columns)
    return rows.groupBy(*keys, "t").agg(F.max_by(rest, "seq").alias("r")).select("r.*")


def prepare_ticks(rows: DataFrame, aggregation: str = "last") -> DataFrame:
    """Ticks (t, seq, symbol, bid, ask) fit for comparison: known positive prices that aren't crossed, one per time if 'last'."""
    if aggregation not in AGGREGATIONS:
        raise ConfigurationError(f"aggregation is one of {AGGREGATIONS}")
    good = rows.where("t is not null and bid > 0 and ask >= bid and not isnan(bid) and not isnan(ask) and ask < double('Infinity')")
    return last_of_each_time(good, ("symbol",)) if aggregation == "last" else good


def require_one_symbol(rows: DataFrame) -> DataFrame:
    """rows, or an error where they hold several symbols: a plain assertion on two values at most."""
    if len(rows.select("symbol").distinct().limit(2).collect()) > 1:
        raise DataQualityError("a feed holds several symbols")
    return rows


def require_columns(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    if missing := [n for n in names if n not in rows.columns]:
        raise DataQualityError(f"columns are missing: {', '.join(missing)}")
    return rows


def with_mid_and_spread(ticks: DataFrame) -> DataFrame:
    """Adds mid and spread of bid and ask."""
    return ticks.withColumn("mid", (F.col("bid") + F.col("ask")) / 2).withColumn("spread", F.col("ask") - F.col("bid"))


def batch_totals(rows: DataFrame, by: str = "symbol") -> DataFrame:
    """(by, rows): how many rows each batch has, and all together under 'total'."""
    each = rows.groupBy(by).agg(F.count("*").alias("rows"))
    return each.union(each.agg(F.lit("total"), F.coalesce(F.sum("rows"), F.lit(0))))


def source_clock(rows: DataFrame, offset_us: int) -> DataFrame:
    """t as UTC where it was a source's clock that is ahead by offset_us; the source's time stays as source_t."""
    return rows.withColumn("source_t", F.col("t")).withColumn("t", F.col("t") - offset_us)
