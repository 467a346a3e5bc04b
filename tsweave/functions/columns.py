"""Column helpers that fix the library's conventions: UTC microseconds, null for what isn't known, no NaN, no division by zero."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp, with or without a zone."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def known(c: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def over(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return a / F.nullif(b, F.lit(0.0))


def rolling(keys: list[str], order: list[str], rows: int) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - rows, 0)


def upto(keys: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def inorder(keys: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def when_full(value: Column, frame: WindowSpec, rows: int, result: Column) -> Column:
    """result where the frame has `rows` values, else null."""
    return F.when(F.count(value).over(frame) == rows, result)


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson's correlation as an aggregate; null where a side is constant. Both sides must be null together."""
    return over(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def same(a: Column, b: Column, relative: float = 1e-9) -> Column:
    """Equal within a relative tolerance."""
    return F.abs(a - b) <= relative * F.greatest(F.abs(a), F.abs(b))
