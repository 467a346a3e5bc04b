"""Coverage of a long panel (t, symbol, close): gaps, runs and the window that symbols share."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InsufficientDataError
from . import stretches


#: Bars that a task takes at a time.
BARS = 65_536


def grid(panel: DataFrame) -> DataFrame:
    """(t, bar): every time of the panel and its number from 1, in order.

    Numbers come from counts by day and running totals over days, so no task sorts the whole grid.
    """
    times = panel.select("t").distinct().withColumn("day", F.floor(F.col("t") / 86_400_000_000))
    days = times.groupBy("day").count().withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return times.join(days.select("day", "before"), "day").select("t", (F.row_number().over(Window.partitionBy("day").orderBy("t")) + F.col("before")).alias("bar"))


def symbol_coverage(panel: DataFrame) -> DataFrame:
    """(symbol, observations, first_t, last_t, fraction, largest_gap): gaps are runs of absent bars, at the ends too."""
    bars = grid(panel)
    n = bars.agg(F.count("*").alias("n"))
    seen = panel.where("close is not null").select("t", "symbol").distinct().join(bars, "t")
    w = Window.partitionBy("symbol").orderBy("bar")
    gaps = seen.withColumn("gap", F.col("bar") - F.coalesce(F.lag("bar").over(w), F.lit(0)) - 1)
    own = gaps.groupBy("symbol").agg(F.count("*").alias("observations"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.max("gap").alias("gap"), F.max("bar").alias("last_bar"))
    own = own.crossJoin(n)
    return own.select("symbol", "observations", "first_t", "last_t", (F.col("observations") / F.col("n")).alias("fraction"), F.greatest("gap", F.col("n") - F.col("last_bar")).alias("largest_gap"))


def full_rows(panel: DataFrame, symbols: int) -> DataFrame:
    """(t): the times at which so many symbols have a value."""
    return panel.where("close is not null").groupBy("t").agg(F.count_distinct("symbol").alias("n")).where(F.col("n") >= symbols).select("t")


def longest_run(flags: DataFrame) -> DataFrame:
    """flags (t, bar) of the bars that count: one row start_t, end_t, rows of the longest run without a missing bar, the first on ties."""
    run = stretches.numbered(flags, "bar", "_at", BARS).withColumn("g", F.col("bar") - F.col("_at")).drop("_at")
    found = run.groupBy("g").agg(F.min("t").alias("start_t"), F.max("t").alias("end_t"), F.count("*").alias("rows"))
    return found.orderBy(F.desc("rows"), "start_t").limit(1).select("start_t", "end_t", "rows")


def shared_window(panel: DataFrame, least_symbols: int) -> dict | None:
    """The longest window that a comparable set of symbols shares: {start, end, rows, symbols}; None without one.

    The driver keeps names and counts of symbols, no rows: each step is an aggregate over the panel. The longest run with
    enough symbols is found; symbols that fill it are taken, else a set grown greedily by the rows it shares, ties to the
    first by name; the run is then found anew for that set.
    """
    bars = grid(panel)
    seen = panel.where("close is not null").select("t", "symbol").distinct()
    first = longest_run(bars.join(full_rows(panel, least_symbols), "t")).first()
    if first is None:
        return None
    inside = seen.where(F.col("t").between(first.start_t, first.end_t))
    counts = sorted(inside.groupBy("symbol").count().collect(), key=lambda r: r.symbol)
    chosen = [r.symbol for r in counts if r["count"] == first.rows]
    if len(chosen) < least_symbols:
        chosen = [max(counts, key=lambda r: r["count"]).symbol]
        while len(chosen) < least_symbols:
            held = inside.where(F.col("symbol").isin(chosen)).groupBy("t").count().where(F.col("count") == len(chosen)).select("t")
            scores = {r.symbol: r["count"] for r in inside.where(~F.col("symbol").isin(chosen)).join(held, "t", "left_semi").groupBy("symbol").count().collect()}
            best = max(sorted(scores), key=lambda s: scores[s], default=None)
            if best is None or scores[best] <= 0:
                return None
            chosen.append(best)
    held = seen.where(F.col("symbol").isin(chosen)).groupBy("t").count().where(F.col("count") == len(chosen))
    run = longest_run(bars.join(held.select("t"), "t")).first()
    return run and {"start": run.start_t, "end": run.end_t, "rows": run.rows, "symbols": sorted(chosen)}


def require_usable(window: dict | None, least_rows: int) -> dict:
    if window is None:
        raise InsufficientDataError("no window is shared by enough symbols")
    if window["rows"] < least_rows:
        raise InsufficientDataError(f"the shared window has {window['rows']} rows of {least_rows}")
    return window


def pivoted(panel: DataFrame, symbols: list[str]) -> DataFrame:
    """One row for each time, a column for each symbol."""
    return panel.groupBy("t").pivot("symbol", symbols).agg(F.first("close"))


def at_times(panel: DataFrame, times: DataFrame) -> DataFrame:
    """The rows of panel at the times t of the other frame."""
    return panel.join(times.select("t"), "t", "left_semi")


def slice_of(panel: DataFrame, start: int, end: int) -> DataFrame:
    return panel.where(F.col("t").between(start, end))
