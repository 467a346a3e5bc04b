"""Rolling, expanding and summary statistics of series (series, t, value). Warm-up rows are null, never zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import inorder, over, rolling, safe_corr, upto, when_full
from . import stretches

MIN_CORRELATION = 8
Z_WINDOW = 20


def zscore(value: Column, keys: list[str], order: list[str], window: int) -> Column:
    """(value - mean) / population deviation over a full window; null while it fills or where nothing varies."""
    w = rolling(keys, order, window)
    return when_full(value, w, window, over(value - F.avg(value).over(w), F.stddev_pop(value).over(w)))


def pct_change(value: Column, keys: list[str], order: list[str], k: int = 1) -> Column:
    before = F.lag(value, k).over(inorder(keys, order))
    return over(value, before) - 1


def rolling_beta(pairs: DataFrame, target: str, benchmark: str, window: int, keys: list[str], order: list[str]) -> DataFrame:
    """Adds beta: covariance by variance (sample) of the two series' returns over a full window of returns."""
    r = pairs.withColumn("_y", pct_change(F.col(target), keys, order)).withColumn("_x", pct_change(F.col(benchmark), keys, order))
    both = F.col("_x").isNotNull() & F.col("_y").isNotNull()
    w = rolling(keys, order, window)
    x, y = F.when(both, F.col("_x")), F.when(both, F.col("_y"))
    beta = when_full(x, w, window, over(F.covar_samp(y, x).over(w), F.var_samp(x).over(w)))
    return r.withColumn("beta", beta).drop("_x", "_y")


def beta_summary(rows: DataFrame, by: tuple[str, ...] = (), order: str = "t") -> DataFrame:
    b = F.col("beta")
    positive, negative = F.avg((b > 0).cast("double")), F.avg((b < 0).cast("double"))
    return rows.where("beta is not null").groupBy(*by).agg(
        F.count("*").alias("windows"), F.max_by(b, F.col(order)).alias("latest"), F.avg(b).alias("mean"), F.median(b).alias("median"), F.stddev_pop(b).alias("deviation"), F.min(b).alias("min"), F.max(b).alias("max"),
        positive.alias("positive_share"), negative.alias("negative_share"), F.greatest(positive, negative).alias("sign_consistency"),
    )


def realized_volatility(value: Column, keys: list[str], order: list[str], window: int) -> Column:
    """Population deviation of a column of returns over a full window."""
    w = rolling(keys, order, window)
    return when_full(value, w, window, F.stddev_pop(value).over(w))


def discrepancy_volatility(value: Column, keys: list[str], order: list[str], window: int = 20, least: int = 5) -> Column:
    """Rolling population deviation from `least` values on, and 0 before."""
    w = rolling(keys, order, window)
    return F.coalesce(F.when(F.count(value).over(w) >= least, F.stddev_pop(value).over(w)), F.lit(0.0))


def regimes(rows: DataFrame, value: str, keys: list[str], window: int, low: float = 0.2, high: float = 0.8) -> DataFrame:
    """Adds volatility and regime (low, normal, high) by quantiles of all volatility so far; rows (keys, t, value).

    A series goes through one task in order of time, which keeps the volatilities so far in heaps: n log n steps.
    """
    order = ["t"]
    back = F.lag(value).over(inorder(keys, order))
    log_return = F.when((F.col(value) > 0) & (back > 0), F.ln(F.col(value) / F.nullif(back, F.lit(0.0))))
    out = rows.withColumn("_r", log_return).withColumn("volatility", realized_volatility(F.col("_r"), keys, order, window))
    out = expanding_quantiles(out, "volatility", keys, order, {"_low": low, "_high": high})
    v, a, b = F.col("volatility"), F.col("_low"), F.col("_high")
    label = F.when(v.isNull(), None).when(a == b, "normal").when(v <= a, "low").when(v >= b, "high").otherwise("normal")
    return out.withColumn("regime", label).drop("_r", "_low", "_high")


class RunningQuantile:
    """The exact quantile of the numbers so far, interpolated between neighbours: two heaps that part at its place."""

    def __init__(self, share: float):
        self.share, self.below, self.above = share, [], []

    def add(self, x: float) -> float:
        from heapq import heappop, heappush, heappushpop

        if self.below and x < -self.below[0]:
            heappush(self.above, -heappushpop(self.below, -x))
        else:
            heappush(self.above, x)
        place = self.share * (len(self.below) + len(self.above) - 1)
        while len(self.below) < int(place) + 1:
            heappush(self.below, -heappop(self.above))
        while len(self.below) > int(place) + 1:
            heappush(self.above, -heappop(self.below))
        low = -self.below[0]
        part = place - int(place)
        return low if part == 0 else (1 - part) * low + part * self.above[0]


def expanding_quantiles(rows: DataFrame, value: str, keys: list[str], order: list[str], shares: dict[str, float]) -> DataFrame:
    """Adds a column for each share: the quantile of all values up to the row, in order; null before the first value."""
    import pyarrow as pa
    from pyspark.sql import types as T

    def run(batches):
        own, found = None, []
        for batch in batches:
            values = batch.column(batch.schema.get_field_index(value)).to_pylist()
            names = zip(*[batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys], strict=True) if keys else [()] * len(values)
            out = []
            for key, v in zip(names, values, strict=True):
                if (key,) != own:
                    own, found, last = (key,), [RunningQuantile(s) for s in shares.values()], [None] * len(shares)
                if v is not None:
                    last = [q.add(v) for q in found]
                out.append(last)
            columns = [pa.array(c, pa.float64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.float64())] * len(shares)
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *shares])

    schema = T.StructType([*rows.schema.fields, *[T.StructField(c, T.DoubleType()) for c in shares]])
    dealt = rows.repartition(*keys) if keys else rows.repartition(1)
    return dealt.sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def regime_summary(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    n = lambda r: F.count_if(F.col("regime") == r)
    known = F.count("regime")
    share = [over(n(r).cast("double"), known.cast("double")).alias(f"{r}_share") for r in ("low", "normal", "high")]
    return rows.groupBy(*by).agg(known.alias("observations"), *[n(r).alias(r) for r in ("low", "normal", "high")], *share, F.count_if(F.col("regime").isNull()).alias("warm_up"))


def expanding_pearson(x: Column, y: Column, keys: list[str], order: list[str], least: int = 10) -> Column:
    """Pearson's correlation of all rows so far, by running sums of values less the first, within -1 and 1."""
    w = upto(keys, order)
    both = x.isNotNull() & y.isNotNull()
    a = F.when(both, x) - F.first(F.when(both, x), ignorenulls=True).over(w)
    b = F.when(both, y) - F.first(F.when(both, y), ignorenulls=True).over(w)
    return _pearson_of_sums(a, b, w, least)


def _pearson_of_sums(a: Column, b: Column, w, least: int) -> Column:
    n = F.count(a).over(w)
    sa, sb = F.sum(a).over(w), F.sum(b).over(w)
    cov = F.sum(a * b).over(w) - sa * sb / F.nullif(n, F.lit(0))
    va, vb = F.sum(a * a).over(w) - sa * sa / F.nullif(n, F.lit(0)), F.sum(b * b).over(w) - sb * sb / F.nullif(n, F.lit(0))
    r = over(cov, F.sqrt(F.greatest(va, F.lit(0.0)) * F.greatest(vb, F.lit(0.0))))
    return F.when(n >= least, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def with_expanding_pearson(rows: DataFrame, x: str, y: str, keys: list[str], order: list[str], name: str = "correlation", least: int = 10) -> DataFrame:
    """rows with expanding_pearson() in two steps, as window functions don't nest."""
    w = upto(keys, order)
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    out = rows.withColumn("_a", F.when(both, F.col(x)) - F.first(F.when(both, F.col(x)), ignorenulls=True).over(w)).withColumn("_b", F.when(both, F.col(y)) - F.first(F.when(both, F.col(y)), ignorenulls=True).over(w))
    return out.withColumn(name, _pearson_of_sums(F.col("_a"), F.col("_b"), w, least)).drop("_a", "_b")


def average_rank(value: str, keys: list[str]) -> Column:
    """Rank from 1, ties sharing the mean of their places."""
    peers = Window.partitionBy(*keys, value)
    return F.rank().over(Window.partitionBy(*keys).orderBy(value)) + (F.count("*").over(peers) - 1) / 2.0


def correlation(pairs: DataFrame, x: str, y: str, by: tuple[str, ...] = (), least: int = MIN_CORRELATION) -> DataFrame:
    """(by, n, pearson, spearman, reason): both null with a reason where there are too few pairs or a side is constant."""
    good = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    if by:
        good = good.withColumn("_rx", average_rank(x, list(by))).withColumn("_ry", average_rank(y, list(by)))
    else:
        good = stretches.average_rank(stretches.average_rank(good, x, "_rx"), y, "_ry")
    c = F.col
    own = good.groupBy(*by).agg(F.count("*").alias("n"), safe_corr(c(x), c(y)).alias("p"), safe_corr(c("_rx"), c("_ry")).alias("s"))
    few = F.col("n") < least
    reason = F.when(few, "insufficient_observations").when(F.col("p").isNull(), "constant_series")
    return own.select(*by, "n", F.when(~few, F.col("p")).alias("pearson"), F.when(~few, F.col("s")).alias("spearman"), reason.alias("reason"))


def lag_pairs(value: str, keys: list[str], order: list[str]) -> tuple[Column, Column]:
    """(previous value, change from it): the pairs of an AR(1) fit."""
    back = F.lag(value).over(inorder(keys, order))
    return back, F.col(value) - back


def ar1(rows: DataFrame, value: str, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, n, slope, intercept, r2) of the change on the previous value; null where that is constant."""
    back, change = lag_pairs(value, keys, order)
    p = rows.select(*keys, back.alias("x"), change.alias("y")).where("x is not null and y is not null")
    own = p.groupBy(*keys).agg(F.count("*").alias("n"), F.covar_pop("x", "y").alias("c"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.avg("x").alias("mx"), F.avg("y").alias("my"))
    slope = over(F.col("c"), F.col("vx"))
    return own.select(*keys, "n", slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"), over(F.col("c") * F.col("c"), F.col("vx") * F.col("vy")).alias("r2"))


def half_life(fits: DataFrame, least: int = 20, alpha: float = 0.05) -> DataFrame:
    """fits of ar1(): adds p_value, half_life and a reason where there is none."""
    from .special import p_of_correlation

    r = F.signum("slope") * F.sqrt("r2")
    out = fits.withColumn("p_value", F.when(F.col("n") >= 3, p_of_correlation(r, F.col("n"))))
    reason = F.when(F.col("n") < least, "insufficient_observations").when(F.col("slope").isNull(), "constant_series").when(F.col("p_value") >= alpha, "slope_not_significant").when(F.col("slope") >= 0, "not_mean_reverting")
    return out.withColumn("reason", reason).withColumn("half_life", F.when(F.col("reason").isNull(), -F.ln(F.lit(2.0)) / F.col("slope")))


def lead_lag(pairs: DataFrame, x: str, y: str, most: int, keys: list[str], order: list[str], least: int = MIN_CORRELATION) -> DataFrame:
    """(keys, lag, n, r): correlation of x with y `lag` rows later, for lags -most to most."""
    w = inorder(keys, order)
    wide = pairs.select(*keys, x, F.array(*[F.struct(F.lit(k).alias("lag"), F.lead(y, k).over(w).alias("y")) for k in range(-most, most + 1)]).alias("a"))
    each = wide.select(*keys, F.col(x).alias("x"), F.explode("a").alias("e")).select(*keys, "x", "e.lag", "e.y").where("x is not null and y is not null")
    own = each.groupBy(*keys, "lag").agg(F.count("*").alias("n"), safe_corr(F.col("x"), F.col("y")).alias("r"))
    return own.withColumn("r", F.when(F.col("n") >= least, F.col("r")))


def usable_lags(lags: DataFrame, alpha: float = 0.05, least_r: float = 0.2) -> DataFrame:
    from .special import p_of_correlation

    out = lags.withColumn("p_value", p_of_correlation(F.col("r"), F.col("n")))
    return out.withColumn("usable", F.coalesce((F.col("p_value") < alpha) & (F.abs("r") >= least_r), F.lit(False)))


def error_metrics(rows: DataFrame, discrepancy: str = "discrepancy", by: tuple[str, ...] = ("name",), z: str = "zscore") -> DataFrame:
    """Mean absolute error, root mean square, 95th percentile of the size, latest z-score that is known."""
    d = F.col(discrepancy)
    return rows.groupBy(*by).agg(F.count(d).alias("n"), F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), F.percentile(F.abs(d), 0.95).alias("p95"), F.max_by(F.col(z), F.when(F.col(z).isNotNull(), F.col("t"))).alias("latest_z"))
