"""Margin, fills, funding and latency: what an opportunity needs and what is left of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigurationError
from ..functions.columns import over

DAYS_PER_YEAR = 365
MIN_FILL_RATIO = 0.9
#: A share captured below this is marginal; a sweep is material from these shares of episodes and of edge.
MIN_CAPTURABLE, MATERIAL_EPISODES, MATERIAL_EDGE = 0.25, 0.25, 0.20
#: The per-leg latencies, in ms, that a sweep tries.
LATENCY_GRID = (1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0, 1000.0, 2500.0, 5000.0, 10000.0)


def margin(rows: DataFrame, leverage: float | None) -> DataFrame:
    """rows (volume, price, contract_size, margin_initial): adds notional, margin (null where unknown) and margin_source."""
    if leverage is not None and leverage <= 0:
        raise ConfigurationError("leverage must be positive")
    notional = F.col("volume") * F.col("contract_size") * F.col("price")
    reported = F.coalesce(F.col("margin_initial") > 0, F.lit(False))
    derived = notional / leverage if leverage else F.lit(None).cast("double")
    value = F.when(reported, F.col("margin_initial") * F.col("volume")).otherwise(derived)
    source = F.when(reported, "broker_reported").when(value.isNotNull(), "derived_from_leverage").otherwise("unavailable")
    return rows.withColumns({"notional": notional, "margin": value, "margin_source": source})


def total_if_all_known(c: str) -> Column:
    """A sum as an aggregate; null where one value is unknown."""
    return F.when(F.count(c) == F.count("*"), F.sum(c))


def round_down(volume: Column, step: Column) -> Column:
    return F.when(step <= 0, volume).otherwise(F.round(F.floor(volume / F.nullif(step, F.lit(0.0)) + 1e-9) * step, 10))


def fill(rows: DataFrame) -> DataFrame:
    """rows (volume, volume_min, volume_max, volume_step; null: no contract): adds fill_status, filled, fill_ratio, partial, limited_by."""
    known = F.col("volume_min").isNotNull() & F.col("volume_max").isNotNull() & F.col("volume_step").isNotNull()
    stepped, capped = round_down(F.col("volume"), F.col("volume_step")), round_down(F.col("volume_max"), F.col("volume_step"))
    below, above = stepped < F.col("volume_min"), F.col("volume") > F.col("volume_max")
    sunk = above & (capped < F.col("volume_min"))
    status = F.when(~known, "unknown_contract").when(below | sunk, "below_minimum").when(above, "above_maximum").otherwise("fillable")
    filled = F.when(~known | below | sunk, 0.0).when(above, capped).otherwise(stepped)
    limit = F.when(~known, "missing_contract_specification").when(below, "volume_min").when(sunk, "volume_max_rounds_below_volume_min").when(above, "volume_max").when(stepped < F.col("volume"), "volume_step")
    out = rows.withColumns({"fill_status": status, "filled": filled, "limited_by": limit})
    return out.withColumn("fill_ratio", F.least(F.lit(1.0), over(F.col("filled"), F.col("volume")))).withColumn("partial", (F.col("filled") > 0) & (F.col("filled") < F.col("volume")))


def funding(rows: DataFrame, daily_rate: float | None, triple_weekday: int = 2) -> DataFrame:
    """rows (start, end: dates; notional): adds nights, charged_nights, funding_cost, annualized_rate. Monday is weekday 0.

    A rollover on the triple weekday counts three times, every one in [start, end). Without a rate or a notional nothing
    accrues; the weekdays are counted by arithmetic, not by a row for each night.
    """
    nights = F.greatest(F.datediff("end", "start"), F.lit(0))
    to_first = F.pmod(F.lit(triple_weekday) - F.weekday("start"), F.lit(7))
    triples = F.when(nights > to_first, F.floor((nights - 1 - to_first) / 7) + 1).otherwise(0).cast("int")
    charged = F.when(F.lit(bool(daily_rate)) & F.col("notional").isNotNull(), nights + 2 * triples).otherwise(0)
    rate = F.lit(float(daily_rate) if daily_rate else None).cast("double")
    return rows.withColumns({"nights": nights, "charged_nights": charged, "funding_cost": F.coalesce(F.abs("notional") * rate * charged, F.lit(0.0)), "annualized_rate": rate * DAYS_PER_YEAR})


def execution(pairs: DataFrame, min_fill_ratio: float = MIN_FILL_RATIO) -> DataFrame:
    """pairs: structs a and b as margin() and fill() leave them. Adds executable, capital_verified, binding_fill_ratio, total_margin, blocking."""
    unknown = (F.col("a.fill_status") == "unknown_contract") | (F.col("b.fill_status") == "unknown_contract")
    binding = F.least("a.fill_ratio", "b.fill_ratio")
    blocks = []
    for s in "ab":
        blocks.append(F.when(F.col(f"{s}.fill_status") == "below_minimum", f"{s}: below the minimum volume"))
        blocks.append(F.when(F.col(f"{s}.fill_status") == "above_maximum", f"{s}: above the maximum volume"))
    blocks.append(F.when(~unknown & (binding < min_fill_ratio), "fill ratio too low"))
    blocking = F.filter(F.array(*blocks), lambda x: x.isNotNull())
    verified = F.col("a.margin").isNotNull() & F.col("b.margin").isNotNull()
    return pairs.withColumns({"blocking": blocking, "executable": F.size(blocking) == 0, "capital_verified": verified, "binding_fill_ratio": binding, "total_margin": F.when(verified, F.col("a.margin") + F.col("b.margin"))})


def mean_edge(peak: Column, offset: Column, duration: Column, round_trip: Column) -> Column:
    """Mean from round_trip to duration of an edge that rises from 0 to its peak at offset and falls to 0 at duration."""
    at = F.least(F.greatest(offset, F.lit(0.0)), duration)
    rise = F.when((at > 0) & (at > round_trip), peak * (at * at - round_trip * round_trip) / F.nullif(2.0 * at, F.lit(0.0))).otherwise(0.0)
    left = F.greatest(round_trip, at)
    rest = duration - left
    fall = F.when((duration > at) & (rest > 0), peak * rest * rest / F.nullif(2.0 * (duration - at), F.lit(0.0))).otherwise(0.0)
    return F.when((duration > 0) & (duration > round_trip), (rise + fall) / F.nullif(duration - round_trip, F.lit(0.0))).otherwise(0.0)


def latency_capture(episodes: DataFrame, per_leg_ms: Column | float, allowance: Column | float = 0.0, min_fraction: float = MIN_CAPTURABLE) -> DataFrame:
    """episodes (duration_ms, peak_edge, peak_offset_ms): adds round_trip_ms, fraction, captured_edge, net_captured_edge, status."""
    leg = per_leg_ms if isinstance(per_leg_ms, Column) else F.lit(float(per_leg_ms))
    d, trip = F.col("duration_ms"), F.lit(2.0) * leg
    fraction = F.when(d <= trip, 0.0).otherwise(over(d - trip, d))
    captured = mean_edge(F.col("peak_edge"), F.col("peak_offset_ms"), d, trip)
    out = episodes.withColumns({"round_trip_ms": trip, "fraction": fraction, "captured_edge": captured})
    out = out.withColumn("net_captured_edge", F.col("captured_edge") - (allowance if isinstance(allowance, Column) else F.lit(float(allowance))))
    gone = (F.col("fraction") <= 0) | (F.col("net_captured_edge") <= 0)
    return out.withColumn("status", F.when(gone, "not_capturable").when(F.col("fraction") < min_fraction, "marginal").otherwise("capturable"))


def latency_report(captures: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts and means of captures; the median is the upper of the two middle durations."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    middle = _upper_median(captures, by)
    own = captures.groupBy(*by).agg(F.count("*").alias("episodes"), count("capturable"), count("marginal"), count("not_capturable"), F.max("duration_ms").alias("max_duration_ms"), F.avg("peak_edge").alias("mean_peak_edge"), F.avg("captured_edge").alias("mean_captured_edge"), F.avg("net_captured_edge").alias("mean_net_captured_edge"))
    return own.join(middle, list(by)) if by else own.crossJoin(middle)


def _upper_median(captures: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """The element at count // 2 in order, from counts of distinct durations."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by)
    counts = captures.groupBy(*by, "duration_ms").count()
    counts = counts.withColumn("upto", F.sum("count").over(w.orderBy("duration_ms"))).withColumn("n", F.sum("count").over(w))
    return counts.where("upto > n div 2").groupBy(*by).agg(F.min("duration_ms").alias("median_duration_ms"))


def sensitivity_sweep(episodes: DataFrame, baseline_ms: float, grid: tuple[float, ...] = LATENCY_GRID, allowance: float = 0.0, min_fraction: float = MIN_CAPTURABLE) -> DataFrame:
    """One row for each latency of the grid: what is captured then. The grid has few rows and is broadcast."""
    values = sorted(set(grid))
    if not values or values[0] <= 0:
        raise ConfigurationError("latencies must be positive")
    steps = episodes.sparkSession.createDataFrame([(float(v),) for v in values], "value double")
    each = latency_capture(episodes.crossJoin(F.broadcast(steps)), F.col("value"), allowance, min_fraction)
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    points = each.groupBy("value").agg(n("capturable"), n("marginal"), n("not_capturable"), F.avg("captured_edge").alias("mean_captured_edge"), F.avg("peak_edge").alias("p"))
    share = F.when(F.col("p") != 0, F.col("mean_captured_edge") / F.nullif("p", F.lit(0.0))).otherwise(0.0)
    return points.select("value", (F.col("value") * 2).alias("round_trip_ms"), "capturable", "marginal", "not_capturable", "mean_captured_edge", share.alias("captured_share"), (F.col("capturable") > 0).alias("survives"), (F.col("value") == baseline_ms).alias("is_baseline"))


def adverse_move_sweep(episodes: DataFrame, per_leg_ms: float, grid: tuple[float, ...]) -> DataFrame:
    """One row for each adverse move: what is left of the captured edge after it."""
    steps = episodes.sparkSession.createDataFrame([(float(v),) for v in sorted(set(grid))], "value double")
    each = latency_capture(episodes.crossJoin(F.broadcast(steps)), per_leg_ms, F.col("value"))
    return each.groupBy("value").agg(F.count_if(F.col("status") == "capturable").alias("capturable"), F.avg("net_captured_edge").alias("mean_net_captured_edge"))


def fragility(points: DataFrame, baseline: float) -> DataFrame:
    """One row: how a latency sweep's verdict depends on the assumed value. A baseline off the grid survives nowhere."""
    n = F.col("capturable") + F.col("marginal") + F.col("not_capturable")
    step = F.array_min(F.expr("zip_with(slice(v, 1, size(v) - 1), slice(v, 2, size(v)), (a, b) -> b - a)"))
    own = points.agg(
        F.max(F.when(F.col("survives"), F.col("value"))).alias("highest_surviving"), F.min(F.when(F.col("survives"), F.col("value"))).alias("lowest_surviving"), F.min(F.when(~F.col("survives"), F.col("value"))).alias("lowest_failing"),
        F.coalesce(F.bool_or(F.col("is_baseline") & F.col("survives")), F.lit(False)).alias("baseline_survives"), F.coalesce(F.max(F.when(F.col("is_baseline"), F.col("capturable") / F.nullif(n, F.lit(0)))), F.lit(0.0)).alias("capturable_fraction"),
        F.coalesce(F.max(F.when(F.col("is_baseline"), F.col("captured_share"))), F.lit(0.0)).alias("captured_share"), F.array_sort(F.collect_list("value")).alias("v"),
    )
    own = own.withColumn("step", F.when(F.size("v") > 1, step).otherwise(0.0))
    span = F.col("highest_surviving") - F.col("lowest_surviving")
    label = (
        F.when(F.col("highest_surviving").isNull(), "always_fails").when((F.col("capturable_fraction") < MATERIAL_EPISODES) | (F.col("captured_share") < MATERIAL_EDGE), "nominal")
        .when(F.col("lowest_failing").isNull(), "always_holds").when((span == 0) | (F.col("step") > 0) & (span <= F.col("step")), "knife_edge").when(F.col("highest_surviving") <= baseline, "sensitive").otherwise("stable")
    )
    return own.select("highest_surviving", "lowest_failing", "baseline_survives", "capturable_fraction", "captured_share", label.alias("fragility"))


def latency_baseline(samples: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Statistics of measured round trips (round_trip_ms), and the per-leg latency of each."""
    good = samples.where("round_trip_ms > 0 and not isnan(round_trip_ms)")
    t = F.col("round_trip_ms")
    return good.groupBy(*by).agg(F.count("*").alias("samples"), F.avg(t).alias("mean"), F.median(t).alias("median"), F.percentile(t, 0.95).alias("p95"), F.max(t).alias("max"), F.min(t).alias("min"), (F.median(t) / 2).alias("per_leg_median"))
