"""Two feeds of one instrument: edges, opportunity episodes and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .asof import asof_join, mutual_nearest

A_TO_B, B_TO_A = "buy_a_sell_b", "buy_b_sell_a"
#: The gap that ends an episode where the feed is too short to have a rhythm; else so many of its median steps.
SHORT_GAP_MS, GAP_STEPS = 1_000.0, 50


def align(a: DataFrame, b: DataFrame, tolerance_us: int, mode: str = "anchor", by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """a's ticks with b's nearest: t, seq, symbol, bid, ask, b_t, b_bid, b_ask, delay_ms (b less a)."""
    join = mutual_nearest(a, b, tolerance_us=tolerance_us, by=by) if mode == "symmetric" else asof_join(a, b, tolerance_us=tolerance_us, direction="nearest", by=by)
    return join.select("t", "seq", *by, "bid", "ask", F.col("match.t").alias("b_t"), F.col("match.bid").alias("b_bid"), F.col("match.ask").alias("b_ask"), ((F.col("match.t") - F.col("t")) / 1000.0).alias("delay_ms"))


def directional_edges(aligned: DataFrame, cost: float) -> DataFrame:
    """Adds a_to_b and b_to_a, the gross edges of both directions, and gross_edge, net_edge and direction of the wider."""
    forth, back = F.col("b_bid") - F.col("ask"), F.col("bid") - F.col("b_ask")
    gross = F.greatest(forth, back)
    return aligned.withColumns({"a_to_b": forth, "b_to_a": back, "gross_edge": gross, "net_edge": gross - cost, "direction": F.when(forth >= back, A_TO_B).otherwise(B_TO_A)})


def episode_gap(ticks: DataFrame, tolerance_us: int, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """(by, gap_ms): the silence that ends an episode, by the feed's own rhythm."""
    step = (F.col("t") - F.lag("t").over(Window.partitionBy(*by).orderBy("t", "seq"))) / 1000.0
    steps = ticks.withColumn("step", step).groupBy(*by).agg(F.count("*").alias("n"), F.median(F.when(F.col("step") > 0, F.col("step"))).alias("m"))
    gap = F.when((F.col("n") < 3) | F.col("m").isNull(), SHORT_GAP_MS).otherwise(F.greatest(F.col("m") * GAP_STEPS, F.lit(tolerance_us / 1000.0)))
    return steps.select(*by, gap.alias("gap_ms"))


def episodes(edges: DataFrame, gap_us: int, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Runs of crossable rows (net_edge > 0) no more than gap_us apart: one row each, told by its first row of widest net edge."""
    order = Window.partitionBy(*by).orderBy("t", "seq")
    rows = edges.where("net_edge > 0").withColumn("new", (F.col("t") - F.lag("t").over(order) > gap_us).cast("int"))
    rows = rows.withColumn("episode", F.sum(F.coalesce("new", F.lit(1))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.max_by(F.struct("direction", "t"), F.struct("net_edge", -F.col("t"), -F.col("seq")))
    found = rows.groupBy(*by, "episode").agg(
        F.min("t").alias("start_us"), F.max("t").alias("end_us"), F.count("*").alias("observations"), F.max("gross_edge").alias("max_gross_edge"),
        F.max("net_edge").alias("max_net_edge"), F.avg("net_edge").alias("mean_net_edge"), best.alias("best"),
    )
    return found.select(*by, "episode", F.col("best.direction").alias("direction"), "start_us", "end_us", ((F.col("end_us") - F.col("start_us")) / 1000.0).alias("duration_ms"), "observations", "max_gross_edge", "max_net_edge", "mean_net_edge", ((F.col("best.t") - F.col("start_us")) / 1000.0).alias("peak_offset_ms"))


def period_hours(t: str = "t"):
    """Hours from first to last, at least a second."""
    return F.greatest((F.max(t) - F.min(t)) / 3_600_000_000.0, F.lit(1 / 3600.0))


#: The labels of a comparison by what is known of its contracts.
VERDICTS = {
    "unverified": "crossable_research_contract_unverified",
    "normalization_required": "crossable_after_cost_pnl_normalized_research",
    "compatible": "crossable_after_cost_contract_validated_research",
}
BLOCKED_BY_CONTRACT, BLOCKED_BY_EXECUTION = "blocked_by_contract_specification", "blocked_by_execution_feasibility"


def classification(contracts: str = "unverified", *, executable: bool | None = None, capital_verified: bool | None = None, survives: bool | None = None, legs_agree: bool | None = None) -> str:
    """The label of a comparison. None: not assessed. What is doubtful is appended, in a fixed order."""
    if contracts not in VERDICTS:
        label = BLOCKED_BY_CONTRACT
    elif executable is False:
        label = BLOCKED_BY_EXECUTION
    else:
        label = VERDICTS[contracts]
        if executable and capital_verified is False:
            label += "_capital_unverified"
    if survives is False:
        label += "_not_capturable_within_latency"
    if legs_agree is False:
        label += "_contract_legs_disagree"
    return label


def tick_summary(a: DataFrame, b: DataFrame, edges: DataFrame, found: DataFrame, label: str = VERDICTS["unverified"]) -> DataFrame:
    """One row over the aligned ticks and their episodes."""
    mid = (F.col("bid") + F.col("ask")) / 2 - (F.col("b_bid") + F.col("b_ask")) / 2
    crossable = F.col("net_edge") > 0
    own = edges.agg(
        F.count("*").alias("aligned"), F.count_distinct("b_t").alias("times"), F.avg(F.abs("delay_ms")).alias("mean_delay_ms"), F.percentile(F.abs("delay_ms"), 0.95).alias("p95_delay_ms"),
        F.avg(F.abs(mid)).alias("mean_abs_difference"), F.max(F.abs(mid)).alias("max_abs_difference"), F.count_if(crossable).alias("crossable"),
        F.avg(F.when(crossable, F.col("net_edge"))).alias("mean_net_edge"), F.max("net_edge").alias("max_net_edge"), period_hours().alias("hours"),
    )
    runs = found.agg(F.count("*").alias("episodes"), F.avg("duration_ms").alias("mean_duration_ms"), F.median("duration_ms").alias("median_duration_ms"), F.max("duration_ms").alias("max_duration_ms"), F.percentile("duration_ms", 0.95).alias("p95_duration_ms"))
    sizes = a.agg(F.count("*").alias("rows_a")).crossJoin(b.agg(F.count("*").alias("rows_b")))
    all_of = own.crossJoin(runs).crossJoin(sizes)
    return all_of.select(
        "rows_a", "rows_b", "aligned", (F.col("rows_a") - F.col("aligned")).alias("unmatched_a"), (F.col("rows_b") - F.col("times")).alias("unmatched_b"), "mean_delay_ms", "p95_delay_ms", "mean_abs_difference", "max_abs_difference",
        "crossable", (F.col("crossable") / F.nullif("aligned", F.lit(0))).alias("crossable_fraction"), "mean_net_edge", "max_net_edge", "hours", "episodes", (F.col("episodes") / F.col("hours")).alias("episodes_per_hour"),
        "mean_duration_ms", "median_duration_ms", "p95_duration_ms", "max_duration_ms",
        F.lit(label).alias("classification"),
    )


def tick_details(raw_a: DataFrame, raw_b: DataFrame, edges: DataFrame, *, blocked: bool = False) -> DataFrame:
    """One row that tick_summary() goes without: repeated times of both sides as they came, signed differences, the widest
    edges among crossable rows, and how many of these a contract blocks, which are then no opportunities."""
    repeated = lambda rows, name: rows.where("t is not null").groupBy("t").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias(name))
    potential = F.col("net_edge") > 0
    crossable = potential & F.lit(not blocked)
    own = edges.agg(
        F.avg(F.col("bid") - F.col("b_bid")).alias("mean_bid_difference"), F.avg(F.col("ask") - F.col("b_ask")).alias("mean_ask_difference"),
        F.max(F.when(crossable, F.col("gross_edge"))).alias("max_gross_crossable_edge"), F.max(F.when(crossable, F.col("net_edge"))).alias("max_net_crossable_edge"),
        F.count_if(crossable).alias("opportunity_observations"), F.count_if(potential & F.lit(blocked)).alias("blocked_observations"),
    )
    return own.crossJoin(repeated(raw_a, "duplicate_times_a")).crossJoin(repeated(raw_b, "duplicate_times_b"))


def bar_summary(a: DataFrame, b: DataFrame, tolerance_us: int, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """One row over bars (t, seq, symbol, close): differences of closes only, so never an opportunity."""
    both = asof_join(a, b, tolerance_us=tolerance_us, direction="nearest", by=by)
    d = F.abs(F.col("close") - F.col("match.close"))
    return both.agg(F.count("*").alias("aligned"), F.avg(d).alias("mean_abs_difference"), F.max(d).alias("max_abs_difference"), F.percentile(d, 0.95).alias("p95_abs_difference"), F.lit(0).cast("long").alias("opportunities"), F.lit("theoretical_bar_price_comparison").alias("classification"))
