"""Contract specifications of two brokers: compatibility, and profit in money."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import same

COMPATIBLE, NORMALIZE, INCOMPATIBLE, REVIEW, UNVERIFIED = "compatible", "normalization_required", "incompatible", "review_required", "unverified"
#: Legs agree where their profits differ by at most this share; units are worth the same within this share.
LEG_TOLERANCE, UNIT_TOLERANCE = 0.05, 0.01
SCHEMA = "broker string, server string, symbol string, description string, path string, currency_base string, currency_profit string, digits int, point double, spread int, trade_mode int, contract_size double, volume_min double, volume_max double, volume_step double, tick_size double, tick_value double, margin_initial double"


def _differ(name: str) -> Column:
    return ~same(F.col(f"a.{name}"), F.col(f"b.{name}"))


def _odd_digits(side: str) -> Column:
    return ~same(F.col(f"{side}.point"), F.pow(F.lit(10.0), -F.col(f"{side}.digits")), 1e-6)


def contract_gate(pairs: DataFrame) -> DataFrame:
    """pairs: struct columns a and b, null where a specification isn't known. Adds status, issues, advisories, blocks and the ratios b / a."""
    hard = [
        (F.upper("a.currency_base") != F.upper("b.currency_base"), "base currencies differ"),
        (F.upper("a.currency_profit") != F.upper("b.currency_profit"), "profit currencies differ"),
        (_differ("point"), "point sizes differ"),
        (_differ("tick_size"), "tick sizes differ"),
        (_odd_digits("a") | _odd_digits("b"), "digits and point size are inconsistent"),
        (_differ("volume_min"), "minimum volumes differ"),
        (_differ("volume_step"), "volume steps differ"),
        (F.col("a.trade_mode") != F.col("b.trade_mode"), "trade modes differ"),
    ]
    issues = F.filter(F.array(*[F.when(c, text) for c, text in hard]), lambda x: x.isNotNull())
    mode = F.col("a.trade_mode").isNull() | F.col("b.trade_mode").isNull()
    unit = [F.col(f"{s}.tick_value") / F.nullif(F.col(f"{s}.tick_size") * F.col(f"{s}.contract_size"), F.lit(0.0)) for s in "ab"]
    worth_alike = same(*unit, UNIT_TOLERANCE)
    both, none = F.col("a").isNotNull() & F.col("b").isNotNull(), F.col("a").isNull() & F.col("b").isNull()
    out = pairs.withColumn("_hard", F.when(both, issues))
    status = (
        F.when(none, UNVERIFIED).when(~both, REVIEW).when(F.size("_hard") > 0, INCOMPATIBLE).when(mode, REVIEW)
        .when(~F.coalesce(worth_alike, F.lit(False)), INCOMPATIBLE).when(_differ("contract_size") | _differ("tick_value"), NORMALIZE).otherwise(COMPATIBLE)
    )
    told = (
        F.when(none, F.array(F.lit("contract specifications were not provided")))
        .when(~both, F.array(F.lit("both broker contract specifications are required")))
        .when((F.size("_hard") > 0) | mode, F.concat("_hard", F.when(mode, F.array(F.lit("trade mode is not known"))).otherwise(F.array().cast("array<string>"))))
        .when(~F.coalesce(worth_alike, F.lit(False)), F.array(F.lit("contract size and tick value do not scale together")))
        .when(_differ("contract_size"), F.array(F.lit("contract sizes differ")))
        .when(_differ("tick_value"), F.array(F.lit("tick values differ")))
        .otherwise(F.array().cast("array<string>"))
    )
    advice = F.when(both & _differ("volume_max"), F.array(F.lit("maximum volumes differ"))).otherwise(F.array().cast("array<string>"))
    ratio = lambda n: F.col(f"b.{n}") / F.nullif(F.col(f"a.{n}"), F.lit(0.0))
    out = out.withColumns({"status": status, "issues": told, "advisories": advice, "size_ratio": ratio("contract_size"), "tick_value_ratio": ratio("tick_value")})
    return out.withColumn("blocks", F.col("status").isin(INCOMPATIBLE, REVIEW)).drop("_hard")


def normalize_edge(rows: DataFrame, edge: str, volume: Column) -> DataFrame:
    """rows with structs a and b: adds volume_a, volume_b (of equal size), pnl_a, pnl_b, net_pnl (leg a's) and legs_agree."""
    pnl = lambda s, v: F.col(edge) * v * F.col(f"{s}.tick_value") / F.col(f"{s}.tick_size")
    out = rows.withColumn("volume_a", volume).withColumn("volume_b", volume * F.col("a.contract_size") / F.col("b.contract_size"))
    out = out.withColumn("pnl_a", pnl("a", F.col("volume_a"))).withColumn("pnl_b", pnl("b", F.col("volume_b"))).withColumn("net_pnl", F.col("pnl_a"))
    widest = F.greatest(F.abs("pnl_a"), F.abs("pnl_b"))
    out = out.withColumn("disagreement", F.when(widest == 0, F.lit(0.0)).otherwise(F.abs(F.col("pnl_a") - F.col("pnl_b")) / F.nullif(widest, F.lit(0.0))))
    return out.withColumn("legs_agree", F.col("disagreement") <= LEG_TOLERANCE)


def normalized_summary(rows: DataFrame) -> DataFrame:
    """One row over normalize_edge(): b's volume for a volume of one of a, profit's mean and maximum, and how far the legs disagree at worst."""
    return rows.agg(
        F.max(F.col("volume_b") / F.col("volume_a")).alias("volume_ratio"), F.avg("net_pnl").alias("mean_net_pnl"), F.max("net_pnl").alias("max_net_pnl"),
        F.min("legs_agree").alias("legs_agree"), F.max("disagreement").alias("disagreement"),
    )
