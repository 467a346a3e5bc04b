"""Families of hypotheses: p-values adjusted for their number, by windows over sorted p-values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ConfigurationError

METHODS = ("bonferroni", "holm", "sidak", "fdr_bh", "fdr_by")


def build_family(rows: DataFrame) -> DataFrame:
    """rows (label, p_value, tests_agree): those with a usable p-value; contested where the tests are known to disagree."""
    usable = rows.where("p_value is not null and not isnan(p_value) and p_value >= 0 and p_value <= 1")
    return usable.withColumn("contested", F.col("tests_agree").eqNullSafe(F.lit(False)))


def adjust(family: DataFrame, method: str, alpha: float = 0.05, by: tuple[str, ...] = (), position: str = "position") -> DataFrame:
    """family (by, label, p_value, position): adds rank, adjusted_p, rejected. Equal p-values rank by position.

    Holm's running maximum and the false-discovery running minimum go over one family in one window: a family is what is
    tested together, a list of candidates; several families are independent partitions.
    """
    if method not in METHODS:
        raise ConfigurationError(f"method is one of {METHODS}")
    p = F.col("p_value")
    order = Window.partitionBy(*by).orderBy("p_value", position)
    n = F.count("*").over(Window.partitionBy(*by))
    out = family.withColumn("rank", F.row_number().over(order)).withColumn("_n", n)
    i, m = F.col("rank"), F.col("_n")
    if method == "bonferroni":
        raw = p * m
    elif method == "sidak":
        raw = 1 - F.pow(1 - p, m)
    elif method == "holm":
        raw = F.max(p * (m - i + 1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    else:
        down = Window.partitionBy(*by).orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, 0)
        raw = F.min(p * m / i).over(down)
        if method == "fdr_by":
            # the harmonic number of the family's size is the sum over its ranks: one term a row, not n terms for each
            out = out.withColumn("_h", F.sum(1 / i.cast("double")).over(Window.partitionBy(*by)))
            raw = F.min(p * m / i * F.col("_h")).over(down)
    out = out.withColumn("adjusted_p", F.least(F.lit(1.0), raw)).drop("_n", "_h")
    return out.withColumn("rejected", F.col("adjusted_p") <= alpha)


def family_report(adjusted: DataFrame, alpha: float = 0.05, by: tuple[str, ...] = ()) -> DataFrame:
    return adjusted.groupBy(*by).agg(F.count("*").alias("tested"), F.count_if(F.col("rejected")).alias("rejected"), F.count_if(F.col("p_value") <= alpha).alias("rejected_unadjusted"), (F.count("*") * alpha).alias("expected_false_positives"))
