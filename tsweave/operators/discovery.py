"""Candidates: which relations there are, which are the same, how they fit, and which to look at first."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import InvalidFormulaError
from ..functions.columns import known
from ..functions.formula import canonical, parse, semantic_key, to_column
from . import stats

MOST_CANDIDATES = 500
#: The relations that are known without a search.
CATALOG = (
    ("EURGBP", "EURGBP", "EURUSD/GBPUSD"),
    ("EURJPY", "EURJPY", "EURUSD*USDJPY"),
    ("GBPJPY", "GBPJPY", "GBPUSD*USDJPY"),
    ("XAUEUR", "XAUEUR", "XAUUSD/EURUSD"),
    ("GOLD_SILVER_RATIO", "GOLD_SILVER_RATIO", "XAUUSD/XAGUSD"),
)
FEATURES = ("zscore", "abs_discrepancy", "discrepancy_volatility", "rolling_beta", "correlation", "volatility_regime")


def catalog(spark: SparkSession, definitions=CATALOG) -> DataFrame:
    """(name, target, formula, deps); of rows alike the last counts."""
    rows = [(n, t, f, sorted(parse(f).symbols())) for n, t, f in dict.fromkeys(reversed(definitions))][::-1]
    return spark.createDataFrame(rows, "name string, target string, formula string, deps array<string>")


def expand(definitions: DataFrame, symbols: list[str], most_depth: int = 3) -> DataFrame:
    """Definitions whose symbols can all be reached, level by level, with the level; a found target can be used next.

    The reached names are a list on the driver, as long as the catalog at most.
    """
    reached, found = set(symbols), None
    for level in range(1, most_depth + 1):
        have = F.array(*[F.lit(s) for s in sorted(reached)]) if reached else F.array().cast("array<string>")
        new = definitions.where(F.size(F.array_except("deps", have)) == 0).withColumn("level", F.lit(level))
        if found is not None:
            new = new.join(found.select("name"), "name", "left_anti")
        found = new if found is None else found.unionByName(new)
        grown = reached | {r.target for r in new.select("target").collect()}
        if grown == reached:
            break
        reached = grown
    return found


def symbol_pairs(symbols: DataFrame) -> DataFrame:
    """Ordered pairs of distinct symbols: a/b. Symbols are a catalog's names, not rows of data."""
    a, b = symbols.select(F.col("symbol").alias("a")), symbols.select(F.col("symbol").alias("b"))
    return a.join(b, F.col("a") != F.col("b"))


def symbol_triples(symbols: DataFrame) -> DataFrame:
    c = symbols.select(F.col("symbol").alias("c"))
    return symbol_pairs(symbols).join(c, (F.col("c") != F.col("a")) & (F.col("c") != F.col("b")))


def candidates(symbols: list[str], most: int = MOST_CANDIDATES) -> tuple[list[tuple[str, str]], int]:
    """((name, formula) of ratios, then of products less a third, in order of symbols; how many the cap left out)."""
    from itertools import permutations

    def q(s: str) -> str:
        return f'"{s}"'

    made = [(f"{a}/{b}", f"{q(a)}/{q(b)}") for a, b in permutations(sorted(symbols), 2)]
    made += [(f"{a}*{b}/{c}", f"{q(a)}*{q(b)}/{q(c)}") for a, b, c in permutations(sorted(symbols), 3)]
    return made[:most], max(0, len(made) - most)


def deduplicate(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    """(position, name, formula, semantic, canonical, kept_as): the first of each meaning stays; null kept_as: it is the first."""
    keyed = [(i, n, f, semantic_key(parse(f)), canonical(parse(f))) for i, (n, f) in enumerate(rows)]
    frame = spark.createDataFrame(keyed, "position int, name string, formula string, semantic string, canonical string")
    w = Window.partitionBy("semantic").orderBy("position")
    return frame.withColumn("_first", F.first("name").over(w)).withColumn("kept_as", F.when(F.row_number().over(w) > 1, F.col("_first"))).drop("_first")


def gate(rows: DataFrame, least: int) -> DataFrame:
    """Candidates (status, observations): those evaluated on too few rows become insufficient; the others keep their status."""
    low = F.col("observations").isNotNull() & (F.col("observations") < least)
    return rows.withColumn("status", F.when(low, "insufficient_observations").otherwise(F.col("status")))


def missing(wanted: DataFrame, have: DataFrame) -> DataFrame:
    """The distinct symbols of the one frame that the other hasn't."""
    return wanted.select("symbol").distinct().join(have.select("symbol"), "symbol", "left_anti")


def missing_symbols(formula: str, have: list[str]) -> list[str]:
    return sorted(parse(formula).symbols() - set(have))


def history(panel: DataFrame, have: list[str], name: str, target: str, formula: str, window: int = stats.Z_WINDOW, least: int = 30) -> DataFrame | None:
    """A candidate's rows on a wide panel (t, one column a symbol): actual, synthetic, discrepancy and what ranks it.

    None where symbols are missing. The window of z-scores is no longer than the rows there are.
    """
    tree = parse(formula)
    if missing_symbols(formula, have) or target not in have:
        return None
    return measured(panel.select(F.lit(name).alias("name"), "t", known(F.col(f"`{target}`")).alias("actual"), known(to_column(tree)).alias("synthetic")), window)


def measured(pairs: DataFrame, window: int = stats.Z_WINDOW) -> DataFrame:
    """What ranks candidates, for rows (name, t, actual, synthetic) of any number of them."""
    rows = pairs.where("actual is not null and synthetic is not null")
    keys, order = ["name"], ["t"]
    rows = rows.withColumn("discrepancy", F.col("actual") - F.col("synthetic")).withColumn("abs_discrepancy", F.abs("discrepancy"))
    rows = rows.withColumn("zscore", stats.zscore(F.col("discrepancy"), keys, order, window))
    rows = rows.withColumn("discrepancy_volatility", stats.discrepancy_volatility(F.col("discrepancy"), keys, order))
    rows = stats.rolling_beta(rows, "actual", "synthetic", window, keys, order).withColumnRenamed("beta", "rolling_beta")
    rows = stats.with_expanding_pearson(rows, "actual", "synthetic", keys, order)
    rows = stats.regimes(rows, "actual", keys, window).withColumn("volatility_regime", F.when(F.col("regime") == "low", -1.0).when(F.col("regime") == "high", 1.0).when(F.col("regime") == "normal", 0.0)).drop("volatility")
    return rows.withColumn("next_abs_zscore", F.lead(F.abs("zscore")).over(Window.partitionBy(*keys).orderBy(*order)))


def evaluate(panel: DataFrame, have: list[str], rows: list[tuple[str, str, str]], least: int = 30) -> tuple[DataFrame | None, list[tuple[str, str, str]]]:
    """(histories of all candidates (name, target, formula), [(name, status, reason)] of those without one).

    The panel is read once: each of its rows gives one row a candidate, and windows are of each candidate.
    """
    found, without = [], []
    for name, target, formula in rows:
        try:
            tree = parse(formula)
        except InvalidFormulaError as e:
            without.append((name, "requires_data", str(e)))
            continue
        if missing_symbols(formula, have) or target not in have:
            without.append((name, "requires_data", "missing: " + ", ".join(sorted({*missing_symbols(formula, have)} | ({target} - set(have))))))
        else:
            found.append(F.struct(F.lit(name).alias("name"), known(F.col(f"`{target}`")).alias("actual"), known(to_column(tree)).alias("synthetic")))
    if not found:
        return None, without
    each = panel.select("t", F.explode(F.array(*found)).alias("c"))
    return measured(each.select("c.name", "t", "c.actual", "c.synthetic")), without


def statuses(histories: DataFrame, least: int = 30) -> DataFrame:
    n = histories.groupBy("name").agg(F.count("*").alias("observations"))
    return n.withColumn("status", F.when(F.col("observations") < least, "insufficient_observations").otherwise("requires_further_validation"))


def chronological_split(rows: DataFrame, share: float = 0.7) -> DataFrame:
    """Adds train: true for the first int(times x share) distinct times, one at least."""
    times = rows.select("t").distinct()
    n = max(1, int(times.count() * share))
    cut = times.orderBy("t").limit(n).agg(F.max("t")).first()[0]
    return rows.withColumn("train", F.col("t") <= cut)


def gram(rows: DataFrame, features: tuple[str, ...] = FEATURES, label: str = "next_abs_zscore") -> DataFrame:
    """One row of sums over complete training rows: n, s_i, s_i_j, y, y_i; all that a ridge fit needs."""
    parts = [F.count("*").alias("n"), F.sum(label).alias("y")]
    parts += [F.sum(f).alias(f"s_{i}") for i, f in enumerate(features)] + [F.sum(F.col(f) * F.col(label)).alias(f"y_{i}") for i, f in enumerate(features)]
    parts += [F.sum(F.col(f) * F.col(g)).alias(f"s_{i}_{j}") for i, f in enumerate(features) for j, g in enumerate(features) if i <= j]
    return rows.agg(*parts)


def ridge(sums, k: int, alpha: float = 1.0) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """(weights, intercept, mean, scale) of standardised features, from the sums of gram(); the intercept isn't penalised."""
    n = float(sums["n"])
    s = np.array([sums[f"s_{i}"] for i in range(k)], float)
    q = np.array([[sums[f"s_{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)
    sy = np.array([sums[f"y_{i}"] for i in range(k)], float)
    y, mean = float(sums["y"]), s / n
    scale = np.sqrt(np.maximum(np.diag(q) / n - mean**2, 0))
    scale[scale == 0] = 1.0
    a = (q - n * np.outer(mean, mean)) / np.outer(scale, scale)
    b = (sy - mean * y) / scale
    return np.linalg.solve(a + alpha * np.eye(k), b), y / n, mean, scale


def rank_candidates(histories: DataFrame, share: float = 0.7, alpha: float = 1.0, least: int = 30) -> DataFrame | None:
    """(rank, name, prediction, rmse, rows): candidates by their mean predicted next |z| after the split; None on too few rows."""
    complete = histories.where(" and ".join(f"{c} is not null" for c in (*FEATURES, "next_abs_zscore")))
    if complete.isEmpty():
        return None
    parts = chronological_split(complete, share)
    sums = gram(parts.where("train")).first()
    if sums["n"] < least:
        return None
    weights, intercept, mean, scale = ridge(sums, len(FEATURES), alpha)
    guess = F.lit(float(intercept))
    for f, w, m, s in zip(FEATURES, weights, mean, scale, strict=True):
        guess = guess + (F.col(f) - float(m)) / float(s) * float(w)
    test = parts.where("not train").withColumn("guess", guess)
    own = test.groupBy("name").agg(F.avg("guess").alias("prediction"), F.sqrt(F.avg((F.col("guess") - F.col("next_abs_zscore")) ** 2)).alias("rmse"), F.count("*").alias("rows"))
    return own.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("prediction"), "name")))
