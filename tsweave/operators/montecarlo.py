"""Robustness of a sequence of trades: block bootstrap under stress scenarios, one simulation a task's group.

Scenarios share the random numbers of a simulation, so they differ by their stress alone. A simulation's generator is
seeded by the seed and its number, so results don't depend on partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import DataQualityError, InsufficientDataError
from . import stretches

#: Name, factor of the gross edge, factor of the cost, cost on top, share of trades missed, deviation of shocks.
SCENARIOS = (
    ("baseline", 1.0, 1.0, 0.0, 0.0, 0.0),
    ("wider_spread", 1.0, 1.5, 0.0, 0.0, 0.0),
    ("slippage", 1.0, 1.25, 0.0, 0.0, 0.0),
    ("latency", 1.0, 1.0, 0.0, 0.05, 0.0),
    ("combined_stress", 1.0, 2.0, 0.0, 0.10, 0.0),
)


#: Sequences of up to so many trades go to every task whole. Longer ones are resampled by joins.
MOST_WHOLE = 1_000_000
RUN_COLUMNS = ["scenario", "simulation", "total", "drawdown", "win_rate", "trades"]
RUNS = "scenario string, simulation long, total double, drawdown double, win_rate double, trades long"


def block_indices(rng: np.random.Generator, n: int, block: int) -> np.ndarray:
    """n places in circular blocks that start anywhere."""
    starts = rng.integers(0, n, -(-n // block))
    return ((starts[:, None] + np.arange(block)) % n).reshape(-1)[:n]


def outcome(gross: np.ndarray, cost: np.ndarray, missed: np.ndarray, shock: np.ndarray, scenario) -> tuple[float, float, float, int]:
    """(total net, drawdown, win rate, trades made) of one resampled sequence. A missed trade nets its cost, lost."""
    _, edge, charge, extra, miss, deviation = scenario
    made = missed >= miss
    paid = cost * charge + extra
    net = np.where(made, gross * edge + shock * deviation, 0.0) - paid
    total = np.cumsum(net)
    fall = total - np.maximum(np.maximum.accumulate(total), 0.0)
    return float(net.sum()), float(fall.min()), float((net[made] > 0).mean()) if made.any() else 0.0, int(made.sum())


def simulate(trades: DataFrame, simulations: int, block: int, seed: int, scenarios=SCENARIOS, rotate: bool = False) -> DataFrame:
    """(scenario, simulation, total, drawdown, win_rate, trades). trades: (execution_t, gross_edge, cost).

    A sequence of up to MOST_WHOLE trades, three numbers each, goes to every task; a longer one is numbered, the numbers
    that blocks start from are joined to it, and each simulation adds up its rows as they come, with the same random
    numbers. rotate: the block is the whole sequence and starts at the simulation's number, a resampling that SQL can
    follow. Without trades, or with a cost below zero, it refuses.
    """
    rows = trades.select("execution_t", "gross_edge", "cost")
    size = rows.agg(F.count("*").alias("n"), F.min("cost").alias("cost")).first()
    n = size.n
    if not n:
        raise InsufficientDataError("there are no trades to resample")
    if size.cost < 0:
        raise DataQualityError("a cost is below zero")
    if n > MOST_WHOLE:
        return _simulate_by_joins(rows, n, simulations, block, seed, scenarios, rotate)
    rows = rows.orderBy("execution_t").toPandas()
    gross, cost = rows["gross_edge"].to_numpy(float), rows["cost"].to_numpy(float)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for s in pdf["id"].tolist():
                rng = np.random.default_rng(seed + s)
                at = np.arange(s, s + n) % n if rotate else block_indices(rng, n, block)
                missed, hit = (np.ones(n), np.zeros(n)) if rotate else (rng.random(n), rng.normal(0.0, 1.0, n))
                for sc in scenarios:
                    out.append((sc[0], s, *outcome(gross[at], cost[at], missed, hit, sc)))
            yield pd.DataFrame(out, columns=["scenario", "simulation", "total", "drawdown", "win_rate", "trades"])

    return trades.sparkSession.range(simulations).mapInPandas(run, RUNS)


class _Sequence:
    """One resampled sequence, whose rows come in parts: its random numbers and what each scenario has made so far."""

    def __init__(self, simulation: int, n: int, block: int, seed: int, scenarios, rotate: bool):
        self.simulation, self.scenarios, self.rotate = simulation, scenarios, rotate
        self.missed, self.shock = np.random.default_rng(seed + simulation), np.random.default_rng(seed + simulation)
        if not rotate:  # the order of the draws: where blocks start, which trades are missed, shocks
            for rng in (self.missed, self.shock):
                rng.integers(0, n, -(-n // block))
            for at in range(0, n, 1_000_000):
                self.shock.random(min(1_000_000, n - at))
        self.sums = [[0.0, 0.0, 0.0, 0, 0] for _ in scenarios]  # total, peak, fall, won, made

    def add(self, gross: np.ndarray, cost: np.ndarray) -> None:
        k = len(gross)
        missed, shock = (np.ones(k), np.zeros(k)) if self.rotate else (self.missed.random(k), self.shock.normal(0.0, 1.0, k))
        for s, (_, edge, charge, extra, miss, deviation) in zip(self.sums, self.scenarios, strict=True):
            made = missed >= miss
            net = np.where(made, gross * edge + shock * deviation, 0.0) - (cost * charge + extra)
            total = s[0] + np.cumsum(net)
            peak = np.maximum(np.maximum.accumulate(total), s[1])
            s[2] = min(s[2], float((total - peak).min()))
            s[0], s[1] = float(total[-1]), float(peak[-1])
            s[3] += int((net[made] > 0).sum())
            s[4] += int(made.sum())

    def rows(self) -> list[tuple]:
        return [(sc[0], self.simulation, s[0], s[2], s[3] / s[4] if s[4] else 0.0, s[4]) for sc, s in zip(self.scenarios, self.sums, strict=True)]


def _simulate_by_joins(rows: DataFrame, n: int, simulations: int, block: int, seed: int, scenarios, rotate: bool) -> DataFrame:
    """As simulate(), with no sequence held whole: (simulation, place) rows, joined to the trade they take, in order of place."""
    size = n if rotate else block

    def starts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for s in pdf["id"].tolist():
                found = np.array([s % n]) if rotate else np.random.default_rng(seed + s).integers(0, n, -(-n // block))
                for at in range(0, len(found), 100_000):
                    some = found[at : at + 100_000]
                    yield pd.DataFrame({"simulation": s, "slot": np.arange(at, at + len(some)), "start": some})

    slot = rows.sparkSession.range(simulations).mapInPandas(starts, "simulation long, slot long, start long")
    place = slot.select("simulation", "slot", "start", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long"))).alias("i"))
    place = place.select("simulation", (F.col("slot") * size + F.col("i")).alias("place"), F.pmod(F.col("start") + F.col("i"), F.lit(n)).alias("at")).where(F.col("place") < n)
    taken = place.join(stretches.numbered(rows, "execution_t", "at"), "at").select("simulation", "place", "gross_edge", "cost")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = None
        for pdf in batches:
            for s, part in pdf.groupby("simulation", sort=False):
                if own is None or own.simulation != s:
                    if own is not None:
                        yield pd.DataFrame(own.rows(), columns=RUN_COLUMNS)
                    own = _Sequence(int(s), n, block, seed, scenarios, rotate)
                own.add(part["gross_edge"].to_numpy(float), part["cost"].to_numpy(float))
        if own is not None:
            yield pd.DataFrame(own.rows(), columns=RUN_COLUMNS)

    return taken.repartition("simulation").sortWithinPartitions("simulation", "place").mapInPandas(run, RUNS)


def distribution(runs: DataFrame, confidence: float = 0.95) -> DataFrame:
    """One row a scenario: mean, median, quantiles, chance of gain, expected shortfall, drawdowns."""
    low = (1 - confidence) / 2
    q = runs.groupBy("scenario").agg(F.percentile("total", low).alias("lower"), F.percentile("total", 1 - low).alias("upper"))
    each = runs.join(F.broadcast(q), "scenario")  # one row a scenario
    return each.groupBy("scenario", "lower", "upper").agg(
        F.count("*").alias("simulations"), F.avg("total").alias("mean"), F.median("total").alias("median"), F.avg((F.col("total") > 0).cast("double")).alias("chance_of_gain"),
        F.avg(F.when(F.col("total") <= F.col("lower"), F.col("total"))).alias("expected_shortfall"), F.min("total").alias("worst"), F.median("drawdown").alias("median_drawdown"), F.percentile("drawdown", low).alias("confidence_drawdown"),
        F.avg("win_rate").alias("mean_win_rate"), F.avg("trades").alias("mean_trades"),
    )
