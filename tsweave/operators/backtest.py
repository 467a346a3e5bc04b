"""Causal backtests: next-observation trades, metrics, walk-forward validation and weighted ensembles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ConfigurationError, DataQualityError
from . import stretches

CONVENTIONS = {"earned_over_following_bar": 1, "realised_at_bar": 0}


def grid_differences(signals: DataFrame, outcomes: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row only_left, only_right: how many rows of either have no match on (keys, t)."""
    on = [*keys, "t"]
    only = lambda x, y, name: x.join(y.select(*on), on, "left_anti").agg(F.count("*").alias(name))
    return only(signals, outcomes, "only_left").crossJoin(only(outcomes, signals, "only_right"))


def one_grid(signals: DataFrame, outcomes: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """signals joined to outcomes on (keys, t), which must be the same rows: unique, no null t, none on one side only."""
    on = [*keys, "t"]
    for frame in (signals, outcomes):
        if not frame.where("t is null").isEmpty():
            raise DataQualityError("an observation has no time")
        if not frame.groupBy(*on).count().where("count > 1").isEmpty():
            raise DataQualityError("a time is repeated")
    if any(grid_differences(signals, outcomes, keys).first()):
        raise DataQualityError("the observation grids differ")
    return signals.join(outcomes, on)


def trades(rows: DataFrame, signal: Column | str = "signal", *, convention: str = "earned_over_following_bar", keys: tuple[str, ...] = (), order: str = "t") -> DataFrame:
    """(keys, decision_t, execution_t, gross_edge, cost, net_edge): a trade for each row with a signal other than zero.

    rows: (keys, t, signal, gross_edge, cost). The outcome is taken from the next row, before any row is dropped, so a
    signal earns nothing on its own bar and one on the last bar earns nothing at all. NaN counts as no signal.
    """
    out = _settled(rows, signal, convention, keys, order).where("_next.t is not null and _next.gross_edge is not null and _next.cost is not null")
    out = out.withColumns({"execution_t": F.col("_next.t"), "_gross": F.col("_next.gross_edge"), "_cost": F.col("_next.cost")})
    return out.select(*keys, F.col("t").alias("decision_t"), "execution_t", F.col("_gross").alias("gross_edge"), F.col("_cost").alias("cost"), (F.col("_gross") - F.col("_cost")).alias("net_edge"))


def unsettled(rows: DataFrame, signal: Column | str = "signal", *, keys: tuple[str, ...] = (), order: str = "t") -> DataFrame:
    """The rows with a signal that no row follows: they earn nothing."""
    return _settled(rows, signal, "earned_over_following_bar", keys, order).where("_next is null").drop("_next")


def _settled(rows: DataFrame, signal: Column | str, convention: str, keys: tuple[str, ...], order: str) -> DataFrame:
    """The rows with a signal, and _next (t, gross_edge, cost), the row that settles it, or null.

    Without keys, days are dealt to tasks, and the last row of a day is settled by the first of the next day that has any.
    """
    k = CONVENTIONS.get(convention)
    if k is None:
        raise ConfigurationError(f"convention is one of {tuple(CONVENTIONS)}")
    took = (F.col(signal) if isinstance(signal, str) else signal).cast("double")
    out = rows.withColumn("_took", (took != 0) & ~F.isnan(took))
    row = F.struct("t", "gross_edge", "cost")
    if not k:
        out = out.withColumn("_next", row)
    elif keys or order != "t":
        out = out.withColumn("_next", F.lead(row, k).over(Window.partitionBy(*keys).orderBy(order)))
    else:
        out = stretches.dealt(out, order)
        first = out.groupBy("_stretch").agg(F.min_by(row, order).alias("_first"))
        first = first.select("_stretch", F.lead("_first").over(Window.orderBy("_stretch")).alias("_first"))
        own = F.lead(row, k).over(Window.partitionBy("_stretch").orderBy(order))
        out = out.withColumn("_next", own).join(first, "_stretch").withColumn("_next", F.coalesce("_next", "_first")).drop("_stretch", "_first")
    return out.where("_took").drop("_took")


def equity(made: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds equity, peak (0 at least) and drawdown (0 at most) in order of execution.

    Without keys, days are dealt to tasks; what a day starts from are sums and peaks of the days before.
    """
    by = keys or ("_stretch",)
    w = Window.partitionBy(*by).orderBy("execution_t", "decision_t").rowsBetween(Window.unboundedPreceding, 0)
    out = made if keys else stretches.dealt(made, "execution_t")
    out = out.withColumn("equity", F.sum("net_edge").over(w)).withColumn("peak", F.max("equity").over(w))
    if not keys:
        day = out.groupBy("_stretch").agg(F.sum("net_edge").alias("_sum"), F.max("equity").alias("_top"))
        day = stretches.before(day, {"_base": F.sum("_sum")})
        day = stretches.before(day.withColumn("_top", F.col("_top") + F.coalesce("_base", F.lit(0.0))), {"_peak": F.max("_top")})
        out = out.join(day.select("_stretch", "_base", "_peak"), "_stretch").withColumn("_base", F.coalesce("_base", F.lit(0.0)))
        out = out.withColumn("equity", F.col("equity") + F.col("_base")).withColumn("peak", F.greatest("_peak", F.col("peak") + F.col("_base"))).drop("_stretch", "_base", "_peak")
    out = out.withColumn("peak", F.greatest(F.lit(0.0), "peak"))
    return out.withColumn("drawdown", F.col("equity") - F.col("peak"))


def metrics(made: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row (a key): win rate and mean are over trades taken, those with a gross edge; no trade gives null rates."""
    taken = F.col("gross_edge") > 0
    net = F.col("net_edge")
    gross = F.sum(F.when(taken, F.col("gross_edge")))
    return equity(made, keys).groupBy(*keys).agg(
        F.count("*").alias("observations"), F.count_if(taken).alias("opportunities"), F.sum("gross_edge").alias("gross"), F.sum(net).alias("net"),
        F.avg(F.when(taken, (net > 0).cast("double"))).alias("win_rate"), F.avg(F.when(taken, net)).alias("mean_net"), F.sum(F.least(net, F.lit(0.0))).alias("mae"), F.sum(F.greatest(net, F.lit(0.0))).alias("mfe"),
        F.min("drawdown").alias("drawdown"), (F.sum(F.when(taken, F.col("cost"))) / F.nullif(gross, F.lit(0.0)) * 100).alias("cost_percent"), F.avg((net > 0).cast("double")).alias("observation_win_rate"),
    )


def numbered(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds pos, a row's number from 0."""
    if not keys:
        return stretches.numbered(rows, "t", "pos")
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy("t")) - 1)


def walk_forward_windows(n: Column | int, train: int, validation: int, test: int, step: int | None = None) -> Column:
    """Array of structs (fold, train_start, validation_start, test_start, test_end) by row number; ends are exclusive."""
    step = step or test
    if min(train, test, step) <= 0 or validation < 0:
        raise ConfigurationError("sizes must be positive")
    whole = train + validation + test
    n = n if isinstance(n, Column) else F.lit(n)
    starts = F.when(n >= whole, F.sequence(F.lit(0).cast("long"), n.cast("long") - whole, F.lit(step).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.transform(starts, lambda s, i: F.struct(i.alias("fold"), s.alias("train_start"), (s + train).alias("validation_start"), (s + train + validation).alias("test_start"), (s + whole).alias("test_end")))


def fold_rows(rows: DataFrame, train: int, validation: int, test: int, step: int | None = None) -> DataFrame:
    """Each row (t, signal, gross_edge, cost) once for each fold it is in, with fold and split; a row is in few folds.

    The folds of a row follow from its number by arithmetic, so no row meets all the windows.
    """
    step = step or test
    whole = train + validation + test
    rows = numbered(rows)
    n = rows.agg(F.count("*").alias("n"))
    last = F.floor((F.col("n") - whole) / step)
    first = F.greatest(F.lit(0), F.ceil((F.col("pos") - whole + 1) / step))
    folds = F.when(F.least(last, F.floor(F.col("pos") / step)) >= first, F.sequence(first.cast("long"), F.least(last, F.floor(F.col("pos") / step)).cast("long")))
    out = rows.crossJoin(F.broadcast(n)).withColumn("fold", F.explode(folds)).withColumn("_in", F.col("pos") - F.col("fold") * step)
    split = F.when(F.col("_in") < train, "train").when(F.col("_in") < train + validation, "validation").otherwise("test")
    return out.withColumn("split", split).drop("_in", "n", "pos")


def walk_forward(rows: DataFrame, thresholds: tuple[float, ...], train: int, validation: int, test: int, step: int | None = None, least_trades: int = 1) -> tuple[DataFrame, DataFrame]:
    """(selected: fold, threshold, train_mean, train_trades; trades of the test rows of each fold at its threshold).

    A threshold is chosen by its mean net edge over trades taken in the training rows, ties to the smallest. Signals over
    it trade within their own split, so no trade crosses from one to the next.
    """
    folds = fold_rows(rows, train, validation, test, step)
    each = folds.withColumn("threshold", F.explode(F.array(*[F.lit(float(x)) for x in sorted(set(thresholds))])))
    made = trades(each, (F.col("signal") > F.col("threshold")).cast("int"), keys=("fold", "split", "threshold"))
    score = made.where("split = 'train' and gross_edge > 0").groupBy("fold", "threshold").agg(F.avg("net_edge").alias("train_mean"), F.count("*").alias("train_trades"))
    w = Window.partitionBy("fold").orderBy(F.desc("train_mean"), "threshold")
    chosen = score.where(F.col("train_trades") >= least_trades).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
    return chosen, made.where("split = 'test'").join(chosen.select("fold", "threshold"), ["fold", "threshold"]).drop("split")


def once_each(made: DataFrame) -> DataFrame:
    """Trades of overlapping test windows once for each execution, from the earliest fold."""
    w = Window.partitionBy("execution_t").orderBy("fold", "decision_t")
    return made.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def ensemble(rows: DataFrame, weights: dict[str, float], threshold: float) -> DataFrame:
    """Trades of the weighted sum of the stages' scores (stage 'ensemble') and of each stage alone, where over threshold."""
    total = sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0))
    stages = F.array(F.struct(F.lit("ensemble").alias("stage"), total.alias("score")), *[F.struct(F.lit(c).alias("stage"), F.col(c).cast("double").alias("score")) for c in weights])
    each = rows.select("t", "gross_edge", "cost", F.explode(stages).alias("s")).select("t", "gross_edge", "cost", "s.stage", "s.score")
    return trades(each, (F.col("score") > threshold).cast("int"), keys=("stage",))
