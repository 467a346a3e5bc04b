import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tsweave.errors import DataQualityError, InvalidFormulaError
from tsweave.functions import formula
from tsweave.operators import backtest, coverage, discovery, montecarlo, multiplicity, special, stats, symbols


def series(spark, values, name="s"):
    return spark.createDataFrame([(name, i, None if v is None else float(v)) for i, v in enumerate(values)], "k string, t long, value double")


def column(df, name, order="t"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_zscore_warms_up_as_null(spark):
    z = column(series(spark, range(1, 12)).withColumn("z", stats.zscore(F.col("value"), ["k"], ["t"], 5)), "z")
    assert z[:4] == [None] * 4 and abs(z[4] - math.sqrt(2)) < 1e-12


def test_beta_of_a_multiple(spark):
    rng = np.random.default_rng(1)
    r = rng.normal(0, 0.01, 30)
    x, y = np.cumprod(1 + r), np.cumprod(1 + 3 * r)
    df = spark.createDataFrame([("k", i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "k string, t long, x double, y double")
    b = stats.rolling_beta(df, "y", "x", 5, ["k"], ["t"])
    got = column(b, "beta")
    assert got[:5] == [None] * 5 and all(abs(v - 3) < 1e-9 for v in got[5:])
    s = stats.beta_summary(b).first()
    assert s.windows == 25 and s.sign_consistency == 1.0


def test_regimes(spark):
    p = series(spark, [100, 101, 100.5, 102, 101, 103, 102, 104, 103, 105])
    r = column(stats.regimes(p, "value", ["k"], 3), "regime")
    assert r[:3] == [None] * 3 and sum(x is not None for x in r) == 7
    flat = column(stats.regimes(series(spark, [5] * 10), "value", ["k"], 3), "regime")
    assert set(flat[3:]) == {"normal"}


CAUSAL = {
    "zscore": lambda d: d.withColumn("x", stats.zscore(F.col("value"), ["k"], ["t"], 5)),
    "volatility": lambda d: d.withColumn("x", stats.discrepancy_volatility(F.col("value"), ["k"], ["t"])),
    "momentum": lambda d: d.withColumn("x", stats.pct_change(F.col("value"), ["k"], ["t"], 3)),
    "regime": lambda d: stats.regimes(d, "value", ["k"], 4).withColumn("x", F.col("regime")),
    "pearson": lambda d: stats.with_expanding_pearson(d.withColumn("y", F.col("value") * F.col("t")), "value", "y", ["k"], ["t"], "x"),
    "equity": lambda d: backtest.equity(d.select("k", F.col("t").alias("execution_t"), F.col("t").alias("decision_t"), F.col("value").alias("net_edge")), ("k",)).select(F.col("execution_t").alias("t"), F.col("drawdown").alias("x")),
}


@pytest.mark.parametrize("name", CAUSAL)
def test_no_row_sees_a_later_one(spark, name):
    rng = np.random.default_rng(2)
    v = rng.uniform(50, 150, 40)
    w = np.concatenate([v[:25], rng.uniform(1, 1000, 15)])
    a, b = (column(CAUSAL[name](series(spark, x).orderBy(F.rand(3)).repartition(3)), "x") for x in (v, w))
    assert a[:25] == b[:25]


def test_half_life(spark):
    rng = np.random.default_rng(5)
    x = [0.0]
    for e in rng.normal(0, 1, 600):
        x.append(0.85 * x[-1] + e)
    r = stats.half_life(stats.ar1(series(spark, x), "value", ["k"], ["t"])).first()
    want = math.log(0.5) / math.log(0.85)
    assert r.reason is None and 0.5 * want < r.half_life < 1.5 * want
    assert stats.half_life(stats.ar1(series(spark, [1] * 30), "value", ["k"], ["t"])).first().reason == "constant_series"


def test_t_distribution_against_tables():
    for df, t in ((1, 12.706), (5, 2.571), (10, 2.228), (30, 2.042)):
        assert abs(special.t_two_sided(t, df) - 0.05) < 2e-4


def test_unit_root_tables():
    # published asymptotic critical values of the Dickey-Fuller and Engle-Granger tests with a constant
    for series_, at in ((1, {-3.43: 0.01, -2.86: 0.05, -2.57: 0.10}), (2, {-3.90: 0.01, -3.34: 0.05, -3.04: 0.10})):
        for tau, p in at.items():
            assert abs(special.mackinnon_p(tau, series_) - p) < 0.004
    rng = np.random.default_rng(3)
    x = np.cumsum(rng.normal(size=500))
    assert special.cointegration(2 * x + rng.normal(size=500), x)["engle_granger_p"] < 0.01
    assert special.cointegration(np.cumsum(rng.normal(size=500)), x)["engle_granger_p"] > 0.05
    assert special.cointegration(x[:20], x[:20])["reason"] == "insufficient_observations"
    assert special.cointegration(np.ones(50), x[:50])["reason"] == "constant_series"
    assert special.cointegration(2 * x + 1, x)["reason"] in ("degenerate_residuals", "collinear_series")


def test_families_against_definitions(spark):
    p = [0.01, 0.04, 0.03, 0.005, 0.5]
    f = spark.createDataFrame([(i, str(i), x) for i, x in enumerate(p)], "position int, label string, p_value double")
    got = {m: {r.position: r.adjusted_p for r in multiplicity.adjust(f, m).collect()} for m in multiplicity.METHODS}
    assert [round(got["bonferroni"][i], 6) for i in range(5)] == [0.05, 0.2, 0.15, 0.025, 1.0]
    assert [round(got["holm"][i], 6) for i in range(5)] == [0.04, 0.09, 0.09, 0.025, 0.5]
    assert [round(got["fdr_bh"][i], 6) for i in range(5)] == [0.025, 0.05, 0.05, 0.025, 0.5]


def test_benjamini_yekutieli_in_a_large_family(spark):
    """Two families of unlike sizes; no row adds up a harmonic number by itself."""
    rows = [(k, i, (i * 37 % 997 + 1) / 99_700) for k, n in ((0, 3_000), (1, 7)) for i in range(n)]
    adjusted = multiplicity.adjust(spark.createDataFrame(rows, "family int, position int, p_value double"), "fdr_by", by=("family",))
    assert "sequence(" not in adjusted._jdf.queryExecution().toString() and "_h" not in adjusted.columns
    got = {(r.family, r.position): r.adjusted_p for r in adjusted.collect()}
    for k, n in ((0, 3_000), (1, 7)):
        own = sorted((p, i) for f, i, p in rows if f == k)
        harmonic, least = sum(1 / j for j in range(1, n + 1)), 1.0
        for rank in range(n, 0, -1):
            p, i = own[rank - 1]
            least = min(least, p * n / rank * harmonic)
            assert abs(got[k, i] - least) < 1e-12


def test_formulas():
    n = formula.parse('a + b * c / ("d e" - 100)')
    assert n.symbols() == {"a", "b", "c", "d e", "100"}
    assert formula.equivalent("a*b/c", "b/c*a") and formula.equivalent("a+b-c", "b-c+a") and not formula.equivalent("a/b", "b/a")
    assert formula.monomial(formula.parse("a/a*b")) == {"b": 1}
    for bad in ("", "a+", "(a", "a b", "-a", "a+*b", "a)"):
        with pytest.raises(InvalidFormulaError):
            formula.parse(bad)


def test_formula_columns(spark):
    df = spark.createDataFrame([(6.0, 2.0), (6.0, 0.0)], "a double, b double")
    assert [r[0] for r in df.select(formula.to_column(formula.parse("a/b"))).collect()] == [3.0, None]
    with pytest.raises(Exception, match="divides by zero"):
        df.select(formula.to_column(formula.parse("a/b"), strict=True)).collect()


def test_trades_settle_on_the_next_row(spark):
    rows = spark.createDataFrame([(0, 1.0, 0.01, 0.001), (1, 0.0, 0.02, 0.002), (2, -1.0, 0.03, 0.002), (3, 1.0, 0.02, 0.002)], "t long, signal double, gross_edge double, cost double")
    made = backtest.trades(rows).orderBy("decision_t").collect()
    assert [(r.decision_t, r.execution_t) for r in made] == [(0, 1), (2, 3)]
    m = backtest.metrics(backtest.trades(rows)).first()
    assert abs(m.gross - 0.04) < 1e-12 and abs(m.net - 0.036) < 1e-12
    only_last = rows.withColumn("signal", F.when(F.col("t") == 3, 1.0).otherwise(0.0))
    assert backtest.trades(only_last).count() == 0
    none = backtest.metrics(backtest.trades(only_last)).first()
    assert none.observations == 0 and none.win_rate is None


def test_grids_must_agree(spark):
    a = spark.createDataFrame([(1, 1.0)], "t long, signal double")
    with pytest.raises(DataQualityError):
        backtest.one_grid(a, spark.createDataFrame([(2, 1.0)], "t long, e double"))
    assert backtest.one_grid(a, spark.createDataFrame([(1, 1.0)], "t long, e double")).count() == 1


def test_walk_forward_folds(spark):
    rows = spark.createDataFrame([(i, float(i % 3 == 0), 0.001 + (i % 4) / 10000, 0.0001) for i in range(40)], "t long, signal double, gross_edge double, cost double")
    counts = {(r.fold, r.split): r["count"] for r in backtest.fold_rows(rows, 10, 8, 8, 8).groupBy("fold", "split").count().collect()}
    assert counts == {(f, s): n for f in (0, 1) for s, n in (("train", 10), ("validation", 8), ("test", 8))}
    w = rows.limit(1).select(backtest.walk_forward_windows(40, 10, 8, 8, 8).alias("w")).first().w
    assert [x.test_start for x in w] == [18, 26]


def test_monte_carlo(spark):
    made = spark.createDataFrame([(i, 0.01 + i % 3 / 1000, 0.001) for i in range(20)], "execution_t long, gross_edge double, cost double")
    a, b = (sorted(map(tuple, montecarlo.simulate(made.repartition(n), 30, 4, 9).collect())) for n in (1, 5))
    assert a == b
    d = {r.scenario: r["mean"] for r in montecarlo.distribution(montecarlo.simulate(made, 30, 4, 9)).collect()}
    assert all(v <= d["baseline"] for v in d.values()) and d["combined_stress"] < d["baseline"]


def test_coverage(spark):
    rows = [(t, s, 1.0) for s, ts in {"a": range(10), "b": [0, 1, 2, 6, 7, 8, 9], "c": [3, 4]}.items() for t in ts]
    p = spark.createDataFrame(rows, "t long, symbol string, close double")
    got = {r.symbol: (r.observations, r.largest_gap) for r in coverage.symbol_coverage(p).collect()}
    assert got == {"a": (10, 0), "b": (7, 3), "c": (2, 5)}
    assert coverage.shared_window(p, 2) == {"start": 0, "end": 9, "rows": 10, "symbols": ["a", "b"]} or coverage.shared_window(p, 2)["rows"] == 4


def test_ranking_and_candidates(spark):
    made, left = discovery.candidates(["a", "b", "c"], 10)
    assert len(made) == 10 and left == 2 and made[0] == ("a/b", '"a"/"b"')
    kept = discovery.deduplicate(spark, made).where("kept_as is null").count()
    assert kept == 9
    assert {r.name for r in discovery.expand(discovery.catalog(spark), ["EURUSD", "GBPUSD"]).collect()} == {"EURGBP"}


def test_symbol_names(spark):
    c = spark.createDataFrame([("XAUUSDmicro", 0), ("GOLD", 1), ("xau.usd", 2)], "symbol string, position int")
    r = symbols.resolve(c, "XAUUSD").first()
    assert (r.symbol, r.reason) == ("xau.usd", "normalized_name")
    r = symbols.resolve(c.where("position < 2"), "XAUUSD").first()
    assert (r.symbol, r.reason) == ("GOLD", "alias")


def test_one_long_series_as_one_key(spark):
    """Without keys, stretches of days give what one window gives."""
    import numpy as np

    rng = np.random.default_rng(4)
    t = np.unique(rng.integers(-3, 40, 300) * 43_200_000_000 + rng.integers(0, 5, 300))
    rows = [(int(x), float(rng.integers(-1, 2)), float(rng.normal()), float(rng.random() / 10), "k", float(rng.integers(0, 9))) for x in t]
    df = spark.createDataFrame(rows, "t long, signal double, gross_edge double, cost double, k string, v double")
    plain = lambda f: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in f.collect())
    for convention in backtest.CONVENTIONS:
        assert plain(backtest.trades(df, convention=convention)) == plain(backtest.trades(df, convention=convention, keys=("k",)).drop("k"))
    made = backtest.trades(df)
    assert plain(backtest.equity(made)) == plain(backtest.equity(made.withColumn("k", F.lit(1)), ("k",)).drop("k"))
    assert plain(backtest.numbered(df).select("t", "pos")) == [(int(x), i) for i, x in enumerate(t)]
    a, b = (stats.correlation(df, "v", "gross_edge", by).first() for by in ((), ("k",)))
    assert (a.n, round(a.pearson, 9), round(a.spearman, 9)) == (b.n, round(b.pearson, 9), round(b.spearman, 9))
    flags = spark.createDataFrame([(i, i + 65_530) for i in range(20) if i not in (3, 15)], "t long, bar long")
    assert tuple(coverage.longest_run(flags).first()) == (4, 14, 11)
    last = [r.t for r in backtest.unsettled(df.withColumn("signal", F.lit(1.0))).collect()]
    assert last == [int(t[-1])]


def test_running_quantiles_are_exact():
    import numpy as np

    rng = np.random.default_rng(8)
    for share in (0.0, 0.2, 0.5, 0.8, 1.0):
        q, seen = stats.RunningQuantile(share), []
        for x in np.round(rng.normal(size=400), 1).tolist():
            seen.append(x)
            assert abs(q.add(x) - np.quantile(seen, share)) < 1e-12


def test_monte_carlo_by_joins(spark, monkeypatch):
    made = spark.createDataFrame([(i * 10**9, 0.01 + i % 3 / 1000, 0.001 + i % 5 / 10000) for i in range(57)], "execution_t long, gross_edge double, cost double")
    for rotate in (False, True):
        found = []
        for most in (10**6, 0):
            monkeypatch.setattr(montecarlo, "MOST_WHOLE", most)
            found.append({(r.scenario, r.simulation): (round(r.total, 9), round(r.drawdown, 9), round(r.win_rate, 9), r.trades) for r in montecarlo.simulate(made, 9, 4, 11, rotate=rotate).collect()})
        assert found[0] == found[1] and len(found[0]) == 45


def test_monte_carlo_refuses(spark):
    from tsweave.errors import InsufficientDataError

    with pytest.raises(InsufficientDataError):
        montecarlo.simulate(spark.createDataFrame([], "execution_t long, gross_edge double, cost double"), 3, 1, 1)
    with pytest.raises(DataQualityError):
        montecarlo.simulate(spark.createDataFrame([(1, 0.1, -0.1)], "execution_t long, gross_edge double, cost double"), 3, 1, 1)


def test_the_last_of_equal_normalised_names(spark):
    c = spark.createDataFrame([("EUR.USD", 0), ("eurusd", 1)], "symbol string, position int")
    assert symbols.resolve(c, "EURUSD").first().symbol == "eurusd"
