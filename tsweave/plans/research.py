"""Queries over panels and series: formulas, statistics, coverage, discovery, families, backtests and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import formula
from ..functions.columns import micros
from ..operators import backtest, coverage, discovery, montecarlo, multiplicity, stats, symbols
from ..sources import tables
from . import inputs as I  # noqa: E741
from .inputs import query, r6, rounded, with_


@query(with_("wide", "SELECT t, round(f/nullif(o,0),6) AS ratio, round(f*o/nullif(p,0),4) AS product_div FROM wide"))
def formula_ratio(spark, sf):
    w = I.wide(spark, sf)
    return rounded(w.select("t", formula.to_column(formula.parse("f/o")).alias("ratio"), F.round(formula.to_column(formula.parse("f*o/p")), 4).alias("product_div")))


@query(with_("wide", "SELECT t, round((f+o)*p/nullif(f-o,0)-p,4) AS value FROM wide"))
def formula_sums(spark, sf):
    return rounded(I.wide(spark, sf).select("t", F.round(formula.to_column(formula.parse("(f + o) * p / (f - o) - p")), 4).alias("value")))


@query(with_("wide", "SELECT t, round(f*0.999/(o*1.001),6) AS low, round(f*1.001/(o*0.999),6) AS high FROM wide"))
def interval_price(spark, sf):
    low, high = formula.to_interval(formula.parse("f/o"), lambda s: F.col(s) * 0.999, lambda s: F.col(s) * 1.001)
    return rounded(I.wide(spark, sf).select("t", low.alias("low"), high.alias("high")))


@query(with_("wide", """, d AS (SELECT t, p*0.999 AS bid, p*1.001 AS ask, f*0.999*0.5+o*0.999*0.5 AS low, f*1.001*0.5+o*1.001*0.5 AS high, f*0.5+o*0.5 AS theory FROM wide)
SELECT t, round(bid-high,3) AS buy_edge, round(low-ask,3) AS sell_edge, round((bid+ask)/2-theory,3) AS difference, round(((bid+ask)/2-theory)/nullif(theory,0)*100,6) AS percent, CASE WHEN greatest(bid-high,low-ask)>0 THEN 'executable' WHEN (bid+ask)/2<>theory THEN 'theoretical' ELSE 'none' END AS kind FROM d"""))
def discrepancy_kind(spark, sf):
    w = I.wide(spark, sf)
    tree = formula.parse("f + o")
    low, high = formula.to_interval(tree, lambda s: F.col(s) * 0.999 * 0.5, lambda s: F.col(s) * 1.001 * 0.5)
    mid = formula.to_column(tree, prices=lambda s: F.col(s) * 0.5)
    found = formula.discrepancy(F.col("p") * 0.999, F.col("p") * 1.001, low, high, mid)
    return rounded(w.select("t", *[(F.round(c, 3) if n in ("buy_edge", "sell_edge", "difference") else c).alias(n) for n, c in found.items()]))


@query(with_("panel", "SELECT t, " + ", ".join(f"max(CASE WHEN symbol='{s}' THEN close END) AS {s}" for s in ("click", "purchase", "view")) + " FROM panel GROUP BY t"))
def panel_pivot(spark, sf):
    return coverage.pivoted(I.panel(spark, sf), ["click", "purchase", "view"])


@query(with_("panel", "SELECT t FROM panel GROUP BY t HAVING count(DISTINCT symbol)>=(SELECT count(DISTINCT symbol) FROM panel)"))
def panel_complete_rows(spark, sf):
    p = I.panel(spark, sf)
    return coverage.full_rows(p, p.select("symbol").distinct().count())


@query(with_("panel", ", bars AS (SELECT t, row_number() OVER (ORDER BY t) AS bar FROM (SELECT DISTINCT t FROM panel)), g AS (SELECT symbol, t, bar, bar-coalesce(lag(bar) OVER (PARTITION BY symbol ORDER BY bar),0)-1 AS gap FROM panel JOIN bars USING (t)) SELECT symbol, count(*) AS observations, min(t) AS first_t, max(t) AS last_t, round(count(*)/(SELECT count(*) FROM bars),6) AS fraction, greatest(max(gap),(SELECT count(*) FROM bars)-max(bar)) AS largest_gap FROM g GROUP BY symbol"))
def symbol_coverage(spark, sf):
    return rounded(coverage.symbol_coverage(I.panel(spark, sf)))


RUN = ", bars AS (SELECT t, row_number() OVER (ORDER BY t) AS bar FROM (SELECT DISTINCT t FROM panel)), r AS (SELECT t, bar-row_number() OVER (ORDER BY bar) AS g FROM bars WHERE t IN (SELECT t FROM panel{where} GROUP BY t HAVING count(*)>={n})) SELECT min(t) AS start_t, max(t) AS end_t, count(*) AS rows FROM r GROUP BY g ORDER BY rows DESC, start_t LIMIT 1"


@query(with_("panel", RUN.format(where="", n=5)))
def longest_run(spark, sf):
    p = I.panel(spark, sf)
    return coverage.longest_run(coverage.grid(p).join(coverage.full_rows(p, 5), "t"))


@query(with_("series", RUN.replace("panel", "series").format(where="", n=3)))
def shared_window(spark, sf):
    found = coverage.shared_window(I.series(spark, sf), 3)
    rows = [(found["start"], found["end"], found["rows"])] if found else []
    return spark.createDataFrame(rows, "start_t long, end_t long, rows long")


@query(with_("series", "SELECT * FROM series WHERE t BETWEEN 800000000000000 AND 900000000000000"))
def panel_slice(spark, sf):
    return coverage.slice_of(I.series(spark, sf), 800_000_000_000_000, 900_000_000_000_000)


@query("""WITH d AS (SELECT * FROM (VALUES ('EURGBP','EURGBP',['EURUSD','GBPUSD']),('EURJPY','EURJPY',['EURUSD','USDJPY']),('GBPJPY','GBPJPY',['GBPUSD','USDJPY']),('XAUEUR','XAUEUR',['EURUSD','XAUUSD']),('GOLD_SILVER_RATIO','GOLD_SILVER_RATIO',['XAGUSD','XAUUSD'])) v(name,target,deps)) SELECT name, target FROM d WHERE NOT EXISTS (SELECT 1 FROM unnest(deps) u(x) WHERE x NOT IN ('EURUSD','GBPUSD','USDJPY','XAUUSD'))""")
def symbol_division(spark, sf):
    return discovery.expand(discovery.catalog(spark), ["EURUSD", "GBPUSD", "USDJPY", "XAUUSD"]).select("name", "target")


@query("SELECT x.event_type AS a, y.event_type AS b FROM (SELECT DISTINCT event_type FROM events) x, (SELECT DISTINCT event_type FROM events) y WHERE x.event_type<>y.event_type")
def symbol_pairs(spark, sf):
    return discovery.symbol_pairs(I.table(spark, sf, "events").select(F.col("event_type").alias("symbol")).distinct())


@query("WITH s AS (SELECT DISTINCT event_type AS e FROM events) SELECT x.e AS a, y.e AS b, z.e AS c FROM s x, s y, s z WHERE x.e<>y.e AND y.e<>z.e AND x.e<>z.e")
def symbol_triples(spark, sf):
    return discovery.symbol_triples(I.table(spark, sf, "events").select(F.col("event_type").alias("symbol")).distinct())


@query("SELECT n_name AS symbol FROM nation EXCEPT SELECT n_name FROM nation JOIN supplier ON n_nationkey=s_nationkey WHERE s_acctbal>9000")
def missing_symbols(spark, sf):
    n, s = I.table(spark, sf, "nation").withColumn("symbol", F.col("n_name")), I.table(spark, sf, "supplier").where("s_acctbal > 9000")
    return discovery.missing(n, n.join(s, n.n_nationkey == s.s_nationkey, "left_semi"))


@query("SELECT c_mktsegment AS symbol FROM customer GROUP BY 1 HAVING count(DISTINCT c_nationkey)>=(SELECT count(*) FROM nation)".replace("c_mktsegment AS symbol", "regexp_replace(lower(c_mktsegment),'[^a-z0-9]','','g') AS symbol"))
def shared_symbols(spark, sf):
    c = I.table(spark, sf, "customer").select(F.col("c_nationkey").alias("profile"), F.col("c_mktsegment").alias("symbol"))
    return symbols.shared_symbols(c, I.table(spark, sf, "nation").count())


def _candidates():
    return [("f/o", "f/o"), ("f*o/p", "f*o/p"), ("o*f/p", "o*f/p"), ("f/p*o", "f/p*o"), ("f+o", "f+o"), ("o+f", "o+f"), ("f-o", "f-o")]


@query("SELECT * FROM (VALUES (0,'f/o',NULL),(1,'f*o/p',NULL),(2,'o*f/p','f*o/p'),(3,'f/p*o','f*o/p'),(4,'f+o',NULL),(5,'o+f','f+o'),(6,'f-o',NULL)) v(p,name,kept_as)".replace("SELECT *", "SELECT CAST(p AS BIGINT) AS position, name, kept_as"))
def dedup_candidates(spark, sf):
    return rounded(discovery.deduplicate(spark, _candidates()).select("position", "name", "kept_as"))


@query("SELECT p_partkey, CASE WHEN p_size<10 THEN 'insufficient_observations' ELSE 'requires_data' END AS status FROM part")
def candidate_gate(spark, sf):
    p = I.table(spark, sf, "part").select("p_partkey", F.col("p_size").alias("observations"), F.lit("requires_data").alias("status"))
    return discovery.gate(p, 10).select("p_partkey", "status")


# ---- statistics of series


@query(with_("z", "SELECT t, symbol, round(z,6) AS z FROM z"))
def rolling_zscore(spark, sf):
    s = I.series(spark, sf)
    return rounded(s.select("t", "symbol", stats.zscore(F.col("close"), ["symbol"], ["t"], 20).alias("z")))


@query(with_("series", "SELECT t, symbol, round(close/nullif(lag(close,5) OVER (PARTITION BY symbol ORDER BY t),0)-1,6) AS momentum FROM series"))
def momentum(spark, sf):
    return rounded(I.series(spark, sf).select("t", "symbol", stats.pct_change(F.col("close"), ["symbol"], ["t"], 5).alias("momentum")))


RETURNS = ", ret AS (SELECT t, symbol, close, close/nullif(lag(close) OVER (PARTITION BY symbol ORDER BY t),0)-1 AS r FROM series)"


@query(with_("series", RETURNS + " SELECT t, symbol, round(CASE WHEN count(r) OVER w=20 THEN stddev_pop(r) OVER w END,6) AS volatility FROM ret WINDOW w AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"))
def realized_vol(spark, sf):
    s = I.series(spark, sf).withColumn("r", stats.pct_change(F.col("close"), ["symbol"], ["t"]))
    return rounded(s.select("t", "symbol", stats.realized_volatility(F.col("r"), ["symbol"], ["t"], 20).alias("volatility")))


@query(with_("wide", "SELECT t, round(coalesce(CASE WHEN count(f-o) OVER w>=5 THEN stddev_pop(f-o) OVER w END,0.0),4) AS volatility FROM wide WINDOW w AS (ORDER BY t ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"))
def disc_vol(spark, sf):
    w = I.wide(spark, sf).withColumn("k", F.lit(1)).withColumn("d", F.col("f") - F.col("o"))
    return w.select("t", F.round(stats.discrepancy_volatility(F.col("d"), ["k"], ["t"]), 4).alias("volatility"))


BETA = with_("wide", ", q AS (SELECT t, f/nullif(lag(f) OVER (ORDER BY t),0)-1 AS y, o/nullif(lag(o) OVER (ORDER BY t),0)-1 AS x FROM wide), bt AS (SELECT t, CASE WHEN count(x) OVER w=20 THEN covar_samp(y,x) OVER w/nullif(var_samp(x) OVER w,0) END AS beta FROM q WINDOW w AS (ORDER BY t ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) ")


def _beta(spark, sf):
    return stats.rolling_beta(I.wide(spark, sf).withColumn("k", F.lit(1)), "f", "o", 20, ["k"], ["t"])


@query(BETA + "SELECT t, round(beta,6) AS beta FROM bt")
def rolling_beta(spark, sf):
    return rounded(_beta(spark, sf).select("t", "beta"))


@query(BETA + f"SELECT count(*) AS windows, round(arg_max(beta,t),6) AS latest, round(avg(beta),6) AS mean, round(median(beta),6) AS median, round(stddev_pop(beta),6) AS deviation, round(min(beta),6) AS min, round(max(beta),6) AS max, round(avg((beta>0)::INT),6) AS positive_share, round(avg((beta<0)::INT),6) AS negative_share, round(greatest(avg((beta>0)::INT),avg((beta<0)::INT)),6) AS sign_consistency FROM bt WHERE beta IS NOT NULL")
def beta_summary(spark, sf):
    return rounded(stats.beta_summary(_beta(spark, sf)))


REGIME = with_("series", ", lr AS (SELECT t, symbol, CASE WHEN close>0 AND lag(close) OVER s>0 THEN ln(close/lag(close) OVER s) END AS r FROM series WINDOW s AS (PARTITION BY symbol ORDER BY t)), vol AS (SELECT t, symbol, CASE WHEN count(r) OVER w=20 THEN stddev_pop(r) OVER w END AS v FROM lr WINDOW w AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)), qq AS (SELECT t, symbol, v, quantile_cont(v,0.2) OVER u AS a, quantile_cont(v,0.8) OVER u AS b FROM vol WINDOW u AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), rg AS (SELECT t, symbol, v, CASE WHEN v IS NULL THEN NULL WHEN a=b THEN 'normal' WHEN v<=a THEN 'low' WHEN v>=b THEN 'high' ELSE 'normal' END AS regime FROM qq) ")


def _regimes(spark, sf):
    return stats.regimes(I.series(spark, sf), "close", ["symbol"], 20)


@query(REGIME + "SELECT t, symbol, round(v,6) AS volatility, regime FROM rg")
def regime_labels(spark, sf):
    return rounded(_regimes(spark, sf).select("t", "symbol", "volatility", "regime"))


@query(REGIME + "SELECT symbol, count(regime) AS observations, " + ", ".join(f"count(*) FILTER (regime='{r}') AS {r}, round(count(*) FILTER (regime='{r}')/nullif(count(regime),0),6) AS {r}_share" for r in ("low", "normal", "high")) + ", count(*) FILTER (regime IS NULL) AS warm_up FROM rg GROUP BY symbol")
def regime_summary(spark, sf):
    return rounded(stats.regime_summary(_regimes(spark, sf), ("symbol",)))


@query(with_("wide", ", c AS (SELECT t, f-first_value(f) OVER (ORDER BY t) AS a, o-first_value(o) OVER (ORDER BY t) AS b FROM wide), s AS (SELECT t, count(*) OVER u AS n, sum(a) OVER u AS sa, sum(b) OVER u AS sb, sum(a*b) OVER u AS sab, sum(a*a) OVER u AS saa, sum(b*b) OVER u AS sbb FROM c WINDOW u AS (ORDER BY t ROWS UNBOUNDED PRECEDING)) SELECT t, round(CASE WHEN n>=10 THEN greatest(-1.0,least(1.0,(sab-sa*sb/n)/nullif(sqrt(greatest(saa-sa*sa/n,0)*greatest(sbb-sb*sb/n,0)),0))) END,6) AS correlation FROM s"))
def expanding_pearson(spark, sf):
    w = I.wide(spark, sf).withColumn("k", F.lit(1))
    return rounded(stats.with_expanding_pearson(w, "f", "o", ["k"], ["t"]).select("t", "correlation"))


@query(with_("wide", ", rk AS (SELECT f, o, rank() OVER (ORDER BY f)+(count(*) OVER (PARTITION BY f)-1)/2.0 AS x, rank() OVER (ORDER BY o)+(count(*) OVER (PARTITION BY o)-1)/2.0 AS y FROM wide) SELECT count(*) AS n, round(covar_pop(f,o)/nullif(stddev_pop(f)*stddev_pop(o),0),6) AS pearson, round(covar_pop(x,y)/nullif(stddev_pop(x)*stddev_pop(y),0),6) AS spearman, CAST(NULL AS VARCHAR) AS reason FROM rk"))
def correlations(spark, sf):
    return rounded(stats.correlation(I.wide(spark, sf), "f", "o"))


@query(with_("wide", ", n AS (SELECT row_number() OVER (ORDER BY t) AS i, f, o FROM wide) SELECT CAST(k AS BIGINT) AS lag, count(*) AS n, round(covar_pop(x.f,y.o)/nullif(stddev_pop(x.f)*stddev_pop(y.o),0),6) AS r FROM (SELECT unnest(range(-3,4)) AS k) g, n x JOIN n y ON y.i=x.i+k GROUP BY k"))
def lead_lag(spark, sf):
    w = I.wide(spark, sf).withColumn("one", F.lit(1))
    return rounded(stats.lead_lag(w, "f", "o", 3, ["one"], ["t"]).select("lag", "n", "r"))


@query(with_("series", ", d AS (SELECT symbol, lag(close) OVER s AS x, close-lag(close) OVER s AS y FROM series WINDOW s AS (PARTITION BY symbol ORDER BY t)) SELECT symbol, count(*) AS n, round(regr_slope(y,x),6) AS slope, round(regr_intercept(y,x),3) AS intercept, round(regr_r2(y,x),6) AS r2 FROM d WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY symbol"))
def ar1_slope(spark, sf):
    return rounded(stats.ar1(I.series(spark, sf), "close", ["symbol"], ["t"]).withColumn("intercept", F.round("intercept", 3)))


@query()
def half_life(spark, sf):
    return rounded(stats.half_life(stats.ar1(I.series(spark, sf), "close", ["symbol"], ["t"])))


@query()
def cointegration(spark, sf):
    from ..operators.special import cointegration_by_name

    w = I.wide(spark, sf)
    pairs = w.select(F.lit("f~o").alias("name"), "t", F.col("f").alias("y"), F.col("o").alias("x")).union(w.select(F.lit("f~p"), "t", F.col("f"), F.col("p")))
    return rounded(cointegration_by_name(pairs))


@query(with_("wide", ", d AS (SELECT t, f-o AS d FROM wide), e AS (SELECT t, d, CASE WHEN count(d) OVER w=20 THEN (d-avg(d) OVER w)/nullif(stddev_pop(d) OVER w,0) END AS z FROM d WINDOW w AS (ORDER BY t ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) SELECT 'f-o' AS name, count(d) AS n, round(avg(abs(d)),4) AS mae, round(sqrt(avg(d*d)),4) AS rmse, round(quantile_cont(abs(d),0.95),4) AS p95, round(arg_max(z,t),6) AS latest_z FROM e"))
def candidate_error_metrics(spark, sf):
    w = I.wide(spark, sf).select(F.lit("f-o").alias("name"), "t", (F.col("f") - F.col("o")).alias("discrepancy"))
    w = w.withColumn("zscore", stats.zscore(F.col("discrepancy"), ["name"], ["t"], 20))
    m = stats.error_metrics(w)
    return rounded(m.withColumns({c: F.round(c, 4) for c in ("mae", "rmse", "p95")}))


# ---- families of hypotheses


def _family(spark, sf):
    p = I.table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("position"), F.col("p_name").alias("label"), ((F.col("p_partkey") * 37 % 997 + 1) / 99700.0).alias("p_value"), (F.col("p_partkey") % 5).alias("family"))


def _fdr(method: str, sql: str):
    body = f", o AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p_value, position) AS i, count(*) OVER (PARTITION BY family) AS n FROM family), r AS (SELECT *, least(1.0,{sql}) AS adjusted FROM o) SELECT position, i AS rank, round(adjusted,6) AS adjusted_p, adjusted<=0.05 AS rejected FROM r"

    def run(spark, sf):
        found = multiplicity.adjust(_family(spark, sf), method, by=("family",))
        return rounded(found.select("position", "rank", "adjusted_p", "rejected"))

    run.__name__ = method if method.startswith("fdr") else f"fdr_{method}"
    query(with_("family", body))(run)


_fdr("bonferroni", "p_value*n")
_fdr("sidak", "1-pow(1-p_value,n)")
_fdr("holm", "max(p_value*(n-i+1)) OVER (PARTITION BY family ORDER BY i)")
_fdr("fdr_bh", "min(p_value*n/i) OVER (PARTITION BY family ORDER BY i DESC)")
_fdr("fdr_by", "min(p_value*n/i*(SELECT sum(1.0::DOUBLE/k) FROM range(1,o.n+1) g(k))) OVER (PARTITION BY family ORDER BY i DESC)")


@query(with_("family", ", o AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p_value, position) AS i, count(*) OVER (PARTITION BY family) AS n FROM family), r AS (SELECT *, min(p_value*n/i) OVER (PARTITION BY family ORDER BY i DESC) AS q FROM o) SELECT family, count(*) AS tested, count(*) FILTER (q<=0.05) AS rejected, count(*) FILTER (p_value<=0.05) AS rejected_unadjusted, round(count(*)*0.05,6) AS expected_false_positives FROM r GROUP BY family"))
def family_report(spark, sf):
    return rounded(multiplicity.family_report(multiplicity.adjust(_family(spark, sf), "fdr_bh", by=("family",)), by=("family",)))


@query("SELECT p_partkey AS label, round(p_size/50.0-0.1,6) AS p_value, coalesce(CASE WHEN p_partkey%3=0 THEN NULL ELSE p_partkey%2=0 END=false,false) AS contested FROM part WHERE p_size/50.0-0.1 BETWEEN 0 AND 1")
def family_build(spark, sf):
    p = I.table(spark, sf, "part")
    k = F.col("p_partkey")
    rows = p.select(k.alias("label"), (F.col("p_size") / 50.0 - 0.1).alias("p_value"), F.when(k % 3 != 0, k % 2 == 0).alias("tests_agree"))
    return rounded(multiplicity.build_family(rows).select("label", "p_value", "contested"))


# ---- backtests


def _signals(spark, sf):
    s = I.series(spark, sf).where("symbol = 'F'")
    z = stats.zscore(F.col("close"), ["symbol"], ["t"], 20)
    own = s.select("t", "symbol", "close", z.alias("z"))
    edge = stats.pct_change(F.col("close"), ["symbol"], ["t"])
    return own.select("t", F.when(F.col("z") < -0.5, 1.0).otherwise(0.0).alias("signal"), F.coalesce("z", F.lit(0.0)).alias("zscore"), edge.alias("gross_edge"), F.lit(0.001).alias("cost"))


@query(with_("trades", f"SELECT decision_t, execution_t, {r6('gross_edge', 'cost', 'net_edge')} FROM trades"))
def next_observation_trades(spark, sf):
    return rounded(backtest.trades(_signals(spark, sf)))


@query(with_("signals", "SELECT t AS decision_t, t AS execution_t, round(gross_edge,6) AS gross_edge, round(cost,6) AS cost, round(gross_edge-cost,6) AS net_edge FROM signals WHERE signal<>0 AND gross_edge IS NOT NULL"))
def realised_trades(spark, sf):
    return rounded(backtest.trades(_signals(spark, sf), convention="realised_at_bar"))


@query(with_("equity", "SELECT execution_t, round(equity,6) AS equity, round(equity-peak,6) AS drawdown FROM equity"))
def equity_drawdown(spark, sf):
    return rounded(backtest.equity(backtest.trades(_signals(spark, sf))).select("execution_t", "equity", "drawdown"))


METRICS = "count(*) AS observations, count(*) FILTER (gross_edge>0) AS opportunities, round(sum(gross_edge),6) AS gross, round(sum(net_edge),6) AS net, round(avg((net_edge>0)::INT) FILTER (gross_edge>0),6) AS win_rate, round(avg(net_edge) FILTER (gross_edge>0),6) AS mean_net, round(sum(least(net_edge,0)),6) AS mae, round(sum(greatest(net_edge,0)),6) AS mfe, round(sum(cost) FILTER (gross_edge>0)/nullif(sum(gross_edge) FILTER (gross_edge>0),0)*100,6) AS cost_percent, round(avg((net_edge>0)::INT),6) AS observation_win_rate"


@query(with_("equity", f"SELECT {METRICS}, round(min(equity-peak),6) AS drawdown FROM equity"))
def backtest_metrics(spark, sf):
    return rounded(backtest.metrics(backtest.trades(_signals(spark, sf))))


@query(with_("signals", ", n AS (SELECT count(*) AS n FROM signals), s AS (SELECT unnest(range(0, n-200+1, 40)) AS s FROM n WHERE n>=200) SELECT (s//40) AS fold, s AS train_start, s+120 AS validation_start, s+160 AS test_start, s+200 AS test_end FROM s"))
def walk_forward_windows(spark, sf):
    n = _signals(spark, sf).agg(F.count("*").alias("n"))
    w = n.select(F.explode(backtest.walk_forward_windows(F.col("n"), 120, 40, 40)).alias("w"))
    return rounded(w.select("w.*"))


WF = with_("signals", ", num AS (SELECT *, row_number() OVER (ORDER BY t)-1 AS pos FROM signals), nn AS (SELECT count(*) AS n FROM signals), f AS (SELECT unnest(range(0, n-200+1, 40)) AS s FROM nn WHERE n>=200), fr AS (SELECT s//40 AS fold, num.*, CASE WHEN pos-s<120 THEN 'train' WHEN pos-s<160 THEN 'validation' ELSE 'test' END AS split, x.threshold FROM f JOIN num ON pos>=s AND pos<s+200, (SELECT unnest([-1.0,0.0,0.5]) AS threshold) x), ld AS (SELECT fold, split, threshold, t AS decision_t, zscore, lead(t) OVER w AS execution_t, lead(gross_edge) OVER w AS gross_edge, lead(cost) OVER w AS cost FROM fr WINDOW w AS (PARTITION BY fold, split, threshold ORDER BY t)), tr AS (SELECT fold, split, threshold, decision_t, execution_t, gross_edge, cost, gross_edge-cost AS net_edge FROM ld WHERE zscore>threshold AND execution_t IS NOT NULL AND gross_edge IS NOT NULL), sc AS (SELECT fold, threshold, avg(net_edge) AS train_mean, count(*) AS train_trades FROM tr WHERE split='train' AND gross_edge>0 GROUP BY fold, threshold), ch AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY train_mean DESC, threshold) AS k FROM sc) WHERE k=1) ")


def _walk(spark, sf):
    rows = _signals(spark, sf).withColumn("signal", F.col("zscore"))
    return backtest.walk_forward(rows, (-1.0, 0.0, 0.5), 120, 40, 40)


@query(WF + "SELECT fold, threshold::DOUBLE AS threshold, round(train_mean,6) AS train_mean, train_trades FROM ch")
def wf_threshold_selection(spark, sf):
    return rounded(_walk(spark, sf)[0])


@query(WF + f", te AS (SELECT tr.* FROM tr JOIN ch USING (fold, threshold) WHERE split='test'), u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY execution_t ORDER BY fold, decision_t) AS k FROM te) WHERE k=1), e AS (SELECT *, sum(net_edge) OVER (ORDER BY execution_t, decision_t) AS equity FROM u), g AS (SELECT *, greatest(0.0,max(equity) OVER (ORDER BY execution_t, decision_t)) AS peak FROM e) SELECT {METRICS}, round(min(equity-peak),6) AS drawdown FROM g")
def wf_aggregate(spark, sf):
    return rounded(backtest.metrics(backtest.once_each(_walk(spark, sf)[1])))


@query(with_("lead1", ", st AS (SELECT decision_t, execution_t, gross_edge, cost, 'ensemble' AS stage, signal*0.5+zscore*-0.3 AS score FROM lead1 UNION ALL SELECT decision_t, execution_t, gross_edge, cost, 'signal', signal FROM lead1 UNION ALL SELECT decision_t, execution_t, gross_edge, cost, 'zscore', zscore FROM lead1) SELECT stage, count(*) AS trades, round(sum(gross_edge-cost),6) AS net FROM st WHERE score>0.4 AND execution_t IS NOT NULL AND gross_edge IS NOT NULL GROUP BY stage"))
def multi_stage_ensemble(spark, sf):
    made = backtest.ensemble(_signals(spark, sf), {"signal": 0.5, "zscore": -0.3}, 0.4)
    return rounded(made.groupBy("stage").agg(F.count("*").alias("trades"), F.sum("net_edge").alias("net")))


@query()
def monte_carlo(spark, sf):
    made = backtest.trades(_signals(spark, sf))
    return rounded(montecarlo.distribution(montecarlo.simulate(made, 200, 10, 7)))


@query(with_("trades", """, n AS (SELECT *, row_number() OVER (ORDER BY execution_t)-1 AS pos, count(*) OVER () AS n FROM trades), s AS (SELECT unnest(range(0,25)) AS simulation), c AS (SELECT * FROM (VALUES ('baseline',1.0),('wider_spread',1.5),('slippage',1.25),('latency',1.0),('combined_stress',2.0)) v(scenario,k)), r AS (SELECT scenario, simulation, (pos-simulation%n+n)%n AS i, gross_edge-cost*k::DOUBLE AS net FROM n, s, c), e AS (SELECT scenario, simulation, i, net, sum(net) OVER (PARTITION BY scenario, simulation ORDER BY i) AS eq FROM r), p AS (SELECT *, eq-greatest(0.0,max(eq) OVER (PARTITION BY scenario, simulation ORDER BY i)) AS dd FROM e), o AS (SELECT scenario, simulation, sum(net) AS total, min(dd) AS drawdown, avg((net>0)::INT) AS win FROM p GROUP BY scenario, simulation)
SELECT scenario, count(*) AS simulations, round(avg(total),6) AS mean, round(median(drawdown),6) AS median_drawdown, round(quantile_cont(drawdown,0.025),6) AS confidence_drawdown, round(avg(win),6) AS mean_win_rate FROM o GROUP BY scenario"""))
def monte_carlo_rotation(spark, sf):
    runs = montecarlo.simulate(backtest.trades(_signals(spark, sf)), 25, 1, 7, rotate=True)
    d = montecarlo.distribution(runs)
    return rounded(d.select("scenario", "simulations", "mean", "median_drawdown", "confidence_drawdown", "mean_win_rate"))


# ---- ranking


def _histories(spark, sf):
    names = [("f~o", "f", "o"), ("f~o*p/o", "f", "o*p/o"), ("o~p", "o", "p")]
    return discovery.evaluate(I.wide(spark, sf), ["f", "o", "p"], names)[0]


HISTORIES = with_("wide", """, c AS (SELECT 'f~o' AS name, t, f AS a, o AS s FROM wide UNION ALL SELECT 'f~o*p/o', t, f, o*p/nullif(o,0) FROM wide UNION ALL SELECT 'o~p', t, o, p FROM wide),
h0 AS (SELECT *, a-s AS d, a/nullif(lag(a) OVER w,0)-1 AS ra, s/nullif(lag(s) OVER w,0)-1 AS rs, CASE WHEN a>0 AND lag(a) OVER w>0 THEN ln(a/lag(a) OVER w) END AS lr, a-first_value(a) OVER w AS ca, s-first_value(s) OVER w AS cs FROM c WINDOW w AS (PARTITION BY name ORDER BY t)),
h1 AS (SELECT *, CASE WHEN count(d) OVER w=20 THEN (d-avg(d) OVER w)/nullif(stddev_pop(d) OVER w,0) END AS z, coalesce(CASE WHEN count(d) OVER w>=5 THEN stddev_pop(d) OVER w END,0.0) AS dv, CASE WHEN count(rs) OVER w=20 THEN covar_samp(ra,rs) OVER w/nullif(var_samp(rs) OVER w,0) END AS beta, CASE WHEN count(lr) OVER w=20 THEN stddev_pop(lr) OVER w END AS v FROM h0 WINDOW w AS (PARTITION BY name ORDER BY t ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
h2 AS (SELECT *, count(*) OVER u AS n, sum(ca) OVER u AS sa, sum(cs) OVER u AS sb, sum(ca*cs) OVER u AS sab, sum(ca*ca) OVER u AS saa, sum(cs*cs) OVER u AS sbb, quantile_cont(v,0.2) OVER u AS q1, quantile_cont(v,0.8) OVER u AS q2 FROM h1 WINDOW u AS (PARTITION BY name ORDER BY t ROWS UNBOUNDED PRECEDING)),
h3 AS (SELECT *, CASE WHEN v IS NULL THEN NULL WHEN q1=q2 THEN 'normal' WHEN v<=q1 THEN 'low' WHEN v>=q2 THEN 'high' ELSE 'normal' END AS regime FROM h2)
SELECT name, t, round(a,4) AS actual, round(s,4) AS synthetic, round(d,4) AS discrepancy, round(abs(d),4) AS abs_discrepancy, round(z,4) AS zscore, round(dv,4) AS discrepancy_volatility, round(beta,4) AS rolling_beta, round(CASE WHEN n>=10 THEN greatest(-1.0,least(1.0,(sab-sa*sb/n)/nullif(sqrt(greatest(saa-sa*sa/n,0)*greatest(sbb-sb*sb/n,0)),0))) END,4) AS correlation, regime, CASE regime WHEN 'low' THEN -1.0 WHEN 'high' THEN 1.0 WHEN 'normal' THEN 0.0 END::DOUBLE AS volatility_regime, round(lead(abs(z)) OVER (PARTITION BY name ORDER BY t),4) AS next_abs_zscore FROM h3""")


@query(HISTORIES)
def candidate_histories(spark, sf):
    return rounded(_histories(spark, sf), 4)


@query()
def ridge_rank(spark, sf):
    found = discovery.rank_candidates(_histories(spark, sf))
    return rounded(found) if found is not None else spark.createDataFrame([], "name string, prediction double, rmse double, rows long, rank long")


@query(with_("wide", ", d AS (SELECT t, f-o AS d, o-p AS e, f-p AS y FROM wide) SELECT count(*) AS n, round(sum(y),2) AS y, round(sum(d),2) AS s_0, round(sum(e),2) AS s_1, round(sum(d*y)/1e6,2) AS y_0, round(sum(e*y)/1e6,2) AS y_1, round(sum(d*d)/1e6,2) AS s_0_0, round(sum(d*e)/1e6,2) AS s_0_1, round(sum(e*e)/1e6,2) AS s_1_1 FROM d"))
def ridge_gram(spark, sf):
    w = I.wide(spark, sf)
    g = discovery.gram(w.select((F.col("f") - F.col("o")).alias("d"), (F.col("o") - F.col("p")).alias("e"), (F.col("f") - F.col("p")).alias("y")), ("d", "e"), "y")
    return g.select("n", *[F.round(c, 2).alias(c) for c in ("y", "s_0", "s_1")], *[F.round(F.col(c) / 1e6, 2).alias(c) for c in ("y_0", "y_1", "s_0_0", "s_0_1", "s_1_1")])


@query(with_("series", ", x AS (SELECT DISTINCT t FROM series), k AS (SELECT max(t) AS c FROM (SELECT t FROM x ORDER BY t LIMIT (SELECT greatest(1,CAST(floor(count(*)*0.7) AS BIGINT)) FROM x))) SELECT symbol, count(*) FILTER (t<=c) AS train, count(*) FILTER (t>c) AS test FROM series, k GROUP BY symbol"))
def chronological_split(spark, sf):
    s = discovery.chronological_split(I.series(spark, sf))
    return s.groupBy("symbol").agg(F.count_if("train").alias("train"), F.count_if(~F.col("train")).alias("test"))


# ---- names


@query("SELECT s_suppkey, regexp_replace(lower(s_name),'[^a-z0-9]','','g') AS normalized FROM supplier")
def name_normalize(spark, sf):
    return I.table(spark, sf, "supplier").select("s_suppkey", symbols.normalized(F.col("s_name")).alias("normalized"))


@query("SELECT p_partkey, regexp_matches(' '||lower(p_type)||' ','[^a-z0-9]brass[^a-z0-9]') OR regexp_matches(' '||lower(p_name)||' ','[^a-z0-9]green[^a-z0-9]') AS hit FROM part")
def boundary_match(spark, sf):
    return I.table(spark, sf, "part").select("p_partkey", (symbols.holds_word(F.col("p_type"), "brass") | symbols.holds_word(F.col("p_name"), "green")).alias("hit"))


@query("SELECT n_name AS name, 'description' AS reason, CAST(85 AS BIGINT) AS quality, row_number() OVER (ORDER BY length(n_name), upper(n_name)) AS rank FROM nation")
def symbol_search(spark, sf):
    n = I.table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.concat(F.lit("Trade area of "), "n_name").alias("description"))
    return rounded(symbols.search(n, "area").select("name", "reason", "quality", "rank"))


@query("SELECT n_nationkey, CASE n_nationkey%6 WHEN 0 THEN 'disabled' WHEN 1 THEN 'long_only' WHEN 2 THEN 'short_only' WHEN 3 THEN 'close_only' WHEN 4 THEN 'full' END AS mode, n_nationkey%6 BETWEEN 1 AND 4 AS tradable FROM nation")
def trade_modes(spark, sf):
    n = I.table(spark, sf, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 6 < 5, (F.col("n_nationkey") % 6).cast("int")).alias("trade_mode"))
    return n.select("n_nationkey", symbols.trade_mode_name().alias("mode"), symbols.is_tradable().alias("tradable"))


@query("SELECT t, count(*) AS n FROM (SELECT (epoch_us(ts)//3600000000)*3600000000 AS t FROM events) GROUP BY t ORDER BY n DESC, t LIMIT 10")
def topk_last_n(spark, sf):
    e = I.table(spark, sf, "events").select((F.floor(micros("ts") / I.HOUR) * I.HOUR).alias("t"))
    n = e.groupBy("t").agg(F.count("*").alias("n"))
    return tables.newest(n.select(F.col("n").alias("t"), (-F.col("t")).alias("seq")), 10).select((-F.col("seq")).alias("t"), F.col("t").alias("n"))


@query("SELECT o_orderkey, n FROM (SELECT l_orderkey AS o_orderkey, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, l_orderkey) AS r FROM lineitem GROUP BY 1) WHERE r<=25")
def ranked_order(spark, sf):
    n = I.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return tables.newest(n.select(F.col("n").alias("t"), (-F.col("o_orderkey")).alias("seq")), 25).select((-F.col("seq")).alias("o_orderkey"), F.col("t").alias("n"))


