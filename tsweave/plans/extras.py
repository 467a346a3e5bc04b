"""Queries over the smaller operators: look-ups, semi joins, labels, periods, identities and summaries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import formula
from ..functions.columns import micros, safe_corr
from ..operators import asof, backtest, coverage, crossfeed, discovery, feeds, multiplicity, stats, symbols
from ..sources import tables
from ..streaming import streams
from ..sources.scratch import scratch
from . import inputs as I  # noqa: E741
from .inputs import query, rounded, with_
from .research import BETA, _family, _signals


@query(with_("wide", ", d AS (SELECT t, f, o*p/nullif(f,0) AS s, f-o*p/nullif(f,0) AS d FROM wide), z AS (SELECT *, CASE WHEN count(d) OVER w=20 THEN (d-avg(d) OVER w)/nullif(stddev_pop(d) OVER w,0) END AS z FROM d WINDOW w AS (ORDER BY t ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) SELECT count(*) AS observations, round(avg(d),3) AS mean, round(stddev_pop(d),3) AS deviation, round(max(abs(d)),3) AS max_abs, round(covar_pop(f,s)/nullif(stddev_pop(f)*stddev_pop(s),0),6) AS correlation, round(arg_max(z,t),6) AS latest_z FROM z"))
def historical_summary(spark, sf):
    w = I.wide(spark, sf).withColumn("s", formula.to_column(formula.parse("o*p/f"))).withColumn("d", F.col("f") - F.col("s")).withColumn("k", F.lit(1))
    w = w.withColumn("z", stats.zscore(F.col("d"), ["k"], ["t"], 20))
    own = w.agg(F.count("*").alias("observations"), F.avg("d").alias("mean"), F.stddev_pop("d").alias("deviation"), F.max(F.abs("d")).alias("max_abs"), safe_corr(F.col("f"), F.col("s")).alias("correlation"), F.max_by("z", F.when(F.col("z").isNotNull(), F.col("t"))).alias("latest_z"))
    return rounded(own.withColumns({c: F.round(c, 3) for c in ("mean", "deviation", "max_abs")}))


@query("SELECT p_partkey AS name, adjusted_p, rejected FROM part LEFT JOIN (SELECT p_partkey AS k, p_size/100.0 AS adjusted_p, p_size<=5 AS rejected FROM part WHERE p_partkey%3=0) ON k=p_partkey")
def candidate_verdicts(spark, sf):
    p = I.table(spark, sf, "part")
    tested = p.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("label"), (F.col("p_size") / 100.0).alias("adjusted_p"), (F.col("p_size") <= 5).alias("rejected"))
    return tables.candidates_with_verdicts(p.select(F.col("p_partkey").alias("name")), tested)


@query(with_("series", "SELECT (SELECT count(*) FROM (SELECT t FROM series WHERE symbol='F' EXCEPT SELECT t FROM series WHERE symbol='P')) AS only_left, (SELECT count(*) FROM (SELECT t FROM series WHERE symbol='P' EXCEPT SELECT t FROM series WHERE symbol='F')) AS only_right"))
def grid_mismatch(spark, sf):
    s = I.series(spark, sf)
    a, b = (s.where(F.col("symbol") == x).select("t") for x in ("F", "P"))
    return backtest.grid_differences(a, b)


@query(with_("panel", "SELECT * FROM panel WHERE t IN (SELECT t FROM panel WHERE symbol='error')"))
def semi_join_times(spark, sf):
    p = I.panel(spark, sf)
    return coverage.at_times(p, p.where("symbol = 'error'")).select("t", "symbol", "close")


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) WHERE k=1")
def first_of_each(spark, sf):
    made = I.table(spark, sf, "events").select(F.struct("user_id", "event_type").alias("execution_t"), micros("ts").alias("fold"), F.col("event_id").alias("decision_t"))
    return backtest.once_each(made).select("execution_t.*", F.col("decision_t").alias("event_id"))


@query(with_("a", "SELECT round(greatest((max(t)-min(t))/3600000000.0, 1/3600.0),6) AS hours, min(t) AS first_t, max(t) AS last_t FROM a"))
def period(spark, sf):
    return rounded(I.feed(spark, sf, "click").agg(crossfeed.period_hours().alias("hours"), F.min("t").alias("first_t"), F.max("t").alias("last_t")))


@query(with_("z", "SELECT t, symbol, round(lead(abs(z)) OVER (PARTITION BY symbol ORDER BY t),6) AS next_abs_zscore FROM z"))
def next_label(spark, sf):
    s = I.series(spark, sf)
    z = s.select("t", "symbol", stats.zscore(F.col("close"), ["symbol"], ["t"], 20).alias("z"))
    return rounded(z.select("t", "symbol", F.lead(F.abs("z")).over(Window.partitionBy("symbol").orderBy("t")).alias("next_abs_zscore")))


@query(with_("series", "SELECT t, symbol, lag(close) OVER w AS previous, round(close-lag(close) OVER w,4) AS change FROM series WINDOW w AS (PARTITION BY symbol ORDER BY t)"))
def lag_pairs(spark, sf):
    back, change = stats.lag_pairs("close", ["symbol"], ["t"])
    return I.series(spark, sf).select("t", "symbol", back.alias("previous"), F.round(change, 4).alias("change"))


@query(with_("family", "SELECT position, row_number() OVER (PARTITION BY family ORDER BY p_value, position) AS rank FROM family"))
def p_value_rank(spark, sf):
    return rounded(multiplicity.adjust(_family(spark, sf), "bonferroni", by=("family",)).select("position", "rank"))


@query("SELECT c_custkey, regexp_replace(c_name,'[^A-Za-z0-9._-]','_','g') AS name FROM customer")
def safe_names(spark, sf):
    return I.table(spark, sf, "customer").select("c_custkey", symbols.safe_name(F.col("c_name")).alias("name"))


@query("SELECT r_regionkey, sha256(r_name || chr(10)) AS sha256, CAST(length(r_name) + 1 AS BIGINT) AS bytes FROM region")
def fingerprints(spark, sf):
    """A file for each region, with its name as the only line."""
    folder = scratch(spark, "regions")
    I.table(spark, sf, "region").select("r_regionkey", "r_name").repartition("r_regionkey").write.partitionBy("r_regionkey").text(folder)
    key = F.regexp_extract("path", "r_regionkey=([0-9]+)", 1).cast(I.table(spark, sf, "region").schema["r_regionkey"].dataType)
    return rounded(tables.fingerprints(spark, [f"{folder}/*/*.txt"]).select(key.alias("r_regionkey"), "sha256", "bytes"))


@query("SELECT l_returnflag AS symbol, count(*) AS rows FROM lineitem GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM lineitem")
def batch_totals(spark, sf):
    return feeds.batch_totals(I.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("symbol")))


@query("SELECT * FROM (VALUES ('EURGBP',['EURUSD','GBPUSD']),('EURJPY',['EURUSD','USDJPY']),('GBPJPY',['GBPUSD','USDJPY']),('XAUEUR',['EURUSD','XAUUSD']),('GOLD_SILVER_RATIO',['XAGUSD','XAUUSD'])) v(name,d)".replace("SELECT *", "SELECT name, array_to_string(d, ',') AS symbols"))
def catalog_symbols(spark, sf):
    return discovery.catalog(spark).select("name", F.array_join("deps", ",").alias("symbols"))


@query(with_("lead1", "SELECT count(*) FILTER (signal<>0) AS signals, count(*) FILTER (signal<>0 AND execution_t IS NULL) AS on_last_bar FROM lead1"))
def unsettled_signals(spark, sf):
    s = _signals(spark, sf)
    return s.agg(F.count_if(F.col("signal") != 0).alias("signals")).crossJoin(backtest.unsettled(s).agg(F.count("*").alias("on_last_bar")))


@query(BETA + "SELECT count(*) AS rows, count(beta) AS windows, count(*)-count(beta) AS warm_up FROM bt")
def beta_warm_up(spark, sf):
    b = stats.rolling_beta(I.wide(spark, sf).withColumn("k", F.lit(1)), "f", "o", 20, ["k"], ["t"])
    return b.agg(F.count("*").alias("rows"), F.count("beta").alias("windows"), (F.count("*") - F.count("beta")).alias("warm_up"))


@query("""WITH l AS (SELECT event_type AS s, epoch_us(ts) AS t, event_id AS seq FROM events WHERE event_id%2=0), r AS (SELECT event_type AS s, epoch_us(ts) AS t, event_id AS seq FROM events WHERE event_id%2=1) SELECT l.s AS symbol, count(*) AS matched, sum(l.t-r.t)::BIGINT AS total_delay_us FROM l ASOF JOIN r ON l.s=r.s AND l.t>=r.t WHERE l.t-r.t<=1800000000 GROUP BY l.s""")
def asof_by_symbol(spark, sf):
    e = I.table(spark, sf, "events").select(F.col("event_type").alias("symbol"), micros("ts").alias("t"), F.col("event_id").alias("seq"))
    joined = asof.asof_join(e.where("seq % 2 = 0"), e.where("seq % 2 = 1"), tolerance_us=30 * I.MINUTE, direction="backward", by=("symbol",))
    return joined.groupBy("symbol").agg(F.count("*").alias("matched"), F.sum(F.col("t") - F.col("match.t")).alias("total_delay_us"))


@query("SELECT event_type AS symbol, (epoch_us(ts)//3600000000)*3600000000 AS t, round(arg_min(value,ts),6) AS open, round(max(value),6) AS high, round(min(value),6) AS low, round(arg_max(value,ts),6) AS close, count(*) AS ticks FROM events GROUP BY ALL")
def bars_of_ticks(spark, sf):
    e = I.table(spark, sf, "events").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"))
    return rounded(streams.bars(e, "1 hour", "0 seconds").select("symbol", micros("ts").alias("t"), "open", "high", "low", "close", "ticks"))
