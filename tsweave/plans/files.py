"""Queries over sources and sinks: each writes rows of the driver's tables as files of a kind and reads them by the library."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import formula
from ..functions.columns import micros
from ..operators import coverage
from ..sources import tables
from ..sources.scratch import scratch
from ..streaming import streams
from . import inputs as I  # noqa: E741
from .inputs import query, rounded, with_
from .research import _signals


def _stamp(t="t"):
    return F.timestamp_micros(t).cast("string")


def _csv(df, spark, name: str) -> str:
    path = scratch(spark, name)
    df.write.option("header", True).csv(path)
    return path


@query("SELECT lpad(CAST(c_custkey AS VARCHAR),9,'0') AS code, c_mktsegment AS segment FROM customer")
def csv_text(spark, sf):
    c = I.table(spark, sf, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("code"), F.col("c_mktsegment").alias("segment"))
    return tables.read_text_csv(spark, _csv(c, spark, "codes"))


@query(with_("series", "SELECT t, symbol, close FROM series"))
def panel_file(spark, sf):
    s = I.series(spark, sf).select(_stamp().alias("timestamp"), "symbol", "close")
    return rounded(tables.load_panel(spark, _csv(s, spark, "panel")))


@query(with_("series", "SELECT t, symbol, close FROM series"))
def wide_panel_file(spark, sf):
    w = coverage.pivoted(I.series(spark, sf), I.STATUSES)
    path = f"{scratch(spark, 'panel')}.parquet"
    w.select(_stamp().alias("timestamp"), *I.STATUSES).write.parquet(path)
    return rounded(tables.load_panel(spark, path))


@query("SELECT epoch_us(ts) AS t, 'X' AS symbol, event_type AS broker_symbol, round(value*0.999,6) AS bid FROM events WHERE event_type='click'")
def feed_file(spark, sf):
    e = I.table(spark, sf, "events").select(F.col("ts").cast("timestamp").cast("string").alias("timestamp"), F.col("event_type").alias("symbol"), (F.col("value") * 0.999).alias("bid"))
    return rounded(tables.load_feed(spark, _csv(e, spark, "feed"), "click", "X").select("t", "symbol", "broker_symbol", "bid"))


@query(with_("signals", "SELECT t, signal, round(gross_edge,6) AS gross_edge, cost FROM signals"))
def experiment_file(spark, sf):
    s = _signals(spark, sf).select(_stamp().alias("timestamp"), "signal", "gross_edge", "cost")
    return rounded(tables.load_experiment(spark, _csv(s, spark, "experiment"), ("signal", "gross_edge", "cost")))


@query("SELECT round(l_quantity/7,6) AS round_trip_ms, l_returnflag AS symbol, CAST(NULL AS VARCHAR) AS broker FROM lineitem WHERE l_linenumber=1 AND l_returnflag IN ('A','R')")
def latency_file(spark, sf):
    """A JSON log that wraps its list in samples, with two logs of other names beside it that give the same column."""
    rows = I.table(spark, sf, "lineitem").where("l_linenumber = 1").select((F.col("l_quantity").cast("double") / 7).alias("latency_ms"), F.col("l_returnflag").alias("symbol"))
    path = f"{scratch(spark, 'latency')}.json"
    rows.groupBy("symbol").agg(F.collect_list(F.struct("latency_ms", "symbol")).alias("samples")).select("samples").repartition(3).write.json(path)
    found = [tables.load_latency(spark, path, symbol=x) for x in ("a", "R")]
    return rounded(found[0].union(found[1]))


@query("SELECT n_name AS symbol, CAST(n_nationkey AS INTEGER) AS digits, n_nationkey*1000.0::DOUBLE AS contract_size FROM nation WHERE n_nationkey=7")
def contract_file(spark, sf):
    n = I.table(spark, sf, "nation").select(F.col("n_name").alias("symbol"), F.col("n_nationkey").alias("digits"), (F.col("n_nationkey") * 1000.0).alias("contract_size"))
    path = f"{scratch(spark, 'contracts')}.json"
    n.agg(F.to_json(F.collect_list(F.struct(*n.columns))).alias("value")).write.text(path)  # one list, as such files have
    name = I.table(spark, sf, "nation").where("n_nationkey = 7").first().n_name
    found = tables.load_contract(spark, path, name.lower())
    return spark.createDataFrame([(found.symbol, found.digits, found.contract_size)], "symbol string, digits int, contract_size double")


@query(with_("series", "SELECT symbol, count(*) AS rows, min(t) AS first_t, round(sum(close),2) AS total FROM series GROUP BY symbol"))
def dataset_files(spark, sf):
    folder = scratch(spark, "dataset")
    kept = tables.write_dataset(I.series(spark, sf), folder, broker_profile="a b", data_type="bars", timeframe="D1")
    tables.write_dataset(I.series(spark, sf).limit(1), folder, broker_profile="other", data_type="bars", timeframe="D1")
    rows = tables.read_dataset(spark, folder, kept["dataset_id"])
    return rounded(rows.groupBy(F.col("symbol").cast("string").alias("symbol")).agg(F.count("*").alias("rows"), F.min("t").alias("first_t"), F.round(F.sum("close"), 2).alias("total")))


def _reports(spark, sf) -> str:
    """A report for each region, whose records are its nations."""
    folder = scratch(spark, "reports")
    rows = I.table(spark, sf, "region").join(I.table(spark, sf, "nation"), F.col("r_regionkey") == F.col("n_regionkey")).select("r_name", "n_name", "n_nationkey").collect()
    for name in sorted({r.r_name for r in rows}):
        made = tables.experiment_manifest("even" if len(name) % 2 == 0 else "odd", {"region": name}, [])
        records = [{"name": r.n_name, "size": float(r.n_nationkey) if r.n_nationkey % 3 else None} for r in rows if r.r_name == name]
        tables.write_report({"manifest": made, "results": {"region": name, "nations": records}}, folder)
    return folder


@query("SELECT CASE WHEN length(r_name)%2=0 THEN 'even' ELSE 'odd' END AS experiment_type, count(DISTINCT r_name) AS reports FROM region JOIN nation ON r_regionkey=n_regionkey GROUP BY 1")
def report_list(spark, sf):
    found = tables.list_reports(spark, _reports(spark, sf))
    return found.groupBy("experiment_type").agg(F.count_distinct("experiment_id").alias("reports"))


@query("SELECT n_name AS name, CASE WHEN n_nationkey%3<>0 THEN n_nationkey::DOUBLE END AS size FROM nation JOIN region ON r_regionkey=n_regionkey")
def report_records(spark, sf):
    return tables.report_rows(spark, f"{_reports(spark, sf)}/EXP-*.json", "nations", "name string, size double")


@query("SELECT * FROM (VALUES ('b*a/c','a'),('EURUSD/GBPUSD','EURUSD'),('z+y','y'),('\"b c\"-d','b c')) v(formula, target)")
def formula_target(spark, sf):
    texts = ["b*a/c", "EURUSD/GBPUSD", "z+y", '"b c"-d']
    return spark.createDataFrame([(x, formula.default_target(formula.parse(x))) for x in texts], "formula string, target string")


@query(with_("series", ", b AS (SELECT t, dense_rank() OVER (ORDER BY t) AS b FROM (SELECT DISTINCT t FROM series)), f AS (SELECT t FROM series GROUP BY t HAVING count(DISTINCT symbol)=3), g AS (SELECT b - row_number() OVER (ORDER BY b) AS g FROM b JOIN f USING (t)) SELECT max(n) AS rows FROM (SELECT count(*) AS n FROM g GROUP BY g)"))
def usable_window(spark, sf):
    window = coverage.require_usable(coverage.shared_window(I.series(spark, sf), 3), 1)
    return spark.createDataFrame([(window["rows"],)], "rows long")


@query("SELECT event_type AS symbol, (epoch_us(ts)//86400000000)*86400000000 AS t, round(arg_min(value,ts),6) AS open, round(max(value),6) AS high, round(min(value),6) AS low, round(arg_max(value,ts),6) AS close, count(*) AS ticks FROM events GROUP BY ALL")
def stream_bars(spark, sf):
    """The bars of a stream that reads the events as files and ends when it has read them."""
    source, out = scratch(spark, "ticks"), scratch(spark, "bars")
    e = I.table(spark, sf, "events").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"))
    e.repartition(4).write.parquet(source)
    made = streams.bars(spark.readStream.schema(spark.read.parquet(source).schema).parquet(source), "1 day", "0 seconds")

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(out)  # the whole result of the run

    q = made.writeStream.outputMode("complete").option("checkpointLocation", scratch(spark, "stream")).foreachBatch(keep).trigger(availableNow=True).start()
    q.awaitTermination()
    return rounded(spark.read.parquet(out).select("symbol", micros("ts").alias("t"), "open", "high", "low", "close", "ticks"))
