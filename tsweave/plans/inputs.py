"""The driver's tables in the roles of feeds, panels, series and bars, as frames and as SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import micros

QUERIES: dict = {}
SQL: dict[str, str] = {}
HOUR, DAY, MINUTE = 3_600_000_000, 86_400_000_000, 60_000_000
TOLERANCE = 10 * MINUTE
STATUSES = ["F", "O", "P"]

#: CTEs by name; with_() puts those that a query needs before it.
CTES = {
    "a": "SELECT epoch_us(ts) AS t, event_id AS seq, value*0.999 AS bid, value*1.001 AS ask FROM events WHERE event_type='click' AND value>0",
    "b": "SELECT epoch_us(ts) AS t, event_id AS seq, value*0.999 AS bid, value*1.001 AS ask FROM events WHERE event_type='view' AND value>0",
    "c": "SELECT epoch_us(ts) AS t, event_id AS seq, value AS v FROM events WHERE event_type='purchase' AND value>0",
    "panel": "SELECT (epoch_us(ts)//3600000000)*3600000000 AS t, event_type AS symbol, round(avg(value),6) AS close FROM events WHERE value>0 GROUP BY ALL",
    "series": "SELECT (epoch_us(o_orderdate)//86400000000)*86400000000 AS t, o_orderstatus AS symbol, round(avg(o_totalprice),4) AS close FROM orders GROUP BY ALL",
    "wide": "SELECT * FROM (SELECT t, max(CASE WHEN symbol='F' THEN close END) AS f, max(CASE WHEN symbol='O' THEN close END) AS o, max(CASE WHEN symbol='P' THEN close END) AS p FROM series GROUP BY t) WHERE f IS NOT NULL AND o IS NOT NULL AND p IS NOT NULL",
    "nearest": """SELECT x.t, x.seq, x.bid, x.ask, CASE WHEN f.t IS NULL OR x.t-k.t<=f.t-x.t THEN k.t ELSE f.t END AS b_t, CASE WHEN f.t IS NULL OR x.t-k.t<=f.t-x.t THEN k.bid ELSE f.bid END AS b_bid, CASE WHEN f.t IS NULL OR x.t-k.t<=f.t-x.t THEN k.ask ELSE f.ask END AS b_ask FROM a x ASOF LEFT JOIN b k ON x.t>=k.t ASOF LEFT JOIN b f ON x.t<=f.t""",
    "aligned": "SELECT *, (b_t-t)/1000.0 AS delay_ms FROM nearest WHERE abs(b_t-t)<=600000000",
    "edges": "SELECT *, b_bid-ask AS a_to_b, bid-b_ask AS b_to_a, greatest(b_bid-ask, bid-b_ask) AS gross_edge, greatest(b_bid-ask, bid-b_ask)-20.0 AS net_edge, CASE WHEN b_bid-ask>=bid-b_ask THEN 'buy_a_sell_b' ELSE 'buy_b_sell_a' END AS direction FROM aligned",
    "runs": "SELECT *, sum(n) OVER (ORDER BY t, seq) AS episode FROM (SELECT *, CASE WHEN lag(t) OVER (ORDER BY t, seq) IS NULL OR t-lag(t) OVER (ORDER BY t, seq)>1800000000 THEN 1 ELSE 0 END AS n FROM edges WHERE net_edge>0)",
    "episodes": "SELECT episode, min(t) AS start_us, max(t) AS end_us, (max(t)-min(t))/1000.0 AS duration_ms, count(*) AS observations, max(gross_edge) AS max_gross_edge, max(net_edge) AS max_net_edge, avg(net_edge) AS mean_net_edge, first(direction ORDER BY net_edge DESC, t, seq) AS direction, (first(t ORDER BY net_edge DESC, t, seq)-min(t))/1000.0 AS peak_offset_ms FROM runs GROUP BY episode",
    "z": "SELECT t, symbol, close, CASE WHEN count(close) OVER w=20 THEN (close-avg(close) OVER w)/nullif(stddev_pop(close) OVER w,0) END AS z FROM series WINDOW w AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)",
    "signals": "SELECT t, CASE WHEN z<-0.5 THEN 1.0 ELSE 0.0 END AS signal, coalesce(z,0.0) AS zscore, close/nullif(lag(close) OVER (ORDER BY t),0)-1 AS gross_edge, 0.001 AS cost FROM z WHERE symbol='F'",
    "lead1": "SELECT t AS decision_t, signal, zscore, lead(t) OVER (ORDER BY t) AS execution_t, lead(gross_edge) OVER (ORDER BY t) AS gross_edge, lead(cost) OVER (ORDER BY t) AS cost FROM signals",
    "trades": "SELECT decision_t, execution_t, gross_edge, cost, gross_edge-cost AS net_edge FROM lead1 WHERE signal<>0 AND execution_t IS NOT NULL AND gross_edge IS NOT NULL",
    "equity": "SELECT *, greatest(0.0, max(equity) OVER (ORDER BY execution_t)) AS peak FROM (SELECT *, sum(net_edge) OVER (ORDER BY execution_t) AS equity FROM trades)",
    "family": "SELECT p_partkey AS position, p_name AS label, ((p_partkey*37)%997+1)/99700.0 AS p_value, p_mfgr_group AS family FROM (SELECT *, p_partkey%5 AS p_mfgr_group FROM part)",
}
#: The CTEs that each needs before it.
NEEDS = {"wide": ["series"], "nearest": ["a", "b"], "aligned": ["nearest"], "edges": ["aligned"], "runs": ["edges"], "episodes": ["runs"], "z": ["series"], "signals": ["z"], "lead1": ["signals"], "trades": ["lead1"], "equity": ["trades"]}


def with_(names: str, body: str) -> str:
    """body after the CTEs it names and all that those need."""
    order: list[str] = []

    def need(n: str) -> None:
        for m in NEEDS.get(n, ()):
            need(m)
        if n not in order:
            order.append(n)

    for n in names.split():
        need(n)
    return "WITH " + ", ".join(f"{n} AS ({CTES[n]})" for n in order) + " " + body


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def feed(spark: SparkSession, sf: str, event: str) -> DataFrame:
    """Ticks of a feed: t, seq, symbol, bid, ask."""
    e = table(spark, sf, "events").where((F.col("event_type") == event) & (F.col("value") > 0))
    return e.select(micros("ts").alias("t"), F.col("event_id").alias("seq"), F.lit("X").alias("symbol"), (F.col("value") * 0.999).alias("bid"), (F.col("value") * 1.001).alias("ask"))


def feeds(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return feed(spark, sf, "click"), feed(spark, sf, "view")


def panel(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly means by type of event: t, symbol, close."""
    e = table(spark, sf, "events").where("value > 0").select((F.floor(micros("ts") / HOUR) * HOUR).alias("t"), F.col("event_type").alias("symbol"), "value")
    return e.groupBy("t", "symbol").agg(F.round(F.avg("value"), 6).alias("close"))


def series(spark: SparkSession, sf: str) -> DataFrame:
    """Daily means of orders by status: t, symbol, close."""
    o = table(spark, sf, "orders").select((F.floor(micros("o_orderdate") / DAY) * DAY).alias("t"), F.col("o_orderstatus").alias("symbol"), "o_totalprice")
    return o.groupBy("t", "symbol").agg(F.round(F.avg("o_totalprice"), 4).alias("close"))


def wide(spark: SparkSession, sf: str) -> DataFrame:
    """The days on which every status has orders: t, f, o, p."""
    from ..operators.coverage import pivoted

    return pivoted(series(spark, sf), STATUSES).dropna().select("t", F.col("F").alias("f"), F.col("O").alias("o"), F.col("P").alias("p"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded and whole numbers as bigint, for comparison across engines."""
    out = []
    for f in df.schema:
        kind = f.dataType.simpleString()
        c = F.col(f"`{f.name}`")
        out.append(F.round(c, digits).alias(f.name) if kind == "double" else c.cast("long").alias(f.name) if kind in ("int", "smallint") or kind.startswith("decimal") else c)
    return df.select(*out)


def r6(*columns: str) -> str:
    """SQL: columns rounded to six places under their own names."""
    return ", ".join(f"round({c},6) AS {c}" for c in columns)
