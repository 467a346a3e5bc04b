"""Streaming counterparts of batch operators: an extension, as what they go by has no streams.

They differ from the batch operators where noted: state must end, so watermarks bound lateness.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tolerance_matches(a: DataFrame, b: DataFrame, tolerance: str, lateness: str) -> DataFrame:
    """All pairs of two tick streams (ts, symbol, bid, ask) within the tolerance; nearest() takes the best of them."""
    x = a.select(F.col("ts"), "symbol", "bid", "ask").withWatermark("ts", lateness)
    y = b.select(F.col("ts").alias("b_ts"), F.col("symbol").alias("b_symbol"), F.col("bid").alias("b_bid"), F.col("ask").alias("b_ask")).withWatermark("b_ts", lateness)
    gap = F.expr(f"interval {tolerance}")
    return x.join(y, (F.col("symbol") == F.col("b_symbol")) & (F.col("b_ts") >= F.col("ts") - gap) & (F.col("b_ts") <= F.col("ts") + gap)).drop("b_symbol")


def session_episodes(edges: DataFrame, gap: str, lateness: str) -> DataFrame:
    """Episodes of crossable rows (ts, symbol, net_edge) by session windows. A silence of exactly `gap` ends an episode here."""
    good = edges.where("net_edge > 0").withWatermark("ts", lateness)
    own = good.groupBy("symbol", F.session_window("ts", gap)).agg(F.count("*").alias("observations"), F.min("ts").alias("start"), F.max("ts").alias("end"), F.max("net_edge").alias("max_net_edge"))
    return own.drop("session_window")


def bars(ticks: DataFrame, width: str, lateness: str) -> DataFrame:
    """Bars of a tick stream (ts, symbol, price) by tumbling windows."""
    own = ticks.withWatermark("ts", lateness).groupBy("symbol", F.window("ts", width))
    return own.agg(F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.count("*").alias("ticks")).select("symbol", F.col("window.start").alias("ts"), "open", "high", "low", "close", "ticks")


def rolling_zscores(rows: DataFrame, window: int) -> DataFrame:
    """Rolling z-scores of a stream (symbol, t, value) in order of arrival, by a ring of the last values as state."""
    schema = "symbol string, t long, value double, zscore double"

    def update(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        ring = list(state.get[0]) if state.exists else []
        for pdf in batches:
            out = []
            for t, v in pdf.sort_values("t")[["t", "value"]].itertuples(index=False):
                ring = [*ring, v][-window:]
                s = pd.Series(ring)
                full = len(ring) == window and s.std(ddof=0) > 0
                out.append((key[0], t, v, (v - s.mean()) / s.std(ddof=0) if full else None))
            yield pd.DataFrame(out, columns=["symbol", "t", "value", "zscore"])
        state.update((ring,))

    return rows.groupBy("symbol").applyInPandasWithState(update, schema, "ring array<double>", "append", "NoTimeout")
