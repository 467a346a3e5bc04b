import random

import pandas as pd
import pytest

from tsweave.operators import asof, contracts, costs, crossfeed, feeds

MIN = 60_000_000


def ticks(spark, rows):
    return spark.createDataFrame([(t, i, "X", float(b), float(a)) for i, (t, b, a) in enumerate(rows)], "t long, seq long, symbol string, bid double, ask double")


def pair(spark):
    a = [(i * MIN, 1.1 + 0.0001 * i, 1.1002 + 0.0001 * i) for i in range(5)]
    b = [(i * MIN + 20_000, 1.1006, 1.1008) for i in range(3)] + [(i * MIN + 20_000, 1.0998, 1.1006) for i in (3, 4)]
    return ticks(spark, a), ticks(spark, b)


def test_two_feeds_make_one_episode(spark):
    a, b = pair(spark)
    edges = crossfeed.directional_edges(crossfeed.align(a, b, 100_000), 0.0001)
    rows = edges.collect()
    assert len(rows) == 5 and all(r.delay_ms == 20.0 for r in rows) and sum(r.net_edge > 1e-12 for r in rows) == 3
    e = crossfeed.episodes(edges.where("net_edge > 1e-12"), 150 * MIN).collect()
    assert len(e) == 1 and e[0].direction == "buy_a_sell_b" and e[0].duration_ms == 120_000 and abs(e[0].max_net_edge - 0.0003) < 1e-9


def test_bars_are_never_an_opportunity(spark):
    bars = lambda v: spark.createDataFrame([(i * MIN, i, "X", float(c)) for i, c in enumerate(v)], "t long, seq long, symbol string, close double")
    r = crossfeed.bar_summary(bars([100, 101, 102]), bars([90, 91, 92]), MIN // 10).first()
    assert (r.aligned, r.max_abs_difference, r.opportunities, r.classification) == (3, 10.0, 0, "theoretical_bar_price_comparison")


def test_mutual_nearest_is_one_to_one(spark):
    a = ticks(spark, [(0, 1, 2), (10_000, 1, 2)])
    b = ticks(spark, [(10_000, 1, 2), (20_000, 1, 2)])
    assert [(r.t, r.match.t) for r in asof.mutual_nearest(a, b, tolerance_us=100_000, by=("symbol",)).collect()] == [(10_000, 10_000)]


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
def test_asof_against_pandas(spark, direction):
    rng = random.Random(3)
    left = [(rng.randrange(400), rng.choice("pq"), i) for i in range(150)]
    right = [(rng.randrange(400), rng.choice("pq"), i) for i in range(120)]
    frame = lambda rows: spark.createDataFrame(rows, "t long, k string, seq long").repartition(5)
    got = {(r.k, r.t, r.seq): (r.match.t, r.match.seq) for r in asof.asof_join(frame(left), frame(right), tolerance_us=5, direction=direction, by=("k",)).collect()}
    lp, rp = (pd.DataFrame(x, columns=["t", "k", "seq"]).sort_values(["t", "seq"]) for x in (left, right))
    want = pd.merge_asof(lp, rp.assign(rt=rp.t, rseq=rp.seq)[["t", "k", "rt", "rseq"]], on="t", by="k", tolerance=5, direction=direction).dropna()
    assert got == {(r.k, r.t, r.seq): (r.rt, r.rseq) for r in want.itertuples()}


def test_episode_gap_is_strict(spark):
    rows = [(0, 1.0), (10_000_000, 1.0)]
    edges = spark.createDataFrame([(t, i, "X", e, e, "d") for i, (t, e) in enumerate(rows)], "t long, seq long, symbol string, gross_edge double, net_edge double, direction string")
    assert crossfeed.episodes(edges, 1_000_000).count() == 2
    one = crossfeed.episodes(edges, 10_000_000).collect()
    assert len(one) == 1 and one[0].duration_ms == 10_000


def test_labels():
    assert crossfeed.classification() == "crossable_research_contract_unverified"
    assert crossfeed.classification("incompatible", survives=False) == "blocked_by_contract_specification_not_capturable_within_latency"
    assert crossfeed.classification("compatible", executable=True, capital_verified=False, survives=False, legs_agree=False).endswith("research_capital_unverified_not_capturable_within_latency_contract_legs_disagree")


def test_quality_counts_what_is_wrong(spark):
    rows = [("2024-01-01 00:00:00", "b", "s", "1.1", "1.2"), ("2024-01-01 00:00:00", "b", "s", "1.3", "1.2"), ("x", "b", "s", None, "oops"), ("2024-01-01 00:00:02", "b", "s", "-1", "NaN")]
    r = feeds.tick_quality(spark.createDataFrame(rows, "timestamp string, broker string, symbol string, bid string, ask string")).first()
    assert (r.rows, r.invalid_timestamps, r.bid_not_positive, r.crossed, r.missing_prices, r.duplicates) == (4, 1, 1, 1, 1, 1)
    assert r.unreadable_prices == 2


@pytest.mark.parametrize(("peak_at", "want"), [(0.0, 0.45), (900.0, 0.549382)])
def test_captured_edge(spark, peak_at, want):
    e = spark.createDataFrame([(1000.0, 1.0, peak_at)], "duration_ms double, peak_edge double, peak_offset_ms double")
    assert abs(costs.latency_capture(e, 50.0).first().captured_edge - want) < 1e-6


def test_funding_counts_triple_nights(spark):
    rows = spark.createDataFrame([("2024-01-03", "2024-01-05", 1000.0), ("2024-01-03", "2024-01-03", 1000.0), ("2024-01-01", "2024-01-15", None)], "s string, e string, notional double")
    rows = rows.selectExpr("cast(s as date) start", "cast(e as date) end", "notional")
    assert [(r.nights, r.charged_nights, round(r.funding_cost, 6)) for r in costs.funding(rows, 0.001).collect()] == [(2, 4, 4.0), (0, 0, 0.0), (14, 0, 0.0)]


def test_unknown_margin_is_null_not_zero(spark):
    rows = spark.createDataFrame([(1.0, 2.0, 3.0, 0.0)], "volume double, price double, contract_size double, margin_initial double")
    r = costs.margin(rows, None).first()
    assert r.margin is None and r.margin_source == "unavailable"
    assert costs.margin(rows, 2.0).first().margin == 3.0
    assert contracts.COMPATIBLE == "compatible"
