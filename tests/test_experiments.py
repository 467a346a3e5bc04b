import json

import numpy as np
import pytest

from tsweave import cli, experiments
from tsweave.errors import DataQualityError


def put(path, text):
    path.write_text(text)
    return str(path)


@pytest.fixture
def feeds_csv(tmp_path):
    t = lambda i, ms=0: f"2024-01-01 00:{i:02d}:00.{ms:03d}"
    a = "timestamp,symbol,bid,ask\n" + "".join(f"{t(i)},EURUSD,{1.1 + 0.0001 * i:.4f},{1.1002 + 0.0001 * i:.4f}\n" for i in range(5))
    b = "timestamp,symbol,bid,ask\n" + "".join(f"{t(i, 20)},EUR,{x},{y}\n" for i, (x, y) in enumerate([(1.1006, 1.1008)] * 3 + [(1.0998, 1.1006)] * 2))
    return put(tmp_path / "a.csv", a), put(tmp_path / "b.csv", b)


def test_compare_feeds(spark, feeds_csv, tmp_path):
    spec = {"symbol": "EURUSD", "currency_base": "EUR", "currency_profit": "USD", "digits": 5, "point": 1e-5, "trade_mode": 4, "contract_size": 1e5, "volume_min": 0.01, "volume_max": 100, "volume_step": 0.01, "tick_size": 1e-5, "tick_value": 1.0, "margin_initial": 0.0}
    ca, cb = put(tmp_path / "ca.json", json.dumps(spec)), put(tmp_path / "cb.json", json.dumps(spec | {"symbol": "EUR"}))
    path = cli.main(["--reports", str(tmp_path / "r"), "compare-feeds", *feeds_csv, "--symbol-a", "EURUSD", "--symbol-b", "EUR", "--canonical", "EURUSD", "--cost", "0.0001", "--latency-ms", "50", "--contract-a", ca, "--contract-b", cb])
    r = json.load(open(path))["results"]
    assert (r["summary"]["aligned"], r["summary"]["mean_delay_ms"], r["summary"]["episodes"]) == (5, 20.0, 1)
    assert r["opportunities"][0]["duration_ms"] == 120_000 and abs(r["opportunities"][0]["max_net_edge"] - 0.0003) < 1e-9
    assert r["contracts"]["status"] == "compatible" and r["summary"]["classification"] == "crossable_after_cost_contract_validated_research_capital_unverified"
    assert r["latency"]["capturable"] == 1 and len(r["latency"]["sweep"]) == 12


def test_discover_and_research(spark, tmp_path):
    rng = np.random.default_rng(7)
    e, g = np.linspace(1.1, 1.2, 80) + rng.normal(0, 1e-3, 80), np.linspace(1.3, 1.4, 80) + rng.normal(0, 1e-3, 80)
    x = e / g + rng.normal(0, 1e-4, 80)
    rows = "".join(f"2024-01-{1 + i // 24:02d} {i % 24:02d}:00:00,{a},{b},{c}\n" for i, (a, b, c) in enumerate(zip(e, g, x, strict=True)))
    p = put(tmp_path / "p.csv", "timestamp,EURUSD,GBPUSD,EURGBP\n" + rows)
    r = experiments.discover(spark, p, least_symbols=3)["results"]
    assert r["window"]["rows"] == 80 and len(r["window"]["symbols"]) == 3
    c = next(c for c in r["candidates"] if c["name"] == "EURGBP")
    assert c["observations"] == 80 and c["adf_p"] < 0.05 and c["mae"] < 1e-3
    assert experiments.research(spark, p, target="EURGBP", text="EURUSD/GBPUSD")["results"]["correlation"]["n"] == 80


def test_signal_experiments(spark, tmp_path):
    p = put(tmp_path / "s.csv", "timestamp,signal,other,gross_edge,cost\n" + "".join(f"2024-01-01 {i // 60:02d}:{i % 60:02d}:00,{int(i % 3 == 0)},{i % 5},{0.001 + i % 4 / 10000},0.0001\n" for i in range(90)))
    assert experiments.run_backtest(spark, p)["results"]["metrics"]["observations"] == 30
    assert len(experiments.run_ensemble(spark, p, weights={"signal": 1.0, "other": 0.1}, threshold=0.5)["results"]["stages"]) == 3
    assert experiments.run_walk_forward(spark, p, thresholds=(0.0, 0.5), train=30, validation=10, test=10)["results"]["folds"]
    assert len(experiments.run_robustness(spark, p, simulations=20)["results"]["scenarios"]) == 5


def test_collect(spark, tmp_path):
    good = spark.createDataFrame([("2024-01-01 00:00:00", "b", "s", 1.0, 1.1)] * 2, "timestamp string, broker string, symbol string, bid double, ask double")
    assert experiments.collect_feed(good, str(tmp_path / "d"), "p")["quality"]["duplicates"] == 1
    with pytest.raises(DataQualityError):
        experiments.collect_feed(good.selectExpr("timestamp", "broker", "symbol", "-bid bid", "ask"), str(tmp_path / "d"), "p")


def test_stored_catalogs(spark, tmp_path):
    path = tmp_path / "catalog.csv"
    path.write_text("position,name,description,visible,trade_mode\n0,GOLD,Gold spot,true,4\n1,EURUSD.m,Euro,false,4\n2,OLD,Gold old,true,0\n")
    p = str(path)
    names = lambda r: [x["name"] for x in r["results"]["symbols"]]
    assert names(experiments.search_symbols(spark, p)) == ["GOLD", "EURUSD.m"]
    assert names(experiments.search_symbols(spark, p, everything=True, visible_only=True)) == ["GOLD", "OLD"]
    assert names(experiments.search_symbols(spark, p, search="gold")) == ["GOLD"]
    found = experiments.resolve_symbols(spark, p, names=("XAUUSD", "EURJPY"))["results"]["resolved"]
    assert found == {"XAUUSD": {"symbol": "GOLD", "reason": "alias"}, "EURJPY": {"symbol": None, "reason": None}}


def test_collecting_drains_and_names_every_failure(spark, tmp_path):
    from tsweave.errors import CollectionError
    from tsweave.sources import tables

    ticks = tmp_path / "t.csv"
    ticks.write_text("timestamp,broker,symbol,bid,ask\n2024-01-01 00:00:00,x,E,1,2\n2024-01-01 00:00:01,x,E,1,2\n2024-01-01 00:00:00,x,BAD,-1,2\n")
    folder = str(tmp_path / "out")
    ok = ("one", "E", str(ticks))
    assert [m["rows"] for m in experiments.collect_all(spark, [ok], folder)] == [2]
    with pytest.raises(CollectionError, match="two/BAD.*three/E: .* after 2 attempts"):
        experiments.collect_all(spark, [("two", "BAD", str(ticks)), ("three", "E", str(tmp_path / "none.csv")), ("four", "E", str(ticks))], folder, retries=1, wait_s=0)
    assert tables.read_dataset(spark, folder).where("broker_profile = 'four'").count() == 2
