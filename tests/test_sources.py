import json

import pytest

from tsweave.errors import ConfigurationError, DataQualityError
from tsweave.sources import tables as T
from tsweave.streaming import streams


def put(path, text):
    path.write_text(text)
    return str(path)


def test_panels_wide_and_long(spark, tmp_path):
    wide = put(tmp_path / "w.csv", "timestamp,000300,EURUSD\n2024-01-01 00:00:00,1.5,2\n2024-01-01 01:00:00,,3\n")
    long = put(tmp_path / "l.csv", "timestamp,symbol,close\n2024-01-01 00:00:00,000300,1.5\n2024-01-01 00:00:00,EURUSD,2\n2024-01-01 01:00:00,EURUSD,3\n")
    a, b = (sorted(map(tuple, T.load_panel(spark, p).collect())) for p in (wide, long))
    assert a == b and a[0][1:] == ("000300", 1.5) and len(a) == 3


@pytest.mark.parametrize("rows", ["2024-01-01,1\n2024-01-01,2\n", "x,1\n", "2024-01-01,abc\n", "2024-01-01,0\n", "2024-01-01,-1\n", ""])
def test_bad_panels_are_refused(spark, tmp_path, rows):
    with pytest.raises(DataQualityError):
        T.load_panel(spark, put(tmp_path / "p.csv", "timestamp,A\n" + rows))


def test_latency_logs(spark, tmp_path):
    csv = put(tmp_path / "l.csv", "latency_ms,symbol\n10,a\n-1,a\n20,b\n")
    js = put(tmp_path / "l.json", json.dumps({"samples": [{"round_trip": 5, "broker": "x"}, {"round_trip": 7, "broker": "y"}]}))
    assert sorted(r.round_trip_ms for r in T.load_latency(spark, csv).collect()) == [10, 20]
    assert [r.round_trip_ms for r in T.load_latency(spark, js, broker="Y").collect()] == [7]


def test_contracts(spark, tmp_path):
    p = put(tmp_path / "c.json", json.dumps([{"symbol": "EURUSD", "digits": 5}, {"symbol": "GBPUSD"}]))
    assert T.load_contract(spark, p, "eurusd").digits == 5
    for s in (None, "x"):
        with pytest.raises(ConfigurationError):
            T.load_contract(spark, p, s)


def test_dataset_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "EUR/USD", 1.0), (2, "XAU", 2.0)], "t long, symbol string, bid double")
    m = T.write_dataset(rows, str(tmp_path / "d"), broker_profile="a b", data_type="ticks")
    assert m["rows"] == 2
    back = T.read_dataset(spark, str(tmp_path / "d"), m["dataset_id"])
    assert {(r.t, r.symbol, r.broker_profile) for r in back.collect()} == {(1, "EUR_USD", "a_b"), (2, "XAU", "a_b")}


def test_reports(spark, tmp_path):
    f = str(tmp_path)
    for kind in ("compare", "discover"):
        T.write_report({"manifest": T.experiment_manifest(kind, {"a": 1}, []), "results": {"candidates": [{"name": "x", "p": 0.5}, {"name": "y", "p": None}]}}, f)
    (tmp_path / "EXP-broken.json").write_text("{")
    listed = T.list_reports(spark, f, "discover").collect()
    assert len(listed) == 1 and T.list_reports(spark, f).count() == 2
    assert [(r.name, r.p) for r in T.report_rows(spark, listed[0].path, "candidates", "name: string, p: double").collect()] == [("x", 0.5), ("y", None)]
    shas = T.fingerprints(spark, [listed[0].path]).first()
    assert shas.sha256 == T.local_sha256(listed[0].path.removeprefix("file://"))


def test_experiments_and_feeds(spark, tmp_path):
    p = put(tmp_path / "e.csv", "timestamp,signal\n2024-01-01,1\n2024-01-02,0\n")
    assert T.load_experiment(spark, p, ("signal",)).count() == 2
    with pytest.raises(DataQualityError):
        T.load_experiment(spark, p, ("cost",))
    q = put(tmp_path / "f.csv", "timestamp,symbol,bid,ask\n2024-01-01,E,1,2\n2024-01-01,G,1,2\n")
    r = T.load_feed(spark, q, "E", "EURUSD").collect()
    assert [(x.symbol, x.broker_symbol, x.bid) for x in r] == [("EURUSD", "E", 1.0)]


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id*10) ts, 'X' symbol, 1.0 + id net_edge, 1.0 + id price from range(6)").coalesce(1).write.parquet(src)
    schema = spark.read.parquet(src).schema
    for name, made in (("bars", streams.bars(spark.readStream.schema(schema).parquet(src), "30 seconds", "0 seconds")), ("episodes", streams.session_episodes(spark.readStream.schema(schema).parquet(src), "15 seconds", "0 seconds"))):
        q = made.writeStream.format("memory").queryName(f"s_{name}").outputMode("complete").start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("s_bars").count() == 2 and spark.table("s_episodes").first().observations == 6


def test_stream_matches_and_scores(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id*10) ts, id*10 t, 'X' symbol, 1.0D + id bid, 2.0D + id ask, cast(id % 3 as double) value from range(8)").coalesce(1).write.parquet(src)
    schema = spark.read.parquet(src).schema
    read = lambda: spark.readStream.schema(schema).parquet(src)
    q = streams.tolerance_matches(read(), read(), "10 seconds", "1 minute").writeStream.format("memory").queryName("s_pairs").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("s_pairs").count() == 8 + 2 * 7
    q = streams.rolling_zscores(read().select("symbol", "t", "value"), 3).writeStream.format("memory").queryName("s_z").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    z = [r.zscore for r in spark.table("s_z").orderBy("t").collect()]
    assert z[:2] == [None, None] and abs(z[2] - 1.224744871391589) < 1e-12
