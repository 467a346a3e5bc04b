"""Every query with SQL, against DuckDB on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from tsweave import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
QUERIES, SQL = plans.queries(), plans.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(df):
    df = df[sorted(df.columns)].copy()
    for c in df:
        text = df[c].dtype == object or str(df[c].dtype).startswith(("str", "bool"))
        df[c] = df[c].map(lambda x: None if pd.isna(x) else str(x)) if text else df[c].astype("float64").round(5) + 0.0
    return df.sort_values(list(df.columns), kind="stable").reset_index(drop=True)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_against_duckdb(spark, duck, name):
    got, want = canonical(QUERIES[name](spark, SF).toPandas()), canonical(duck.execute(SQL[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for c in got:
        if got[c].dtype == "float64":
            assert ((got[c] - want[c]).abs().fillna(0) <= 2e-5 * (1 + want[c].abs().fillna(0))).all() and (got[c].isna() == want[c].isna()).all(), c
        else:
            assert (got[c].fillna("") == want[c].fillna("")).all(), c


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL])
def test_runs(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.01").count() > 0


def test_prepared_feed_keeps_ticks_of_equal_times(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT event_id+k*1000000 AS event_id, * EXCLUDE event_id FROM '{SF}/events.parquet', range(3) r(k)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got, want = canonical(QUERIES["prepared_feed"](spark, str(tmp_path)).toPandas()), canonical(con.execute(SQL["prepared_feed"]).df())
    assert len(want) > want["t"].nunique() and len(got) == len(want) and ((got - want).abs() <= 2e-5).all(axis=None)
