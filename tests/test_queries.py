"""Every query against DuckDB over the smallest tables."""

import datetime as dt
import math
import os

import duckdb
import pandas as pd
import pytest

from pricelattice.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{DATA}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(value):
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return ""
    if isinstance(value, (pd.Timestamp, dt.datetime)):
        return str(value.date()) if value == value.replace(hour=0, minute=0, second=0, microsecond=0) else str(value)[:26]
    if isinstance(value, bool) or not hasattr(value, "__float__"):
        return str(value)
    return f"{float(value):.5g}"


def rows(df: pd.DataFrame) -> list:
    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, db, name):
    ours, theirs = QUERIES[name](spark, DATA).toPandas(), db.execute(ORACLES[name]).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_clusters_label_every_product_once(spark):
    pdf = QUERIES["clusters"](spark, DATA).toPandas()
    assert pdf["product_id"].is_unique and len(pdf) == len(QUERIES["product_features"](spark, DATA).toPandas())
    mean = pdf.groupby("label")["volatility"].mean()
    assert mean.idxmin() == "stable" and mean.idxmax() == "volatile"


def test_forecasts_cover_the_horizon_with_ordered_bounds(spark):
    pdf = QUERIES["forecasts"](spark, DATA).toPandas()
    assert (pdf.groupby("product_id").size() == 7).all()
    assert (pdf["lower_bound"] <= pdf["predicted_price"]).all() and (pdf["predicted_price"] <= pdf["upper_bound"]).all() and (pdf["lower_bound"] >= 0).all()


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
