"""Queries that judge all products and categories of their tables, active or not, over rows made for it: by DuckDB and by hand."""

from datetime import datetime, timedelta

import duckdb
import pytest

from pricelattice.registry import ORACLES, QUERIES

T0 = datetime(2024, 1, 1)
KINDS = ["BUILDING", "MACHINERY", None]


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """Twelve customers, four of each kind and one without: every third owes, the fifth's balance is NULL. Numbers 0 to 8 and the unknown 99 have prices of 20 days."""
    d = str(tmp_path_factory.mktemp("whole"))
    con = duckdb.connect()
    con.execute("CREATE TABLE customer (c_custkey BIGINT, c_name VARCHAR, c_nationkey INTEGER, c_acctbal DOUBLE, c_mktsegment VARCHAR)")
    con.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    con.executemany("INSERT INTO customer VALUES (?, ?, 0, ?, ?)", [(i, f"Customer {i}", None if i == 5 else -9.0 if i % 3 == 2 else 9.0, KINDS[i // 4]) for i in range(12)])
    events = [(u, day) for u in [*range(9), 99] for day in range(20)]
    rows = [(n, T0 + timedelta(days=day, minutes=u), u, ("view", "purchase")[u % 2], float(100 + u + day * (u + 1) * 7 % 13)) for n, (u, day) in enumerate(events)]
    con.executemany("INSERT INTO events VALUES (?, ?, ?, ?, ?, NULL)", rows)
    for t in ("customer", "events"):
        con.execute(f"COPY {t} TO '{d}/{t}.parquet' (FORMAT PARQUET)")
    return d, con


def both(spark, tables, name):
    """The query's rows, after a look at whether SQL has the same."""
    d, con = tables
    ours, theirs = QUERIES[name](spark, d), con.execute(ORACLES[name])
    columns = [c[0] for c in theirs.description]
    got = sorted((tuple(r) for r in ours.select(*columns).collect()), key=str)
    assert got == sorted(theirs.fetchall(), key=str)
    return got


def test_category_index_has_every_category(spark, tables):
    got = {r[0]: r[1] for r in both(spark, tables, "category_index")}
    assert got == {"BUILDING": 4, "MACHINERY": 4, None: 1}


def test_products_without_data_has_every_product(spark, tables):
    assert set(both(spark, tables, "products_without_data")) == {(9, None), (10, None), (11, None)}


def test_fx_sensitivity_p_has_every_product_with_prices(spark, tables):
    got = dict(both(spark, tables, "fx_sensitivity_p"))
    assert set(got) == {*range(9), 99} and all(p is not None for p in got.values())
