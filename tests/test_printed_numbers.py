"""Numbers whose short decimal ends in a 5, printed as their doubles round: by Python, by DuckDB and by hand."""

from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F
from test_whole_jobs import both

from pricelattice.functions.formats import fixed

T0 = datetime(2024, 1, 1)
#: Prices before and after, and the change as printed: doubles above, below and at a tie.
STEPS = [(20.0, 10.51, "47.5%"), (20.0, 14.17, "29.1%"), (100.0, 112.25, "12.2%")]


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """A product for each step, which comes twice: on the second day, and 19.85 days later, 0.15 days after the price before."""
    d = str(tmp_path_factory.mktemp("printed"))
    con = duckdb.connect()
    con.execute("CREATE TABLE customer (c_custkey BIGINT, c_name VARCHAR, c_nationkey INTEGER, c_acctbal DOUBLE, c_mktsegment VARCHAR)")
    con.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    con.executemany("INSERT INTO customer VALUES (?, ?, 0, 9.0, 'BUILDING')", [(u, f"Customer {u}") for u in range(len(STEPS))])
    rows = [(u, T0 + timedelta(days=day, minutes=u), price) for u, (a, b, _) in enumerate(STEPS) for day, price in zip((0, 1, 20.7, 20.85), (a, b, a, b))]
    con.executemany("INSERT INTO events VALUES (?, ?, ?, 'view', ?, NULL)", [(n, ts, u, price) for n, (u, ts, price) in enumerate(rows)])
    for t in ("customer", "events"):
        con.execute(f"COPY {t} TO '{d}/{t}.parquet' (FORMAT PARQUET)")
    return d, con


@pytest.mark.parametrize("digits", [0, 1, 3])
def test_fixed_prints_as_python_does(spark, digits):
    numbers = [sign * k * 5 / 10**places for sign in (1, -1) for places in (1, 2, 3, 4) for k in range(1, 2000, 2)] + [0.0, 47.449999999999996, 1e-300, 9999999999.945, 999999999999.0625, 4503599627370496.0]
    got = spark.createDataFrame([(x,) for x in numbers], "x double").select("x", fixed(F.col("x"), digits).alias("text")).collect()
    assert [(r["x"], r["text"]) for r in got] == [(x, f"{x:.{digits}f}") for x in numbers]


def test_report_text_prints_ties_as_sql_does(spark, tables):
    got = [r[0] for r in both(spark, tables, "report_text")]
    assert {line.split("  Description: change ")[1] for line in got if "Product" in line} == {text for *_, text in STEPS}


def test_spike_messages_print_ties_as_sql_does(spark, tables):
    """The change, the one like it before and the days between (0.15, which is a little less)."""
    got = dict(both(spark, tables, "spike_messages"))
    for u, (a, b, text) in enumerate(STEPS):
        assert got[u] == (
            f"Sharp {'rise' if b > a else 'fall'} of {text} in 0.1 days: {a:.0f} (21.01.2024) -> {b:.0f} (21.01.2024)"
            f". A change of {text} like it came on 02.01.2024 (19 days before)"
        )
