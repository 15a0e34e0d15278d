"""Change logs, upserts, alerts, sources and streams."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pricelattice.functions import labels, stats, text
from pricelattice.operators import ingest
from pricelattice.sources import files
from pricelattice.streaming import streams


def test_arrival_order_decides(spark):
    rows = [(1, 100, 0, datetime(2024, 1, 2)), (1, 100, 1, datetime(2024, 1, 3)), (1, 120, 2, datetime(2024, 1, 1))]
    got = ingest.change_log(spark.createDataFrame(rows, "product_id long, price long, arrival long, ts timestamp_ntz")).orderBy("arrival").collect()
    assert [(r["price"], r["is_actual"], r["old_price"]) for r in got] == [(100, False, None), (120, True, 100)]


def test_append_changes_equals_one_log(spark):
    rows = [(i % 3, (i * 7) % 4 * 10, i, datetime(2024, 1, 1) + timedelta(hours=i)) for i in range(60)]
    df = spark.createDataFrame(rows, "product_id long, price long, arrival long, ts timestamp_ntz")
    cols = ["product_id", "price", "ts", "is_actual"]
    whole = ingest.change_log(df).select(*cols)
    part = ingest.append_changes(ingest.change_log(df.where("arrival < 30")), df.where("arrival >= 30")).select(*cols)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, part.collect()))


def test_alert_fires_once_at_the_target(spark):
    h = spark.createDataFrame([(1, 10, datetime(2024, 1, 1), 0, True)], "product_id long, price int, ts timestamp_ntz, tie long, is_actual boolean")
    p = spark.createDataFrame([(1, "a")], "product_id long, name string")
    subs = spark.createDataFrame([(5, 1, 10, True), (6, 1, 9, True)], "user_id long, product_id long, target_price int, is_active boolean")
    fired = ingest.check_alerts(h, subs, p)
    assert [r["user_id"] for r in fired.collect()] == [5]
    assert ingest.check_alerts(h, ingest.after_alerts(subs, fired), p).isEmpty()


def test_seed_with_an_empty_field_raises(spark):
    old = spark.createDataFrame([], "slug string, name string, source_path string")
    rows = spark.createDataFrame([(0, "", "x", "y")], "arrival long, name string, slug string, source_path string")
    with pytest.raises(Exception, match="empty field"):
        ingest.seed_categories(old, rows).collect()


def test_student_p_matches_integration(spark):
    import numpy as np

    def by_hand(r, n):
        v = n - 2
        t = abs(r) * (v / (1 - r * r)) ** 0.5
        x = np.linspace(0, t, 400_001)
        f = (1 + x * x / v) ** (-(v + 1) / 2)
        from math import gamma, pi, sqrt

        return 1 - 2 * gamma((v + 1) / 2) / (sqrt(v * pi) * gamma(v / 2)) * np.trapezoid(f, x)

    cases = [(0.3, 10), (0.3, 11), (-0.9, 5), (0.05, 30), (0.5, 3), (0.5, 4)]
    df = spark.createDataFrame(cases, "r double, n long")
    for row in df.select("r", "n", stats.student_p(F.col("r"), F.col("n")).alias("p")).collect():
        assert abs(row["p"] - by_hand(row["r"], row["n"])) < 1e-6
    edge = spark.createDataFrame([(1.0, 9), (None, 9)], "r double, n long").select(stats.student_p(F.col("r"), F.col("n")).alias("p")).collect()
    assert [r["p"] for r in edge] == [0.0, None]


def test_labels(spark):
    df = spark.createDataFrame([(0.71,), (-0.5,), (0.2,), (float("nan"),), (None,)], "r double")
    assert [r[0] for r in df.select(labels.corr_verdict(F.col("r"))).collect()] == ["strong direct", "moderate inverse", "none", "none", "none"]


def test_blocked_pages(spark):
    df = spark.createDataFrame([("403 Forbidden", ""), ("Shop", "x HTTP 403 y"), ("Shop", "fine"), (None, None)], "t string, h string")
    assert [r[0] for r in df.select(text.blocked_page(F.col("t"), F.col("h"))).collect()] == [True, True, False, False]


def test_rates_from_an_xml_file(spark, tmp_path):
    body = '<?xml version="1.0" encoding="windows-1251"?><ValCurs><Valute><CharCode>USD</CharCode><Nominal>1</Nominal><Value>90,5</Value></Valute><Valute><CharCode>CNY</CharCode><Nominal>10</Nominal><Value></Value></Valute></ValCurs>'
    (tmp_path / "r.xml").write_bytes(body.encode("cp1251"))
    got = {r["currency"]: float(r["rate"]) for r in files.read_rates_xml(spark, str(tmp_path / "r.xml"), date(2024, 1, 1)).collect()}
    assert got == {"USD": 90.5, "CNY": 0.0}


def test_categories_from_json(spark, tmp_path):
    (tmp_path / "c.json").write_text('[{"name": "A", "slug": "a", "source_path": "x"}, {"name": "B", "slug": "b", "source_path": "y"}]')
    assert [r["slug"] for r in files.read_categories_json(spark, str(tmp_path / "c.json")).orderBy("arrival").collect()] == ["a", "b"]


def test_change_log_stream_keeps_state_between_batches(spark, tmp_path):
    src = tmp_path / "in"
    schema = "product_id long, price long, arrival long"
    spark.createDataFrame([(1, 10, 0), (1, 10, 1)], schema).coalesce(1).write.parquet(str(src))
    read = lambda: spark.readStream.schema(schema).parquet(str(src))
    streams.drained(streams.stream_change_log(read()), str(tmp_path / "s"))
    spark.createDataFrame([(1, 10, 2), (1, 30, 3)], schema).coalesce(1).write.mode("append").parquet(str(src))
    got = streams.drained(streams.stream_change_log(read()), str(tmp_path / "s")).orderBy("arrival").collect()
    assert [(r["price"], r["arrival"]) for r in got] == [(10, 0), (30, 3)]


