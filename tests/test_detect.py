"""Detectors on literal price series."""

from datetime import datetime, timedelta

import pytest

from pricelattice.operators import detect
from pricelattice.operators.reports import best_deals, category_index, heatmap

T0 = datetime(2024, 1, 1)


def history(spark, *series):
    rows = [(i, float(p), T0 + timedelta(days=d), d, d == len(s) - 1) for i, s in enumerate(series) for d, p in enumerate(s)]
    return spark.createDataFrame(rows, "product_id long, p double, ts timestamp_ntz, tie long, is_actual boolean").selectExpr(
        "product_id", "cast(p as decimal(12,2)) as price", "ts", "tie", "is_actual"
    )


def found(spark, detector, series, **kw):
    return detector(detect.recent_series(history(spark, series)), **kw).collect()


@pytest.mark.parametrize(
    ("series", "severity"),
    [((1000, 1010, 1020), None), ((1000, 1200), "medium"), ((1200, 900), "medium"), ((100,), None), ((1000, 1100), None), ((1000, 1301), "high"), ((1000, 1300), "medium"), ((0, 50), None)],
)
def test_spike(spark, series, severity):
    got = found(spark, detect.detect_spike, series)
    assert [r["severity"] for r in got] == ([severity] if severity else [])


@pytest.mark.parametrize(
    ("series", "peak"),
    [((1000, 1100, 1150, 950), 1150), ((1000, 1020, 1040, 1060), None), ((1000, 1200), None), ((1000, 1100, 1000, 999), 1100), ((1000, 1100, 1000, 1000), None), ((1000, 1200, 1200, 900), 1200)],
)
def test_manipulation(spark, series, peak):
    got = found(spark, detect.detect_manipulation, series)
    assert [r["peak"] for r in got] == ([peak] if peak else [])


def test_cyclic(spark):
    assert not found(spark, detect.detect_cyclic, (100,) * 5)
    assert not found(spark, detect.detect_cyclic, (1000,) * 10)
    got = found(spark, detect.detect_cyclic, (1000, 1200) * 6)
    assert len(got) == 1 and got[0]["severity"] == "low"


def test_full_detection_needs_three_rows_and_skips_known(spark):
    now = T0 + timedelta(days=9)
    assert not detect.full_detection(history(spark, (1000, 1500)), now).collect()
    new = detect.full_detection(history(spark, (1000, 1000, 1500)), now)
    assert [r["anomaly_type"] for r in new.collect()] == ["spike"]
    assert detect.new_anomalies(new, new).isEmpty()
    assert detect.new_anomalies(new, new.withColumn("resolved", detect.F.lit(True))).count() == 1
    late = new.withColumn("detected_at", detect.F.expr("detected_at - INTERVAL 25 HOURS"))
    assert detect.new_anomalies(new, late).count() == 1


def product(spark, *names):
    return spark.createDataFrame([(i, n, "c", True) for i, n in enumerate(names)], "product_id long, name string, category string, is_active boolean")


def test_best_deals_skips_products_with_a_price_of_zero(spark):
    h = history(spark, (0, 10), (20, 10))
    got = best_deals(h, product(spark, "a", "b"), T0 + timedelta(days=2)).collect()
    assert [(r["product_id"], r["discount_pct"], r["at_min"]) for r in got] == [(1, 33.3, True)]


def test_heatmap_compares_with_the_last_day_that_has_a_price(spark):
    h = history(spark, (100, 0, 110)).where("tie <> 1")
    got = heatmap(h, product(spark, "a"), T0 + timedelta(days=2), days=2).orderBy("date").collect()
    assert [r["change_pct"] for r in got] == [None, None, 10.0] and got[2]["indicator"] == "up2"


def test_category_index_keeps_categories_without_a_past(spark):
    got = category_index(history(spark, (100,)), product(spark, "a"), T0).collect()
    assert got[0]["product_count"] == 1 and got[0]["prev_mean"] is None and got[0]["mean_change_pct"] is None
