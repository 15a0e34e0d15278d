"""Rollups by day, reports from them, and medians by selection."""

from datetime import datetime, timedelta
from pathlib import Path
from statistics import median

import numpy as np
from pyspark.sql import functions as F

from pricelattice.functions.series import exact_medians
from pricelattice.operators import detect, reports, rollup, sensitivity
from pricelattice.plans import snapshot
from pricelattice.sources import views

DATA = "/root/testdata/sf0.001"
T0 = datetime(2024, 1, 1)


def history(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(int(rng.integers(5)), round(float(rng.random() * 50), 2), T0 + timedelta(minutes=int(rng.integers(60 * 24 * 10))), i) for i in range(n)]
    return spark.createDataFrame(rows, "product_id long, price double, ts timestamp_ntz, tie long").withColumn("price", F.col("price").cast("decimal(12,2)"))


def table_rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def test_appends_merge_into_the_days_that_they_touch(spark, tmp_path):
    h = history(spark)
    state = rollup.RollupTable(spark, str(tmp_path / "r"))
    state.create(h.where("tie < 250"))
    before = {str(f): f.stat().st_mtime_ns for f in Path(state.path).rglob("part-*")}
    more = h.where("tie >= 250 and ts >= '2024-01-08'")
    touched = state.append(more)
    assert [d.isoformat() for d in touched] == ["2024-01-08", "2024-01-09", "2024-01-10"]
    kept = [f for f in before if not any(d.isoformat() in f for d in touched)]
    assert kept and all(Path(f).stat().st_mtime_ns == before[f] for f in kept)
    state.append(h.where("tie >= 250 and ts < '2024-01-08'"))
    assert table_rows(state.read()) == table_rows(rollup.daily_rollup(h))
    assert state.append(h.limit(0)) == []
    halves = rollup.daily_rollup(h.where("tie % 2 = 0")).unionByName(rollup.daily_rollup(h.where("tie % 2 = 1")))
    assert table_rows(rollup.merged(halves)) == table_rows(rollup.daily_rollup(h))


def test_windows_that_begin_within_a_day(spark, tmp_path):
    h = history(spark, seed=2)
    state = rollup.RollupTable(spark, str(tmp_path / "r"))
    state.create(h)
    cuts = (T0 + timedelta(days=3, hours=7), T0 + timedelta(days=6, hours=13, minutes=1))
    kept = state.windows(h, cuts)
    assert table_rows(kept) == table_rows(rollup.daily_rollup(h, cuts))
    got = {r["product_id"]: r for r in rollup.product_figures(kept, wide=1, near=2).collect()}
    for name, cut in (("wide", cuts[0]), ("near", cuts[1])):
        want = h.where(F.col("ts") >= F.lit(cut).cast("timestamp_ntz")).groupBy("product_id").agg(F.count("*").alias("n"), F.sum("price").alias("s"), F.min("price").alias("lo"), F.max("ts").alias("last"))
        for r in want.collect():
            g = got[r["product_id"]]
            assert (g[f"{name}_n"], g[f"{name}_total"], g[f"{name}_lowest"], g[f"{name}_last"]) == (r["n"], r["s"], r["lo"], r["last"])


def events_scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("events.parquet")


def test_dashboard_from_a_kept_rollup_and_from_the_history(spark, tmp_path):
    t = views.events_view(spark, DATA)
    found = detect.full_detection(t.history, t.now).withColumn("detected_at", F.col("ts"))
    state = rollup.RollupTable(spark, str(tmp_path / "r"))
    late = F.lit(t.now - timedelta(days=2)).cast("timestamp_ntz")
    state.create(t.history.where(F.col("ts") < late))
    state.append(t.history.where(F.col("ts") >= late))
    a, b = snapshot.full_dashboard(t, found), snapshot.full_dashboard(t, found, state)
    assert a.first() == b.first()
    options = {"period_days": 3, "metrics_days": 5, "deals_days": 11, "heatmap_days": 2, "deals_limit": 3, "heatmap_max_products": 4, "sensitivity_limit": 6}
    row = snapshot.dashboard_summary(t, found, state, **options).first()
    assert row["records_in_window"] == reports.ingest_metrics(t.history, t.product, t.category, t.now, 5).first()["total_records"]
    assert row["deals_listed"] == reports.best_deals(t.history, t.product, t.now, 11, 3).count() and row["index_rows"] == reports.category_index(t.history, t.product, t.now, 3, t.category).count()
    assert row["heat_products"] == reports.heatmap(t.history, t.product, t.now, 2, 4).select("product_id").distinct().count()
    assert row["sensitivity_rows"] == sensitivity.fx_sensitivity(t.history, t.product, t.rates, limit=6).count()
    assert events_scans(snapshot.dashboard_summary(t, found)) <= 3  # rates and detection; the rollup has been read already


def test_board_sections_equal_the_reports(spark):
    t = views.events_view(spark, DATA)
    b = snapshot.Board.of(t, snapshot.DEFAULTS | {"metrics_days": 4})
    assert table_rows(b.metrics()) == table_rows(reports.ingest_metrics(t.history, t.product, t.category, t.now, 4))
    assert table_rows(b.index(7)) == table_rows(reports.category_index(t.history, t.product, t.now, 7, t.category))
    assert table_rows(b.deals(50)) == table_rows(reports.best_deals(t.history, t.product, t.now, 30, 50))
    assert table_rows(b.heat(7, 30)) == table_rows(reports.heatmap(t.history, t.product, t.now))
    assert table_rows(b.sensitivity(30)) == table_rows(sensitivity.fx_sensitivity(t.history, t.product, t.rates, limit=30))


def test_sensitivity_reads_the_history_once(spark):
    t = views.events_view(spark, DATA)
    assert events_scans(sensitivity.fx_sensitivity(t.history, t.product, t.rates)) == 2  # prices and rates


def test_medians_equal_those_of_sorted_groups(spark):
    rng = np.random.default_rng(3)
    rows = [("hot", int(v)) for v in rng.integers(-(10**7), 10**7, 3000)] + [("hot", 5)] * 2000 + [("two", -3), ("two", 8), ("one", 1 << 40), ("none", None), (None, 4)]
    df = spark.createDataFrame(rows, "k string, v long").repartition(7)
    groups = {}
    for k, v in rows:
        groups.setdefault(k, []).extend([v] if v is not None else [])
    for bits in (1, 4, 20):
        got = {r["k"]: (r["n"], int(r["sum"]), r["median"]) for r in exact_medians(df, ["k"], "v", bits).collect()}
        assert got == {k: (len(v), sum(v), float(median(v))) for k, v in groups.items() if v and k is not None}
    assert exact_medians(df.limit(0), ["k"], "v").isEmpty()


def test_index_of_one_hot_category(spark):
    rng = np.random.default_rng(4)
    prices = [round(float(x), 2) for x in rng.random(4001) * 900]
    rows = [(i, p, T0 + timedelta(days=20), 0) for i, p in enumerate(prices)] + [(0, 3.0, T0 + timedelta(days=10), 1), (1, 4.5, T0 + timedelta(days=10), 1)]
    h = spark.createDataFrame(rows, "product_id long, price double, ts timestamp_ntz, tie long").withColumn("price", F.col("price").cast("decimal(12,2)"))
    p = h.select("product_id", F.lit("a").alias("category")).distinct()
    got = reports.category_index(h, p, T0 + timedelta(days=20)).first()
    assert got["median_price"] == round(median(prices), 4) and got["product_count"] == 4001 and got["prev_median"] == 3.75 and got["prev_mean"] == 3.75
