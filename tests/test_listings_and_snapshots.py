"""Search through the index, pages by key, snapshots of kinds, clusters, times as text."""

import json
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricelattice.functions import text
from pricelattice.functions.formats import iso_text, iso_time
from pricelattice.operators import api, detect, features, search
from pricelattice.plans import snapshot
from pricelattice.plans.commands import Reports
from pricelattice.sources import views

DATA = "/root/testdata/sf0.001"


def test_the_index_loses_nothing(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, "".join(rng.choice(list("abcÄ #1"), int(rng.integers(0, 12)))), "".join(rng.choice(list("ab1"), int(rng.integers(0, 5))))) for i in range(400)] + [(900, None, None), (901, "abcabcabc", None)]
    p = spark.createDataFrame(rows, "product_id long, name string, vendor_code string")
    search.write_index(search.trigrams(p, "name", "vendor_code"), str(tmp_path / "i"))
    index = search.read_index(spark, str(tmp_path / "i"))
    looked = 0
    for q in ("abc", "ABC ab1", "äb", "a", "", "bca, cab", "zzz", "b #", "ccc aaa"):
        want = sorted(r["product_id"] for r in p.where(text.matches_search(q, F.col("name"), F.col("vendor_code"))).collect())
        near = search.among(p, index, q)
        assert sorted(r["product_id"] for r in near.where(text.matches_search(q, F.col("name"), F.col("vendor_code"))).collect()) == want
        if any(len(t) >= 3 for t in text.search_terms(q)):
            looked += near.count()
    assert looked < 400  # of five searches over 402 products
    plan = search.candidates(index, "abc")._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "gram,abc" in plan.split("PushedFilters: [")[1].split("]")[0]


@pytest.mark.parametrize("order", [("name", "product_id"), ("-parsed", "product_id"), ("parsed", "-product_id")])
def test_pages_by_key_are_those_by_offset(spark, order):
    rng = np.random.default_rng(2)
    rows = [(i, "abcde"[int(rng.integers(5))] if rng.random() < 0.9 else None, int(rng.integers(6)) if rng.random() < 0.7 else None) for i in range(57)]
    df = spark.createDataFrame(rows, "product_id long, name string, parsed int")
    whole, after, page = [], None, 1
    while True:
        got = api.seek(df, order, after, 10)
        ids = [r["product_id"] for r in got.collect()]
        assert ids == [r["product_id"] for r in api.paged(df.orderBy(*[api.by(o) for o in order]), page, 10).collect()]
        if not ids:
            break
        whole, after, page = whole + ids, api.last_key(got, order), page + 1
    assert sorted(whole) == list(range(57)) and api.last_key(df.limit(0), order) is None


def test_a_late_page_reads_no_more_than_the_first(spark, tmp_path):
    df = spark.range(20_000).select(F.col("id").alias("product_id"), F.format_string("n%06d", "id").alias("name"))
    df.orderBy("name").write.option("maxRecordsPerFile", 500).parquet(str(tmp_path / "p"))
    kept = spark.read.parquet(str(tmp_path / "p"))
    page = api.seek(kept, ("name", "product_id"), ("n019000", 19_000))
    assert [r["product_id"] for r in page.collect()] == list(range(19_001, 19_021))
    assert "GreaterThanOrEqual(name,n019000)" in page._jdf.queryExecution().executedPlan().toString()
    read = kept.where("name >= 'n019000'").observe("seen", F.count(F.lit(1)).alias("n"))
    assert read.count() == 1000


def test_listings_leave_out_what_is_not_active(spark):
    h = spark.createDataFrame([(i, 5, datetime(2024, 1, 1), 0) for i in range(4)], "product_id long, price int, ts timestamp_ntz, tie long")
    p = spark.createDataFrame([(0, "a", True, "2024-01-01"), (1, "b", False, None), (2, "c", True, None), (3, "d", True, "2024-01-03")], "product_id long, name string, is_active boolean, last_parsed_at string")
    p = p.withColumn("vendor_code", F.lit("v")).withColumn("category", F.lit("c"))
    assert [r["product_id"] for r in api.list_products(h, p).collect()] == [0, 2, 3]
    assert [r["product_id"] for r in api.in_default_order(p, "product", "product_id").collect()] == [1, 2, 3, 0]
    assert api.product_detail(h, p, 1).isEmpty() and api.product_detail(h, p, 2).first()["current_price"] == 5
    assert api.product_prices(h, p, 1).isEmpty() and api.product_prices(h, p, 0).count() == 1


def test_anomalies_come_in_the_order_asked_for(spark):
    df = spark.createDataFrame([(1, "spike", "high", datetime(2024, 1, 1)), (2, "spike", "low", datetime(2024, 1, 3)), (3, "spike", "medium", datetime(2024, 1, 2))], "product_id long, anomaly_type string, severity string, detected_at timestamp_ntz")
    ids = lambda **k: [r["product_id"] for r in api.list_anomalies(df, **k).collect()]
    assert ids() == [2, 3, 1] and ids(order="detected_at") == [1, 3, 2] and ids(order="severity") == [1, 2, 3]
    with pytest.raises(ValueError):
        api.list_anomalies(df, order="product_id")


@pytest.fixture(scope="module")
def reports(spark):
    t = views.events_view(spark, DATA)
    return Reports(t, detect.full_detection(t.history, t.now).withColumn("detected_at", F.col("ts")))


def test_snapshots_of_kinds_hold_their_parameters(spark, reports, tmp_path):
    path, category = str(tmp_path / "s"), reports.tables.product.first()["category"]
    for kind in ("clusters", "index", "metrics", "deals", "anomalies"):
        reports.save_snapshot(path, kind, period=9, category=category if kind in ("deals", "clusters") else None, clusters=3, metrics_days=5, deals_days=20)
    rows = {r["kind"]: {c: json.loads(r[c]) for c in ("parameters", "summary", "payload")} for r in spark.read.parquet(path).collect()}
    assert rows["clusters"]["parameters"] == {"period": 9, "category": category, "clusters": 3} and rows["deals"]["parameters"] == {"period": 9, "category": category, "days": 20, "limit": 100}
    assert rows["metrics"]["parameters"] == {"period": 9, "days": 5} and rows["anomalies"]["parameters"] == {"period": 9, "days": 9} and rows["index"]["parameters"] == {"period": 9}
    labels = rows["clusters"]["payload"]
    assert rows["clusters"]["summary"] == {k: len(v) for k, v in labels.items()} and all(set(x) == {"product_id", "name", "mean_price", "volatility", "trend"} for v in labels.values() for x in v)
    assert rows["index"]["summary"] == {"rows": len(rows["index"]["payload"]["data"])} and rows["index"]["summary"]["rows"] == reports.index(9).count()
    assert rows["deals"]["summary"] == {"count": len(rows["deals"]["payload"]["data"])} and {d["category"] for d in rows["deals"]["payload"]["data"]} <= {category}
    m = reports.metrics(5).first()
    assert rows["metrics"]["summary"] == {"total_records": m["total_records"], "unique_products": m["unique_products"]} and rows["metrics"]["payload"]["total_products"] == m["total_products"]
    a = rows["anomalies"]
    assert a["payload"]["days"] == 9 == a["summary"]["days"] and a["summary"]["total"] == sum(a["payload"]["by_type"].values()) == sum(a["payload"]["by_severity"].values())
    with pytest.raises(ValueError):
        snapshot.snapshot(reports.tables, reports.known, "heatmap", reports.tables.now)


def test_kept_and_printed_clusters_are_cut_where_each_is(spark, monkeypatch, reports):
    rows = [(i, f"n{i}", "c", 5, 10.0, 0.1 + i % 2 + i / 1e4, 0.0, 1.0) for i in range(60)]
    f = spark.createDataFrame(rows, "product_id long, name string, category string, n_records long, mean_price double, volatility double, trend double, max_change_pct double")
    for most in (7, 200):
        assert [(r["products"], len(r["items"])) for r in snapshot.clusters_payload(f, 2, most).collect()] == [(30, min(30, most))] * 2
    assert (snapshot.CLUSTER_ITEMS, snapshot.KIND_ITEMS, snapshot.PRINTED_ITEMS) == (200, 500, 15)
    monkeypatch.setattr(snapshot, "PRINTED_ITEMS", 2)
    lines = [r["value"] for r in reports.clusters_text(clusters=2).collect()]
    heads = [x for x in lines if x.startswith("---")]
    assert len(heads) == 2 and all(x.startswith("  ... and ") or " | volatility " in x or x in heads for x in lines) and sum(" | volatility " in x for x in lines) <= 4


def cost(x, centres):
    return ((x[:, None, :] - centres) ** 2).sum(axis=2).min(axis=1).sum()


def test_clusters_are_as_tight_as_those_of_many_starts(spark):
    t = views.lineitem_view(spark, DATA)
    pdf = features.cluster_products(features.product_features(t.history, t.product)).toPandas()
    x = pdf[["volatility", "trend", "max_change_pct"]].to_numpy()
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    rng, best = np.random.default_rng(0), np.inf
    for _ in range(60):
        c = z[rng.choice(len(z), 4, replace=False)]
        for _ in range(60):
            near = ((z[:, None, :] - c) ** 2).sum(axis=2).argmin(axis=1)
            c = np.array([z[near == k].mean(axis=0) if (near == k).any() else c[k] for k in range(4)])
        best = min(best, cost(z, c))
    ours = np.array([z[(pdf["label"] == k).to_numpy()].mean(axis=0) for k in pdf["label"].unique()])
    assert len(ours) <= 4 and (len(ours) < 4 or cost(z, ours) <= 1.05 * best)
    few = features.cluster_products(features.product_features(t.history, t.product).limit(3))
    assert {r["label"] for r in few.collect()} == {features.ALL}


def test_iso_times(spark):
    shown = ["2024-02-29T23:30:00.250000-03:30", "2024-01-01T00:00:00Z", "2024-01-01 05:00:00+0500", "2024-01-01T01:02:03", "2024-01-01", "nothing", None, ""]
    got = [r["t"] for r in spark.createDataFrame([(i, s) for i, s in enumerate(shown)], "i int, s string").orderBy("i").select(iso_time(F.col("s")).alias("t")).collect()]
    assert got == [datetime(2024, 3, 1, 3, 0, 0, 250000), datetime(2024, 1, 1), datetime(2024, 1, 1), datetime(2024, 1, 1, 1, 2, 3), datetime(2024, 1, 1), None, None, None]
    times = [datetime(2024, 1, 1), datetime(2024, 1, 1, 1, 2, 3, 40)]
    df = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz").select("t", iso_text(F.col("t")).alias("s"))
    assert [r["s"] for r in df.orderBy("t").collect()] == [t.isoformat() + "+00:00" for t in times]
    assert df.where(iso_time(F.col("s")) == F.col("t")).count() == 2


def test_slugs_by_default(spark):
    df = spark.createDataFrame([("x", "Name"), ("", "Two  Words!"), (None, "Ünï")], "s string, n string")
    assert [r[0] for r in df.select(text.default_slug(F.col("s"), F.col("n"))).collect()] == ["x", "two-words", "ünï"]
