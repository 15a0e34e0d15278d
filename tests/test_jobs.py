"""Scheduled jobs and the rates source."""

import json
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pricelattice.operators import ingest
from pricelattice.plans import jobs
from pricelattice.sources.live_rates import DailyRates


def test_ingest_job_works_on_changed_products_only(spark):
    t0 = datetime(2024, 1, 1)
    rows = [(p, 100, i, t0 + timedelta(days=i)) if i % 2 else (p, 101, i, t0 + timedelta(days=i)) for p in (1, 2) for i in range(9)]
    df = spark.createDataFrame(rows, "product_id long, price long, arrival long, ts timestamp_ntz")
    log = ingest.change_log(df).select("product_id", "price", "ts", "is_actual", "old_price")
    new = spark.createDataFrame([(1, 200, 20, t0 + timedelta(days=20)), (2, 101, 21, t0 + timedelta(days=20))], df.schema)
    product = spark.createDataFrame([(1, True), (2, True)], "product_id long, is_active boolean")
    got = jobs.ingest_job(log, new, product, None, t0 + timedelta(days=20))
    assert [r["product_id"] for r in got.changed.collect()] == [1]
    assert {(r["product_id"], r["anomaly_type"]) for r in got.anomalies.collect()} >= {(1, "spike")}
    assert {r["product_id"] for r in got.forecasts.collect()} == {1}
    assert got.log.where("is_actual").count() == 2


def test_rates_source_reads_a_day_a_partition_and_skips_gaps(spark, tmp_path):
    for day, value in (("2024-01-01", "90,5"), ("2024-01-03", "91")):
        (tmp_path / f"{day}.xml").write_text(f"<V><Valute><CharCode>USD</CharCode><Nominal>2</Nominal><Value>{value}</Value></Valute><Valute><CharCode>XXX</CharCode></Valute></V>")
    spark.dataSource.register(DailyRates)
    df = spark.read.format("daily_rates").option("url", f"file://{tmp_path}/{{day}}.xml").option("today", "2024-01-03").option("days", 3).load()
    assert sorted((r["currency"], r["date"], float(r["rate"])) for r in df.collect()) == [("USD", date(2024, 1, 1), 45.25), ("USD", date(2024, 1, 3), 45.5)]


def test_full_snapshot_holds_every_section(spark, tmp_path):
    from pricelattice.operators import detect
    from pricelattice.plans import snapshot
    from pricelattice.sources import sinks, views

    t = views.events_view(spark, "/root/testdata/sf0.001")
    found = detect.full_detection(t.history, t.now).withColumn("detected_at", F.col("ts"))
    path = str(tmp_path / "s")
    sinks.append_rows(snapshot.snapshot(t, found, "full", t.now), path)
    sinks.append_rows(snapshot.snapshot(t, found, "clusters", t.now), path)
    rows = {r["kind"]: r for r in spark.read.parquet(path).collect()}
    payload, summary = json.loads(rows["full"]["payload"]), json.loads(rows["full"]["summary"])
    assert set(payload) == {"generated_at", "metrics", "category_index", "deals_top", "clusters", "heatmap", "sensitivity", "anomalies_summary", "currency_rates_latest"}
    labels = {c["label"]: c["products"] for c in payload["clusters"]}
    assert summary["cluster_labels"] == labels and sum(labels.values()) == features_count(spark, t)
    assert all(len(c["items"]) == min(200, c["products"]) for c in payload["clusters"])
    assert summary["deals_listed"] == len(payload["deals_top"]) and summary["sensitivity_rows"] == len(payload["sensitivity"])
    assert payload["anomalies_summary"]["total"] == sum(payload["anomalies_summary"]["by_type"].values()) == summary["anomalies"]
    strength = [abs(r["correlation"]) for r in payload["sensitivity"] if "correlation" in r]
    assert strength == sorted(strength, reverse=True) and "common dates" in payload["sensitivity"][0]["detail"]
    assert len(payload["heatmap"]["dates"]) == 8 and len(json.loads(rows["clusters"]["payload"])) == len(labels)


def features_count(spark, t):
    from pricelattice.operators.features import product_features

    return product_features(t.history, t.product).count()


def test_report_of_nothing_is_one_line(spark):
    from pricelattice.operators import reports

    none = spark.createDataFrame([], "product_id long, name string, category string, anomaly_type string, severity string, detected_at timestamp_ntz, resolved boolean")
    assert [r["value"] for r in reports.report_text(none).collect()] == ["No anomalies in this period."]
    one = spark.createDataFrame([(1, "a", "c", "spike", "high", datetime(2024, 1, 1, 9, 5), True)], none.schema)
    lines = [r["value"] for r in reports.report_text(one, {"spike": "Sprung"}).collect()]
    assert lines[0] == "Anomaly report (1)" and lines[2].splitlines()[1] == "[HIGH] Sprung" and lines[-1] == "  Active: 0, resolved: 1" and len(lines) == 8


def test_one_product(spark):
    from pricelattice.operators.reports import one_product

    p = spark.createDataFrame([(1, "Red shoe", "red"), (2, "Blue shoe", "blue")], "product_id long, name string, slug string")
    assert one_product(p, text="RED") == one_product(p, slug="red") == one_product(p, product_id=1) == 1
    for wrong in ({"text": "shoe"}, {"slug": "none"}, {}, {"text": "red", "slug": "red"}):
        with pytest.raises(ValueError):
            one_product(p, **wrong)


def test_seed_counts_and_dry_run(spark, tmp_path):
    old = spark.createDataFrame([("a", "A", "x")], "slug string, name string, source_path string")
    builtin = spark.createDataFrame([(0, "AA", "a", "y"), (1, "B", "b", "z")], "arrival long, name string, slug string, source_path string")
    file = spark.createDataFrame([(0, "BB", "b", "z")], builtin.schema)
    seeded = ingest.seed_categories(old, ingest.seed_rows(builtin, file))
    path = tmp_path / "c"
    assert ingest.apply_seed(seeded, str(path), dry_run=True) == {"created": 1, "updated": 0, "skipped": 1} and not path.exists()
    assert ingest.apply_seed(ingest.seed_categories(old, ingest.seed_rows(builtin), update=True), str(path))["updated"] == 1
    assert {r["name"] for r in spark.read.parquet(str(path)).collect()} == {"AA", "B"}


def test_anomaly_stream_keeps_one_a_day(spark, tmp_path):
    from pricelattice.streaming import streams

    t0 = datetime(2024, 1, 1)
    rows = [(1, "spike", t0), (1, "spike", t0 + timedelta(hours=5)), (1, "cyclic", t0), (2, "spike", t0 + timedelta(hours=1))]
    schema = "product_id long, anomaly_type string, detected_at timestamp"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    got = streams.drained(streams.stream_new_anomalies(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), str(tmp_path / "s"))
    assert sorted((r["product_id"], r["anomaly_type"]) for r in got.collect()) == [(1, "cyclic"), (1, "spike"), (2, "spike")]


def test_cards_of_captured_html(spark):
    from pricelattice.sources.files import Selectors, extract_products, split_cards

    page = '<ul><li class="card a"><a class="t">One</a> <em class="p">1 200 ₽</em><img src="/1.png"></li><li class="other">x</li><li class="big card"><h1>Two</h1>for 7 ₽</li><li class="cards">y</li></ul>'
    cards = split_cards(spark.createDataFrame([(1, "u/55", page), (2, "u/6", None)], "page_id long, url string, html string"), "card")
    got = [tuple(r) for r in extract_products(cards, Selectors(name=("t",), price=("p",))).orderBy("card_no").select("name", "price", "old_price", "vendor_code", "image_url").collect()]
    assert got == [("One", 1200, None, "55", "/1.png"), ("Two", 7, None, "55", None)]


def test_reports_by_name(spark, tmp_path):
    from pricelattice.operators import detect
    from pricelattice.plans.commands import Reports
    from pricelattice.sources import views

    t = views.events_view(spark, "/root/testdata/sf0.001")
    r = Reports(t, detect.full_detection(t.history, t.now).withColumn("detected_at", F.col("ts")))
    lines = [x["value"] for x in r.anomalies(days=30, severity="high", out=str(tmp_path / "a")).collect()]
    assert "\n".join(lines) + "\n" == "".join(p.read_text() for p in sorted((tmp_path / "a").glob("part-*")))
    assert "product_id" in json.loads(r.anomalies(days=30, json=True).first()["value"])
    some = t.product.join(t.history, "product_id").first()["category"]
    assert {x["category"] for x in r.deals(category=some).collect()} == {some} and r.index().count() >= 1 and r.metrics().count() == 1
    assert r.forecast(limit=3, horizon=2).groupBy("product_id").count().where("count = 2").count() <= 3
    assert r.sensitivity(limit=4).count() <= 4 and r.heatmap(most=2).select("product_id").distinct().count() <= 2
    assert r.compare([1, 1], r.forecast(product_id=1)).count() == 2
    r.save_snapshot(str(tmp_path / "s"), "index")
    r.save_snapshot(str(tmp_path / "s"), "deals")
    assert r.list_snapshots(str(tmp_path / "s")).count() == 2 and r.list_snapshots(str(tmp_path / "s"), "full_dashboard").isEmpty()
    counts = r.sync(horizon=2)
    assert counts["errors"] == 0 and counts["forecasts_created"] > 0
    for wrong in (lambda: r.anomalies(severity="loud"), lambda: r.sensitivity(currency="GBP"), lambda: r.save_snapshot("x", "none")):
        with pytest.raises(ValueError):
            wrong()
