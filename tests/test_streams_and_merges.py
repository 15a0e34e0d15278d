"""Alerts that survive replays, anomalies in any order of arrival, tables that merges change in part."""

import shutil
from datetime import date, datetime, timedelta
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricelattice.operators import detect, ingest
from pricelattice.plans import jobs
from pricelattice.sources import merge
from pricelattice.streaming import streams

PRICES = "product_id long, price long, arrival long"
SUBS = "user_id long, product_id long, target_price long, is_active boolean"


def put(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def run_alerts(spark, tmp_path, subs):
    stream = spark.readStream.schema(PRICES).parquet(str(tmp_path / "in"))
    streams.stream_alerts(stream, subs, str(tmp_path / "s")).start().awaitTermination()


def outputs(spark, tmp_path, subs):
    folder = str(tmp_path / "s")
    alerts = sorted(map(tuple, streams.read_alerts(spark, folder).collect()))
    off = sorted((r["user_id"], r["product_id"]) for r in streams.open_subscriptions(subs, folder).where("not is_active").collect())
    assert [(a[0], a[1]) for a in alerts] == off  # the two outputs agree
    return alerts


def test_alerts_once_over_batches_replays_and_crashes(spark, tmp_path, monkeypatch):
    subs = spark.createDataFrame([(5, 1, 20, True), (6, 1, 11, True), (7, 2, 50, True)], SUBS)
    put(spark, [(1, 15, 0), (1, 18, 1)], PRICES, tmp_path / "in")
    run_alerts(spark, tmp_path, subs)
    first = outputs(spark, tmp_path, subs)
    assert [(a[0], a[1], float(a[2]), a[4]) for a in first] == [(5, 1, 18.0, 0)]
    put(spark, [(1, 10, 2), (2, 40, 3)], PRICES, tmp_path / "in")
    run_alerts(spark, tmp_path, subs)
    whole = outputs(spark, tmp_path, subs)
    assert [(a[0], a[1], a[4]) for a in whole] == [(5, 1, 0), (6, 1, 1), (7, 2, 1)]

    def forget():  # as if Spark had not noted the batch's end
        for f in (tmp_path / "s/checkpoint/commits").glob("*1*"):
            f.unlink()

    forget()
    run_alerts(spark, tmp_path, subs)
    assert outputs(spark, tmp_path, subs) == whole
    forget()  # between the two outputs
    shutil.rmtree(tmp_path / "s/off/batch=1")
    run_alerts(spark, tmp_path, subs)
    assert outputs(spark, tmp_path, subs) == whole
    forget()  # while an output is written
    for f in (tmp_path / "s/alerts/batch=1").glob("part-*"):
        f.unlink()
    run_alerts(spark, tmp_path, subs)
    assert outputs(spark, tmp_path, subs) == whole
    put(spark, [(1, 1, 4)], PRICES, tmp_path / "in")
    run_alerts(spark, tmp_path, subs)
    assert outputs(spark, tmp_path, subs) == whole


EVENTS = "product_id long, anomaly_type string, detected_at timestamp, resolved boolean"
T0 = datetime(2024, 1, 1)


def some_events(n, seed):
    rng = np.random.default_rng(seed)
    return [(int(rng.integers(3)), "ab"[int(rng.integers(2))], T0 + timedelta(minutes=int(rng.integers(60 * 24 * 6))), bool(rng.random() < 0.2)) for _ in range(n)]


def by_hand(events, hours=24):
    kept, open_at = [], {}
    for p, kind, at, resolved in sorted(events, key=lambda e: (e[2], e[3])):
        if resolved:
            open_at.pop((p, kind), None)
        elif (p, kind) not in open_at or at - open_at[p, kind] > timedelta(hours=hours):
            kept.append((p, kind, at))
            open_at[p, kind] = at
    return sorted(kept)


def test_anomalies_once_equals_walking_by_hand(spark):
    events = some_events(300, 1) + [(9, "a", T0, False), (9, "a", T0 + timedelta(hours=24), False), (9, "a", T0 + timedelta(hours=24, microseconds=1), False), (9, "a", T0, True)]
    got = detect.anomalies_once(spark.createDataFrame(events, EVENTS).repartition(5)).collect()
    assert sorted(map(tuple, got)) == by_hand(events)
    assert detect.anomalies_once(spark.createDataFrame([], EVENTS)).isEmpty()


@pytest.mark.parametrize("seed", [2, 3])
def test_stream_of_anomalies_in_any_order_of_arrival(spark, tmp_path, seed):
    events = some_events(120, seed)
    rng = np.random.default_rng(seed)
    # Each arrives up to 20 hours late, in one of five batches or so.
    arrival = sorted(events, key=lambda e: e[2] + timedelta(hours=float(rng.random() * 20)))
    size = len(arrival) // 4
    for k in range(0, len(arrival), size):
        put(spark, arrival[k : k + size], EVENTS, tmp_path / "in")
        stream = spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in"))
        got = streams.drained(streams.stream_anomalies_once(stream, "20 hours"), str(tmp_path / "s"))
    passed = max(e[2] for e in events) - timedelta(hours=20)
    assert sorted(map(tuple, got.collect())) == [r for r in by_hand(events) if r[2] <= passed]


def files(path):
    return {str(f): f.stat().st_mtime_ns for f in Path(path).rglob("part-*")}


def test_merges_rewrite_touched_buckets_only(spark, tmp_path):
    rows = spark.range(400).select(F.concat(F.lit("C"), "id").alias("currency"), F.lit(date(2024, 1, 1)).alias("date"), F.col("id").alias("rate"))
    table = merge.MergeTable(spark, str(tmp_path / "t"), ("currency", "date"), 16)
    table.create(rows)
    before = files(table.path)
    assert len(before) == 16
    new = spark.createDataFrame([("C7", date(2024, 1, 1), 1000), ("C8", date(2024, 1, 2), 5)], "currency string, date date, rate long")
    assert table.upsert(new) == {"created": 1, "updated": 1}
    after = files(table.path)
    touched = {f.rsplit("/", 1)[0] for f in before.items() ^ after.items() for f in [f[0]]}
    assert 1 <= len(touched) <= 2 and len(after) == 16
    assert {r["rate"] for r in table.read().where("currency in ('C7', 'C8')").collect()} == {1000, 8, 5} and table.read().count() == 401
    assert table.upsert(new) == {"created": 0, "updated": 2} and table.read().count() == 401  # again
    assert table.insert_missing(new.withColumn("rate", F.lit(3333).cast("long")).unionByName(spark.createDataFrame([("Z", date(2024, 1, 1), 4444)], new.schema))) == {"created": 1, "skipped": 2}
    assert table.read().where("rate = 3333").isEmpty() and table.read().where("rate = 4444").count() == 1
    was = files(table.path)
    assert table.merge(new.limit(0), ingest.append_changes) == [] and files(table.path) == was


def test_price_log_takes_deliveries_twice(spark, tmp_path):
    schema = "product_id long, price long, arrival long, ts timestamp_ntz"
    rows = [(i % 7, (i * 5) % 4, i, T0 + timedelta(hours=i)) for i in range(140)]
    df = spark.createDataFrame(rows, schema)
    table = merge.price_log(spark, str(tmp_path / "log"), 4)
    table.create(ingest.change_log(df.where("arrival < 40")).select("product_id", "price", "ts", "arrival", "is_actual", "old_price"))
    for lo, hi in ((40, 90), (40, 90), (20, 100), (90, 140), (0, 140)):
        merge.append_prices(table, df.where(f"arrival >= {lo} and arrival < {hi}"))
    want = ingest.change_log(df).select("product_id", "price", "ts", "arrival", "is_actual", "old_price")
    assert sorted(map(tuple, table.read().collect())) == sorted(map(tuple, want.collect()))
    before = files(table.path)
    merge.append_prices(table, spark.createDataFrame([(3, 99, 500, T0 + timedelta(days=30))], schema))
    assert len(before.items() - files(table.path).items()) == 1


def test_changed_products_are_those_with_new_rows(spark):
    schema = "product_id long, price long, arrival long, ts timestamp_ntz"
    log = ingest.change_log(spark.createDataFrame([(1, 5, 0, T0), (2, 7, 1, T0)], schema))
    # Product 2's price arrives unchanged, with a time that the log knows; product 1's first row comes again.
    again = spark.createDataFrame([(2, 7, 2, T0), (1, 5, 0, T0), (3, 1, 3, T0)], schema)
    assert [r[0] for r in jobs.changed_products(again, log).collect()] == [3]
    assert [r[0] for r in jobs.changed_products(again, log.drop("arrival")).collect()] == [3]


def one_by_one(wanted, taken):
    out, taken = {}, set(taken)
    for key, slug, _ in sorted(wanted, key=lambda r: (r[2], r[0])):
        n = 0
        while slug in taken:
            n += 1
            slug = f"{slug[:480]}-d{n}"[:512]
        taken.add(slug)
        out[key] = slug
    return out


def test_slugs_as_if_products_came_one_by_one(spark):
    rng = np.random.default_rng(4)
    names = ["x", "x-d1", "x-d1-d2", "y", "y" * 500, "y" * 480 + "-d1", "z"]
    for taken in ([], ["x", "x-d1"], ["y" * 500, "x-d1-d2"]):
        wanted = [(f"u{i}", names[int(rng.integers(len(names)))], int(i)) for i in rng.permutation(40)]
        df = spark.createDataFrame(wanted, "key string, slug string, arrival long").repartition(3)
        got = ingest.allocate_slugs(df, spark.createDataFrame([(t,) for t in taken], "slug string"))
        assert {r["key"]: r["slug"] for r in got.collect()} == one_by_one(wanted, taken)


def test_new_products_keep_off_slugs_of_other_buckets(spark, tmp_path):
    cols = "url string, name string, category string, vendor_code string, image_url string, last_parsed_at date, slug string"
    parsed = [(f"u{i}", "Same", "c", "", "", date(2024, 1, 2), i) for i in range(6)]
    new = spark.createDataFrame(parsed, "url string, name string, category string, vendor_code string, image_url string, parsed_at date, arrival long")
    base = {r["url"]: r["slug"] for r in ingest.upsert_products(spark.createDataFrame([], cols), new).collect()}
    table = merge.MergeTable(spark, str(tmp_path / "p"), ("url",), 8)
    table.create(spark.createDataFrame([(f"old{i}", "Old", "c", "", "", date(2024, 1, 1), s) for i, s in enumerate(base.values())], cols))
    merge.merge_products(table, new)
    got = {r["url"]: r["slug"] for r in table.read().collect()}
    assert len(set(got.values())) == 12 and all(got[u] == f"{s}-d1" for u, s in base.items())
    merge.merge_products(table, new)
    assert {r["url"]: r["slug"] for r in table.read().collect()} == got
