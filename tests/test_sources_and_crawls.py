"""A database, rates as batches and streams, and crawls."""

import threading
from collections import Counter
from datetime import date, datetime
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.error import URLError

import pytest
from pyspark.sql import functions as F

from pricelattice.plans import jobs
from pricelattice.sources import database, merge
from pricelattice.sources.live_rates import DailyRates, with_retries

XML = "<V><Valute><CharCode>USD</CharCode><Nominal>10</Nominal><Value>{}0,5</Value></Valute><Valute><CharCode>GBP</CharCode><Value>1</Value></Valute></V>"


def test_a_database_gets_filters_columns_and_ranges(spark):
    url = "jdbc:derby:memory:prices;create=true"
    rows = spark.range(1000).select(F.col("id").alias("ID"), (F.col("id") * 2).alias("PRICE"), F.concat(F.lit("p"), "id").alias("NAME")).repartition(3)
    database.write_table(rows, url, "PRICES", mode="overwrite", createTableColumnTypes="NAME VARCHAR(20)")
    got = database.read_table(spark, url, "PRICES", key="ID", rows_a_part=300)
    assert got.rdd.getNumPartitions() == 4 and sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect()))
    few = got.where("ID >= 990 and NAME = 'p995'").select("PRICE")
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(ID,990)" in plan and "EqualTo(NAME,p995)" in plan and "ReadSchema: struct<PRICE" in plan
    assert [r[0] for r in few.collect()] == [1990]
    assert database.read_table(spark, url, "PRICES").rdd.getNumPartitions() == 1 and database.read_table(spark, url, "PRICES", key="ID").count() == 1000
    database.write_table(rows.limit(0), url, "NOTHING", mode="overwrite")
    assert database.read_table(spark, url, "NOTHING", key="ID").isEmpty()
    database.write_table(spark.createDataFrame([(None, 5), (7, 6), (9, 7)], "ID long, PRICE long"), url, "HOLES", mode="overwrite")
    assert database.read_table(spark, url, "HOLES", key="ID", rows_a_part=1).count() == 3


@pytest.fixture
def bank():
    """A server that fails each day twice and then answers; ``never`` are days that it never answers."""

    class Bank(BaseHTTPRequestHandler):
        asked, never = Counter(), set()

        def do_GET(self):
            day = self.path.strip("/")
            Bank.asked[day] += 1
            if Bank.asked[day] <= 2 or day in Bank.never:
                self.send_error(503)
                return
            self.send_response(200)
            self.end_headers()
            self.wfile.write(XML.format(day[-1]).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Bank)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield Bank, f"http://127.0.0.1:{server.server_port}/{{day}}"
    server.shutdown()


def test_retries_wait_longer_each_time():
    for error, extra in ((ConnectionError("x"), 0), (URLError(TimeoutError("late")), 20)):
        waits, left = [], [error, error]

        def fetch():
            if left:
                raise left.pop()
            return b"ok"

        assert with_retries(fetch, 3, 1.0, waits.append) == b"ok"
        assert [extra + 2 <= waits[0] <= extra * 2.25 + 3, extra + 4 <= waits[1] <= extra * 2.25 + 5] == [True, True]
    with pytest.raises(ConnectionError):
        with_retries(lambda: (_ for _ in ()).throw(ConnectionError("x")), 2, 0.0, lambda s: None)


def test_backfill_goes_on_past_failures_and_gaps(spark, bank, tmp_path):
    server, url = bank
    server.never.add("2024-01-02")
    table = merge.MergeTable(spark, str(tmp_path / "rates"), ("currency", "date"), 4, "currency string, date date, rate decimal(10,4)")
    table.create(spark.createDataFrame([("USD", date(2024, 1, 3), None)], table.schema))
    assert jobs.backfill_rates(spark, table, url, 4, today="2024-01-04", pause="0") == 2  # the 1st and the 4th
    assert {(r["date"].day, float(r["rate"])) for r in table.read().collect()} == {(1, 1.05), (3, 3.05), (4, 4.05)}
    assert set(server.asked.values()) == {3} and jobs.backfill_rates(spark, table, url, 4, today="2024-01-04", pause="0") == 0


def test_rates_stream_reads_new_days_only(spark, bank, tmp_path):
    server, url = bank
    spark.dataSource.register(DailyRates)

    def run(today):
        stream = spark.readStream.format("daily_rates").option("url", url).option("from", "2024-01-01").option("today", today).option("pause", "0").load()
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))
        q.trigger(once=True).start().awaitTermination()
        return sorted((r["date"].day, float(r["rate"])) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run("2024-01-02") == [(1, 1.05), (2, 2.05)]
    first = dict(server.asked)
    assert run("2024-01-04") == [(1, 1.05), (2, 2.05), (3, 3.05), (4, 4.05)]
    assert all(server.asked[d] == n for d, n in first.items()) and server.asked["2024-01-03"] == 3
    server.never.add("2024-01-05")
    with pytest.raises(Exception, match="503"):
        run("2024-01-05")
    server.never.clear()
    assert len(run("2024-01-05")) == 5


CARDS = "category string, url string, name string, price long, old_price long, vendor_code string, image_url string, arrival long"


def crawl(spark, shop, rows, day, kinds):
    return jobs.crawl_job(shop, spark.createDataFrame(rows, CARDS), kinds, datetime(2024, 1, day))


def test_crawls_count_what_they_do_and_can_run_again(spark, tmp_path, monkeypatch):
    shop = jobs.Shop(merge.product_table(spark, str(tmp_path / "p"), 4), merge.price_log(spark, str(tmp_path / "l"), 4), str(tmp_path / "a"))
    shop.products.create(spark.createDataFrame([], merge.PRODUCTS))
    shop.log.create(spark.createDataFrame([], merge.LOG))
    kinds = spark.createDataFrame([("tv", True), ("old", False), ("none", True)], "name string, is_active boolean")
    card = lambda url, price, name="A", kind="tv", code="": (kind, url, name, price, None, code, "", int(price or 0))
    rows = [card("u1", 100), card("u2", 50), card("u2", 70), card("", 5), card("u3", None), card("u4", 9, name=""), card("u9", 1, kind="old")]
    got = crawl(spark, shop, rows, 1, kinds)
    assert (got.created, got.updated, got.saved, got.unchanged, got.anomalies) == (2, 0, 2, 0, 0)
    assert sorted(map(tuple, got.categories.collect())) == [("none", "empty", 0), ("old", "skipped", 0), ("tv", "ok", 2)]
    ids = {r["url"]: r["product_id"] for r in shop.products.read().collect()}
    assert set(ids) == {"u1", "u2"} and len(set(ids.values())) == 2
    got = crawl(spark, shop, [card("u1", 100, name="B"), card("u2", 55), card("u5", 3)], 2, kinds)
    assert (got.created, got.updated, got.saved, got.unchanged) == (1, 2, 2, 1)
    again = crawl(spark, shop, [card("u1", 100, name="B"), card("u2", 55), card("u5", 3)], 2, kinds)
    assert (again.created, again.updated, again.saved, again.unchanged, again.anomalies) == (0, 3, 0, 3, 0)
    assert {r["url"]: r["product_id"] for r in shop.products.read().collect()}.items() >= ids.items()
    assert shop.products.read().where("url = 'u1'").first()["name"] == "B"

    def broken(table, arrivals):
        raise RuntimeError("lost")

    keep = merge.append_prices
    monkeypatch.setattr(merge, "append_prices", broken)
    with pytest.raises(RuntimeError):  # before the prices are logged
        crawl(spark, shop, [card("u2", 90)], 3, kinds)
    monkeypatch.setattr(merge, "append_prices", keep)
    assert shop.log.read().where(f"product_id = {ids['u2']}").count() == 2
    found = spark.read.parquet(shop.anomalies)
    assert [(r["product_id"], r["anomaly_type"]) for r in found.collect()] == [(ids["u2"], "spike")]
    got = crawl(spark, shop, [card("u2", 90)], 3, kinds)
    assert (got.saved, got.anomalies) == (1, 0) and spark.read.parquet(shop.anomalies).count() == 1
    log = shop.log.read().where(f"product_id = {ids['u2']}").orderBy("arrival").collect()
    assert [(r["price"], r["is_actual"], r["old_price"]) for r in log] == [(50, False, None), (55, False, 50), (90, True, 55)]
