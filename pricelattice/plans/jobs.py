"""Jobs that a scheduler runs: ingest with detection and forecasts for what changed, alerts, snapshots."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import detect, forecast, ingest
from ..operators.rollup import settled
from ..sources import files, merge, sinks
from ..sources.live_rates import DailyRates


@dataclass
class IngestResult:
    """What one ingest run leaves."""

    log: DataFrame
    changed: DataFrame
    anomalies: DataFrame
    forecasts: DataFrame


def changed_products(arrivals: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Products whose price the arrivals change, each once."""
    log = ingest.change_log(arrivals) if before is None else ingest.new_changes(before, arrivals)
    return log.select("product_id").distinct()


def detect_changed(history: DataFrame, changed: DataFrame, known: DataFrame | None, now: datetime) -> DataFrame:
    """Anomalies of changed products only, without those known in the last day."""
    found = detect.full_detection(history.join(changed, "product_id", "left_semi"), now)
    return found if known is None else detect.new_anomalies(found, known)


def ingest_job(log: DataFrame, arrivals: DataFrame, product: DataFrame, known: DataFrame | None, now: datetime, horizon: int = 7) -> IngestResult:
    """Append arrivals to the log, detect and forecast for the products that changed. ``log`` and ``arrivals`` have product_id, price, ts; arrivals an ``arrival`` order."""
    new = ingest.append_changes(log, arrivals)
    changed = changed_products(arrivals, log)
    history = new.withColumn("tie", F.unix_micros(new["ts"].cast("timestamp")))
    return IngestResult(new, changed, detect_changed(history, changed, known, now), forecast.forecast_products(history.join(changed, "product_id", "left_semi"), product, horizon))


@dataclass
class Shop:
    """The tables that a crawl changes: products by url (with ``product_id``), the price log by product, and the folder of anomalies."""

    products: merge.MergeTable
    log: merge.MergeTable
    anomalies: str


@dataclass
class CrawlResult:
    """What a crawl did: a row a category (``category``, ``status``: ok, empty or skipped, ``parsed``), and counts of products and prices."""

    categories: DataFrame
    created: int
    updated: int
    saved: int
    unchanged: int
    anomalies: int


def crawl_job(shop: Shop, cards: DataFrame, categories: DataFrame, now: datetime) -> CrawlResult:
    """From cards to anomalies: parsed cards (category, url, name, price, old_price, vendor_code, image_url, arrival) of active categories become products by url, the first
    of one url counting; their prices go to the log where they changed, and the products that changed are searched for anomalies.

    A card without url, name or price is none. Each step writes its table before the next reads it, counts come along with the writes (``observe``), and each can
    run again: products and prices are then known, and anomalies of the last day are not repeated.
    """
    spark = cards.sparkSession
    active = categories.where("is_active").select(F.col("name").alias("category"))
    whole = cards.where("url <> '' and name <> '' and price is not null").join(active, "category", "left_semi")
    parsed = settled(files.first_seen(whole, "url", "arrival"), "parsed")

    old = shop.products.read()
    top = old.agg(F.max("product_id")).first()[0] or 0
    known = old.select("url", "product_id")
    # Unique and not dense; written, as they must not be counted twice.
    made, kept = Observation(), Observation()
    fresh = parsed.join(known, "url", "left_anti").select("url", (F.monotonically_increasing_id() + top + 1).alias("product_id"))
    ids = settled(
        known.join(parsed.select("url"), "url", "left_semi").observe(kept, F.count(F.lit(1)).alias("n")).unionByName(fresh.observe(made, F.count(F.lit(1)).alias("n"))), "ids"
    )
    slugs = old.select("slug")

    def combined(old: DataFrame, new: DataFrame) -> DataFrame:
        found = ingest.upsert_products(old.drop("product_id", "is_active"), new, taken=slugs).drop("created")
        own = old.select("url", F.col("product_id").alias("_old"), "is_active")
        both = found.join(own, "url", "left").join(ids, "url", "left")
        return both.withColumn("product_id", F.coalesce("_old", "product_id")).withColumn("is_active", F.coalesce("is_active", F.lit(True)))

    shop.products.merge(parsed.withColumn("parsed_at", F.lit(now).cast("timestamp_ntz")), combined)

    arrivals = settled(parsed.join(ids, "url").select("product_id", "price", F.lit(now).cast("timestamp_ntz").alias("ts"), F.unix_micros(F.lit(now).cast("timestamp")).alias("arrival")), "arrivals")
    saved = Observation()
    log = shop.log.read()
    changed = settled(ingest.new_changes(log, arrivals).observe(saved, F.count(F.lit(1)).alias("n")).select("product_id").distinct(), "changed")

    # Anomalies are found in the log as it will be and kept before it is, so that a job that breaks off in between finds them again.
    ahead = ingest.append_changes(log.join(changed, "product_id", "left_semi"), arrivals.join(changed, "product_id", "left_semi"))
    history = ahead.withColumn("tie", F.col("arrival")).withColumn("price", F.col("price").cast("decimal(12,2)"))
    before = spark.read.schema(ANOMALIES).parquet(shop.anomalies) if sinks.exists(spark, shop.anomalies) else spark.createDataFrame([], ANOMALIES)
    found = Observation()
    new = detect_changed(history, changed, before.select("product_id", "anomaly_type", "detected_at", "resolved"), now).observe(found, F.count(F.lit(1)).alias("n"))
    sinks.append_rows(new.select("product_id", "anomaly_type", "severity", "detected_at", "resolved"), shop.anomalies)
    merge.append_prices(shop.log, arrivals)

    n = parsed.groupBy("category").agg(F.count("*").alias("parsed"))
    per = categories.select(F.col("name").alias("category"), "is_active").join(n, "category", "left")
    status = F.when(~F.col("is_active"), "skipped").when(F.col("parsed").isNull(), "empty").otherwise("ok")
    totals = [o.get["n"] for o in (made, kept, saved, found)]
    return CrawlResult(
        per.select("category", status.alias("status"), F.coalesce("parsed", F.lit(0)).alias("parsed")), totals[0], totals[1], totals[2], totals[0] + totals[1] - totals[2], totals[3]
    )


ANOMALIES = "product_id long, anomaly_type string, severity string, detected_at timestamp_ntz, resolved boolean"


def save_rates(table: merge.MergeTable, rates: DataFrame) -> int:
    """Write rates (currency, date, rate) over those of their days; how many are new."""
    return table.upsert(rates)["created"]


def backfill_rates(spark: SparkSession, table: merge.MergeTable, url: str, days: int, **options: str) -> int:
    """Fetch the rates of the last ``days`` days and save them; how many are new. Days that cannot be fetched are left out."""
    spark.dataSource.register(DailyRates)
    fetched = spark.read.format("daily_rates").options(url=url, days=str(days), **options).load()
    return save_rates(table, settled(fetched, "rates"))  # fetched once
