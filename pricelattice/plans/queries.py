"""Every query by name over the test tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import labels, text
from ..functions.formats import fixed, iso_text, iso_time, padded, percent, signed
from ..operators import api, detect, features, forecast, ingest, reports, search, sensitivity
from ..operators.rollup import RollupTable
from ..session import shared_folder
from ..sources import files, merge, sinks, views
from ..streaming import streams
from . import jobs, snapshot

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Register a query. Its decimals leave as doubles, which compare alike everywhere."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = f(spark, sf_dir)
        return df.withColumns({c.name: F.col(c.name).cast("double") for c in df.schema if c.dataType.typeName() == "decimal"})

    QUERIES[f.__name__] = run
    return f


def _found(spark: SparkSession, d: str) -> tuple[views.PriceTables, DataFrame]:
    t = views.events_view(spark, d)
    # Detected when the newest row came, so that reports over a window select some.
    return t, detect.full_detection(t.history, t.now).withColumn("detected_at", F.col("ts"))


@query
def active_products(spark, d):
    return views.events_product(spark, d).where("is_active").select("product_id", "name", "category")


@query
def by_category(spark, d):
    return views.lineitem_view(spark, d).product.where("category = 'Brand#13' and is_active").select("product_id", "name", "category")


@query
def name_search(spark, d):
    return reports.find_product(views.events_product(spark, d), "r#00000001")


def _index(spark, d, *fields: str) -> DataFrame:
    path = shared_folder(spark, "trigrams")
    search.write_index(search.trigrams(views.events_product(spark, d), *fields), path)
    return search.read_index(spark, path)


@query
def name_search_indexed(spark, d):
    return reports.find_product(views.events_product(spark, d), "r#00000001", index=_index(spark, d, "name"))


@query
def latest_price(spark, d):
    return reports.latest_prices(views.lineitem_view(spark, d).history)


@query
def price_history(spark, d):
    t = views.events_view(spark, d)
    return reports.price_history(t.history, t.product, 7, 30)


@query
def product_change_log(spark, d):
    arrivals = views.read(spark, d, "events").select(
        F.col("user_id").alias("product_id"), (F.floor(F.col("value") / 10) * 10).cast("long").alias("price"), F.col("event_id").alias("arrival")
    )
    return ingest.change_log(arrivals).select("product_id", "price", "arrival", "is_actual", F.col("old_price").cast("double").alias("old_price"))


@query
def best_deals(spark, d):
    t = views.events_view(spark, d)
    return reports.best_deals(t.history, t.product, t.now)


@query
def best_deals_lineitem(spark, d):
    t = views.lineitem_view(spark, d)
    return reports.best_deals(t.history, t.product, t.now, days=365, limit=50)


@query
def category_index(spark, d):
    """All categories: the tables mark none as closed."""
    t = views.events_view(spark, d)
    return reports.category_index(t.history, t.product, t.now)


@query
def heatmap(spark, d):
    t = views.events_view(spark, d)
    return reports.heatmap(t.history, t.product, t.now)


@query
def ingest_metrics(spark, d):
    t = views.events_view(spark, d)
    return reports.ingest_metrics(t.history, t.product, t.category, t.now)


@query
def products_without_data(spark, d):
    """All products: the tables mark none as inactive."""
    t = views.events_view(spark, d)
    return reports.products_without_data(t.history, t.product.withColumn("is_active", F.lit(True)))


def _forecasts(spark, d) -> DataFrame:
    """Stand-in forecasts that SQL can make, too."""
    return views.read(spark, d, "customer").select(
        F.col("c_custkey").alias("product_id"), F.lit(date(2024, 2, 1)).alias("forecast_date"), F.col("c_acctbal").cast("decimal(12,2)").alias("predicted_price"), F.lit("ARIMA").alias("method")
    )


@query
def compare_products(spark, d):
    t = views.events_view(spark, d)
    return reports.compare_products(t.history, t.product, _forecasts(spark, d), [2, 2, 999_999_999, 5, 1, 14], t.now)


@query
def spike(spark, d):
    t = views.events_view(spark, d)
    found = detect.detect_spike(detect.recent_series(t.history), 3)
    return found.select("product_id", "severity", "ts", "previous", "current", F.round("change", 6).alias("change"), "direction", F.round("days", 6).alias("days"))


@query
def spike_messages(spark, d):
    t = views.events_view(spark, d)
    found = detect.detect_spike(detect.recent_series(t.history), 3)
    return detect.spike_text(found, detect.past_similar_spike(found, t.history))


@query
def past_similar_spike(spark, d):
    t = views.events_view(spark, d)
    found = detect.past_similar_spike(detect.detect_spike(detect.recent_series(t.history), 3), t.history)
    return found.select("product_id", F.round("change", 6).alias("change"), "past_ts", F.round("past_change", 6).alias("past_change"), "days_ago")


@query
def manipulation(spark, d):
    found = detect.detect_manipulation(detect.recent_series(views.events_view(spark, d).history))
    return found.select("product_id", "severity", "ts", "base", "peak", "after", "position")


@query
def cyclic(spark, d):
    found = detect.detect_cyclic(detect.recent_series(views.events_view(spark, d).history))
    return found.select("product_id", "severity", "ts", F.round("ratio", 6).alias("ratio"), F.round("period_rows", 6).alias("period_rows"), F.round("period_days", 6).alias("period_days"))


@query
def full_detection(spark, d):
    t = views.events_view(spark, d)
    found = detect.full_detection(t.history, t.now)
    return found.select("product_id", "anomaly_type", "severity", "ts", F.round("metric", 6).alias("metric"), "detected_at", "resolved")


@query
def anomaly_dedup(spark, d):
    """Known: odd products' anomalies of 12 hours ago (unresolved where the id is no multiple of 3), even ones' of two days ago."""
    t = views.events_view(spark, d)
    found = detect.full_detection(t.history, t.now)
    age = F.when(F.col("product_id") % 2 == 1, F.expr("INTERVAL 12 HOURS")).otherwise(F.expr("INTERVAL 48 HOURS"))
    known = found.select("product_id", "anomaly_type", (F.col("detected_at") - age).alias("detected_at"), (F.col("product_id") % 3 == 0).alias("resolved"))
    return detect.new_anomalies(found, known).select("product_id", "anomaly_type", "severity", "ts")


@query
def anomaly_report(spark, d):
    t, found = _found(spark, d)
    return reports.anomaly_report(found, t.product, t.now, 1)


@query
def anomaly_summary(spark, d):
    t, found = _found(spark, d)
    return reports.anomaly_summary(found, t.now, 7)


@query
def anomaly_report_lines(spark, d):
    t, found = _found(spark, d)
    return reports.report_lines(reports.anomaly_report(found, t.product, t.now, 1, severity="high"))


@query
def report_text(spark, d):
    """The whole report, its lines numbered in order."""
    t, found = _found(spark, d)
    entries = reports.anomaly_report(found.withColumn("description", F.concat(F.lit("change "), percent(F.col("metric")))), t.product, t.now, 1)
    return reports.report_text(entries)


@query
def anomaly_report_json(spark, d):
    t, found = _found(spark, d)
    rows = reports.anomaly_report(found, t.product, t.now, 1, kind="cyclic").select("product_id", "name", "anomaly_type")
    return reports.report_json(rows)


@query
def changed_products_detection(spark, d):
    """Detection for the products whose price the events of the last day changed."""
    t = views.events_view(spark, d)
    late = views.read(spark, d, "events").where(F.col("ts") >= detect.window_start(t.now, 1))
    arrivals = late.select(F.col("user_id").alias("product_id"), F.col("value").cast("decimal(12,2)").alias("price"), F.col("event_id").alias("arrival"), "ts")
    return jobs.detect_changed(t.history, jobs.changed_products(arrivals), None, t.now).select("product_id", "anomaly_type", "severity", "ts")


@query
def product_features(spark, d):
    t = views.lineitem_view(spark, d)
    f = features.product_features(t.history, t.product)
    return f.select("product_id", "name", "category", "n_records", "mean_price", *[F.round(c, 6).alias(c) for c in ("volatility", "trend", "max_change_pct")])


@query
def clusters(spark, d):
    t = views.lineitem_view(spark, d)
    return features.cluster_products(features.product_features(t.history, t.product))


@query
def fx_sensitivity(spark, d):
    t = views.events_view(spark, d)
    return sensitivity.fx_sensitivity(t.history, t.product, t.rates).select("product_id", "name", F.round("correlation", 6).alias("correlation"), "sample_size", "verdict")


@query
def fx_sensitivity_p(spark, d):
    """All products that have prices: the tables mark none as inactive."""
    t = views.events_view(spark, d)
    return sensitivity.correlations(sensitivity.last_prices(t.history), t.rates, "EUR").select("product_id", F.round("p_value", 5).alias("p_value"))


@query
def fx_sensitivity_ranked(spark, d):
    """The first 30 products by id, the strongest correlation first, with the text that a report shows."""
    t = views.events_view(spark, d)
    found = sensitivity.fx_sensitivity(t.history, t.product, t.rates, limit=30)
    place = F.row_number().over(Window.orderBy(F.abs(F.round("correlation", 9)).desc_nulls_last(), "product_id"))  # 30 rows
    return found.select("product_id", place.alias("place"), F.regexp_replace("detail", r" \(p=[^)]*\)", "").alias("detail"))


@query
def forecasts(spark, d):
    t = views.events_view(spark, d)
    return forecast.forecast_products(t.history, t.product)


@query
def alerts(spark, d):
    t = views.lineitem_view(spark, d)
    return ingest.check_alerts(t.history, views.subscriptions(spark, d), t.product)


@query
def alerts_state(spark, d):
    t = views.lineitem_view(spark, d)
    subs = views.subscriptions(spark, d)
    return ingest.after_alerts(subs, ingest.check_alerts(t.history, subs, t.product)).groupBy("is_active").agg(F.count("*").alias("n"), F.sum("target_price").cast("double").alias("targets"))


def _products(spark, d) -> tuple[DataFrame, DataFrame]:
    """Known products and parsed ones, with some of both."""
    part = views.read(spark, d, "part")
    url = F.concat(F.lit("https://shop.example.com/"), F.col("p_partkey").cast("string"))
    old = part.where("p_partkey % 3 <> 0").select(
        url.alias("url"), F.col("p_name").alias("name"), F.col("p_brand").alias("category"), F.col("p_type").alias("vendor_code"), F.lit("a.png").alias("image_url"),
        F.lit(date(2024, 1, 1)).alias("last_parsed_at"), F.concat(F.lit("s-"), F.col("p_partkey").cast("string")).alias("slug"),
    )
    new = part.where("p_partkey % 2 = 0 or p_partkey % 3 = 0").select(
        url.alias("url"), F.upper("p_name").alias("name"), F.lit("new").alias("category"), F.when(F.col("p_size") > 25, F.col("p_type")).otherwise("").alias("vendor_code"),
        F.lit("").alias("image_url"), F.lit(date(2024, 2, 1)).alias("parsed_at"), F.col("p_partkey").alias("arrival"),
    )
    return old, new


@query
def product_upsert(spark, d):
    return ingest.upsert_products(*_products(spark, d))


@query
def product_merge(spark, d):
    """The same into a table of buckets."""
    old, new = _products(spark, d)
    table = merge.MergeTable(spark, shared_folder(spark, "products"), ("url",), 8)
    table.create(old)
    known = old.select("url", F.lit(False).alias("created"))
    merge.merge_products(table, new)
    return table.read().join(known, "url", "left").withColumn("created", F.coalesce("created", F.lit(True)))


@query
def price_log_merge(spark, d):
    """The change log of all events, merged into a table of buckets in three deliveries that overlap."""
    arrivals = views.read(spark, d, "events").select(
        F.col("user_id").alias("product_id"), (F.floor(F.col("value") / 10) * 10).cast("long").alias("price"), F.col("ts"), F.col("event_id").alias("arrival")
    )
    arrivals = arrivals.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    third = F.lit(views.newest(arrivals, "arrival") // 3)
    table = merge.price_log(spark, shared_folder(spark, "log"), 8)
    table.create(ingest.change_log(arrivals.where(F.col("arrival") <= third)).select("product_id", "price", "ts", "arrival", "is_actual", "old_price"))
    merge.append_prices(table, arrivals.where((F.col("arrival") > third / 2) & (F.col("arrival") <= 2 * third)))
    merge.append_prices(table, arrivals.where(F.col("arrival") > third))
    return table.read().select("product_id", "price", "arrival", "is_actual", F.col("old_price").cast("double").alias("old_price"))


@query
def forecast_merge(spark, d):
    """Forecasts of two days merged into those of one."""
    old = _forecasts(spark, d)
    table = merge.MergeTable(spark, shared_folder(spark, "forecasts"), ("product_id", "forecast_date", "method"), 8)
    table.create(old)
    new = old.where("product_id % 2 = 0").withColumn("predicted_price", (F.col("predicted_price") * 2).cast("decimal(12,2)"))
    table.upsert(new.unionByName(new.withColumn("forecast_date", F.lit(date(2024, 2, 2)))))
    return table.read()


@query
def rates_merge(spark, d):
    """Rates of the second half of a month merged into those of the first 20 days."""
    rates = views.events_rates(spark, d)
    table = merge.MergeTable(spark, shared_folder(spark, "rates"), ("currency", "date"), 8)
    table.create(rates.where(F.dayofmonth("date") <= 20))
    table.upsert(rates.where(F.dayofmonth("date") >= 15).withColumn("rate", (F.col("rate") + 1).cast("decimal(10,4)")))
    return table.read()


def _seeds(spark, d) -> tuple[DataFrame, DataFrame]:
    """Known: regions and market segments. A built-in list names the regions otherwise; a file has them once more, last, and the nations."""
    region, nation = views.read(spark, d, "region"), views.read(spark, d, "nation")
    slug = F.concat(F.lit("r-"), F.col("r_regionkey").cast("string"))
    old = region.select(slug.alias("slug"), F.col("r_name").alias("name"), F.lit("a").alias("source_path")).unionByName(
        views.events_product(spark, d).select("category").distinct().select(F.col("category").alias("slug"), F.col("category").alias("name"), F.lit("b").alias("source_path"))
    )
    builtin = region.select(F.col("r_regionkey").cast("long").alias("arrival"), F.lower("r_name").alias("name"), slug.alias("slug"), F.lit("/c/").alias("source_path"))
    file = builtin.withColumn("name", F.concat(F.lit(" "), "name", F.lit("s "))).unionByName(
        nation.select((F.col("n_nationkey") + 100).cast("long").alias("arrival"), F.col("n_name").alias("name"), F.concat(F.lit("n-"), F.col("n_nationkey").cast("string")).alias("slug"), F.lit("d/e/").alias("source_path"))
    )
    return old, ingest.seed_rows(builtin, file)


@query
def seed_merge(spark, d):
    return ingest.seed_categories(*_seeds(spark, d))


@query
def seed_merge_update(spark, d):
    return ingest.seed_categories(*_seeds(spark, d), update=True)


@query
def fx_upsert(spark, d):
    rates = views.events_rates(spark, d)
    old = rates.where(F.dayofmonth("date") <= 20)
    new = rates.where(F.dayofmonth("date") >= 15).withColumn("rate", (F.col("rate") + 1).cast("decimal(10,4)"))
    return ingest.upsert(old, new, ["currency", "date"])


@query
def forecast_upsert(spark, d):
    old = _forecasts(spark, d)
    new = old.where("product_id % 2 = 0").withColumn("predicted_price", (F.col("predicted_price") * 2).cast("decimal(12,2)"))
    more = new.withColumn("forecast_date", F.lit(date(2024, 2, 2)))
    return ingest.upsert(old, new.unionByName(more), ["product_id", "forecast_date", "method"])


@query
def subscription_create(spark, d):
    subs = views.subscriptions(spark, d).where("product_id % 3 = 0").withColumn("is_active", F.col("user_id") % 2 == 0)
    wanted = views.subscriptions(spark, d).where("product_id % 2 = 0 or product_id % 3 <> 0").select("user_id", "product_id", "target_price", F.col("product_id").alias("arrival"))
    return ingest.create_subscriptions(subs, wanted).select("user_id", "product_id", "target_price")


@query
def fx_rates_xml(spark, d):
    """The rates of every day, written as the bank's XML (a decimal comma, ten units of CNY, currencies that nobody asked for) and read again."""
    nominal = F.when(F.col("currency") == "CNY", 10).otherwise(1)
    value = F.replace((F.col("rate") * nominal).cast("string"), F.lit("."), F.lit(","))
    one = F.concat(F.lit("<Valute><CharCode>"), "currency", F.lit("</CharCode><Nominal>"), nominal.cast("string"), F.lit("</Nominal><Value>"), value, F.lit("</Value></Valute>"))
    docs = views.events_rates(spark, d).groupBy("date").agg(F.array_join(F.collect_list(one), "").alias("all"))
    more = F.lit("<Valute><CharCode>GBP</CharCode><Value>1,0</Value></Valute></ValCurs>")
    return files.rates_from_xml_text(docs.select("date", F.concat(F.lit("<ValCurs>"), "all", more).alias("xml")))


@query
def fx_backfill_calendar(spark, d):
    return files.backfill_days(spark, views.newest(views.read(spark, d, "events")).date(), 90)


@query
def clean_price(spark, d):
    rows = spark.createDataFrame([("12 499 ₽",), ("999₽",), ("",), ("none in stock",), ("from 5 499 ₽/pc",), ("1 000",)], "raw string")
    price = text.clean_price(F.col("raw")).cast("double").alias("price")
    own = rows.select("raw", price)
    part = views.read(spark, d, "part").select(F.concat(F.lit("from "), F.col("p_partkey").cast("string"), F.lit(" 00 ₽/1 pc")).alias("raw"))
    return own.unionByName(part.select("raw", price))


@query
def slugify(spark, d):
    part = views.read(spark, d, "part")
    url = F.concat(F.lit("https://shop.example.com/"), F.col("p_partkey").cast("string"))
    return part.select("p_partkey", text.product_slug(F.col("p_name"), F.col("p_brand"), url).alias("slug"))


@query
def proxy_parts(spark, d):
    key = F.col("s_suppkey")
    scheme = F.when(key % 3 == 0, "http://").when(key % 3 == 1, "socks5://").otherwise("")
    url = F.concat(scheme, F.lit("p"), key.cast("string"), F.lit(".example.com"), F.when(key % 2 == 0, F.concat(F.lit(":"), (key + 1000).cast("string"))).otherwise(""))
    return views.read(spark, d, "supplier").select(url.alias("url"), text.proxy_parts(url).alias("p")).select("url", "p.*")


@query
def heat_indicator(spark, d):
    change = F.when(F.col("event_id") % 10 != 0, F.round((F.col("value") - 50) / 10, 3))
    return views.read(spark, d, "events").select("event_id", labels.heat_indicator(change).alias("indicator"))


@query
def heat_text(spark, d):
    change = F.when(F.col("event_id") % 10 != 0, F.round((F.col("value") - 50) / 10, 3))
    return views.read(spark, d, "events").select("event_id", labels.heat_text(change).alias("cell"))


@query
def number_texts(spark, d):
    """Prices and shares of every part as reports show them."""
    price = F.col("p_retailprice")
    return views.read(spark, d, "part").select(
        "p_partkey", padded(fixed(price), 10).alias("price"), signed(price - 1000, 1).alias("change"), percent(price / 4096).alias("share"),
        labels.label_of(F.col("p_type"), {"PROMO": "promoted", "SMALL": "small"}).alias("kind"),
    )


@query
def corr_verdict(spark, d):
    r = F.when(F.col("event_id") % 10 != 0, F.round(F.col("event_id") % 201 / 100.0 - 1, 2))
    return views.read(spark, d, "events").select("event_id", labels.corr_verdict(r).alias("verdict"))


@query
def page_extract(spark, d):
    found = files.extract_products(views.read(spark, d, "pages"))
    return found.select("page_id", "name", "vendor_code", F.col("price").cast("double").alias("price"), F.col("old_price").cast("double").alias("old_price"), "image_url")


def _list_pages(spark, d) -> DataFrame:
    """A list page for each brand, a card for each part: every third without its price's own element, every fourth reduced, every fifth without an image."""
    key, price = F.col("p_partkey"), F.floor("p_retailprice").cast("long")
    shown = F.when(key % 3 == 0, F.concat(F.lit("<b>only "), price.cast("string"), F.lit(" ₽ today</b>"))).otherwise(F.concat(F.lit('<span class="now big">'), price.cast("string"), F.lit(" ₽</span>")))
    before = F.when(key % 4 == 0, F.concat(F.lit('<s class="was">'), (price + 100).cast("string"), F.lit(" ₽</s>"))).otherwise("")
    image = F.when(key % 5 != 0, F.concat(F.lit('<img data-src="/i/'), key.cast("string"), F.lit('.png">'))).otherwise("")
    card = F.concat(
        F.lit('<div class="item card">'), image, F.lit('<a class="title">'), "p_name", F.lit("  "), "p_type", F.lit("</a>"), shown, before,
        F.lit('<i class="sku">No. '), key.cast("string"), F.lit("</i></div>"),
    )
    cards = views.read(spark, d, "part").groupBy("p_brand").agg(F.sort_array(F.collect_list(F.struct("p_partkey", card.alias("card")))).alias("cards"))
    body = F.array_join(F.transform("cards", lambda c: c["card"]), "\n")
    return cards.select("p_brand", F.concat(F.lit("https://shop.example.com/l/"), "p_brand").alias("url"), F.concat(F.lit("<h1>All</h1><p class='cards'>"), body, F.lit("</p>")).alias("html"))


@query
def card_extract(spark, d):
    chosen = files.Selectors(name=("title",), price=("now",), old_price=("was",), code=("sku",))
    found = files.extract_products(files.split_cards(_list_pages(spark, d), "card"), chosen)
    return found.select("p_brand", "card_no", "name", F.col("price").cast("double").alias("price"), F.col("old_price").cast("double").alias("old_price"), "vendor_code", "image_url")


def _crawls(spark, d) -> tuple[jobs.CrawlResult, jobs.CrawlResult]:
    """Two crawls of the brands' list pages, a day apart; at the second every fourth part costs 5 more, and one brand's page has no cards."""
    chosen = files.Selectors(name=("title",), price=("now",), old_price=("was",), code=("sku",))
    found = files.extract_products(files.split_cards(_list_pages(spark, d), "card"), chosen)
    code = F.col("vendor_code").cast("long")
    cards = found.select(F.col("p_brand").alias("category"), F.concat("url", F.lit("/"), "vendor_code").alias("url"), "name", "price", "old_price", "vendor_code", "image_url", code.alias("arrival"))
    cards = cards.unionByName(cards.where("arrival % 7 = 0").withColumn("price", F.lit(1).cast("long")).withColumn("arrival", F.col("arrival") + 1_000_000_000))  # seen again further down
    folder = shared_folder(spark, "shop")
    shop = jobs.Shop(merge.product_table(spark, f"{folder}/products", 8), merge.price_log(spark, f"{folder}/log", 8), f"{folder}/anomalies")
    shop.products.create(spark.createDataFrame([], merge.PRODUCTS))
    shop.log.create(spark.createDataFrame([], merge.LOG))
    kinds = views.lineitem_view(spark, d).category
    first = jobs.crawl_job(shop, cards, kinds, datetime(2024, 1, 1))
    dearer = cards.where("category <> 'Brand#13'").withColumn("price", F.when(F.col("arrival") % 4 == 0, F.col("price") + 5).otherwise(F.col("price")))
    return first, jobs.crawl_job(shop, dearer, kinds, datetime(2024, 1, 2))


@query
def crawl_statuses(spark, d):
    return _crawls(spark, d)[1].categories


@query
def crawl_counts(spark, d):
    rows = [(i, c.created, c.updated, c.saved, c.unchanged, c.anomalies) for i, c in enumerate(_crawls(spark, d), 1)]
    return spark.createDataFrame(rows, "crawl int, created long, updated long, saved long, unchanged long, anomalies long")


@query
def page_blocked(spark, d):
    h = F.col("html")
    return views.read(spark, d, "pages").select("page_id", text.blocked_page(files.tag_text(h, "title"), h).alias("blocked"))


@query
def dedupe_first(spark, d):
    host = F.regexp_extract("url", r"://([^/?#]*)", 1)
    return files.first_seen(views.read(spark, d, "pages").select("page_id", "url", host.alias("host")), "host", "page_id")


@query
def api_products(spark, d):
    t = views.events_view(spark, d)
    return api.list_products(t.history, t.product, search="customer 1", page=2)


@query
def api_products_indexed(spark, d):
    t = views.events_view(spark, d)
    return api.list_products(t.history, t.product, search="customer 1", page=2, index=_index(spark, d, "name", "vendor_code"))


@query
def api_products_after(spark, d):
    """The second page, by the key of the last product on the first."""
    t = views.events_view(spark, d)
    first = api.list_products(t.history, t.product, search="customer 1").orderBy("name", "product_id")
    key = api.last_key(first, ("name", "product_id"))
    return api.list_products(t.history, t.product, search="customer 1", page=2, after=key) if key else first.limit(0)


@query
def api_products_by_parsed(spark, d):
    """The last parsed first, before them those that never were."""
    t = views.events_view(spark, d)
    parsed = F.when(F.col("product_id") % 40 != 0, F.date_add(F.lit(date(2024, 1, 1)), (F.col("product_id") % 50).cast("int")))
    return api.list_products(t.history, t.product.withColumn("last_parsed_at", parsed), order="-last_parsed_at")


@query
def alert_notifications(spark, d):
    """Alerts with whom they go to."""
    t = views.lineitem_view(spark, d)
    fired = ingest.check_alerts(t.history, views.subscriptions(spark, d), t.product)
    url = F.concat(F.lit("https://shop.example.com/p/"), F.col("product_id").cast("string"))
    return api.addressed(fired, views.users(spark, d), t.product.withColumn("url", url))


@query
def category_slugs(spark, d):
    """Slugs of nations, given for every other one."""
    given = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("n-"), F.col("n_nationkey").cast("string"))).when(F.col("n_nationkey") % 3 == 0, F.lit(""))
    return views.read(spark, d, "nation").select("n_nationkey", text.default_slug(given, F.concat(F.lit(" The "), "n_name", F.lit("! "))).alias("slug"))


@query
def iso_times(spark, d):
    """Times of the events printed with different offsets, and read again."""
    ts = F.col("ts").cast("timestamp_ntz")
    moved = F.when(F.col("event_id") % 3 == 0, F.concat(F.date_format(ts + F.expr("INTERVAL '3:30' HOUR TO MINUTE"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+03:30")))
    shown = moved.when(F.col("event_id") % 3 == 1, F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit("Z"))).otherwise(iso_text(ts))
    return views.read(spark, d, "events").select("event_id", shown.alias("shown")).select("event_id", "shown", iso_time(F.col("shown")).alias("ts"))


@query
def api_price_history(spark, d):
    t = views.events_view(spark, d)
    return api.product_prices(t.history, t.product, 3)


@query
def api_product_detail(spark, d):
    t = views.events_view(spark, d)
    return api.product_detail(t.history, t.product, 14)


@query
def api_inactive(spark, d):
    """What listings leave out."""
    return views.events_product(spark, d).where("not is_active").select("product_id", "name", "category")


@query
def api_anomalies(spark, d):
    _, found = _found(spark, d)
    return api.list_anomalies(found, severity="high").select("product_id", "anomaly_type", "severity", "ts")


@query
def api_subscriptions(spark, d):
    return api.list_subscriptions(views.subscriptions(spark, d), views.lineitem_view(spark, d).product, 10)


@query
def api_notifications(spark, d):
    t = views.lineitem_view(spark, d)
    return api.notifications(ingest.check_alerts(t.history, views.subscriptions(spark, d), t.product))


@query
def dashboard_summary(spark, d):
    t, found = _found(spark, d)
    return snapshot.dashboard_summary(t, found)


@query
def dashboard_kept(spark, d):
    """The same from a kept rollup, into which the events of the last week came by appends of a few days."""
    t, found = _found(spark, d)
    state = RollupTable(spark, shared_folder(spark, "rollup"))
    cuts = [detect.window_start(t.now, days) for days in (7, 4)]
    state.create(t.history.where(F.col("ts") < cuts[0]))
    state.append(t.history.where((F.col("ts") >= cuts[0]) & (F.col("ts") < cuts[1])))
    state.append(t.history.where(F.col("ts") >= cuts[1]))
    return snapshot.dashboard_summary(t, found, state)


@query
def dashboard_payload(spark, d):
    """The full snapshot's JSON read back: a row for each section with its items and the first one's key. What clusters hold is not SQL's to tell."""
    t, found = _found(spark, d)
    body = snapshot.snapshot(t, found, "full", t.now)
    part = lambda path: F.get_json_object("payload", f"$.{path}")
    sections = {
        "metrics": ("total_records", None), "category_index": ("[0].category", "category_index"), "deals_top": ("[0].product_id", "deals_top"), "heatmap": (".rows[0].product_id", "heatmap.rows"),
        "sensitivity": ("[0].product_id", "sensitivity"), "anomalies_summary": ("total", None), "currency_rates_latest": ("[0].currency", "currency_rates_latest"),
    }
    rows = [
        F.struct(F.lit(name).alias("section"), (F.json_array_length(part(many)) if many else F.lit(1)).cast("long").alias("items"), part(name + (key if key[0] in "[." else "." + key)).alias("first"))
        for name, (key, many) in sections.items()
    ]
    return body.select(F.inline(F.array(*rows)))


@query
def dashboard_sections(spark, d):
    """The full snapshot's JSON read back whole: a row for every number of every item of all sections but the clusters', which SQL cannot tell."""
    t, found = _found(spark, d)
    body = snapshot.snapshot(t, found, "full", t.now).select("payload")
    deal = "product_id: BIGINT, current_price: DOUBLE, min_price: DOUBLE, avg_price: DOUBLE, discount_pct: DOUBLE"
    index = "category: STRING, product_count: DOUBLE, mean_price: DOUBLE, median_price: DOUBLE, prev_mean: DOUBLE, prev_median: DOUBLE"
    metrics = "total_records: DOUBLE, unique_products: DOUBLE, total_products: DOUBLE, active_categories: DOUBLE, products_without_data: DOUBLE, avg_records_per_product: DOUBLE"
    schema = (
        f"deals_top ARRAY<STRUCT<{deal}>>, category_index ARRAY<STRUCT<{index}>>, metrics STRUCT<{metrics}>, sensitivity ARRAY<STRUCT<product_id: BIGINT, correlation: DOUBLE, sample_size: DOUBLE>>, "
        "heatmap STRUCT<rows: ARRAY<STRUCT<product_id: BIGINT, cells: ARRAY<STRUCT<date: STRING, price: DOUBLE, change_pct: DOUBLE>>>>>, "
        "anomalies_summary STRUCT<by_severity: MAP<STRING, DOUBLE>, by_type: MAP<STRING, DOUBLE>>, currency_rates_latest ARRAY<STRUCT<currency: STRING, date: STRING, rate: DOUBLE>>"
    )
    p = body.select(F.from_json("payload", schema).alias("p")).select("p.*")

    def rows(section: str, items: DataFrame, key, *fields: str) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(f).alias("field"), F.round(F.col(f).cast("double"), 6).alias("value")) for f in fields])
        return items.select(F.lit(section).alias("section"), key.cast("string").alias("item"), F.inline(cells))

    names = lambda s: [x.split(":")[0] for x in s.split(", ")]
    cells = p.select(F.explode("heatmap.rows").alias("r")).select("r.product_id", F.inline("r.cells"))
    counts = p.select(F.explode(F.map_concat("anomalies_summary.by_severity", "anomalies_summary.by_type")).alias("label", "n"))
    parts = [
        rows("deals_top", p.select(F.inline("deals_top")), F.col("product_id"), *names(deal)[1:]), rows("category_index", p.select(F.inline("category_index")), F.col("category"), *names(index)[1:]),
        rows("metrics", p.select("metrics.*"), F.lit(""), *names(metrics)), rows("sensitivity", p.select(F.inline("sensitivity")), F.col("product_id"), "correlation", "sample_size"),
        rows("heatmap", cells, F.concat_ws(" ", F.col("product_id").cast("string"), "date"), "price", "change_pct"), rows("anomalies_summary", counts, F.col("label"), "n"),
        rows("currency_rates_latest", p.select(F.inline("currency_rates_latest")), F.concat_ws(" ", "currency", "date"), "rate"),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


@query
def latest_rates(spark, d):
    return snapshot.latest_rates(views.events_rates(spark, d))


@query
def list_snapshots(spark, d):
    t, found = _found(spark, d)
    made = None
    for i, (kind, given) in enumerate((("index", {}), ("deals", {"limit": 100}), ("anomalies", {}), ("metrics", {}))):
        one = snapshot.snapshot(t, found, kind, t.now - timedelta(hours=i), **given).select("kind", "created_at", "summary")
        made = one if made is None else made.unionByName(one)
    return snapshot.list_snapshots(made, limit=3)


@query
def stream_change_log(spark, d):
    return streams.drained(streams.stream_change_log(streams.events_stream(spark, f"{d}/events.parquet")), shared_folder(spark, "stream"))


@query
def stream_daily_last(spark, d):
    """All days that the watermark, one day behind the newest row, has passed at the end."""
    return streams.drained(streams.stream_daily_last(streams.events_stream(spark, f"{d}/events.parquet")), shared_folder(spark, "stream"))


def _as_anomalies(df: DataFrame) -> DataFrame:
    """Every event as an anomaly of one of three types, sign-ups as resolutions."""
    kind = F.element_at(F.array(*[F.lit(x) for x in ("spike", "manipulation", "cyclic")]), (F.col("event_id") % 3 + 1).cast("int"))
    return df.select(F.col("user_id").alias("product_id"), kind.alias("anomaly_type"), F.col("ts").cast("timestamp").alias("detected_at"), (F.col("event_type") == "signup").alias("resolved"))


@query
def anomalies_once(spark, d):
    return detect.anomalies_once(_as_anomalies(views.read(spark, d, "events")))


@query
def stream_anomalies_once(spark, d):
    """The same as a stream, as far as the watermark has come at the end: an hour behind the newest row."""
    rows = _as_anomalies(streams.table_stream(spark, f"{d}/events.parquet"))
    return streams.drained(streams.stream_anomalies_once(rows), shared_folder(spark, "stream"))


def _alert_stream(spark, d) -> tuple[DataFrame, str]:
    """Alerts over the events as a stream that starts three times, each time with another third of them; then its last batch runs once more, as if its end had not been
    noted. Customers watch the products with their own number and the next."""
    subs, folder = views.event_subscriptions(spark, d), shared_folder(spark, "alerts")
    events = views.read(spark, d, "events").select(F.col("user_id").alias("product_id"), F.col("value").cast("decimal(12,2)").alias("price"), F.col("event_id").alias("arrival"))

    def run() -> None:
        stream = spark.readStream.schema(events.schema).parquet(f"{folder}/in")
        streams.stream_alerts(stream, subs, folder).start().awaitTermination()

    for third in range(3):
        events.where(F.col("arrival") % 3 == third).write.mode("append").parquet(f"{folder}/in")
        run()
    sinks.remove(spark, f"{folder}/checkpoint/commits/2")
    run()
    return subs, folder


@query
def stream_alerts(spark, d):
    _, folder = _alert_stream(spark, d)
    return streams.read_alerts(spark, folder)


@query
def stream_alerts_state(spark, d):
    subs, folder = _alert_stream(spark, d)
    return streams.open_subscriptions(subs, folder).select("user_id", "product_id", "is_active")
