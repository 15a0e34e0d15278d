"""Price reports: deals, category index, heat map, comparison, ingest metrics, anomaly report, price history."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formats import MINUTE, date_text
from ..functions.labels import direction, heat_indicator, label_of
from ..functions.series import current_point, current_rows, exact_medians, last_n, latest
from .detect import window_start
from .search import among


def _day(ts: datetime) -> F.Column:
    return F.lit(ts.date()).cast("date")


def best_deals(history: DataFrame, product: DataFrame, now: datetime, days: int = 30, limit: int = 20, category: str | None = None) -> DataFrame:
    """Current price below the window's mean, by rounded discount: the ``limit`` best. Products without rows in the window, or with a lowest
    price of 0 there, are left out; the current price may be older than the window.

    One aggregation on the product gives the current price and the window's figures together.
    """
    inside = F.col("ts") >= window_start(now, days)
    p = F.col("price")
    agg = history.groupBy("product_id").agg(
        current_point(history).alias("r"),
        F.min(F.when(inside, p)).alias("min_price"),
        (F.sum(F.when(inside, p)).cast("double") / F.count(F.when(inside, p))).alias("avg_price"),
    )
    return rank_deals(agg, product, limit, category)


def rank_deals(figures: DataFrame, product: DataFrame, limit: int = 20, category: str | None = None) -> DataFrame:
    """The ``limit`` best of products with their current point ``r`` and the window's ``min_price`` and ``avg_price``."""
    current = F.col("r.price")
    discount = F.round(F.try_divide(F.col("avg_price") - current.cast("double"), F.col("avg_price")) * 100, 1)
    items = product.where("is_active").where(F.col("category") == category) if category else product.where("is_active")
    out = (
        figures.where("r is not null and min_price <> 0 and avg_price <> 0").join(items.select("product_id", "name", "category"), "product_id")
        .select(
            "product_id", "name", "category", current.alias("current_price"), "min_price", F.round("avg_price", 2).alias("avg_price"),
            discount.alias("discount_pct"), (current <= F.col("min_price")).alias("at_min"),
        )
    )
    return out.orderBy(F.desc("discount_pct"), "product_id").limit(limit)


def active_categories(category: DataFrame) -> DataFrame:
    """The active rows of a table of categories; all where it does not tell."""
    return category.where("is_active") if "is_active" in category.columns else category


def category_index(history: DataFrame, product: DataFrame, now: datetime, period_days: int = 7, category: DataFrame | None = None) -> DataFrame:
    """Mean and exact median of current prices by category, of the active ones in ``category`` (name), against rows of the period before the last one. Products that
    are not active count. Without ``category`` all categories do, and NULL is one."""
    now_rows = latest(current_rows(history)).select("product_id", "price")
    return index_of(now_rows, history, product, now, period_days, category)


def index_of(current: DataFrame, history: DataFrame, product: DataFrame, now: datetime, period_days: int = 7, category: DataFrame | None = None) -> DataFrame:
    """The index from current prices (product_id, price) and the rows of ``history`` in the period before the last one. Prices count in hundredths."""
    lo, hi = window_start(now, 2 * period_days), window_start(now, period_days)
    past = history.where((F.col("ts") >= lo) & (F.col("ts") < hi)).select("product_id", "price", F.lit("p").alias("of"))
    items = product if category is None else product.join(active_categories(category).select(F.col("name").alias("category")), "category", "left_semi")
    rows = current.select("product_id", "price", F.lit("c").alias("of")).unionByName(past).join(items.select("product_id", "category"), "product_id")
    keys = [F.coalesce("category", F.lit("")).alias("category"), F.isnull("category").alias("nameless")]  # medians leave NULL keys out
    found = exact_medians(rows.select(*keys, "of", (F.col("price") * 100).cast("long").alias("v")), ["category", "nameless", "of"], "v")
    one = lambda of, c: F.max(F.when(F.col("of") == of, c))
    mean, median = F.try_divide(F.col("sum").cast("double"), F.col("n") * 100), F.col("median") / 100
    g = found.groupBy("category", "nameless").agg(
        one("c", F.col("n")).alias("product_count"), one("c", mean).alias("mean_price"), one("c", median).alias("median_price"), one("p", mean).alias("prev_mean"), one("p", median).alias("prev_median"),
    )
    pct = lambda a, b: F.when(F.col(b) > 0, F.round((F.col(a) - F.col(b)) / F.col(b) * 100, 4))
    return g.where("product_count > 0").select(
        F.when(~F.col("nameless"), F.col("category")).alias("category"), "product_count", F.round("mean_price", 4).alias("mean_price"), F.round("median_price", 4).alias("median_price"),
        F.round("prev_mean", 4).alias("prev_mean"), F.round("prev_median", 4).alias("prev_median"),
        pct("mean_price", "prev_mean").alias("mean_change_pct"), pct("median_price", "prev_median").alias("median_change_pct"),
    )


def heatmap(history: DataFrame, product: DataFrame, now: datetime, days: int = 7, max_products: int = 30) -> DataFrame:
    """Last price of each day for the first products by name, on every date of the window, with the change from the last date that has one.

    Long form. The calendar is a short array exploded per product, after the limit, so the grid is days x max_products.
    Products of the limit without any row in the window have no rows.
    """
    chosen = heat_products(product, max_products)
    inside = history.where(F.col("ts") >= window_start(now, days)).join(F.broadcast(chosen), "product_id")
    daily = inside.groupBy("product_id", F.to_date("ts").alias("date")).agg(F.max(F.struct("ts", "tie", "price"))["price"].cast("double").alias("price"), F.first("name").alias("name"))
    return heat_cells(daily, now, days)


def heat_products(product: DataFrame, max_products: int = 30) -> DataFrame:
    """The first active products by name."""
    return product.where("is_active").orderBy("name", "product_id").limit(max_products).select("product_id", "name")


def heat_cells(daily: DataFrame, now: datetime, days: int = 7) -> DataFrame:
    """The cells of products from their last prices of days (product_id, name, date, price): every date of the window looks its price up among the product's few days."""
    start = now - timedelta(days=days)
    prices = daily.groupBy("product_id").agg(F.first("name").alias("name"), F.map_from_entries(F.collect_list(F.struct("date", "price"))).alias("prices"))
    grid = prices.select("product_id", "name", "prices", F.explode(F.sequence(_day(start), _day(now))).alias("date"))
    before = Window.partitionBy("product_id").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    full = grid.select("product_id", "name", "date", F.col("prices")[F.col("date")].alias("price")).withColumn("prev", F.last("price", ignorenulls=True).over(before))
    change = F.when(F.col("price").isNotNull() & (F.col("prev") > 0), (F.col("price") - F.col("prev")) / F.col("prev") * 100)
    return full.select("product_id", "name", "date", "price", F.round(change, 4).alias("change_pct"), heat_indicator(change).alias("indicator"))


def compare_products(history: DataFrame, product: DataFrame, forecasts: DataFrame, ids: list[int], now: datetime, days: int = 30) -> DataFrame:
    """A row for each id in the given order, repeats included, unknown ids left out."""
    spark = history.sparkSession
    asked = spark.createDataFrame(list(enumerate(ids)), "position int, product_id long")
    wanted = sorted(set(ids))
    rows = history.where(F.col("product_id").isin(wanted))
    inside, p = F.col("ts") >= window_start(now, days), F.col("price")
    point = F.struct("ts", "tie", "price")
    agg = rows.groupBy("product_id").agg(
        current_point(history).alias("r"),
        F.min(F.when(inside, p)).alias("min_price"), F.max(F.when(inside, p)).alias("max_price"),
        F.try_divide(F.sum(F.when(inside, p)).cast("double"), F.count(F.when(inside, p))).alias("avg"),
        F.min(F.when(inside, point))["price"].cast("double").alias("first"), F.max(F.when(inside, point))["price"].cast("double").alias("last"),
        F.count(F.when(inside, p)).alias("n_records"),
    )
    next_ = forecasts.where("method = 'ARIMA'").groupBy("product_id").agg(F.min(F.struct("forecast_date", "predicted_price"))["predicted_price"].alias("forecast"))
    current = F.col("r.price")
    trend = F.when((F.col("n_records") >= 2) & (F.col("first") > 0), F.round((F.col("last") - F.col("first")) / F.col("first") * 100, 1))
    return (
        F.broadcast(asked).join(product.where(F.col("product_id").isin(wanted)), "product_id").join(agg, "product_id", "left").join(next_, "product_id", "left")
        .select(
            "position", "product_id", "name", "category", current.alias("current_price"), "min_price", "max_price",
            F.when(F.col("avg") != 0, F.round("avg", 4)).alias("avg_price"), trend.alias("trend_pct"),
            F.coalesce("n_records", F.lit(0)).alias("n_records"), F.col("forecast").alias("forecast_price"),
            direction(F.col("forecast"), current).alias("direction"),
        )
    )


def products_without_data(history: DataFrame, product: DataFrame) -> DataFrame:
    """Active products that never had a price."""
    return product.where("is_active").select("product_id", "category").join(history.select("product_id"), "product_id", "left_anti")


def ingest_metrics(history: DataFrame, product: DataFrame, category: DataFrame, now: datetime, days: int = 7) -> DataFrame:
    """One row on what arrived in the window."""
    w = history.where(F.col("ts") >= window_start(now, days)).agg(
        F.count("*").alias("total_records"), F.count_distinct("product_id").alias("unique_products"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )
    total = product.where("is_active").agg(F.count("*").alias("total_products"))
    cats = active_categories(category).agg(F.count("*").alias("active_categories"))
    without = products_without_data(history, product).agg(F.count("*").alias("products_without_data"))
    return metrics_of(w, total, cats, without)


def metrics_of(*rows: DataFrame) -> DataFrame:
    """Counts of one row each, side by side, with records a product."""
    one = F.lit(1).alias("_one")
    joined = rows[0].select("*", one)
    for other in rows[1:]:
        joined = joined.join(other.select("*", one), "_one")
    per = F.coalesce(F.round(F.try_divide(F.col("total_records").cast("double"), F.col("unique_products")), 1), F.lit(0.0))
    return joined.drop("_one").withColumn("avg_records_per_product", per)


def price_history(history: DataFrame, product: DataFrame, product_id: int, limit: int = 30) -> DataFrame:
    """The newest rows of one product in time order, each with its change from the row shown before it."""
    rows = last_n(history.where(F.col("product_id") == product_id), max(1, limit))
    w = Window.partitionBy("product_id").orderBy("ts", "tie")
    d = rows.withColumn("prev", F.lag("price").over(w)).withColumn("delta", F.col("price") - F.col("prev"))
    pct = F.round(F.try_divide(F.col("delta").cast("double"), F.col("prev").cast("double")) * 100, 4)
    return d.join(product.select("product_id", "name"), "product_id").select("product_id", "name", "ts", "price", "delta", pct.alias("delta_pct"))


def find_product(product: DataFrame, text: str, most: int = 5, index: DataFrame | None = None) -> DataFrame:
    """Products whose name holds ``text`` in any case, the first few by id: more than one means the name is not unique. ``index`` is a :func:`..operators.search.trigrams`
    table that finds the products to look at."""
    near = product if index is None else among(product, index, text)
    return near.where(F.contains(F.lower("name"), F.lit(text.lower()))).orderBy("product_id").limit(most).select("product_id", "name")


def one_product(product: DataFrame, *, product_id: int | None = None, slug: str | None = None, text: str | None = None, most: int = 5) -> int:
    """The id of the one product that a selector names: its id, its slug, or a part of its name. Anything but one selector and one product raises."""
    given = [x for x in (product_id, slug, text) if x is not None]
    if len(given) != 1:
        raise ValueError("name a product by its id, its slug or a part of its name: one of the three")
    if text is not None:
        found = find_product(product, text, most)
    else:
        found = product.where(F.col("product_id") == product_id if slug is None else F.col("slug") == slug).select("product_id", "name").limit(most)
    rows = found.collect()  # a few at most
    if len(rows) != 1:
        raise ValueError(f"{len(rows) or 'no'} products fit {given[0]!r}: {', '.join(str(r['name']) for r in rows)}")
    return rows[0]["product_id"]


def anomaly_report(anomalies: DataFrame, product: DataFrame, now: datetime, days: int = 7, severity: str | None = None, kind: str | None = None, category: str | None = None) -> DataFrame:
    """Anomalies of the window with product and category names, newest first."""
    rows = anomalies.where(F.col("detected_at") >= window_start(now, days))
    rows = rows.where(F.col("severity") == severity) if severity else rows
    rows = rows.where(F.col("anomaly_type") == kind) if kind else rows
    items = product.where(F.col("category") == category) if category else product
    return rows.join(items.select("product_id", "name", "category"), "product_id").select(
        "product_id", "name", F.coalesce("category", F.lit("")).alias("category"), "anomaly_type", "severity", "detected_at", "resolved",
        *[c for c in ("description",) if c in rows.columns],
    )


def anomaly_summary(anomalies: DataFrame, now: datetime, days: int = 7) -> DataFrame:
    """Counts by severity and by type in one scan."""
    rows = anomalies.where(F.col("detected_at") >= window_start(now, days))
    both = F.array(F.struct(F.lit("severity").alias("kind"), F.col("severity").alias("label")), F.struct(F.lit("type").alias("kind"), F.col("anomaly_type").alias("label")))
    return rows.select(F.inline(both)).groupBy("kind", "label").agg(F.count("*").alias("n"))


def report_lines(entries: DataFrame) -> DataFrame:
    """A report as text lines, newest first, for ``write.text``."""
    line = F.concat_ws(" ", F.date_format("detected_at", "yyyy-MM-dd HH:mm"), F.concat(F.lit("["), F.upper("severity"), F.lit("]")), "anomaly_type", "name", F.concat(F.lit("("), "category", F.lit(")")))
    return entries.orderBy(F.desc("detected_at"), "product_id", "anomaly_type").select(line.alias("value"))


#: Labels of the codes in reports.
TYPE_LABELS = {"spike": "sharp change", "manipulation": "rise before a discount", "cyclic": "cyclic change"}
SEVERITY_LABELS = {"high": "high", "medium": "medium", "low": "low"}


def report_text(entries: DataFrame, types: dict[str, str] = TYPE_LABELS, severities: dict[str, str] = SEVERITY_LABELS) -> DataFrame:
    """A whole report as ``value`` rows in order: a head, a block of lines for each anomaly, the newest first, and totals; one line where there is none.

    ``entries`` is :func:`anomaly_report`, with a ``description`` if there is one.
    """
    kind, grade = label_of(F.col("anomaly_type"), types), label_of(F.col("severity"), severities)
    about = F.col("description") if "description" in entries.columns else F.lit("")
    rows = entries.select("product_id", "name", "category", "anomaly_type", "detected_at", "resolved", kind.alias("kind"), grade.alias("grade"), about.alias("about"))
    block = F.concat_ws(
        "\n", F.concat(F.lit("\n["), F.upper("grade"), F.lit("] "), "kind"), F.concat(F.lit("  Product: "), "name", F.lit(" (id="), F.col("product_id").cast("string"), F.lit(")")),
        F.concat(F.lit("  Category: "), "category"), F.concat(F.lit("  Date: "), date_text(F.col("detected_at"), MINUTE)),
        F.concat(F.lit("  Status: "), F.when(F.col("resolved"), "resolved").otherwise("active")), F.concat(F.lit("  Description: "), F.coalesce("about", F.lit(""))),
    )
    body = rows.select(F.lit(1).alias("part"), F.col("detected_at").alias("at"), "product_id", "anomaly_type", block.alias("value"))
    # A few labels, so a map of counts is small.
    counted = rows.select(F.inline(F.array(F.struct(F.lit("t").alias("of"), F.col("kind").alias("label")), F.struct(F.lit("s").alias("of"), F.col("grade").alias("label"))))).groupBy("of", "label").count()
    text = F.concat("label", F.lit(": "), F.col("count").cast("string"))
    listed = lambda of: F.array_join(F.sort_array(F.collect_list(F.when(F.col("of") == of, text))), ", ")
    totals = counted.agg(listed("t").alias("types"), listed("s").alias("grades")).withColumn("_one", F.lit(1))
    n = rows.agg(F.count("*").alias("n"), F.count_if("resolved").alias("done")).withColumn("_one", F.lit(1)).join(totals, "_one")
    bar = F.lit("=" * 60)
    head = F.array(F.concat(F.lit("Anomaly report ("), F.col("n").cast("string"), F.lit(")")), bar)
    foot = F.array(
        F.concat(F.lit("\n"), bar), F.lit("Summary:"), F.concat(F.lit("  By type: "), "types"), F.concat(F.lit("  By severity: "), "grades"),
        F.concat(F.lit("  Active: "), (F.col("n") - F.col("done")).cast("string"), F.lit(", resolved: "), F.col("done").cast("string")),
    )
    none = F.array(F.lit("No anomalies in this period."))
    ends = n.select(F.explode(F.when(F.col("n") == 0, F.array(F.struct(F.lit(0).alias("part"), none.alias("lines")))).otherwise(
        F.array(F.struct(F.lit(0).alias("part"), head.alias("lines")), F.struct(F.lit(2).alias("part"), foot.alias("lines")))
    )).alias("e")).select("e.part", F.posexplode("e.lines").alias("at_line", "value"))
    body = body.withColumn("at_line", F.lit(0))
    whole = body.unionByName(ends, allowMissingColumns=True)
    return whole.orderBy("part", "at_line", F.desc("at"), "product_id", "anomaly_type").select("value")


def report_json(entries: DataFrame) -> DataFrame:
    """A report as JSON lines."""
    return entries.select(F.to_json(F.struct(*entries.columns)).alias("value"))


def latest_prices(history: DataFrame) -> DataFrame:
    return latest(history)
