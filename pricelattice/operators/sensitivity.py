"""How product prices move with a currency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.formats import date_text, fixed
from ..functions.labels import corr_verdict
from ..functions.stats import pearson, student_p


def fx_sensitivity(history: DataFrame, product: DataFrame, rates: DataFrame, currency: str = "USD", least_rows: int = 5, least_dates: int = 5, limit: int | None = None) -> DataFrame:
    """Pearson correlation of each product's last price a day with the currency's rate, on common dates.

    ``limit`` takes the first products by id before anything else. The strongest correlation comes first, undefined ones last. The rates of one currency, a row a
    day, are broadcast.
    """
    items = sensitive_products(product, limit)
    return sensitivity_of(last_prices(history.join(items, "product_id", "left_semi")), items, rates, currency, least_rows, least_dates)


def sensitive_products(product: DataFrame, limit: int | None = None) -> DataFrame:
    """Active products, the first ``limit`` by id."""
    items = product.where("is_active").select("product_id", "name")
    return items.orderBy("product_id").limit(limit) if limit else items


def last_prices(history: DataFrame) -> DataFrame:
    """The last price of each product and day, with its number of rows. Rows of no product are left out."""
    return history.where("product_id is not null").groupBy("product_id", F.to_date("ts").alias("date")).agg(
        F.max(F.struct("ts", "tie", "price"))["price"].cast("double").alias("price"), F.count("*").alias("rows")
    )


def correlations(daily: DataFrame, rates: DataFrame, currency: str = "USD", least_rows: int = 5, least_dates: int = 5) -> DataFrame:
    """Correlation, p-value, number and bounds of common dates of every product in last prices of days (product_id, date, price, rows): one aggregation gives a
    product's rows, on all dates, and the correlation on common ones."""
    fx = rates.where(F.col("currency") == currency).select("date", F.col("rate").cast("double").alias("r"))
    both = daily.join(F.broadcast(fx), "date", "left").withColumn("p", F.when(F.col("r").isNotNull(), F.col("price")))
    common = F.when(F.col("r").isNotNull(), F.col("date"))
    g = both.groupBy("product_id").agg(
        F.sum("rows").alias("rows"), pearson("p", "r").alias("correlation"), F.count("r").alias("sample_size"), F.min(common).alias("first"), F.max(common).alias("last")
    ).where((F.col("rows") >= least_rows) & (F.col("sample_size") >= least_dates))
    return g.select("product_id", "correlation", student_p(F.col("correlation"), F.col("sample_size")).alias("p_value"), "sample_size", "first", "last")


def sensitivity_of(daily: DataFrame, items: DataFrame, rates: DataFrame, currency: str = "USD", least_rows: int = 5, least_dates: int = 5) -> DataFrame:
    """``fx_sensitivity`` from last prices of days (product_id, date, price, rows), of the products in ``items`` (product_id, name)."""
    found = correlations(daily, rates, currency, least_rows, least_dates).join(items, "product_id")
    detail = F.concat(
        F.lit("Pearson correlation "), fixed(F.col("correlation"), 3), F.lit(" (p="), fixed(F.col("p_value"), 4), F.lit("), "), date_text(F.col("first")), F.lit(" to "),
        date_text(F.col("last")), F.lit(", "), F.col("sample_size").cast("string"), F.lit(" common dates. "), F.initcap("verdict"), F.lit(f": as {currency} rises, the price "),
        F.when(F.col("correlation") > 0, "rises").otherwise("falls"),
    )
    out = found.select("product_id", "name", "correlation", "p_value", "sample_size", corr_verdict(F.col("correlation")).alias("verdict"), "first", "last")
    return out.withColumn("detail", detail).drop("first", "last").orderBy(F.abs("correlation").desc_nulls_last(), "product_id")
