"""Readers for rates in XML, category lists in JSON and captured product pages."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import clean_price, first_digits, local_decimal, squeeze

CURRENCIES = ("USD", "EUR", "CNY")


def read_rates_xml(spark: SparkSession, path: str, day: Column | date, charset: str = "windows-1251") -> DataFrame:
    """Daily rates: one ``Valute`` element a currency, a decimal comma, a value for ``Nominal`` units."""
    rows = spark.read.format("xml").option("rowTag", "Valute").option("charset", charset).schema("CharCode string, Nominal string, Value string").load(path)
    return _rates(rows, F.lit(day))


def rates_from_xml_text(docs: DataFrame, xml: str = "xml", day: str = "date") -> DataFrame:
    """The same from a column of XML documents."""
    schema = "STRUCT<Valute: ARRAY<STRUCT<CharCode: STRING, Nominal: STRING, Value: STRING>>>"
    rows = docs.select(F.col(day).alias("_day"), F.explode(F.from_xml(F.col(xml), schema)["Valute"]).alias("v")).select("_day", "v.*")
    return _rates(rows, F.col("_day"))


def _rates(rows: DataFrame, day: Column) -> DataFrame:
    return rows.where(F.col("CharCode").isin(*CURRENCIES)).select(
        F.col("CharCode").alias("currency"), day.cast("date").alias("date"), local_decimal(F.col("Value"), F.col("Nominal")).alias("rate")
    )


def backfill_days(spark: SparkSession, today: date, days: int = 90) -> DataFrame:
    """The days that a backfill asks for, a partition's worth of requests each."""
    return spark.range(days).select(F.date_sub(F.lit(today), F.lit(days - 1) - F.col("id").cast("int")).alias("date"))


def read_categories_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of name, slug and source_path; anything else fails at once. ``arrival`` keeps the order in the file."""
    rows = spark.read.option("multiLine", True).option("mode", "FAILFAST").schema("name string, slug string, source_path string").json(path)
    return rows.withColumn("arrival", F.monotonically_increasing_id())


def class_text(html: Column, name: str) -> Column:
    """The text of the first element of a class; NULL without one."""
    t = F.regexp_extract(html, rf"(?is)class=[\"'][^\"']*\b{name}\b[^\"']*[\"'][^>]*>\s*([^<]*)", 1)
    return F.when(t != "", t)


def tag_text(html: Column, tag: str) -> Column:
    t = F.regexp_extract(html, rf"(?is)<{tag}[^>]*>([^<]*)</{tag}>", 1)
    return F.when(t != "", t)


@dataclass(frozen=True)
class Selectors:
    """Classes of the elements that hold a field on a site's pages, those to try first first. They differ from site to site, so none are built in."""

    name: tuple[str, ...] = ()
    price: tuple[str, ...] = ()
    old_price: tuple[str, ...] = ()
    code: tuple[str, ...] = ()


def split_cards(pages: DataFrame, card: str, html: str = "html") -> DataFrame:
    """A row for each card of a list page: every element of class ``card`` with what follows it up to the next; ``card_no`` counts from 0."""
    opening = rf"(?i)(?=<[a-z][a-z0-9]*\b[^>]*class=[\"'](?:[^\"']*\s)?{card}(?:\s[^\"']*)?[\"'])"
    parts = F.split(F.coalesce(F.col(html), F.lit("")), opening)
    has = F.filter(parts, lambda p: F.regexp_like(p, F.lit(rf"(?i)^<[a-z][a-z0-9]*\b[^>]*class=[\"'](?:[^\"']*\s)?{card}(?:\s[^\"']*)?[\"']")))
    return pages.select(*[c for c in pages.columns if c != html], F.posexplode(has).alias("card_no", html))


def extract_products(pages: DataFrame, selectors: Selectors = Selectors(), url: str = "url", html: str = "html") -> DataFrame:
    """Name, price, old price, code and image of captured pages or cards, each by a chain of fallbacks.

    The name comes from ``selectors``, else from the first heading or the title; a price from ``selectors``, else from the first text with a currency sign;
    the code from ``selectors``, else from the URL, its first digits; the image from the first ``src`` or ``data-src``. What is missing is NULL (a name: empty).
    """
    h = F.coalesce(F.col(html), F.lit(""))
    first = lambda names, of: F.coalesce(*[of(class_text(h, n)) for n in names], F.lit(None))
    signed = F.regexp_extract(h, r">([^<]*₽)", 1)
    image = F.regexp_extract(h, r"(?is)<img[^>]*\b(?:data-)?src=[\"']([^\"']+)", 1)
    digits = lambda c: F.nullif(first_digits(c), F.lit(""))
    return pages.select(
        *[c for c in pages.columns if c not in (url, html)], F.col(url).alias("url"),
        squeeze(F.coalesce(first(selectors.name, lambda c: c), tag_text(h, "h1"), tag_text(h, "title"), F.lit(""))).alias("name"),
        F.coalesce(first(selectors.price, clean_price), clean_price(signed)).alias("price"), first(selectors.old_price, clean_price).cast("bigint").alias("old_price"),
        F.coalesce(first(selectors.code, digits), first_digits(F.col(url))).alias("vendor_code"), F.nullif(image, F.lit("")).alias("image_url"),
    )


def first_seen(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key in arrival order."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
