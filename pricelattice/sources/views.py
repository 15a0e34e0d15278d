"""Canonical price tables over the star-schema test tables.

``events_view``: a month of unique timestamps a product; ``lineitem_view``: seven years of days with ties.
Some products, categories and subscriptions are not active. Every price history has product_id, price decimal(12,2), ts and tie (a total order with ts).
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class PriceTables:
    """A price history with its dimensions and its ``now``, the newest timestamp."""

    history: DataFrame
    product: DataFrame
    category: DataFrame
    rates: DataFrame
    now: datetime


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the test tables."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def newest(df: DataFrame, ts: str = "ts") -> datetime:
    """The newest timestamp; Parquet statistics answer it without a scan of rows."""
    return df.agg(F.max(ts).alias("m")).first()["m"]


def raw_events_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("product_id"), F.col("value").cast("decimal(12,2)").alias("price"), "ts", F.col("event_id").alias("tie")
    )


def events_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("product_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("category"),
        F.concat(F.lit("V"), F.col("c_custkey").cast("string")).alias("vendor_code"),
        F.concat(F.lit("https://shop.example.com/p/"), F.col("c_custkey").cast("string")).alias("url"), (F.col("c_acctbal") >= 0).alias("is_active"),
    )


def events_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.when(F.col("event_type") == "purchase", "USD").when(F.col("event_type") == "view", "EUR").when(F.col("event_type") == "click", "CNY")
    return (
        read(spark, sf_dir, "events").select(code.alias("currency"), F.to_date("ts").alias("date"), F.col("value").cast("decimal(12,2)").alias("v"))
        .where("currency is not null").groupBy("currency", "date")
        .agg((F.sum("v").cast("double") / F.count("v")).cast("decimal(10,4)").alias("rate"))
    )


def events_view(spark: SparkSession, sf_dir: str) -> PriceTables:
    raw = raw_events_history(spark, sf_dir)
    product = events_product(spark, sf_dir)
    category = product.select(F.col("category").alias("name")).distinct().withColumn("is_active", F.col("name") != "MACHINERY")
    return PriceTables(raw, product, category, events_rates(spark, sf_dir), newest(raw))


def lineitem_view(spark: SparkSession, sf_dir: str) -> PriceTables:
    raw = read(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("product_id"), F.col("l_extendedprice").cast("decimal(12,2)").alias("price"), F.col("l_shipdate").alias("ts"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("tie"),
    )
    product = read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("category"), (F.col("p_size") > 5).alias("is_active")
    )
    code = F.create_map(*[F.lit(x) for x in ("O", "USD", "F", "EUR", "P", "CNY")])[F.col("o_orderstatus")]
    rates = (
        read(spark, sf_dir, "orders").select(code.alias("currency"), F.to_date("o_orderdate").alias("date"), F.col("o_totalprice").cast("decimal(14,2)").alias("v"))
        .groupBy("currency", "date").agg((F.sum("v").cast("double") / F.count("v") / 1000).cast("decimal(10,4)").alias("rate"))
    )
    return PriceTables(raw, product, product.select(F.col("category").alias("name")).distinct().withColumn("is_active", F.col("name") != "Brand#55"), rates, newest(raw))


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who watches which part, and from what price on: 25 times the retail price. Every seventh is switched off."""
    pairs = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("product_id")
    ).distinct()
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), (F.col("p_retailprice") * 25).cast("decimal(12,2)").alias("target_price"))
    return pairs.join(part, "product_id").select("user_id", "product_id", "target_price", ((F.col("user_id") + F.col("product_id")) % 7 != 0).alias("is_active"))


def event_subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who watches which product of the events' view: everyone the one with their own number and the one after it, at a price from their balance."""
    c = read(spark, sf_dir, "customer")
    target = (F.abs("c_acctbal") / 100).cast("decimal(12,2)").alias("target_price")
    watched = c.select(F.col("c_custkey").alias("user_id"), F.explode(F.array("c_custkey", F.col("c_custkey") + 1)).alias("product_id"), target)
    return watched.withColumn("is_active", F.col("user_id") % 5 != 0)


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who subscribes: the customers."""
    name = F.lower("c_name")
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), name.alias("username"), F.concat(F.replace(name, F.lit("#"), F.lit(".")), F.lit("@example.com")).alias("email"))
