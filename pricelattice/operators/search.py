"""Substring search through an index of trigrams: the words' postings name the rows to look at, the exact search decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import search_terms

#: Folders of a kept index.
BUCKETS = 32


def _grams(text: Column) -> Column:
    """The different runs of three characters of a lower-cased text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_distinct(F.when(F.length(low) >= 3, F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substring(low, i, F.lit(3)))).otherwise(F.array().cast("array<string>")))


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def trigrams(product: DataFrame, *fields: str) -> DataFrame:
    """``gram``, ``product_id`` and ``bucket``, once for each product that has the trigram in one of the fields."""
    all_ = F.array_distinct(F.concat(*[_grams(F.col(f)) for f in fields]))
    rows = product.select("product_id", F.explode(all_).alias("gram"))
    return rows.select("gram", "product_id", _bucket(F.col("gram")).alias("bucket"))


def write_index(index: DataFrame, path: str) -> None:
    """Keep an index: a folder a bucket, grams in order within, so that a search opens its grams' folders and skips most of their rows."""
    index.repartition("bucket").sortWithinPartitions("gram", "product_id").write.partitionBy("bucket").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("gram string, product_id long, bucket int").parquet(path)


def candidates(index: DataFrame, search: str) -> DataFrame | None:
    """``product_id`` of the products that have all trigrams of every term, so all that match and some more; None where no term has three characters."""
    spark = index.sparkSession
    terms = [t.lower() for t in search_terms(search)]
    grams = sorted({t[i : i + 3] for t in terms for i in range(len(t) - 2)})
    if not grams:
        return None
    buckets = [r[0] for r in spark.createDataFrame([(g,) for g in grams], "gram string").select(_bucket(F.col("gram"))).distinct().collect()]
    near = index.where(F.col("bucket").isin(buckets) & F.col("gram").isin(grams))
    return near.groupBy("product_id").agg(F.count("*").alias("n")).where(F.col("n") == len(grams)).select("product_id")


def among(product: DataFrame, index: DataFrame, search: str) -> DataFrame:
    """The products that the index names for a search; all where it has nothing to look up."""
    found = candidates(index, search)
    return product if found is None else product.join(found, "product_id", "left_semi")
