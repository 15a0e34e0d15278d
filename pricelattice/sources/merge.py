"""Parquet tables that merges change in part: rows lie in buckets by a hash of their keys, and a merge reads and rewrites only the buckets it touches."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ingest

BUCKET = "_bucket"


@dataclass
class MergeTable:
    """A table at ``path`` whose rows are found by ``keys``, in ``buckets`` folders. All users of one path take the same keys and number. A table that may be empty
    needs its ``schema`` (DDL), as it has no file to tell."""

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    buckets: int = 64
    schema: str | None = None

    def _dealt(self, df: DataFrame) -> DataFrame:
        return df.withColumn(BUCKET, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _write(self, df: DataFrame) -> None:
        # One task a bucket, so a bucket is one file; dynamic overwrite replaces the folders that have rows, after all of them are written elsewhere.
        self._dealt(df).repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)

    def create(self, df: DataFrame) -> None:
        """Write ``df`` as the whole table."""
        self._dealt(df).repartition(BUCKET).write.partitionBy(BUCKET).parquet(self.path)

    def _stored(self) -> DataFrame:
        reader = self.spark.read
        return (reader.schema(f"{self.schema}, {BUCKET} int") if self.schema else reader).parquet(self.path)

    def read(self) -> DataFrame:
        return self._stored().drop(BUCKET)

    def merge(self, new: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Replace the buckets that rows of ``new`` fall into by ``combine(old rows there, new)``, and return them. ``combine`` keeps keys in their bucket and
        removes none. A merge that breaks off leaves each bucket old or new; where ``combine`` gives the same on its own result, running it again completes it."""
        touched = sorted(r[0] for r in self._dealt(new).select(BUCKET).distinct().collect())  # numbers of buckets
        if touched:
            old = self._stored().where(F.col(BUCKET).isin(touched)).drop(BUCKET)
            self._write(combine(old, new).select(old.columns))
        return touched

    def upsert(self, new: DataFrame) -> dict[str, int]:
        """Rows of ``new``, one a key, replace those with their keys; how many keys were new and how many not."""
        seen = self._known(new)
        self.merge(new, lambda old, more: ingest.upsert(old, more, list(self.keys)))
        return seen

    def insert_missing(self, new: DataFrame) -> dict[str, int]:
        """Rows of ``new``, one a key, whose keys are not there yet; the others are left as they are."""
        seen = self._known(new)
        self.merge(new, lambda old, more: old.unionByName(more.join(old.select(*self.keys), list(self.keys), "left_anti")))
        return {"created": seen["created"], "skipped": seen["updated"]}

    def _known(self, new: DataFrame) -> dict[str, int]:
        touched = [r[0] for r in self._dealt(new).select(BUCKET).distinct().collect()]
        old = self._stored().where(F.col(BUCKET).isin(touched)).select(*self.keys, F.lit(True).alias("_known"))
        n = new.join(old, list(self.keys), "left").agg(F.count_if(F.col("_known").isNull()).alias("created"), F.count("_known").alias("updated")).first()
        return n.asDict()


LOG = "product_id long, price long, ts timestamp_ntz, arrival long, is_actual boolean, old_price long"
PRODUCTS = "url string, name string, category string, vendor_code string, image_url string, last_parsed_at timestamp_ntz, slug string, product_id long, is_active boolean"


def price_log(spark: SparkSession, path: str, buckets: int = 64) -> MergeTable:
    """The price log by product."""
    return MergeTable(spark, path, ("product_id",), buckets, LOG)


def product_table(spark: SparkSession, path: str, buckets: int = 64) -> MergeTable:
    """Products by url."""
    return MergeTable(spark, path, ("url",), buckets, PRODUCTS)


def append_prices(table: MergeTable, arrivals: DataFrame) -> list[int]:
    """Append what changes of ``arrivals`` (product_id, price, ts, arrival) to the log: only the arriving products' buckets are read. Arrivals up to a product's last
    logged one are known, so delivering them again changes nothing."""
    return table.merge(arrivals, ingest.append_changes)


def merge_products(table: MergeTable, parsed: DataFrame) -> list[int]:
    """Upsert products by url as :func:`..operators.ingest.upsert_products` does. Slugs are the table's, so new ones are held against the slugs of all buckets: one column
    is read of those that the merge does not touch."""
    slugs = table.read().select("slug")
    return table.merge(parsed, lambda old, new: ingest.upsert_products(old, new, taken=slugs).drop("created"))
