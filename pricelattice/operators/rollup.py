"""A price history rolled up by product and day, from which reports come without reading the history again.

A row has the number of prices of a product on a day, their sum, lowest and highest, and the first and last point. Rows of one product and day merge by adding, taking
the least and the greatest, so appended prices are rolled up by themselves and merged into the days that they touch. Where a window
begins within a day, ``part`` tells that day's rows apart: it counts the window starts (``cuts``) that a row has passed.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

KEYS = ["product_id", "date", "part"]


def _at(cut: datetime) -> Column:
    return F.lit(cut).cast("timestamp_ntz")


def _passed(cuts: tuple[datetime, ...], reached) -> Column:
    return sum((reached(c).cast("int") for c in cuts), F.lit(0))


def daily_rollup(history: DataFrame, cuts: tuple[datetime, ...] = ()) -> DataFrame:
    """One aggregation, combined on the map side. Where the history marks actual rows, ``current`` is the last of these."""
    point = F.struct("ts", "tie", "price")
    actual = F.max(F.when(F.col("is_actual"), point)) if "is_actual" in history.columns else F.max(point)
    part = _passed(cuts, lambda c: F.col("ts") >= _at(c))
    return history.groupBy("product_id", F.to_date("ts").alias("date"), part.alias("part")).agg(
        F.count("price").alias("n"), F.sum("price").cast("decimal(28,2)").alias("total"), F.min("price").alias("lowest"), F.max("price").alias("highest"),
        F.min(point).alias("first"), F.max(point).alias("last"), actual.alias("current"),
    )


def merged(rows: DataFrame) -> DataFrame:
    """Rows of the same product, day and part as one."""
    return rows.groupBy(*KEYS).agg(
        F.sum("n").alias("n"), F.sum("total").cast("decimal(28,2)").alias("total"), F.min("lowest").alias("lowest"), F.max("highest").alias("highest"),
        F.min("first").alias("first"), F.max("last").alias("last"), F.max("current").alias("current"),
    )


@dataclass
class RollupTable:
    """Rollups by day at ``path``, a folder a date: appends read and rewrite the dates that they touch. A history whose rows change their ``is_actual`` is not
    for appends; one without it takes the newest row as current."""

    spark: SparkSession
    path: str

    def create(self, history: DataFrame) -> None:
        self._write(daily_rollup(history), "errorifexists")

    def _write(self, rows: DataFrame, mode: str) -> None:
        rows.repartition("date").write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def append(self, history: DataFrame) -> list:
        """Merge new rows in; returns the dates that were rewritten. New rows come once: counts add up."""
        new = daily_rollup(history)
        dates = sorted(r[0] for r in new.select("date").distinct().collect())  # days
        if dates:
            old = self.read().where(F.col("date").isin(dates))
            self._write(merged(old.unionByName(new)), "overwrite")
        return dates

    def windows(self, history: DataFrame, cuts: tuple[datetime, ...]) -> DataFrame:
        """The rollup with windows from ``cuts`` on: whole days as they are, and the days that a window begins in anew from ``history``, of which only they are read."""
        broken = F.col("date").isin([c.date() for c in cuts])
        whole = self.read().where(~broken).withColumn("part", _passed(cuts, lambda c: F.col("date") > F.lit(c.date())))
        inside = [(F.col("ts") >= F.lit(c.date()).cast("timestamp_ntz")) & (F.col("ts") < F.date_add(F.lit(c.date()), 1).cast("timestamp_ntz")) for c in cuts]
        return whole.unionByName(daily_rollup(history.where(reduce(or_, inside)), cuts))


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: what several reports read is made once, and outlives executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def daily_last(rollup: DataFrame, where: Column | None = None) -> DataFrame:
    """``product_id``, ``date``, ``price`` (the day's last, as double), ``rows`` of the days' rows that fit."""
    rows = rollup if where is None else rollup.where(where)
    return rows.groupBy("product_id", "date").agg(F.max("last")["price"].cast("double").alias("price"), F.sum("n").alias("rows"))


def product_figures(rollup: DataFrame, **parts: int) -> DataFrame:
    """A row a product: ``r`` (its current point), ``rows``, and for each window by name, whose rows have at least the part given, ``<name>_n``, ``<name>_total``,
    ``<name>_lowest``, ``<name>_first`` and ``<name>_last``."""
    aggs = [F.max("current").alias("r"), F.sum("n").alias("rows")]
    for name, part in parts.items():
        inside = lambda c, p=part: F.when(F.col("part") >= p, F.col(c))
        aggs += [
            F.coalesce(F.sum(inside("n")), F.lit(0)).alias(f"{name}_n"), F.sum(inside("total")).alias(f"{name}_total"), F.min(inside("lowest")).alias(f"{name}_lowest"),
            F.min(inside("first"))["ts"].alias(f"{name}_first"), F.max(inside("last"))["ts"].alias(f"{name}_last"),
        ]
    return rollup.groupBy("product_id").agg(*aggs)
