"""Windows over price series: one exchange and sort on the product serve them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def newest_first(key: str = "product_id") -> WindowSpec:
    return Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("tie"))


def oldest_first(key: str = "product_id") -> WindowSpec:
    return Window.partitionBy(key).orderBy("ts", "tie")


def mark_actual(history: DataFrame, key: str = "product_id") -> DataFrame:
    """``is_actual``: the newest row of each product. For listings that show it; reports take :func:`current_point`."""
    return history.withColumn("is_actual", F.row_number().over(newest_first(key)) == 1)


def current_rows(history: DataFrame) -> DataFrame:
    """The rows among which each product's newest is its current one: those that a change log marks actual, or all."""
    return history.where("is_actual") if "is_actual" in history.columns else history


def current_point(history: DataFrame) -> Column:
    """An aggregate: the current row of a product as a struct of (ts, tie, price). It combines on the map side and needs no sort."""
    point = F.struct("ts", "tie", "price")
    return F.max(F.when(F.col("is_actual"), point) if "is_actual" in history.columns else point)


def latest(history: DataFrame, key: str = "product_id") -> DataFrame:
    """The newest row of each key, by aggregation: partial maxima on the map side, no sort."""
    row = F.struct("ts", "tie", "price")
    return history.groupBy(key).agg(F.max(row).alias("r")).select(key, F.col("r.price").alias("price"), F.col("r.ts").alias("ts"))


def last_n(history: DataFrame, n: int, key: str = "product_id") -> DataFrame:
    """The newest n rows of each key with ``rn`` (1: newest); the rank limit is pushed below the exchange."""
    return history.withColumn("rn", F.row_number().over(newest_first(key))).where(F.col("rn") <= n)


def recent_series(history: DataFrame, n: int = 14, key: str = "product_id") -> DataFrame:
    """``s``: the newest n rows of each key in time order as structs of (ts, tie, price as double)."""
    point = F.struct("ts", "tie", F.col("price").cast("double").alias("price"))
    return last_n(history, n, key).groupBy(key).agg(F.sort_array(F.collect_list(point)).alias("s"))


def step_change(price: Column, before: Column) -> Column:
    """Relative change from a positive price before, else 0."""
    return F.when(before > 0, (price - before) / before).otherwise(F.lit(0.0))


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(a, b)


def mean_price(price: str = "price") -> Column:
    """The mean as sum / count: ``avg`` of a decimal would drop digits."""
    return F.sum(price).cast("double") / F.count(price)


def exact_medians(rows: DataFrame, keys: list[str], value: str, low_bits: int = 20) -> DataFrame:
    """``keys``, ``n``, ``sum``, ``median`` (double) of whole numbers ``value``, by selection in two rounds: no task holds a group.

    Equal values are counted first, on the map side; counts by the values' high bits name the ranges that hold the middle, and only those ranges' values are put in
    order. So a task sees as many different ranges, or values of one range, as their bits allow. NULL values and keys are left out.
    """
    counted = rows.groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_c")).where("_v is not null")
    high = F.shiftright("_v", low_bits)
    ranges = counted.groupBy(*keys, high.alias("_high")).agg(F.sum("_c").alias("_c"), F.sum(F.col("_v").cast("decimal(38,0)") * F.col("_c")).alias("_s"))
    upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_high").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    all_ = Window.partitionBy(*keys)
    placed = ranges.select(*keys, "_high", F.col("_c").alias("_in"), upto.alias("_upto"), F.sum("_c").over(all_).alias("n"), F.sum("_s").over(all_).alias("sum"))
    lower, upper = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)  # places of the middle, from 0
    middle = placed.where((F.col("_upto") > lower) & (F.col("_upto") - F.col("_in") <= upper)).withColumn("_before", F.col("_upto") - F.col("_in"))
    inside = counted.withColumn("_high", high).join(middle.drop("_upto", "_in"), [*keys, "_high"])
    run = F.col("_before") + F.sum("_c").over(Window.partitionBy(*keys, "_high").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return inside.withColumn("_run", run).groupBy(*keys).agg(
        F.first("n").alias("n"), F.first("sum").alias("sum"),
        ((F.min(F.when(F.col("_run") > lower, F.col("_v"))).cast("double") + F.min(F.when(F.col("_run") > upper, F.col("_v"))).cast("double")) / 2).alias("median"),
    )
