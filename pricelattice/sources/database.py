"""Tables of a relational database, read in parallel; filters and columns reach the database."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, url: str, table: str, *, key: str | None = None, rows_a_part: int = 1_000_000, most_parts: int = 64, fetch: int = 10_000, **options: str) -> DataFrame:
    """``table`` of the database at ``url``. With a numeric ``key`` it is read in ranges of it, one query each, about ``rows_a_part`` rows and ``most_parts``
    connections at most; the database tells the key's bounds and the number of rows first. Rows with a NULL key come with the first range.

    ``where`` and ``select`` on the result go to the database, as do aggregates without ``key``. ``options`` (user, password, driver) are Spark's.
    """
    base = {"url": url, "fetchsize": str(fetch), "pushDownPredicate": "true", "pushDownAggregate": "true", "pushDownLimit": "true"} | options
    whole = spark.read.format("jdbc").options(**base, dbtable=table)
    if key is None:
        return whole.load()
    ask = f"(SELECT MIN({key}) AS lo, MAX({key}) AS hi, COUNT(*) AS n FROM {table}) bounds"
    lo, hi, n = spark.read.format("jdbc").options(**base, dbtable=ask).load().first()
    parts = min(most_parts, -(-n // rows_a_part), (int(hi) - int(lo) + 1) if n and lo is not None else 1)
    if parts < 2:
        return whole.load()
    return whole.options(partitionColumn=key, lowerBound=str(int(lo)), upperBound=str(int(hi) + 1), numPartitions=str(parts)).load()


def write_table(df: DataFrame, url: str, table: str, mode: str = "append", batch: int = 10_000, **options: str) -> None:
    """Write rows to a table, each task over a connection of its own. A task that runs again writes its rows again, so keys should be the database's to check."""
    df.write.format("jdbc").options(url=url, dbtable=table, batchsize=str(batch), **options).mode(mode).save()
