"""Where results go: tables that grow by appends, and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at ``path``, in whatever file system it lies."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def remove(spark: SparkSession, path: str) -> None:
    """Remove the file or folder at ``path``, if it is there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def append_rows(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Append prices, anomalies or snapshots to the Parquet table at ``path``."""
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def write_report(lines: DataFrame, path: str, form: str = "text") -> None:
    """Write the ``value`` lines of a report in their order, as UTF-8 text or JSON lines, to one file below ``path``."""
    if form not in ("text", "json"):
        raise ValueError(f"no report form {form}")
    # A report is read as one file; its rows are those of a bounded window of days.
    lines.select("value").coalesce(1).write.mode("overwrite").text(path)
