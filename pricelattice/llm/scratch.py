"""Folders for tables between the steps of a job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_folder

__all__ = ["drop", "shared_folder", "stored"]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new shared folder and read it back: it cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._stored_at = path
    return back


def drop(*tables: DataFrame) -> None:
    """Remove the folders of tables from :func:`stored` that nothing reads any more, in whatever file system they lie."""
    for df in tables:
        spark = df.sparkSession
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
