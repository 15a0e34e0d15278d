"""The incremental operators as Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.detect import first_of_runs
from ..sources.sinks import exists


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table's rows as they arrive: files of a folder, or one file, which its folder lists by name."""
    schema = spark.read.parquet(path).schema
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        reader, path = reader.option("pathGlobFilter", p.getName()), p.getParent().toString()
    return reader.parquet(path)


def events_stream(spark: SparkSession, path: str) -> DataFrame:
    """Price rows from the events table as they arrive."""
    return table_stream(spark, path).select(
        F.col("user_id").alias("product_id"), (F.floor(F.col("value") / 10) * 10).cast("long").alias("price"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("arrival")
    )


def stream_change_log(stream: DataFrame) -> DataFrame:
    """Only prices that differ from the product's last one, whatever batch that came in; the state is one number a product."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("arrival")
        before = state.get[0] if state.exists else None
        keep = rows["price"].ne(rows["price"].shift())
        keep.iloc[0] = before is None or rows["price"].iloc[0] != before
        state.update((int(rows["price"].iloc[-1]),))
        yield rows.loc[keep, ["product_id", "price", "arrival"]]

    return stream.groupBy("product_id").applyInPandasWithState(
        step, "product_id long, price long, arrival long", "price long", "append", GroupStateTimeout.NoTimeout
    )


def stream_daily_last(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """The last price of each product and day; days close when the watermark passes them."""
    return (
        stream.withWatermark("ts", late).groupBy("product_id", F.window("ts", "1 day").alias("w"))
        .agg(F.max(F.struct("ts", "arrival", "price"))["price"].alias("price")).select("product_id", F.to_date("w.start").alias("date"), "price")
    )


def stream_new_anomalies(stream: DataFrame, within: str = "24 hours") -> DataFrame:
    """Of anomalies (product_id, anomaly_type, detected_at, ...), those whose product and type had none ``within`` that time, whatever became of it, in order of arrival: the
    state is one entry for each such pair, and goes when the watermark passes it. :func:`stream_anomalies_once` is exact."""
    return stream.withWatermark("detected_at", within).dropDuplicatesWithinWatermark(["product_id", "anomaly_type"])


def stream_anomalies_once(stream: DataFrame, late: str = "1 hour", hours: int = 24) -> DataFrame:
    """What :func:`..operators.detect.anomalies_once` keeps of the same rows (product_id, anomaly_type, detected_at, resolved), in whatever order they arrive.

    A row waits in its key's state until the watermark, ``late`` behind the newest row, has passed it, so rows are judged in order of time. A timer wakes the key
    for that, and once more when its last anomaly is ``hours`` old: then the key's state goes. Rows that come later than ``late`` are dropped.
    """
    span = hours * 3_600_000_000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_at, times, kinds = state.get if state.exists else (None, [], [])
        rows = list(zip(times, kinds))
        for pdf in batches:
            rows += zip(pdf["detected_at"].astype("datetime64[us]").astype("int64").tolist(), pdf["resolved"].tolist())
        rows.sort()
        passed = state.getCurrentWatermarkMs() * 1000
        due = [r for r in rows if r[0] <= passed]
        kept, open_at = first_of_runs(due, open_at, span)
        rows = rows[len(due) :]
        if open_at is not None and open_at + span < passed:
            open_at = None
        if not rows and open_at is None:
            state.remove()
        else:
            state.update((open_at, [t for t, _ in rows], [k for _, k in rows]))
            state.setTimeoutTimestamp(max(passed // 1000 + 1, -(-(rows[0][0] if rows else open_at + span + 1) // 1000)))
        if kept:
            yield pd.DataFrame({"product_id": key[0], "anomaly_type": key[1], "detected_at": pd.to_datetime(kept, unit="us")})

    marked = stream.select("product_id", "anomaly_type", "detected_at", "resolved").withWatermark("detected_at", late)
    return marked.groupBy("product_id", "anomaly_type").applyInPandasWithState(
        step, "product_id long, anomaly_type string, detected_at timestamp", "open_at long, times array<long>, kinds array<boolean>", "append", GroupStateTimeout.EventTimeTimeout
    )


#: What each batch of alerts leaves, a folder each: the alerts, and the subscriptions that they switch off.
ALERTS, OFF = "user_id long, product_id long, current_price decimal(12,2), target_price decimal(12,2)", "user_id long, product_id long"


def _batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All batches' rows of one output, with their ``batch``."""
    schema += ", batch long"
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def alert_batch(subscriptions: DataFrame, folder: str):
    """A ``foreachBatch`` function: alerts for the batch's prices (product_id, price, arrival), once a subscription.

    A batch owns one folder of each output and overwrites it; it leaves out what batches before it have switched off, and reads nothing of its own. So a batch
    that runs again, after a crash between the two outputs or before Spark noted its end, leaves the same rows.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        prices = rows.groupBy("product_id").agg(F.max(F.struct("arrival", "price"))["price"].cast("decimal(12,2)").alias("current_price"))
        hits = subscriptions.where("is_active").join(prices, "product_id").where("current_price <= target_price")
        past = _batches(spark, f"{folder}/off", OFF).where(F.col("batch") < number).select("user_id", "product_id")
        new = hits.join(past, ["user_id", "product_id"], "left_anti")
        new.select("user_id", "product_id", "current_price", F.col("target_price").cast("decimal(12,2)").alias("target_price")).write.mode("overwrite").parquet(f"{folder}/alerts/batch={number}")
        fired = spark.read.schema(ALERTS).parquet(f"{folder}/alerts/batch={number}")
        fired.select("user_id", "product_id").write.mode("overwrite").parquet(f"{folder}/off/batch={number}")

    return batch


def stream_alerts(stream: DataFrame, subscriptions: DataFrame, folder: str):
    """Alerts once a subscription, exactly once whatever fails: :func:`alert_batch` for each batch, the outputs read by :func:`read_alerts` and
    :func:`open_subscriptions`."""
    return stream.writeStream.foreachBatch(alert_batch(subscriptions, folder)).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)


def read_alerts(spark: SparkSession, folder: str) -> DataFrame:
    """All alerts with the batch that they came in."""
    return _batches(spark, f"{folder}/alerts", ALERTS)


def open_subscriptions(subscriptions: DataFrame, folder: str) -> DataFrame:
    """The subscriptions as the batches so far have left them: those that fired are switched off."""
    off = _batches(subscriptions.sparkSession, f"{folder}/off", OFF).select("user_id", "product_id").withColumn("_off", F.lit(True))
    left = subscriptions.join(off, ["user_id", "product_id"], "left")
    return left.withColumn("is_active", F.col("is_active") & F.col("_off").isNull()).drop("_off")


def drained(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there, write it below ``folder`` and read it back."""
    q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").outputMode(mode)
    q.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")
