"""Anomaly detectors over each product's newest rows.

Every detector reads ``recent_series``: one exchange on the product, then arrays of 14 points at most, on which
higher-order functions work without Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta
from math import pi

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formats import date_text, fixed, percent
from ..functions.labels import spike_severity
from ..functions.series import recent_series

SPIKE, RISE, SIMILAR = 0.10, 0.10, 0.7


def _at(i: Column | int) -> Column:
    return F.get("s", F.lit(i) if isinstance(i, int) else i)


def _spike(least_rows: int) -> Column:
    """The newest price against the one before, as a struct; NULL without a spike."""
    n = F.size("s")
    a, b = _at(n - 2), _at(n - 1)
    change = F.try_divide(F.abs(b["price"] - a["price"]), a["price"])
    days = F.abs(F.unix_micros(b["ts"].cast("timestamp")) - F.unix_micros(a["ts"].cast("timestamp"))) / 86_400e6
    return F.when(
        (n >= max(2, least_rows)) & (change > SPIKE),
        F.struct(
            spike_severity(change).alias("severity"), b["ts"].alias("ts"), a["price"].alias("previous"), b["price"].alias("current"), change.alias("change"),
            F.when(b["price"] > a["price"], "up").otherwise("down").alias("direction"), days.alias("days"), a["ts"].alias("previous_ts"),
        ),
    )


def detect_spike(series: DataFrame, least_rows: int = 2) -> DataFrame:
    """The newest price against the one before: a relative change above 10 % (exactly 10 % is none; a price before of 0 is skipped)."""
    hit = series.select("product_id", _spike(least_rows).alias("hit")).where("hit is not null")
    return hit.select("product_id", F.lit("spike").alias("anomaly_type"), "hit.*")


def past_similar_spike(spikes: DataFrame, history: DataFrame, older_than_days: int = 14, rows: int = 60) -> DataFrame:
    """For each spike, the first step of at least 0.7 times its change among the newest 60 rows older than 14 days."""
    newest = Window.partitionBy("product_id").orderBy(F.desc("ts"), F.desc("tie"))
    asc = Window.partitionBy("product_id").orderBy("ts", "tie")
    old = history.select("product_id", "ts", "tie", F.col("price").cast("double").alias("p"))
    s = spikes.select("product_id", F.col("ts").alias("spike_ts"), "change")
    near = (
        old.join(s, "product_id").where(F.col("ts") < F.col("spike_ts") - F.expr(f"INTERVAL {older_than_days} DAYS"))
        .withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= rows)
        .withColumn("before", F.lag("p").over(asc))
        .withColumn("step", F.try_divide(F.abs(F.col("p") - F.col("before")), F.col("before")))
        .where((F.col("before") != 0) & (F.col("step") >= SIMILAR * F.col("change")))
    )
    first = near.groupBy("product_id").agg(F.min(F.struct("ts", "tie", "step", "spike_ts", "change")).alias("m"))
    return first.select(
        "product_id", F.col("m.change").alias("change"), F.col("m.ts").alias("past_ts"), F.col("m.step").alias("past_change"),
        F.datediff(F.col("m.spike_ts"), F.col("m.ts")).alias("days_ago"),
    )


def spike_text(spikes: DataFrame, past: DataFrame | None = None) -> DataFrame:
    """``product_id`` and ``message`` for each spike; with :func:`past_similar_spike`, a hint to the change before it that was like it."""
    rise = F.col("direction") == "up"
    message = F.concat(
        F.lit("Sharp "), F.when(rise, "rise").otherwise("fall"), F.lit(" of "), percent(F.col("change")), F.lit(" in "), fixed(F.col("days"), 1), F.lit(" days: "),
        fixed(F.col("previous")), F.lit(" ("), date_text(F.col("previous_ts")), F.lit(") -> "), fixed(F.col("current")), F.lit(" ("), date_text(F.col("ts")), F.lit(")"),
    )
    if past is None:
        return spikes.select("product_id", message.alias("message"))
    hint = F.concat(F.lit(". A change of "), percent(F.col("past_change")), F.lit(" like it came on "), date_text(F.col("past_ts")), F.lit(" ("), F.col("days_ago").cast("string"), F.lit(" days before)"))
    both = spikes.join(past.select("product_id", "past_change", "past_ts", "days_ago"), "product_id", "left")
    return both.select("product_id", F.concat(message, F.coalesce(hint, F.lit(""))).alias("message"))


def _manipulation() -> Column:
    """The first rise above a base with a fall below it after, as a struct; NULL without one."""
    n = F.size("s")

    def fires(i: Column) -> Column:
        base, after = _at(i)["price"], _at(i + 3)["price"]
        peak = F.greatest(_at(i + 1)["price"], _at(i + 2)["price"])
        return (base != 0) & (F.try_divide(peak - base, base) >= RISE) & (after < base)

    def figures(i: Column) -> Column:
        peak_at = F.when(_at(i + 1)["price"] >= _at(i + 2)["price"], i + 1).otherwise(i + 2)
        return F.struct(
            F.lit("high").alias("severity"), _at(i + 3)["ts"].alias("ts"), _at(i)["price"].alias("base"), _at(peak_at)["price"].alias("peak"),
            _at(i + 3)["price"].alias("after"), i.cast("int").alias("position"),
        )

    where = F.filter(F.sequence(F.lit(0), F.greatest(n - 4, F.lit(0))), fires)
    return F.when(n >= 4, F.get(F.transform(F.slice(where, 1, 1), figures), F.lit(0)))


def detect_manipulation(series: DataFrame) -> DataFrame:
    """A rise of 10 % or more above a base within two rows, then a price below the base: the first such four rows."""
    hit = series.select("product_id", _manipulation().alias("hit")).where("hit is not null")
    return hit.select("product_id", F.lit("manipulation").alias("anomaly_type"), "hit.*")


def _with_cycle(series: DataFrame) -> DataFrame:
    """``series`` with ``cycle``, a struct on its dominant frequency; NULL without one. The steps are columns, so each is worked out once."""
    n = F.size("s")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    line = lambda i: _at(0)["price"] + (_at(n - 1)["price"] - _at(0)["price"]) * i / (n - 1)
    d = series.withColumn("_x", F.when(n >= 6, F.transform("s", lambda x, i: x["price"] - line(i))))
    d = d.withColumn("_mean", total(F.col("_x")) / n)
    d = d.withColumn("_std", F.sqrt(total(F.transform("_x", lambda v: (v - F.col("_mean")) * (v - F.col("_mean")))) / n))

    def amplitude(k: Column) -> Column:
        part = lambda f: total(F.transform("_x", lambda v, t: v * f(2 * pi * k * t / n)))
        return F.sqrt(F.pow(part(F.cos), 2) + F.pow(part(F.sin), 2))

    d = d.withColumn("_amps", F.when(F.col("_std") >= 1.0, F.transform(F.sequence(F.lit(1), F.floor(n / 2).cast("int")), amplitude)))
    d = d.withColumn("_sum", total(F.col("_amps"))).withColumn("_top", F.array_max("_amps"))
    ratio = F.try_divide(F.col("_top"), F.col("_sum"))
    k = F.array_position("_amps", F.col("_top"))
    span = F.unix_micros(_at(n - 1)["ts"].cast("timestamp")) - F.unix_micros(_at(0)["ts"].cast("timestamp"))
    cycle = F.struct(
        F.lit("low").alias("severity"), _at(n - 1)["ts"].alias("ts"), ratio.alias("ratio"), (n / k).alias("period_rows"), (span / 86_400e6 / k).alias("period_days")
    )
    return d.withColumn("cycle", F.when((F.col("_sum") >= 1e-6) & (ratio > 0.3), cycle)).drop("_x", "_mean", "_std", "_amps", "_sum", "_top")


def detect_cyclic(series: DataFrame) -> DataFrame:
    """A dominant frequency in six rows or more, detrended by the line through the first and last value: the largest amplitude
    of the spectrum without its mean is more than 0.3 of their sum."""
    hit = _with_cycle(series).where("cycle is not null")
    return hit.select("product_id", F.lit("cyclic").alias("anomaly_type"), "cycle.*")


def full_detection(history: DataFrame, detected_at: datetime, recent: int = 14, least_rows: int = 3) -> DataFrame:
    """Spike, manipulation and cyclic anomalies of all products with three rows or more: one scan, one exchange, all detectors on each row."""
    s = _with_cycle(recent_series(history, recent).where(F.size("s") >= least_rows))
    s = s.select("product_id", _spike(least_rows).alias("spike"), _manipulation().alias("manipulation"), "cycle")
    one = lambda name, hit, metric: F.when(F.col(hit).isNotNull(), F.struct(F.lit(name).alias("anomaly_type"), F.col(hit)["severity"].alias("severity"), F.col(hit)["ts"].alias("ts"), metric.alias("metric")))
    rise = F.try_divide(F.col("manipulation.peak") - F.col("manipulation.base"), F.col("manipulation.base"))
    found = s.select("product_id", F.inline(F.array_compact(F.array(
        one("spike", "spike", F.col("spike.change")), one("manipulation", "manipulation", rise), one("cyclic", "cycle", F.col("cycle.ratio"))
    ))))
    return found.withColumn("detected_at", F.lit(detected_at).cast("timestamp_ntz")).withColumn("resolved", F.lit(False))


def new_anomalies(found: DataFrame, known: DataFrame, hours: int = 24) -> DataFrame:
    """Those of ``found`` without an unresolved one of the same product and type in the last day."""
    k = known.where(~F.col("resolved")).select("product_id", "anomaly_type", F.col("detected_at").alias("known_at"))
    f, k = found.alias("f"), k.alias("k")
    same = (F.col("f.product_id") == F.col("k.product_id")) & (F.col("f.anomaly_type") == F.col("k.anomaly_type"))
    return f.join(k, same & (F.col("k.known_at") >= F.col("f.detected_at") - F.expr(f"INTERVAL {hours} HOURS")), "left_anti")


def first_of_runs(rows: list[tuple[int, bool]], open_at: int | None, span: int) -> tuple[list[int], int | None]:
    """Of rows (time, resolved) in order, the times of anomalies that none within ``span`` before them, kept and unresolved, stands for; and the last such one
    that is still open. ``open_at`` is the one left by the rows before."""
    kept = []
    for t, resolved in rows:
        if resolved:
            open_at = None
        elif open_at is None or t - open_at > span:
            kept.append(t)
            open_at = t
    return kept, open_at


def anomalies_once(events: DataFrame, hours: int = 24) -> DataFrame:
    """Anomalies (product_id, anomaly_type, detected_at, resolved) in order of time: one is kept unless its product and type have a kept and unresolved one in the
    ``hours`` before, the end included. A row with ``resolved`` resolves those; at one time anomalies come first.

    Rows are walked in order, one key's in one task; a key's open anomaly is all that is held.
    """
    span = hours * 3_600_000_000
    cols = ["product_id", "anomaly_type", "at", "resolved"]
    rows = events.select("product_id", "anomaly_type", F.unix_micros(F.col("detected_at").cast("timestamp")).alias("at"), F.coalesce("resolved", F.lit(False)).alias("resolved"))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before, open_at = None, None
        for pdf in batches:
            out = []
            for key, part in pdf.groupby(["product_id", "anomaly_type"], sort=False, dropna=False):
                same = before is not None and key == before
                kept, open_at = first_of_runs(list(zip(part["at"].tolist(), part["resolved"].tolist())), open_at if same else None, span)
                before = key
                out += [(*key, t) for t in kept]
            yield pd.DataFrame(out, columns=["product_id", "anomaly_type", "at"])

    kept = rows.repartition("product_id", "anomaly_type").sortWithinPartitions(*cols).mapInPandas(walk, "product_id long, anomaly_type string, at long")
    return kept.select("product_id", "anomaly_type", F.timestamp_micros("at").alias("detected_at"))


def window_start(now: datetime, days: int) -> Column:
    return F.lit(now - timedelta(days=days)).cast("timestamp_ntz")
