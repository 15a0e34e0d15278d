"""Buckets and verdicts as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .formats import signed

#: Edges of the heat map's buckets and of the correlation verdicts.
HEAT_STRONG, HEAT_WEAK = 5.0, 0.5
STRONG, MODERATE, WEAK = 0.7, 0.4, 0.2


def heat_indicator(change: Column) -> Column:
    """Bucket of a day's change in per cent; NULL: no data."""
    return (
        F.when(change.isNull(), "none").when(change > HEAT_STRONG, "up2").when(change > HEAT_WEAK, "up1")
        .when(change < -HEAT_STRONG, "down2").when(change < -HEAT_WEAK, "down1").otherwise("flat")
    )


#: What stands for each bucket before the change in per cent.
HEAT_MARKS = {"up2": "▲▲", "up1": " ▲", "down2": "▼▼", "down1": " ▼", "flat": "  ●"}
HEAT_NONE = "  -  "


def heat_text(change: Column) -> Column:
    """A heat map's cell: the bucket's mark and the change without digits after the point."""
    marks = F.create_map(*[F.lit(x) for kv in HEAT_MARKS.items() for x in kv])
    return F.coalesce(F.concat(marks[heat_indicator(change)], signed(change), F.lit("%")), F.lit(HEAT_NONE))


def label_of(value: Column, names: dict[str, str]) -> Column:
    """The label of a code, or the code where it has none."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[value], value) if names else value


def corr_verdict(r: Column) -> Column:
    """Strength and direction of a correlation; NULL or NaN: none."""
    size = F.abs(r)
    way = F.when(r > 0, "direct").otherwise("inverse")
    return (
        F.when(r.isNull() | F.isnan(r), "none").when(size > STRONG, F.concat(F.lit("strong "), way)).when(size > MODERATE, F.concat(F.lit("moderate "), way))
        .when(size > WEAK, F.concat(F.lit("weak "), way)).otherwise("none")
    )


def spike_severity(change: Column) -> Column:
    return F.when(change > 0.30, "high").otherwise("medium")


def direction(forecast: Column, current: Column) -> Column:
    """up, down or flat; NULL where either is missing or 0."""
    return F.when((forecast != 0) & (current != 0), F.when(forecast > current, "up").when(forecast < current, "down").otherwise("flat"))
