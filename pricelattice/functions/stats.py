"""Statistics that Spark lacks, as Column builders."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F


def pearson(x: str, y: str) -> Column:
    """Correlation, NULL for a constant side (the built-in one raises an error there)."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def student_p(r: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation of n pairs, from the finite trigonometric series for whole degrees of freedom."""
    df = n - 2
    t = F.abs(r) * F.sqrt(df / F.greatest(1 - r * r, F.lit(1e-300)))
    angle = F.atan(t / F.sqrt(df))
    cos2 = F.pow(F.cos(angle), 2)

    def series(first: Column, terms: Column, factor) -> Column:
        start = F.struct(first.alias("term"), F.lit(0.0).alias("sum"))
        steps = F.when(terms > 0, F.sequence(F.lit(1), terms)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(
            steps, start,
            lambda a, k: F.struct((a["term"] * factor(k) * cos2).alias("term"), (a["sum"] + a["term"]).alias("sum")),
            lambda a: a["sum"],
        )

    odd = 2 / pi * (angle + F.sin(angle) * series(F.cos(angle), F.floor((df - 1) / 2).cast("int"), lambda k: 2.0 * k / (2.0 * k + 1)))
    even = F.sin(angle) * series(F.lit(1.0), F.floor(df / 2).cast("int"), lambda k: (2.0 * k - 1) / (2.0 * k))
    p = 1 - F.when(df % 2 == 1, odd).otherwise(even)
    return F.when(r.isNull() | (df < 1), None).when(F.abs(r) >= 1, 0.0).otherwise(F.greatest(p, F.lit(0.0)))
