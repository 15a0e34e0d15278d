"""Product features and clusters by price dynamics."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.series import step_change
from .rollup import settled

ALL, STABLE, VOLATILE, RISING, FALLING = "all products", "stable", "volatile", "rising", "falling"


def product_features(history: DataFrame, product: DataFrame, least_rows: int = 3) -> DataFrame:
    """Mean, coefficient of variation, trend and largest step of each active product over its whole history."""
    w = Window.partitionBy("product_id").orderBy("ts", "tie")
    rows = history.select("product_id", "ts", "tie", F.col("price").cast("double").alias("p"), "price").withColumn("before", F.lag("p").over(w))
    step = F.when(F.col("before").isNotNull(), F.abs(step_change(F.col("p"), F.col("before"))))
    g = rows.groupBy("product_id").agg(
        F.count("*").alias("n_records"), (F.sum("price").cast("double") / F.count("price")).alias("mean_price"), F.stddev_pop("p").alias("std"),
        F.min(F.struct("ts", "tie", "p"))["p"].alias("first"), F.max(F.struct("ts", "tie", "p"))["p"].alias("last"), F.max(step).alias("max_change"),
    )
    return (
        g.where((F.col("n_records") >= least_rows) & (F.col("mean_price") != 0))
        .join(product.where("is_active").select("product_id", "name", "category"), "product_id")
        .select(
            "product_id", "name", "category", "n_records", "mean_price", (F.col("std") / F.col("mean_price")).alias("volatility"),
            F.coalesce(F.try_divide(F.col("last") - F.col("first"), F.col("first")), F.lit(0.0)).alias("trend"),
            (F.col("max_change") * 100).alias("max_change_pct"),
        )
    )


def cluster_products(features: DataFrame, k: int = 4, starts: int = 10, seed: int = 42) -> DataFrame:
    """K-means on scaled volatility, trend and largest step; the best of several starts. Clusters are named by their means: lowest volatility stable,
    highest volatile, others rising, falling or numbered; clusters of one name merge. Fewer than k products: one label."""
    features = settled(features, "features")  # read by every fit and by the result
    if features.count() < k:
        return features.withColumn("label", F.lit(ALL))
    vec = VectorAssembler(inputCols=["volatility", "trend", "max_change_pct"], outputCol="raw").transform(features)
    scaled = StandardScaler(inputCol="raw", outputCol="x", withMean=True, withStd=True).fit(vec).transform(vec)
    fits = [KMeans(k=k, seed=seed + i, featuresCol="x", predictionCol="cluster").fit(scaled) for i in range(starts)]
    best = min(fits, key=lambda m: m.summary.trainingCost)
    marked = best.transform(scaled)
    means = marked.groupBy("cluster").agg(F.avg("volatility").alias("v"), F.avg("trend").alias("t")).orderBy("v", "cluster").collect()
    names = {}
    for i, r in enumerate(means):
        names[r["cluster"]] = (
            STABLE if i == 0 else VOLATILE if i == len(means) - 1 else RISING if r["t"] > 0.02 else FALLING if r["t"] < -0.02 else f"cluster {r['cluster']}"
        )
    label = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("cluster")]
    return marked.select(*features.columns, label.alias("label"))
