"""Dashboard snapshots: several reports in one JSON row."""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import reports, rollup
from ..operators.features import cluster_products, product_features
from ..operators.rollup import RollupTable
from ..operators.sensitivity import sensitive_products, sensitivity_of
from ..sources.views import PriceTables

KINDS = ("clusters", "index", "metrics", "deals", "anomalies", "full")


#: The windows and limits of the dashboard.
DEFAULTS = {"period_days": 7, "metrics_days": 7, "deals_days": 30, "heatmap_days": 7, "heatmap_max_products": 30, "deals_limit": 50, "sensitivity_limit": 30, "n_clusters": 4}
#: Products of a cluster in the dashboard, in a snapshot of clusters, and in a printed report.
CLUSTER_ITEMS, KIND_ITEMS, PRINTED_ITEMS = 200, 500, 15


def _one(df: DataFrame) -> DataFrame:
    return df.withColumn("_one", F.lit(1))


def _joined(parts: list[DataFrame]) -> DataFrame:
    """Tables of one row each, side by side."""
    out = _one(parts[0])
    for p in parts[1:]:
        out = out.join(_one(p), "_one")
    return out.drop("_one")


def _listed(df: DataFrame, name: str, order: list | None = None) -> DataFrame:
    """A table as one row: an array of its rows in order (as far as ``order`` says, then by all columns). For reports, whose rows are bounded."""
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order or [])], F.struct(*df.columns).alias("row"))
    return df.agg(F.transform(F.sort_array(F.collect_list(key)), lambda x: x["row"]).alias(name))


def _counts(anomalies: DataFrame, now: datetime, days: int) -> DataFrame:
    """One row: anomalies of the period in all, by severity and by type (maps of a few codes)."""
    listed = reports.anomaly_summary(anomalies, now, days)
    entries = lambda kind: F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("label", "n")))))
    return listed.agg(
        F.coalesce(F.sum(F.when(F.col("kind") == "type", F.col("n"))), F.lit(0)).alias("anomalies"), entries("severity").alias("by_severity"), entries("type").alias("by_type")
    )


@dataclass
class Board:
    """What all reports of a dashboard start from: the history rolled up by day, and a row a product with its figures. Both are made once, in one scan of the history and one
    of the products, or from a kept :class:`..operators.rollup.RollupTable`."""

    t: PriceTables
    cuts: tuple[datetime, ...]
    days: DataFrame
    products: DataFrame

    @staticmethod
    def of(t: PriceTables, options: dict[str, int], state: RollupTable | None = None) -> Board:
        windows = {k: t.now - timedelta(days=options[k]) for k in ("period_days", "metrics_days", "deals_days", "heatmap_days")}
        cuts = tuple(sorted(set(windows.values())))
        days = rollup.settled(rollup.daily_rollup(t.history, cuts) if state is None else state.windows(t.history, cuts), "rollup")
        figures = rollup.product_figures(days, metrics=cuts.index(windows["metrics_days"]) + 1, deals=cuts.index(windows["deals_days"]) + 1)
        items = t.product.select("product_id", "name", "category", "is_active")
        return Board(t, cuts, days, rollup.settled(items.join(figures, "product_id", "full"), "products"))

    def since(self, days: int) -> Column:
        return F.col("part") > self.cuts.index(self.t.now - timedelta(days=days))

    def metrics(self) -> DataFrame:
        active = F.coalesce("is_active", F.lit(False))
        own = self.products.agg(
            F.coalesce(F.sum("metrics_n"), F.lit(0)).alias("total_records"), F.count_if(F.col("metrics_n") > 0).alias("unique_products"), F.min("metrics_first").alias("first_ts"),
            F.max("metrics_last").alias("last_ts"), F.count_if(active).alias("total_products"), F.count_if(active & F.col("rows").isNull()).alias("products_without_data"),
        )
        return reports.metrics_of(own, reports.active_categories(self.t.category).agg(F.count("*").alias("active_categories")))

    def index(self, period_days: int) -> DataFrame:
        current = self.products.where("r is not null").select("product_id", F.col("r.price").alias("price"))
        return reports.index_of(current, self.t.history, self.products.where("name is not null"), self.t.now, period_days, self.t.category)

    def index_rows(self) -> DataFrame:
        """How many rows the index has; that takes no medians."""
        sold = self.products.where("r is not null").select(F.col("category").alias("name")).distinct()
        return reports.active_categories(self.t.category).join(sold, "name", "left_semi").agg(F.count("*").alias("index_rows"))

    def deals(self, limit: int) -> DataFrame:
        figures = self.products.select("product_id", "r", F.col("deals_lowest").alias("min_price"), F.try_divide(F.col("deals_total").cast("double"), F.col("deals_n")).alias("avg_price"))
        return reports.rank_deals(figures, self.products.select("product_id", "name", "category", "is_active"), limit)

    def heat(self, days: int, most: int) -> DataFrame:
        chosen = reports.heat_products(self.products, most)
        daily = rollup.daily_last(self.days.join(F.broadcast(chosen.select("product_id")), "product_id", "left_semi"), self.since(days)).drop("rows")
        return reports.heat_cells(daily.join(F.broadcast(chosen), "product_id"), self.t.now, days)

    def sensitivity(self, limit: int) -> DataFrame:
        items = sensitive_products(self.products, limit)
        return sensitivity_of(rollup.daily_last(self.days.join(items, "product_id", "left_semi")), items, self.t.rates)


def _headline(b: Board, found: DataFrame, o: dict[str, int]) -> DataFrame:
    metrics = b.metrics().select(
        F.lit(o["metrics_days"]).alias("period_days"), F.col("total_records").alias("records_in_window"), F.col("unique_products").alias("products_updated"), "total_products",
        "active_categories", "products_without_data",
    )
    count = lambda df, name: df.agg(F.count("*").alias(name))
    n = lambda of, key: F.coalesce(F.col(of)[key], F.lit(0)).alias(f"anomalies_{key}")
    return _joined([
        metrics,
        found.select("anomalies", *[n("by_severity", s) for s in ("high", "medium", "low")], *[n("by_type", k) for k in ("spike", "manipulation", "cyclic")]),
        b.index_rows(),
        count(b.deals(o["deals_limit"]), "deals_listed"),
        b.heat(o["heatmap_days"], o["heatmap_max_products"]).agg(F.count_distinct("product_id").alias("heat_products"), F.count_distinct("date").alias("heat_dates")),
        count(b.sensitivity(o["sensitivity_limit"]), "sensitivity_rows"),
    ])


def dashboard_summary(t: PriceTables, anomalies: DataFrame, state: RollupTable | None = None, **options: int) -> DataFrame:
    """One row of headline figures, but for the clusters', which :func:`full_dashboard` adds; ``options`` as in ``DEFAULTS``. With ``state`` the history's whole days are
    not read again."""
    o = DEFAULTS | options
    return _headline(Board.of(t, o, state), _counts(anomalies, t.now, o["period_days"]), o)


def full_dashboard(t: PriceTables, anomalies: DataFrame, state: RollupTable | None = None, **options: int) -> DataFrame:
    """One row: ``summary`` and ``payload``, structs with all sections of the dashboard; ``options`` as in ``DEFAULTS``."""
    o = DEFAULTS | options
    b = Board.of(t, o, state)
    found = rollup.settled(_counts(anomalies, t.now, o["period_days"]), "counts")  # one row
    clusters = rollup.settled(clusters_payload(product_features(t.history, t.product), o["n_clusters"]), "clusters")  # a row a label
    sizes = clusters.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "products")))).alias("cluster_labels"))
    summary = _joined([_headline(b, found, o), sizes])
    cells = b.heat(o["heatmap_days"], o["heatmap_max_products"])
    rows = cells.groupBy("product_id", "name").agg(F.sort_array(F.collect_list(F.struct("date", "price", "change_pct", "indicator"))).alias("cells"))
    heat = _joined([cells.agg(F.sort_array(F.collect_set("date")).alias("dates")), _listed(rows, "rows", [F.col("name"), F.col("product_id")])])
    metrics = b.metrics()
    metrics = metrics.select("total_records", "unique_products", "first_ts", "last_ts", "total_products", "active_categories", "products_without_data", "avg_records_per_product")
    payload = _joined([
        metrics.select(F.struct(*metrics.columns).alias("metrics")),
        _listed(b.index(o["period_days"]), "category_index", [F.col("category")]),
        _listed(b.deals(o["deals_limit"]), "deals_top", [-F.col("discount_pct"), F.col("product_id")]),
        _listed(clusters, "clusters", [F.col("label")]),
        heat.select(F.struct("dates", "rows").alias("heatmap")),
        _listed(b.sensitivity(o["sensitivity_limit"]), "sensitivity", [F.coalesce(-F.abs("correlation"), F.lit(2.0)), F.col("product_id")]),
        found.select(F.struct(F.lit(o["period_days"]).alias("period_days"), F.col("anomalies").alias("total"), "by_severity", "by_type").alias("anomalies_summary")),
        _listed(latest_rates(t.rates), "currency_rates_latest", [-F.unix_date("date"), F.col("currency")]),
    ])
    return _joined([summary.select(F.struct(*summary.columns).alias("summary")), payload.select(F.struct(F.lit(t.now).alias("generated_at"), *payload.columns).alias("payload"))])


def latest_rates(rates: DataFrame, n: int = 9) -> DataFrame:
    return rates.orderBy(F.desc("date"), "currency").limit(n)


def clusters_payload(features: DataFrame, k: int = 4, most: int = CLUSTER_ITEMS) -> DataFrame:
    """A row for each label with the number of its products and its products, the most volatile first, ``most`` of them."""
    w = Window.partitionBy("label").orderBy(F.desc("volatility"), "product_id")
    ranked = cluster_products(features, k).withColumn("rn", F.row_number().over(w))
    item = F.when(F.col("rn") <= most, F.struct("rn", "product_id", "name", "category", "mean_price", "volatility", "trend", "max_change_pct", "n_records"))
    return ranked.groupBy("label").agg(F.count("*").alias("products"), F.sort_array(F.collect_list(item)).alias("items"))


def _kind(t: PriceTables, anomalies: DataFrame, kind: str, p: dict) -> tuple[DataFrame, Column, Column]:
    """One row, and its columns for the summary and the payload, of the report ``kind`` with parameters ``p``."""
    items = t.product if p.get("category") is None else t.product.where(F.col("category") == p["category"])
    if kind == "clusters":
        labels = clusters_payload(product_features(t.history, items), int(p.get("clusters", 4)), KIND_ITEMS)
        keep = ("product_id", "name", "mean_price", "volatility", "trend")
        rows = F.transform("items", lambda x: F.struct(*[x[c].alias(c) for c in keep]))
        of = lambda c: F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", c))))
        both = labels.select("label", "products", rows.alias("rows")).agg(of("products").alias("s"), of("rows").alias("p"))
        return both, F.col("s"), F.col("p")
    if kind == "index":
        listed = _listed(reports.category_index(t.history, t.product, t.now, int(p.get("period", 7)), t.category), "data", [F.col("category")])
        return listed, F.struct(F.size("data").alias("rows")), F.struct("data")
    if kind == "metrics":
        m = reports.ingest_metrics(t.history, t.product, t.category, t.now, int(p.get("days", 7)))
        return m, F.struct("total_records", "unique_products"), F.struct(*m.columns)
    if kind == "deals":
        best = reports.best_deals(t.history, t.product, t.now, int(p.get("days", 30)), int(p.get("limit", 50)), p.get("category"))
        listed = _listed(best, "data", [-F.col("discount_pct"), F.col("product_id")])
        return listed, F.struct(F.size("data").alias("count")), F.struct("data")
    if kind == "anomalies":
        days = int(p.get("days", 7))
        found = _counts(anomalies, t.now, days)
        return found, F.struct(F.col("anomalies").alias("total"), F.lit(days).alias("days")), F.struct("by_severity", "by_type", F.lit(days).alias("days"))
    raise ValueError(f"no snapshot of kind {kind}")


def snapshot(t: PriceTables, anomalies: DataFrame, kind: str, created_at: datetime, scope: str = "", **parameters) -> DataFrame:
    """One row for the snapshot table: kind, scope, time, parameters, summary and payload as JSON. :func:`..sources.sinks.append_rows` adds it.

    A ``full`` one takes ``DEFAULTS`` as parameters; ``clusters`` category and clusters; ``index`` period; ``metrics`` days; ``deals`` days, category and limit; ``anomalies``
    days. Payloads that are lists are the ``data`` of an object. Heat maps and sensitivities are kept in full ones only.
    """
    given = {k: v for k, v in parameters.items() if v is not None}
    if kind == "full":
        body, summary, payload = full_dashboard(t, anomalies, **given), F.col("summary"), F.col("payload")
    else:
        body, summary, payload = _kind(t, anomalies, kind, given)
    return body.select(
        F.lit(kind).alias("kind"), F.lit(scope).alias("scope_key"), F.lit(created_at).cast("timestamp_ntz").alias("created_at"), F.lit(json.dumps(given)).alias("parameters"),
        F.to_json(summary).alias("summary"), F.to_json(payload).alias("payload"),
    )


def list_snapshots(snapshots: DataFrame, kind: str | None = None, limit: int = 10) -> DataFrame:
    """The newest snapshots, of one kind or all."""
    rows = snapshots.where(F.col("kind") == kind) if kind else snapshots
    return rows.orderBy(F.desc("created_at"), "kind").limit(limit)
