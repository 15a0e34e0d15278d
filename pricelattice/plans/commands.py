"""Every report by the name and with the defaults under which it is asked for, over one set of price tables."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.formats import fixed, padded, percent
from ..operators import features, forecast, reports, sensitivity
from ..sources import sinks
from ..sources.merge import MergeTable
from ..sources.views import PriceTables
from . import jobs, snapshot

SEVERITIES, TYPES, CURRENCIES = ("low", "medium", "high"), ("spike", "manipulation", "cyclic"), ("USD", "EUR", "CNY")


def _one_of(value: str | None, allowed: tuple[str, ...]) -> None:
    if value is not None and value not in allowed:
        raise ValueError(f"{value!r} is none of {', '.join(allowed)}")


@dataclass
class Reports:
    """Reports over ``tables`` and the ``known`` anomalies. ``category`` restricts a report to a category's products."""

    tables: PriceTables
    known: DataFrame

    def _products(self, category: str | None = None, product_id: int | None = None) -> DataFrame:
        p = self.tables.product
        p = p if category is None else p.where(F.col("category") == category)
        return p if product_id is None else p.where(F.col("product_id") == product_id)

    def anomalies(self, days: int = 7, severity: str | None = None, kind: str | None = None, category: str | None = None, json: bool = False, out: str | None = None) -> DataFrame:
        """The anomaly report as lines of text or of JSON, written to ``out`` where it is given."""
        _one_of(severity, SEVERITIES)
        _one_of(kind, TYPES)
        entries = reports.anomaly_report(self.known, self.tables.product, self.tables.now, days, severity, kind, category)
        lines = reports.report_json(entries) if json else reports.report_text(entries)
        if out:
            sinks.write_report(lines, out, "json" if json else "text")
        return lines

    def clusters(self, category: str | None = None, clusters: int = 4) -> DataFrame:
        return snapshot.clusters_payload(features.product_features(self.tables.history, self._products(category)), clusters)

    def clusters_text(self, category: str | None = None, clusters: int = 4) -> DataFrame:
        """The clusters as lines: a head for each, its 15 most volatile products, and how many more there are."""
        rows = self.clusters(category, clusters)
        item = lambda x: F.concat(
            F.lit("  "), F.rpad(F.substring(x["name"], 1, 55), 55, " "), F.lit(" | mean "), padded(fixed(x["mean_price"]), 10), F.lit(" | volatility "), fixed(x["volatility"], 3),
            F.lit(" | trend "), percent(x["trend"]), F.lit(" | records "), x["n_records"].cast("string"),
        )
        head = F.concat(F.lit("--- "), F.upper("label"), F.lit(" ("), F.col("products").cast("string"), F.lit(") ---"))
        more = F.when(F.col("products") > snapshot.PRINTED_ITEMS, F.concat(F.lit("  ... and "), (F.col("products") - snapshot.PRINTED_ITEMS).cast("string"), F.lit(" more")))
        lines = F.array_compact(F.concat(F.array(head), F.transform(F.slice("items", 1, snapshot.PRINTED_ITEMS), item), F.array(more)))
        return rows.select("label", F.posexplode(lines).alias("at", "value")).orderBy("label", "at").select("value")

    def index(self, period: int = 7) -> DataFrame:
        return reports.category_index(self.tables.history, self.tables.product, self.tables.now, period, self.tables.category)

    def heatmap(self, category: str | None = None, days: int = 7, most: int = 30) -> DataFrame:
        return reports.heatmap(self.tables.history, self._products(category), self.tables.now, days, most)

    def forecast(self, category: str | None = None, product_id: int | None = None, horizon: int = 7, limit: int | None = None) -> DataFrame:
        """Forecasts of all active products, the first ``limit`` by id, or one."""
        items = self._products(category, product_id).where("is_active").orderBy("product_id")
        return forecast.forecast_products(self.tables.history, items.limit(limit) if limit else items, horizon)

    def sensitivity(self, category: str | None = None, currency: str = "USD", product_id: int | None = None, limit: int = 50) -> DataFrame:
        _one_of(currency, CURRENCIES)
        return sensitivity.fx_sensitivity(self.tables.history, self._products(category, product_id), self.tables.rates, currency, limit=limit)

    def metrics(self, days: int = 7) -> DataFrame:
        return reports.ingest_metrics(self.tables.history, self.tables.product, self.tables.category, self.tables.now, days)

    def deals(self, days: int = 30, category: str | None = None, limit: int = 20) -> DataFrame:
        return reports.best_deals(self.tables.history, self.tables.product, self.tables.now, days, limit, category)

    def compare(self, ids: list[int], forecasts: DataFrame, days: int = 30) -> DataFrame:
        return reports.compare_products(self.tables.history, self.tables.product, forecasts, ids, self.tables.now, days)

    def backfill(self, table: MergeTable, url: str, days: int, **options: str) -> int:
        """Fetch the rates of the last ``days`` days into ``table``; how many are new."""
        return jobs.backfill_rates(self.tables.product.sparkSession, table, url, days, **({"today": self.tables.now.date().isoformat()} | options))

    def save_snapshot(
        self, path: str, kind: str = "full", period: int = 7, category: str | None = None, clusters: int = 4, metrics_days: int = 7, deals_days: int = 30, created_at: datetime | None = None
    ) -> DataFrame:
        """Save a snapshot of a kind with the parameters that the kind has."""
        _one_of(kind, snapshot.KINDS)
        given = {"period": period, "category": category} | {
            "clusters": {"clusters": clusters}, "metrics": {"days": metrics_days}, "deals": {"days": deals_days, "limit": 100}, "anomalies": {"days": period},
        }.get(kind, {})
        given = {"period_days": period, "metrics_days": metrics_days, "deals_days": deals_days} if kind == "full" else given
        row = snapshot.snapshot(self.tables, self.known, kind, created_at or self.tables.now, **given)
        sinks.append_rows(row, path)
        return row

    def list_snapshots(self, path: str, kind: str | None = None, limit: int = 10) -> DataFrame:
        """The newest snapshots; ``full_dashboard`` is another name of ``full``."""
        saved = self.tables.product.sparkSession.read.parquet(path)
        return snapshot.list_snapshots(saved, "full" if kind == "full_dashboard" else kind, limit)

    def sync(self, horizon: int = 7) -> dict[str, int]:
        """Detection and forecasts for all products, counted; a product that cannot be forecast is an error of its own and stops no other."""
        t = self.tables
        new = jobs.detect.full_detection(t.history, t.now)
        new = jobs.detect.new_anomalies(new, self.known.select("product_id", "anomaly_type", "detected_at", "resolved"))
        made = forecast.forecast_products(t.history, t.product, horizon).persist()
        counts = {"anomalies_created": new.count()} | forecast.forecast_counts(t.history, t.product, made)
        made.unpersist()
        return counts
