"""Listings as an HTTP client would page them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.series import current_rows, latest, mark_actual
from ..functions.text import matches_search
from .search import among

#: Fixed value: rows of a page.
PAGE = 20


def paged(df: DataFrame, page: int = 1, size: int = PAGE) -> DataFrame:
    """One page of an ordered listing."""
    return df.offset((page - 1) * size).limit(size)


#: The orders in which listings come unless another is asked for.
DEFAULT_ORDERS = {
    "category": ("name",), "product": ("-last_parsed_at",), "price": ("-ts",), "anomaly": ("-detected_at",), "rate": ("-date", "currency"), "forecast": ("product_id", "forecast_date"),
    "snapshot": ("-created_at",), "notification": ("-sent_at",),
}


def by(order: str) -> Column:
    """An order by one column, a minus before it for the reverse. As a database has it, NULLs come last, and first where the order is reversed."""
    return F.col(order[1:]).desc_nulls_first() if order.startswith("-") else F.col(order).asc_nulls_last()


def in_default_order(df: DataFrame, kind: str, *ties: str) -> DataFrame:
    """Rows of a kind in its default order, then by ``ties``."""
    return df.orderBy(*[by(o) for o in (*DEFAULT_ORDERS[kind], *ties)])


def seek(df: DataFrame, order: tuple[str, ...], after: tuple | None = None, size: int = PAGE) -> DataFrame:
    """The ``size`` rows after the key ``after`` in the order of ``order`` (columns as in :func:`by`, together unique), or the first ones.

    The key of a page's last row (:func:`last_key`) leads to the next, so no page sorts or skips the rows before it. Besides the exact condition its first column alone
    bounds the rows, which reaches the scan, where files and row groups in that order are left out.
    """
    if after is not None:
        beyond, same = F.lit(False), F.lit(True)
        for o, v in zip(order, after):
            c, down = F.col(o.lstrip("-")), o.startswith("-")
            if v is None:  # NULLs are last, and first in reverse
                step = c.isNotNull() if down else F.lit(False)
            else:
                step = c < F.lit(v) if down else (c > F.lit(v)) | c.isNull()
            beyond, same = beyond | (same & step), same & c.eqNullSafe(F.lit(v))
        c, v, down = F.col(order[0].lstrip("-")), after[0], order[0].startswith("-")
        near = F.lit(True) if v is None and down else c.isNull() if v is None else c <= F.lit(v) if down else (c >= F.lit(v)) | c.isNull()
        df = df.where(near).where(beyond)
    return df.orderBy(*[by(o) for o in order]).limit(size)


def last_key(page: DataFrame, order: tuple[str, ...]) -> tuple | None:
    """The key of the last row of a page from :func:`seek`; None of an empty page."""
    rows = page.select(*[o.lstrip("-") for o in order]).collect()  # a page
    return tuple(rows[-1]) if rows else None


def list_products(
    history: DataFrame, product: DataFrame, search: str = "", category: str | None = None, order: str = "name", page: int = 1, after: tuple | None = None, index: DataFrame | None = None
) -> DataFrame:
    """Active products that match every search term by name or code, with their current price (NULL without one).

    ``page`` counts from 1; ``after``, the (order column, product_id) of the last product before, replaces it and costs no more on later pages. ``index`` is a
    :func:`..operators.search.trigrams` table that finds the products to look at.
    """
    rows = product.where("is_active")
    rows = rows if index is None else among(rows, index, search)
    rows = rows.where(matches_search(search, F.col("name"), F.col("vendor_code")))
    rows = rows.where(F.col("category") == category) if category else rows
    found = paged(rows.orderBy(by(order), "product_id"), page) if after is None else seek(rows, (order, "product_id"), after)
    one = found.select("product_id", "name", "category", "vendor_code", F.col(order.lstrip("-")).alias("_order"))
    # A page of 20 ids is broadcast; only their rows are aggregated.
    near = current_rows(history).join(F.broadcast(one.select("product_id")), "product_id", "left_semi")
    priced = one.join(latest(near).select("product_id", F.col("price").alias("current_price")), "product_id", "left")
    return priced.orderBy(by("-_order" if order.startswith("-") else "_order"), "product_id").drop("_order")


def product_detail(history: DataFrame, product: DataFrame, product_id: int) -> DataFrame:
    """One active product, all its columns, with its current price (NULL without one). No row where there is none."""
    one = product.where("is_active").where(F.col("product_id") == product_id)
    near = current_rows(history.where(F.col("product_id") == product_id))
    return one.join(latest(near).select("product_id", F.col("price").alias("current_price")), "product_id", "left")


def product_prices(history: DataFrame, product: DataFrame, product_id: int, most: int = 100) -> DataFrame:
    """An active product's newest rows, 100 as the reference's endpoint has it; one product's rows alone are sorted."""
    rows = history.where(F.col("product_id") == product_id).join(product.where("is_active").where(F.col("product_id") == product_id).select("product_id"), "product_id", "left_semi")
    rows = rows if "is_actual" in history.columns else mark_actual(rows)
    return rows.orderBy(F.desc("ts"), F.desc("tie")).limit(most).select("product_id", "price", "ts", "is_actual")


def list_anomalies(anomalies: DataFrame, severity: str | None = None, kind: str | None = None, resolved: bool | None = None, product_id: int | None = None, page: int = 1, order: str = "-detected_at") -> DataFrame:
    """Anomalies that fit all filters, the last detected first; ``order`` is ``detected_at`` or ``severity``, a minus before it for the reverse."""
    if order.lstrip("-") not in ("detected_at", "severity"):
        raise ValueError(f"no order by {order}")
    rows = anomalies
    for col, value in (("severity", severity), ("anomaly_type", kind), ("resolved", resolved), ("product_id", product_id)):
        rows = rows if value is None else rows.where(F.col(col) == value)
    return paged(rows.orderBy(by(order), "product_id", "anomaly_type"), page)


def list_subscriptions(subscriptions: DataFrame, product: DataFrame, user_id: int) -> DataFrame:
    """A user's own subscriptions."""
    return subscriptions.where(F.col("user_id") == user_id).join(product.select("product_id", "name"), "product_id")


def notifications(fired: DataFrame, user_id: int | None = None) -> DataFrame:
    """Alert messages, of one user or all."""
    rows = fired if user_id is None else fired.where(F.col("user_id") == user_id)
    text = alert_text()
    return rows.select("user_id", "product_id", text.alias("message"))


def alert_text() -> Column:
    """What an alert says."""
    return F.concat(F.col("name"), F.lit(": "), F.col("current_price").cast("string"), F.lit(" <= "), F.col("target_price").cast("string"))


def addressed(fired: DataFrame, users: DataFrame, product: DataFrame) -> DataFrame:
    """Alerts with whom they go to and where the product is: user_id, username, email, product_id, message. Alerts of unknown users have no row."""
    link = F.concat(alert_text(), F.lit(" "), F.coalesce("url", F.lit("")))
    both = fired.join(users.select("user_id", "username", "email"), "user_id").join(product.select("product_id", "url"), "product_id")
    return both.select("user_id", "username", "email", "product_id", F.trim(link).alias("message"))
