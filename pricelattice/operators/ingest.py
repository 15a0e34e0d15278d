"""Change-only price logs, upserts and alerts: a new state is a join of the old one with what arrived."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.series import current_rows, latest
from ..functions.text import product_slug
from ..session import shared_folder


def change_log(arrivals: DataFrame) -> DataFrame:
    """Keep an arriving price only if it differs from the product's last one; the last kept row is actual.

    Arrival order (``arrival``) decides, not event time: a skipped row equals the current price, so the arrival before holds it.
    """
    w = Window.partitionBy("product_id").orderBy("arrival")
    back = Window.partitionBy("product_id").orderBy(F.desc("arrival"))
    before = F.lag("price").over(w)
    kept = arrivals.withColumn("before", before).where("before is null or before <> price")
    return kept.withColumn("is_actual", F.row_number().over(back) == 1).withColumn("old_price", F.when(F.col("before") != 0, F.col("before"))).drop("before")


def new_changes(log: DataFrame, arrivals: DataFrame) -> DataFrame:
    """The rows that arrivals (product_id, price, arrival, ts) add to a log: only products that arrive are read of it.

    Where the log keeps its rows' ``arrival``, arrivals up to a product's last logged one are known and add nothing: delivering them again is harmless.
    """
    kept = "arrival" in log.columns
    at = F.col("arrival") if kept else F.lit(None).cast("long")
    current = log.where("is_actual").select("product_id", F.col("price").alias("_price"), at.alias("_at"), F.lit(True).alias("_known"))
    ids = arrivals.select("product_id").distinct()
    known = current.join(ids, "product_id", "left_semi")
    fresh = arrivals.select("product_id", "price", "arrival", "ts")
    if kept:
        fresh = fresh.join(known.select("product_id", "_at"), "product_id", "left").where("_at is null or arrival > _at").drop("_at")
    # A product's current row goes before all of its arrivals.
    first = known.select("product_id", F.col("_price").alias("price"), F.lit(None).cast("long").alias("arrival"), F.lit(None).cast(log.schema["ts"].dataType).alias("ts"))
    return change_log(first.unionByName(fresh)).where("arrival is not null")


def append_changes(log: DataFrame, arrivals: DataFrame) -> DataFrame:
    """An existing log with :func:`new_changes`; the rows that were actual before them no longer are."""
    cols = [c for c in ("product_id", "price", "ts", "arrival", "is_actual", "old_price") if c != "arrival" or c in log.columns]
    new = new_changes(log, arrivals)
    ids = new.select("product_id").distinct().withColumn("_new", F.lit(True))
    old = log.join(ids, "product_id", "left").withColumn("is_actual", F.col("is_actual") & F.col("_new").isNull()).drop("_new")
    return old.select(*cols).unionByName(new.select(*cols))


def filled(new: str, old: str) -> Column:
    """The new text unless it is empty."""
    return F.coalesce(F.when(F.col(new) != "", F.col(new)), F.col(old))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with their keys."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def allocate_slugs(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """A free slug for each row of ``wanted`` (key, slug, arrival), as if they came one by one: where a slug is taken, a number goes after it, ``-d1``, and
    where that is taken as well, the next after that.

    All rows ask at once and the earliest gets a slug; the others ask on with their next one, and may push out a later row. As one order decides everywhere, that ends
    in what one by one would give. Only rows that have lost take another round, each written to the shared folder.
    """
    spark = wanted.sparkSession
    asks = wanted.select("key", "arrival", "slug", F.lit(0).alias("n"))
    owned = taken.select("slug").where("slug is not null").distinct().withColumn("_owned", F.lit(True))
    while True:
        first = Window.partitionBy("slug").orderBy("arrival", "key")
        asked = asks.join(owned, "slug", "left").withColumn("lost", F.col("_owned").isNotNull() | (F.row_number().over(first) > 1)).drop("_owned")
        path = shared_folder(spark, "slugs")
        asked.write.parquet(path)
        asked = spark.read.parquet(path)
        if asked.where("lost").isEmpty():
            return asked.select("key", "slug")
        longer = F.substring(F.concat(F.substring("slug", 1, 480), F.lit("-d"), (F.col("n") + 1).cast("string")), 1, 512)
        asks = asked.select("key", "arrival", F.when(F.col("lost"), longer).otherwise(F.col("slug")).alias("slug"), (F.col("n") + F.col("lost").cast("int")).alias("n"))


def upsert_products(old: DataFrame, parsed: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """By url. A known product takes the new name and time, and code and image where they are not empty; its category stays. A new one gets all, and a slug that
    no other has (``taken``: slugs of products besides ``old``). The last of several rows for one url in ``parsed`` (by ``arrival``) names it."""
    w = Window.partitionBy("url").orderBy(F.desc("arrival"))
    last = parsed.withColumn("rn", F.row_number().over(w)).where("rn = 1").select(
        "url", F.col("name").alias("n_name"), F.col("category").alias("n_category"), F.col("vendor_code").alias("n_code"), F.col("image_url").alias("n_image"), F.col("parsed_at").alias("n_at"),
        F.col("arrival").alias("n_arrival"),
    )
    fresh = last.join(old.select("url"), "url", "left_anti").select(F.col("url").alias("key"), product_slug(F.col("n_name"), F.col("n_code"), F.col("url")).alias("slug"), F.col("n_arrival").alias("arrival"))
    slugs = allocate_slugs(fresh, old.select("slug") if taken is None else taken)
    both = old.join(last.join(slugs.select(F.col("key").alias("url"), F.col("slug").alias("n_slug")), "url", "left"), "url", "full")
    known = F.col("slug").isNotNull()
    return both.select(
        "url", F.coalesce("n_name", "name").alias("name"), F.when(known, F.col("category")).otherwise(F.col("n_category")).alias("category"),
        filled("n_code", "vendor_code").alias("vendor_code"), filled("n_image", "image_url").alias("image_url"),
        F.coalesce("n_at", "last_parsed_at").alias("last_parsed_at"), F.coalesce("slug", "n_slug").alias("slug"), (~known).alias("created"),
    )


def seed_categories(old: DataFrame, rows: DataFrame, update: bool = False) -> DataFrame:
    """Categories by slug with what happened to each: created, updated, or skipped. Of one slug the last row counts; an empty field raises."""
    w = Window.partitionBy("slug").orderBy(F.desc("arrival"))
    clean = rows.select("arrival", *[F.trim(F.trim(F.col(c)), F.lit("/")).alias(c) for c in ("name", "slug", "source_path")])
    empty = (F.col("name") == "") | (F.col("slug") == "") | (F.col("source_path") == "")
    checked = clean.withColumn("slug", F.when(empty, F.raise_error(F.lit("a category has an empty field")).cast("string")).otherwise(F.col("slug")))
    last = checked.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("slug", F.col("name").alias("n_name"), F.col("source_path").alias("n_path"))
    both = old.select("slug", "name", "source_path").join(last, "slug", "full")
    take = F.col("name").isNull() | (F.lit(update) & F.col("n_name").isNotNull())
    action = F.when(F.col("n_name").isNull(), "kept").when(F.col("name").isNull(), "created").when(F.lit(update), "updated").otherwise("skipped")
    return both.select(
        "slug", F.when(take, F.col("n_name")).otherwise(F.col("name")).alias("name"), F.when(take, F.col("n_path")).otherwise(F.col("source_path")).alias("source_path"), action.alias("action")
    )


def seed_rows(builtin: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """A built-in list of categories, then those of a file; ``arrival`` keeps that order, so of one slug the file's row counts."""
    cols = ["name", "slug", "source_path"]
    rows = builtin.select(F.struct(F.lit(0).alias("of"), F.col("arrival").cast("long").alias("at")).alias("arrival"), *cols)
    return rows if more is None else rows.unionByName(more.select(F.struct(F.lit(1).alias("of"), F.col("arrival").cast("long").alias("at")).alias("arrival"), *cols))


def seed_counts(seeded: DataFrame) -> dict[str, int]:
    """How many categories :func:`seed_categories` would create, update and skip."""
    found = {r["action"]: r["count"] for r in seeded.groupBy("action").count().collect()}
    return {a: found.get(a, 0) for a in ("created", "updated", "skipped")}


def apply_seed(seeded: DataFrame, path: str, dry_run: bool = False) -> dict[str, int]:
    """Write the seeded categories as the new table at ``path``, or only count what would happen. ``path`` must not be a table that ``seeded`` reads."""
    counts = seed_counts(seeded)
    if not dry_run:
        seeded.drop("action").write.mode("overwrite").parquet(path)
    return counts


def check_alerts(history: DataFrame, subscriptions: DataFrame, product: DataFrame) -> DataFrame:
    """Active subscriptions whose product's current price is at or below their target."""
    current = latest(current_rows(history)).select("product_id", F.col("price").alias("current_price"))
    return (
        subscriptions.where("is_active").join(current, "product_id").where("current_price <= target_price")
        .join(product.select("product_id", "name"), "product_id").select("user_id", "product_id", "name", "current_price", "target_price")
    )


def after_alerts(subscriptions: DataFrame, fired: DataFrame) -> DataFrame:
    """The subscriptions with those that fired switched off: an alert comes once."""
    hit = fired.select("user_id", "product_id", F.lit(True).alias("_hit"))
    return subscriptions.join(hit, ["user_id", "product_id"], "left").withColumn("is_active", F.col("is_active") & F.col("_hit").isNull()).drop("_hit")


def create_subscriptions(known: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted subscriptions that do not exist yet; an inactive one blocks as well. The first of equal wishes counts."""
    w = Window.partitionBy("user_id", "product_id").orderBy("arrival")
    first = wanted.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
    return first.join(known.select("user_id", "product_id"), ["user_id", "product_id"], "left_anti")
