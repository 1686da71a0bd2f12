"""Summary views kept up to date by recomputing the affected keys from the base table.

View, tracker (which keys each order went into) and watermark are committed together. A full refresh leaves no obsolete keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.schema import ORDER
from millrace.operators.reports import cents, total
from millrace.session import cut
from millrace.sources.store import Warehouse

TRACKER = "id_order string, date string, skus array<string>"
VIEWS = {"daily_sales_summary": "date", "top_products_summary": "sku"}


def _keys(orders: DataFrame) -> DataFrame:
    """The day and the skus of each order."""
    day = F.when(F.col("order_date") != "", F.substring("order_date", 1, 10))
    skus = F.array_sort(F.array_distinct(F.filter(F.transform("items", lambda x: x["sku"]), lambda s: s.isNotNull())))
    return orders.select("id_order", day.alias("date"), F.coalesce(skus, F.array().cast("array<string>")).alias("skus"))


def daily_sales(orders: DataFrame, affected: DataFrame | None = None) -> DataFrame:
    rows = orders.where("order_date is not null and order_date <> ''").withColumn("date", F.substring("order_date", 1, 10))
    if affected is not None:
        rows = rows.join(affected, "date", "left_semi")
    found = rows.groupBy("date").agg(total("total_amount").alias("total_revenue"), F.count("*").alias("total_orders"), F.avg("total_amount").alias("avg_order_value"))
    return found.withColumns({c: cents(c) for c in ("total_revenue", "avg_order_value")})


def product_sales(orders: DataFrame, affected: DataFrame | None = None) -> DataFrame:
    """By sku alone; the name is the smallest of those given."""
    lines = orders.where(F.size("items") > 0).select(F.explode("items").alias("item")).where("item.sku is not null").select("item.*")
    if affected is not None:
        lines = lines.join(affected, "sku", "left_semi")
    found = lines.groupBy("sku").agg(F.min("name").alias("product_name"), F.coalesce(F.sum("qty"), F.lit(0)).cast("long").alias("total_quantity_sold"), total("total").alias("total_revenue"), F.count("*").alias("order_occurrences"))
    return found.withColumn("total_revenue", cents("total_revenue"))


def changed(orders: DataFrame, watermark: str) -> DataFrame:
    """Orders whose update or order time is later than the watermark."""
    return orders.where((F.col("updated_at") > watermark) | (F.col("order_date") > watermark))


def affected_keys(delta: DataFrame, tracker: DataFrame, key: str) -> DataFrame:
    """The keys that changed orders belong to now or belonged to before."""
    new = _keys(delta)
    old = tracker.join(delta.select("id_order"), "id_order", "left_semi")
    part = (lambda df: df.select("date")) if key == "date" else (lambda df: df.select(F.explode("skus").alias("sku")))
    return part(new).unionByName(part(old)).where(f"{key} is not null").distinct()


def incremental(view: DataFrame, orders: DataFrame, affected: DataFrame, name: str) -> DataFrame:
    """The view with its affected keys recomputed; keys that no order has any more are gone."""
    key = VIEWS[name]
    again = (daily_sales if key == "date" else product_sales)(orders, affected)
    return view.join(affected, key, "left_anti").unionByName(again, allowMissingColumns=True)


def refresh(store: Warehouse, name: str, now: str, full: bool = False, table: str = "orders_validated") -> dict:
    """Bring a view up to date and say how: mode, status, number of affected keys, watermark."""
    if name not in VIEWS:
        raise ValueError(f"unknown view: {name}")
    key, mark, tracks, base = VIEWS[name], f"view:{name}", f"view_keys_{VIEWS[name]}", store.number
    orders = store.read(table, ORDER)
    since = store.state.get(mark)
    build = daily_sales if key == "date" else product_sales
    latest = orders.agg(F.max(F.coalesce(F.nullif("updated_at", F.lit("")), "order_date"))).first()[0]
    if full or since is None or not store.has(name) or store.read(name).isEmpty():
        view = build(orders).withColumn("last_refreshed_at", F.lit(now))
        store.commit({name: view, tracks: _keys(orders)}, {mark: latest}, base=base)
        return {"view": name, "mode": "full", "status": "refreshed", "affected": store.read(name).count(), "watermark": latest}
    delta = cut(changed(orders, since).select("id_order", "order_date", "items", "updated_at"))
    tracker = store.read(tracks, TRACKER)
    keys = cut(affected_keys(delta, tracker, key))
    n = keys.count()
    if n == 0:
        return {"view": name, "mode": "incremental", "status": "up_to_date", "affected": 0, "watermark": since}
    old = store.read(name)
    view = incremental(old.drop("last_refreshed_at"), orders, keys, name).join(old.select(key, F.col("last_refreshed_at").alias("_was")), key, "left").join(keys.withColumn("_new", F.lit(True)), key, "left")
    view = view.withColumn("last_refreshed_at", F.when(F.col("_new"), F.lit(now)).otherwise(F.col("_was"))).drop("_was", "_new")
    moved = tracker.join(delta.select("id_order"), "id_order", "left_anti").unionByName(_keys(delta))
    new = max(since, delta.agg(F.max(F.greatest(F.coalesce("updated_at", "order_date"), F.coalesce("order_date", "updated_at")))).first()[0] or since)
    store.commit({name: view, tracks: moved}, {mark: new}, base=base)
    return {"view": name, "mode": "incremental", "status": "refreshed", "affected": n, "watermark": new}


def refresh_all(store: Warehouse, now: str, full: bool = False) -> list[dict]:
    return [refresh(store, name, now, full) for name in VIEWS]


def read_view(store: Warehouse, name: str, limit: int = 100, skip: int = 0) -> DataFrame:
    if name not in VIEWS:
        raise ValueError(f"unknown view: {name}")
    return store.read(name).orderBy(F.desc(VIEWS[name])).offset(skip).limit(limit)
