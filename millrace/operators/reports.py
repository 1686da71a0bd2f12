"""Aggregation reports over validated orders. Sums of nothing are 0, amounts are rounded half to even, ties are broken by the key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _positive(name: str, value, default: int) -> int:
    if value is None:
        return default
    try:
        number = int(value)
    except (TypeError, ValueError):
        raise ValueError(f"{name}: a whole number is needed") from None
    if number <= 0:
        raise ValueError(f"{name}: a number above 0 is needed")
    return number


def total(col: str) -> Column:
    return F.coalesce(F.sum(col), F.lit(0.0))


def cents(col: str | Column) -> Column:
    return F.bround(col, 2)


def sales_by_city(df: DataFrame, limit: int = 20, min_orders: int = 1) -> DataFrame:
    limit, least = _positive("limit", limit, 20), _positive("min_orders", min_orders, 1)
    city = F.col("customer.address.city")
    rows = df.where(city.isNotNull() & ~city.isin("", "null")).groupBy(city.alias("city")).agg(total("total_amount").alias("total_revenue"), F.count("*").alias("total_orders"), F.avg("total_amount").alias("avg_order_value"))
    return rows.where(F.col("total_orders") >= least).withColumns({c: cents(c) for c in ("total_revenue", "avg_order_value")}).orderBy(F.desc("total_revenue"), "city").limit(limit)


def _lines(df: DataFrame) -> DataFrame:
    return df.where(F.size("items") > 0).select(F.explode("items").alias("item")).where("item.sku is not null").select("item.*")


def top_products(df: DataFrame, limit: int = 10, min_qty: int = 1) -> DataFrame:
    """By sku and name."""
    limit, least = _positive("limit", limit, 10), _positive("min_qty", min_qty, 1)
    rows = _lines(df).groupBy("sku", F.col("name").alias("product_name")).agg(F.coalesce(F.sum("qty"), F.lit(0)).cast("long").alias("total_quantity_sold"), total("total").alias("total_revenue"), F.count("*").alias("order_occurrences"))
    return rows.where(F.col("total_quantity_sold") >= least).withColumn("total_revenue", cents("total_revenue")).orderBy(F.desc("total_revenue"), "sku", "product_name").limit(limit)


def top_customers(df: DataFrame, limit: int = 10, min_spend: float = 0.0) -> DataFrame:
    """Compares the unrounded sum; the name is the smallest of those given."""
    limit = _positive("limit", limit, 10)
    try:
        least = float(min_spend if min_spend is not None else 0.0)
    except (TypeError, ValueError):
        raise ValueError("min_spend: a number is needed") from None
    if least < 0:
        raise ValueError("min_spend is below 0")
    customer = F.col("customer.customer_id")
    rows = df.where(customer.isNotNull() & ~customer.isin("", "null")).groupBy(customer.alias("customer_id")).agg(
        F.min("customer.name").alias("customer_name"), total("total_amount").alias("total_spend"), F.count("*").alias("total_orders"), F.avg("total_amount").alias("avg_order_spend"), F.max("order_date").alias("last_order_date")
    )
    return rows.where(F.col("total_spend") >= least).withColumns({c: cents(c) for c in ("total_spend", "avg_order_spend")}).orderBy(F.desc("total_spend"), "customer_id").limit(limit)


def sales_by_period(df: DataFrame, period: str = "daily", start_date: str | None = None, end_date: str | None = None, limit: int = 30) -> DataFrame:
    """By day or month of the date text. A bound replaces the test that a date is given."""
    limit = _positive("limit", limit, 30)
    if period not in ("daily", "monthly"):
        raise ValueError("period: daily or monthly")
    if start_date and end_date and start_date > end_date:
        raise ValueError("start_date is after end_date")
    when = F.col("order_date")
    keep = when.isNotNull() & (when != "")
    if start_date or end_date:
        keep = F.lit(True)
        keep = keep & (when >= start_date) if start_date else keep
        keep = keep & (when <= end_date) if end_date else keep
    rows = df.where(keep).groupBy(F.substring(when, 1, 10 if period == "daily" else 7).alias("period")).agg(total("total_amount").alias("total_revenue"), F.count("*").alias("total_orders"), F.avg("total_amount").alias("avg_order_value"))
    return rows.withColumns({c: cents(c) for c in ("total_revenue", "avg_order_value")}).orderBy(F.desc("period")).limit(limit)


def orders_by_status(df: DataFrame, min_orders: int = 1) -> DataFrame:
    least = _positive("min_orders", min_orders, 1)
    status = F.col("status")
    rows = df.where(status.isNotNull() & ~status.isin("", "null")).groupBy("status").agg(F.count("*").alias("count_orders"), total("total_amount").alias("total_value"), F.avg("total_amount").alias("avg_value"))
    return rows.where(F.col("count_orders") >= least).withColumns({c: cents(c) for c in ("total_value", "avg_value")}).orderBy(F.desc("count_orders"), "status")


def quarantine_summary(df: DataFrame) -> DataFrame:
    """How many quarantined rows carry each error code."""
    return df.select(F.explode("codes_error").alias("code")).groupBy("code").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "code")


def key_figures(df: DataFrame) -> DataFrame:
    """One row: number of orders, the first five cities and products, the statuses, each as an array of structs."""
    def rows(found: DataFrame, name: str) -> DataFrame:
        return found.agg(F.array_sort(F.collect_list(F.struct(*found.columns))).alias(name))  # five rows, or one a status

    counted = df.agg(F.count("*").alias("total_orders"))
    parts = (("top_cities", sales_by_city(df, 5)), ("top_products", top_products(df, 5)), ("statuses", orders_by_status(df)))
    for name, found in parts:
        counted = counted.join(F.broadcast(rows(found, name)))
    return counted


AGGREGATIONS = {
    "sales_by_city": {"description": "revenue by city", "func": sales_by_city, "parameters": ("limit", "min_orders")},
    "top_products": {"description": "products by revenue", "func": top_products, "parameters": ("limit", "min_qty")},
    "top_customers": {"description": "customers by spending", "func": top_customers, "parameters": ("limit", "min_spend")},
    "sales_by_period": {"description": "revenue by day or month", "func": sales_by_period, "parameters": ("period", "start_date", "end_date", "limit")},
    "orders_by_status": {"description": "orders by status", "func": orders_by_status, "parameters": ("min_orders",)},
}
