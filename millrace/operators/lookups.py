"""Parameterised lookups over validated orders, with the checks of their parameters and deterministic paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check_page(limit: int, skip: int) -> None:
    if not isinstance(limit, int) or isinstance(limit, bool) or limit <= 0:
        raise ValueError("limit: a whole number from 1 on is needed")
    if not isinstance(skip, int) or isinstance(skip, bool) or skip < 0:
        raise ValueError("skip: a whole number from 0 on is needed")


def _text(name: str, value: str) -> str:
    if not isinstance(value, str) or not value.strip():
        raise ValueError(f"{name}: a text is needed")
    return value.strip()


def page(df: DataFrame, limit: int = 50, skip: int = 0, *order: Column) -> DataFrame:
    """One page in the given order; without one, or among equals, by id_order and all it leaves open by record_id where there is one."""
    check_page(limit, skip)
    keys = [F.col(c) for c in ("id_order", "record_id") if c in df.columns]
    return df.orderBy(*order, *keys).offset(skip).limit(limit)


def orders_by_customer(df: DataFrame, customer_id: str, limit: int = 50, skip: int = 0) -> DataFrame:
    return page(df.where(F.col("customer.customer_id") == _text("customer_id", customer_id)), limit, skip)


def orders_by_city(df: DataFrame, city: str, limit: int = 50, skip: int = 0) -> DataFrame:
    return page(df.where(F.col("customer.address.city") == _text("city", city)), limit, skip)


def orders_by_status(df: DataFrame, status: str, limit: int = 50, skip: int = 0) -> DataFrame:
    return page(df.where(F.col("status") == _text("status", status)), limit, skip)


def orders_by_date_range(df: DataFrame, start_date: str, end_date: str, limit: int = 50, skip: int = 0) -> DataFrame:
    """A closed range of the date text, compared as text: an end without a time leaves out that day's later times."""
    start, end = _text("start_date", start_date), _text("end_date", end_date)
    if start > end:
        raise ValueError("start_date is after end_date")
    return page(df.where(F.col("order_date").between(start, end)), limit, skip, F.asc("order_date"))


def high_value_orders(df: DataFrame, min_amount: float, limit: int = 50, skip: int = 0) -> DataFrame:
    try:
        least = float(min_amount)
    except (TypeError, ValueError):
        raise ValueError("min_amount: a number is needed") from None
    if least < 0:
        raise ValueError("min_amount is below 0")
    return page(df.where(F.col("total_amount") >= least), limit, skip, F.desc("total_amount"))


def orders_by_city_and_status(df: DataFrame, city: str, status: str, limit: int = 50, skip: int = 0) -> DataFrame:
    return page(df.where((F.col("customer.address.city") == _text("city", city)) & (F.col("status") == _text("status", status))), limit, skip)


def search(df: DataFrame, term: str, *columns: str) -> DataFrame:
    """Rows of which a column matches a regular expression, in any case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c).rlike("(?i)" + term), F.lit(False))
    return df.where(hit)


def sample(df: DataFrame, given: dict[str, object] | None = None, limit: int = 10) -> DataFrame:
    """The first rows, by key, of which the given fields (paths) have the given values; null asks for a missing one."""
    for path, value in (given or {}).items():
        df = df.where(F.col(path).isNull() if value is None else F.col(path) == value)
    return page(df, limit, 0)


def with_code(df: DataFrame, code: str) -> DataFrame:
    """Quarantined rows that carry an error code."""
    return df.where(F.array_contains("codes_error", code))


#: name -> description, function, parameters
QUERIES = {
    "orders_by_customer": {"description": "orders of a customer", "func": orders_by_customer, "parameters": ("customer_id", "limit", "skip")},
    "orders_by_city": {"description": "orders to a city", "func": orders_by_city, "parameters": ("city", "limit", "skip")},
    "orders_by_status": {"description": "orders in a status", "func": orders_by_status, "parameters": ("status", "limit", "skip")},
    "orders_by_date_range": {"description": "orders between two dates", "func": orders_by_date_range, "parameters": ("start_date", "end_date", "limit", "skip")},
    "high_value_orders": {"description": "orders of at least an amount", "func": high_value_orders, "parameters": ("min_amount", "limit", "skip")},
    "orders_by_city_and_status": {"description": "orders to a city in a status", "func": orders_by_city_and_status, "parameters": ("city", "status", "limit", "skip")},
}


def run(registry: dict, name: str, df: DataFrame, **parameters) -> DataFrame:
    """Call a registered function; unknown names and parameters raise ValueError."""
    if name not in registry:
        raise ValueError(f"unknown name: {name}")
    unknown = set(parameters) - set(registry[name]["parameters"])
    if unknown:
        raise ValueError(f"unknown parameters: {', '.join(sorted(unknown))}")
    try:
        return registry[name]["func"](df, **parameters)
    except TypeError as e:
        raise ValueError(str(e)) from None
