"""Layouts in place of indexes: rows sorted within files so that min-max statistics skip row groups, and a comparison of what is read."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.sources.store import Warehouse

#: What the lookups filter by, in the order that rows are sorted.
SORT = ("order_date", "id_order")


def sorted_rows(df: DataFrame, *keys: str) -> DataFrame:
    """Rows range-partitioned and sorted by the keys: a file holds a narrow range, its statistics say which."""
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def rewrite(store: Warehouse, table: str, keys: tuple[str, ...] = SORT) -> dict:
    """Commit a table anew in sorted order."""
    number = store.compact(table, sorted_rows(store.read(table), *keys))
    store.commit(state={"layouts": {table: list(keys)}})
    return {"table": table, "sorted_by": list(keys), "commit": number}


def layouts(store: Warehouse) -> dict[str, list[str]]:
    """The tables that were sorted, and by what."""
    return {table: keys for table, keys in store.state.get("layouts", {}).items() if keys}


def forget(store: Warehouse, table: str) -> bool:
    """Let a table be compacted without an order from now on; whether it had one."""
    had = table in layouts(store)
    if had:
        store.commit(state={"layouts": {table: []}})
    return had


def compact(store: Warehouse, table: str) -> int:
    """One folder of a table's many, in its order if it has one."""
    keys = layouts(store).get(table)
    return store.compact(table, sorted_rows(store.read(table), *keys) if keys else None)


def plan_of(df: DataFrame) -> dict:
    """What of a plan tells an access path: the filters at the scan, the columns read, the operators from the top."""
    text = df._jdf.queryExecution().executedPlan().toString()
    lines = [x.strip() for x in text.splitlines()]
    scan = next((x for x in lines if "FileScan" in x), "")
    part = lambda name: scan.partition(f"{name}: ")[2].partition("]")[0] + "]" if f"{name}: [" in scan else ""
    return {"pushed": part("PushedFilters"), "schema": scan.partition("ReadSchema: ")[2], "operators": [x.lstrip("+-:* ()0123456789").split(" ")[0].split("(")[0] for x in lines if x]}


def compare(df: DataFrame, predicate: Column, path: str, keys: tuple[str, ...] = SORT, files: int = 16) -> list[dict]:
    """Read the rows of a predicate from the table as it is and from a sorted copy: plan, files that hold hits, seconds."""
    out = []
    spark = df.sparkSession
    for name, rows in (("as it is", df.repartition(files)), ("sorted", df.repartitionByRange(files, *keys).sortWithinPartitions(*keys))):
        rows.write.mode("overwrite").parquet(f"{path}/{name.replace(' ', '_')}")
        found = spark.read.parquet(f"{path}/{name.replace(' ', '_')}").where(predicate)
        began = time.time()
        hits = found.count()
        out.append({"layout": name, "rows": hits, "seconds": round(time.time() - began, 3), "files_with_hits": found.select(F.input_file_name()).distinct().count(), **plan_of(found)})
    return out
