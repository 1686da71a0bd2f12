"""Reading order files: routing, layouts, CSV, JSON lines and JSON, each row with its number in the file and its untouched content."""

from __future__ import annotations

import hashlib
import os
import secrets
from datetime import datetime, timezone
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.cleaners import json_value, strip
from millrace.functions.schema import LAYOUTS
from millrace.operators.rejects import load_records
from millrace.sources.records import csv_records

SUFFIXES = (".csv", ".jsonl", ".json")
#: Where a raw record keeps the text of a CSV record that does not parse, and why it does not.
UNPARSEABLE, REASON = "_unparseable_record", "_reject_reason"
#: Files up to this size need no cluster-wide read.
SMALL_MB = 200.0
ENGINES = {"local": "local", "batch": "local", "python": "local", "python_batch": "local", "spark": "spark", "pyspark": "spark"}


class Route(NamedTuple):
    path: str
    size_mb: float
    suffix: str
    engine: str
    id_run: str
    fingerprint: str


def run_id(now: datetime | None = None) -> str:
    return f"run_{(now or datetime.now(timezone.utc)):%Y%m%d_%H%M%S}_{secrets.token_hex(3)}"


def fingerprint(path: str) -> str:
    """Of a file's name, size and time of change."""
    info = os.stat(path)
    return hashlib.md5(f"{os.path.basename(path)}_{info.st_size}_{info.st_mtime}".encode(), usedforsecurity=False).hexdigest()


def route(path: str, threshold_mb: float = SMALL_MB, engine: str | None = None, resume: str | None = None) -> Route:
    """Check a file and decide how it is read: by the engine asked for, else by its size."""
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    if not os.path.isfile(path):
        raise ValueError(f"not a file: {path}")
    size = os.path.getsize(path)
    if size == 0:
        raise ValueError(f"empty file: {path}")
    suffix = os.path.splitext(path)[1].lower()
    if suffix not in SUFFIXES:
        raise ValueError(f"unsupported file type: {suffix}")
    if engine is not None and engine.lower() not in ENGINES:
        raise ValueError(f"unknown engine: {engine}")
    chosen = ENGINES[engine.lower()] if engine else "local" if size / 2**20 <= threshold_mb else "spark"
    return Route(path, size / 2**20, suffix, chosen, resume or run_id(), fingerprint(path))


def header(path: str) -> list[str]:
    """The names in a CSV file's first line."""
    import csv

    with open(path, encoding="utf-8-sig", newline="") as lines:
        return [n.strip() for n in next(csv.reader(lines), [])]


def layout(path: str) -> list[str]:
    """The columns of a CSV file: those of a known layout if the header is exactly that, else the header's in small letters."""
    names = header(path)
    return names if tuple(names) in LAYOUTS else [n.lower() for n in names]


def numbered(df: DataFrame, name: str = "number_row_source") -> DataFrame:
    """df with row numbers from 1 without gaps, in the order of the files: offsets come from the sizes of the partitions."""
    rows = df.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    sizes = rows.groupBy("_part").agg(F.count("*").alias("n"), F.min("_at").alias("first")).collect()  # one row a partition
    total, offsets = 0, []
    for r in sorted(sizes, key=lambda r: r["_part"]):
        offsets.append((r["_part"], total - r["first"]))
        total += r["n"]
    table = df.sparkSession.createDataFrame(offsets, "_part int, _shift long")
    return rows.join(F.broadcast(table), "_part").withColumn(name, F.col("_at") + F.col("_shift") + 1).drop("_part", "_at", "_shift")


def read_csv(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """(number_row_source, the columns as text, _reason, _record) of a CSV file, or of a folder of files whose columns have these names; quoted line breaks are part of a value.

    A record that is not well-formed or has another number of fields than the header has a reason, its text and no values.
    """
    names = names or layout(path)
    records = csv_records(spark, path, len(names)).where("number > 0")
    found = load_records(records, "number", "value", [f"c{i}" for i in range(len(names))], keep=("value",), items=None, amount=None)
    return found.select(F.col("number").alias("number_row_source"), *[F.col(f"c{i}").alias(n) for i, n in enumerate(names)], F.col("reason").alias("_reason"), F.when(F.col("reason").isNotNull(), F.col("value")).alias("_record"))


def read_lines(spark: SparkSession, path: str, wrapper: str = "_unparseable_line") -> DataFrame:
    """(number_row_source, record_raw) of each line that is not blank; blank ones use up a number. A line that is no JSON is wrapped."""
    rows = numbered(spark.read.text(path)).where(F.trim("value") != "")
    wrapped = F.to_json(F.struct(F.col("value").alias(wrapper)))
    return rows.select("number_row_source", F.when(json_value(F.col("value")).isNotNull(), F.col("value")).otherwise(wrapped).alias("record_raw"))


def business_key(raw: Column) -> Column:
    """The trimmed id_order or, if that is missing or empty, order_id of a record's text."""
    value = F.try_parse_json(raw)
    keys = [F.nullif(strip(F.try_variant_get(value, f"$.{k}", "string")), F.lit("")) for k in ("id_order", "order_id")]
    return F.coalesce(*keys)


def raw_layer(df: DataFrame, id_run: str, file_source: str, engine: str, now: str) -> DataFrame:
    """Rows with what is known of their origin, all of the row as JSON text and nothing else beside it."""
    if "record_raw" in df.columns:
        rows, key = df, business_key(F.col("record_raw"))
    else:
        data = [c for c in df.columns if c not in ("number_row_source", "_reason", "_record")]
        keys = [F.nullif(strip(F.col(c)), F.lit("")) for c in ("id_order", "order_id") if c in data]
        key = F.coalesce(*keys) if keys else F.lit(None).cast("string")
        text = F.to_json(F.struct(*data), {"ignoreNullFields": "false"})
        if "_reason" in df.columns:
            text = F.when(F.col("_reason").isNull(), text).otherwise(F.to_json(F.struct(F.col("_record").alias(UNPARSEABLE), F.col("_reason").alias(REASON))))
        rows = df.withColumn("record_raw", text)
    return rows.select(
        F.lit(id_run).alias("id_run"), F.lit(file_source).alias("file_source"), F.col("number_row_source").cast("long").alias("number_row_source"),
        F.lit(now).alias("at_ingested"), F.lit(engine).alias("engine_used"), key.alias("id_order"), "record_raw",
    )


def read_file(spark: SparkSession, found: Route, now: str, partitions: int = 0) -> DataFrame:
    """The raw layer of a routed file."""
    if found.suffix == ".csv":
        rows = read_csv(spark, found.path)
    else:
        rows = read_lines(spark, found.path, "_unparseable_line" if found.suffix == ".jsonl" else "raw_line")
    if partitions > 0:
        rows = rows.repartition(partitions)
    return raw_layer(rows, found.id_run, os.path.basename(found.path), found.engine, now)


def write_raw(raw: DataFrame, path: str) -> None:
    """Replace the partition of each run in raw, and no other: a replay changes nothing."""
    raw.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("id_run").parquet(path)


def profile(spark: SparkSession, path: str, rows: int = 5) -> dict:
    """The first rows, the columns and the number of rows; of large files an estimate from the size."""
    found = route(path)
    df = read_csv(spark, path).drop("_reason", "_record").orderBy("number_row_source") if found.suffix == ".csv" else spark.read.text(path)
    exact = os.path.getsize(path) <= SMALL_MB * 2**20
    return {"columns": [c for c in df.columns if c != "number_row_source"], "preview": [r.asDict() for r in df.limit(rows).collect()], "rows": df.count() if exact else os.path.getsize(path) // 220, "exact": exact}


def write_sample(spark: SparkSession, path: str, rows: int, out: str) -> None:
    """The first rows of a file, with its header, as a folder of the same format."""
    found = route(path)
    if found.suffix == ".csv":
        read_csv(spark, path).where("_reason is null").orderBy("number_row_source").limit(rows).drop("number_row_source", "_reason", "_record").coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(out)
    else:
        spark.read.text(path).limit(rows).coalesce(1).write.mode("overwrite").text(out)


def export_csv(df: DataFrame, out: str) -> None:
    """Any table as CSV; arrays and structs as JSON text."""
    flat = [F.to_json(c).alias(c) if kind.startswith(("array", "struct", "map")) else F.col(c) for c, kind in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').csv(out)
