"""The same loads as streams: files to the raw layer, deltas to the store, messages without repeats, event-time windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.functions.text import identifier_col
from millrace.operators.incremental import process_delta
from millrace.operators.redelivery import deduplicated
from millrace.sources.store import Warehouse


def stream_deltas(spark: SparkSession, source: str, schema: str, store: Warehouse, checkpoint: str, now: Callable[[], str], pipeline: str = "incremental", files: int = 100) -> StreamingQuery:
    """Take all new parquet files under source through the incremental load and stop. A batch that is run again is skipped: its number is in the store's state."""

    def load(batch: DataFrame, number: int) -> None:
        mark = f"batch:{pipeline}"
        if store.state.get(mark, -1) >= number:
            return
        process_delta(store, batch, now(), pipeline, state={mark: number})

    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    return reader.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_deliveries(stream: DataFrame, key: str = "id_order", at: str = "received_at", late: str = "7 days") -> DataFrame:
    """The first delivery to arrive of each message; the state forgets identifiers after the time a repeat may be late.

    A plan without a ledger, hence not the whole: rows without an identifier and rows behind the watermark are left out. stream_once keeps both.
    """
    rows = stream.withColumn("_key", identifier_col(F.col(key))).withColumn(at, F.col(at).cast("timestamp")).where("_key is not null")
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def stream_once(stream: DataFrame, path: str, key: str = "id_order", row_id: str = "delivery_id", at: str = "received_at") -> StreamingQuery:
    """Take all messages that are there, append to path/rows each that repeats none before it, and stop.

    path/seen is the ledger of all identifiers so far, so no row is too late: neither a first delivery nor a repeat. Within a batch the
    earliest delivery stays, as in redelivered(). Rows without an identifier pass unchanged. Both folders have a part for each batch, which
    is overwritten if the batch is run again.
    """

    def load(batch: DataFrame, number: int) -> None:
        spark, part = batch.sparkSession, f"batch={number}"
        rows = deduplicated(batch, key, row_id, at)
        if number:
            seen = spark.read.schema("_seen string, batch long").parquet(f"{path}/seen").where(F.col("batch") < number)
            rows = rows.join(seen, identifier_col(rows[key]) == seen["_seen"], "left_anti")
        rows.write.mode("overwrite").parquet(f"{path}/rows/{part}")
        new = spark.read.schema(batch.schema).parquet(f"{path}/rows/{part}").select(identifier_col(F.col(key)).alias("_seen"))
        new.where("_seen is not null").write.mode("overwrite").parquet(f"{path}/seen/{part}")

    return stream.writeStream.foreachBatch(load).option("checkpointLocation", f"{path}/_checkpoint").trigger(availableNow=True).start()


def windowed(stream: DataFrame, at: str, width: str, slide: str | None = None, late: str = "1 day", by: tuple[str, ...] = (), value: str = "value") -> DataFrame:
    """Count and sum in tumbling or sliding windows of event time; late rows count until the watermark passes."""
    rows = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    window = F.window(at, width, slide) if slide else F.window(at, width)
    found = rows.groupBy(window.alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return found.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n", "total")


def sessions(stream: DataFrame, at: str, gap: str, key: str, late: str = "1 day") -> DataFrame:
    """Sessions of a key: runs of events with no gap of that length."""
    rows = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    found = rows.groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return found.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def to_folder(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what is final to a parquet folder, exactly once, and stop when all that is there is read."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
