"""Incremental loading: a watermark, versions in conflict, events seen before. Times are compared as the texts they are stored as."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.cleaners import strip
from millrace.operators.upsert import touched, upsert
from millrace.session import cut
from millrace.sources.store import Warehouse

EPOCH, NEVER = "1970-01-01T00:00:00Z", "9999-12-31T23:59:59Z"
EVENTS = "event_id string, id_order string, processed_at string"


def _time(*names: str) -> Column:
    return F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names])


def delta_filter(records: DataFrame, watermark: str) -> DataFrame:
    """Records later than the watermark; those without a time always pass."""
    return records.where(F.coalesce(_time("updated_at", "order_date"), F.lit(NEVER)) > watermark)


def unseen_events(records: DataFrame, ledger: DataFrame) -> DataFrame:
    """Records without an event or with one that the ledger does not hold. Equal events of one batch all pass."""
    seen = ledger.select(F.col("event_id").alias("_seen")).where("_seen is not null").distinct()
    return records.join(seen, F.col("event_id") == F.col("_seen"), "left_anti")


def resolve_versions(records: DataFrame, stored: DataFrame) -> DataFrame:
    """records with _accepted: whether each is newer than the stored row of its key, by version and then by time."""
    held = stored.select(F.col("id_order").alias("_key"), F.coalesce("version", F.lit(0)).alias("_version"), F.coalesce(_time("updated_at", "order_date"), F.lit(EPOCH)).alias("_stored_at"))
    rows = records.join(held, strip(F.col("id_order")) == F.col("_key"), "left")
    version, at = F.coalesce("version", F.lit(1)), F.coalesce(_time("updated_at", "order_date"), F.lit(EPOCH))
    newer = (version > F.col("_version")) | ((version == F.col("_version")) & (at >= F.col("_stored_at")))
    return rows.withColumn("_accepted", F.col("_key").isNull() | newer).drop("_key", "_version", "_stored_at")


def watermark(records: DataFrame, start: str) -> str:
    found = records.agg(F.max(_time("updated_at", "order_date"))).first()[0]
    return max(start, found) if found else start


def _load(store: Warehouse, records: DataFrame, now: str, pipeline: str, table: str, mode: str, force: bool, state: dict | None = None) -> dict:
    base = store.number
    used = store.state.get(pipeline, EPOCH) if mode == "delta_load" else EPOCH
    read = records if "_row" in records.columns else records.withColumn("_row", F.monotonically_increasing_id())
    read = cut(read)
    delta = read if force or mode == "initial_load" else delta_filter(read, used)
    keyed = delta.where(F.coalesce(strip(F.col("id_order")), F.lit("")) != "")
    ledger = store.read("processed_events", EVENTS)
    fresh = keyed if mode == "initial_load" else unseen_events(keyed, ledger)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema.fields if f.name != "_row")
    stored = store.read(table, schema)
    judged = cut(fresh.withColumn("_accepted", F.lit(True)) if mode == "initial_load" else resolve_versions(fresh, stored))
    accepted = judged.where("_accepted").drop("_accepted")
    counts = {r: n for r, n in zip(("read", "delta", "keyed", "judged", "accepted"), (read.count(), delta.count(), keyed.count(), judged.count(), accepted.count()))}
    new = watermark(judged, used)
    done = upsert(touched(stored, accepted), accepted, now)
    merged = cut(done.merged)
    actions = done._replace(merged=merged).counts()
    events = accepted.where("event_id is not null and event_id <> ''").groupBy("event_id").agg(F.max("id_order").alias("id_order")).withColumn("processed_at", F.lit(now))
    if counts["accepted"] or new != used or mode == "initial_load" or state:
        changes = {}
        if counts["accepted"] or not store.has(table):
            written = merged.where("_action in ('inserted', 'updated')").drop("_action")
            changes = {table: (written, "id_order"), "processed_events": (events, "event_id")}
        store.commit(upsert=changes, state={pipeline: new} | (state or {}), base=base)
    return {
        "mode": mode,
        "watermark_used": used,
        "delta_records_read": counts["read"],
        "filtered_by_watermark": counts["read"] - counts["delta"],
        "processed_count": counts["accepted"],
        **actions,
        "conflicts_rejected": counts["judged"] - counts["accepted"],
        "events_skipped": counts["keyed"] - counts["judged"],
        "new_watermark": new,
    }


def initial_load(store: Warehouse, records: DataFrame, now: str, pipeline: str = "incremental", table: str = "orders_validated") -> dict:
    """Take over all records as the base and set the watermark to the latest of their times."""
    return _load(store, records, now, pipeline, table, "initial_load", False)


def process_delta(store: Warehouse, records: DataFrame, now: str, pipeline: str = "incremental", table: str = "orders_validated", force: bool = False, state: dict | None = None) -> dict:
    """Filter by the watermark (unless forced), skip events seen before, reject stale versions, upsert the rest, advance the watermark.

    The changed rows, the ledger's new events, the watermark and more state, if given, are committed together, and nothing else is written. Of several versions of a key in one batch the last in the batch's order wins,
    each having been compared with the store. Rejected records advance the watermark too.
    """
    return _load(store, records, now, pipeline, table, "delta_load", force, state)
