"""The whole way of a file: route, raw layer, clean and classify, upsert, quarantine, metrics; and the jobs around it."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.schema import ORDER
from millrace.operators import reports, views
from millrace.operators.quality import classify
from millrace.operators.upsert import Upsert, touched, upsert
from millrace.plans import layout
from millrace.session import cut, spread
from millrace.sources import checkpoints as CP
from millrace.sources.files import REASON, Route, read_file, route
from millrace.sources.store import Warehouse

QUARANTINE = (
    "quarantine_key string, id_run string, file_source string, number_row_source long, source_row_number long, id_order string, codes_error array<string>, details_error array<string>, "
    "record_raw string, cleaned_attempt string, reject_reason string, quarantined_at string"
)
RUNS = (
    "id_run string, timestamp string, file_source string, file_size_mb double, threshold_mb double, engine string, engine_reason string, read_rows long, loaded_raw long, rejected_rows long, valid long, corrected long, quarantined long, "
    "sum_classified long, consistent boolean, inserted long, updated long, unchanged long, seconds double, rows_per_second double, batch_rows long, batches long, partitions long, resumed_from long, codes map<string, long>"
)
JOB_LOG = "job string, trigger string, status string, start_time string, seconds double, message string"


def utc_now() -> str:
    return datetime.now(timezone.utc).isoformat()


def validated_rows(classified: DataFrame, now: str) -> DataFrame:
    """The good records as orders, in the order of their rows."""
    good = classified.where("outcome <> 'QUARANTINED'")
    return good.select("cleaned.*", F.lower("outcome").alias("quality_status"), "corrections", F.lit(now).alias("processed_at"), F.col("number_row_source").alias("_row"))


def quarantine_rows(classified: DataFrame, now: str) -> DataFrame:
    """The bad records with their codes and what cleaning made of them, under the key run:row."""
    bad = classified.where("outcome = 'QUARANTINED'")
    row = F.col("number_row_source")
    attempt = F.when(F.col("cleaned").isNotNull(), F.to_json("cleaned"))
    return bad.select(
        F.concat_ws(":", "id_run", row.cast("string")).alias("quarantine_key"), "id_run", "file_source", row, row.alias("source_row_number"), F.coalesce("cleaned.id_order", "id_order").alias("id_order"), "codes_error", "details_error",
        "record_raw", attempt.alias("cleaned_attempt"), F.get_json_object("record_raw", f"$.{REASON}").alias("reject_reason"), F.lit(now).alias("quarantined_at"),
    )


def code_counts(classified: DataFrame) -> dict[str, int]:
    """How many records have each error code."""
    return {r["code"]: r["count"] for r in classified.select(F.explode("codes_error").alias("code")).groupBy("code").count().collect()}  # a row for each code


def ingest(spark: SparkSession, store: Warehouse, path: str, threshold_mb: float = 200.0, engine: str | None = None, now: str | None = None, allowed: dict | None = None, attempts: int = 3, batch_rows: int | None = None) -> dict:
    """Load a file and say what became of its rows. Loading the same file twice changes no order.

    The raw layer is appended batch by batch (all rows are one batch unless batch_rows is given), each together with the checkpoint that
    counts it: a run that failed is taken up again behind the last of them. Nothing that was there before is written again.
    """
    now = now or utc_now()
    began = time.time()
    found = route(path, threshold_mb, engine)
    point = CP.active(store, found.fingerprint)
    if point:
        found = found._replace(id_run=point.id_run)
    start = point.processed_rows if point else 0
    for attempt in range(attempts):
        try:
            out = _ingest(spark, store, found, now, allowed, began, batch_rows, threshold_mb, start, "asked for" if engine else "size")
            CP.save(store, CP.Checkpoint(found.fingerprint, found.id_run, CP.COMPLETED, out["read_rows"], now))
            return out
        except Exception as e:
            if attempt + 1 == attempts:
                CP.save(store, CP.Checkpoint(found.fingerprint, found.id_run, CP.FAILED, _processed(store, found), now, str(e)[:500]))
                raise
    raise AssertionError


def _processed(store: Warehouse, found: Route) -> int:
    return max([0, *(p.processed_rows for p in CP.all_of(store, found.fingerprint) if p.id_run == found.id_run)])


def load_raw(spark: SparkSession, store: Warehouse, found: Route, now: str, batch_rows: int | None = None) -> int:
    """Append the rows of a file that the raw layer does not hold yet; the number of batches."""
    done, batches = _processed(store, found), 0
    if not done:
        CP.save(store, CP.Checkpoint(found.fingerprint, found.id_run, CP.IN_PROGRESS, 0, now))
    rows = cut(spread(CP.remaining(read_file(spark, found, now), CP.Checkpoint(found.fingerprint, found.id_run, CP.IN_PROGRESS, done, now))))
    last = rows.agg(F.max("number_row_source")).first()[0]
    while last is not None and done < last:
        end = last if batch_rows is None else min(last, done + batch_rows)
        batch = rows.where((F.col("number_row_source") > done) & (F.col("number_row_source") <= end))
        point = CP.Checkpoint(found.fingerprint, found.id_run, CP.IN_PROGRESS, end, now)
        store.commit(append={"orders_raw": batch}, tags={"orders_raw": f"{found.id_run}/{done + 1}"}, state=CP.state_of(point))
        done, batches = end, batches + 1
    return batches


def raw_of(store: Warehouse, id_run: str) -> DataFrame:
    """The raw rows of one run, from its own folders."""
    return store.read("orders_raw", tag=id_run)


def _ingest(spark: SparkSession, store: Warehouse, found: Route, now: str, allowed: dict | None, began: float, batch_rows: int | None, threshold_mb: float, start: int, reason: str) -> dict:
    batches = load_raw(spark, store, found, now, batch_rows)
    raw = spread(raw_of(store, found.id_run))
    base = store.number
    classified = cut(classify(raw, now=now, allowed=allowed))
    counted = {r["outcome"]: r["count"] for r in classified.groupBy("outcome").count().collect()}  # three outcomes
    good = validated_rows(classified, now)
    done = upsert(touched(store.read("orders_validated", ORDER), good), good, now)
    done = done._replace(merged=cut(done.merged))
    rows = sum(counted.values())
    out = {"id_run": found.id_run, "timestamp": now, "file_source": found.path.rpartition("/")[2], "file_size_mb": round(found.size_mb, 6), "threshold_mb": float(threshold_mb), "engine": found.engine, "engine_reason": reason}
    out |= {"read_rows": raw.count(), "loaded_raw": rows, "rejected_rows": classified.where(F.get_json_object("record_raw", f"$.{REASON}").isNotNull()).count()}
    out |= {**{k.lower(): counted.get(k, 0) for k in ("VALID", "CORRECTED", "QUARANTINED")}, "sum_classified": rows, **done.counts()}
    out["consistent"] = out["read_rows"] == out["valid"] + out["corrected"] + out["quarantined"]
    out["seconds"] = round(time.time() - began, 3)
    out["rows_per_second"] = round(rows / max(out["seconds"], 1e-9), 2)
    out |= {"batch_rows": batch_rows, "batches": batches, "partitions": classified.rdd.getNumPartitions(), "resumed_from": start, "codes": code_counts(classified)}
    store.commit(upsert=_changes(store, done, out), append={"quarantine_orders": quarantine_rows(classified, now), "runs": spark.createDataFrame([out], RUNS)}, tags={"quarantine_orders": found.id_run, "runs": found.id_run}, base=base)
    return out


def _changes(store: Warehouse, done: Upsert, counts: dict) -> dict[str, tuple[DataFrame, str]]:
    """What an upsert has to write: the rows that changed, nothing if there are none."""
    if store.has("orders_validated") and not counts["inserted"] + counts["updated"]:
        return {}
    return {"orders_validated": (done.merged.where("_action in ('inserted', 'updated')").drop("_action"), "id_order")}


def revalidate(store: Warehouse, now: str | None = None, allowed: dict | None = None) -> dict:
    """Classify the quarantine again: what is good now is upserted and leaves it, the rest stays with its new codes."""
    now, base = now or utc_now(), store.number
    held = cut(store.read("quarantine_orders", QUARANTINE))
    again = cut(classify(held.select("id_run", "file_source", "number_row_source", "id_order", "record_raw"), now=now, allowed=allowed))
    good = validated_rows(again, now)
    done = upsert(touched(store.read("orders_validated", ORDER), good), good, now)
    done = done._replace(merged=cut(done.merged))
    bad = quarantine_rows(again, now).drop("quarantined_at").join(held.select("quarantine_key", "quarantined_at"), "quarantine_key").select(*held.columns)
    out = {"total_examined": held.count(), "recovered_count": again.where("outcome <> 'QUARANTINED'").count(), "remaining_quarantine": bad.count(), **done.counts()}
    if out["recovered_count"]:
        store.commit({"quarantine_orders": bad}, upsert=_changes(store, done, out), base=base)
    return out


def audit_runs(runs: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """(id_run, issue) for repeated runs, missing figures, sums that do not add up and throughputs that do not fit their times."""
    repeated = runs.groupBy("id_run").count().where("count > 1").select("id_run", F.lit("repeated run").alias("issue"))
    fits = F.abs(F.col("rows_per_second") - F.col("read_rows") / F.col("seconds")) <= tolerance * F.col("rows_per_second")
    checks = (("missing figure", F.col("read_rows").isNull() | F.col("seconds").isNull()), ("inconsistent counts", ~F.col("consistent")), ("throughput does not fit", F.coalesce(~fits, F.lit(False))))
    for text, wrong in checks:
        repeated = repeated.unionByName(runs.where(F.coalesce(wrong, F.lit(True))).select("id_run", F.lit(text).alias("issue")))
    return repeated


def periodic_report(store: Warehouse) -> dict:
    """The key figures of the validated orders as plain values, which are also written beside the store's tables."""
    row = reports.key_figures(store.read("orders_validated", ORDER)).first()
    found = json.loads(json.dumps(row.asDict(True), ensure_ascii=False, default=str))
    store.write_json("periodic_report", found)
    return found


def compact_all(store: Warehouse) -> dict[str, int]:
    """One folder for each table that commits have made grow, and no folder that is not current."""
    done = {name: layout.compact(store, name) for name in ("orders_raw", "orders_validated", "quarantine_orders", "runs", "job_log", "processed_events") if store.has(name)}
    store.vacuum()
    return done


JOBS: dict[str, dict] = {
    "refresh_views": {"description": "bring the summary views up to date", "func": lambda store, now: views.refresh_all(store, now), "minutes": 60},
    "periodic_report": {"description": "key figures of the validated orders", "func": lambda store, now: periodic_report(store), "minutes": 360},
    "revalidate": {"description": "classify the quarantine again", "func": lambda store, now: revalidate(store, now), "minutes": 1440},
    "compact": {"description": "write each table as one folder", "func": lambda store, now: compact_all(store), "minutes": 1440},
}


def run_job(store: Warehouse, name: str, trigger: str = "manual", now: str | None = None, jobs: dict[str, dict] | None = None) -> object:
    """Run a job; what became of it is always logged, and a failure raised again as RuntimeError."""
    jobs = jobs or JOBS
    if name not in jobs:
        raise ValueError(f"unknown job: {name}")
    now, began, failure, result = now or utc_now(), time.time(), None, None
    try:
        result = jobs[name]["func"](store, now)
    except Exception as e:
        failure = e
    row = (name, trigger, "FAILED" if failure else "SUCCESS", now, round(time.time() - began, 3), str(failure or "")[:500])
    store.commit(append={"job_log": store.spark.createDataFrame([row], JOB_LOG).coalesce(1)})
    if failure:
        raise RuntimeError(f"job {name} failed: {failure}") from failure
    return result


def job_log(store: Warehouse, name: str | None = None, limit: int = 20) -> DataFrame:
    rows = store.read("job_log", JOB_LOG)
    return (rows.where(F.col("job") == name) if name else rows).orderBy(F.desc("start_time"), "job").limit(limit)


def write_job_log(store: Warehouse, most: int = 500) -> str:
    """The newest entries of the job log as a JSON file; its path."""
    return store.write_json("job_log", [r.asDict() for r in job_log(store, limit=most).collect()])


def last_runs(log: DataFrame) -> DataFrame:
    """The last run of each job."""
    return log.groupBy("job").agg(F.max_by(F.struct("status", "seconds"), "start_time").alias("last"), F.max("start_time").alias("start_time")).select("job", "start_time", "last.*")


def health(spark: SparkSession) -> dict[str, Callable | str]:
    """Whether the session answers."""
    return {"status": "ok" if spark.range(1).count() == 1 else "unavailable", "version": spark.version}
