"""The service surface as one function: a method, a path and parameters in, a status and plain values out. Any HTTP server can sit on it."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import SparkSession

from millrace.functions.schema import ORDER
from millrace.operators import lookups, reports, views
from millrace.plans import layout, pipeline
from millrace.sources.store import Warehouse

NUMBERS: dict[str, Callable] = {"limit": int, "skip": int, "min_orders": int, "min_qty": int, "min_spend": float, "min_amount": float}


def _registered(registry: dict) -> list[dict]:
    return [{"name": n, "description": r["description"], "parameters": list(r["parameters"])} for n, r in registry.items()]


def _run(store: Warehouse, registry: dict, name: str, given: dict) -> tuple[int, object]:
    if name not in registry:
        return 404, {"error": f"unknown name: {name}"}
    try:
        parameters = {k: NUMBERS[k](v) if k in NUMBERS and isinstance(v, str) else v for k, v in given.items()}
        wanted = inspect.signature(registry[name]["func"]).parameters
        missing = [p for p, how in list(wanted.items())[1:] if how.default is inspect.Parameter.empty and p not in parameters]
        if missing:
            raise ValueError(f"missing parameters: {', '.join(missing)}")
        found = lookups.run(registry, name, store.read("orders_validated", ORDER), **parameters)
    except ValueError as e:
        return 400, {"error": str(e)}
    return 200, [r.asDict(True) for r in found.collect()]  # limited by the query's own limit


def handle(spark: SparkSession, store: Warehouse, method: str, path: str, given: dict | None = None, now: str | None = None) -> tuple[int, object]:
    """(status, body): 404 for an unknown path or name, 400 for bad parameters, 503 if the session is down, 500 if the work fails."""
    given = dict(given or {})
    parts = [p for p in path.split("/") if p]
    now = now or pipeline.utc_now()
    try:
        match (method.upper(), *parts):
            case ("GET", "health"):
                try:
                    return 200, pipeline.health(spark)
                except Exception as e:
                    return 503, {"error": str(e)}
            case ("POST", "ingest"):
                try:
                    return 201, pipeline.ingest(spark, store, given["path"], float(given.get("threshold_mb") or 200.0), given.get("engine"), now)
                except (FileNotFoundError, KeyError, ValueError) as e:
                    return 400, {"error": str(e)}
            case ("POST", "indexes"):
                return 200, {"layout": layout.rewrite(store, "orders_validated")}
            case ("GET", "queries"):
                return 200, _registered(lookups.QUERIES)
            case ("GET", "queries", name):
                return _run(store, lookups.QUERIES, name, given)
            case ("GET", "aggregations"):
                return 200, _registered(reports.AGGREGATIONS)
            case ("GET", "aggregations", name):
                return _run(store, reports.AGGREGATIONS, name, given)
            case ("POST", "refresh-mv"):
                return 200, views.refresh_all(store, now, bool(given.get("full")))
            case ("GET", "views", name):
                try:
                    return 200, [r.asDict(True) for r in views.read_view(store, name, int(given.get("limit", 100)), int(given.get("skip", 0))).collect()]
                except ValueError as e:
                    return 400, {"error": str(e)}
            case ("GET", "jobs"):
                return 200, [{"name": n, "description": j["description"], "minutes": j["minutes"]} for n, j in pipeline.JOBS.items()]
            case ("POST", "jobs", name, "run"):
                return (200, pipeline.run_job(store, name, now=now)) if name in pipeline.JOBS else (404, {"error": f"unknown job: {name}"})
    except Exception as e:
        return 500, {"error": str(e)}
    return 404, {"error": f"unknown path: {path}"}
