"""python -m millrace ingest FILE | status | runs | refresh [--full] | report NAME | query NAME key=value ... | explain NAME key=value ... | layouts | forget TABLE | idempotency FILE | job NAME | log"""

from __future__ import annotations

import argparse
import json
import sys

from millrace.functions.schema import ORDER
from millrace.operators import lookups, reports, views
from millrace.plans import layout, pipeline
from millrace.session import session
from millrace.sources.store import Warehouse


def _values(pairs: list[str]) -> dict:
    out: dict = {}
    for pair in pairs:
        name, _, text = pair.partition("=")
        try:
            out[name] = json.loads(text)
        except ValueError:
            out[name] = text
    return out


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="millrace", description=__doc__)
    parser.add_argument("--store", required=True)
    parser.add_argument("--master")
    parser.add_argument("--full", action="store_true")
    parser.add_argument("command", choices=("ingest", "status", "runs", "refresh", "report", "query", "explain", "layouts", "forget", "idempotency", "job", "log"))
    parser.add_argument("rest", nargs="*")
    given = parser.parse_args(args)
    spark = session(master=given.master)
    store = Warehouse(spark, given.store)
    show = lambda x: print(json.dumps(x, ensure_ascii=False, default=str))
    rows = lambda df: [r.asDict(True) for r in df.collect()]  # noqa: E731  pages and reports, limited by their own limit
    if given.command == "ingest":
        out = pipeline.ingest(spark, store, given.rest[0])
        show(out)
        return 0 if out["consistent"] else 1
    if given.command == "status":
        show({name: store.read(name).count() for name in ("orders_raw", "orders_validated", "quarantine_orders") if store.has(name)})
    elif given.command == "runs":
        show(rows(store.read("runs", pipeline.RUNS).orderBy("id_run").limit(100)))
    elif given.command == "refresh":
        show(views.refresh_all(store, pipeline.utc_now(), given.full))
    elif given.command in ("report", "query"):
        registry = reports.AGGREGATIONS if given.command == "report" else lookups.QUERIES
        show(rows(lookups.run(registry, given.rest[0], store.read("orders_validated", ORDER), **_values(given.rest[1:]))))
    elif given.command == "explain":
        show(layout.plan_of(lookups.run(lookups.QUERIES, given.rest[0], store.read("orders_validated", ORDER), **_values(given.rest[1:]))))
    elif given.command == "layouts":
        show(layout.layouts(store))
    elif given.command == "forget":
        show({"forgotten": layout.forget(store, given.rest[0])})
    elif given.command == "idempotency":
        one, two = (pipeline.ingest(spark, store, given.rest[0]) for _ in range(2))
        show({"first": one, "second": two})
        return 0 if two["inserted"] == two["updated"] == 0 else 1
    elif given.command == "job":
        show(pipeline.run_job(store, given.rest[0]))
    else:
        show(rows(pipeline.job_log(store)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
