import copy
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import cleaners as C
from millrace.functions.schema import LAYOUTS, ORDER
from millrace.operators import incremental, lookups, quality, reports, views
from millrace.operators.upsert import keep_last, upsert
from millrace.plans import pipeline
from millrace.sources import checkpoints as CP
from millrace.sources import files
from millrace.sources.store import Warehouse
from millrace.streaming import loader

GOOD = {
    "id_order": "ORD-1", "order_date": "2025-01-31T10:00:00Z", "status": "مؤكد",
    "customer": {"customer_id": "CUS-1", "name": "Ali", "phone": "967771234567", "email": "ali@example.com", "address": {"city": "صنعاء", "district": "حدة"}},
    "items": [{"sku": "SKU-1", "name": "Item 1", "qty": 1, "unit_price": 5000.0, "total": 5000.0}],
    "delivery": {"type": "سريع", "cost": 1000.0}, "payment": {"method": "بطاقة", "status": "تم الدفع", "amount": 6000.0, "currency": "YER"}, "total_amount": 6000.0,
}


def cleaned(spark, f, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, x string")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "f, pairs",
    [
        (C.number, {"٣٤٥٫٥": 345.5, "٨٬٧٦٥": 8765.0, "4٢": 42.0, "ألفين": 2000.0, "خمسة آلاف": 5000.0, "1,250.75 yr": 1250.75, "twelve": None, "7f": None, "-3": -3.0, "": None}),
        (C.thousands, {"9٬876,5": "98765", "12 345 678": "12345678", "a, b": "a b"}),
        (C.phone, {"(70) 222-33-44": "967702223344", "70 22": "7022", "0096773 0001112": "967730001112", "0 71 999 88 77": "967719998877", "٧٣١١١٢٢٢٣": "967731112223", "12": "12", None: ""}),
        (C.email, {" who@@@here..org ": "who@here.org", "a.b@c": "a.b@c", None: ""}),
        (C.date, {"2023/ 7/ 4": "2023-07-04", "١٩٩٩/١٢/٠١": "1999-12-01", "2024/02/29T23:59:00Z": "2024-02-29T23:59:00Z", "2024-03-05 08:15:00": "2024-03-0508:15:00", "24/3/5": "24/3/5"}),
        (C.status, {" shipped ": "قيد الشحن", "confirmed": "مؤكد", "مرتجع": "مرتجع", "Shipped": "Shipped", "lost": "lost"}),
        (C.currency_code, {"12 ر.ي": "YER", "€ 3": "€", "الدينار": "دينار", "none": None, "yer or usd": "USD"}),
        (C.is_iso, {"2024-02-29": True, "2023-02-29": False, "2024": False, "2024-06-01T23:15:30.25+03:00": True, "2024-06-01T25:00": False, None: False}),
    ],
)
def test_cleaners(spark, f, pairs):
    assert cleaned(spark, f, list(pairs)) == list(pairs.values())


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(max_size=12), min_size=1, max_size=20))
def test_cleaners_keep_their_promises(spark, values):
    once = cleaned(spark, C.phone, values)
    assert cleaned(spark, C.phone, once) == once and all(p.isdigit() or not p for p in once)
    assert all("@@" not in e and ".." not in e for e in cleaned(spark, C.email, values))
    assert cleaned(spark, C.arabic_digits, cleaned(spark, C.arabic_digits, values)) == cleaned(spark, C.arabic_digits, values)


def classified(spark, *records):
    texts = [r if isinstance(r, str) or r is None else json.dumps(r, ensure_ascii=False) for r in records]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, record_raw string")
    return quality.classify(df, now="T").orderBy("n").collect()


def changed(change):
    record = copy.deepcopy(GOOD)
    change(record)
    return record


def test_one_mutation_for_each_code(spark):
    cases = [
        (lambda r: r.update(id_order="   "), "ID_ORDER_MISSING"),
        (lambda r: r["customer"].update(customer_id=""), "ID_CUSTOMER_MISSING"),
        (lambda r: r.update(order_date="invalid-date-9999-99-99"), "DATE_IMPOSSIBLE_INVALID"),
        (lambda r: r["items"][0].pop("sku"), "JSON_ITEMS_CORRUPTED"),
        (lambda r: r.update(items=[]), "ITEMS_EMPTY"),
        (lambda r: r["items"][0].update(unit_price=None), "PRICE_UNKNOWN"),
        (lambda r: r["items"][0].update(qty=-5), "VALUE_NEGATIVE_AMBIGUOUS"),
        (lambda r: r["items"][0].update(qty=2.0), "VALUE_NEGATIVE_AMBIGUOUS"),
        (lambda r: r.update(is_duplicate=True), "ID_ORDER_DUPLICATE"),
        (lambda r: r.update(id_order="", order_date="invalid", items=[]), "ERRORS_CONFLICTING_MULTIPLE"),
        (lambda r: r["items"].append(7), "JSON_ITEMS_CORRUPTED"),
        (lambda r: r.update(items="[{sku:1}]"), "JSON_ITEMS_CORRUPTED"),
    ]
    out = classified(spark, GOOD, *[changed(c) for c, _ in cases], None, "nonsense", "[1]")
    assert out[0].outcome == "VALID" and out[0].corrections == []
    for row, (_, code) in zip(out[1:], cases):
        assert row.outcome == "QUARANTINED" and code in row.codes_error
    assert all(r.outcome == "QUARANTINED" for r in out[-3:])


def test_corrections_are_logged_in_order(spark):
    def dirty(r):
        r.update(status="pending", order_date="٢٠٢٥/٠١/٣١", items=json.dumps([{"sku": "S", "name": "N", "qty": "٢", "unit_price": "5,000 ريال", "total": "10000"}], ensure_ascii=False))
        r["customer"].update(phone="+967 77-123-4567", email="a@@b..c")

    (row,) = classified(spark, changed(dirty))
    assert row.outcome == "CORRECTED"
    assert [c.rule_code for c in row.corrections] == ["STATUS_SYNONYM_NORM", "DATE_ISO_NORM", "PHONE_NORM", "EMAIL_REPAIR", "PARSE_JSON_ITEMS", "NUMERIC_ARABIC_WORDS_QTY", "NUMERIC_CURRENCY_SEP_PRICE", "NUMERIC_SEP_TOTAL"]
    assert row.corrections[5].field == "items[0].qty" and row.corrections[5].original_value == "٢" and row.corrections[5].timestamp == "T"
    assert row["cleaned"]["items"][0].asDict() == {"sku": "S", "name": "N", "qty": 2, "unit_price": 5000.0, "total": 10000.0}


def test_flat_rows_are_always_corrected(spark):
    flat = {"id_order": "O", "order_date": "2025-01-31", "status": "مؤكد", "customer_id": "C", "customer_name": "N", "phone": "0771234567", "email": "a@b.c", "shipping_city": "عدن", "district": "d", "items": json.dumps(GOOD["items"]), "payment_method": "بطاقة", "total_amount": "5000"}
    (row,) = classified(spark, flat)
    assert row.outcome == "CORRECTED" and {"SYNTHESIZE_FLAT_CUSTOMER", "SYNTHESIZE_FLAT_PAYMENT"} <= {c.rule_code for c in row.corrections}
    assert row["cleaned"]["customer"]["phone"] == "967771234567"


def test_allowed_values_and_a_filter_on_the_outcome(spark):
    df = spark.createDataFrame([(json.dumps(GOOD),)], "record_raw string")
    assert quality.classify(df, allowed={"payment.currency": ("USD",)}).where("outcome = 'QUARANTINED'").count() == 1
    assert quality.classify(df).where("outcome = 'QUARANTINED'").count() == 0
    assert quality.revalidate(quality.classify(df, allowed={"status": ()}))[0].count() == 1


def orders(spark, rows):
    out = []
    for id_order, date, status, customer, name, city, lines, total in rows:
        out.append(dict(id_order=id_order, order_date=date, status=status, customer={"customer_id": customer, "name": name, "address": {"city": city}}, items=[dict(sku=s, name=n, qty=q, unit_price=float(p), total=float(t)) for s, n, q, p, t in lines], total_amount=float(total), updated_at=date))
    return spark.createDataFrame([json.dumps(r, ensure_ascii=False) for r in out], "string").select(F.from_json("value", ORDER).alias("o")).select("o.*")


REPORT = [
    ("ORD-AGG-001", "2025-01-10T10:00:00Z", "تم التسليم", "CUS-001", "Ahmad", "صنعاء", [("SKU-A", "Laptop", 1, 1000, 1000), ("SKU-B", "Mouse", 2, 50, 100)], 1100),
    ("ORD-AGG-002", "2025-01-15T12:00:00Z", "مؤكد", "CUS-001", "Ahmad", "صنعاء", [("SKU-B", "Mouse", 1, 50, 50)], 50),
    ("ORD-AGG-003", "2025-01-20T14:00:00Z", "تم التسليم", "CUS-002", "Sara", "عدن", [("SKU-A", "Laptop", 2, 1000, 2000)], 2000),
    ("ORD-AGG-004", "2025-02-05T09:00:00Z", "ملغي", "CUS-003", "Ali", "تعز", [("SKU-C", "Keyboard", 1, 80, 80)], 80),
]


def test_reports(spark):
    df = orders(spark, REPORT)
    assert [tuple(r) for r in reports.sales_by_city(df).collect()][:2] == [("عدن", 2000.0, 1, 2000.0), ("صنعاء", 1150.0, 2, 575.0)]
    assert [tuple(r)[:1] + tuple(r)[2:] for r in reports.top_products(df).collect()][:2] == [("SKU-A", 3, 3000.0, 2), ("SKU-B", 3, 150.0, 2)]
    assert [(r.customer_id, r.total_spend, r.total_orders) for r in reports.top_customers(df).collect()][:2] == [("CUS-002", 2000.0, 1), ("CUS-001", 1150.0, 2)]
    assert reports.sales_by_period(df).count() == 4
    assert [(r.period, r.total_revenue, r.total_orders) for r in reports.sales_by_period(df, "monthly").collect()] == [("2025-02", 80.0, 1), ("2025-01", 3150.0, 3)]
    assert tuple(reports.orders_by_status(df).first())[:3] == ("تم التسليم", 2, 3100.0)
    assert reports.key_figures(df).first().total_orders == 4
    for r in reports.AGGREGATIONS.values():
        assert r["func"](df.limit(0)).count() == 0
    for bad in (lambda: reports.sales_by_city(df, 0), lambda: reports.top_customers(df, min_spend=-5), lambda: reports.sales_by_period(df, "hourly"), lambda: reports.sales_by_period(df, start_date="2", end_date="1")):
        with pytest.raises(ValueError):
            bad()


def test_lookups(spark):
    rows = [(f"ORD-{i:03d}", f"2025-01-{i % 28 + 1:02d}T10:00:00Z", ["مؤكد", "تم التسليم", "قيد الانتظار", "قيد الشحن"][i % 4], f"CUS-{i % 10 + 1:03d}", "n", ["صنعاء", "عدن", "تعز", "الحديدة", "إب"][i % 5], [], i * 100) for i in range(1, 101)]
    df = orders(spark, rows)
    run = lambda name, **p: lookups.run(lookups.QUERIES, name, df, **p)
    assert run("orders_by_customer", customer_id=" CUS-001 ").count() == 10
    assert run("orders_by_city", city="عدن").count() == 20
    assert run("high_value_orders", min_amount=9500).first().total_amount == 10000
    assert [r.order_date for r in run("orders_by_date_range", start_date="2025-01-01", end_date="2025-01-02").collect()] == ["2025-01-01T10:00:00Z"] * 3
    assert run("orders_by_status", status="مؤكد", limit=5, skip=20).count() == 5
    for name, p, text in (("orders_by_customer", {"customer_id": " "}, "customer_id"), ("orders_by_date_range", {"start_date": "2", "end_date": "1"}, "start_date is after end_date"), ("high_value_orders", {"min_amount": -1}, "below 0"), ("orders_by_city", {"city": "x", "limit": 0}, "limit"), ("nothing", {}, "unknown"), ("orders_by_city", {"town": "x"}, "unknown")):
        with pytest.raises(ValueError, match=text):
            run(name, **p)


def test_upsert_lifecycle(spark):
    base = orders(spark, REPORT).limit(0)
    new = orders(spark, REPORT).withColumn("_row", F.monotonically_increasing_id())
    first = upsert(base, new, "NOW")
    assert first.counts() == {"inserted": 4, "updated": 0, "unchanged": 0}
    again = upsert(first.table(), new.withColumn("processed_at", F.lit("later")), "NOW")
    assert again.counts() == {"inserted": 0, "updated": 0, "unchanged": 4}
    other = upsert(first.table(), new.where("id_order = 'ORD-AGG-001'").withColumn("status", F.lit("ملغي")), "NOW")
    assert other.counts() == {"inserted": 0, "updated": 1, "unchanged": 0} and other.table().count() == 4
    assert other.table().where("updated_at = 'NOW'").count() == 1
    twice = new.unionByName(new.withColumns({"_row": F.col("_row") + 10**12, "total_amount": F.lit(1.0)})).unionByName(new.withColumn("id_order", F.lit("  ")))
    assert [r.total_amount for r in upsert(base, twice, "NOW").table().collect()] == [1.0] * 4
    assert keep_last(twice, "id_order", "_row").count() == 5


def test_incremental_lifecycle(spark, tmp_path):
    def batch(*rows):
        return orders(spark, [(i, at, "مؤكد", "C", "N", "x", [], amount) for i, _, at, amount, _ in rows]).join(spark.createDataFrame([(i, v, e) for i, v, _, _, e in rows], "id_order string, v int, e string"), "id_order").withColumns({"version": F.col("v"), "event_id": F.col("e")}).drop("v", "e")

    store = Warehouse(spark, str(tmp_path / "w"))
    out = incremental.initial_load(store, batch(("1", 1, "2025-01-31T10:00:00Z", 1, None), ("2", 1, "2025-01-31T10:30:00Z", 2, None), ("3", 1, "2025-01-31T11:00:00Z", 3, None)), "NOW")
    assert (out["inserted"], out["new_watermark"]) == (3, "2025-01-31T11:00:00Z")
    delta = batch(("2", 2, "2025-02-01T12:00:00Z", 20, "E1"), ("4", 1, "2025-02-01T12:00:00Z", 4, "E2"))
    out = incremental.process_delta(store, delta, "2025-02-01T13:00:00Z")
    assert (out["inserted"], out["updated"], out["new_watermark"]) == (1, 1, "2025-02-01T12:00:00Z")
    out = incremental.process_delta(store, delta, "NOW")
    assert (out["filtered_by_watermark"], out["processed_count"]) == (2, 0)
    out = incremental.process_delta(store, delta, "NOW", force=True)
    assert (out["events_skipped"], out["inserted"], out["updated"]) == (2, 0, 0)
    out = incremental.process_delta(store, batch(("2", 1, "2025-03-01T00:00:00Z", 99, None)), "NOW")
    assert (out["conflicts_rejected"], out["updated"], out["new_watermark"]) == (1, 0, "2025-03-01T00:00:00Z")
    assert {r.id_order: r.total_amount for r in store.read("orders_validated").collect()} == {"1": 1.0, "2": 20.0, "3": 3.0, "4": 4.0}
    store.vacuum()
    assert store.read("orders_validated").count() == 4


def test_views(spark, tmp_path):
    def row(i, day, lines, total, updated):
        return orders(spark, [(i, day, "مؤكد", "C", "N", "x", [(s, s, q, p, q * p) for s, q, p in lines], total)]).withColumn("updated_at", F.lit(updated))

    store = Warehouse(spark, str(tmp_path / "w"))
    state = {"1": row("1", "2025-01-10", [("LAPTOP", 1, 1000), ("MOUSE", 2, 25)], 1050, "2025-01-10"), "2": row("2", "2025-01-10", [("MOUSE", 1, 25)], 25, "2025-01-10"), "3": row("3", "2025-01-20", [("KEYBOARD", 1, 80)], 80, "2025-01-20")}

    def save():
        out = None
        for df in state.values():
            out = df if out is None else out.unionByName(df)
        store.commit({"orders_validated": out})

    def daily():
        return {r.date: (r.total_revenue, r.total_orders) for r in store.read("daily_sales_summary").collect()}

    def products():
        return {r.sku: (r.total_quantity_sold, r.total_revenue, r.order_occurrences) for r in store.read("top_products_summary").collect()}

    save()
    assert [r["mode"] for r in views.refresh_all(store, "A")] == ["full", "full"]
    assert daily() == {"2025-01-10": (1075.0, 2), "2025-01-20": (80.0, 1)} and products()["MOUSE"] == (3, 75.0, 2)
    assert [r["status"] for r in views.refresh_all(store, "B")] == ["up_to_date"] * 2
    state["4"] = row("4", "2025-02-05", [("MONITOR", 1, 300)], 300, "2025-02-05")
    save()
    assert [r["affected"] for r in views.refresh_all(store, "C")] == [1, 1]
    state["3"] = row("3", "2025-01-25", [("HEADPHONES", 1, 80)], 80, "2025-03-01")
    save()
    views.refresh_all(store, "D")
    assert daily() == {"2025-01-10": (1075.0, 2), "2025-01-25": (80.0, 1), "2025-02-05": (300.0, 1)}
    assert "KEYBOARD" not in products() and products()["HEADPHONES"] == (1, 80.0, 1) and products()["LAPTOP"] == (1, 1000.0, 1)
    assert [r.last_refreshed_at for r in views.read_view(store, "daily_sales_summary").collect()] == ["C", "D", "A"]
    with pytest.raises(ValueError):
        views.read_view(store, "nothing")


def test_ingest_jsonl(spark, tmp_path):
    good = [changed(lambda r, i=i: r.update(id_order=f"ORD-{i}")) for i in range(15)]
    bad = [{"id_order": "", "status": "غير معروف", "customer": {"name": "x"}}] * 5
    path = tmp_path / "orders.jsonl"
    path.write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in [*good, *bad]) + "\n\nnot json\n", encoding="utf-8")
    store = Warehouse(spark, str(tmp_path / "w"))
    out = pipeline.ingest(spark, store, str(path))
    assert (out["read_rows"], out["valid"] + out["corrected"], out["quarantined"], out["inserted"], out["consistent"]) == (21, 15, 6, 15, True)
    assert [r.number_row_source for r in store.read("orders_raw").orderBy("number_row_source").collect()] == [*range(1, 21), 22]
    again = pipeline.ingest(spark, store, str(path))
    assert (again["inserted"], again["unchanged"]) == (0, 15) and store.read("orders_raw").count() == 42
    assert store.read("runs").count() == 2 and pipeline.audit_runs(store.read("runs")).where("issue = 'inconsistent counts'").count() == 0
    assert pipeline.periodic_report(store)["total_orders"] == 15
    pipeline.run_job(store, "refresh_views", now="2026-01-01")
    with pytest.raises(RuntimeError):
        pipeline.run_job(store, "breaks", now="2026-01-02", jobs={"breaks": {"func": lambda store, now: 1 / 0}})
    assert {r.job: r.status for r in pipeline.last_runs(pipeline.job_log(store)).collect()} == {"refresh_views": "SUCCESS", "breaks": "FAILED"}


def test_csv_files(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text(",".join(LAYOUTS[0]) + "\n" + ",".join(["O1", *["x"] * 7, '"two\nlines"', *["y"] * 7]) + "\n" + ",".join([" O2 ", *["x"] * 15]) + "\n", encoding="utf-8")
    found = files.route(str(path))
    raw = files.read_file(spark, found, "NOW").orderBy("number_row_source").collect()
    assert [(r.number_row_source, r.id_order) for r in raw] == [(1, "O1"), (2, "O2")] and json.loads(raw[0].record_raw)["district"] == "two\nlines"
    assert found.engine == "local" and files.route(str(path), threshold_mb=0).engine == "spark" and files.route(str(path), engine="pyspark").engine == "spark"
    assert files.profile(spark, str(path))["rows"] == 2
    (tmp_path / "b.csv").write_text("Order_ID,X\n1,2\n", encoding="utf-8")
    assert files.layout(str(tmp_path / "b.csv")) == ["order_id", "x"]
    for name, text in (("c.txt", "x"), ("d.csv", "")):
        (tmp_path / name).write_text(text)
        with pytest.raises(ValueError):
            files.route(str(tmp_path / name))
    with pytest.raises(FileNotFoundError):
        files.route(str(tmp_path / "none.csv"))
    raw_df = files.read_file(spark, found, "NOW")
    for _ in range(2):
        files.write_raw(raw_df, str(tmp_path / "raw"))
    assert spark.read.parquet(str(tmp_path / "raw")).count() == 2


def test_checkpoints(spark, tmp_path):
    store = Warehouse(spark, str(tmp_path / "w"))
    assert CP.active(store, "f") is None
    for run, status, at in (("a", CP.COMPLETED, "1"), ("b", CP.FAILED, "2"), ("c", CP.FAILED, "3")):
        CP.save(store, CP.Checkpoint("f", run, status, 5, at))
    assert CP.active(store, "f").id_run == "c"
    CP.save(store, CP.Checkpoint("f", "d", CP.IN_PROGRESS, 5, "4"))
    assert CP.active(store, "f").id_run == "d"
    assert CP.remaining(spark.range(10).withColumnRenamed("id", "number_row_source"), CP.active(store, "f")).count() == 4
    CP.save(store, CP.Checkpoint("f", "e", CP.IN_PROGRESS, 5, "5"))
    with pytest.raises(CP.AmbiguousCheckpoint):
        CP.active(store, "f")


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    orders(spark, REPORT).write.parquet(str(source))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in orders(spark, REPORT).schema.fields)
    store = Warehouse(spark, str(tmp_path / "w"))
    for _ in range(2):
        loader.stream_deltas(spark, str(source), schema, store, str(tmp_path / "cp"), lambda: "NOW").awaitTermination()
    assert store.read("orders_validated").count() == 4 and store.state["incremental"] == "2025-02-05T09:00:00Z"
    messages = spark.createDataFrame([(1, "A", "2024-01-01 00:00:00"), (2, " a", "2024-01-01 01:00:00"), (3, "B", "2024-01-01 02:00:00"), (4, "", "2024-01-01 02:00:00")], "delivery_id long, id_order string, received_at string").withColumn("received_at", F.to_timestamp("received_at"))
    messages.coalesce(1).write.parquet(str(tmp_path / "m"))
    stream = spark.readStream.schema(messages.schema).parquet(str(tmp_path / "m"))
    loader.to_folder(loader.first_deliveries(stream), str(tmp_path / "out"), str(tmp_path / "cp2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    assert loader.sessions(messages.withColumn("k", F.lit(1)), "received_at", "90 minutes", "k").count() == 1


def test_json_texts_with_something_behind_them(spark):
    texts = ["[1]", " [1] ", "[1] ;", "[1]]", "[1]}", "[1],[2]", '[1],"w":1', "{}", '{"a":1} x', '{"a":1}', "", None, "1 2", '"a"', "[NaN]"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    out = [r[0] for r in df.select(C.json_value(F.col("t")).isNotNull()).collect()]
    assert out == [True, True, False, False, False, False, False, True, False, True, False, False, False, True, False]
