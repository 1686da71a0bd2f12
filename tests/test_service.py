import json

from pyspark.sql import functions as F

from millrace.functions.schema import ORDER
from millrace.plans import layout
from millrace.plans.service import handle
from millrace.sources import files
from millrace.sources.store import Warehouse


def order(i):
    return {
        "id_order": f"O{i:03d}", "order_date": f"2025-01-{i % 28 + 1:02d}", "status": "مؤكد", "customer": {"customer_id": f"C{i % 5}", "name": "N", "phone": "967771234567", "email": "a@b.c", "address": {"city": "عدن", "district": "d"}},
        "items": [{"sku": "S", "name": "n", "qty": 1, "unit_price": 10.0, "total": 10.0}], "payment": {"method": "بطاقة", "status": "تم الدفع", "amount": 10.0, "currency": "YER"}, "total_amount": 10.0,
    }


def test_requests(spark, tmp_path):
    path = tmp_path / "orders.jsonl"
    path.write_text("\n".join(json.dumps(order(i), ensure_ascii=False) for i in range(20)), encoding="utf-8")
    store = Warehouse(spark, str(tmp_path / "w"))
    ask = lambda method, at, **given: handle(spark, store, method, at, given, "2026-01-01T00:00:00Z")
    assert ask("GET", "/health")[0] == 200
    assert ask("POST", "/ingest", path=str(path))[0] == 201
    assert ask("POST", "/ingest", path="/nowhere")[0] == 400 and ask("POST", "/ingest")[0] == 400
    assert len(ask("GET", "/queries")[1]) == 6 and len(ask("GET", "/aggregations")[1]) == 5
    status, rows = ask("GET", "/queries/orders_by_customer", customer_id="C1", limit="2")
    assert status == 200 and [r["id_order"] for r in rows] == ["O001", "O006"]
    assert ask("GET", "/queries/orders_by_customer")[0] == 400 and ask("GET", "/queries/orders_by_customer", customer_id="C1", limit="x")[0] == 400
    assert ask("GET", "/queries/none")[0] == 404 and ask("GET", "/none")[0] == 404
    assert ask("GET", "/aggregations/sales_by_city")[1][0]["total_orders"] == 20
    assert ask("POST", "/refresh-mv")[1][0]["status"] == "refreshed" and len(ask("GET", "/views/top_products_summary")[1]) == 1
    assert ask("GET", "/views/none")[0] == 400
    assert ask("POST", "/jobs/periodic_report/run")[1]["total_orders"] == 20 and ask("POST", "/jobs/none/run")[0] == 404
    assert ask("POST", "/indexes")[0] == 200 and store.read("orders_validated").count() == 20


def test_layouts(spark, tmp_path):
    df = spark.range(4000).select(F.format_string("O%06d", "id").alias("id_order"), F.format_string("2025-01-%02d", F.col("id") % 28 + 1).alias("order_date"))
    plain, ordered = layout.compare(df, F.col("order_date") == "2025-01-05", str(tmp_path / "l"))
    assert plain["rows"] == ordered["rows"] and ordered["files_with_hits"] < plain["files_with_hits"] and "order_date" in ordered["pushed"]


def test_sample_and_export(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text("\n".join(json.dumps({"i": i}) for i in range(9)))
    files.write_sample(spark, str(path), 3, str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).count() == 3
    one = spark.createDataFrame([json.dumps(order(1), ensure_ascii=False)], "string").select(F.from_json("value", ORDER).alias("o")).select("o.*")
    files.export_csv(one, str(tmp_path / "c"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).first()
    assert json.loads(back.customer)["customer_id"] == "C1"
