"""The canonical order (as DDL) and the layouts of raw order files."""

from __future__ import annotations

CORRECTION = "struct<field string, original_value string, corrected_value string, rule_code string, timestamp string>"
ORDER = (
    "id_order string, order_date string, status string, "
    "customer struct<customer_id: string, name: string, phone: string, email: string, address: struct<city: string, district: string, street: string, details: string>>, "
    "items array<struct<sku: string, name: string, qty: int, unit_price: double, total: double>>, delivery struct<type: string, cost: double, expected_date: string>, "
    "payment struct<method: string, status: string, amount: double, currency: string>, total_amount double, version int, updated_at string, event_id string, "
    "quality_status string, corrections array<struct<field: string, original_value: string, corrected_value: string, rule_code: string, timestamp: string>>, processed_at string"
)
#: Raw layouts by exact header (fixed values): columns are bound by position, so a schema fits only its own header.
LAYOUTS = (
    tuple("id_order order_date status customer_id customer_name phone email shipping_city district items payment_method payment_status currency total_amount delivery_type delivery_cost".split()),
    tuple("order_id order_date status customer_id customer_name customer_phone customer_email city district delivery_type delivery_cost payment_method payment_status payment_amount currency total_amount items_json".split()),
)


#: Fields that say when and how a record was processed; no part of an order's state (fixed values).
METADATA = ("_id", "id_run", "at_ingested", "processed_at", "quarantined_at", "ingest_timestamp", "file_source", "number_row_source", "engine_used", "updated_at", "record_id")
