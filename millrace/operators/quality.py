"""Cleaning with an audit of every change, validation with error codes, classification into valid, corrected and quarantined.

A record is JSON text; it is read as a variant, so that the rules see the types it was written with. Everything is one select of
column expressions. Rules of the business (recomputed totals, allowed states and methods) are not built in; allowed values of any field
can be given to validate().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import cleaners as C
from millrace.functions.schema import CORRECTION

#: Names under which a flat record may give a part of the customer, in the order they count.
ALIASES = {
    "customer_id": ("customer_id", "id_customer"),
    "name": ("customer_name", "name"),
    "phone": ("customer_phone", "phone"),
    "email": ("customer_email", "email"),
    "city": ("shipping_city", "city"),
    "district": ("district",),
}


def _at(path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.col("v"), f"$.{path}", kind)


def _kind(path: str) -> Column:
    """The type a path was written with: STRING, BIGINT, DECIMAL..., OBJECT<...>, ARRAY<...>; null if missing."""
    return F.schema_of_variant(F.try_variant_get(F.col("v"), f"$.{path}", "variant"))


def _is_object(path: str) -> Column:
    return F.coalesce(_kind(path).startswith("OBJECT"), F.lit(False))


def _first(*paths: str) -> Column:
    """The first given text; an empty one does not count."""
    return F.coalesce(*[F.nullif(_at(p), F.lit("")) for p in paths])


def _numeric(kind: Column) -> Column:
    return F.coalesce(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.lit(False))


def _change(field: Column | str, old: Column, new: Column, code: str, when: Column, now: Column) -> Column:
    name = F.lit(field) if isinstance(field, str) else field
    return F.when(when, F.struct(name.alias("field"), old.cast("string").alias("original_value"), new.cast("string").alias("corrected_value"), F.lit(code).alias("rule_code"), now.alias("timestamp")))


def _some(*changes: Column) -> Column:
    return F.filter(F.array(*changes), lambda x: x.isNotNull())


def _item(x: Column) -> Column:
    """One element of items: its parts, the kinds they were written with, and the numbers in them."""

    def part(name: str, kind: str = "string") -> Column:
        return F.try_variant_get(x, f"$.{name}", kind)

    def kind(name: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(x, f"$.{name}", "variant"))

    price = F.when(kind("unit_price").isNull(), F.lit("price")).otherwise(F.lit("unit_price"))
    price_kind = F.coalesce(kind("unit_price"), kind("price"))
    price_text = F.when(price == "price", part("price")).otherwise(part("unit_price"))
    texts = {"qty": (part("qty"), kind("qty")), "unit_price": (price_text, price_kind), "total": (part("total"), kind("total"))}
    columns = [F.coalesce(F.schema_of_variant(x).startswith("OBJECT"), F.lit(False)).alias("is_object"), part("sku").alias("sku"), part("name").alias("name")]
    for name, (text, how) in texts.items():
        value = F.when(_numeric(how), text.try_cast("double")).when(how == "STRING", C.number(text))
        columns += [text.alias(f"{name}_text"), how.alias(f"{name}_kind"), value.alias(f"{name}_value")]
    return F.struct(*columns)


def clean(df: DataFrame, raw: str = "record_raw", now: str | None = None) -> DataFrame:
    """df with cleaned (a struct) and corrections (an array in the order of the rules). now stamps the corrections; without it they bear no time.

    A text that is no JSON object gives a record of nulls with is_record false. Null stays null; nothing is guessed.
    """
    stamp = F.lit(now).cast("string")
    rows = df.withColumn("v", C.json_value(F.col(raw)))
    is_record = F.coalesce(F.schema_of_variant(F.col("v")).startswith("OBJECT"), F.lit(False))
    nested = _is_object("customer")
    flat = {name: _first(*paths) for name, paths in ALIASES.items()}
    some = F.coalesce(*[flat[n] for n in ("customer_id", "name", "phone", "email", "city")]).isNotNull()
    phone = F.coalesce(F.nullif(_at("customer.phone"), F.lit("")), C.phone(_first("customer.customer_phone", "customer_phone", "phone")))
    mail = F.coalesce(F.nullif(_at("customer.email"), F.lit("")), C.email(_first("customer.customer_email", "customer_email", "email")))

    def person(own: Column, made: Column) -> Column:
        return F.when(nested, own).when(some, made)

    def plain(name: str) -> Column:
        return F.coalesce(F.trim(flat[name]), F.lit(""))

    rows = rows.select(
        "*",
        is_record.alias("is_record"),
        F.coalesce(F.nullif(C.strip(_at("id_order")), F.lit("")), F.nullif(C.strip(_at("order_id")), F.lit(""))).alias("_id"),
        _at("status").alias("_status"),
        (_kind("status") == "STRING").alias("_status_text"),
        _at("order_date").alias("_date"),
        nested.alias("_nested"),
        some.alias("_some"),
        person(_at("customer.customer_id"), plain("customer_id")).alias("_customer_id"),
        person(_at("customer.name"), plain("name")).alias("_name"),
        person(phone, F.when(flat["phone"].isNull(), "").otherwise(C.phone(flat["phone"]))).alias("_phone"),
        person(mail, F.when(flat["email"].isNull(), "").otherwise(C.email(flat["email"]))).alias("_email"),
        person(_at("customer.address.city"), plain("city")).alias("_city"),
        person(_at("customer.address.district"), plain("district")).alias("_district"),
        _at("customer.address.street").alias("_street"),
        _at("customer.address.details").alias("_details"),
        _is_object("payment").alias("_pays"),
        F.coalesce(_first("payment.method"), _first("payment_method", "method")).alias("_method"),
        F.coalesce(_first("payment.status"), _first("payment_status")).alias("_pay_status"),
        F.coalesce(_first("payment.currency"), _first("currency")).alias("_currency"),
        F.coalesce(_first("payment.amount", "payment_amount"), F.when(~_is_object("payment"), _first("total_amount", "price"))).alias("_amount"),
        _at("total_amount").alias("_total"),
        _at("delivery.type").alias("_delivery"),
        _first("delivery.cost", "delivery_cost").alias("_cost"),
        _at("delivery.expected_date").alias("_expected"),
        F.coalesce(_kind("items"), _kind("items_json")).alias("_items_kind"),
        F.coalesce(_at("items"), _at("items_json")).alias("_items_text"),
        *[_at(c, k).alias(f"_{c}") for c, k in (("version", "int"), ("updated_at", "string"), ("event_id", "string"), ("is_duplicate", "boolean"))],
    )
    parsed = F.when(F.col("_items_kind") == "STRING", C.json_value(F.col("_items_text"))).otherwise(F.coalesce(F.try_variant_get("v", "$.items", "variant"), F.try_variant_get("v", "$.items_json", "variant")))
    rows = rows.withColumn("_items", parsed)
    is_array = F.coalesce(F.schema_of_variant("_items").startswith("ARRAY"), F.lit(False))
    rows = rows.withColumn("_is_array", is_array).withColumn("_lines", F.when(F.col("_is_array"), F.transform(F.try_variant_get("_items", "$", "array<variant>"), _item)))
    # the variant itself cannot be compared or shuffled; it has served
    rows = rows.drop("v", "_items")
    rows = rows.withColumns(
        {
            "_lines": F.when(F.spark_partition_id() >= 0, F.col("_lines")),
            "_new_status": F.when(F.col("_status_text"), C.status(F.col("_status"))).otherwise(F.col("_status")),
            "_new_date": C.date(F.col("_date")),
            "_new_phone": C.phone(F.col("_phone")),
            "_new_mail": C.email(F.col("_email")),
            "_code": C.currency_code(F.col("_currency")),
        }
    )
    new_status, new_date, new_phone, new_mail, code = (F.col(c) for c in ("_new_status", "_new_date", "_new_phone", "_new_mail", "_code"))
    currency = F.coalesce(code, F.trim("_currency"), C.currency_code(F.col("_amount")))
    numbers = {"qty": "NUMERIC_ARABIC_WORDS_QTY", "unit_price": "NUMERIC_CURRENCY_SEP_PRICE", "total": "NUMERIC_SEP_TOTAL"}

    def line_changes(x: Column, i: Column) -> Column:
        out = []
        for name, rule in numbers.items():
            value = x[f"{name}_value"]
            new = value.cast("long").cast("string") if name == "qty" else value.cast("string")
            out.append(_change(F.concat(F.lit("items["), i.cast("string"), F.lit(f"].{name}")), x[f"{name}_text"], new, rule, (x[f"{name}_kind"] == "STRING") & value.isNotNull(), stamp))
        return _some(*out)

    head = _some(
        _change("status", F.col("_status"), new_status, "STATUS_SYNONYM_NORM", new_status != F.col("_status"), stamp),
        _change("order_date", F.col("_date"), new_date, "DATE_ISO_NORM", new_date != F.col("_date"), stamp),
        _change("customer", F.lit(None), F.to_json(F.struct(*[F.col(f"_{c}").alias(c) for c in ("customer_id", "name", "phone", "email", "city", "district")])), "SYNTHESIZE_FLAT_CUSTOMER", ~F.col("_nested") & F.col("_some"), stamp),
        _change("customer.phone", F.col("_phone"), new_phone, "PHONE_NORM", F.col("_nested") & (new_phone != F.col("_phone")), stamp),
        _change("customer.email", F.col("_email"), new_mail, "EMAIL_REPAIR", F.col("_nested") & (new_mail != F.col("_email")), stamp),
        _change("payment", F.lit(None), F.to_json(F.struct(F.col("_method").alias("method"), F.col("_pay_status").alias("status"), currency.alias("currency"), F.col("_amount").alias("amount"))), "SYNTHESIZE_FLAT_PAYMENT", ~F.col("_pays") & F.coalesce("_method", "_amount").isNotNull(), stamp),
        _change("items", F.col("_items_text"), F.col("_items_text"), "PARSE_JSON_ITEMS", (F.col("_items_kind") == "STRING") & F.col("_is_array"), stamp),
    )
    tail = _some(_change("payment.currency", F.col("_currency"), code, "CURRENCY_NORM", F.col("_pays") & code.isNotNull() & (code != F.col("_currency")), stamp))
    lines = F.coalesce(F.flatten(F.transform("_lines", line_changes)), F.array().cast(f"array<{CORRECTION}>"))
    item = lambda x: F.struct(x["sku"].alias("sku"), x["name"].alias("name"), x["qty_value"].cast("int").alias("qty"), x["unit_price_value"].alias("unit_price"), x["total_value"].alias("total"))
    cleaned = F.struct(
        F.col("_id").alias("id_order"),
        new_date.alias("order_date"),
        new_status.alias("status"),
        F.struct(F.col("_customer_id").alias("customer_id"), F.col("_name").alias("name"), new_phone.alias("phone"), new_mail.alias("email"), F.struct(F.col("_city").alias("city"), F.col("_district").alias("district"), F.col("_street").alias("street"), F.col("_details").alias("details")).alias("address")).alias("customer"),
        F.transform("_lines", item).alias("items"),
        F.struct(F.col("_delivery").alias("type"), C.number(F.col("_cost")).alias("cost"), F.col("_expected").alias("expected_date")).alias("delivery"),
        F.struct(C.status(F.col("_method")).alias("method"), F.col("_pay_status").alias("status"), C.number(F.col("_amount")).alias("amount"), currency.alias("currency")).alias("payment"),
        C.number(F.col("_total")).alias("total_amount"),
        F.col("_version").alias("version"),
        F.col("_updated_at").alias("updated_at"),
        F.col("_event_id").alias("event_id"),
    )
    return rows.withColumns({"cleaned": cleaned, "corrections": F.concat(head, lines, tail).cast(f"array<{CORRECTION}>")})


def _error(code: str, detail: Column | str, when: Column) -> Column:
    return F.when(F.coalesce(when, F.lit(True)), F.struct(F.lit(code).alias("code"), (F.lit(detail) if isinstance(detail, str) else detail).alias("detail")))


def _blank(path: str) -> Column:
    return F.coalesce(F.trim(path), F.lit("")) == ""


def validate(rows: DataFrame, allowed: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Cleaned rows with errors, an array of (code, detail) in the order of the checks. allowed: path of a cleaned field -> its values."""

    def line_errors(x: Column, i: Column) -> Column:
        at = F.concat(F.lit("items["), i.cast("string"), F.lit("]"))
        say = lambda text: F.concat(at, F.lit(text))
        number = lambda name: x[f"{name}_value"]
        given = lambda name: x[f"{name}_kind"].isNotNull() & (x[f"{name}_kind"] != "VOID")
        whole = (x["qty_kind"] == "BIGINT") | (x["qty_kind"] == "STRING")
        inside = [
            _error("JSON_ITEMS_CORRUPTED", say(".sku is missing"), F.coalesce(F.trim(x["sku"]), F.lit("")) == ""),
            _error("JSON_ITEMS_CORRUPTED", say(".name is missing"), F.coalesce(F.trim(x["name"]), F.lit("")) == ""),
            _error("VALUE_NEGATIVE_AMBIGUOUS", say(".qty is no positive integer"), ~(whole & (F.floor(number("qty")) > 0))),
            _error("PRICE_UNKNOWN", say(".unit_price is missing"), ~given("unit_price")),
            _error("VALUE_NEGATIVE_AMBIGUOUS", say(".unit_price is no number of at least 0"), given("unit_price") & ~F.coalesce(number("unit_price") >= 0, F.lit(False))),
            _error("VALUE_NEGATIVE_AMBIGUOUS", say(".total is no number of at least 0"), ~(given("total") & (number("total") >= 0))),
        ]
        return F.when(x["is_object"], _some(*inside)).otherwise(_some(_error("JSON_ITEMS_CORRUPTED", say(" is not an object"), F.lit(True))))

    c = "cleaned."
    checks = [
        _error("JSON_ITEMS_CORRUPTED", "the record is no JSON object", ~F.col("is_record")),
        _error("ID_ORDER_MISSING", "id_order is missing", F.col(c + "id_order").isNull()),
        _error("DATE_IMPOSSIBLE_INVALID", "order_date is missing or no date", ~C.is_iso(F.col(c + "order_date"))),
        _error("ID_CUSTOMER_MISSING", "customer.customer_id is missing", _blank(c + "customer.customer_id")),
        _error("ID_CUSTOMER_MISSING", "customer.name is missing", _blank(c + "customer.name")),
        _error("ERRORS_CONFLICTING_MULTIPLE", "customer.email is no address", ~F.col(c + "customer.email").rlike(C.EMAIL_PATTERN)),
        _error("ERRORS_CONFLICTING_MULTIPLE", "customer.phone is no number", ~F.col(c + "customer.phone").rlike(C.PHONE_PATTERN)),
        _error("ERRORS_CONFLICTING_MULTIPLE", "customer.address lacks city or district", _blank(c + "customer.address.city") | _blank(c + "customer.address.district")),
        _error("JSON_ITEMS_CORRUPTED", "items is no array", ~F.col("_is_array")),
        _error("ITEMS_EMPTY", "items is empty", F.col("_is_array") & (F.size("_lines") == 0)),
    ]
    last = [
        _error("VALUE_NEGATIVE_AMBIGUOUS", "payment.amount is no number of at least 0", ~(F.col(c + "payment.amount") >= 0)),
        _error("VALUE_NEGATIVE_AMBIGUOUS", "total_amount is no number of at least 0", ~(F.col(c + "total_amount") >= 0)),
        *[_error("ERRORS_CONFLICTING_MULTIPLE", f"{path} has a value that is not allowed", ~F.col(c + path).isin(*values)) for path, values in (allowed or {}).items()],
        _error("ID_ORDER_DUPLICATE", "the record is marked as a duplicate", F.coalesce("_is_duplicate", F.lit(False))),
    ]
    error = "array<struct<code string, detail string>>"
    errors = F.concat(_some(*checks).cast(error), F.coalesce(F.flatten(F.transform("_lines", line_errors)), F.array().cast(error)).cast(error), _some(*last).cast(error))
    # always true, but not to the optimizer: a filter on the outcome must not drag all checks through every step below
    rows = rows.withColumn("errors", F.when(F.spark_partition_id() >= 0, errors))
    # a record that is none gives nothing that the checks could tell apart
    none = F.array(*[F.struct(F.lit(code).alias("code"), F.lit("the record is no JSON object").alias("detail")) for code in ("JSON_ITEMS_CORRUPTED", "ERRORS_CONFLICTING_MULTIPLE")])
    rows = rows.withColumn("errors", F.when(F.col("is_record"), F.col("errors")).otherwise(none.cast(error)))
    several = (F.size("errors") > 1) & ~F.exists("errors", lambda x: x["code"] == "ERRORS_CONFLICTING_MULTIPLE")
    more = F.array(F.struct(F.lit("ERRORS_CONFLICTING_MULTIPLE").alias("code"), F.concat(F.size("errors").cast("string"), F.lit(" errors")).alias("detail")))
    return rows.withColumn("errors", F.when(several, F.concat("errors", more)).otherwise(F.col("errors")))


def classify(df: DataFrame, raw: str = "record_raw", now: str | None = None, allowed: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """df with outcome (VALID, CORRECTED or QUARANTINED), codes_error, details_error, cleaned and corrections. Columns of df stay."""
    rows = validate(clean(df, raw, now), allowed)
    outcome = F.when(F.size("errors") > 0, "QUARANTINED").when(F.size("corrections") > 0, "CORRECTED").otherwise("VALID")
    return rows.select(
        *df.columns,
        outcome.alias("outcome"),
        F.array_sort(F.array_distinct(F.transform("errors", lambda x: x["code"]))).alias("codes_error"),
        F.transform("errors", lambda x: x["detail"]).alias("details_error"),
        F.when(F.col("is_record"), F.col("cleaned")).alias("cleaned"),
        "corrections",
    )


def outcome_counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy("outcome").agg(F.count("*").alias("records"))


def consistent(raw: DataFrame, classified: DataFrame) -> DataFrame:
    """One row: rows read, rows of each outcome, and whether they add up."""
    out = classified.agg(*[F.count_if(F.col("outcome") == o).alias(o.lower()) for o in ("VALID", "CORRECTED", "QUARANTINED")])
    return raw.agg(F.count("*").alias("read_rows")).join(F.broadcast(out)).withColumn("consistent", F.col("read_rows") == F.col("valid") + F.col("corrected") + F.col("quarantined"))


def revalidate(quarantine: DataFrame, now: str | None = None, allowed: dict[str, tuple[str, ...]] | None = None) -> tuple[DataFrame, DataFrame]:
    """Classify quarantined records again: (recovered, still quarantined)."""
    again = classify(quarantine.drop("outcome", "codes_error", "details_error", "cleaned", "corrections"), now=now, allowed=allowed)
    return again.where("outcome <> 'QUARANTINED'"), again.where("outcome = 'QUARANTINED'")
