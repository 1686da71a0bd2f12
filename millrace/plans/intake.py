"""Queries of what happens to orders on their way in: files, the store, classification; each with its twin in SQL.

Those that need a file or a store write the table there first, in the folder that the session shares, and read it back by the operator.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import cleaners as C
from millrace.functions.schema import LAYOUTS
from millrace.operators import incremental as I
from millrace.operators import lookups, quality, reports, views
from millrace.operators.upsert import touched, upsert
from millrace.plans import orders as O
from millrace.plans import pipeline
from millrace.plans.found import IS_ARRAY, SAFE
from millrace.session import checkpoint_folder, spread, table
from millrace.sources import files
from millrace.sources.store import Warehouse

QUERIES = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


# files

_FIELDS = LAYOUTS[0]


def _written(spark: SparkSession, sf: str) -> str:
    """The raw orders as CSV files with headers, a row in 50 with a field too many and one in 60 with quotes that do not close."""
    path = _folder(spark, "csv")
    rows = table(spark, sf, "spark_loader").select("loader_id", *[F.coalesce(c, F.lit("")).alias(c) for c in _FIELDS])
    quoted = F.concat_ws(",", *[F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"')) for c in _FIELDS])
    bad = F.when(F.col("loader_id") % 50 == 7, F.concat(quoted, F.lit(",more"))).when(F.col("loader_id") % 60 == 11, F.concat(F.lit('"K"x",'), F.translate(quoted, '"\n\r', "")))
    lines = rows.select(F.coalesce(bad, quoted).alias("value"))
    lines.mapInPandas(_headed, "value string").write.text(path)
    return path


def _headed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every file begins with the header."""
    yield pd.DataFrame({"value": [",".join(_FIELDS)]})
    yield from parts


_BAD = "(loader_id % 50 = 7 or loader_id % 60 = 11)"


@query(f"select {', '.join(f'''coalesce({c}, '') as {c}''' for c in _FIELDS)} from spark_loader where not {_BAD}")
def csv_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The records of CSV files that parse, quoted line breaks included."""
    return files.read_csv(spark, _written(spark, sf), list(_FIELDS)).where("_reason is null").select(*_FIELDS)


@query("select case when loader_id % 50 = 7 then 'column_count' else 'quoting' end as reason, count(*) as records from spark_loader where loader_id % 50 = 7 or loader_id % 60 = 11 group by 1")
def csv_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """Why the others do not."""
    return files.read_csv(spark, _written(spark, sf), list(_FIELDS)).where("_reason is not null").groupBy(F.col("_reason").alias("reason")).agg(F.count("*").alias("records"))


def _lines(spark: SparkSession, sf: str) -> str:
    """The raw orders as JSON lines, every third with its identifier as order_id; a line in 40 is cut off, one in 41 is blank."""
    path = _folder(spark, "jsonl")
    rows = table(spark, sf, "spark_loader").withColumn("order_id", F.when(F.col("loader_id") % 3 == 0, F.col("id_order"))).withColumn("id_order", F.when(F.col("loader_id") % 3 != 0, F.col("id_order")))
    text = F.to_json(F.struct("loader_id", "id_order", "order_id", "status"))
    rows.select(F.when(F.col("loader_id") % 40 == 1, F.concat(F.lit("{}#"), "loader_id", F.lit("{"))).when(F.col("loader_id") % 41 == 2, " ").otherwise(text).alias("value")).write.text(path)
    return path


_LINE_SQL = f"""case when loader_id % 40 = 1 then null else loader_id end as loader_id, case when loader_id % 40 = 1 then null else nullif({O._strip('id_order')}, '') end as id_order,
    case when loader_id % 40 = 1 then '{{}}#' || loader_id || '{{' end as unparseable from spark_loader where loader_id % 41 <> 2 or loader_id % 40 = 1"""


@query(f"select {_LINE_SQL}")
def jsonl_scan(spark: SparkSession, sf: str) -> DataFrame:
    """JSON lines to the raw layer: lines that are no JSON wrapped, blank ones passed over, the identifier under either name."""
    raw = files.raw_layer(files.read_lines(spark, _lines(spark, sf)), "run_1", "a.jsonl", "local", "now")
    value = F.try_parse_json("record_raw")
    return raw.select(F.try_variant_get(value, "$.loader_id", "bigint").alias("loader_id"), "id_order", F.try_variant_get(value, "$._unparseable_line", "string").alias("unparseable"))


@query("select count(*) as n, 1 as first, count(*) as last, count(*) as different from spark_loader")
def row_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers of rows without gaps, from the sizes of the partitions."""
    rows = files.numbered(table(spark, sf, "spark_loader").select("loader_id").repartition(7))
    return rows.agg(F.count("*").alias("n"), F.min("number_row_source").cast("int").alias("first"), F.max("number_row_source").alias("last"), F.countDistinct("number_row_source").alias("different"))


@query("select record_id, json_array_length(to_json(items)) as lines, customer.phone as phone from orders_validated where items is not null")
def csv_export(spark: SparkSession, sf: str) -> DataFrame:
    """Nested orders as CSV and back: arrays and structs are JSON text."""
    path = _folder(spark, "export")
    files.export_csv(table(spark, sf, "orders_validated").where("items is not null").select("record_id", "items", "customer"), path)
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).schema("record_id long, items string, customer string").csv(path)
    return back.select("record_id", F.json_array_length("items").cast("long").alias("lines"), F.get_json_object("customer", "$.phone").alias("phone"))


# the store

_RUN = "(select min(id_run) from spark_loader)"


@query(f"select loader_id from spark_loader where id_run = {_RUN}")
def raw_run_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The raw rows of one run, from its own folders, after a replay of it and another run."""
    store, rows = Warehouse(spark, _folder(spark, "store")), table(spark, sf, "spark_loader").select("id_run", "loader_id")
    run = rows.agg(F.min("id_run")).first()[0]
    for part in (rows.where(F.col("id_run") == run), rows.where(F.col("id_run") == run)):
        store.commit(append={"orders_raw": part}, tags={"orders_raw": f"{run}/1"})
    store.commit(append={"orders_raw": rows.where(F.coalesce("id_run", F.lit("")) != run)}, tags={"orders_raw": "others"})
    return pipeline.raw_of(store, run).select("loader_id")


@query(O.SQL["upsert_result"])
def store_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """The store after an upsert that wrote only the rows that changed."""
    store, both = Warehouse(spark, _folder(spark, "store")), table(spark, sf, "orders_validated")
    store.commit(upsert={"orders_validated": (O._last(both.where(O._OLD)), "id_order")})
    come = both.where(O._NEW).withColumn("_row", F.col("record_id"))
    done = upsert(touched(store.read("orders_validated"), come), come, "2030-01-01T00:00:00Z")
    store.commit(upsert={"orders_validated": (done.merged.where("_action in ('inserted', 'updated')").drop("_action"), "id_order")})
    return store.read("orders_validated").select("id_order", "record_id", "total_amount", "updated_at")


@query(f"select * from ({O._daily_sql(O._last_sql('true'))}) order by date desc limit 100")
def read_view(spark: SparkSession, sf: str) -> DataFrame:
    """A page of a view after its refresh in a store."""
    store = Warehouse(spark, _folder(spark, "store"))
    store.commit({"orders_validated": O._last(table(spark, sf, "orders_validated"))})
    views.refresh(store, "daily_sales_summary", "2030-01-01")
    return views.read_view(store, "daily_sales_summary").drop("last_refreshed_at")


# selections

@query(f"select record_id from orders_validated where coalesce(updated_at > '{O._MARK}', false) or coalesce(order_date > '{O._MARK}', false)")
def changed_since(spark: SparkSession, sf: str) -> DataFrame:
    return views.changed(table(spark, sf, "orders_validated"), O._MARK).select("record_id")


@query("""select count(*) as total_orders,
    (select list(c order by c.r desc, c.city) from (select customer.address.city as city, round_even(coalesce(sum(total_amount), 0), 2) as r from orders_validated where customer.address.city is not null and customer.address.city not in ('', 'null') group by 1 order by r desc, 1 limit 5) c)[1].city as first_city,
    (select count(distinct status) from orders_validated where status is not null and status not in ('', 'null')) as statuses from orders_validated""")
def key_figures(spark: SparkSession, sf: str) -> DataFrame:
    found = reports.key_figures(table(spark, sf, "orders_validated"))
    best = F.array_max(F.transform("top_cities", lambda c: c["total_revenue"]))
    city = F.filter("top_cities", lambda c: c["total_revenue"] == best)[0]["city"]
    return found.select("total_orders", city.alias("first_city"), F.size("statuses").cast("long").alias("statuses"))


@query("with hits as materialized (select * from orders_validated where status = 'ملغي' and customer.email is null) select record_id from hits order by id_order nulls first, record_id limit 15")
def filtered_sample(spark: SparkSession, sf: str) -> DataFrame:
    return lookups.sample(table(spark, sf, "orders_validated"), {"status": "ملغي", "customer.email": None}, 15).select("record_id")


# cleaners

def _foreign_sql(x: str) -> str:
    return "case " + " ".join(f"when contains(upper({x}), '{n.upper()}') then '{n}' end" if i == len(C.FOREIGN) - 1 else f"when contains(upper({x}), '{n.upper()}') then '{n}'" for i, n in enumerate(C.FOREIGN))


_HOME = "(?i)" + "|".join(n.replace(".", "[.]") for n in C.YER_SYNONYMS)


def _bare_sql(x: str) -> str:
    """The text without the currency named in it."""
    text = O._strip(x)
    cases = " ".join(f"when '{n}' then regexp_replace({text}, '(?i){n.replace('$', '[$]')}', '', 'g')" for n in C.FOREIGN)
    return O._strip(f"case {_foreign_sql(text)} {cases} else regexp_replace({text}, '{_HOME}', '', 'g') end")


@query(f"select delivery_id, {_bare_sql('total_amount')} as value from test_duplicate_orders")
def without_currency(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "test_duplicate_orders").select("delivery_id", C.without_currency(F.col("total_amount")).alias("value"))


def number_sql(x: str) -> str:
    """The number in a text with foreign digits, separators, currency names or number words."""
    text = _bare_sql(O._thousands(f"translate({O._digits(x)}, '٫', '.')"))
    plain = f"case when regexp_matches({text}, '^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$') then try_cast({text} as double) end"
    return f"coalesce(cast({O._case(text, C.NUMBER_WORDS)} as double), {plain})"


@query(f"select delivery_id, {number_sql('total_amount')} as value from test_duplicate_orders")
def clean_amount(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "test_duplicate_orders").select("delivery_id", C.number(F.col("total_amount")).alias("value"))


@query(f"select loader_id, {IS_ARRAY} as is_array, case when {IS_ARRAY} then json_array_length({SAFE}) end as lines from spark_loader where items is not null")
def json_items(spark: SparkSession, sf: str) -> DataFrame:
    """Whether items is the text of a JSON array, and of how many elements."""
    value = C.json_value(F.col("items"))
    lines = F.size(F.try_variant_get(value, "$", "array<variant>"))
    is_array = F.coalesce(F.schema_of_variant(value).startswith("ARRAY"), F.lit(False))
    return table(spark, sf, "spark_loader").where("items is not null").select("loader_id", is_array.alias("is_array"), F.when(is_array, lines).cast("long").alias("lines"))


@query(f"""select loader_id, coalesce(nullif({O._strip('id_order')}, ''), 'HASH_' || sha256('{{"batch":"' || coalesce(payment_method, 'None') || '","city":"' || coalesce(cast(number_row_source as varchar), 'None') || '"}}')) as key
    from spark_loader where payment_method is null or not regexp_matches(payment_method, '["\\\\\\x00-\\x1f]')""")
def content_keys(spark: SparkSession, sf: str) -> DataFrame:
    """The identifier or, without one, a hash of the content."""
    rows = table(spark, sf, "spark_loader").where(F.col("payment_method").isNull() | ~F.col("payment_method").rlike('["\\\\\\x00-\\x1f]'))
    rows = rows.select("loader_id", "id_order", F.col("payment_method").alias("batch"), F.col("number_row_source").alias("city"))
    return rows.select("loader_id", C.content_key(F.col("id_order"), ("city", "batch")).alias("key"))


# classification of nested records

_PARTS = ("id_order", "order_date", "status", "customer", "items", "delivery", "payment", "total_amount")
_ALLOWED = {"status": tuple(dict.fromkeys(C.STATUS_SYNONYMS.values())), "payment.currency": ("YER",)}


def _classified(spark: SparkSession, sf: str, allowed: dict | None = None) -> DataFrame:
    rows = table(spark, sf, "orders_validated")
    raw = rows.select(F.col("record_id").alias("number_row_source"), F.to_json(F.struct(*_PARTS)).alias("record_raw"))
    return quality.classify(spread(raw), allowed=allowed)


def _blank_sql(x: str) -> str:
    return f"coalesce(trim({x}, ' '), '') = ''"


_DAY = O._DATE.replace("loader_id", "record_id").replace("spark_loader", "orders_validated")
_ITEM = "coalesce(trim(i.{0}, ' '), '') = ''"
_LINE_CODES = f"""case when i is null then ['JSON_ITEMS_CORRUPTED'] else list_filter([
    case when {_ITEM.format('sku')} then 'JSON_ITEMS_CORRUPTED' end, case when {_ITEM.format('name')} then 'JSON_ITEMS_CORRUPTED' end,
    case when not coalesce(i.qty > 0, false) then 'VALUE_NEGATIVE_AMBIGUOUS' end, case when i.unit_price is null then 'PRICE_UNKNOWN' end,
    case when i.unit_price is not null and not (i.unit_price >= 0) then 'VALUE_NEGATIVE_AMBIGUOUS' end, case when not coalesce(i.total >= 0, false) then 'VALUE_NEGATIVE_AMBIGUOUS' end],
    lambda c: c is not null) end"""


def _classify_sql(allowed: bool = False) -> str:
    more = ""
    if allowed:
        states = ", ".join(f"'{s}'" for s in _ALLOWED["status"])
        more = f", case when not coalesce(new_status in ({states}), false) then 'ERRORS_CONFLICTING_MULTIPLE' end, case when not coalesce(currency = 'YER', false) then 'ERRORS_CONFLICTING_MULTIPLE' end"
    amount = "coalesce(payment.amount, case when payment is null then total_amount end)"
    return rf"""
    with days as ({_DAY}),
    cleaned as (
        select o.*, d.value as day, {O._status('status')} as new_status,
            case when customer is not null then coalesce(nullif(customer.phone, ''), '') end as phone, case when customer is not null then coalesce(nullif(customer.email, ''), '') end as email,
            {O._currency('payment.currency')} as code
        from orders_validated o join days d using (record_id)),
    tidy as (select *, {O._phone('phone')} as new_phone, {O._email('email')} as new_email, coalesce(code, trim(payment.currency, ' ')) as currency, regexp_replace({O._strip('day')}, '[Zz]$', '+00:00') as iso from cleaned),
    judged as (
        select record_id, list_filter([
            case when coalesce({O._strip('id_order')}, '') = '' then 'ID_ORDER_MISSING' end,
            case when not coalesce(regexp_matches(iso, '{O._ISO}') and try_cast(iso as timestamptz) is not null, false) then 'DATE_IMPOSSIBLE_INVALID' end,
            case when {_blank_sql('customer.customer_id')} then 'ID_CUSTOMER_MISSING' end, case when {_blank_sql('customer.name')} then 'ID_CUSTOMER_MISSING' end,
            case when not regexp_matches(new_email, '^[^@\s]+@[^@\s]+[.][^@\s]+$') then 'ERRORS_CONFLICTING_MULTIPLE' end,
            case when not regexp_matches(new_phone, '^(967)?(77|73|70|71)[0-9]{{7}}$') then 'ERRORS_CONFLICTING_MULTIPLE' end,
            case when {_blank_sql('customer.address.city')} or {_blank_sql('customer.address.district')} then 'ERRORS_CONFLICTING_MULTIPLE' end,
            case when items is null then 'JSON_ITEMS_CORRUPTED' end, case when len(items) = 0 then 'ITEMS_EMPTY' end,
            case when not coalesce({amount} >= 0, false) then 'VALUE_NEGATIVE_AMBIGUOUS' end, case when not coalesce(total_amount >= 0, false) then 'VALUE_NEGATIVE_AMBIGUOUS' end{more}], lambda c: c is not null)
            || coalesce(flatten(list_transform(items, lambda i: {_LINE_CODES})), []) as errors,
            list_filter([case when new_status <> status then 'STATUS_SYNONYM_NORM' end, case when day <> order_date then 'DATE_ISO_NORM' end,
            case when customer is not null and new_phone <> phone then 'PHONE_NORM' end, case when customer is not null and new_email <> email then 'EMAIL_REPAIR' end,
            case when payment is null and total_amount is not null then 'SYNTHESIZE_FLAT_PAYMENT' end,
            case when payment is not null and code <> payment.currency then 'CURRENCY_NORM' end], lambda c: c is not null) as changes
        from tidy),
    coded as (select *, list_sort(list_distinct(case when len(errors) > 1 then errors || ['ERRORS_CONFLICTING_MULTIPLE'] else errors end)) as codes from judged),
    found as (select record_id, case when len(codes) > 0 then 'QUARANTINED' when len(changes) > 0 then 'CORRECTED' else 'VALID' end as outcome, codes, len(errors) as errors, list_sort(changes) as changes from coded)"""


_SHOWN = "select record_id, outcome, array_to_string(codes, ',') as codes, array_to_string(changes, ',') as changes from found"


def _shown(found: DataFrame) -> DataFrame:
    rules: Column = F.array_sort(F.transform("corrections", lambda c: c["rule_code"]))
    return found.select(F.col("number_row_source").alias("record_id"), "outcome", F.array_join("codes_error", ",").alias("codes"), F.array_join(rules, ",").alias("changes"))


@query(_classify_sql() + _SHOWN)
def classify_nested(spark: SparkSession, sf: str) -> DataFrame:
    """Outcome, codes and corrections of nested records."""
    return _shown(_classified(spark, sf))


@query(_classify_sql(True) + _SHOWN)
def classify_allowed(spark: SparkSession, sf: str) -> DataFrame:
    """The same with lists of allowed states and currencies."""
    return _shown(_classified(spark, sf, _ALLOWED))


@query(_classify_sql() + "select outcome, count(*) as records from found group by 1")
def nested_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return quality.outcome_counts(_classified(spark, sf))


@query(_classify_sql() + "select unnest(codes) as code, count(*) as count from found group by 1")
def nested_codes(spark: SparkSession, sf: str) -> DataFrame:
    """How many quarantined records carry each code."""
    return reports.quarantine_summary(_classified(spark, sf).where("outcome = 'QUARANTINED'"))


@query(_classify_sql() + "select record_id from found where list_contains(codes, 'PRICE_UNKNOWN')")
def with_code(spark: SparkSession, sf: str) -> DataFrame:
    return lookups.with_code(_classified(spark, sf), "PRICE_UNKNOWN").select(F.col("number_row_source").alias("record_id"))


@query(_classify_sql() + """select (select count(*) from orders_validated) as read_rows, count(*) filter (outcome = 'VALID') as valid, count(*) filter (outcome = 'CORRECTED') as corrected,
    count(*) filter (outcome = 'QUARANTINED') as quarantined, true as consistent from found""")
def consistency_of_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return quality.consistent(table(spark, sf, "orders_validated"), _classified(spark, sf))


# classification of flat records: the twins of the queries in orders.py

_GIVEN = "nullif({0}, '')"
_FLAT = ("customer_id", "customer_name", "phone", "email", "shipping_city")
_KIND = "json_type(el, '$.{0}')"


def _line_number(name: str) -> str:
    """The number in a part of a line, by the type it was written with."""
    return f"case when {name}_kind in ('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT') then try_cast({name}_text as double) when {name}_kind = 'VARCHAR' then {number_sql(f'{name}_text')} end"


def _flat_sql() -> str:
    some = f"coalesce({', '.join(_GIVEN.format(c) for c in _FLAT)}) is not null"
    plain = lambda c: f"case when given then coalesce(trim({_GIVEN.format(c)}, ' '), '') end"
    amount = _GIVEN.format("total_amount")
    wrong = "not coalesce({0}, false)"
    return rf"""
    with days as ({O._DATE}),
    rows as (select s.*, {some} as given, d.value as day, {O._status('status')} as new_status, {IS_ARRAY} as is_array, {SAFE} as safe from spark_loader s join days d using (loader_id)),
    tidy as (select *, regexp_replace({O._strip('day')}, '[Zz]$', '+00:00') as iso, {number_sql(amount)} as amount,
        case when given and {_GIVEN.format('phone')} is not null then {O._phone('phone')} else '' end as one_phone, case when given and {_GIVEN.format('email')} is not null then {O._email('email')} else '' end as one_email from rows),
    clean as (select *, {O._phone('one_phone')} as new_phone, {O._email('one_email')} as new_email from tidy),
    elements as (select loader_id, unnest(json_extract(safe, '$[*]')) as el from rows where is_array),
    parts as (select loader_id, json_type(el) as kind, json_extract_string(el, '$.sku') as sku, json_extract_string(el, '$.name') as name,
        json_extract_string(el, '$.qty') as qty_text, {_KIND.format('qty')} as qty_kind, json_extract_string(el, '$.total') as total_text, {_KIND.format('total')} as total_kind,
        case when {_KIND.format('unit_price')} is null then json_extract_string(el, '$.price') else json_extract_string(el, '$.unit_price') end as price_text, coalesce({_KIND.format('unit_price')}, {_KIND.format('price')}) as price_kind from elements),
    numbers as (select *, {_line_number('qty')} as qty, {_line_number('price')} as price, {_line_number('total')} as total from parts),
    lines as (select loader_id, count(*) as n,
        flatten(list(case when kind <> 'OBJECT' then ['JSON_ITEMS_CORRUPTED'] else list_filter([
            case when {_blank_sql('sku')} then 'JSON_ITEMS_CORRUPTED' end, case when {_blank_sql('name')} then 'JSON_ITEMS_CORRUPTED' end,
            case when {wrong.format("qty_kind in ('BIGINT', 'UBIGINT', 'VARCHAR') and floor(qty) > 0")} then 'VALUE_NEGATIVE_AMBIGUOUS' end,
            case when {wrong.format("price_kind <> 'NULL'")} then 'PRICE_UNKNOWN' when {wrong.format('price >= 0')} then 'VALUE_NEGATIVE_AMBIGUOUS' end,
            case when {wrong.format("total_kind <> 'NULL' and total >= 0")} then 'VALUE_NEGATIVE_AMBIGUOUS' end], lambda c: c is not null) end)) as codes,
        sum(case when qty_kind = 'VARCHAR' and qty is not null then 1 else 0 end + case when price_kind = 'VARCHAR' and price is not null then 1 else 0 end + case when total_kind = 'VARCHAR' and total is not null then 1 else 0 end) as changes
        from numbers group by 1),
    judged as (
        select loader_id, list_filter([
            case when coalesce({O._strip('id_order')}, '') = '' then 'ID_ORDER_MISSING' end,
            case when {wrong.format(f"regexp_matches(iso, '{O._ISO}') and try_cast(iso as timestamptz) is not null")} then 'DATE_IMPOSSIBLE_INVALID' end,
            case when {_blank_sql(plain('customer_id'))} then 'ID_CUSTOMER_MISSING' end, case when {_blank_sql(plain('customer_name'))} then 'ID_CUSTOMER_MISSING' end,
            case when not regexp_matches(new_email, '^[^@\s]+@[^@\s]+[.][^@\s]+$') then 'ERRORS_CONFLICTING_MULTIPLE' end,
            case when not regexp_matches(new_phone, '^(967)?(77|73|70|71)[0-9]{{7}}$') then 'ERRORS_CONFLICTING_MULTIPLE' end,
            case when {_blank_sql(plain('shipping_city'))} or {_blank_sql(plain('district'))} then 'ERRORS_CONFLICTING_MULTIPLE' end,
            case when not is_array then 'JSON_ITEMS_CORRUPTED' when coalesce(n, 0) = 0 then 'ITEMS_EMPTY' end,
            case when {wrong.format('amount >= 0')} then 'VALUE_NEGATIVE_AMBIGUOUS' end, case when {wrong.format('amount >= 0')} then 'VALUE_NEGATIVE_AMBIGUOUS' end], lambda c: c is not null) || coalesce(codes, []) as errors,
            cast(coalesce(new_status <> status, false) as int) + cast(coalesce(day <> order_date, false) as int) + cast(given as int) + cast(coalesce({_GIVEN.format('payment_method')}, {amount}) is not null as int) + cast(is_array as int) + coalesce(changes, 0) as corrections
        from clean left join lines using (loader_id)),
    coded as (select *, list_sort(list_distinct(case when len(errors) > 1 then errors || ['ERRORS_CONFLICTING_MULTIPLE'] else errors end)) as codes from judged),
    found as (select loader_id, case when len(codes) > 0 then 'QUARANTINED' when corrections > 0 then 'CORRECTED' else 'VALID' end as outcome, codes, cast(corrections as int) as corrections from coded)"""


SQL["classify_records"] = _flat_sql() + "select loader_id as number_row_source, outcome, array_to_string(codes, ',') as codes, corrections from found"
SQL["classify_outcomes"] = _flat_sql() + "select outcome, count(*) as records from found group by 1"
SQL["quarantine_summary"] = _flat_sql() + "select unnest(codes) as code, count(*) as count from found group by 1"


# incremental loads, runs and jobs in a store

_STORED = f"with o as ({O._last_sql(O._OLD)}), mark as (select greatest('{I.EPOCH}', max({O._TIME})) as wm from orders_validated where {O._OLD} and coalesce({O._strip('id_order')}, '') <> '')"


@query(f"""{_STORED},
    new as (select *, {O._strip('id_order')} as key, coalesce(nullif(updated_at, ''), nullif(order_date, ''), '{I.EPOCH}') as time from orders_validated where {O._NEW}),
    delta as (select new.* from new, mark where coalesce({O._TIME}, '{I.NEVER}') > mark.wm),
    keyed as (select * from delta where coalesce(key, '') <> ''),
    judged as (select * from keyed k where event_id is null or not exists (select 1 from orders_validated e where e.source_system = 'erp' and coalesce({O._strip('e.id_order')}, '') <> '' and e.event_id = k.event_id and e.event_id <> '')),
    accepted as (select j.* from judged j left join o on j.key = o.id_order where o.id_order is null or coalesce(j.version, 1) > coalesce(o.version, 0)
        or (coalesce(j.version, 1) = coalesce(o.version, 0) and j.time >= coalesce(nullif(o.updated_at, ''), nullif(o.order_date, ''), '{I.EPOCH}')))
    select (select wm from mark) as watermark_used, (select count(*) from new) as read, (select count(*) from new) - (select count(*) from delta) as filtered, (select count(*) from keyed) - (select count(*) from judged) as events_skipped,
        (select count(*) from judged) - (select count(*) from accepted) as conflicts_rejected, (select count(*) from accepted) as processed,
        (select count(distinct key) from accepted) - (select count(distinct key) from accepted a join o on a.key = o.id_order) as inserted,
        (select greatest((select wm from mark), coalesce(max({O._TIME}), '')) from judged) as new_watermark""")
def delta_counters(spark: SparkSession, sf: str) -> DataFrame:
    """The counters of an incremental load after an initial one."""
    store, both = Warehouse(spark, _folder(spark, "store")), table(spark, sf, "orders_validated").withColumn("_row", F.col("record_id"))
    I.initial_load(store, both.where(O._OLD), "2030-01-01T00:00:00Z")
    done = I.process_delta(store, both.where(O._NEW), "2030-01-01T00:00:00Z")
    names = {"watermark_used": "watermark_used", "delta_records_read": "read", "filtered_by_watermark": "filtered", "events_skipped": "events_skipped", "conflicts_rejected": "conflicts_rejected", "processed_count": "processed", "inserted": "inserted", "new_watermark": "new_watermark"}
    return spark.createDataFrame([tuple(done[k] for k in names)], "watermark_used string, read long, filtered long, events_skipped long, conflicts_rejected long, processed long, inserted long, new_watermark string").toDF(*names.values())


def _jobs(spark: SparkSession, sf: str) -> DataFrame:
    start = F.lpad(F.col("event_id").cast("string"), 12, "0")
    return table(spark, sf, "events").select(F.col("event_type").alias("job"), F.lit("manual").alias("trigger"), F.when(F.col("value") > 50, "FAILED").otherwise("SUCCESS").alias("status"), start.alias("start_time"), F.col("value").alias("seconds"), F.lit("").alias("message"))


_JOBS = "select event_type as job, case when value > 50 then 'FAILED' else 'SUCCESS' end as status, lpad(cast(event_id as varchar), 12, '0') as start_time, value as seconds from events"


@query(f"select job, max(start_time) as start_time, arg_max(status, start_time) as status, arg_max(seconds, start_time) as seconds from ({_JOBS}) group by 1")
def last_job_runs(spark: SparkSession, sf: str) -> DataFrame:
    """The last run of each job."""
    return pipeline.last_runs(_jobs(spark, sf))


@query(f"select job, status, start_time, seconds from ({_JOBS}) where job = (select min(event_type) from events) order by start_time desc, job limit 20")
def job_log_page(spark: SparkSession, sf: str) -> DataFrame:
    """The newest entries of a job in the log of a store."""
    store, jobs = Warehouse(spark, _folder(spark, "store")), _jobs(spark, sf)
    store.commit(append={"job_log": jobs.where("status = 'FAILED'")})
    store.commit(append={"job_log": jobs.where("status <> 'FAILED'")})
    return pipeline.job_log(store, jobs.agg(F.min("job")).first()[0]).select("job", "status", "start_time", "seconds")


@query("""with runs as (select user_id as id_run, count(*) as read_rows, case when user_id % 3 <> 0 then count(*) / 2.0 end as seconds, case when user_id % 5 = 0 then 9.0 else 2.0 end as rows_per_second, user_id % 7 <> 0 as consistent from events where user_id is not null group by 1)
    select cast(id_run as varchar) as id_run, unnest(list_filter([case when seconds is null then 'missing figure' end, case when not consistent then 'inconsistent counts' end, case when abs(rows_per_second - read_rows / seconds) > 0.05 * rows_per_second then 'throughput does not fit' end], lambda x: x is not null)) as issue from runs""")
def audited_runs(spark: SparkSession, sf: str) -> DataFrame:
    """What does not fit in the figures of runs."""
    run = F.col("user_id")
    rows = table(spark, sf, "events").where("user_id is not null").groupBy("user_id").agg(F.count("*").alias("read_rows"))
    seconds = F.when(run % 3 != 0, F.col("read_rows") / 2.0)
    runs = rows.select(run.cast("string").alias("id_run"), "read_rows", seconds.alias("seconds"), F.when(run % 5 == 0, 9.0).otherwise(2.0).alias("rows_per_second"), (run % 7 != 0).alias("consistent"))
    return pipeline.audit_runs(runs)
