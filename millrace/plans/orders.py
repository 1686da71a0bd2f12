"""Queries of the order operators over the test tables, each with its twin in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import cleaners as C
from millrace.functions.schema import LAYOUTS
from millrace.operators import incremental as I
from millrace.operators import lookups, quality, reports, views
from millrace.operators.upsert import keep_last, upsert
from millrace.session import small, spread, table
from millrace.sources.files import raw_layer
from millrace.streaming.loader import windowed

QUERIES = {}
SQL: dict[str, str] = {}

#: White space for RE2, as Java's (?U)\s has it.
_WS = r"[\s\x{0b}\x{85}\p{Z}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _digits(x: str) -> str:
    return f"translate({x}, '{C.ARABIC_DIGITS[0]}', '{C.ARABIC_DIGITS[1]}')"


def _case(x: str, pairs: dict) -> str:
    return f"case {x} " + " ".join(f"when '{k}' then {v!r}" for k, v in pairs.items()) + " end"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders_validated")


# reports

_CITY = "customer.address.city"


@query(f"""select {_CITY} as city, round_even(coalesce(sum(total_amount), 0), 2) as total_revenue, count(*) as total_orders, round_even(avg(total_amount), 2) as avg_order_value
    from orders_validated where {_CITY} is not null and {_CITY} not in ('', 'null') group by 1 order by total_revenue desc, city limit 20""")
def sales_by_city(spark: SparkSession, sf: str) -> DataFrame:
    return reports.sales_by_city(_orders(spark, sf))


@query("""with lines as (select unnest(items) as i from orders_validated)
    select i.sku as sku, i.name as product_name, cast(coalesce(sum(i.qty), 0) as bigint) as total_quantity_sold, round_even(coalesce(sum(i.total), 0), 2) as total_revenue, count(*) as order_occurrences
    from lines where i.sku is not null group by 1, 2 having coalesce(sum(i.qty), 0) >= 1 order by total_revenue desc, sku, product_name limit 10""")
def top_products(spark: SparkSession, sf: str) -> DataFrame:
    return reports.top_products(_orders(spark, sf))


@query("""select customer.customer_id as customer_id, min(customer.name) as customer_name, round_even(coalesce(sum(total_amount), 0), 2) as total_spend, count(*) as total_orders,
    round_even(avg(total_amount), 2) as avg_order_spend, max(order_date) as last_order_date
    from orders_validated where customer.customer_id is not null and customer.customer_id not in ('', 'null') group by 1 order by total_spend desc, customer_id limit 10""")
def top_customers(spark: SparkSession, sf: str) -> DataFrame:
    return reports.top_customers(_orders(spark, sf))


def _period_sql(n: int, more: str = "") -> str:
    return f"""select substring(order_date, 1, {n}) as period, round_even(coalesce(sum(total_amount), 0), 2) as total_revenue, count(*) as total_orders, round_even(avg(total_amount), 2) as avg_order_value
        from orders_validated where {more or "order_date is not null and order_date <> ''"} group by 1 order by period desc limit 30"""


@query(_period_sql(10))
def sales_by_period_daily(spark: SparkSession, sf: str) -> DataFrame:
    return reports.sales_by_period(_orders(spark, sf))


@query(_period_sql(7, "order_date >= '2024-03' and order_date <= '2025-09'"))
def sales_by_period_monthly(spark: SparkSession, sf: str) -> DataFrame:
    return reports.sales_by_period(_orders(spark, sf), "monthly", "2024-03", "2025-09")


@query("""select status, count(*) as count_orders, round_even(coalesce(sum(total_amount), 0), 2) as total_value, round_even(avg(total_amount), 2) as avg_value
    from orders_validated where status is not null and status not in ('', 'null') group by 1""")
def orders_by_status(spark: SparkSession, sf: str) -> DataFrame:
    return reports.orders_by_status(_orders(spark, sf))


@query("""with orders_at as (select n_name, r_name, o_totalprice from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)
    select r_name as region, n_name as city, round_even(sum(o_totalprice), 2) as total_revenue, count(*) as total_orders, round_even(avg(o_totalprice), 2) as avg_order_value from orders_at group by 1, 2""")
def sales_by_nation(spark: SparkSession, sf: str) -> DataFrame:
    nations = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(small(nations), F.col("c_nationkey") == F.col("n_nationkey"))
    found = rows.groupBy(F.col("r_name").alias("region"), F.col("n_name").alias("city")).agg(F.sum("o_totalprice").alias("total_revenue"), F.count("*").alias("total_orders"), F.avg("o_totalprice").alias("avg_order_value"))
    return found.withColumns({c: reports.cents(c) for c in ("total_revenue", "avg_order_value")})


# lookups: one page of the fields that tell the documents apart

_SHOWN = ("record_id", "id_order", "order_date", "status", "total_amount")
_ONE_CITY = "(select city_name_ar from ref_city where city_id = 2)"


def _page_sql(where: str, order: str = "") -> str:
    # the filter apart from the page: DuckDB 2.0 fails on a filter of a nested field below a limit
    return f"with hits as materialized (select * from orders_validated where {where}) select {', '.join(_SHOWN)} from hits order by {order} id_order nulls first, record_id limit 50"


def _city(spark: SparkSession, sf: str) -> str:
    return table(spark, sf, "ref_city").where("city_id = 2").first()["city_name_ar"]


@query(_page_sql("customer.customer_id || '' = 'CUS-000001'"))
def orders_by_customer(spark: SparkSession, sf: str) -> DataFrame:
    return lookups.orders_by_customer(_orders(spark, sf), "CUS-000001").select(*_SHOWN)


@query(_page_sql(f"{_CITY} || '' = {_ONE_CITY}"))
def orders_by_city(spark: SparkSession, sf: str) -> DataFrame:
    return lookups.orders_by_city(_orders(spark, sf), _city(spark, sf)).select(*_SHOWN)


@query(_page_sql("status = 'ملغي'"))
def lookup_orders_by_status(spark: SparkSession, sf: str) -> DataFrame:
    return lookups.orders_by_status(_orders(spark, sf), "ملغي").select(*_SHOWN)


@query(_page_sql("order_date between '2024-02' and '2024-05-31'", "order_date,"))
def orders_by_date_range(spark: SparkSession, sf: str) -> DataFrame:
    return lookups.orders_by_date_range(_orders(spark, sf), "2024-02", "2024-05-31").select(*_SHOWN)


@query(_page_sql("total_amount >= 20000", "total_amount desc,"))
def high_value_orders(spark: SparkSession, sf: str) -> DataFrame:
    return lookups.high_value_orders(_orders(spark, sf), 20000).select(*_SHOWN)


@query(_page_sql(f"{_CITY} || '' = {_ONE_CITY} and status = 'مؤكد'"))
def orders_by_city_and_status(spark: SparkSession, sf: str) -> DataFrame:
    return lookups.orders_by_city_and_status(_orders(spark, sf), _city(spark, sf), "مؤكد").select(*_SHOWN)


@query("select record_id, id_order from orders_validated where regexp_matches(id_order, '(?i)ord-0*1[0-9]*9') or regexp_matches(customer.name, '(?i)hedua')")
def regex_search(spark: SparkSession, sf: str) -> DataFrame:
    return lookups.search(_orders(spark, sf), "(ord-0*1[0-9]*9|hedua)", "id_order", "customer.name").select("record_id", "id_order")


# cleaners


@query(f"select loader_id, {_digits('total_amount')} as value from spark_loader")
def clean_arabic_digits(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "spark_loader").select("loader_id", C.arabic_digits(F.col("total_amount")).alias("value"))


_BETWEEN = rf"(\p{{Nd}}){_WS}+(\p{{Nd}})"


def _thousands(x: str) -> str:
    bare = f"translate({x}, ',٬', '')"
    once = f"regexp_replace({bare}, '{_BETWEEN}', '\\1\\2', 'g')"
    return f"regexp_replace({once}, '{_BETWEEN}', '\\1\\2', 'g')"


@query(f"select loader_id, {_thousands('total_amount')} as value from spark_loader")
def clean_thousands(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "spark_loader").select("loader_id", C.thousands(F.col("total_amount")).alias("value"))


def _currency(x: str) -> str:
    text = f"upper({_strip(x)})"
    cases = " ".join(f"when contains({text}, '{n.upper()}') then '{C.FOREIGN_CODES.get(n, n.upper())}'" for n in C.FOREIGN)
    home = " or ".join(f"contains({text}, '{n.upper()}')" for n in C.YER_SYNONYMS)
    return f"case {cases} when {home} then 'YER' end"


@query(f"select loader_id, {_currency('currency')} as code from spark_loader")
def clean_currency(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "spark_loader").select("loader_id", C.currency_code(F.col("currency")).alias("code"))


@query(f"select delivery_id, {_case(_strip('total_amount'), C.NUMBER_WORDS)} as value from test_duplicate_orders")
def clean_number_words(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "test_duplicate_orders").select("delivery_id", C.number_word(F.col("total_amount")).alias("value"))


def _phone(x: str) -> str:
    digits = f"regexp_replace(regexp_replace({_digits(x)}, '[^0-9]', '', 'g'), '^00967', '967')"
    local = f"regexp_replace({digits}, '^0((?:77|73|70|71)[0-9]{{7}})$', '\\1')"
    return f"coalesce(regexp_replace({local}, '^((?:77|73|70|71)[0-9]{{7}})$', '967\\1'), '')"


@query(f"select loader_id, {_phone('phone')} as value from spark_loader")
def clean_phone(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "spark_loader").select("loader_id", C.phone(F.col("phone")).alias("value"))


def _email(x: str) -> str:
    return f"coalesce(regexp_replace(regexp_replace({_strip(x)}, '@+', '@', 'g'), '[.]+', '.', 'g'), '')"


@query(f"select loader_id, {_email('email')} as value from spark_loader")
def clean_email(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "spark_loader").select("loader_id", C.email(F.col("email")).alias("value"))


_DATE = f"""
    with a as (select loader_id, order_date as old, {_digits('order_date')} as new from spark_loader),
    b as (select *, regexp_replace({_strip('new')}, '{_WS}+', ' ', 'g') as tidy from a),
    c as (select *, string_split(translate(translate(case when contains(tidy, 'T') then substring(tidy, 1, instr(tidy, 'T') - 1) else tidy end, ' ', ''), '/', '-'), '-') as p,
                 case when contains(tidy, 'T') then 'T' || {_strip("substring(tidy, instr(tidy, 'T') + 1)")} else '' end as clock from b)
    select loader_id, case when (regexp_matches(new, '[/ ]') or new <> old) and len(p) = 3 and length(p[1]) = 4
        then p[1] || '-' || case when length(p[2]) < 2 then lpad(p[2], 2, '0') else p[2] end || '-' || case when length(p[3]) < 2 then lpad(p[3], 2, '0') else p[3] end || clock
        else old end as value from c"""


@query(_DATE)
def clean_date(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "spark_loader").select("loader_id", C.date(F.col("order_date")).alias("value"))


def _number(x: str) -> str:
    text = _thousands(f"translate({_digits(x)}, '٫', '.')")
    return f"case when regexp_matches({_strip(text)}, '^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$') then try_cast({_strip(text)} as double) end"


@query(f"select loader_id, {_number('total_amount')} as value from spark_loader")
def clean_numeric(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "spark_loader").select("loader_id", C.number(F.col("total_amount")).alias("value"))


def _status(x: str) -> str:
    return f"coalesce({_case(_strip(x), C.STATUS_SYNONYMS)}, {_strip(x)})"


@query(f"select delivery_id, {_status('status')} as value from test_duplicate_orders")
def status_synonyms(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "test_duplicate_orders").select("delivery_id", C.status(F.col("status")).alias("value"))


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def parse_json_payload(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query("select record_id, i.sku as sku, i.qty as qty, i.total as total from (select record_id, unnest(items) as i from orders_validated)")
def unwind_items(spark: SparkSession, sf: str) -> DataFrame:
    return _orders(spark, sf).select("record_id", F.explode("items").alias("i")).select("record_id", "i.sku", "i.qty", "i.total")


@query("select record_id, coalesce(list_sum(list_transform(items, lambda i: i.qty)), 0) as pieces, coalesce(len(items), 0) as lines from orders_validated")
def sum_items(spark: SparkSession, sf: str) -> DataFrame:
    pieces = F.aggregate("items", F.lit(0), lambda s, i: s + F.coalesce(i["qty"], F.lit(0)))
    return _orders(spark, sf).select("record_id", F.coalesce(pieces, F.lit(0)).cast("decimal(38,0)").cast("long").alias("pieces"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("lines"))


# raw layer, quality


@query(f"""select loader_id as number_row_source, nullif({_strip('id_order')}, '') as id_order, 'run_1' as id_run, 'orders.csv' as file_source, 'spark' as engine_used from spark_loader""")
def raw_metadata(spark: SparkSession, sf: str) -> DataFrame:
    return _raw(spark, sf).select("number_row_source", "id_order", "id_run", "file_source", "engine_used")


def _raw(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "spark_loader").select(F.col("loader_id").alias("number_row_source"), *LAYOUTS[0])
    return raw_layer(rows, "run_1", "orders.csv", "spark", "2026-01-01T00:00:00Z")


_ISO = "^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]{1,6})?)?([+-][0-9]{2}:[0-9]{2})?)?$"


@query(f"""with d as ({_DATE}), x as (select s.*, regexp_replace({_strip('d.value')}, '[Zz]$', '+00:00') as iso from spark_loader s join d using (loader_id))
    select loader_id, coalesce({_strip('id_order')}, '') = '' as id_missing, not coalesce(regexp_matches(iso, '{_ISO}') and try_cast(iso as timestamptz) is not null, false) as date_invalid,
        coalesce({_strip('customer_id')}, '') = '' as customer_missing, coalesce({_strip('customer_name')}, '') = '' as name_missing,
        not regexp_matches({_email('email')}, '^[^@\\s]+@[^@\\s]+[.][^@\\s]+$') as email_invalid, not regexp_matches({_phone('phone')}, '^(967)?(77|73|70|71)[0-9]{{7}}$') as phone_invalid
    from x""")
def validation_flags(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "spark_loader")
    empty = lambda c: F.coalesce(C.strip(F.col(c)), F.lit("")) == ""
    return rows.select(
        "loader_id",
        (F.coalesce(C.strip(F.col("id_order")), F.lit("")) == "").alias("id_missing"),
        (~C.is_iso(C.date(F.col("order_date")))).alias("date_invalid"),
        empty("customer_id").alias("customer_missing"),
        empty("customer_name").alias("name_missing"),
        (~C.email(F.col("email")).rlike(C.EMAIL_PATTERN)).alias("email_invalid"),
        (~C.phone(F.col("phone")).rlike(C.PHONE_PATTERN)).alias("phone_invalid"),
    )


@query()
def classify_records(spark: SparkSession, sf: str) -> DataFrame:
    """Outcome, error codes and number of corrections of every raw row."""
    found = quality.classify(spread(_raw(spark, sf)))
    return found.select("number_row_source", "outcome", F.array_join("codes_error", ",").alias("codes"), F.size("corrections").alias("corrections"))


@query()
def classify_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return quality.outcome_counts(quality.classify(spread(_raw(spark, sf))))


@query()
def quarantine_summary(spark: SparkSession, sf: str) -> DataFrame:
    return reports.quarantine_summary(quality.classify(spread(_raw(spark, sf))).where("outcome = 'QUARANTINED'"))


@query("select count(*) as read_rows, true as consistent from spark_loader")
def consistency_equation(spark: SparkSession, sf: str) -> DataFrame:
    raw = spread(_raw(spark, sf))
    return quality.consistent(raw, quality.classify(raw)).select("read_rows", "consistent")


# upsert, incremental loading, views: the records of one source system are the store, all others arrive

_OLD, _NEW = "source_system = 'erp'", "coalesce(source_system, '') <> 'erp'"


def _last_sql(where: str) -> str:
    return f"select * from (select * replace (nullif({_strip('id_order')}, '') as id_order), row_number() over (partition by nullif({_strip('id_order')}, '') order by record_id desc) as _n from orders_validated where {where}) where _n = 1 and id_order is not null"


def _last(df: DataFrame) -> DataFrame:
    rows = df.withColumn("id_order", F.nullif(C.strip(F.col("id_order")), F.lit(""))).where("id_order is not null")
    return keep_last(rows, "id_order", "record_id")


@query(f"select id_order, record_id from ({_last_sql('true')})")
def dedup_keep_last(spark: SparkSession, sf: str) -> DataFrame:
    return _last(_orders(spark, sf)).select("id_order", "record_id")


_SAME = " and ".join(
    [f"o.{c} is not distinct from n.{c}" for c in ("order_date", "status", "customer", "items", "delivery", "payment", "total_amount", "version", "event_id", "quality_status", "source_system")]
    + ["list_transform(o.corrections, lambda c: [c.field, c.original_value, c.corrected_value, c.rule_code]) is not distinct from list_transform(n.corrections, lambda c: [c.field, c.original_value, c.corrected_value, c.rule_code])"]
)


@query(f"""with o as ({_last_sql(_OLD)}), n as ({_last_sql(_NEW)})
    select coalesce(o.id_order, n.id_order) as id_order, case when n.id_order is null then 'kept' when o.id_order is null then 'inserted' when {_SAME} then 'unchanged' else 'updated' end as action
    from o full join n on o.id_order = n.id_order""")
def upsert_classification(spark: SparkSession, sf: str) -> DataFrame:
    return _upsert(spark, sf).merged.select("id_order", F.col("_action").alias("action"))


def _upsert(spark: SparkSession, sf: str):
    orders = _orders(spark, sf)
    return upsert(_last(orders.where(_OLD)), orders.where(_NEW).withColumn("_row", F.col("record_id")), "2030-01-01T00:00:00Z")


@query(f"""with o as ({_last_sql(_OLD)}), n as ({_last_sql(_NEW)}),
    m as (select o.id_order is not null as held, n.id_order is not null as came, coalesce({_SAME}, false) as same, o as old, n as new from o full join n on o.id_order = n.id_order)
    select coalesce(old.id_order, new.id_order) as id_order,
        case when not came or (held and same) then old.record_id else new.record_id end as record_id,
        case when not came or (held and same) then old.total_amount else new.total_amount end as total_amount,
        case when not came or (held and same) then old.updated_at when held then '2030-01-01T00:00:00Z' else coalesce(nullif(new.updated_at, ''), '2030-01-01T00:00:00Z') end as updated_at
    from m""")
def upsert_result(spark: SparkSession, sf: str) -> DataFrame:
    return _upsert(spark, sf).table().select("id_order", "record_id", "total_amount", "updated_at")


_MARK = "2025-06-01T00:00:00Z"
_TIME = "coalesce(nullif(updated_at, ''), nullif(order_date, ''))"


@query(f"select record_id from orders_validated where coalesce({_TIME}, '{I.NEVER}') > '{_MARK}'")
def delta_filter(spark: SparkSession, sf: str) -> DataFrame:
    return I.delta_filter(_orders(spark, sf), _MARK).select("record_id")


@query(f"""with o as ({_last_sql(_OLD)})
    select n.record_id, o.id_order is null or coalesce(n.version, 1) > coalesce(o.version, 0) or (coalesce(n.version, 1) = coalesce(o.version, 0)
        and coalesce(nullif(n.updated_at, ''), nullif(n.order_date, ''), '{I.EPOCH}') >= coalesce(nullif(o.updated_at, ''), nullif(o.order_date, ''), '{I.EPOCH}')) as accepted
    from orders_validated n left join o on {_strip('n.id_order')} = o.id_order where coalesce(n.source_system, '') <> 'erp'""")
def version_conflict(spark: SparkSession, sf: str) -> DataFrame:
    orders = _orders(spark, sf)
    return I.resolve_versions(orders.where(_NEW), _last(orders.where(_OLD))).select("record_id", F.col("_accepted").alias("accepted"))


@query(f"""select record_id from orders_validated n where {_NEW} and not exists (select 1 from orders_validated o where o.source_system = 'erp' and o.event_id = n.event_id)""")
def event_dedup(spark: SparkSession, sf: str) -> DataFrame:
    orders = _orders(spark, sf)
    return I.unseen_events(orders.where(_NEW), orders.where(_OLD).select("event_id")).select("record_id")


@query(f"select greatest('{I.EPOCH}', max({_TIME})) as watermark from orders_validated")
def watermark_advance(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(I.watermark(_orders(spark, sf), I.EPOCH),)], "watermark string")


def _daily_sql(rows: str) -> str:
    return f"""select substring(order_date, 1, 10) as date, round_even(coalesce(sum(total_amount), 0), 2) as total_revenue, count(*) as total_orders, round_even(avg(total_amount), 2) as avg_order_value
        from ({rows}) where order_date is not null and order_date <> '' group by 1"""


def _products_sql(rows: str) -> str:
    return f"""select i.sku as sku, min(i.name) as product_name, cast(coalesce(sum(i.qty), 0) as bigint) as total_quantity_sold, round_even(coalesce(sum(i.total), 0), 2) as total_revenue, count(*) as order_occurrences
        from (select unnest(items) as i from ({rows})) where i.sku is not null group by 1"""


@query(_daily_sql(_last_sql("true")))
def mv_daily_full(spark: SparkSession, sf: str) -> DataFrame:
    return views.daily_sales(_last(_orders(spark, sf)))


@query(_products_sql(_last_sql("true")))
def mv_products_full(spark: SparkSession, sf: str) -> DataFrame:
    return views.product_sales(_last(_orders(spark, sf)))


_MERGED = f"select n.* from ({_last_sql(_NEW)}) n union all by name select o.* from ({_last_sql(_OLD)}) o where o.id_order not in (select id_order from ({_last_sql(_NEW)}))"


def _incremental(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """The view of the store, brought up to date by the keys of what arrived; its twin computes it anew."""
    orders = _orders(spark, sf)
    old, new = _last(orders.where(_OLD)), _last(orders.where(_NEW))
    merged = old.join(new.select("id_order"), "id_order", "left_anti").unionByName(new)
    affected = views.affected_keys(new, views._keys(old), views.VIEWS[name])
    view = (views.daily_sales if name.startswith("daily") else views.product_sales)(old)
    return views.incremental(view, merged, affected, name)


@query(_daily_sql(_MERGED))
def mv_daily_incremental(spark: SparkSession, sf: str) -> DataFrame:
    return _incremental(spark, sf, "daily_sales_summary")


@query(_products_sql(_MERGED))
def mv_products_incremental(spark: SparkSession, sf: str) -> DataFrame:
    return _incremental(spark, sf, "top_products_summary")


@query("select date_trunc('day', ts) as window_start, event_type, count(*) as n, round_even(sum(value), 2) as total from events group by 1, 2")
def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    found = windowed(table(spark, sf, "events"), "ts", "1 day", by=("event_type",))
    return found.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.bround("total", 2).alias("total"))
