"""The queries of problems 1, 4, 5, 6 and 7 over the test tables, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.nested import nodes
from millrace.operators.redelivery import redelivered
from millrace.operators.rejects import ORDER_FIELDS, load_records, loaded, rejected
from millrace.operators.timestamps import utc_instants
from millrace.operators.units import identity_scales, in_hundredths
from millrace.session import small, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redelivered(table(spark, sf_dir, "test_duplicate_orders"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return utc_instants(table(spark, sf_dir, "test_duplicate_orders"), table(spark, sf_dir, "channels"))


#: ISO 8601 with seconds and a zone.
_ZONED = "^[0-9]{4}-[0-9]{2}-[0-9]{2}T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]([.][0-9]{1,6})?(Z|[+-][01][0-9]:[0-5][0-9])$"


def p4_zoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The instants of p4_found that are written in ISO 8601 with a zone."""
    rows = table(spark, sf_dir, "test_duplicate_orders").where(F.col("order_date").rlike(_ZONED))
    return utc_instants(rows, table(spark, sf_dir, "channels"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        ("spark_loader", rejected(table(spark, sf_dir, "spark_loader"), "loader_id", "items", "items_json")),
        ("test_duplicate_orders", rejected(table(spark, sf_dir, "test_duplicate_orders"), "delivery_id", "total_amount", "amount")),
        ("raw_lines", rejected(table(spark, sf_dir, "raw_lines"), "raw_id", "line_text", "record")),
    ]
    first, *rest = [df.toDF("row_id", "reason").select(F.lit(src).alias("src"), "row_id", "reason") for src, df in parts]
    for df in rest:
        first = first.unionAll(df)
    return first


def p5_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of the three tables: (src, row_id) and the fields of each row that loads; those that a table does not have are null."""
    lines = load_records(table(spark, sf_dir, "raw_lines")).where("reason is null").drop("reason").withColumnRenamed("raw_id", "row_id")
    orders = loaded(table(spark, sf_dir, "spark_loader").select("loader_id", *ORDER_FIELDS), "loader_id", "items", "items_json").withColumnRenamed("loader_id", "row_id")
    sent = table(spark, sf_dir, "test_duplicate_orders")
    sent = loaded(sent.select("delivery_id", *[c for c in ORDER_FIELDS if c in sent.columns]), "delivery_id", "total_amount", "amount").withColumnRenamed("delivery_id", "row_id")
    parts = [df.withColumn("src", F.lit(src)) for src, df in (("raw_lines", lines), ("spark_loader", orders), ("test_duplicate_orders", sent))]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2], allowMissingColumns=True)
    return both.select("src", "row_id", *ORDER_FIELDS)


def p5_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of p5_found whose structure is at fault, not an amount."""
    return p5_found(spark, sf_dir).where("reason <> 'amount'")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(table(spark, sf_dir, "spark_loader"), payload=False).select("loader_id", "parent_path", "node_path")


def p6_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All flat tables of items with their payload: tag, keys of row and parent, members as JSON text."""
    return nodes(table(spark, sf_dir, "spark_loader"))


def p6_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers of nodes of each table and kind: objects, single objects, plain values, empty arrays."""
    return nodes(table(spark, sf_dir, "spark_loader")).groupBy("tag", "kind").agg(F.count("*").alias("nodes"))


def _amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    currencies = table(spark, sf_dir, "ref_currency")
    one = in_hundredths(table(spark, sf_dir, "test_duplicate_orders"), currencies, "delivery_id", channels=table(spark, sf_dir, "channels"))
    two = in_hundredths(table(spark, sf_dir, "spark_loader"), currencies, "loader_id", currency="currency")
    both = [df.toDF("row_id", "yer_hundredths", "how").withColumn("src", F.lit(src)) for src, df in (("test_duplicate_orders", one), ("spark_loader", two))]
    return both[0].unionAll(both[1])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _amounts(spark, sf_dir).where("yer_hundredths is not null").select("src", "row_id", "yer_hundredths")


_PLAIN = "^[0-9]{1,12}([.][0-9]{1,6})?$"


def p7_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The amounts of p7_found that are plain figures with a currency's code: all rows are converted, then those that the SQL names are taken."""
    currencies = table(spark, sf_dir, "ref_currency")
    amounts = in_hundredths(table(spark, sf_dir, "spark_loader"), currencies, "loader_id", currency="currency", keep=("total_amount", "currency"))
    plain = F.col("total_amount").rlike(_PLAIN.removesuffix("$") + r"\z")  # in Java $ also stands before a last line break
    coded = amounts.where(plain).join(small(currencies.select("currency_code")), F.col("currency") == F.col("currency_code"))
    return coded.where("yer_hundredths is not null").select("loader_id", "yer_hundredths")


def p7_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scale of each order's amount by the identity amount = lines + delivery, with its residual and whether it is the only one."""
    return identity_scales(table(spark, sf_dir, "spark_loader"))


QUERIES = {f.__name__: f for f in (p1_found, p4_found, p4_zoned, p5_found, p5_structure, p5_loaded, p6_found, p6_tables, p6_kinds, p7_found, p7_plain, p7_scales)}

_EDGE = r"[\p{Z}\p{Cc}\p{Cf}]+"
#: Whether items is the text of a JSON array. DuckDB also takes a comma before a closing bracket and NaN, which RFC 8259 does not.
BARE = r"""regexp_replace(items, '"(\\.|[^"\\])*"', '""', 'g')"""
SAFE = "case when json_valid(items) then items else 'null' end"
IS_ARRAY = rf"""(json_valid(items) and json_type({SAFE}) = 'ARRAY' and not regexp_matches({BARE}, ',\s*[\]}}]')
        and not regexp_matches(regexp_replace({BARE}, 'true|false|null|[0-9][eE]', '', 'g'), '[A-Za-z/]'))"""
_FIELD = r"""(?s)(?:"(?:[^"]|"")*"|[^",\r\n]*)"""
SQL = {
    "p4_zoned": f"""
        select delivery_id, epoch_us(try_cast(order_date as timestamptz)) as utc_us from test_duplicate_orders
        where regexp_matches(order_date, '{_ZONED}') and try_cast(order_date as timestamptz) is not null""",
    "p7_plain": f"""
        select loader_id, cast(total_amount::decimal(20, 6) * yer_per_unit * 100 as bigint) as yer_hundredths from spark_loader join ref_currency on currency = currency_code
        where regexp_matches(total_amount, '{_PLAIN}') and (total_amount::decimal(20, 6) * yer_per_unit * 100) % 1 = 0""",
    "p5_structure": rf"""
        with ended as (select raw_id, coalesce(line_text, '') as t from raw_lines),
        bare as (select raw_id, case when ends_with(t, chr(10)) then t[:-2] else t end as t from ended),
        lines as (select raw_id, case when ends_with(t, chr(13)) then t[:-2] else t end as t from bare),
        cut as (select raw_id, regexp_full_match(t, '{_FIELD}(?:,{_FIELD})*') as fits, regexp_extract_all(',' || t, ',({_FIELD})', 1) as fields from lines),
        texts as (select raw_id, fits, len(fields) as n, case when starts_with(fields[10], '"') then replace(fields[10][2:-2], '""', '"') else fields[10] end as items from cut),
        told as (
            select raw_id, case when not fits then 'quoting' when n <> 16 then 'column_count'
                when regexp_replace(items, '^{_EDGE}|{_EDGE}$', '', 'g') <> '' and not {IS_ARRAY} then 'items_json' end as reason from texts)
        select 'raw_lines' as src, raw_id as row_id, reason from told where reason is not null
        union all select 'spark_loader', loader_id, 'items_json' from spark_loader where regexp_replace(items, '^{_EDGE}|{_EDGE}$', '', 'g') <> '' and not {IS_ARRAY}""",
    "p6_kinds": rf"""
        with recursive texts as (
            select loader_id, ({SAFE})::json as v from spark_loader where regexp_replace(items, '^{_EDGE}|{_EDGE}$', '', 'g') <> '' and {IS_ARRAY}),
        lists as (select distinct t.key as k from texts, json_tree(texts.v) t where t.type = 'ARRAY' and t.key is not null and t.fullkey not like '%]'),
        walk as (
            select v, 'ARRAY' as type, 'items' as tag, case when json_array_length(v) = 0 then 'empty' end as kind from texts
            union all
            select c.value, c.type, case when w.type = 'ARRAY' then w.tag else w.tag || '.' || c.key end,
                   case when c.type = 'ARRAY' then case when json_array_length(c.value) = 0 then 'empty' end
                        when w.type = 'ARRAY' then case when c.type = 'OBJECT' then 'object' else 'value' end
                        when c.key in (select k from lists) then 'single' end
            from walk w, json_each(w.v) c where w.type in ('ARRAY', 'OBJECT') and (w.type = 'ARRAY' or c.type in ('ARRAY', 'OBJECT')))
        select tag, kind, count(*) as nodes from walk where kind is not null group by 1, 2""",
    "p6_found": rf"""
        with recursive texts as (
            select loader_id, ({SAFE})::json as v from spark_loader where regexp_replace(items, '^{_EDGE}|{_EDGE}$', '', 'g') <> '' and {IS_ARRAY}),
        lists as (select distinct t.key as k from texts, json_tree(texts.v) t where t.type = 'ARRAY' and t.key is not null and t.fullkey not like '%]'),
        walk as (
            select loader_id, v, 'items' as node_path, '' as parent_path, false as node from texts
            union all
            select w.loader_id, c.value,
                   case when json_type(w.v) = 'ARRAY' then w.node_path || '[' || c.key || ']'
                        when c.type = 'OBJECT' and c.key in (select k from lists) then w.node_path || '.' || c.key || '[0]'
                        else w.node_path || '.' || c.key end,
                   case when w.node then w.node_path else w.parent_path end,
                   c.type = 'OBJECT' and (json_type(w.v) = 'ARRAY' or c.key in (select k from lists))
            from walk w, json_each(w.v) c where c.type in ('ARRAY', 'OBJECT'))
        select loader_id, parent_path, node_path from walk where node""",
    "p1_found": rf"""
        with keyed as (
            select delivery_id, received_at,
                   upper(translate(regexp_replace(id_order, '^{_EDGE}|{_EDGE}$', '', 'g'), '٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹', '01234567890123456789')) as k
            from test_duplicate_orders),
        ranked as (
            select delivery_id, row_number() over (partition by k order by received_at nulls last, delivery_id) as n
            from keyed where k <> '')
        select delivery_id from ranked where n > 1""",
}
