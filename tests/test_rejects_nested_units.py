import csv
import io
import json
from fractions import Fraction

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.functions.amounts import read_amount
from millrace.operators.nested import array_keys, nodes, read_table, visit, write_tables
from millrace.operators.rejects import Index, is_json_array, load_records, record_reasons, rejected
from millrace.operators.units import hundredths, identity_scales, in_hundredths, resolve, unit_table

CURRENCIES = [
    dict(currency_code=c, name_en=e, name_ar=a, minor_name=m, minor_per_unit=100, yer_per_unit=y)
    for c, e, a, m, y in (("YER", "Yemeni rial", "ريال يمني", "fils", 1), ("USD", "US dollar", "دولار أمريكي", "cent", 531), ("SAR", "Saudi riyal", "ريال سعودي", "halala", 141), ("EUR", "Euro", "يورو", "cent", 587), ("AED", "UAE dirham", "درهم إماراتي", "fils", 145))
]


def strict(text):
    """RFC 4180, one character at a time."""
    text = text[:-1] if text.endswith("\n") else text
    text = text[:-1] if text.endswith("\r") else text
    fields, i = [], 0
    while True:
        if text[i : i + 1] == '"':
            i, value = i + 1, ""
            while True:
                if i >= len(text):
                    return None
                if text[i : i + 2] == '""':
                    value, i = value + '"', i + 2
                elif text[i] == '"':
                    i += 1
                    break
                else:
                    value, i = value + text[i], i + 1
            fields.append(value)
        else:
            start = i
            while i < len(text) and text[i] not in ',"\r\n':
                i += 1
            if i < len(text) and text[i] != ",":
                return None
            fields.append(text[start:i])
        if i >= len(text):
            return fields
        if text[i] != ",":
            return None
        i += 1


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet='a,"\n\ré', max_size=14), max_size=6))
def test_structure_against_a_state_machine(texts):
    index = Index(pa.array(texts, pa.string()))
    for row, text in enumerate(texts):
        fields = strict(text)
        assert bool(index.well_formed[row]) == (fields is not None), text
        if fields is not None:
            assert [index.field(row, k) for k in range(int(index.fields[row]))] == fields


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=9), min_size=16, max_size=16))
def test_written_records_load(fields):
    line = io.StringIO()
    csv.writer(line, quoting=csv.QUOTE_ALL).writerow(fields)
    index = Index(pa.array([line.getvalue()]))
    assert index.well_formed[0] and [index.field(0, k) for k in range(16)] == fields


def record(items="", amount=""):
    fields = ["x"] * 16
    fields[9], fields[13] = items, amount
    line = io.StringIO()
    csv.writer(line).writerow(fields)
    return line.getvalue().rstrip("\r\n")


def test_first_reason_counts():
    texts = [record(), record("[]", "5"), record("{}", "x"), record("[1,]"), record("[]", "N/A"), "a,b", "", None, 'a"b' + "," * 15, record("[]", " "), "x" * 200_000]
    assert record_reasons(pa.array(texts)) == [None, None, "items_json", "items_json", "amount", "column_count", "column_count", "column_count", "quoting", None, "column_count"]


@pytest.mark.parametrize("text, good", [("[]", True), (" [1, {\"a\": null}]\n", True), ("[NaN]", False), ("{}", False), ("[1] x", False), ("[1,]", False), ("﻿[]", False), ('["a\nb"]', False), ("[01]", False), ("[" * 5000 + "]" * 5000, True), ("[" * 5000 + "]" * 4999, False), ("[" + "9" * 6000 + "]", True), ("['a']", False)])
def test_json(text, good):
    assert is_json_array(text) == good


def test_load_records(spark):
    df = spark.createDataFrame([(1, record("[]", "7"), 0), (2, "bad", 0), (2, "bad", 0), (3, None, 0)], "raw_id long, line_text string, reason int")
    out = {r.raw_id: r for r in load_records(df).collect()}
    assert out[1].reason is None and out[1].total_amount == "7" and out[2].reason == "column_count" and out[3].reason == "column_count"
    assert rejected(df, "raw_id", "line_text", "record").count() == 3
    assert rejected(df.limit(0), "raw_id", "line_text", "record").count() == 0


DOC = [
    {"a": [{"b": 1}, 5, {"c": {"d": [{"e": 2}]}}]},
    None,
    {"a": {"b": 3, "d": {"x": 1}}, "g": {"to": 1, "d": []}},
    [[{"z": 1}]],
]


def test_visit():
    keys = set()
    array_keys(DOC, keys)
    assert keys == {"a", "d"}
    assert [(p, n) for _, _, n, p, _, _ in visit(DOC, "items", keys)] == [
        ("", "items[0]"), ("items[0]", "items[0].a[0]"), ("items[0]", "items[0].a[2]"), ("items[0].a[2]", "items[0].a[2].c.d[0]"),
        ("", "items[2]"), ("items[2]", "items[2].a[0]"), ("items[2].a[0]", "items[2].a[0].d[0]"), ("", "items[3][0][0]"),
    ]


def test_nodes_and_tables(spark, tmp_path):
    rows = [(1, json.dumps(DOC), "k"), (2, "", "k"), (3, None, "k"), (4, "[{]", "k"), (5, '[{"b": 1.5}]', "k"), (5, '[{"b": 1.5}]', "k"), (6, "[" * 3000 + "]" * 3000, "k")]
    df = spark.createDataFrame(rows, "loader_id long, items string, tag string")
    out = nodes(df)
    assert nodes(df, payload=False).groupBy("loader_id").count().orderBy("loader_id").collect() == [(1, 8), (5, 2)]
    assert out.where("kind in ('object', 'single')").groupBy("loader_id").count().orderBy("loader_id").collect() == [(1, 8), (5, 2)]
    assert out.where("kind not in ('object', 'single')").groupBy("loader_id", "kind").count().orderBy("loader_id", "kind").collect() == [(1, "empty", 1), (1, "value", 2), (6, "empty", 1)]
    write_tables(out, str(tmp_path / "t"))
    assert [r.b for r in read_table(spark, str(tmp_path / "t"), "items.a", "b int").orderBy("node_path").collect()] == [1, None, 3]
    assert nodes(df.limit(0)).count() == 0
    joined = nodes(df, most_keys=0)
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, out.collect()))


@pytest.mark.parametrize("text, value, unit", [("3835.50", "3835.5", ""), ("٢٬٤٨٦٫٢٥", "2486.25", ""), ("2.141,25", "2141.25", ""), ("43,081.00", "43081", ""), ("2,632", "2632", ""), ("1 263.25", "1263.25", ""), ("+1425", "1425", ""), (" 5139\t", "5139", ""), ("عشرة آلاف ريال", "10000", "ريال"), ("one hundred dollars", "100", "dollars"), ("مئة ألف ريال يمني", "100000", "رياليمني"), ("ألفين ريال", "2000", "ريال"), ("two hundred and five dirhams", "205", "dirhams")])
def test_amounts(text, value, unit):
    found = read_amount(text)
    assert found is not None and found.value == Fraction(value) and found.unit == unit


@pytest.mark.parametrize("text", ["48..24", "70970-3-", "24x668y", "8o27360", "1S78960", "7l02150", "602.65.94,1", "1687 / 2187", "52486 or 52986", "9272 ~ 9772", "95414 أو 95914", "--", "null", "N/A", "#REF!", "ريال", "USD", "?", "12,34", "1.234.567", "x" * 100_000])
def test_no_amount(text):
    assert read_amount(text) is None


TABLE = unit_table(CURRENCIES)


@pytest.mark.parametrize("text, expected", [("32.15 k SAR", 453315000), ("141362 فلس يمني", 141362), ("554,141 سنت أمريكي", 554141 * 531), ("YER 1.7k", 170000), ("0.3 million SAR", 300000 * 14100), ("4.8 YER '000", 480000), ("1.55Kريال", 155000), ("ألف درهم", 1000 * 14500), ("564286 halalas (SAR)", 564286 * 141), ("$ 2.394,75", 239475 * 531), ("2.5 kEUR", 2500 * 58700), ("5 fils", None), ("5 XYZ", None), ("two thousand rials YER", 200000), ("14.60", 1460), ("1 cent", None)])
def test_units(text, expected):
    assert hundredths(text, None, TABLE, ("YER", Fraction(100)), False)[0] == expected


def test_unit_columns(spark):
    rows = spark.createDataFrame([(1, "5", "ري ال"), (2, "5", "Yemeni rial،"), (3, "5", None), (4, None, "USD"), (5, "5", "QQD"), (6, "5,000.10", "k YER"), (6, "5,000.10", "k YER")], "id long, total_amount string, currency string")
    table = spark.createDataFrame(CURRENCIES)
    out = sorted((r.id, r.yer_hundredths) for r in in_hundredths(rows, table, "id", currency="currency").where("yer_hundredths is not null").collect())
    assert out == [(1, 500), (2, 500), (6, 500010000), (6, 500010000)]
    assert in_hundredths(rows.limit(0), table, "id", currency="currency").count() == 0
    channels = spark.createDataFrame([("bulk", "YER", "1000.00")], "channel string, currency_code string, amount_scale string").selectExpr("channel", "currency_code", "cast(amount_scale as decimal(12,2)) amount_scale")
    sent = spark.createDataFrame([(1, "14.60", "bulk"), (2, "14.60", None), (3, "14.60 USD", None), (4, "1", "none")], "id long, total_amount string, channel string")
    assert sorted((r.id, r.yer_hundredths) for r in in_hundredths(sent, table, "id", channels=channels).where("yer_hundredths is not null").collect()) == [(1, 1460000), (3, 775260)]


def test_identities_choose_units():
    # 12 kg of something of 0.8 kg/l in 15 l, the mass in g or kg
    assert resolve([(0.8, [1.0]), (15.0, [1.0]), (1 / 12000, [1.0, 1000.0])], 1.0) == ((0, 0, 1), True)
    assert resolve([(2.0, [1.0, 1.0])], 2.0)[1] is False


def test_scales_by_identity(spark):
    lines = '[{"qty": 2, "unit_price": 500}, {"total": "1,500"}]'
    rows = [(1, "2500", lines, None), (2, "250000", lines, ""), (3, "2.6", lines, "100"), (4, "3000", lines, None), (5, None, lines, None), (6, "5", "[]", None), (7, "5", "bad", None), (8, "5", '[{"sku": "x"}]', None), (9, "5", lines, "free")]
    df = spark.createDataFrame(rows, "loader_id long, total_amount string, items string, delivery_cost string")
    assert {r.loader_id: (r.factor, r.is_unique) for r in identity_scales(df).collect()} == {1: (1.0, True), 2: (0.01, True), 3: (1000.0, True), 4: (1.0, False)}
    assert identity_scales(df.limit(0)).count() == 0
