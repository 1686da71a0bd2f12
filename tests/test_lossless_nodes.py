"""Problem 6: the rows of a record make the record again."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import DATA

from millrace.operators.nested import array_keys, assembled, nodes, payload_text, visit
from millrace.operators.nested import _steps as steps_text
from millrace.operators.rejects import Number, parse_array

TEXTS = [
    "[]",
    "[[], [[]], {}]",
    '[{"bundle": {"label": "x", "parts": [1, 2.50, "2.50"], "in": {"a": {}}}, "gift": {"to": null}}]',
    '[{"n": 12345678901234567890.12, "m": 1e400, "o": -0, "p": [1E5, true]}]',
    '[{"a.b": [1], "a": {"b": [2]}, "[0]": [{}], "": [{"": [3]}]}]',
    '[{"serials": ["A1", "A2"], "discounts": [0.10]}, "loose", 7, null]',
    '[{"bundle": {"parts": {"sku": 1}}}, {"parts": [{"sku": 2}, 3]}]',
    '[{"bad": "\\ud800", "\\udc00k": [{"x": "\\u0000"}]}]',
]


def again(text: str):
    found, keys = parse_array(text, True), set()
    array_keys(found, keys)
    rows = [(kind, parent, path, steps_text(steps), None if kind == "empty" else payload_text(v, keys)) for _, kind, path, parent, steps, v in visit(found, "items", keys, True)]
    return found, assembled(rows)


def typed(value):
    """A value whose numbers do not equal the strings that look like them."""
    if isinstance(value, (list, dict)):
        return [typed(v) for v in value] if isinstance(value, list) else {k: typed(v) for k, v in value.items()}
    return ("number", str(value)) if isinstance(value, Number) else value


@pytest.mark.parametrize("text", TEXTS)
def test_round_trip(text):
    found, made = again(text)
    assert typed(made) == typed(found)


plain = st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=4)
values = st.recursive(plain, lambda x: st.lists(x, max_size=4) | st.dictionaries(st.sampled_from(["a", "b", "c.d", "e[0]", ""]), x, max_size=4), max_leaves=30)


@settings(max_examples=400, deadline=None)
@given(st.lists(values, max_size=4))
def test_any_array(value):
    found, made = again(json.dumps(value))
    assert typed(made) == typed(found)


def test_numbers_as_written(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "loader_id long, items string")
    found = {r.node_path: r.payload for r in nodes(df.where("loader_id = 3")).collect()}
    assert found == {"items[0]": '{"n": 12345678901234567890.12, "m": 1e400, "o": -0}', "items[0].p[0]": "1E5", "items[0].p[1]": "true"}
    by: dict = {}
    for r in nodes(df).collect():
        by.setdefault(r.loader_id, []).append((r.kind, r.parent_path, r.node_path, r.steps, r.payload))
    for i, text in enumerate(TEXTS):
        if "ud800" not in text:
            assert typed(assembled(by[i])) == typed(parse_array(text, True))


def test_depth(spark):
    deep = 100_000
    df = spark.createDataFrame([(1, "[" * deep + '{"k": 1}' + "]" * deep)], "loader_id long, items string")
    (row,) = nodes(df).collect()
    assert row.node_path == "items" + "[0]" * deep and row.payload == '{"k": 1}' and row.parent_path == ""
    assert nodes(df, payload=False).count() == 1


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_every_row_of_a_table(spark):
    df = spark.read.parquet(str(DATA.parent / "sf0.01" / "spark_loader.parquet")).select("loader_id", "items")
    by: dict = {}
    for r in nodes(df).collect():
        by.setdefault(r.loader_id, []).append((r.kind, r.parent_path, r.node_path, r.steps, r.payload))
    loadable = 0
    for r in df.collect():
        found = parse_array(r["items"], True) if r["items"] else None
        if found is not None:
            loadable += 1
            assert typed(assembled(by[r["loader_id"]])) == typed(found)
    assert loadable > 8_000
