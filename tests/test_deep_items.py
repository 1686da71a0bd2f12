import json

from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.operators.nested import nodes
from millrace.operators.rejects import _as_written, _deep_array, is_json_array, parse_array, rejected

DEEP = 12_000
ROWS = [
    (1, '[{"a":' * DEEP + '[{"sku":"x","n":1}]' + "}]" * DEEP),
    (2, "[" * DEEP + '{"k":{"b":[{}]},"big":' + "9" * 5000 + "}" + "]" * DEEP),
    (3, "[" * DEEP + "}" * DEEP),
]


def test_rows_that_load_are_flattened_at_any_depth(spark):
    df = spark.createDataFrame([*ROWS, (4, '[{"k":{"b":1}}]')], "loader_id long, items string")
    assert [r.loader_id for r in rejected(df, "loader_id", "items", "items_json").collect()] == [3]
    for payload in (False, True):
        found = nodes(df.where("loader_id <> 1"), payload=payload).collect()
        deep = "items" + "[0]" * DEEP
        assert sorted((r.loader_id, r.parent_path, r.node_path) for r in found if not payload or r.kind != "empty") == [(2, "", deep), (2, deep, deep + ".k.b[0]"), (4, "", "items[0]")]


def test_every_level_of_a_deep_chain(spark):
    depth = 5_000
    df = spark.createDataFrame([(1, '[{"a":' * depth + "[]" + "}]" * depth)], "loader_id long, items string")
    found = nodes(df, payload=False)
    levels = "length({0}) - length(replace({0}, '[0]', '12'))"
    assert found.count() == depth and found.where(f"{levels.format('node_path')} = {levels.format('parent_path')} + 1").count() == depth


def test_deep_chain_of_objects():
    found, depth = parse_array(ROWS[0][1]), 0
    while isinstance(found[0].get("a"), list):
        found, depth = found[0]["a"], depth + 1
    assert depth == DEEP and found == [{"sku": "x", "n": "1"}] and is_json_array(ROWS[0][1]) and parse_array(ROWS[2][1]) is None


json_values = st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=5), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=3), x, max_size=4), max_leaves=20)


@settings(max_examples=300, deadline=None)
@given(st.lists(json_values, max_size=4), st.integers(0, 60), st.sampled_from(["", ",", "]", "}", ":", '"']))
def test_scanner_against_the_decoder(value, at, put):
    text = json.dumps(value, ensure_ascii=False)
    text = text[: at % (len(text) + 1)] + put + text[at % (len(text) + 1) :]
    try:
        want = _as_written.decode(text)
    except ValueError:
        want = None
    assert _deep_array(text, _as_written) == (want if isinstance(want, list) else None)
