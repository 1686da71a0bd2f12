"""Problem 6: deeply nested records as flat tables that keep parent-child links.

A depth-first visitor passes each record once and emits (tag, kind, parent_path, node_path, steps, payload): the tag names the table, the
path within the record is the primary key. Keys that hold an array anywhere are found first, over all records, so that a single object
under such a key counts as element 0 of that array. Nothing is lost on the way: assembled() makes the record from its rows again.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from json.encoder import encode_basestring

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import is_blank
from millrace.operators.rejects import Number, parse_array
from millrace.session import SMALL_ROWS, cut, is_small

#: Characters of paths and payloads in one batch of results: the paths of a deep row are long.
PATHS = 32_000_000
#: Kinds of rows: an object in an array, one under a key that elsewhere holds an array, a plain value in an array, an array without elements.
OBJECT, SINGLE, VALUE, EMPTY = "object", "single", "value", "empty"
_SURROGATE = re.compile("[\ud800-\udfff]")


def array_keys(found: list, keys: set[str]) -> None:
    """Add the names of all keys under which a list stands."""
    stack: list = [found]
    while stack:
        x = stack.pop()
        if isinstance(x, dict):
            for k, v in x.items():
                if isinstance(v, list):
                    keys.add(k)
                    stack.append(v)
                elif isinstance(v, dict):
                    stack.append(v)
        else:
            stack.extend(v for v in x if isinstance(v, (dict, list)))


def _joined(path: str | tuple) -> str:
    """The text of a path: a text, or a pair of what comes before and the last piece."""
    pieces = []
    while not isinstance(path, str):
        path, piece = path
        pieces.append(piece)
    return path + "".join(reversed(pieces)) if pieces else path


def _steps(steps: tuple | None) -> str:
    """Keys and positions from the parent on as a JSON array."""
    pieces = []
    while steps is not None:
        steps, piece = steps
        pieces.append(str(piece) if isinstance(piece, int) else encode_basestring(piece))
    return "[" + ",".join(reversed(pieces)) + "]"


def visit(found: list, root: str, keys: set[str], whole: bool = False) -> Iterator[tuple]:
    """(tag, kind, node path, parent path, steps, value) of each object that is an array's element, parents before children.

    With whole, of plain elements of arrays and of empty arrays too. Steps lead from the parent to the node, whatever characters its keys have.
    """
    # (value, path, tag, parent, steps, kind): a list's elements and an object's members inherit what encloses them; kind is set for elements
    stack: list[tuple] = [(found, root, root, "", None, None)]
    while stack:
        value, path, tag, parent, steps, kind = stack.pop()
        if isinstance(value, list):
            if whole and not value:
                yield _joined(tag), EMPTY, _joined(path), parent, steps, None
            for i in range(len(value) - 1, -1, -1):
                v = value[i]
                if isinstance(v, dict):
                    stack.append((v, (path, f"[{i}]"), tag, parent, (steps, i), OBJECT))
                elif isinstance(v, list):
                    stack.append((v, (path, f"[{i}]"), tag, parent, (steps, i), None))
                elif whole:
                    stack.append((v, (path, f"[{i}]"), tag, parent, (steps, i), VALUE))
            continue
        if kind is not None:  # an element
            path, tag = _joined(path), _joined(tag)
            yield tag, kind, path, parent, steps, value
            if kind == VALUE:
                continue
            parent, steps = path, None
        below = []
        for k, v in value.items():
            if isinstance(v, list):
                below.append((v, (path, f".{k}"), (tag, f".{k}"), parent, (steps, k), None))
            elif isinstance(v, dict):
                if k in keys:
                    below.append((v, (path, f".{k}[0]"), (tag, f".{k}"), parent, (steps, k), SINGLE))
                else:
                    below.append((v, (path, f".{k}"), (tag, f".{k}"), parent, (steps, k), None))
        stack.extend(reversed(below))


def _scalar(v: object) -> str:
    if isinstance(v, str):
        return v if isinstance(v, Number) else encode_basestring(v)
    return "null" if v is None else "true" if v else "false"


def payload_text(value: object, keys: set[str]) -> str:
    """The JSON text of a plain value, or of an object with all that belongs to no other row: its plain members and the plain objects in it."""
    if not isinstance(value, dict):
        return _scalar(value)
    out: list[str] = []
    stack: list = [value]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        pieces: list = []
        for k, v in x.items():
            if isinstance(v, list) or (isinstance(v, dict) and k in keys):
                continue
            pieces += [", " if pieces else "{", encode_basestring(k), ": "]
            pieces.append(v if isinstance(v, dict) else _scalar(v))
        pieces.append("}" if pieces else "{}")
        stack.extend(reversed(pieces))
    return "".join(out)


def assembled(rows: Iterable[tuple[str, str, str, str, str | None]]) -> list:
    """The record that (kind, parent path, node path, steps, payload) of all its nodes come from, numbers as Number."""
    decode = json.JSONDecoder(parse_float=Number, parse_int=Number).decode
    root: list = []
    made: dict[str, object] = {"": root}
    waiting: dict[str, list[tuple[str, str, str, str | None]]] = {}
    for kind, parent, path, steps, text in rows:
        waiting.setdefault(parent, []).append((kind, path, steps, text))
    todo = [""]
    while todo:
        at = todo.pop()
        for kind, path, steps, text in waiting.get(at, ()):
            value = [] if kind == EMPTY else decode(text)
            place, trail = made[at], json.loads(steps)
            if not trail:  # an empty record
                continue
            for step, then in zip(trail, [*trail[1:], None]):
                inside = value if then is None else [] if isinstance(then, int) else {}
                if isinstance(place, list):
                    place.extend([None] * (step + 1 - len(place)))
                    if then is None or place[step] is None:
                        place[step] = inside
                elif then is None or step not in place:
                    place[step] = inside
                place = place[step]
            if kind in (OBJECT, SINGLE):
                made[path] = value
                todo.append(path)
    return root


def _keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys: set[str] = set()
    for batch in batches:
        for text in batch.column("text").to_pylist():
            if not is_blank(text) and (found := parse_array(text)) is not None:
                array_keys(found, keys)
    yield pa.RecordBatch.from_arrays([pa.array(sorted(map(_sound, keys)), pa.string())], names=["key"])


def _object_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys of each row under which an object stands."""
    for batch in batches:
        ids, names = [], []
        for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist()):
            stack: list = [] if is_blank(text) else [parse_array(text) or []]
            keys = set()
            while stack:
                x = stack.pop()
                if isinstance(x, dict):
                    keys.update(_sound(k) for k, v in x.items() if isinstance(v, dict))
                stack.extend(v for v in (x.values() if isinstance(x, dict) else x) if isinstance(v, (dict, list)))
            ids += [row] * len(keys)
            names += keys
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.string())], names=["row", "key"])


def _sound(text: str | None) -> str | None:
    """Half of a surrogate pair, which a JSON escape can hold but UTF-8 cannot, as that escape."""
    return text if text is None or text.isascii() or not _SURROGATE.search(text) else _SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def _strings(values: list) -> pa.Array:
    try:
        return pa.array(values, pa.string())
    except UnicodeEncodeError:
        return pa.array(map(_sound, values), pa.string())


def nodes(df: DataFrame, row_id: str = "loader_id", text: str = "items", payload: bool = True, most_keys: int = SMALL_ROWS) -> DataFrame:
    """The nodes of each row's JSON array: without payload (row_id, tag, parent_path, node_path) of each object that is an array's element at any depth.

    With payload (row_id, tag, kind, parent_path, node_path, steps, payload) of all that makes up the array: such objects (kind object, or
    single under a key that elsewhere holds an array), plain elements of arrays (value) and arrays without elements (empty). The payload
    of an object holds its plain members and the plain objects in it as JSON text, numbers as written; steps leads from the parent to
    the node by keys and positions. Null and blank texts and those that are no JSON array give nothing. An array nested in an array
    adds its position to the path. Of a key that an object has twice the last counts, as in most readers. Half a surrogate pair stays
    an escape. Up to most_keys keys that hold arrays are told to every task, more are joined to the rows. An empty table gives an empty
    result; other columns are not looked at.
    """
    rows = df.select(F.col(row_id).cast("long").alias("row"), F.col(text).cast("string").alias("text"))
    names = cut(rows.mapInArrow(_keys_of, "key string").distinct())
    told = is_small(names, most_keys)
    shared = {r["key"] for r in names.collect()} if told else set()
    if not told:
        # keys that are data: each row gets those of its own that hold an array somewhere
        own = rows.mapInArrow(_object_keys, "row long, key string").distinct().join(names, "key", "left_semi")
        rows = rows.join(own.groupBy("row").agg(F.collect_list("key").alias("keys")), "row", "left").select("row", "text", "keys")
    columns = ["tag", *["kind"] * payload, "parent_path", "node_path", *["steps", "payload"] * payload]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids: list[int] = []
            out: dict[str, list] = {c: [] for c in columns}
            size = 0

            def full() -> pa.RecordBatch:
                arrays = [pa.array(ids, pa.int64()), *map(_strings, out.values())]
                for x in (ids, *out.values()):
                    x.clear()
                return pa.RecordBatch.from_arrays(arrays, names=["row", *columns])

            own_keys = [shared] * batch.num_rows if told else [set(k or ()) for k in batch.column("keys").to_pylist()]
            for row, value, keys in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), own_keys):
                if is_blank(value) or (found := parse_array(value, payload)) is None:
                    continue
                for tag, kind, path, parent, steps, node in visit(found, text, keys, payload):
                    ids.append(row)
                    out["tag"].append(tag)
                    out["parent_path"].append(parent)
                    out["node_path"].append(path)
                    size += len(path)
                    if payload:
                        load = None if kind == EMPTY else payload_text(node, keys)
                        out["kind"].append(kind)
                        out["steps"].append(_steps(steps))
                        out["payload"].append(load)
                        size += len(load or "")
                    if size > PATHS:
                        yield full()
                        size = 0
            yield full()

    return rows.mapInArrow(run, "row long, " + ", ".join(f"{c} string" for c in columns)).withColumnRenamed("row", row_id)


def write_tables(found: DataFrame, path: str) -> None:
    """All tables in one pass, a folder for each tag."""
    found.write.mode("overwrite").partitionBy("tag").parquet(path)


def read_table(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """The objects of one of the written tables with the schema of its payload applied."""
    rows = spark.read.parquet(path).where((F.col("tag") == tag) & F.col("kind").isin(OBJECT, SINGLE))
    return rows.withColumn("_at", F.from_json("payload", schema)).select(*[c for c in rows.columns if c not in ("payload", "tag")], "_at.*")
