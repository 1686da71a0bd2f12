"""Problem 5: rows that fail to parse, set apart with a reason.

A batch of records is one byte buffer. Quote masks and their prefix parity give the delimiters of all its records at once; counts
and type checks then make each record valid or a reject with the first reason that applies.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.amounts import read_amount
from millrace.functions.schema import LAYOUTS
from millrace.functions.text import is_blank

#: The 16 fields of a raw order record.
ORDER_FIELDS = list(LAYOUTS[0])


def _no_constant(name: str) -> None:
    raise ValueError(name)


class Number(str):
    """A JSON number as it was written."""

    __slots__ = ()


_decoder = json.JSONDecoder(parse_constant=_no_constant, parse_float=str, parse_int=str)
_as_written = json.JSONDecoder(parse_constant=_no_constant, parse_float=Number, parse_int=Number)
_SPACE = " \t\n\r"


def _deep_array(text: str, decoder: json.JSONDecoder = _decoder) -> list | None:
    """The JSON array of a text too deep for the recursive decoder, by a scan with an explicit stack; None if it is none."""
    stack: list[list | dict] = []
    keys: list[str | None] = []  # of each open value: the key whose value comes next, if it is an object
    at, n, state = 0, len(text), "value"
    root = None
    while True:
        while at < n and text[at] in _SPACE:
            at += 1
        if state == "after" and not stack:
            return root if at == n and isinstance(root, list) else None
        if at >= n:
            return None
        c = text[at]
        if state in ("value", "first"):
            if state == "first" and c == "]":
                stack.pop()
                keys.pop()
                at, state = at + 1, "after"
                continue
            if c in "[{":
                value: object = [] if c == "[" else {}
                at += 1
            else:
                try:
                    value, at = decoder.raw_decode(text, at)
                except ValueError:
                    return None
            if not stack:
                root = value
            elif isinstance(stack[-1], list):
                stack[-1].append(value)
            else:
                stack[-1][keys[-1]] = value
            if c in "[{":
                stack.append(value)
                keys.append(None)
                state = "first" if c == "[" else "key1"
            else:
                state = "after"
        elif state in ("key1", "key"):
            if c == "}" and state == "key1":
                stack.pop()
                keys.pop()
                at, state = at + 1, "after"
                continue
            if c != '"':
                return None
            try:
                keys[-1], at = decoder.raw_decode(text, at)
            except ValueError:
                return None
            while at < n and text[at] in _SPACE:
                at += 1
            if text[at : at + 1] != ":":
                return None
            at, state = at + 1, "value"
        elif c == ",":
            at, state = at + 1, "value" if isinstance(stack[-1], list) else "key"
        elif c == ("]" if isinstance(stack[-1], list) else "}"):
            stack.pop()
            keys.pop()
            at += 1
        else:
            return None


def parse_array(text: str, as_written: bool = False) -> list | None:
    """The JSON array of a text by RFC 8259, numbers as plain text or, told apart from strings, as Number; None if it is none."""
    if text.lstrip(_SPACE)[:1] != "[":
        return None
    decoder = _as_written if as_written else _decoder
    try:
        return decoder.decode(text)
    except RecursionError:
        return _deep_array(text, decoder)
    except ValueError:
        return None


def is_json_array(text: str) -> bool:
    if text.lstrip(_SPACE)[:1] != "[":
        return False
    try:
        _decoder.decode(text)
        return True
    except ValueError:
        return False
    except RecursionError:
        return _deep_array(text) is not None


class Index:
    """The structure of CSV records by RFC 4180: which are well-formed, how many fields they have, where these begin and end."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_string())
        _, offsets, data = texts.buffers()
        bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        base = int(bounds[0])
        self.data = np.frombuffer(data, np.uint8)[base : int(bounds[-1])] if data is not None else np.zeros(0, np.uint8)
        self.start, self.end = bounds[:-1] - base, (bounds[1:] - base).copy()
        n, size = len(texts), len(self.data)
        self.end = self._without_line_end(size)
        row_of = np.repeat(np.arange(n), (bounds[1:] - bounds[:-1]))  # of each byte its record
        quotes = np.flatnonzero(self.data == 0x22)
        owner = row_of[quotes]
        # parity of a record's quotes so far: the running number less that at the record's beginning
        before = np.searchsorted(quotes, self.start)
        opens = (np.arange(len(quotes)) - before[owner]) % 2 == 0
        bad = np.zeros(n, bool)
        inside_count = np.searchsorted(quotes, self.end) - before
        bad |= inside_count % 2 == 1
        previous = np.where(quotes > self.start[owner], self.data[np.maximum(quotes - 1, 0)], 0x2C) if size else quotes
        following = np.where(quotes + 1 < self.end[owner], self.data[np.minimum(quotes + 1, size - 1)], 0x2C) if size else quotes
        wrong = np.where(opens, (previous != 0x2C) & (previous != 0x22), (following != 0x2C) & (following != 0x22))
        bad[owner[wrong]] = True
        marks = np.flatnonzero((self.data == 0x2C) | (self.data == 0x0A) | (self.data == 0x0D))
        at = row_of[marks]
        outside = ((np.searchsorted(quotes, marks) - before[at]) % 2 == 0) & (marks < self.end[at])
        breaks = self.data[marks] != 0x2C
        bad[at[outside & breaks]] = True
        self.commas, self.comma_row = marks[outside & ~breaks], at[outside & ~breaks]
        self.well_formed = ~bad
        self.fields = np.bincount(self.comma_row, minlength=n) + 1
        self.first_comma = np.searchsorted(self.comma_row, np.arange(n))

    def _without_line_end(self, size: int) -> np.ndarray:
        """A record's own line end at its end is not part of it."""
        end = self.end
        if size:
            for code in (0x0A, 0x0D):
                end = np.where((end > self.start) & (self.data[np.clip(end - 1, 0, size - 1)] == code), end - 1, end)
        return end

    def field(self, row: int, k: int) -> str:
        """Field k of a well-formed record, its quotes resolved."""
        first = self.first_comma[row]
        left = self.start[row] if k == 0 else self.commas[first + k - 1] + 1
        right = self.end[row] if k + 1 == self.fields[row] else self.commas[first + k]
        text = self.data[left:right].tobytes().decode("utf-8", "replace")
        return text[1:-1].replace('""', '"') if text[:1] == '"' else text


    def column(self, k: int, rows: np.ndarray) -> pa.StringArray:
        """Field k of the well-formed records rows, their quotes resolved, without a step a row."""
        first = self.first_comma[rows]
        left = self.start[rows] if k == 0 else self.commas[first + k - 1] + 1
        last = self.fields[rows] == k + 1
        right = self.end[rows].copy()
        right[~last] = self.commas[first[~last] + k]
        quoted = np.zeros(len(rows), bool)
        some = right > left
        quoted[some] = self.data[left[some]] == 0x22
        left, right = left + quoted, right - quoted
        size = right - left
        ends = np.cumsum(size)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(left - (ends - size), size)
        offsets = np.concatenate([[0], ends]).astype(np.int64)
        found = pa.LargeStringArray.from_buffers(len(rows), pa.py_buffer(offsets), pa.py_buffer(self.data[at]))
        if quoted.any():
            found = pc.if_else(pa.array(quoted), pc.replace_substring(found, '""', '"'), found)
        return found.cast(pa.string())


def record_reasons(texts: pa.Array, columns: int = 16, items: int | None = 9, amount: int | None = 13, index: Index | None = None) -> list[str | None]:
    """The first reason for which each record does not load: quoting, column_count, items_json, amount; None if it loads."""
    index = index or Index(texts.fill_null(""))
    reasons = np.where(~index.well_formed, "quoting", np.where(index.fields != columns, "column_count", "")).astype(object)
    rows = np.flatnonzero(reasons == "")
    for k, reason, loads in ((items, "items_json", is_json_array), (amount, "amount", lambda t: read_amount(t) is not None)):
        if k is not None and len(rows):
            bad = np.array([not is_blank(t) and not loads(t) for t in index.column(k, rows).to_pylist()], bool)
            reasons[rows[bad]] = reason
            rows = rows[~bad]
    return [r or None for r in reasons.tolist()]


def _reasons(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            if kind == "record":
                found = record_reasons(texts)
            elif kind == "items_json":
                found = [None if is_blank(t) or is_json_array(t) else kind for t in texts.to_pylist()]
            else:
                found = [None if is_blank(t) or read_amount(t) is not None else kind for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(found, pa.string())], names=["row", "reason"])

    return run


def reasons(df: DataFrame, row_id: str, text: str, kind: str) -> DataFrame:
    """(row_id, reason) of every row; the reason is null if the row loads. kind: record (a CSV record), items_json or amount.

    Null and blank values load, but as a record: that has one empty field, hence the wrong number. Empty tables give empty
    results; other columns are not looked at.
    """
    rows = df.select(F.col(row_id).cast("long").alias("row"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_reasons(kind), "row long, reason string").withColumnRenamed("row", row_id)


def rejected(df: DataFrame, row_id: str, text: str, kind: str) -> DataFrame:
    """(row_id, reason) of the rows that do not load."""
    return reasons(df, row_id, text, kind).where("reason is not null")


def load_records(df: DataFrame, row_id: str = "raw_id", text: str = "line_text", names: list[str] | tuple[str, ...] | None = None, keep: tuple[str, ...] = (), items: str | None = "items", amount: str | None = "total_amount") -> DataFrame:
    """Every record with its fields as columns, or nulls and a reason: one scan makes both the valid and the reject rows.

    items and amount are the fields whose values are tested, if names has them; columns to keep go before the reason. Null texts are empty records.
    """
    names = list(names or ORDER_FIELDS)
    at = [names.index(c) if c in names else None for c in (items, amount)]
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index = Index(batch.column("text").fill_null(""))
            reasons = pa.array(record_reasons(batch.column("text"), len(names), *at, index), pa.string())
            good = np.flatnonzero(reasons.is_null().to_numpy(zero_copy_only=False))
            place = np.full(batch.num_rows, -1)
            place[good] = np.arange(len(good))
            place = pa.array(place, mask=place < 0)
            columns = [index.column(k, good).take(place) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], reasons, *columns], names=[*batch.schema.names[:-1], "reason", *(f"f{k}" for k in range(len(names)))])

    rows = df.select(F.col(row_id).cast("long").alias("row"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).cast("string").alias("text"))
    schema = ", ".join(["row long", *(f"k{i} {kinds[c]}" for i, c in enumerate(keep)), "reason string", *(f"f{k} string" for k in range(len(names)))])
    return rows.mapInArrow(run, schema).toDF(row_id, *keep, "reason", *names)


def loaded(df: DataFrame, row_id: str, text: str, kind: str) -> DataFrame:
    """The rows of df whose value loads, all columns kept: the others are those of rejected(). kind: items_json or amount."""
    kinds, names = dict(df.dtypes), df.columns
    good = {"items_json": is_json_array, "amount": lambda t: read_amount(t) is not None}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([is_blank(t) or good(t) for t in batch.column(0).to_pylist()], pa.bool_()))

    rows = df.select(F.col(text).cast("string").alias("_text"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(names)])
    return rows.mapInArrow(run, ", ".join(["_text string", *(f"c{i} {kinds[c]}" for i, c in enumerate(names))])).drop("_text").toDF(*names)
