"""CSV files as records, by many tasks: where a record ends is found across lines and splits.

Lines are read by the splits of the text source. A line can open a quoted line break, go on inside one or close it only if it is
well-formed as such, so a block of lines maps the state before it (inside quotes or not) to the state after it. These maps are made for
all blocks at once and then chained, a row for each block; with its state every block is cut into records on its own, and only records
that cross blocks are put together.

A line that is a well-formed record of the right number of fields by itself is always a record. So a quote that is wrong or never
closed spoils its own line only: the lines after it, up to one that cannot stand inside quotes, are read on their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.operators.rejects import Index
from millrace.session import SMALL_ROWS, cut, is_small

#: Bytes of the longest record; a longer one counts as one whose quote is never closed.
LONGEST = 64_000_000
#: The mark that some writers put before the first line.
_MARK = "\ufeff"
CLOSED, BROKEN, THROUGH = "closed", "broken", "through"


class Run(NamedTuple):
    """Lines first to last of a block that a quoted line break holds together; first is -1 if it began before the block."""

    first: int
    last: int
    fate: str


class Lines(NamedTuple):
    """The numbers of the lines that can open a run, that can close one, and that cannot stand inside one."""

    opens: np.ndarray
    closes: np.ndarray
    breaks: np.ndarray


def kinds(texts: pa.Array, columns: int) -> Lines:
    """The kinds of lines, columns being the number of fields of a whole record."""
    index = Index(texts)
    n = len(texts)
    quotes = np.bincount(np.searchsorted(index.start, np.flatnonzero(index.data == 0x22), "right") - 1, minlength=n) if len(index.data) else np.zeros(n, np.int64)
    whole = index.well_formed & (index.fields == columns)
    odd = quotes % 2 == 1

    def fit(rows: np.ndarray, before: str, after: str) -> np.ndarray:
        """Those of the rows that are well-formed with quotes put before and after."""
        ends = np.array([t.rstrip("\r") for t in texts.take(pa.array(rows)).to_pylist()], object)
        return rows[Index(pa.array([f"{before}{t}{after}" for t in ends], pa.string())).well_formed] if len(rows) else rows

    at_odd = np.flatnonzero(odd)
    closes, inside = fit(at_odd, '"', ""), np.flatnonzero(~odd & (quotes > 0) & ~whole)
    breaks = np.concatenate([np.flatnonzero(whole), np.setdiff1d(at_odd, closes), np.setdiff1d(inside, fit(inside, '"', '"'))])
    return Lines(fit(at_odd, "", '"'), closes, np.sort(breaks))


def runs(lines: Lines, n: int, inside: bool) -> list[Run]:
    """The runs among n lines, by the state before the first."""
    found, at = [], 0
    opens = -1 if inside else None
    first = lambda x, k: int(x[i]) if (i := np.searchsorted(x, k)) < len(x) else n
    while True:
        if opens is None:
            opens = first(lines.opens, at)
            if opens == n:
                return found
        closes, breaks = first(lines.closes, opens + 1), first(lines.breaks, opens + 1)
        if closes < breaks:
            found.append(Run(opens, closes, CLOSED))
            at = closes + 1
        elif breaks < n:
            found.append(Run(opens, breaks - 1, BROKEN))
            at = breaks
        else:
            found.append(Run(opens, n - 1, THROUGH))
            return found
        opens = None


class _Block:
    """The lines of one block, batch after batch."""

    def __init__(self, columns: int):
        self.columns, self.n = columns, 0
        self.parts: list[Lines] = []
        self.sizes: list[np.ndarray] = []

    def add(self, texts: pa.Array) -> None:
        self.parts.append(Lines(*(x + self.n for x in kinds(texts, self.columns))))
        self.sizes.append(pc.binary_length(texts).to_numpy())
        self.n += len(texts)

    def done(self) -> tuple[Lines, np.ndarray]:
        return Lines(*(np.concatenate(x) for x in zip(*self.parts))), np.concatenate(self.sizes)


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.Array]]:
    """(file, block, lines) of each stretch of one block."""
    for batch in batches:
        block = batch.column("block").to_numpy()
        file = batch.column("file").to_pylist()
        cuts = [0, *(i for i in range(1, len(block)) if block[i] != block[i - 1] or file[i] != file[i - 1]), len(block)] if len(block) else [0]
        for a, b in zip(cuts, cuts[1:]):
            yield file[a], int(block[a]), batch.column("value").slice(a, b - a)


_MAPS = "file string, block long, out_fate string, out_size long, in_fate string, in_size long, in_then string, in_then_size long"
_STATES = "file string, block long, inside boolean, carried string, tail string, head long"


def _maps(columns: int):
    """Of each block: how its last run ends if the block begins outside quotes; how the run it begins in ends, and what then is the last."""

    def row(file: str, block: int, b: _Block) -> tuple:
        lines, sizes = b.done()
        total = np.concatenate([[0], np.cumsum(sizes + 1)])
        size = lambda r: int(total[r.last + 1] - total[max(r.first, 0)])
        last = lambda found: (found[-1].fate, size(found[-1])) if found and found[-1].fate == THROUGH else ("", 0)
        inside = runs(lines, b.n, True)
        return file, block, *last(runs(lines, b.n, False)), inside[0].fate, size(inside[0]), *last(inside[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, _Block(columns), []
        for file, block, texts in _by_block(batches):
            if now is not None and now != (file, block):
                out.append(row(*now, held))
                held = _Block(columns)
            now = (file, block)
            held.add(texts)
        if now is not None:
            out.append(row(*now, held))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string() if "string" in c else pa.int64()) for i, c in enumerate(_MAPS.split(", "))], names=[c.split()[0] for c in _MAPS.split(", ")])

    return run


def _chained(longest: int):
    """The blocks of a file in order, a row each: the state before each, what becomes of the run that enters it and of the one that leaves it."""

    def run(maps: pd.DataFrame) -> pd.DataFrame:
        maps = maps.sort_values("block", ignore_index=True)
        inside, carried, tail, head = [], [], [], []
        open_at: int | None = None  # the block in whose end the present run began
        size, members = 0, []

        def close(fate: str) -> None:
            for i, what in members:
                (tail if what == "tail" else carried)[i] = fate

        for i, r in enumerate(maps.itertuples()):
            inside.append(open_at is not None)
            carried.append("")
            tail.append("")
            head.append(-1 if open_at is None else open_at)
            leaves, leaves_size = r.out_fate, r.out_size
            if open_at is not None:
                members.append((i, "carried"))
                size += r.in_size
                if r.in_fate == THROUGH:
                    continue
                close(r.in_fate if size <= longest else BROKEN)
                open_at, members = None, []
                leaves, leaves_size = r.in_then, r.in_then_size
            if leaves == THROUGH:
                open_at, size, members = r.block, leaves_size, [(i, "tail")]
        close(BROKEN)
        return pd.DataFrame({"file": maps["file"], "block": maps["block"], "inside": inside, "carried": carried, "tail": tail, "head": head})

    return run


def _cut_up(file: str, block: int, state: tuple, lines: Lines, texts: pa.Array) -> pa.RecordBatch:
    """(file, block, ord, head, value) of a block: the records that begin in it, numbered, and the end of the one that began before it."""
    inside, carried, tail, head = state
    n = len(texts)
    begins = pc.binary_length(pc.utf8_rtrim(texts, characters="\r")).to_numpy() > 0  # blank lines are no records
    longer: list[tuple[int, str, int | None]] = []  # of records of several lines: the first line, the text, the block if it goes on in the next
    end: list[str] = []
    for r in runs(lines, n, inside):
        first = max(r.first, 0)
        if (carried if r.first < 0 else tail if r.fate == THROUGH else r.fate) == BROKEN:
            continue
        text = "\n".join(texts.slice(first, r.last + 1 - first).to_pylist())
        begins[first : r.last + 1] = False
        if r.first < 0:
            end = [text]
        else:
            begins[first] = True
            longer.append((first, text, block if r.fate == THROUGH else None))
    at = np.flatnonzero(begins)
    values, heads = texts.take(pa.array(at)), np.full(len(at), -1)
    if longer:
        place = np.searchsorted(at, [x[0] for x in longer])
        mask = np.zeros(len(at), bool)
        mask[place] = True
        values = pc.replace_with_mask(values, pa.array(mask), pa.array([x[1] for x in longer], values.type))
        heads[place] = [-1 if x[2] is None else x[2] for x in longer]
    heads = np.concatenate([heads, np.full(len(end), head)])
    out = [pa.array([file] * len(heads), pa.string()), pa.array(np.full(len(heads), block)), pa.array(np.concatenate([np.arange(len(at)), np.full(len(end), -1)])), pa.array(heads, mask=heads < 0), pa.concat_arrays([values.cast(pa.string()), pa.array(end, pa.string())])]
    return pa.RecordBatch.from_arrays(out, names=["file", "block", "ord", "head", "value"])


def _pieces(columns: int, told: Broadcast | None):
    """The records that begin in each block, and the pieces of those that cross blocks: (file, block, ord, head, value)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, texts, state = None, _Block(columns), [], None
        for batch in batches:
            place = 0
            for file, block, part in _by_block(iter([batch])):
                if now is not None and now != (file, block):
                    yield _cut_up(*now, state, held.done()[0], pa.concat_arrays(texts))
                    held, texts = _Block(columns), []
                now = (file, block)
                state = told.value[now] if told is not None else tuple(batch.column(c)[place].as_py() for c in ("inside", "carried", "tail", "head"))
                place += len(part)
                held.add(part)
                texts.append(part)
        if now is not None:
            yield _cut_up(*now, state, held.done()[0], pa.concat_arrays(texts))

    return run


def csv_records(spark: SparkSession, path: str | list[str], columns: int, longest: int = LONGEST, most_blocks: int = SMALL_ROWS) -> DataFrame:
    """(file, number, value): the text of each record of CSV files with its number in its file from 0, the header included. Blank lines are none.

    columns is the number of fields that a whole record has. Records that are not well-formed come as they are: load_records() tells why.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.ltrim("value", F.lit(_MARK)).alias("value"))
    maps = lines.mapInArrow(_maps(columns), _MAPS)
    blocks = cut(maps.groupBy("file").applyInPandas(_chained(longest), _STATES))  # a row for each block
    out = "file string, block long, ord long, head long, value string"
    if is_small(blocks, most_blocks):
        states = {(r["file"], r["block"]): (r["inside"], r["carried"], r["tail"], r["head"]) for r in blocks.collect()}
        pieces = lines.mapInArrow(_pieces(columns, spark.sparkContext.broadcast(states)), out)
    else:
        # too many blocks to tell every task: lines are brought to the row of their block and put in order again
        placed = lines.withColumn("at", F.monotonically_increasing_id()).join(blocks.hint("shuffle_merge"), ["file", "block"]).sortWithinPartitions("file", "block", "at")
        pieces = placed.select("file", "block", "value", "inside", "carried", "tail", "head").mapInArrow(_pieces(columns, None), out)
    pieces = cut(pieces)
    # at most one record of each block goes on in the next
    crossing = pieces.where("head is not null").groupBy("file", "head").agg(F.max(F.when(F.col("block") == F.col("head"), F.col("ord"))).alias("ord"), F.array_sort(F.collect_list(F.struct("block", "value"))).alias("parts"))
    crossing = crossing.select("file", F.col("head").alias("block"), "ord", F.array_join("parts.value", "\n").alias("value"))
    records = pieces.where("head is null").select("file", "block", "ord", "value").unionByName(crossing)
    counts = pieces.where("ord >= 0").groupBy("file", "block").agg(F.count("*").alias("n"))
    # a row for each block of a file
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("file", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return records.join(offsets, ["file", "block"]).select("file", (F.col("before") + F.col("ord")).alias("number"), "value")
