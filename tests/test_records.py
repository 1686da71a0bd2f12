"""Problem 5 over files: where records end, across lines and splits."""

import csv
import io
import json

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.operators.rejects import Index, load_records
from millrace.sources.files import layout, raw_layer, read_csv
from millrace.sources.records import BROKEN, THROUGH, csv_records, kinds, runs


def one_by_one(text: str, columns: int) -> list[str]:
    """The definition, line after line."""
    lines = text.split("\n")
    lines = lines[:-1] if lines[-1] == "" else lines
    fits = lambda t: bool(Index(pa.array([t], pa.string())).well_formed[0])
    whole = lambda t: fits(t) and Index(pa.array([t], pa.string())).fields[0] == columns
    out, i = [], 0
    while i < len(lines):
        j, bare = i, lines[i].rstrip("\r")
        if bare.count('"') % 2 and fits(f'{bare}"'):
            for k in range(i + 1, len(lines)):
                line = lines[k].rstrip("\r")
                if whole(line):
                    break
                if line.count('"') % 2:
                    j = k if fits(f'"{line}') else i
                    break
                if '"' in line and not fits(f'"{line}"'):
                    break
        record = "\n".join(lines[i : j + 1])
        if j > i or record.rstrip("\r"):
            out.append(record)
        i = j + 1
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a,b", "a", '"a', 'b",c', '"a,b",c', "", 'x"y,z', '"', "a,b,c", '"",""', "é,ü\r"]), max_size=12))
def test_runs_of_one_block(lines):
    out, at = [], 0
    for r in runs(kinds(pa.array(lines, pa.string()), 2), len(lines), False):
        out += [x for x in lines[at : r.first] if x.rstrip("\r")]
        out += lines[r.first : r.last + 1] if r.fate in (BROKEN, THROUGH) else ["\n".join(lines[r.first : r.last + 1])]
        out, at = [x for x in out if x.rstrip("\r")], r.last + 1
    out += [x for x in lines[at:] if x.rstrip("\r")]
    assert out == one_by_one("\n".join(lines) + "\n" if lines else "", 2)


FILES = [
    "h1,h2\n1,a\n2,b\n",
    'h1,h2\n1,"a\nb\nc"\n2,b\n3,"open\n4,d\n5,"x\n\ny"\n6,"e',
    'h1,h2\n1,"' + "long line\n" * 40 + '"\n2,b\n',
    'h1,h2\n"never closed\n' + "one field\n" * 30 + 'x,y\n"p\nq",r\n',
    'h1,h2\n1,2,3\n"bro"ken,5\n7\n8,"a""b"\n\n9,z\r\n10,"w\r\nv"\r\n',
    "﻿h1,h2\né,ü\n",
    'h1,h2\n"K"x",1\n2,"a\nb"\n"open,1\n"3","c\n ""q"", d\ne"\n"4","f\n"g",5\n',
]


@pytest.mark.parametrize("width", [7, 23, 64, 10_000])
@pytest.mark.parametrize("most_blocks", [50_000, 0])
def test_files_in_splits(spark, tmp_path, width, most_blocks):
    for i, text in enumerate(FILES):
        (tmp_path / f"{i}.csv").write_text(text, encoding="utf-8", newline="")
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(width))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        found: dict = {}
        df = csv_records(spark, str(tmp_path), 2, most_blocks=most_blocks)
        for r in df.collect():
            found.setdefault(int(r.file.rpartition("/")[2][0]), {})[r.number] = r.value
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    for i, text in enumerate(FILES):
        want = one_by_one(text.removeprefix("﻿"), 2)
        assert [found[i][n] for n in range(len(want))] == want and len(found[i]) == len(want)


def test_longest_record(spark, tmp_path):
    (tmp_path / "a.csv").write_text('h,i\n1,"' + "x\n" * 500 + '"\n2,b\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert csv_records(spark, str(tmp_path), 2).count() == 3 and csv_records(spark, str(tmp_path), 2, longest=300).count() == 503
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_rejects_at_ingest(spark, tmp_path):
    names = "id_order order_date status customer_id customer_name phone email shipping_city district items payment_method payment_status currency total_amount delivery_type delivery_cost".split()
    good = ["K1", *["x"] * 8, "[]", *["y"] * 6]
    out = io.StringIO()
    write = csv.writer(out, lineterminator="\n")
    write.writerows([names, [*good, "more", "more"], good[:3]])
    path = tmp_path / "probe.csv"
    path.write_text(out.getvalue() + ",".join(["K2", '"bro"ken', *good[2:]]) + "\n" + ",".join(['"K3', *good[1:]]) + "\n" + ",".join(good) + "\n")
    assert layout(str(path)) == names
    found = read_csv(spark, str(path))
    rows = {r.number_row_source: r for r in found.collect()}
    assert {n: r._reason for n, r in rows.items()} == {1: "column_count", 2: "column_count", 3: "quoting", 4: "quoting", 5: None}
    assert rows[5].id_order == "K1" and rows[5]._record is None and rows[1].id_order is None and rows[2]._record == "K1,x,x"
    raw = {r.number_row_source: json.loads(r.record_raw) for r in raw_layer(found, "r", "probe.csv", "local", "now").collect()}
    assert raw[4]["_reject_reason"] == "quoting" and raw[4]["_unparseable_record"].startswith('"K3') and raw[5]["items"] == "[]"


def test_columns_of_many_records(spark):
    rows = [(i, ",".join(f'"{i}""{k}"' if k % 3 == 0 else "" if k % 3 == 1 else f"v{k}é" for k in range(4))) for i in range(50)] + [(50, "a,b"), (51, None)]
    out = {r.n: r for r in load_records(spark.createDataFrame(rows, "n long, t string"), "n", "t", list("abcd")).collect()}
    assert all((out[i].a, out[i].b, out[i].c, out[i].d) == (f'{i}"0', "", "v2é", f'{i}"3') for i in range(50))
    assert out[50].reason == out[51].reason == "column_count" and out[50].a is None
