import datetime as dt

from millrace.streaming import loader

SCHEMA = "delivery_id long, id_order string, received_at timestamp"


def at(day):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=day)


def test_no_message_is_lost_and_none_repeated(spark, tmp_path):
    """Blank identifiers, a first delivery and a repeat far behind the watermark, repeats within a batch and across batches."""
    sent = [
        [(1, "A", at(60)), (2, "", at(60)), (3, None, at(61)), (4, "B", at(61)), (5, " b", at(60))],
        [(6, "C", at(1)), (7, " a", at(1)), (8, " \u200f", at(1)), (9, "D", at(90)), (10, "d", at(90)), (11, "E", None)],
        [(12, "c", at(200)), (13, "", at(200)), (14, "F", at(200)), (15, "e", at(0))],
    ]
    kept = []
    for rows, want in zip(sent, ([1, 2, 3, 5], [6, 8, 9, 11], [13, 14])):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        loader.stream_once(stream, str(tmp_path / "out")).awaitTermination()
        kept += want
        assert sorted(r.delivery_id for r in spark.read.parquet(str(tmp_path / "out/rows")).collect()) == sorted(kept)
    assert sorted(r[0] for r in spark.read.parquet(str(tmp_path / "out/seen")).collect()) == list("ABCDEF")
