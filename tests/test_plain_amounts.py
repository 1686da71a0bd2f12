import duckdb
from test_rejects_nested_units import CURRENCIES

from millrace.plans import found

ROWS = [
    (1, "5", "USD"), (2, "5.25", "USDT"), (3, "5", "eth"), (4, "00012.50", "AED"), (5, "5", "EUR"), (5, "5", "EUR"),
    (6, "5\n", "USD"), (7, "5.25\r\n", "YER"), (8, "5", "USD\n"), (9, "5", "DHS"), (10, "5", "ETH"), (11, "5", "usd"), (12, "5", " USD"),
    (13, "0.001", "YER"), (14, None, "YER"), (15, "5", None), (16, "5", "XYZ"), (17, "1234567890123", "YER"), (18, "1,000", "YER"), (None, "7", "YER"),
]


def write(spark, folder):
    more = [dict(CURRENCIES[1], currency_code=code, name_en=code, name_ar=code, minor_name=f"{code}-cent", yer_per_unit=rate) for code, rate in (("USDT", 530), ("eth", 900))]
    spark.createDataFrame(CURRENCIES + more).write.parquet(f"{folder}/ref_currency.parquet")
    spark.createDataFrame(ROWS, "loader_id long, total_amount string, currency string").write.parquet(f"{folder}/spark_loader.parquet")


def test_plain_amounts_are_those_of_the_sql(spark, tmp_path):
    write(spark, tmp_path)
    con = duckdb.connect()
    for name in ("ref_currency", "spark_loader"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    want = con.sql(found.SQL["p7_plain"]).fetchall()
    assert {2, 3} <= {row for row, _ in want}  # codes that are not three capitals
    assert sorted(map(tuple, found.p7_plain(spark, str(tmp_path)).collect()), key=str) == sorted(want, key=str)


def test_plain_amounts_convert_every_row(spark, tmp_path, monkeypatch):
    write(spark, tmp_path)
    given, convert = [], found.in_hundredths
    monkeypatch.setattr(found, "in_hundredths", lambda df, *args, **kwargs: given.append(df.count()) or convert(df, *args, **kwargs))
    found.p7_plain(spark, str(tmp_path))
    assert given == [len(ROWS)]
