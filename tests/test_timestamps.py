import datetime as dt
from zoneinfo import ZoneInfo

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.operators.timestamps import instants, to_utc, utc_instants

import numpy as np


def one(value, zone="UTC", day_first=True):
    us, ok = instants([value], [zone], [day_first])
    return int(us[0]) if ok[0] else None


def us(*parts, micro=0):
    return int(dt.datetime(*parts, tzinfo=dt.timezone.utc).timestamp()) * 1_000_000 + micro


@pytest.mark.parametrize(
    "value, zone, day_first, expected",
    [
        ("2024-01-31T02:00:00Z", None, None, us(2024, 1, 31, 2)),
        ("2024-01-31T02:00:00+0300", None, None, us(2024, 1, 30, 23)),
        ("2024-01-31 02:00:00.123456789-05", None, None, us(2024, 1, 31, 7, micro=123456)),
        ("٢٠٢٤/٠١/٣١ ٠٢:٣٤ م", "Asia/Aden", True, us(2024, 1, 31, 11, 34)),
        ("2024 / 01 / 30 T23:24:55Z", None, None, us(2024, 1, 30, 23, 24, 55)),
        ("31/01/2024 03:21:15 AM", "UTC", True, us(2024, 1, 31, 3, 21, 15)),
        ("01/31/2024 12:05 AM", "UTC", False, us(2024, 1, 31, 0, 5)),
        ("01/31/2024", "UTC", True, None),
        ("31.01.2024 02:16", "UTC", None, None),
        ("1706661286", None, None, 1706661286 * 10**6),
        ("1706653733741", None, None, 1706653733741000),
        ("20240130235338", "UTC", None, us(2024, 1, 30, 23, 53, 38)),
        ("20240131T003521Z", None, None, us(2024, 1, 31, 0, 35, 21)),
        ("2024", "UTC", True, None),
        ("10/2026", "UTC", True, None),
        ("Q3 2024", "UTC", True, None),
        ("2026-02-31T19:41:00Z", None, None, None),
        ("2024-02-29", "UTC", None, us(2024, 2, 29)),
        ("2024-03-27 03:29:55 America/New_York", None, None, us(2024, 3, 27, 7, 29, 55)),
        ("2024-02-01T07:32:05[Asia/Aden]", None, None, us(2024, 2, 1, 4, 32, 5)),
        ("2024-10-27 02:30:00", "Europe/Berlin", None, us(2024, 10, 27, 0, 30)),  # twice: the earlier
        ("2024-03-31 02:30:00", "Europe/Berlin", None, None),  # skipped
        ("Wed, 31 Jan 2024 17:06:14 GMT", None, None, us(2024, 1, 31, 17, 6, 14)),
        ("May 1, 2024 01:07 PM", "UTC", None, us(2024, 5, 1, 13, 7)),
        ("2024-01-31T02:00:00", None, True, None),
        ("13:00 PM", "UTC", True, None),
        ("0000-00-00", "UTC", True, None),
        ("", "UTC", True, None),
        (None, "UTC", True, None),
        ("9" * 100_000, "UTC", True, None),
        ("2024-01-31 02:00:00", "Not/AZone", True, None),
    ],
)
def test_values(value, zone, day_first, expected):
    assert one(value, zone, day_first) == expected


@settings(max_examples=200, deadline=None)
@given(st.datetimes(dt.datetime(1902, 1, 1), dt.datetime(2099, 1, 1)), st.sampled_from(["Europe/Berlin", "America/New_York", "Asia/Kolkata", "Europe/London", "Asia/Riyadh", "Africa/Casablanca"]))
def test_zones_against_the_standard_library(local, name):
    zone = ZoneInfo(name)
    seconds = int((local.replace(microsecond=0) - dt.datetime(1970, 1, 1)).total_seconds())
    expected = local.replace(microsecond=0, tzinfo=zone, fold=0).astimezone(dt.timezone.utc)
    exists = expected.astimezone(zone).replace(tzinfo=None) == local.replace(microsecond=0)
    got, ok = to_utc(np.array([seconds]), name, np.array([False]))
    assert bool(ok[0]) == exists
    if exists:
        assert int(got[0]) == int((expected.replace(tzinfo=None) - dt.datetime(1970, 1, 1)).total_seconds())


@settings(max_examples=200, deadline=None)
@given(st.datetimes(dt.datetime(1, 1, 2), dt.datetime(9999, 12, 30)))
def test_iso_round_trip(when):
    assert one(when.isoformat() + "Z") == (when - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)


def test_table(spark):
    rows = spark.createDataFrame([(1, "web", "2024-01-31 03:00:00", 1), (1, "web", "2024-01-31 03:00:00", 1), (2, None, "2024-01-31", 1), (3, "nowhere", "2024-01-31", 1), (4, None, None, 1)], "delivery_id long, channel string, order_date string, zone int")
    channels = spark.createDataFrame([("web", "Asia/Aden", True)], "channel string, tz_name string, day_first boolean")
    out = utc_instants(rows, channels)
    assert sorted(map(tuple, out.collect())) == [(1, us(2024, 1, 31))] * 2
    assert utc_instants(rows.limit(0), channels).count() == 0
    assert utc_instants(rows, channels.limit(0)).count() == 0
