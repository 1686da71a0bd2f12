"""Problem 4: mixed timestamp formats and time zones, out as microseconds since 1970-01-01 UTC.

All formats are compiled into one regular expression whose alternatives have named groups; a value is matched once. Calendar
ranges are checked and instants assembled over whole batches with integer day arithmetic; zones are tables of transitions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from functools import cache
from zoneinfo import ZoneInfo

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import ascii_digits, strip_edges
from millrace.session import small

#: Month names by their first three letters, and the marks of the half day (fixed values).
MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}
NOON = {"am": 0, "pm": 12, "a.m.": 0, "p.m.": 12, "ص": 0, "م": 12, "صباحا": 0, "مساء": 12}

_PARTS = {
    "Y": r"\d{4}",
    "m": r"\d{1,2}",
    "d": r"\d{1,2}",
    "a": r"\d{1,2}",  # day or month, as the channel has it
    "b": r"\d{1,2}",
    "B": r"jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?",
    "p": r"(?:[ap]\.?m\.?(?![a-z])|صباحا|مساء|ص|م)",
    "z": r"z|utc|gmt|[+-]\d{2}(?::?\d{2})?|\[[A-Za-z_]+(?:/[A-Za-z_+\-0-9]+)*\]|[A-Za-z_]+(?:/[A-Za-z_+\-0-9]+)+",
    "e": r"\d{9,10}|\d{13}|\d{16}|\d{19}",
    "H": r"\d{1,2}",
    "M": r"\d{1,2}",
    "S": r"\d{1,2}",
    "f": r"\d+",
}
_CLOCK = r"<H>:<M>(?::<S>(?:[.,]<f>)?)?(?: ?<p>)?(?: ?<z>)?"
_TIGHT = {"Y": r"\d{4}"} | dict.fromkeys("mdHMS", r"\d{2}")
#: The formats, each with the widths of its parts; blanks around a date's separators are allowed. Order matters only for digits.
FORMATS = (
    (r"<Y> ?- ?<m> ?- ?<d>(?:(?: ?t ?| )" + _CLOCK + ")?", _PARTS),
    (r"<Y> ?/ ?<m> ?/ ?<d>(?:(?: ?t ?| )" + _CLOCK + ")?", _PARTS),
    (r"<Y>\.<m>\.<d>(?:(?: ?t ?| )" + _CLOCK + ")?", _PARTS),
    (r"<a>(?P<s>[/.-])<b>(?P=s)<Y>(?:(?:,? |t)" + _CLOCK + ")?", _PARTS),
    (r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,? )?<d>[ -]<B>\.?,?[ -]<Y>(?:,? " + _CLOCK + ")?", _PARTS),
    (r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,? )?<B>\.? <d>(?:st|nd|rd|th)?,? <Y>(?:,? " + _CLOCK + ")?", _PARTS),
    (r"<Y><m><d>(?:t?<H><M>(?:<S>(?:[.,]<f>)?)?(?: ?<z>)?)?", _PARTS | _TIGHT),
    (r"<e>", _PARTS),
)
#: Fields of a matched value; missing ones are -1.
FIELDS = "Y m d H M S f".split()


@cache
def matcher() -> tuple[re.Pattern, list[dict[str, int]]]:
    """The one alternation, and for each format the numbers of its groups."""
    parts = []
    for i, (form, widths) in enumerate(FORMATS):
        form = re.sub(r"<(\w)>", lambda m: f"(?P<{m[1]}{i}>{widths[m[1]]})", form.replace("P<s>", f"P<s{i}>").replace("P=s", f"P=s{i}"))
        parts.append(f"(?P<form{i}>{form})")
    # epoch lengths other than compact dates are tried by the last format only when the compact one does not fit
    pattern = re.compile("|".join(f"(?:{p}\\Z)" for p in parts), re.IGNORECASE)
    groups = [{n[0]: g for n, g in pattern.groupindex.items() if n[1:] == str(i)} for i in range(len(FORMATS))]
    return pattern, groups


@cache
def transitions(name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Of a zone between 1900 and 2100: local times (s) from which an offset holds, the instants it starts, the offsets; None if unknown."""
    try:
        zone = ZoneInfo(name)
    except Exception:
        return None

    def offset(at: int) -> int:
        return int(zone.utcoffset(datetime(1970, 1, 1, tzinfo=timezone.utc).astimezone(zone) if at == 0 else (datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=at)).astimezone(zone)).total_seconds())

    week = 7 * 86400
    low, high = -2208988800, 4102444800
    starts, offsets = [low], [offset(low)]
    for at in range(low, high, week):
        if offset(at + week) != offsets[-1]:
            left, right = at, at + week
            while right - left > 1:
                mid = (left + right) // 2
                left, right = (mid, right) if offset(mid) == offsets[-1] else (left, mid)
            starts.append(right)
            offsets.append(offset(right))
    before = [offsets[0], *offsets[:-1]]
    return np.array([s + o for s, o in zip(starts, before)], np.int64), np.array(starts, np.int64), np.array(offsets, np.int64)


def to_utc(local: np.ndarray, zone: str, dated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Local seconds to UTC seconds in a zone, and which exist. Of two instants the earlier; a date alone starts with its first instant."""
    found = transitions(zone)
    if found is None:
        return local, np.zeros(len(local), bool)
    wall, starts, offsets = found
    at = np.clip(np.searchsorted(wall, local, "right") - 1, 0, None)
    utc = local - offsets[at]
    skipped = utc < starts[at]
    utc = np.where(skipped & dated, starts[at], utc)
    inside = (local > wall[0] + 86400) & (local < 4102444800)
    for i in np.flatnonzero(~inside):
        try:
            there = datetime(1970, 1, 1) + timedelta(seconds=int(local[i]))
            utc[i] = int(local[i]) - int(ZoneInfo(zone).utcoffset(there.replace(tzinfo=ZoneInfo(zone))).total_seconds())
        except (OverflowError, ValueError):
            skipped[i] = True
    return utc, ~skipped | dated


def days(year: np.ndarray, month: np.ndarray, day: np.ndarray) -> np.ndarray:
    """Days since 1970-01-01 of a date of the Gregorian calendar, by integers alone: years begin in March."""
    year = year - (month <= 2)
    era = year // 400
    of_era = year - era * 400
    of_year = (153 * (month + np.where(month > 2, -3, 9)) + 2) // 5 + day - 1
    return era * 146097 + of_era * 365 + of_era // 4 - of_era // 100 + of_year - 719468


def _clean(text: str) -> str:
    text = strip_edges(ascii_digits(text))
    if not text.isascii():
        text = re.sub(r"[​-‏‪-‮⁠⁦-⁩﻿؜]", "", text).replace("−", "-")
    return re.sub(r"\s+", " ", text)


def instants(values: list[str | None], zones: list[str | None], day_first: list[bool | None]) -> tuple[np.ndarray, np.ndarray]:
    """Microseconds since 1970-01-01 UTC of the values, and which of them fix an instant.

    A zone or offset in the value counts, else the row's zone; without either there is none. Numeric dates with the year last
    need day_first. Impossible, incomplete and skipped times fix none; fractions are cut off after microseconds.
    """
    pattern, groups = matcher()
    n = len(values)
    part = {f: np.full(n, -1, np.int64) for f in FIELDS}
    ok, dated, epoch = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, bool)
    offset = np.zeros(n, np.int64)
    by_zone: dict[str, list[int]] = {}
    us = np.zeros(n, np.int64)
    for i, value in enumerate(values):
        if value is None:
            continue
        m = pattern.match(_clean(value))
        if m is None:
            continue
        k = int(m.lastgroup[4:])
        g = groups[k]
        if "e" in g:
            text = m[g["e"]]
            us[i] = int(text) * 1_000_000 if len(text) <= 10 else int(text) * 10 ** (16 - len(text)) if len(text) <= 16 else int(text) // 1000
            ok[i] = epoch[i] = True
            continue
        y = int(m[g["Y"]])
        if "a" in g:
            if day_first[i] is None:
                continue
            d, mo = int(m[g["a"]]), int(m[g["b"]])
            if not day_first[i]:
                d, mo = mo, d
        else:
            d = int(m[g["d"]])
            mo = MONTHS[m[g["B"]][:3].lower()] if "B" in g else int(m[g["m"]])
        hour = m[g["H"]]
        minute = second = micro = 0
        if hour is None:
            hour, dated[i] = 0, True
        else:
            hour, minute = int(hour), int(m[g["M"]])
            second = int(m[g["S"]] or 0)
            micro = int(((m[g["f"]] or "") + "000000")[:6])
            half = m[g["p"]] if "p" in g else None
            if half:
                if not 1 <= hour <= 12:
                    continue
                hour = hour % 12 + NOON[half.lower() if half[0] in "صم" else half[0].lower() + "m"]
        zone = m[g["z"]] if "z" in g else None
        if zone is None:
            zone = zones[i]
            if zone is None:
                continue
        elif zone[0] in "+-":
            digits = zone[1:].replace(":", "")
            east, late = int(digits[:2]), int(digits[2:] or 0)
            if east > 18 or late > 59:
                continue
            offset[i] = (east * 3600 + late * 60) * (-1 if zone[0] == "-" else 1)
            zone = ""
        elif zone.lower() in ("z", "utc", "gmt"):
            zone = ""
        else:
            zone = zone.strip("[]")
        if zone:
            by_zone.setdefault(zone, []).append(i)
        ok[i] = True
        for f, x in zip(FIELDS, (y, mo, d, hour, minute, second, micro)):
            part[f][i] = x
    y, mo, d = part["Y"], part["m"], part["d"]
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    length = np.array([31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])[np.clip(mo, 1, 12) - 1] + (leap & (mo == 2))
    ranged = (y >= 1) & (mo >= 1) & (mo <= 12) & (d >= 1) & (d <= length) & (part["H"] <= 23) & (part["M"] <= 59) & (part["S"] <= 59)
    ok &= ranged | epoch
    local = days(y, mo, d) * 86400 + part["H"] * 3600 + part["M"] * 60 + part["S"]
    utc = local - offset
    for zone, rows in by_zone.items():
        at = np.array(rows)
        at = at[ok[at]]
        utc[at], exists = to_utc(local[at], zone, dated[at])
        ok[at] = exists
    return np.where(epoch, us, utc * 1_000_000 + part["f"]), ok


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        us, ok = instants(*(batch.column(c).to_pylist() for c in ("value", "zone", "first")))
        yield pa.RecordBatch.from_arrays([batch.column("row").filter(pa.array(ok)), pa.array(us[ok], pa.int64())], names=["row", "us"])


def utc_instants(df: DataFrame, channels: DataFrame, value: str = "order_date", row_id: str = "delivery_id", channel: str = "channel") -> DataFrame:
    """(row_id, utc_us) of each row whose value fixes an instant.

    Null, blank, unreadable, incomplete or impossible values give no row, nor does a value without a zone whose channel is
    missing or unknown. An empty table gives an empty result; other columns are not looked at.
    """
    rules = small(channels.select(F.col("channel").alias("_channel"), F.col("tz_name").alias("zone"), F.col("day_first").alias("first")).dropDuplicates(["_channel"]))
    rows = df.select(F.col(row_id).cast("long").alias("row"), F.col(channel).alias("_at"), F.col(value).cast("string").alias("value")).where("value is not null")
    rows = rows.join(rules, F.col("_at") == F.col("_channel"), "left").select("row", "value", "zone", "first")
    return rows.mapInArrow(_batches, "row long, us long").select(F.col("row").alias(row_id), F.col("us").alias("utc_us"))
