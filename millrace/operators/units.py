"""Problem 7: quantities recorded in different units.

Each row gets the unit readings its text and its channel allow. Where more than one is left, physical identities among columns
decide: the combination of readings with the smallest log residual wins, and ties are flagged as not unique.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from fractions import Fraction
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.amounts import SCALES, read_amount, split_scale, unify
from millrace.functions.text import is_blank, squash
from millrace.operators.rejects import parse_array
from millrace.session import small, small_rows

#: Other writings of the currencies: signs and everyday names (fixed values).
WRITINGS = {
    "YER": ("YR", "ر.ي", "ريال", "rial", "rials", "yemeni rials", "ريالات يمنية", "ريال يمنى", "ريالات"),
    "USD": ("$", "US$", "dollar", "dollars", "us dollars", "american dollar", "دولار", "دولارات", "دولار امريكي"),
    "SAR": ("SR", "ر.س", "saudi riyals", "saudi rial", "saudi rials", "ريالات سعودية"),
    "EUR": ("€", "euros", "يورو"),
    "AED": ("Dhs", "Dh", "د.إ", "dirham", "dirhams", "uae dirhams", "emirati dirham", "درهم", "دراهم", "درهم اماراتي"),
}
#: Countries as adjectives in the names of minor units, and the minor units' Arabic names (fixed values).
ADJECTIVES = {"YER": ("yemeni", "يمني"), "USD": ("us", "american", "امريكي"), "SAR": ("saudi", "سعودي"), "EUR": ("euro", "اوروبي"), "AED": ("uae", "emirati", "اماراتي")}
MINORS = {"fils": ("فلس", "فلوس"), "cent": ("سنت", "سنتات", "cents"), "halala": ("هللة", "هللات", "halalas", "halalah")}


def _key(text: str) -> str:
    return unify(squash(text))


def unit_table(currencies: Sequence) -> dict[str, list[tuple[str, Fraction]]]:
    """Every writing of a unit, squashed, to its readings: (currency, YER hundredths of one). Several readings are ambiguous."""
    table: dict[str, list[tuple[str, Fraction]]] = {}

    def put(text: str, code: str, factor: Fraction) -> None:
        readings = table.setdefault(_key(text), [])
        if (code, factor) not in readings:
            readings.append((code, factor))

    for r in currencies:
        code, rate = r["currency_code"], Fraction(int(r["yer_per_unit"]) * 100)
        names = [code, r["name_en"], r["name_ar"], *WRITINGS.get(code, ())]
        for name in names:
            put(name, code, rate)
        nouns = {str(r["name_en"]).split()[-1].casefold()} | {n for n in WRITINGS.get(code, ()) if n.isalpha()}
        for noun in nouns:
            for form in (noun, noun + "s"):
                put(form + code, code, rate)
                put(code + form, code, rate)
        minor = str(r["minor_name"])
        less = rate / int(r["minor_per_unit"])
        for form in {minor, minor + "s", *MINORS.get(minor, ())}:
            put(form, code, less)
            for country in (code, *ADJECTIVES.get(code, ()), str(r["name_en"]), str(r["name_ar"]).split()[-1]):
                put(country + form, code, less)
                put(form + country, code, less)
    return table


def readings(unit: str, table: dict[str, list[tuple[str, Fraction]]]) -> list[tuple[str, Fraction]]:
    """The readings of a squashed unit, with the scale it may carry."""
    unit = unify(unit)
    if unit in table:
        return table[unit]
    for factor, rest in split_scale(unit):
        if rest in table:
            return [(code, rate * factor) for code, rate in table[rest]]
    return []


def resolve(terms: list[tuple[float, list[float]]], identity: float, tie: float = 1e-6) -> tuple[tuple[int, ...], bool]:
    """Choose a factor for each term of a product that should equal identity: the readings with the least log residual, and whether no other does as well.

    terms: (value, candidate factors); mass = density * volume is [(density, ...), (volume, ...), (1 / mass, ...)] with identity 1.
    """
    best: list[tuple[float, tuple[int, ...]]] = []
    for pick in product(*(range(len(f)) for _, f in terms)):
        logs = sum(math.log(v * f[i]) for (v, f), i in zip(terms, pick))
        best.append((abs(logs - math.log(identity)), pick))
    best.sort()
    return best[0][1], len(best) == 1 or best[1][0] - best[0][0] > tie


def hundredths(text: str | None, said: str | None, table: dict, bare: tuple[str, Fraction] | None, column: bool) -> tuple[int | None, str]:
    """(YER hundredths, how): stated, channel, column, ambiguous, unknown, unreadable or inexact. Null unless the value is exact and its unit certain."""
    amount = None if is_blank(text) else read_amount(text)
    if amount is None:
        return None, "unreadable"
    if column:
        if is_blank(said):
            return None, "unknown"
        units, how = readings(_key(said), table), "column"
        if amount.unit and (own := readings(amount.unit, table)) and own != units:
            return None, "ambiguous"
    elif amount.unit and amount.unit in SCALES:
        units, how = ([(bare[0], bare[1] * SCALES[amount.unit])] if bare else []), "channel"
    elif amount.unit:
        units, how = readings(amount.unit, table), "stated"
    else:
        units, how = ([bare] if bare else []), "channel"
    if len(units) != 1:
        return None, "ambiguous" if units else "unknown"
    value = amount.value * units[0][1]
    return (int(value), how) if value.denominator == 1 and abs(value) < 2**63 else (None, "inexact")


def in_hundredths(df: DataFrame, currencies: DataFrame, row_id: str, amount: str = "total_amount", currency: str | None = None, channels: DataFrame | None = None, channel: str = "channel", keep: Sequence[str] = ()) -> DataFrame:
    """(row_id, yer_hundredths, how) of every row, and the columns keep as they are. The unit comes from the column currency or, without one, from the amount's text and else the channel.

    Null or blank amounts, unreadable ones, unknown or ambiguous units give a null with the reason. Empty tables give empty results.
    """
    table = unit_table(small_rows(currencies))
    kept = {f"kept_{n}": name for n, name in enumerate(keep)}
    rows = df.select(F.col(row_id).cast("long").alias("row"), F.col(amount).cast("string").alias("text"), (F.col(currency) if currency else F.lit(None)).cast("string").alias("said"), (F.col(channel) if channels is not None else F.lit(None)).cast("string").alias("_at"), *[F.col(name).alias(at) for at, name in kept.items()])
    if channels is not None:
        rules = channels.select(F.col("channel").alias("_channel"), F.col("currency_code").alias("code"), F.col("amount_scale").cast("string").alias("scale")).dropDuplicates(["_channel"])
        rows = rows.join(small(rules), F.col("_at") == F.col("_channel"), "left").drop("_channel")
    else:
        rows = rows.withColumns({"code": F.lit(None).cast("string"), "scale": F.lit(None).cast("string")})

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units: dict[str, tuple[str, Fraction] | None] = {}
        for batch in batches:
            out = []
            for text, said, code, scale in zip(*(batch.column(c).to_pylist() for c in ("text", "said", "code", "scale"))):
                bare = None
                if code is not None and scale is not None:
                    at = f"{code} {scale}"
                    if at not in units:
                        own = table.get(_key(code), [])
                        units[at] = (own[0][0], own[0][1] * Fraction(scale)) if len(own) == 1 else None
                    bare = units[at]
                out.append(hundredths(text, said, table, bare, currency is not None))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([v for v, _ in out], pa.int64()), pa.array([h for _, h in out], pa.string()), *map(batch.column, kept)], names=["row", "yer_hundredths", "how", *kept])

    schema = ", ".join(["row long, yer_hundredths long, how string", *[f"{at} {rows.schema[at].dataType.simpleString()}" for at in kept]])
    return rows.select("row", "text", "said", "code", "scale", *kept).mapInArrow(convert, schema).withColumnsRenamed({"row": row_id} | kept)


#: What a recorded number may have to be multiplied by to be in whole units: cents and the like, units, thousands, millions.
FACTORS = (0.01, 1.0, 1000.0, 1_000_000.0)


def _line_total(items: str | None, delivery: str | None) -> float | None:
    """The sum of an order's lines (their totals, else quantity times price) and its delivery cost, if all can be read."""
    found = parse_array(items) if not is_blank(items) else None
    if not found:
        return None
    total = 0.0
    for line in found:
        if not isinstance(line, dict):
            continue
        parts = []
        for name in ("total", "qty", "unit_price"):
            value = line.get(name)
            amount = read_amount(value) if isinstance(value, str) and not is_blank(value) else None
            parts.append(float(amount.value) if amount is not None else None)
        if parts[0] is not None:
            total += parts[0]
        elif parts[1] is not None and parts[2] is not None:
            total += parts[1] * parts[2]
        else:
            return None
    if not is_blank(delivery):
        cost = read_amount(delivery)
        if cost is None:
            return None
        total += float(cost.value)
    return total if total > 0 else None


def identity_scales(df: DataFrame, row_id: str = "loader_id", amount: str = "total_amount", items: str = "items", delivery: str = "delivery_cost", tolerance: float = 0.01) -> DataFrame:
    """(row_id, factor, residual, is_unique) of each row on which the identity amount * factor = sum of lines + delivery can be tried.

    The factor with the least log residual is chosen. is_unique is false if another does as well or if none comes within the
    tolerance. The identity holds within one currency: it tells the scale of an amount, never its currency. Rows with a blank or
    unreadable part, or a sum of nothing, are left out; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, factors, residuals, unique = [], [], [], []
            for row, text, lines, cost in zip(*(batch.column(c).to_pylist() for c in ("row", "text", "lines", "cost"))):
                read = None if is_blank(text) else read_amount(text)
                whole = _line_total(lines, cost)
                if read is None or read.value <= 0 or whole is None:
                    continue
                pick, only = resolve([(float(read.value), list(FACTORS)), (1 / whole, [1.0])], 1.0)
                residual = abs(math.log(float(read.value) * FACTORS[pick[0]] / whole))
                rows.append(row)
                factors.append(FACTORS[pick[0]])
                residuals.append(residual)
                unique.append(only and residual <= tolerance)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(factors, pa.float64()), pa.array(residuals, pa.float64()), pa.array(unique, pa.bool_())], names=["row", "factor", "residual", "is_unique"])

    text = lambda c, name: F.col(c).cast("string").alias(name)
    chosen = df.select(F.col(row_id).cast("long").alias("row"), text(amount, "text"), text(items, "lines"), text(delivery, "cost"))
    return chosen.mapInArrow(run, "row long, factor double, residual double, is_unique boolean").withColumnRenamed("row", row_id)
