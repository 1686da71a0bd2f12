"""Cleaning primitives of the order pipeline as column expressions; none of them leaves the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the cleaning rules.
ARABIC_DIGITS = ("٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789")
NUMBER_WORDS = {
    "ألف": 1000, "الف": 1000, "ألفان": 2000, "الفان": 2000, "ألفين": 2000, "الفين": 2000, "ثلاثة آلاف": 3000, "أربعة آلاف": 4000,
    "خمسة آلاف": 5000, "عشرة آلاف": 10000, "مئة ألف": 100000, "مليون": 1000000,
}
STATUS_SYNONYMS = {
    "مؤكد": "مؤكد", "مدفوع": "مؤكد", "قيد الانتظار": "قيد الانتظار", "قيد الشحن": "قيد الشحن", "تم التسليم": "تم التسليم", "مرتجع": "مرتجع",
    "ملغي": "ملغي", "confirmed": "مؤكد", "pending": "قيد الانتظار", "shipped": "قيد الشحن", "delivered": "تم التسليم", "cancelled": "ملغي",
}
YER_SYNONYMS = ("ريال يمني", "ريال", "ر.ي", "yer", "yr", "لاير")
FOREIGN = ("USD", "EUR", "SAR", "AED", "GBP", "دولار", "سعودي", "$", "€", "£", "¥", "درهم", "دينار")
FOREIGN_CODES = {"دولار": "USD", "$": "USD", "سعودي": "SAR"}
PHONE_PATTERN = r"^(967)?(77|73|70|71)\d{7}$"
EMAIL_PATTERN = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
ISO_PATTERN = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?([+-]\d{2}:\d{2})?)?$"
#: What a number may look like after cleaning; keeps out spellings that only one engine reads.
NUMBER_PATTERN = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def strip(col: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: without it, nested cleaners would multiply the size of the expression."""
    return F.transform(F.array(value), body)[0]


def lookup(col: Column, table: dict) -> Column:
    """The table's value for a text, null if it has none."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), col)


def _any(names: Sequence[str]) -> str:
    """A pattern for any of the names, in any case."""
    return "(?iu)" + "|".join(re.escape(n) for n in names)


def arabic_digits(col: Column) -> Column:
    return F.translate(col, *ARABIC_DIGITS)


def thousands(col: Column) -> Column:
    """Without grouping commas and without white space between digits."""
    return F.regexp_replace(F.translate(col, ",٬", ""), r"(?U)(?<=\d)\s+(?=\d)", "")


def _foreign(text: Column) -> Column:
    """The first foreign name, in the list's order, that a text holds in any case."""
    upper = F.upper(text)
    return let(upper, lambda u: F.coalesce(*[F.when(F.contains(u, F.lit(n.upper())), F.lit(n)) for n in FOREIGN]))


def currency_code(col: Column) -> Column:
    """The currency a text names: a foreign one first, in the list's order; else YER if one of its synonyms occurs; else null."""
    codes = {n: FOREIGN_CODES.get(n, n.upper()) for n in FOREIGN}
    return let(strip(col), lambda t: F.coalesce(lookup(_foreign(t), codes), F.when(t.rlike(_any(YER_SYNONYMS)), F.lit("YER"))))


def without_currency(col: Column) -> Column:
    """The text without the name of the currency that currency_code finds in it: that foreign name, or all synonyms of the home currency."""

    def without(both: Column) -> Column:
        foreign = strip(F.regexp_replace(both["text"], F.concat(F.lit("(?iu)\\Q"), both["name"], F.lit("\\E")), F.lit("")))
        return F.when(both["name"].isNotNull(), foreign).otherwise(strip(F.regexp_replace(both["text"], _any(YER_SYNONYMS), "")))

    return let(strip(col), lambda t: let(F.struct(t.alias("text"), _foreign(t).alias("name")), without))


def number_word(col: Column) -> Column:
    """The number that an amount in words is, null for other texts."""
    return lookup(strip(col), NUMBER_WORDS)


def phone(col: Column) -> Column:
    """Digits with the country code where the number is a local one; null becomes empty."""
    digits = F.regexp_replace(F.regexp_replace(arabic_digits(col), r"[^0-9]", ""), "^00967", "967")
    local = F.regexp_replace(digits, r"^0((?:77|73|70|71)\d{7})$", "$1")
    return F.coalesce(F.regexp_replace(local, r"^((?:77|73|70|71)\d{7})$", "967$1"), F.lit(""))


def email(col: Column) -> Column:
    """Stripped, runs of @ and of points as one; null becomes empty."""
    return F.coalesce(F.regexp_replace(F.regexp_replace(strip(col), "@+", "@"), r"\.+", "."), F.lit(""))


def date(col: Column) -> Column:
    """A date with slashes, blanks or other digits in ISO form; other texts as they are. A blank between date and time is lost with the rest (kept so for parity)."""

    def iso(parts: Column) -> Column:
        two = [F.regexp_replace(parts["day"][i], "^(.?)$", "0$1") for i in (1, 2)]
        two = [F.regexp_replace(x, "^0$", "00") for x in two]
        return F.when((F.size(parts["day"]) == 3) & (F.length(parts["day"][0]) == 4), F.concat(parts["day"][0], F.lit("-"), two[0], F.lit("-"), two[1], parts["clock"]))

    def split(tidy: Column) -> Column:
        day = F.split(F.translate(F.translate(F.substring_index(tidy, "T", 1), " ", ""), "/", "-"), "-")
        clock = F.coalesce(F.concat(F.lit("T"), strip(F.nullif(F.regexp_extract(tidy, "T(.*)$", 1), F.lit("")))), F.when(F.contains(tidy, F.lit("T")), F.lit("T")), F.lit(""))
        return let(F.struct(day.alias("day"), clock.alias("clock")), iso)

    def change(both: Column) -> Column:
        touched = both["new"].rlike("[/ ]") | (both["new"] != both["old"])
        return F.coalesce(F.when(touched, let(F.regexp_replace(strip(both["new"]), r"(?U)\s+", " "), split)), both["old"])

    return let(F.struct(col.alias("old"), arabic_digits(col).alias("new")), change)


def number(col: Column) -> Column:
    """The number in a text with foreign digits, separators, currency names or number words, as double; null if it holds none."""
    text = F.translate(arabic_digits(col), "٫", ".")
    return let(strip(without_currency(thousands(text))), lambda t: F.coalesce(number_word(t).cast("double"), F.when(t.rlike(NUMBER_PATTERN), t.try_cast("double"))))


def status(col: Column) -> Column:
    """The canonical status of a synonym, other texts stripped."""
    return let(strip(col), lambda t: F.coalesce(lookup(t, STATUS_SYNONYMS), t))


def is_iso(col: Column) -> Column:
    """Whether a text is an ISO date or timestamp that exists."""
    text = F.regexp_replace(strip(col), "[Zz]$", "+00:00")
    return let(text, lambda t: F.coalesce(t.rlike(ISO_PATTERN) & t.try_cast("timestamp").isNotNull(), F.lit(False)))


def json_value(col: Column) -> Column:
    """The variant of a JSON text; null if it is none. try_parse_json alone takes a value with anything behind it.

    What stands behind a value can fit behind it in an object or in an array, but never in both.
    """
    inside = F.try_variant_get(F.try_parse_json(F.concat(F.lit('{"v":'), col, F.lit("}"))), "$.v", "variant")
    return F.when(F.try_parse_json(F.concat(F.lit("["), col, F.lit("]"))).isNotNull(), inside)


def content_key(id_order: Column, columns: Sequence[str]) -> Column:
    """The trimmed identifier, or HASH_ and the SHA-256 of the row's content with sorted keys and all values as text."""
    content = F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("None")).alias(c) for c in sorted(columns)]))
    return F.coalesce(F.nullif(strip(id_order), F.lit("")), F.concat(F.lit("HASH_"), F.sha2(content, 256)))
