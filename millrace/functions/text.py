"""Normalising text: digits of all scripts, invisible characters, blank values, identifiers."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters without a visible mark that belong to no invisible category (fixed values).
_HOLLOW = "͏ᅟᅠ឴឵᠋᠌᠍᠏⠀ㅤﾠ"
#: The same in a Java regular expression: separators, control and format characters, hollow marks, variation selectors.
EDGE = r"[\p{Z}\p{Cc}\p{Cf}" + _HOLLOW + r"\x{fe00}-\x{fe0f}]+"


@cache
def digit_map() -> dict[int, str]:
    """Each decimal digit of any script, but ASCII, to the ASCII digit; from the character database."""
    return {c: str(unicodedata.decimal(chr(c))) for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"}


@cache
def invisible() -> str:
    """All characters that show nothing: separators, controls, format characters, hollow marks."""
    return "".join(chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("Zs", "Zl", "Zp", "Cc", "Cf")) + _HOLLOW + "".join(map(chr, range(0xFE00, 0xFE10)))


def ascii_digits(text: str) -> str:
    """Python side: digits of all scripts in ASCII."""
    return text if text.isascii() else text.translate(digit_map())


def strip_edges(text: str) -> str:
    """Python side: no white space or invisible characters at the ends."""
    return text.strip() if text.isascii() and text.strip() == text.strip(invisible()) else text.strip(invisible())


def is_blank(text: str | None) -> bool:
    return text is None or not text.strip(invisible())


def digits_col(col: Column) -> Column:
    """Digits of all scripts in ASCII; pure ASCII values skip the translation."""
    table = digit_map()
    return F.when(col.rlike(r"[^\x00-\x7F]"), F.translate(col, "".join(map(chr, table)), "".join(table.values()))).otherwise(col)


def trimmed_col(col: Column) -> Column:
    """No white space or invisible characters at the ends."""
    return F.regexp_replace(col, f"^{EDGE}|{EDGE}$", "")


def identifier_col(col: Column) -> Column:
    """The canonical form of an identifier: trimmed of all that is invisible, ASCII digits, capitals; null if blank."""
    return F.nullif(F.upper(digits_col(trimmed_col(col))), F.lit(""))


def identifier(text: str | None) -> str | None:
    """Python twin of identifier_col."""
    return (ascii_digits(strip_edges(text)).upper() or None) if text is not None else None


def squash(text: str) -> str:
    """Compatibility form, ASCII digits, case folded, nothing but letters, digits and currency marks: for comparing names."""
    text = unicodedata.normalize("NFKC", ascii_digits(text)).casefold()
    return re.sub(r"[^\w$€£¥']|_|ـ", "", text)
