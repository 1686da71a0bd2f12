"""Reading an amount of money from free text: one number in figures or words, its scale, and what is said of its unit."""

from __future__ import annotations

import re
import unicodedata
from fractions import Fraction
from functools import cache
from typing import NamedTuple

from millrace.functions.text import ascii_digits, squash

#: Number words (fixed values). English, then Arabic in the spellings in use, with letters unified as by unify().
ENGLISH = {
    w: n
    for n, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())
} | {w: 20 + 10 * i for i, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split())}
ARABIC = {
    "صفر": 0, "واحد": 1, "واحده": 1, "اثنان": 2, "اثنين": 2, "ثلاث": 3, "ثلاثه": 3, "اربع": 4, "اربعه": 4, "خمس": 5, "خمسه": 5, "ست": 6, "سته": 6,
    "سبع": 7, "سبعه": 7, "ثمان": 8, "ثماني": 8, "ثمانيه": 8, "تسع": 9, "تسعه": 9, "عشر": 10, "عشره": 10, "عشرون": 20, "عشرين": 20, "ثلاثون": 30,
    "ثلاثين": 30, "اربعون": 40, "اربعين": 40, "خمسون": 50, "خمسين": 50, "ستون": 60, "ستين": 60, "سبعون": 70, "سبعين": 70, "ثمانون": 80, "ثمانين": 80,
    "تسعون": 90, "تسعين": 90, "مئه": 100, "مايه": 100, "مائه": 100, "ميه": 100, "مئتان": 200, "مئتين": 200, "مائتان": 200, "مائتين": 200,
    "ثلاثمئه": 300, "ثلاثمائه": 300, "اربعمئه": 400, "اربعمائه": 400, "خمسمئه": 500, "خمسمائه": 500, "ستمئه": 600, "ستمائه": 600,
    "سبعمئه": 700, "سبعمائه": 700, "ثمانمئه": 800, "ثمانمائه": 800, "تسعمئه": 900, "تسعمائه": 900,
}
#: Words and letters for thousands and more; those of DUAL hold their two already.
SCALES = {
    "k": 1000, "thousand": 1000, "thousands": 1000, "'000": 1000, "000s": 1000, "الف": 1000, "الاف": 1000, "m": 10**6, "mn": 10**6, "mio": 10**6,
    "million": 10**6, "millions": 10**6, "مليون": 10**6, "ملايين": 10**6, "bn": 10**9, "billion": 10**9, "billions": 10**9, "مليار": 10**9,
}
DUAL = {"الفان": 2000, "الفين": 2000, "الفا": 2000, "مليونان": 2 * 10**6, "مليونين": 2 * 10**6}

_SIGN = r"[+\-−]?"
#: Figures: plain, grouped by commas (also in pairs before the last three), by points before a decimal comma, by spaces or apostrophes.
_FIGURES = re.compile(
    r"(?:\d{1,3}(?: \d{3})+(?:\.\d+)?|\d{1,3}(?:'\d{3})+(?:\.\d+)?|\d{1,2}(?:,\d{2})+,\d{3}(?:\.\d+)?|\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d{1,3}(?:\.\d{3})+,\d+|\d+(?:\.\d+)?)"
)
_CHUNK = re.compile(_SIGN + r" ?[.,]?\d(?:[\d.,]|[ '](?=\d{3}(?!\d)))*")
_PLAIN = re.compile(r"\d+(?:\.\d+)?\Z")


class Amount(NamedTuple):
    value: Fraction
    unit: str  # what else the text says, squashed; "" if the amount is bare


@cache
def _letters() -> dict[int, str]:
    return str.maketrans({"أ": "ا", "إ": "ا", "آ": "ا", "ٱ": "ا", "ى": "ي", "ة": "ه", "ـ": None} | {chr(c): None for c in range(0x64B, 0x653)})


def unify(word: str) -> str:
    """Arabic letters that are written in several ways as one; no marks. Other text is unchanged."""
    return word if word.isascii() else word.translate(_letters())


def tidy(text: str) -> str:
    """ASCII digits and separators, plain spaces, nothing invisible."""
    text = ascii_digits(text)
    if not text.isascii():
        text = text.replace("٫", ".").replace("٬", ",").replace("’", "'").replace("−", "-")
        text = "".join(" " if (k := unicodedata.category(c)) == "Zs" else "" if k == "Cf" else c for c in text)
    return re.sub(r"\s+", " ", text).strip()


def _number(chunk: str) -> Fraction | None:
    """The value of figures if they are well-formed: the point is the decimal sign, the comma groups; if both occur the last is the decimal sign."""
    sign = -1 if chunk[0] == "-" else 1
    chunk = chunk.lstrip("+- ")
    if not _PLAIN.match(chunk):
        if not _FIGURES.fullmatch(chunk) and not re.fullmatch(r"\d+,\d{3}(?:,\d{3})*\.\d+", chunk):
            return None
        if "," in chunk and "." in chunk and chunk.rindex(",") > chunk.rindex("."):
            chunk = chunk.replace(".", "").replace(",", ".")
        chunk = re.sub("[, ']", "", chunk)
    whole, _, part = chunk.partition(".")
    return sign * Fraction(int(whole + part), 10 ** len(part))


def _words(text: str) -> Amount | None:
    """A number in words followed or preceded by the unit."""
    total = group = 0
    seen = False
    rest = []
    ended = False
    for raw in re.split(r"[\s-]+", text.casefold()):
        word = unify(raw)
        bare = word[1:] if word.startswith("و") and len(word) > 2 and (word[1:] in ARABIC or word[1:] in SCALES or word[1:] in DUAL) else word
        if word in ("and", "و") and seen:
            continue
        n = ENGLISH.get(word, ARABIC.get(bare))
        scale = {"hundred": 100}.get(word) or (SCALES.get(bare) if len(bare) > 2 else None)
        if n is None and scale is None and bare not in DUAL:
            rest.append(raw)
            ended = ended or seen
            continue
        if ended:
            return None  # a second number after the unit
        seen = True
        if bare in DUAL:
            total += DUAL[bare]
        elif scale == 100:
            group = (group or 1) * 100
        elif scale:
            total += (group or 1) * scale
            group = 0
        elif n == 100 and 0 < group < 10:
            group *= 100
        else:
            group += n
    return Amount(Fraction(total + group), squash(" ".join(rest))) if seen else None


def split_scale(unit: str) -> list[tuple[int, str]]:
    """The ways to take a word for thousands or the like off an end of a squashed unit: (what it multiplies by, the rest)."""
    unit = unify(unit)
    ways = []
    for word in sorted(SCALES, key=len, reverse=True):
        if len(word) < len(unit):
            if unit.startswith(word):
                ways.append((SCALES[word], unit[len(word) :]))
            if unit.endswith(word):
                ways.append((SCALES[word], unit[: -len(word)]))
    return ways


def read_amount(text: str) -> Amount | None:
    """The one well-formed amount in a text, or None if there is none or several. Scales stay part of the unit."""
    if _PLAIN.match(text):
        whole, _, part = text.partition(".")
        if text.isascii():
            return Amount(Fraction(int(whole + part), 10 ** len(part)), "")
    text = re.sub(r"(?<=\D)'000\b|(?<= )000s\b", " thousand ", tidy(text))
    chunks = list(_CHUNK.finditer(text))
    if not chunks:
        return _words(text) if text else None
    if len(chunks) > 1:
        return None
    m = chunks[0]
    value = _number(m[0])
    if value is None:
        return None
    before, after = text[: m.start()], text[m.end() :]
    if before[-1:].isalpha() and not before[-1:].isspace() and after[:1].isalpha() and len(before.strip()) == 1:
        return None
    if re.match(r"[-+/~]", after.strip()) or re.search(r"[-+/~]$", before.strip()):
        return None
    return Amount(value, squash(before + after))
