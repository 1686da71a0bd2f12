"""Problem 2: mapping free-entered values to a canonical list.

The writings of the reference entries and their aliases form a trie. A value, in a plain form and cut into the parts that can be a
name, is searched in it with a Levenshtein automaton (one bit for each position of the value, one word for each number of errors),
which gives all entries within a distance that depends on the length. The nearest entry is meant; without one, or with two entries
equally near, the value is unmatched.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator, Mapping, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import ascii_digits, trimmed_col
from millrace.session import small, small_rows, spread

#: The default of the parameter aliases: other ways to write an order's status, by its English label (fixed values).
STATUS_ALIASES = {
    "Pending": ("waiting", "still waiting", "awaiting confirmation", "awaiting", "not confirmed yet", "not confirmed", "on hold", "in queue", "queued", "قيد الإنتظار", "بالانتظار", "في الانتظار", "لم يؤكد بعد", "بانتظار التأكيد", "معلق"),
    "Confirmed": ("confirm", "confirmed by phone", "order confirmed", "approved", "conf. ok", "conf ok", "confirmation received", "paid", "تم التأكيد", "مأكد", "مدفوع", "مؤكدة", "أكد العميل"),
    "Shipped": ("in transit", "on the way", "dispatched", "with the courier", "out for delivery", "sent out", "الطلب في الطريق", "تم الشحن", "في الطريق", "مشحون", "شحنت"),
    "Delivered": ("delivered ok", "handed to customer", "received by customer", "received", "complete", "completed", "تم التوصيل", "وصل للعميل", "تم التسليم للعميل", "تم الاستلام", "تسليم تم", "سلمت", "وصل"),
    "Returned": ("rtn returned", "returned to sender", "sent back", "customer sent it back", "return", "ارجاع", "إرجاع", "راجع", "مرتجعة", "أُعيد للمرسل", "مسترجع", "تم الإرجاع"),
    "Cancelled": ("cancel", "canceled", "canceled by customer", "cancelled by customer", "called off", "void", "إلغاء الطلب", "ملغى", "ملغية", "تم الإلغاء", "الغاء", "ملغي من العميل", "لاغي"),
}
#: The defaults of the parameters fillers and regions: words around a place name that are not part of it (fixed values, in plain form), and
#: words that make a part the name of a governorate, which is no city.
FILLERS = frozenset("city of town near market to pls please the centre center in at مدينه في المركز قرب السوق الي بلده".split())
REGION = frozenset("governorate gov محافظه م".split())
#: Parts of a value are separated by these, and hyphens with blanks.
_PARTS = re.compile(r"[/,،;؛|()\[\]]| - | – |\s-|-\s")
_DROP = re.compile(r"[\"'“”«»„`.:!?؟*#~]")
_JOIN = re.compile(r"(?<=\w)-(?=\w)")
#: Latin spellings of the same sound.
_SOUNDS = (("oo", "u"), ("ou", "u"), ("ee", "i"), ("q", "k"), ("v", "w"), ("ph", "f"))
_LETTERS = str.maketrans({"ى": "ي", "ة": "ه", "ـ": None, "ی": "ي", "ک": "ك", "ٱ": "ا", "ı": "i", "ß": "ss", "ø": "o", "đ": "d", "ł": "l"})


@lru_cache(200_000)
def plain(text: str) -> str:
    """Case folded, without accents, vowel signs, stretching and invisible characters; underscores and white space as one blank."""
    text = unicodedata.normalize("NFKD", ascii_digits(text)).casefold().translate(_LETTERS)
    text = "".join(c for c in text if unicodedata.category(c) not in ("Mn", "Me", "Cf", "Cc") or c in "\t\n\r")
    return re.sub(r"[\s_]+", " ", text).strip()


def key(text: str) -> str:
    """What is compared: a plain text without blanks and marks."""
    return re.sub(r"[^\w]|_", "", plain(text))


def sound(text: str) -> str:
    """A key with Latin sounds in one spelling: another path to the same entries."""
    for said, one in _SOUNDS:
        text = text.replace(said, one)
    return text


def allowed(length: int) -> int:
    """The errors allowed in a word of a length."""
    return 0 if length < 3 else 1 if length < 6 else 2 if length < 14 else 3


class Trie:
    """Writings with the ids they stand for."""

    def __init__(self, entries: Iterable[tuple[str, int]]):
        # a node: [children, ids, least and most characters below it]
        self.root: list = [{}, set(), 0, 0]
        for text, at in entries:
            if text:
                node = self.root
                for c in text:
                    node = node[0].setdefault(c, [{}, set(), 0, 0])
                node[1].add(at)
        self._measure(self.root)

    def _measure(self, node: list) -> None:
        stack = [(node, False)]
        while stack:
            node, seen = stack.pop()
            if not seen:
                stack.append((node, True))
                stack.extend((x, False) for x in node[0].values())
            else:
                low = [x[2] + 1 for x in node[0].values()] + [0] * bool(node[1])
                high = [x[3] + 1 for x in node[0].values()] + [0]
                node[2], node[3] = min(low, default=0), max(high)

    def within(self, text: str, most: int) -> dict[int, int]:
        """All ids with a writing at most that many errors from text, with the least number."""
        n = len(text)
        full = (1 << (n + 1)) - 1
        where: dict[str, int] = {}
        for i, c in enumerate(text):
            where[c] = where.get(c, 0) | 1 << i
        found: dict[int, int] = {}
        start = [(1 << (d + 1)) - 1 & full for d in range(most + 1)]
        stack = [(self.root, start, 0)]
        accept = 1 << n
        while stack:
            node, states, depth = stack.pop()
            if node[1]:
                for d, s in enumerate(states):
                    if s & accept:
                        for at in node[1]:
                            if d < found.get(at, most + 1):
                                found[at] = d
                        break
            depth += 1
            for c, below in node[0].items():
                if depth + below[2] > n + most or depth + below[3] < n - most:
                    continue
                here = where.get(c, 0)
                last = (states[0] & here) << 1
                new = [last]
                alive = last
                for d in range(1, most + 1):
                    before = states[d - 1]
                    # a match, a letter too many in the writing, another letter, a letter too many in the text
                    last = (((states[d] & here) << 1) | before | (before << 1) | (last << 1)) & full
                    new.append(last)
                    alive |= last
                if alive:
                    stack.append((below, new, depth))
        return found


class Matcher:
    """Values to the entry that is meant, 0 if none is."""

    def __init__(self, entries: Iterable[tuple[str, int]], regions: Iterable[str] = (), fillers: frozenset[str] = FILLERS, region_words: frozenset[str] = REGION):
        self.fillers, self.region_words = fillers, region_words
        self.exact: dict[str, set[int]] = {}
        pairs = [(key(text), at) for text, at in entries if text]
        for text, at in pairs:
            self.exact.setdefault(text, set()).add(at)
        self.trie = Trie(pairs)
        self.sounds = Trie((sound(text), at) for text, at in pairs)
        self.regions = {key(r) for r in regions if r}
        self.region_trie = Trie((r, 1) for r in self.regions)
        self.known: dict[str, tuple[int, frozenset[int]]] = {}

    def _nearest(self, text: str) -> tuple[int, frozenset[int]]:
        """(distance, ids) of the nearest entries of one part; distance 99 if there is none."""
        if text in self.exact:
            return 0, frozenset(self.exact[text])
        if len(self.known) > REMEMBER:
            self.known.clear()
        if text not in self.known:
            most = allowed(len(text))
            hits = self.trie.within(text, most) if most else {}
            if most and (said := sound(text)).isascii():
                for at, d in self.sounds.within(said, allowed(len(said))).items():
                    hits[at] = min(d, hits.get(at, d))
            least = min(hits.values(), default=99)
            if least < 99 and self.regions and least > 0 and min(self.region_trie.within(text, min(least, 1)).values(), default=99) <= least:
                least = 99  # a governorate, not a misspelt city
            self.known[text] = least, frozenset(at for at, d in hits.items() if d == least)
        return self.known[text]

    def _parts(self, text: str) -> list[str]:
        """The whole value and the parts of it that may be the name."""
        text = _DROP.sub("", plain(text).replace("—", " - "))
        found = [key(text)]
        for part in _PARTS.split(f" {text} "):
            words = _JOIN.sub("", part.strip(" -–")).split()
            if words and not any(w in self.region_words for w in words):
                found.append(self._bare(words))
        found.append(self._bare(re.sub(r"[^\w]+", " ", _JOIN.sub("", text)).split()))
        return [p for p in dict.fromkeys(found) if p]

    def _bare(self, words: list[str]) -> str:
        """Words without those around a name."""
        while words and words[0] in self.fillers:
            words.pop(0)
        while words and words[-1] in self.fillers:
            words.pop()
        return key(" ".join(words))

    def all(self, texts: list[str], memo: dict[str, int]) -> list[int]:
        """match() of each text; memo holds what is known, bounded: forgetting costs time only."""
        if len(memo) > REMEMBER:
            memo.clear()
        for text in set(texts).difference(memo):
            memo[text] = self.match(text)
        return [memo[t] for t in texts]

    def match(self, text: str) -> int:
        best, ids = 99, frozenset()
        for part in self._parts(text):
            if part in self.regions:
                continue
            d, at = self._nearest(part)
            if d < best:
                best, ids = d, at
            elif d == best and at:
                ids = ids & at or ids | at  # parts that name the same entry agree; others make the value ambiguous
        return next(iter(ids)) if len(ids) == 1 else 0


def city_matcher(cities: Sequence, fillers: frozenset[str] = FILLERS, region_words: frozenset[str] = REGION) -> Matcher:
    entries = [(r[c], int(r["city_id"])) for r in cities for c in ("city_name_ar", "city_name_latin")]
    return Matcher(entries, {r[c] for r in cities for c in ("governorate_ar", "governorate_latin")}, fillers, region_words)


def status_matcher(statuses: Sequence, aliases: Iterable[tuple[str, str]] | Mapping[str, Iterable[str]] = STATUS_ALIASES) -> Matcher:
    """aliases: (an entry's name or label, another way to write it) or label -> ways."""
    pairs = [(label, way) for label, ways in aliases.items() for way in ways] if isinstance(aliases, Mapping) else list(aliases)
    at = {r[c]: int(r["status_id"]) for r in statuses for c in ("status_name", "status_label")}
    return Matcher([*((name, i) for name, i in at.items()), *((way, at[label]) for label, way in pairs if label in at)])


#: Values and parts of values that a task remembers at most.
REMEMBER = 300_000


def canonical(df: DataFrame, row_id: str, value: str, matcher: Matcher, writings: DataFrame) -> DataFrame:
    """(row_id, ref_id) of each row whose value is neither blank nor exactly one of the writings; ref_id 0 is unmatched.

    Rows are matched where they are read, each different value once a task, so no value is hot and nothing is shuffled. Null and blank
    values give no row; very long texts are compared whole; repeated rows stay. An empty table gives an empty result; other columns are
    not looked at.
    """
    rows = df.select(F.col(row_id).cast("long").alias("row"), F.col(value).cast("string").alias("value")).where(F.col("value").isNotNull() & (trimmed_col(F.col("value")) != ""))
    rows = spread(rows).join(small(writings.toDF("writing").where("writing is not null").distinct()), F.col("value") == F.col("writing"), "left_anti")
    told = df.sparkSession.sparkContext.broadcast(matcher)  # of a reference list whose size is checked

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(told.value.all(batch.column("value").to_pylist(), memo), pa.int64())], names=["row", "ref_id"])

    return rows.mapInArrow(run, "row long, ref_id long").withColumnRenamed("row", row_id)


def city_ids(df: DataFrame, cities: DataFrame, row_id: str = "loader_id", value: str = "shipping_city", fillers: frozenset[str] = FILLERS, region_words: frozenset[str] = REGION) -> DataFrame:
    writings = cities.select(F.explode(F.array("city_name_ar", "city_name_latin")))
    return canonical(df, row_id, value, city_matcher(small_rows(cities), fillers, region_words), writings)


def status_ids(df: DataFrame, statuses: DataFrame, row_id: str = "delivery_id", value: str = "status", aliases: DataFrame | Mapping[str, Iterable[str]] = STATUS_ALIASES) -> DataFrame:
    """aliases: a table (entry, alias), entry being a name or label of statuses, or a mapping of labels."""
    writings = statuses.select(F.explode(F.array("status_name", "status_label")))
    ways = [(r[0], r[1]) for r in small_rows(aliases) if r[0] and r[1]] if isinstance(aliases, DataFrame) else aliases
    return canonical(df, row_id, value, status_matcher(small_rows(statuses), ways), writings)
