"""Problem 10: keyword-stuffed and link-list pages.

Neighbouring words of sentences attract each other; those of a word salad do not. Two passes: the first counts all words and all
neighbouring pairs of the corpus, the second gives each document the mean pointwise mutual information of its pairs (normalised, and
without the document's own share of the counts, so that a page cannot vouch for itself) and the shares of repeated collocations, of
collocations with a link or a tag, and of distinct words. PMI is shrunk towards independence by a constant probability, so words that the
corpus does not know say nothing, and a page counts as incoherent by its distance from the corpus's own median, whatever its size.
Counts of rare words and pairs are joined to the documents that have them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import cut

#: Pairs and words rarer than this share of all pairs are not broadcast but joined, which bounds each broadcast table by 1 / RARE entries.
RARE = 2.0**-21

#: Probability added to what is observed of a pair and to what its words let expect: evidence below it counts little, no evidence nothing.
PRIOR = 2.0**-22
#: A page is incoherent from so many median deviations below the median on; least median deviation. The pages that the median is taken of have so many words at least.
FAR, LEAST_DEVIATION, WORDS = 3.0, 0.01, 15
#: Resolution of the median.
STEPS = 10_000

_TOKEN = regex.compile(r"https?://\S+|www\.\S+|<a\s[^>]*>|[(\[]dot[)\]]|#[\p{L}\p{M}\p{N}_-]+|\p{L}[\p{L}\p{M}'’-]*(?:\.[\p{L}\p{N}][\p{L}\p{N}./-]*)?")
_LINK, _TAG = 1, 2  # codes of tokens that are no words; hashes of words are never below 16
_ENDS = (". ", "! ", "? ", "؟ ", ".\n", "!\n", "?\n", "؟\n", ")", "]", ".\r")


class _Codes(dict):
    """Token -> code: a hash of the word, or what the token is instead. Bounded; forgetting costs time only."""

    def __missing__(self, token: str) -> int:
        if len(self) > 400_000:
            self.clear()
        if token[0] == "#":
            code = _TAG
        elif token[0] in "<([" or "://" in token or token.startswith("www.") or ("." in token and self._domain(token)):
            code = _LINK
        else:
            code = xxhash.xxh3_64_intdigest(token.encode("utf-8", "surrogatepass")) | 16
        self[token] = code
        return code

    @staticmethod
    def _domain(token: str) -> bool:
        host = token.split("/")[0].rstrip(".-")
        last = host.rpartition(".")[2]
        return host.isascii() and last.isalpha() and len(last) >= 2 and len(host) >= 7


def codes(texts: list[str | None], cache: _Codes) -> tuple[np.ndarray, np.ndarray]:
    """The token codes of all texts in one array, and where each text's begin (and the last end)."""
    found = [list(map(cache.__getitem__, _TOKEN.findall(t.casefold()))) if t else [] for t in texts]
    ends = np.cumsum([0, *map(len, found)])
    flat = np.empty(int(ends[-1]), np.uint64)
    for part, at in zip(found, ends):
        flat[at : at + len(part)] = part
    return flat, ends


class Words(NamedTuple):
    """The words of a batch of documents, their pairs, and the document of each."""

    word: np.ndarray
    doc: np.ndarray
    pair: np.ndarray
    left: np.ndarray  # of each pair the place of its first word
    links: np.ndarray  # of each document
    tags: np.ndarray


def split(flat: np.ndarray, ends: np.ndarray) -> Words:
    n = len(ends) - 1
    doc = np.repeat(np.arange(n), np.diff(ends))
    links = np.bincount(doc[flat == _LINK], minlength=n)
    tags = np.bincount(doc[flat == _TAG], minlength=n)
    keep = flat >= 16
    word, doc = flat[keep], doc[keep]
    left = np.flatnonzero(doc[:-1] == doc[1:]) if len(doc) > 1 else np.zeros(0, np.int64)
    pair = word[left] * np.uint64(0x9E3779B97F4A7C15) + word[left + 1] if len(left) else np.zeros(0, np.uint64)
    return Words(word, doc, pair, left, links, tags)


class Counts(NamedTuple):
    """Sorted keys and their counts, and the number of all pairs."""

    words: np.ndarray
    word_n: np.ndarray
    pairs: np.ndarray
    pair_n: np.ndarray
    total: int

    def of(self, keys: np.ndarray, table: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The count of each key, 0 if the table does not hold it."""
        if not len(table):
            return np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return np.where(table[at] == keys, counts[at], 0)


def _mixed(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """(document, key) as a 64-bit mix of both."""
    return (key ^ (doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0x9E3779B97F4A7C15)


def _own(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """How often each key occurs in its own document."""
    _, at, n = np.unique(_mixed(doc, key), return_inverse=True, return_counts=True)
    return n[at]


def _npmi(pair_n: np.ndarray, left_n: np.ndarray, right_n: np.ndarray, total: int) -> np.ndarray:
    """Normalised PMI by the counts outside the page, shrunk towards 0 where there is little evidence."""
    total = max(total, 1)
    pair = pair_n / total + PRIOR
    return np.clip(np.log(pair / (left_n / total * (right_n / total) + PRIOR)) / np.maximum(-np.log(pair), 1e-9), -1, 1)


class Open(NamedTuple):
    """What the kept counts leave open: the pairs (each once a document) that have a count, their own or a word's, which is not kept.

    A number of a term from 0 is a count outside the page; one below stands for the cold key at place -1 - number of its document.
    """

    terms: np.ndarray  # pair, left and right word, occurrences; a row for each
    term_doc: np.ndarray
    is_pair: np.ndarray  # of each cold key, in order of documents
    key: np.ndarray
    own: np.ndarray
    key_doc: np.ndarray


def _left_open(w: Words, at: np.ndarray, word_n: np.ndarray, pair_n: np.ndarray, own_word: np.ndarray, own_pair: np.ndarray) -> Open:
    """at: the places of the pairs that are open."""
    doc = w.doc[w.left]
    at = at[np.unique(_mixed(doc[at], w.pair[at]), return_index=True)[1]]
    at = at[np.argsort(doc[at], kind="stable")]
    left = w.left[at]
    sides = ((w.pair[at], pair_n[at], own_pair[at]), *((w.word[x], word_n[x], own_word[x]) for x in (left, left + 1)))
    key, n, own = (np.concatenate(x) for x in zip(*sides))
    is_pair, of = np.repeat([True, False, False], len(at)), np.tile(doc[at], 3)
    terms = np.maximum(n - own, 0)
    cold = np.flatnonzero(n == 0)
    _, first, slot = np.unique(_mixed(of[cold], key[cold] ^ is_pair[cold].astype(np.uint64)), return_index=True, return_inverse=True)
    order = np.argsort(of[cold[first]], kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    kept = cold[first[order]]
    terms[cold] = np.searchsorted(of[kept], of[cold]) - place[slot] - 1
    return Open(np.stack([*terms.reshape(3, -1), own_pair[at]], 1).astype(np.int64), doc[at], is_pair[kept], key[kept], own[kept], of[kept])


def measured(texts: list[str | None], cache: _Codes, counts: Counts) -> tuple[dict[str, np.ndarray], Open | None]:
    """The features of each document, with coherence as a sum over the pairs whose counts are all kept, and what is left open."""
    w = split(*codes(texts, cache))
    n = len(texts)
    own_word, own_pair = _own(w.doc, w.word), _own(w.doc[w.left], w.pair)
    word_n, pair_n = counts.of(w.word, counts.words, counts.word_n), counts.of(w.pair, counts.pairs, counts.pair_n)
    closed = (pair_n > 0) & (word_n[w.left] > 0) & (word_n[w.left + 1] > 0) if len(w.left) else np.zeros(0, bool)
    at, out = w.left[closed], word_n - own_word
    npmi = _npmi(pair_n[closed] - own_pair[closed], out[at], out[at + 1], counts.total)
    doc = w.doc[w.left]
    words, pairs, marks = np.bincount(w.doc, minlength=n), np.bincount(doc, minlength=n), w.links + w.tags
    found = {
        "words": words,
        "links": w.links,
        "tags": w.tags,
        "coherence": np.bincount(doc[closed], npmi, n),
        "repeated": np.bincount(doc, own_pair >= 3, n) / np.maximum(pairs, 1),
        "marked": np.where(marks >= 4, 2 * marks / np.maximum(2 * marks + pairs, 1), 0),
        "distinct": np.bincount(w.doc, 1 / own_word, n) / np.maximum(words, 1) if len(w.doc) else np.zeros(n),
        "sentences": np.array([0 if not t else sum(map(t.count, _ENDS)) + (t.rstrip()[-1:] in ".!?؟") for t in texts], np.int64),
        "pairs": pairs,
    }
    return found, None if closed.all() else _left_open(w, np.flatnonzero(~closed), word_n, pair_n, own_word, own_pair)


def close(f: dict[str, np.ndarray], terms: np.ndarray, term_doc: np.ndarray, outside: np.ndarray, begins: np.ndarray, total: int) -> dict[str, np.ndarray]:
    """The features with the open terms counted in. outside: counts outside the page of the cold keys; begins: where each document's begin."""
    n = len(f["pairs"])
    values = terms[:, :3].copy()
    row, side = np.nonzero(values < 0)
    values[row, side] = outside[begins[term_doc[row]] - 1 - values[row, side]]
    more = np.bincount(term_doc, _npmi(values[:, 0], values[:, 1], values[:, 2], total) * terms[:, 3], n)
    return {k: (v + more) / np.maximum(f["pairs"], 1) if k == "coherence" else v for k, v in f.items() if k != "pairs"}


_NONE = np.zeros(0, np.int64)


def features(texts: list[str | None], cache: _Codes, counts: Counts) -> dict[str, np.ndarray]:
    """Of each document: words, links, tags, coherence (mean normalised PMI), repeated (share of pairs that occur three times or more),
    marked (share of collocations with a link or tag, each link and each tag being the same word; 0 below four of them), distinct (share of
    distinct words), sentences.

    Keys that are not in counts do not occur outside the page.
    """
    f, rest = measured(texts, cache, counts)
    if rest is None:
        return close(f, np.zeros((0, 4), np.int64), _NONE, _NONE, _NONE, counts.total)
    return close(f, rest.terms, rest.term_doc, np.zeros(len(rest.key), np.int64), np.searchsorted(rest.key_doc, np.arange(len(texts))), counts.total)


def usual(found: DataFrame) -> tuple[float, float]:
    """The median coherence of the corpus's pages, and the median deviation from it; by a histogram of at most 2 * STEPS + 1 bars."""
    bars = found.where(F.col("words") >= WORDS).groupBy(F.round(F.col("coherence") * STEPS).cast("int").alias("at")).agg(F.count("*").alias("n")).collect()
    if not bars:
        return 0.0, LEAST_DEVIATION
    at, n = np.array([r["at"] for r in bars]), np.array([r["n"] for r in bars])

    def median(x: np.ndarray) -> int:
        order = np.argsort(x, kind="stable")
        return int(x[order][np.searchsorted(np.cumsum(n[order]), n.sum() / 2)])

    middle = median(at)
    return middle / STEPS, max(median(np.abs(at - middle)) / STEPS, LEAST_DEVIATION)


def stuffed(middle: float, deviation: float) -> Column:
    """Whether a page is spam by its features, in a corpus with that median coherence and deviation.

    Incoherent word salad: neighbours that attract each other far less than in the corpus's other pages, on a page without sentences
    (keyword and product lists) or one that strings few words together (lists of names and speeches have many). Excessively repeated
    collocations: of links or tags with whatever stands beside them, or of a small vocabulary without sentences. Repeated cries and
    formulas are sentences or short.
    """
    words = F.col("words")
    flat = F.col("sentences") * 30 < words
    incoherent = F.col("coherence") < middle - FAR * deviation
    salad = incoherent & (((words >= WORDS) & flat) | ((words >= 50) & (F.col("distinct") < 0.3)))
    collocations = (F.col("marked") >= 0.15) | ((words >= 20) & flat & (F.col("distinct") < 0.5) & (F.col("repeated") > 0.25))
    return salad | collocations


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words and pairs of a partition with their counts, folded batch by batch."""
    cache = _Codes()
    held: dict[bool, list[tuple[np.ndarray, np.ndarray]]] = {False: [], True: []}

    def fold(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return keys, np.bincount(at, np.concatenate([c for _, c in parts])).astype(np.int64)

    def out(is_pair: bool) -> pa.RecordBatch:
        keys, n = fold(held[is_pair])
        held[is_pair] = []
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), is_pair)), pa.array(keys.view(np.int64)), pa.array(n)], names=["pair", "key", "n"])

    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            w = split(*codes(batch.column("text")[at : at + 2000].to_pylist(), cache))
            for is_pair, keys in ((False, w.word), (True, w.pair)):
                if len(keys):
                    held[is_pair].append(np.unique(keys, return_counts=True))
                if sum(len(k) for k, _ in held[is_pair]) > 4_000_000:
                    held[is_pair] = [fold(held[is_pair])]
                    if len(held[is_pair][0][0]) > 2_000_000:
                        yield out(is_pair)
    for is_pair in (False, True):
        if held[is_pair]:
            yield out(is_pair)


def _sums(df: DataFrame, text: str) -> tuple[DataFrame, int]:
    """(pair, key, n) of all words and neighbouring pairs, materialised, and the number of all pairs."""
    parts = df.select(F.col(text).cast("string").alias("text")).mapInArrow(_count, "pair boolean, key long, n long")
    sums = cut(parts.groupBy("pair", "key").agg(F.sum("n").alias("n")))
    return sums, sums.where("pair").agg(F.sum("n")).first()[0] or 0


def _kept(sums: DataFrame, total: int) -> Counts:
    kept = sums.where(F.col("n") >= RARE * total).toArrow()
    tables = []
    for is_pair in (False, True):
        t = kept.filter(pa.compute.equal(kept["pair"], is_pair)) if kept.num_rows else kept
        keys, n = t["key"].to_numpy().view(np.uint64), t["n"].to_numpy()
        order = np.argsort(keys)
        tables += [keys[order], n[order]]
    return Counts(*tables, total)


def corpus_counts(df: DataFrame, text: str = "text") -> Counts:
    """Counts of all words and neighbouring pairs; those with at least the share RARE of all pairs come to the driver, at most 1 / RARE of each."""
    return _kept(*_sums(df, text))


_FEATURES = {c: "long" if c in ("words", "links", "tags", "sentences") else "double" for c in ("words", "links", "tags", "coherence", "repeated", "marked", "distinct", "sentences")}


def _columns(f: dict[str, np.ndarray]) -> list[pa.Array]:
    return [pa.array(f[c]).cast(pa.int64() if kind == "long" else pa.float64()) for c, kind in _FEATURES.items()]


def _lists(values: np.ndarray, doc: np.ndarray, n: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)), pa.int32()), pa.array(values))


def page_features(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The features of each document and whether it is stuffed: (doc_id, words, links, tags, coherence, repeated, marked, distinct, sentences, stuffed).

    Counts are exact: the frequent ones are broadcast, a document's others are joined to the sums, each once. A null or empty text has
    no words and is not stuffed; whole texts are read. An empty table gives an empty result; other columns are not looked at.
    """
    found = cut(_measured_pages(df, doc_id, text))
    return found.withColumn("stuffed", stuffed(*usual(found))).withColumnRenamed("doc", doc_id)


def _measured_pages(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    context = df.sparkSession.sparkContext
    sums, total = _sums(df, text)
    shared = context.broadcast(_kept(sums, total))
    schema = "doc long, " + ", ".join(f"{c} {kind}" for c, kind in _FEATURES.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Codes()
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                f = features(part.column("text").to_pylist(), cache, shared.value)
                yield pa.RecordBatch.from_arrays([part.column("doc"), *_columns(f)], names=["doc", *_FEATURES])

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Codes()
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                n = part.num_rows
                f, rest = measured(part.column("text").to_pylist(), cache, shared.value)
                if rest is None:
                    rest = Open(np.zeros((0, 4), np.int64), _NONE, np.zeros(0, bool), np.zeros(0, np.uint64), _NONE, _NONE)
                ends = np.searchsorted(rest.term_doc, np.arange(n + 1)).tolist()
                terms = pa.array([rest.terms[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())
                lists = [_lists(x, rest.key_doc, n) for x in (rest.is_pair, rest.key.view(np.int64), rest.own.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([part.column("doc"), *_columns(f), pa.array(f["pairs"]).cast(pa.int64()), terms, *lists], names=["doc", *_FEATURES, "pairs", "terms", "is_pair", "key", "own"])

    def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            f = {c: batch.column(c).to_numpy() for c in (*_FEATURES, "pairs")}
            terms = batch.column("terms").to_pylist()
            term_doc = np.repeat(np.arange(n), [len(t) // 32 for t in terms])
            own, found = batch.column("own"), batch.column("found")
            begins = np.cumsum([0, *own.value_lengths().to_pylist()])
            outside = -own.flatten().to_numpy()
            joined = found.flatten()
            doc = np.repeat(np.arange(n), np.array([x or 0 for x in found.value_lengths().to_pylist()], np.int64))
            outside[begins[doc] + joined.field("place").to_numpy()] += joined.field("n").to_numpy()
            f = close(f, np.frombuffer(b"".join(terms), np.int64).reshape(-1, 4), term_doc, outside, begins, total)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), *_columns(f)], names=["doc", *_FEATURES])

    rows = df.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    if RARE * total <= 1:  # all counts are kept
        return rows.mapInArrow(run, schema)
    begun = cut(rows.mapInArrow(begin, f"{schema}, pairs long, terms binary, is_pair array<boolean>, key array<long>, own array<long>").withColumn("row", F.monotonically_increasing_id()))
    cold = begun.select("row", F.posexplode(F.arrays_zip("is_pair", "key")).alias("place", "k")).select("row", "place", F.col("k.is_pair").alias("pair"), "k.key")
    counted = cold.join(sums.where(F.col("n") < RARE * total), ["pair", "key"]).groupBy("row").agg(F.collect_list(F.struct("place", "n")).alias("found"))
    whole = begun.drop("is_pair", "key").join(counted, "row", "left").drop("row")
    return whole.select("doc", *_FEATURES, "pairs", "terms", "own", "found").mapInArrow(end, schema)
