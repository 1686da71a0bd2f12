"""Problem 8: encoding of the whole corpus with a public tokenizer of byte pairs.

Texts are cut into words by the vocabulary's pattern. The different words of the corpus are counted, and those that occur often enough are
encoded once, shard by shard: an inverted index leads from each token pair to its places in all the words of a shard, and merges are
replayed in rank order, each touching only the places of its pair and their neighbours. The dictionary that comes of it, of bounded
size, is told to every task; words that are not in it are replayed, by the same index, where they occur.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import cut, spread

#: Where the vocabulary lies: a file of base64 tokens and ranks. A parameter of every function that needs it.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that belongs to the vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words of the dictionary that every task is told: all words of the corpus, or as many of the most frequent ones.
DICTIONARY = 300_000
#: Characters of the longest word in it; words of a shard that are replayed together.
LONGEST, SHARD = 64, 50_000
#: Other words, and pairs looked up, that a task remembers at most; forgetting costs time only.
REMEMBER = 500_000
#: Documents encoded at a time.
ROWS = 1000


def read_vocabulary(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Encoder:
    """Text to token ids; special tokens are ordinary text."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.byte = [ranks[bytes([b])] for b in range(256)]
        self.find = regex.compile(pattern).findall
        self.told: tuple[list[str], np.ndarray, np.ndarray] = ([], np.zeros(0, np.int32), np.zeros(1, np.int64))
        self._forget()
        self.merged: dict[tuple[int, int], int | None] = {}

    def _merge(self, left: int, right: int) -> int | None:
        """The token that a pair merges into, which is its rank as well."""
        pair = (left, right)
        if pair not in self.merged:
            if len(self.merged) > 2 * REMEMBER:
                self.merged.clear()
            self.merged[pair] = self.ranks.get(self.tokens[left] + self.tokens[right])
        return self.merged[pair]

    def replay(self, words: list[str]) -> list[tuple[int, ...]]:
        """Encode words together by replaying the merges in rank order over an index of pairs."""
        tokens: list[int] = []
        before: list[int] = []
        after: list[int] = []
        bounds = [0]
        for word in words:
            data = word.encode("utf-8", "replace")
            start = len(tokens)
            tokens.extend(self.byte[b] for b in data)
            end = len(tokens)
            before.extend(range(start - 1, end - 1))
            after.extend(range(start + 1, end + 1))
            if end > start:
                before[start] = after[end - 1] = -1
            bounds.append(end)
        index: dict[tuple[int, int], list[int]] = {}
        for at, right in enumerate(after):
            if right >= 0:
                index.setdefault((tokens[at], tokens[right]), []).append(at)
        heap = [(rank, pair) for pair in index if (rank := self._merge(*pair)) is not None]
        heapify(heap)
        while heap:
            rank, pair = heappop(heap)
            places = index.pop(pair, None)
            if places is None:
                continue
            places.sort()
            for at in places:
                right = after[at]
                if right < 0 or tokens[at] != pair[0] or tokens[right] != pair[1]:
                    continue  # an earlier merge took one of the two
                tokens[at], tokens[right] = rank, -1
                after[at] = far = after[right]
                after[right] = -1
                if far >= 0:
                    before[far] = at
                    self._enter(index, heap, tokens, at, far)
                near = before[at]
                if near >= 0:
                    self._enter(index, heap, tokens, near, at)
        return [tuple(t for t in tokens[a:b] if t >= 0) for a, b in zip(bounds, bounds[1:])]

    def _enter(self, index: dict, heap: list, tokens: list[int], left: int, right: int) -> None:
        """Put a new pair of neighbours into the index."""
        pair = (tokens[left], tokens[right])
        places = index.get(pair)
        if places is not None:
            places.append(left)
        elif (rank := self._merge(*pair)) is not None:
            index[pair] = [left]
            heappush(heap, (rank, pair))

    def tell(self, words: list[str], flat: np.ndarray, bounds: np.ndarray) -> None:
        """Words that are encoded already: the ids of all in one array, and where each word's begin and the last end."""
        self.told = words, flat, bounds
        self._forget()

    def _forget(self) -> None:
        words, self.flat, self.bounds = self.told
        self.words = dict(zip(words, range(len(words))))

    def _learn(self, new: list[str]) -> None:
        found = self.replay(new)
        self.words.update(zip(new, range(len(self.words), len(self.words) + len(new))))
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(found), np.int32)])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum([len(x) for x in found], dtype=np.int64)])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and where each text's begin (and the last end). Null and empty texts have none."""
        found = [self.find(t) if t else () for t in texts]
        here = set(chain.from_iterable(found))
        new = here.difference(self.words)
        if len(self.words) + len(new) > len(self.told[0]) + REMEMBER:
            self._forget()
            new = here.difference(self.words)
        if new:
            self._learn(list(new))
        counts = [len(f) for f in found]
        word = np.fromiter(map(self.words.__getitem__, chain.from_iterable(found)), np.int64, sum(counts))
        size = self.bounds[word + 1] - self.bounds[word]
        ends = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(int(ends[-1])) + np.repeat(self.bounds[word] - ends[:-1], size)
        return self.flat[at], ends[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of a partition, each with the number of blocks of ROWS documents that it occurs in."""
    find = regex.compile(PATTERN).findall
    held: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        words = [w for w in held if len(w) <= LONGEST]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([held[w] for w in words], pa.int64())], names=["word", "n"])

    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            held.update(set(chain.from_iterable(find(t) for t in batch.column("_text").slice(at, ROWS).to_pylist() if t)))
            if len(held) > REMEMBER:
                yield out()
                held.clear()
    yield out()


def dictionary(df: DataFrame, text: str = "text", path: str = VOCABULARY, most: int | None = None) -> DataFrame:
    """(word, ids) of the corpus's words, each encoded once: of all of them, or of those in the most blocks of documents, at most so many.

    Words longer than LONGEST characters are left out. Materialised.
    """
    shared = df.sparkSession.sparkContext.broadcast(read_vocabulary(path))  # one entry for each token, which bounds it
    most = DICTIONARY if most is None else most
    counts = cut(df.select(F.col(text).cast("string").alias("_text")).mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    least, words = 0, 0
    for r in counts.groupBy(F.floor(F.log2("n")).alias("power")).count().orderBy(F.desc("power")).collect():  # at most 64 rows
        if words + r["count"] > most:
            least = 2 ** (r["power"] + 1)
            break
        words += r["count"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        words = [w for batch in batches for w in batch.column("word").to_pylist()]
        for at in range(0, len(words), 2 * SHARD):
            part = words[at : at + 2 * SHARD]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array(encoder.replay(part), pa.list_(pa.int32()))], names=["word", "ids"])

    shards = max(1, -(-words // SHARD), min(df.sparkSession.sparkContext.defaultParallelism, words // 5000))
    return cut(counts.where(F.col("n") >= least).select("word").repartition(shards, "word").mapInArrow(run, "word string, ids array<int>"))


def _encoded(df: DataFrame, doc_id: str, text: str, path: str, keep: tuple[str, ...], lists: bool) -> DataFrame:
    """df with the ids of its texts, or only with their number."""
    context = df.sparkSession.sparkContext
    shared = context.broadcast(read_vocabulary(path))
    kind, kinds = dict(df.dtypes)[doc_id], dict(df.dtypes)
    df = spread(df.select(*dict.fromkeys([doc_id, *keep, text])))
    known = dictionary(df, text, path).toArrow()  # at most DICTIONARY words of LONGEST characters
    ids = known["ids"].combine_chunks()
    told = context.broadcast((known["word"].to_pylist(), ids.flatten().to_numpy().astype(np.int32), np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy(), dtype=np.int64)])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        encoder.tell(*told.value)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                flat, ends = encoder.encode(part.column("_text").to_pylist())
                if lists:
                    value = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
                else:
                    value = pa.array(np.diff(ends))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], value], names=[*part.schema.names[:-1], "_value"])

    rows = df.select(F.col(doc_id).alias("_id"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(keep)], F.col(text).cast("string").alias("_text"))
    schema = ", ".join([f"_id {kind}", *[f"_{i} {kinds[c]}" for i, c in enumerate(keep)], "_value " + ("array<int>" if lists else "long")])
    return rows.mapInArrow(run, schema).toDF(doc_id, *keep, "ids" if lists else "n_tokens")


def token_ids(df: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids) of every document, without special tokens; null and empty texts have an empty list.

    Whole texts are encoded; strings of special tokens are ordinary text. Repeated rows stay repeated, an empty table gives an empty
    result and other columns are not looked at.
    """
    return _encoded(df, doc_id, text, path, (), True)


def token_counts(df: DataFrame, keep: tuple[str, ...] = (), doc_id: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(doc_id, columns to keep, n_tokens) of every document."""
    return _encoded(df, doc_id, text, path, keep, False)
