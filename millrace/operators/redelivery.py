"""Problem 1: messages delivered more than once.

1. Every delivery gets a time bucket; the bounds are quantiles of the arrival times, so buckets hold about equally many deliveries.
2. Each task puts the identifiers it reads into a Bloom filter per bucket, and says which it may have seen twice in one bucket. The filters,
   side by side in one matrix of bounded size, are merged in chunks and sent to all tasks.
3. A delivery whose identifier no other bucket's filter holds, and its own not twice, is definitely the only one: it is never shuffled.
4. The others, possible repeats, are stored by bucket and compared exactly: deliveries of an identifier are folded before the shuffle to the one
   that stays, and what is not among those is dropped, by its own row, so a hot identifier is no hot task.

The matrix has at most 64 MB, which every task builds and gets in two planes. Above about 20 million deliveries it screens less and less,
and above about 160 million, where most would pass anyway, it is left out: the exact comparison then takes all deliveries, folded before the
shuffle in the same way.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import identifier_col
from millrace.session import cut, micros_of

#: Time buckets; the words of the filter matrix have one bit for each.
BUCKETS = 64
#: Hash functions, and bits of a bucket's filter for each of its deliveries.
HASHES, BITS = 4, 24
#: Words of the largest filter matrix (8 bytes each), and of a chunk in which it is merged.
MOST_WORDS, CHUNK = 1 << 23, 1 << 13
#: Share of set bits in a bucket's filter from which on it tells nothing.
FULL = 0.7
#: Deliveries without an arrival time come after all others.
_LATE = 2**62


def words_for(rows: int) -> int:
    """The words of the matrix for so many deliveries: a power of two."""
    return min(MOST_WORDS, 1 << max(6, int(np.ceil(np.log2(max(rows, 1) / BUCKETS * BITS)))))


def _positions(key: np.ndarray, words: int) -> list[np.ndarray]:
    """The positions of 64-bit hashes in a matrix, by double hashing."""
    one = key.astype(np.uint64)
    two = (one >> np.uint64(32)) | np.uint64(1)
    return [((one + np.uint64(i) * two) & np.uint64(words - 1)).astype(np.int64) for i in range(HASHES)]


class BucketFilters:
    """Bloom filters of all time buckets side by side: bit b of a word belongs to bucket b. again holds what may have come twice in a bucket."""

    def __init__(self, words: int):
        self.seen, self.again = np.zeros(words, np.uint64), np.zeros(words, np.uint64)

    @staticmethod
    def _all(plane: np.ndarray, key: np.ndarray) -> np.ndarray:
        found = np.full(len(key), np.uint64(2**64 - 1))
        for at in _positions(key, len(plane)):
            found &= plane[at]
        return found

    def add(self, key: np.ndarray, bucket: np.ndarray) -> None:
        mine = np.uint64(1) << bucket.astype(np.uint64)
        order = np.lexsort((bucket, key))
        same = np.zeros(len(key), bool)
        same[order[1:]] = (key[order[1:]] == key[order[:-1]]) & (bucket[order[1:]] == bucket[order[:-1]])
        twice = same | ((self._all(self.seen, key) & mine) != 0)
        for at in _positions(key[twice], len(self.again)):
            np.bitwise_or.at(self.again, at, mine[twice])
        for at in _positions(key, len(self.seen)):
            np.bitwise_or.at(self.seen, at, mine)

    def merge(self, seen: np.ndarray, again: np.ndarray, at: int = 0) -> None:
        """Add the words of another matrix from a place on: what both hold may have come twice."""
        here = slice(at, at + len(seen))
        self.again[here] |= again | (self.seen[here] & seen)
        self.seen[here] |= seen

    def maybe(self, key: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Whether each delivery may have another of its identifier: in another bucket, or twice in its own."""
        mine = np.uint64(1) << bucket.astype(np.uint64)
        return ((self._all(self.seen, key) & ~mine) != 0) | ((self._all(self.again, key) & mine) != 0)


def _packed(chunk: int, seen: np.ndarray, again: np.ndarray) -> tuple[int, bytes, bytes]:
    return chunk, zlib.compress(seen.tobytes(), 1), zlib.compress(again.tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.uint64)


def _chunks(rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int32(), pa.binary(), pa.binary()))], names=["chunk", "seen", "again"])


_CHUNKS = "chunk int, seen binary, again binary"


def _buckets(us: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.searchsorted(bounds, us).astype(np.int64)


def _filters(rows: DataFrame, words: int, bounds: np.ndarray) -> BucketFilters:
    """The filters of all deliveries: a matrix a task, merged chunk by chunk in the tasks, put together here."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = BucketFilters(words)
        for batch in batches:
            own.add(batch.column("h").to_numpy().view(np.uint64), _buckets(batch.column("us").to_numpy(), bounds))
        for at in range(0, words, CHUNK):
            seen = own.seen[at : at + CHUNK]
            if seen.any():
                yield _chunks([_packed(at // CHUNK, seen, own.again[at : at + CHUNK])])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, BucketFilters] = {}
        for batch in batches:
            for chunk, seen, again in zip(*(c.to_pylist() for c in batch.columns)):
                held.setdefault(chunk, BucketFilters(min(CHUNK, words))).merge(_unpacked(seen), _unpacked(again))
        for chunk, x in held.items():
            yield _chunks([_packed(chunk, x.seen, x.again)])

    parts = rows.select("h", "us").mapInArrow(build, _CHUNKS)
    tasks = min(-(-words // CHUNK), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    whole = BucketFilters(words)
    for chunk in parts.repartition(tasks, "chunk").mapInArrow(merge, _CHUNKS).collect():  # the matrix, at most MOST_WORDS twice
        whole.merge(_unpacked(chunk["seen"]), _unpacked(chunk["again"]), chunk["chunk"] * CHUNK)
    return whole


def possible_repeats(rows: DataFrame, bounds: np.ndarray, count: int) -> DataFrame:
    """The deliveries (row, key, us) that the filters do not tell to be the only ones of their identifier."""
    words = words_for(count)
    if 1 - np.exp(-count / BUCKETS * HASHES / words) > FULL:
        return rows.select("row", "key", "us")
    hashed = rows.withColumn("h", F.xxhash64("key"))
    told = rows.sparkSession.sparkContext.broadcast(_filters(hashed, words, bounds))

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maybe = told.value.maybe(batch.column("h").to_numpy().view(np.uint64), _buckets(batch.column("us").to_numpy(), bounds))
            yield batch.filter(pa.array(maybe)).select(["row", "key", "us"])

    return hashed.select("row", "key", "us", "h").mapInArrow(screen, "row long, key string, us long")


def redelivered(df: DataFrame, key: str = "id_order", row_id: str = "delivery_id", at: str = "received_at") -> DataFrame:
    """The deliveries to drop: (row_id). Of each identifier the earliest delivery stays, among equals the smallest row_id.

    Identifiers are compared in canonical form. Blank or null ones identify nothing: their rows are never dropped.
    Deliveries without an arrival time come last. An empty table gives an empty result. Other columns are not looked at.
    """
    rows = df.select(F.col(row_id).cast("long").alias("row"), identifier_col(F.col(key)).alias("key"), F.coalesce(micros_of(df, at), F.lit(_LATE)).alias("us")).where("key is not null")
    shares = [i / BUCKETS for i in range(1, BUCKETS)]
    facts = rows.agg(F.count("*").alias("n"), F.percentile_approx("us", shares, 1000).alias("bounds")).first()
    repeats = cut(possible_repeats(rows, np.array(facts["bounds"] or [], np.int64), facts["n"]))
    stays = repeats.groupBy("key").agg(F.min(F.struct("us", "row")).alias("first")).select(F.col("first.row").alias("row"), "key")
    return repeats.join(stays, ["row", "key"], "left_anti").select(F.col("row").alias(row_id))


def deduplicated(df: DataFrame, key: str = "id_order", row_id: str = "delivery_id", at: str = "received_at") -> DataFrame:
    """df with exactly one delivery of each message, all its columns kept."""
    gone = redelivered(df, key, row_id, at)
    return df.join(gone, df[row_id] == gone[row_id], "left_anti")
