"""Problem 3: the best representative of each duplicate group, field by field.

Two ways to choose. survivors() takes each field from the record of the most trusted source, then the latest, as given priors fix it.
posterior_values() is Bayesian fusion with copy detection: sources vote with the log odds of their estimated accuracy, a source that
shares false values with another loses most of its vote where the two agree, and accuracies and votes are estimated in turn.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from millrace.functions.text import EDGE, identifier_col, trimmed_col
from millrace.operators.timestamps import instants
from millrace.session import cut, is_small, small

#: The fields of an order that are fused.
FIELDS = ("customer.name", "customer.phone", "customer.email", "customer.address.city", "customer.address.district", "payment.method", "delivery.type")
#: Stand-ins for a missing value, trimmed and in small letters (fixed values); texts without any letter or digit are too.
STAND_INS = (
    "n/a", "na", "n.a.", "none", "null", "nil", "nan", "unknown", "undefined", "missing", "not set", "not given", "not available", "tbd", "xxx",
    "غير معروف", "غير محدد", "غير متوفر", "غير متاح", "لا يوجد", "لايوجد", "مجهول", "بدون",
)
#: Fusion: rounds, false values that a field may take, prior chance that two sources copy, chance that a copier copies a value.
ROUNDS, FALSE_VALUES, COPY_PRIOR, COPY_RATE = 4, 20, 0.1, 0.8
#: Pairs of sources with a claim in common that can be told to every task, and sums that a task holds at a time.
PAIRS, HELD = 1_000_000, 500_000


def given(value: Column) -> Column:
    """The value trimmed, or null if it is blank or a mere stand-in for a missing one."""
    text = trimmed_col(value)
    return F.when(text.rlike(r"[\p{L}\p{N}]") & ~F.lower(F.regexp_replace(text, EDGE, " ")).isin(*STAND_INS), text)


@F.pandas_udf(LongType())
def _instant(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in values:
        us, ok = instants(batch.where(batch.notna(), None).tolist(), ["UTC"] * len(batch), [None] * len(batch))
        yield pd.Series(us).where(pd.Series(ok))


def _records(df: DataFrame, fields: Sequence[str], key: str, record_id: str, source: str, updated: str) -> DataFrame:
    """key, record, source, instant of the last update, and each field's given value as f0, f1, ..."""
    values = [given(F.col(f).cast("string")).alias(f"f{i}") for i, f in enumerate(fields)]
    rows = df.select(identifier_col(F.col(key)).alias("key"), F.col(record_id).cast("long").alias("record"), F.col(source).alias("source"), _instant(F.col(updated).cast("string")).alias("us"), *values)
    return rows.where("key is not null")


def survivors(df: DataFrame, trust: DataFrame, fields: Sequence[str] = FIELDS, key: str = "id_order", record_id: str = "record_id", source: str = "source_system", updated: str = "updated_at", least: int = 2) -> DataFrame:
    """(key, field, record_id) for each identifier with at least so many records and each field that one of them gives.

    The record is that of the highest trust (0 if its source is missing or not listed), then the latest update (unreadable = oldest, without
    a zone = UTC), then the smallest id. Identifiers are compared in canonical form, blank ones identify nothing. Repeated rows count
    as records. An empty table gives an empty result. The fold starts before the shuffle, so a hot identifier is no hot task.
    """
    rows = _records(df, fields, key, record_id, source, updated)
    weights = trust.select(F.col("source_system").alias("_source"), F.col("trust").cast("long").alias("trust")).groupBy("_source").agg(F.max("trust").alias("trust"))
    rows = rows.join(small(weights), F.col("source") == F.col("_source"), "left")
    rank = [F.coalesce("trust", F.lit(0)), F.coalesce("us", F.lit(-(2**63))), -F.col("record")]
    best = [F.max(F.when(F.col(f"f{i}").isNotNull(), F.struct(*rank))).alias(f"b{i}") for i in range(len(fields))]
    found = rows.groupBy("key").agg(F.count("*").alias("n"), *best).where(F.col("n") >= least)
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"b{i}.col3").alias("minus")) for i, f in enumerate(fields)])
    return found.select(F.col("key").alias(key), F.inline(pairs)).where("minus is not null").select(key, "field", (-F.col("minus")).alias(record_id))


USUAL_VOTE = math.log(FALSE_VALUES * 0.8 / 0.2)


class _Beliefs(NamedTuple):
    """What a round knows: votes by source and field, the order of the sources, what a source's vote keeps beside one it may copy."""

    votes: dict[tuple[str, str], float]  # a source that no claim has been compared of has the usual one
    order: dict[str, int]
    keep: dict[tuple[str, str], float]

    def judge(self, field: str, claims: list[tuple[str, str]]) -> tuple[str, float, int]:
        """(value, posterior, support) of the best value that (source, value) claims name, among equals the smallest."""
        by: dict[str, list[str]] = {}
        for source, value in claims:
            by.setdefault(value, []).append(source)
        scores = {}
        for value, sources in by.items():
            sources.sort(key=lambda s: (self.order.get(s, len(self.order)), s))
            scores[value] = 0.0
            for i, source in enumerate(sources):
                vote = self.votes.get((source, field), USUAL_VOTE)
                for other in sources[:i]:
                    vote *= self.keep.get((source, other), 1.0)
                scores[value] += vote
        best = min(scores, key=lambda v: (-scores[v], v))
        return best, 1 / sum(math.exp(x - scores[best]) for x in scores.values()), len(by[best])


def _beliefs(names: Sequence[str], fields: Sequence[str], accuracy: dict[tuple[str, str], float], depends: dict[tuple[str, str], float]) -> _Beliefs:
    def mean(s: str) -> float:
        own = [accuracy[s, f] for f in fields if (s, f) in accuracy]
        return sum(own) / len(own) if own else 0.8

    order = {s: i for i, s in enumerate(sorted(names, key=lambda s: (-mean(s), s)))}
    votes = {}
    for s in names:
        for f in fields:
            p = min(0.99, max(0.01, accuracy.get((s, f), 0.8)))
            votes[s, f] = math.log(FALSE_VALUES * p / (1 - p))
    return _Beliefs(votes, order, {pair: max(1e-3, 1 - COPY_RATE * p) for pair, p in depends.items()})


def _copying(pairs: dict[tuple[str, str], list[int]], accuracy: dict[str, float]) -> dict[tuple[str, str], float]:
    """The chance that two sources depend on each other, from the numbers of claims where both are right, both wrong alike, and different."""
    out = {}
    for (a, b), (right, wrong, unlike) in pairs.items():
        e = max(0.01, 1 - (accuracy.get(a, 0.8) + accuracy.get(b, 0.8)) / 2)
        alone = ((1 - e) ** 2, e * e / FALSE_VALUES, max(1e-9, 1 - (1 - e) ** 2 - e * e / FALSE_VALUES))
        tied = tuple(COPY_RATE * p + (1 - COPY_RATE) * q for p, q in zip((1 - e, e, 1e-9), alone))
        logs = sum(k * math.log(t / q) for k, t, q in zip((right, wrong, unlike), tied, alone))
        odds = math.log(COPY_PRIOR / (1 - COPY_PRIOR)) + max(-50, min(50, logs))
        out[a, b] = out[b, a] = 1 / (1 + math.exp(-odds))
    return out


def posterior_values(df: DataFrame, fields: Sequence[str] = FIELDS, key: str = "id_order", record_id: str = "record_id", source: str = "source_system", updated: str = "updated_at", rounds: int = ROUNDS) -> DataFrame:
    """(key, field, value, posterior, support): the value of each field with the greatest posterior, among equals the smallest value.

    A source has one claim for a field of an identifier: its latest given value (then the smallest record id). Records without a source
    have a source of their own. Support is the number of sources that claim the value. Blank identifiers are left out; an empty
    table gives an empty result. Claims are shuffled once as a row for each source of an identifier; a round is one pass that only sends
    sums of sources and pairs of sources. Sources may be any number; more than PAIRS pairs of them with claims in common are an error.
    """
    rows = _records(df, fields, key, record_id, source, updated).withColumn("source", F.coalesce("source", F.lit("")))
    names = [f"f{i}" for i in range(len(fields))]
    latest = [F.max(F.when(F.col(f).isNotNull(), F.struct(F.coalesce("us", F.lit(-(2**63))), -F.col("record"), f))).alias(f"b_{f}") for f in names]
    folded = rows.groupBy("key", "source").agg(*latest).select("key", "source", *[F.col(f"b_{f}.{f}").alias(f) for f in names])
    # one element for each source of an identifier
    groups = cut(folded.where(F.coalesce(*names).isNotNull()).groupBy("key").agg(*[F.collect_list(F.struct("source", f)).alias(f) for f in names]))

    def claims(batch: pa.RecordBatch, f: str) -> tuple[np.ndarray, list[str], list[str]]:
        """The bounds of each identifier's claims for a field among all of the batch, their sources and their values."""
        lists = batch.column(f)
        parts = lists.flatten()
        given = parts.field(1).is_valid()
        ends = np.concatenate([[0], np.cumsum(given.to_numpy(zero_copy_only=False))])
        bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        parts = parts.filter(given)
        return ends[bounds], parts.field(0).to_pylist(), parts.field(1).to_pylist()

    accuracy: dict[tuple[str, str], float] = {}
    depends: dict[tuple[str, str], float] = {}
    sources: set[str] = set()
    for turn in range(rounds - 1):
        told = df.sparkSession.sparkContext.broadcast(_beliefs(sorted(sources), fields, accuracy, depends))

        def tally(batches: Iterator[pa.RecordBatch], told=told, turn=turn) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple[str, str, str], list[int]] = {}

            def out() -> pa.RecordBatch:
                found = [(*k, *n, k[1] == "") for k, n in sums.items()]
                sums.clear()
                return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()))], names=list("sfoabcp"))

            for batch in batches:
                for field, f in zip(fields, names):
                    bounds, all_who, all_what = claims(batch, f)
                    for at in np.flatnonzero(np.diff(bounds) > 1).tolist():
                        who, what = all_who[bounds[at] : bounds[at + 1]], all_what[bounds[at] : bounds[at + 1]]
                        true = told.value.judge(field, list(zip(who, what)))[0]
                        for i, (s, v) in enumerate(zip(who, what)):
                            one = sums.setdefault((s, field, ""), [0, 0, 0])
                            one[0] += v == true
                            one[1] += 1
                            for t, w in zip(who[:i], what[:i]):
                                two = sums.setdefault((min(s, t), "", max(s, t)), [0, 0, 0])
                                # what the majority says is no truth yet: at first only agreeing always tells
                                two[2 if v != w else 0 if turn == 0 or v == true else 1] += 1
                    if len(sums) > HELD:
                        yield out()
            yield out()

        found = groups.mapInArrow(tally, "s string, f string, o string, a long, b long, c long, p boolean")
        found = cut(found.groupBy("s", "f", "o", "p").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("c").alias("c")))
        if not is_small(found, PAIRS):
            raise ValueError(f"copy detection compares at most {PAIRS} pairs of sources that have claims in common")
        sums = found.collect()
        sources = {r["s"] for r in sums} | {r["o"] for r in sums if r["p"]}
        # first only who depends on whom, with equal accuracies: copied mistakes must not make their sources look right
        if turn:
            accuracy = {(r["s"], r["f"]): (r["a"] + 4) / (r["b"] + 5) for r in sums if not r["p"]}
        means = {s: [accuracy[s, f] for f in fields if (s, f) in accuracy] for s in sources} if accuracy else {}
        depends = _copying({(r["s"], r["o"]): [r["a"], r["b"], r["c"]] for r in sums if r["p"]}, {s: sum(m) / len(m) for s, m in means.items() if m})
    told = df.sparkSession.sparkContext.broadcast(_beliefs(sorted(sources), fields, accuracy, depends))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for field, f in zip(fields, names):
                bounds, who, what = claims(batch, f)
                at = np.flatnonzero(np.diff(bounds) > 0)
                out = [told.value.judge(field, list(zip(who[bounds[k] : bounds[k + 1]], what[bounds[k] : bounds[k + 1]]))) for k in at.tolist()]
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(at)), pa.array([field] * len(at), pa.string()), pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.float64()), pa.array([r[2] for r in out], pa.int64())], names=["key", "field", "value", "posterior", "support"])

    return groups.mapInArrow(choose, "key string, field string, value string, posterior double, support long").withColumnRenamed("key", key)
