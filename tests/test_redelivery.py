import datetime as dt
import random

import numpy as np
import pytest

from millrace.operators import redelivery
from millrace.operators.redelivery import BucketFilters, deduplicated, redelivered

SCHEMA = "delivery_id long, id_order string, received_at timestamp_ntz, _key string, row string"


def at(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)


def found(spark, rows):
    df = spark.createDataFrame([(i, k, t, "clash", "clash") for i, k, t in rows], SCHEMA)
    return sorted(r.delivery_id for r in redelivered(df).collect())


def brute(rows):
    from millrace.functions.text import identifier

    by = {}
    for i, k, t in rows:
        if identifier(k):
            by.setdefault(identifier(k), []).append((t or dt.datetime.max, i))
    return sorted(i for g in by.values() for _, i in sorted(g)[1:])


def test_canonical_ties_nulls(spark):
    rows = [(1, "ORD-1", at(5)), (2, " ord-١‏", at(1)), (3, "ORD-1", at(1)), (4, None, at(1)), (5, "", at(1)), (6, " ", at(2)), (7, "ORD-1-B", at(1)), (8, "ORD-2", None), (9, "ORD-2", at(9)), (10, "x" * 50_000, at(1)), (11, "X" * 50_000, at(2))]
    assert found(spark, rows) == brute(rows) == [1, 3, 8, 11]


def test_empty(spark):
    assert found(spark, []) == []


def test_against_brute_force_with_a_hot_identifier(spark):
    rnd = random.Random(5)
    rows = [(i, "HOT" if rnd.random() < 0.33 else f"ORD-{rnd.randrange(900)}", at(rnd.randrange(3000))) for i in range(4000)]
    assert found(spark, rows) == brute(rows)


def test_one_instant(spark):
    rows = [(i, f"O{i % 3}", at(0)) for i in range(30)]
    assert found(spark, rows) == brute(rows)


def test_deduplicated_keeps_columns(spark):
    df = spark.createDataFrame([(1, "A", at(0), "p", "q"), (2, "a", at(1), "r", "s")], SCHEMA)
    out = deduplicated(df)
    assert out.columns == df.columns and [r.delivery_id for r in out.collect()] == [1]


@pytest.mark.parametrize("words", [1 << 6, 1 << 12, 1 << 17])
def test_filters_never_miss(words):
    rnd = np.random.default_rng(1)
    keys, bucket = rnd.integers(0, 3000, 5000), rnd.integers(0, 64, 5000)
    keys = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    parts = []
    for part in range(3):
        parts.append(BucketFilters(words))
        parts[-1].add(keys[part::3][:700], bucket[part::3][:700])
        parts[-1].add(keys[part::3][700:], bucket[part::3][700:])
    whole = BucketFilters(words)
    for x in parts:
        whole.merge(x.seen, x.again)
    maybe = whole.maybe(keys, bucket)
    _, at, n = np.unique(keys, return_inverse=True, return_counts=True)
    assert maybe[n[at] > 1].all()
    if words == 1 << 17:
        assert maybe[n[at] == 1].mean() < 0.01


@pytest.mark.parametrize("most", [1 << 6, 1 << 9, 1 << 23])
def test_any_size_of_the_filters(spark, monkeypatch, most):
    monkeypatch.setattr(redelivery, "MOST_WORDS", most)
    rnd = random.Random(6)
    rows = [(i, "HOT" if rnd.random() < 0.1 else f"ORD-{rnd.randrange(2500)}", at(0) if rnd.random() < 0.3 else at(rnd.randrange(3000))) for i in range(3000)] + [(3000, "far", dt.datetime(2400, 1, 1))]
    assert found(spark, rows) == brute(rows)


def test_most_new_identifiers_are_not_shuffled(spark):
    df = spark.range(50_000).selectExpr("id as row", "'ORD-' || if(id % 20 = 0, id % 500, id) as key", "id * 1000 as us").repartition(6)
    bounds = np.arange(1, 64) * (50_000_000 // 64)
    left = redelivery.possible_repeats(df, bounds, 50_000)
    assert 2500 <= left.count() < 6500 and left.where("row % 20 = 0").count() == 2500


def test_repeated_rows(spark):
    rows = [(1, "A", at(1)), (1, "A", at(1)), (2, "A", at(2)), (2, "A", at(2)), (2, "B", at(3)), (3, "B", at(2))]
    assert found(spark, rows) == [2, 2, 2]
