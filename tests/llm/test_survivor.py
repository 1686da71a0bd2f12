import random

from pyspark.sql import functions as F

from millrace.functions.text import identifier
from millrace.llm.survivor import FIELDS, posterior_values, survivors

SCHEMA = "record_id long, source_system string, id_order string, customer struct<name string, phone string, email string, address struct<city string, district string>>, payment struct<method string>, delivery struct<type string>, updated_at string, field string"
TRUST = {"erp": 5, "web": 4, "csv": 2}


def row(i, source, key, name, updated, city=None):
    return (i, source, key, (name, None, None, (city, None)), ("cash",), (None,), updated, "clash")


def frames(spark, rows):
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(list(TRUST.items()), "source_system string, trust long")


def test_rule(spark):
    rows = [
        row(1, "erp", "ORD-1", "n/a", "2025-01-01T00:00:00Z"), row(2, "web", " ord-١ ", "Web", "2025-01-01T00:00:00Z"), row(3, "web", "ORD-1", "Later", "2025-01-01T02:00:00+01:00"),
        row(4, "none", "ORD-1", "Unlisted", "2030-01-01T00:00:00Z", "x"), row(5, None, "ORD-1", "Zed", "2031-01-01", "y"),
        row(6, "erp", "ORD-2", "alone", "2025-01-01"), row(7, "erp", None, "blank", None), row(8, "erp", "", "blank", None),
        row(9, "csv", "ORD-3", "B", "not set"), row(10, "csv", "ORD-3", "A", "not set"), row(11, "csv", "ORD-3", "غير معروف", "2026-01-01"), row(12, "web", "ORD-4", "-", None), row(13, "web", "ORD-4", " ", None),
    ]
    df, trust = frames(spark, rows)
    out = {(r.id_order, r.field): r.record_id for r in survivors(df, trust).collect()}
    assert out == {
        ("ORD-1", "customer.name"): 3, ("ORD-1", "customer.address.city"): 5, ("ORD-1", "payment.method"): 1,
        ("ORD-3", "customer.name"): 9, ("ORD-3", "payment.method"): 11, ("ORD-4", "payment.method"): 12,
    }
    assert survivors(df.limit(0), trust).count() == 0
    assert survivors(df, trust.limit(0)).where("field = 'customer.name' and id_order = 'ORD-1'").first().record_id == 5


def test_against_brute_force_with_a_hot_identifier(spark):
    rnd = random.Random(4)
    rows = [row(i, rnd.choice([*TRUST, "old", None]), "HOT" if rnd.random() < 0.3 else f"o{rnd.randrange(200)}", rnd.choice(["A", "B", "?", None, "NULL"]), rnd.choice([None, "", f"2025-01-{rnd.randrange(1, 28):02d} 10:00:00"])) for i in range(1500)]
    df, trust = frames(spark, rows)
    groups = {}
    for r in rows:
        groups.setdefault(identifier(r[2]), []).append(r)
    expected = {}
    for key, group in groups.items():
        named = [r for r in group if r[3][0] in ("A", "B")]
        if len(group) > 1 and named:
            expected[key] = max(named, key=lambda r: (TRUST.get(r[1], 0), r[6] or "", -r[0]))[0]
    assert {r.id_order: r.record_id for r in survivors(df, trust).where("field = 'customer.name'").collect()} == expected


def test_copies_are_outvoted(spark):
    """Two honest sources against three that copy each other's mistakes: the majority is wrong, the posterior is not."""
    rnd = random.Random(9)
    rows, truth, n = [], {}, 0
    for k in range(150):
        truth[f"O{k}"] = f"true{k}"
        wrong = rnd.random() < 0.4
        for source in ("good1", "good2", "copy1", "copy2", "copy3"):
            n += 1
            if source.startswith("good"):
                name = truth[f"O{k}"] if rnd.random() < 0.95 else f"slip{n}"
            else:
                name = f"false{k}" if wrong else truth[f"O{k}"]
            rows.append(row(n, source, f"O{k}", name, "2025-01-01"))
    df, _ = frames(spark, rows)
    out = {r.id_order: r for r in posterior_values(df, ("customer.name",), rounds=5).collect()}
    right = sum(out[k].value == v for k, v in truth.items()) / len(truth)
    assert right > 0.85
    assert posterior_values(df.limit(0)).count() == 0
    assert all(0 < r.posterior <= 1 for r in out.values())


def test_fields_are_the_statement():
    assert len(FIELDS) == 7 and F is not None


def test_planted_copiers_and_accuracies(spark):
    """Seven sources of planted accuracies, three of them copying a bad one: the values chosen are nearly as good as knowing all that, and better than the vote of most."""
    rnd = random.Random(12)
    accuracy = {"a": 0.95, "b": 0.9, "c": 0.8, "bad": 0.45}
    rows, truth, votes, n = [], {}, {}, 0
    for k in range(400):
        key, true = f"O{k}", f"true{k}"
        truth[key] = true
        said = {s: true if rnd.random() < p else f"false{k}-{rnd.randrange(8)}" for s, p in accuracy.items() if rnd.random() < 0.9}
        for copier in ("copy1", "copy2", "copy3"):
            if "bad" in said and rnd.random() < 0.95:
                said[copier] = said["bad"]
        for source, value in said.items():
            n += 1
            rows.append(row(n, source, key, value, "2025-01-01"))
        by = {}
        for value in said.values():
            by[value] = by.get(value, 0) + 1
        votes[key] = min(by, key=lambda v: (-by[v], v)) if by else None
    df, _ = frames(spark, rows)
    out = {r.id_order: r.value for r in posterior_values(df, ("customer.name",), rounds=5).collect()}
    fused = sum(out.get(k) == v for k, v in truth.items()) / len(truth)
    most = sum(votes[k] == v for k, v in truth.items()) / len(truth)
    print(f"right by fusion {fused:.3f}, by most votes {most:.3f}")
    assert fused > 0.9 > 0.8 > most


def test_more_sources_than_fit_a_table_of_all_pairs(spark):
    rows = [row(3 * i + j, f"s{i + j}", f"O{i}", "A" if j else f"B{i}", "2025-01-01") for i in range(1500) for j in range(3)]
    df, _ = frames(spark, rows)
    out = posterior_values(df, ("customer.name",)).collect()
    assert len(out) == 1500 and {r.value for r in out} == {"A"}
