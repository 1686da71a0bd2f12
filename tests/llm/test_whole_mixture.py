import math

from millrace.llm.mixing import budgets, drawn, entropy, mix, report, sizes


def test_a_whole_mixture_lowers_the_exponent_and_repeats(spark):
    rows = [(i, "word word word", "big") for i in range(900)] + [(1000 + i, "word word word", "small") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 3)], "source string, target_share double, max_repeats int")
    found = mix(df, targets, passes=1.0)
    out = {r.source: r for r in report(found).collect()}
    everything = sum(b.available for b in found.budgets)
    assert math.isclose(sum(r.tokens for r in out.values()), everything, rel_tol=0.01)
    assert 0.29 < out["small"].reached_share < 0.31 and out["small"].most_repeats == 3 and out["big"].most_repeats == 1
    assert sum(r.tokens for r in report(mix(df, targets)).collect()) < 0.7 * everything
    assert mix(df.limit(0), targets, passes=1.0).documents.count() == 0


def test_an_entropy_target_is_met_by_the_exponent():
    targets = [("a", 0.6, 9), ("b", 0.3, 9), ("c", 0.1, 9)]
    available = {"a": 10_000, "b": 1_000, "c": 100}
    for share in (0.0, 0.5, 0.9, 0.99):
        found = budgets(targets, available, least_entropy=share * math.log(3))
        a = found[0].exponent
        raw = {s: (n / 11_100) ** a for s, n in available.items()}
        weights = [w / sum(raw.values()) for w in raw.values()]
        assert math.isclose(found[0].entropy, entropy(weights)) and found[0].entropy >= share * math.log(3)
        drawn_shares = [b.tokens / sum(x.tokens for x in found) for b in found]
        assert all(math.isclose(x, y) for x, y in zip(drawn_shares, weights))
        assert all(b.tokens <= b.limit * b.available * (1 + 1e-9) for b in found) and any(math.isclose(b.tokens, b.limit * b.available) for b in found)
        assert (a == 1.0) == (share == 0.0)
    # a little less temperature would miss the target
    a = budgets(targets, available, least_entropy=0.9 * math.log(3))[0].exponent
    raw = [(n / 11_100) ** (a + 1e-6) for n in available.values()]
    assert 0 < a < 1 and entropy(w / sum(raw) for w in raw) < 0.9 * math.log(3)


def test_report_against_a_loop(spark):
    rows = [(i, " ".join(["word"] * (1 + i % 7)), "big" if i % 5 else "small") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("big", 0.3, 1), ("small", 0.7, 3), ("absent", 0.2, 4)], "source string, target_share double, max_repeats int")
    found = sizes(df, targets)
    for mixture in (drawn(found), drawn(found, passes=1.0), drawn(found, least_entropy=0.68)):
        documents = mixture.documents.collect()
        tokens = {s: sum(d.n_tokens * d.repeats for d in documents if d.source == s) for s in ("big", "small", "absent")}
        for r in report(mixture).collect():
            assert r.tokens == tokens[r.source] and math.isclose(r.reached_share, tokens[r.source] / sum(tokens.values()))
            assert math.isclose(r.reached_entropy, entropy(x / sum(tokens.values()) for x in tokens.values())) and r.most_repeats <= r.max_repeats
            assert abs(r.tokens - next(b.tokens for b in mixture.budgets if b.source == r.source)) <= 4
    assert 0 < drawn(found, passes=1.0).budgets[0].exponent < 1 and 0 < drawn(found, least_entropy=0.68).budgets[0].exponent < 1
    assert drawn(sizes(df.limit(0), targets), least_entropy=0.5).documents.count() == 0
