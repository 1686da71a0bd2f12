import base64
import math
import random

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm.encoding import PATTERN, VOCABULARY, Encoder, read_vocabulary, token_counts, token_ids
from millrace.llm.mixing import budgets, entropy, mix, report
from millrace.llm.stuffing import Counts, _Codes, codes, corpus_counts, features, page_features, split

RANKS = read_vocabulary()
ENCODER = Encoder(RANKS)
REFERENCE = tiktoken.Encoding("reference", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})


def ids(*texts):
    flat, ends = ENCODER.encode(list(texts))
    return [flat[a:b].tolist() for a, b in zip(ends, ends[1:])]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6))
def test_ids_against_two_libraries(texts):
    assert ids(*texts) == [REFERENCE.encode_ordinary(t) for t in texts]


def test_ids_of_odd_texts():
    t = Tokenizer.from_file(VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    texts = ["", "<|endoftext|> x", "a" * 5000, "\u0085  　x", "½²Ⅷ٣", "🇾🇪👩‍👩‍👧", "السيد الرئيس،  ", "\n\n \t x"]
    assert ids(*texts) == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_ids_decode_to_the_text():
    text = "The sitting – الجلسة – wird eröffnet.\n" * 500
    assert b"".join(ENCODER.tokens[i] for i in ids(text)[0]).decode() == text


def test_token_table(spark):
    df = spark.createDataFrame([(1, "Hello"), (2, ""), (3, None), (1, "Hello")], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    assert sorted((r.doc_id, r.ids) for r in token_ids(df).collect()) == [(1, REFERENCE.encode_ordinary("Hello"))] * 2 + [(2, []), (3, [])]
    assert sorted((r.doc_id, r.n_tokens) for r in token_counts(df).collect()) == [(1, 1), (1, 1), (2, 0), (3, 0)]
    assert token_ids(df.limit(0)).count() == 0


def test_budgets_meet_targets_or_limits():
    targets = [("a", 0.5, 1), ("b", 0.3, 4), ("none", 0.2, 3)]
    out = {b.source: b for b in budgets(targets, {"a": 1000, "b": 100})}
    assert out["none"].tokens == 0 and math.isclose(out["a"].tokens / out["b"].tokens, 5 / 3) and out["b"].tokens <= 400.0001
    big = {b.source: b for b in budgets(targets, {"a": 1000, "b": 100}, total=1100)}
    assert big["a"].tokens <= 1000 and big["b"].tokens <= 400.0001 and math.isclose(sum(b.tokens for b in big.values()), 1100, rel_tol=1e-6)
    flat = budgets([("a", 0.99, 9), ("b", 0.01, 9)], {"a": 10, "b": 10}, total=20, least_entropy=0.6)
    assert entropy([b.tokens / 20 for b in flat]) >= 0.6
    assert budgets(targets, {}) and all(b.tokens == 0 for b in budgets(targets, {}))


def test_mixture(spark):
    rnd = random.Random(2)
    rows = [(i, " ".join(["word"] * rnd.randint(1, 9)), "big" if i % 4 else "small") for i in range(2000)] + [(9001, "", "small"), (9002, None, "small"), (9003, "x y", "other"), (9004, "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_tokens", F.lit("clash"))
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 3), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    found = mix(df, targets)
    out = {r.source: r for r in report(found).collect()}
    assert abs(out["big"].reached_share - 5 / 9) < 0.005 and abs(out["small"].reached_share - 4 / 9) < 0.005
    assert out["absent"].tokens == 0 and out["small"].most_repeats <= 3 and out["big"].most_repeats == 1
    assert found.documents.where("doc_id > 9000").count() == 0
    assert sorted(map(tuple, found.documents.collect())) == sorted(map(tuple, mix(df, targets).documents.collect()))
    repeats = [r.repeats for r in found.documents.where("source = 'small'").collect()]
    assert max(repeats) - min(repeats) <= 1 and len(repeats) == 500
    assert mix(df.limit(0), targets).documents.count() == 0 and report(mix(df.limit(0), targets)).count() == 3
    assert mix(df, targets.limit(0)).documents.count() == 0


TEMPLATE = "Mr President, the committee will defend the {} of the {} in the name of thrift. According to the report before us, the government has promised the {} for the {} before the summer recess. "
NOUNS = "bridges harbours wells schools clinics archives tenancies tariffs pumps roofs kilns signals".split()


def corpus():
    rnd = random.Random(3)
    speeches = ["".join(TEMPLATE.format(*rnd.sample(NOUNS, 4)) for _ in range(rnd.randint(1, 6))) for _ in range(400)]
    words = "cheap tyres sale loans watch buy ink casino lamps best rugs sofa".split()
    spam = [" ".join(rnd.choice(words) for _ in range(rnd.randint(60, 150))) for _ in range(8)]
    spam += ["\n".join(f"https://{w}{rnd.randrange(999)}.test/x" for w in words) for _ in range(4)]
    spam += [" ".join(f"#{rnd.choice(words)}_{rnd.choice(words)}" for _ in range(30)) for _ in range(4)]
    spam += [", ".join(rnd.choice(NOUNS) for _ in range(90)) for _ in range(6)]
    genuine = ["", None, "(Hear, hear!) (Hear, hear!) (Hear, hear!)", "The Chair: The question is put.", speeches[0] + " See https://record.test/1 and https://record.test/2 for the figures."]
    return speeches + genuine, spam


def test_pages(spark):
    genuine, spam = corpus()
    rows = list(enumerate([*genuine, *spam]))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("stuffed", F.lit("clash"))
    found = {r.doc_id for r in page_features(df).where("stuffed").select("doc_id").collect()}
    assert found == set(range(len(genuine), len(rows)))
    assert page_features(df.limit(0)).count() == 0


def test_corpus_counts_against_a_loop(spark):
    genuine, spam = corpus()
    texts = [*genuine, *spam]
    counts = corpus_counts(spark.createDataFrame([(t,) for t in texts], "text string").repartition(5))
    w = split(*codes(texts, _Codes()))
    for have, n, keys in ((counts.words, counts.word_n, w.word), (counts.pairs, counts.pair_n, w.pair)):
        k, c = np.unique(keys, return_counts=True)
        assert (k == have).all() and (c == n).all()
    assert counts.total == len(w.pair)


def test_features_without_a_corpus():
    none = Counts(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), 0)
    f = features(["", None, "one", "two words", "x" * 100_000], _Codes(), none)
    assert f["words"].tolist() == [0, 0, 1, 2, 1] and np.isfinite(f["coherence"]).all()


def test_vocabulary_is_complete():
    assert all(bytes([b]) in RANKS for b in range(256)) and len(base64.b64encode(max(RANKS, key=len))) > 0
    with pytest.raises(OSError):
        read_vocabulary("/nowhere")
