"""Problem 8: the dictionary of the corpus's words, whole, in part and empty."""

import random

import tiktoken

from millrace.llm import encoding
from millrace.llm.encoding import PATTERN, VOCABULARY, dictionary, read_vocabulary, token_ids

RANKS = read_vocabulary(VOCABULARY)
REFERENCE = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})


def corpus():
    rnd = random.Random(8)
    words = ["".join(rnd.choices("abcdeéاب123 ", k=rnd.randint(1, 9))) for _ in range(400)]
    texts = [" ".join(words[int(400 * rnd.random() ** 3)] for _ in range(rnd.randint(0, 80))) for _ in range(200)]
    return [*texts, "", None, "x" * 3000 + " " + "é" * 500, texts[0]]


def test_ids_do_not_depend_on_the_dictionary(spark, monkeypatch):
    texts = corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    for most, remember in ((300_000, 500_000), (50, 500_000), (0, 500_000), (50, 3)):
        monkeypatch.setattr(encoding, "DICTIONARY", most)
        monkeypatch.setattr(encoding, "REMEMBER", remember)
        out = {r.doc_id: r.ids for r in token_ids(df).collect()}
        assert all(out[i] == (REFERENCE.encode_ordinary(t) if t else []) for i, t in enumerate(texts)), (most, remember)


def test_each_word_is_encoded_once(spark):
    texts = corpus()
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(7)
    rows = dictionary(df).collect()
    find = encoding.Encoder(RANKS).find
    assert sorted(r.word for r in rows) == sorted({w for t in texts if t for w in find(t) if len(w) <= encoding.LONGEST})
    assert all(r.ids == REFERENCE.encode_ordinary(r.word) for r in rows)
    some = dictionary(df, most=40).collect()
    assert len(some) <= 40 and dictionary(df.limit(0)).count() == 0
