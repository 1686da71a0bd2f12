import math
import random
from collections import Counter

from millrace.llm import stuffing


def npmi(texts):
    """Mean normalised PMI of each text, by plain loops over whole words."""
    pages = [t.lower().split() for t in texts]
    words, pairs = Counter(w for p in pages for w in p), Counter(x for p in pages for x in zip(p, p[1:]))
    total = sum(pairs.values())
    for page in pages:
        own_w, own_p, out = Counter(page), Counter(zip(page, page[1:])), 0.0
        for a, b in zip(page, page[1:]):
            p, left, right = ((n / total) for n in (pairs[a, b] - own_p[a, b], words[a] - own_w[a], words[b] - own_w[b]))
            out += max(-1, min(1, math.log((p + stuffing.PRIOR) / (left * right + stuffing.PRIOR)) / -math.log(p + stuffing.PRIOR)))
        yield out / max(len(page) - 1, 1)


def test_rare_words_and_pairs_are_counted_exactly(spark, monkeypatch):
    rnd = random.Random(7)
    vocabulary = ["".join(rnd.choices("abcdefgh", k=6)) for _ in range(300)]
    texts = [" ".join(vocabulary[int(300 * rnd.random() ** 3)] for _ in range(rnd.randrange(0, 60))) for _ in range(300)] + ["", "alone"]
    df = spark.createDataFrame(list(enumerate([*texts, texts[0]])), "doc_id long, text string").repartition(5)
    want = list(npmi([*texts, texts[0]]))
    for share in (2.0**-21, 2.0**-9, 2.0**-6, 1.0):
        monkeypatch.setattr(stuffing, "RARE", share)
        rows = stuffing.page_features(df).collect()
        assert len(rows) == len(want) and all(math.isclose(r.coherence, want[r.doc_id], abs_tol=1e-9) for r in rows), share
