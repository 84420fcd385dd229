"""Language ID against a naive Bayes written out plainly."""

import math
from collections import Counter

import numpy as np

from veridiff.llm import language_id as L


def plain_counts(text):
    c = L._codes(text)
    out = Counter()
    for n, g in zip(L.GRAMS, L._grams(c)):
        out.update(g.tolist())
    return out


def test_scores_against_plain_naive_bayes(spark, monkeypatch):
    train = [(1, "der die und das nicht", "de"), (2, "the of and that is", "en"), (3, "und ist ein haus", "de"), (4, "le la et les", "fr"), (5, None, "fr"), (6, "xx", None)]
    docs = spark.createDataFrame(train, "doc_id long, text string, lang string")
    langs, prior, logp = L.train(docs)
    assert langs == ["de", "en", "fr"]
    counts = {k: Counter() for k in langs}
    for _, t, lang in train:
        if t is not None and lang is not None:
            counts[lang].update(plain_counts(t))
    texts = ["und the haus", None, "", "12 34", "é", "la " * 50, "der die und das nicht " * 40]
    for chunk in (1_000_000, 7):
        monkeypatch.setattr(L, "CHUNK", chunk)
        pred, score = L.score_texts(texts, langs, prior, logp)
        for t, p, s in zip(texts, pred, score):
            own = plain_counts(t) if t else Counter()
            if not own:
                assert (p, s) == ("und", 0.0)
                continue
            n_docs = {"de": 2, "en": 1, "fr": 1}
            total = [math.log(n_docs[k] / 4) + sum(n * math.log((counts[k][b] + L.ALPHA) / (sum(counts[k].values()) + L.ALPHA * L.BUCKETS)) for b, n in own.items()) for k in langs]
            best = int(np.argmax(total))
            assert p == langs[best] and math.isclose(s, 1 / sum(math.exp(x - total[best]) for x in total), rel_tol=1e-9)


def test_too_many_languages_are_an_error_before_counting(spark, monkeypatch):
    monkeypatch.setattr(L, "MAX_LANGUAGES", 2)
    docs = spark.createDataFrame([(k, "text", f"l{k}") for k in range(4)], "doc_id long, text string, lang string")
    try:
        L.train(docs)
    except ValueError:
        return
    raise AssertionError("no error")
