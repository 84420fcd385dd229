"""Repeated ids, large components, and that the tree avoids computations."""

import numpy as np
from pyspark.sql import functions as F

from veridiff.llm import metric_search


def brute(rows, q_id, q, k):
    return sorted((-sum(int(a) * int(b) for a, b in zip(q, v)), i) for i, v in rows if i != q_id)[:k]


def test_repeated_ids_among_equal_vectors(spark):
    rows = [(5, [1.0, 2.0])] * 3 + [(k, [1.0, 2.0]) for k in range(10, 37)] + [(5, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [r for r in metric_search.top_k(df, F.col("vec_id") == 5, 20).collect()]
    whole = [(i, [64 * x for x in v]) for i, v in rows]
    best = sorted((s, i) for i, v in whole if i == 5 for s, i in brute(whole, 5, v, 100))[:20]
    assert sorted((r["rank"], -r.score, r.vec_id) for r in got) == [(n + 1, *x) for n, x in enumerate(best)]


def test_scores_beyond_doubles():
    x = np.array([[3.0, 1.0], [5.0, 7.0]])
    q = np.array([[2.0**53 + 2, 1.0]])
    _, ids, score = metric_search.Tree(x, np.array([1, 2])).search(q, np.array([9]), 2)
    assert list(zip(ids.tolist(), score.tolist())) == [(2, 5 * (2**53 + 2) + 7), (1, 3 * (2**53 + 2) + 1)]


def test_fewer_products_than_a_scan():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16)) * 1000
    x = np.floor(np.repeat(centres, 100, axis=0) + rng.normal(size=(4000, 16)))
    ids = np.arange(4000)
    count = []
    row, got, score = metric_search.Tree(x, ids, page=64).search(x[::50], ids[::50], 10, count=count)
    for n, q in enumerate(ids[::50].tolist()):
        assert list(zip((-score[row == n]).tolist(), got[row == n].tolist())) == brute(list(zip(ids.tolist(), x)), q, x[q], 10)
    assert count[0] < 0.5 * len(x) * len(ids[::50])


def test_lengths_empty_vectors_and_empty_tables(spark):
    rows = [(1, [1.0]), (2, [2.0]), (3, []), (4, []), (5, [1.0, 1.0]), (6, [float("inf")]), (7, [1e308]), (None, [1.0]), (8, None)]
    df = spark.createDataFrame([(i, v, "x", 3) for i, v in rows], "vec_id long, embedding array<double>, rank string, cell int")
    got = metric_search.top_k(df, F.lit(True), 2).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 2, 8192), (2, 1, 1, 8192), (3, 1, 4, 0), (4, 1, 3, 0)]
    assert metric_search.top_k(df.limit(0), F.lit(True)).count() == 0
