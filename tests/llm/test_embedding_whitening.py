"""Whitening against exact integers and a dense decomposition."""

import math
from fractions import Fraction

import numpy as np
import pytest

from veridiff.llm import embedding_whitening as W
from veridiff.llm.queries import whitened_rows

SCHEMA = "vec_id long, embedding array<float>, label int, x string, whitened int"


def brute(vectors, k=32):
    """(n, deviations, variances, components, trace) of lists of floats."""
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    off = [[n * a - s for a, s in zip(v, sums)] for v in x]
    centred = np.array([[float(Fraction(a, n)) for a in v] for v in off])
    e, u = np.linalg.eigh(centred.T @ centred / n)
    keep = np.argsort(-e)[:k]
    return n, [sum(a * a for a in v) for v in off], e[keep], u[:, keep], centred


@pytest.mark.parametrize("dims,scale", [(5, 1.0), (40, 0.2), (3, 3e9)])
def test_whitening(spark, dims, scale):
    rng = np.random.default_rng(dims)
    vectors = [[float(np.float32(c)) for c in v] for v in rng.normal(size=(150, dims)) * scale * np.linspace(1, 2, dims)]
    vectors += [vectors[0]] * 20
    odd = [None, [], [None] * dims, [float("nan")] * dims, [float("inf")] + [0.0] * (dims - 1), [1e30] * dims, [0.5] * (dims + 1)]
    rows = [(i, v, 1, "", 0) for i, v in enumerate(vectors + odd)] + [(None, vectors[3], None, None, None), (7, vectors[7], 1, "", 0)]
    used = [v for _, v, *_ in rows if v not in odd and v is not None and v == v and len(v) == dims and all(c is not None and c == c and abs(c) < 1e20 for c in v)]
    n, dev, e, u, centred = brute(used)
    got = whitened_rows(spark.createDataFrame(rows, SCHEMA).repartition(4), 32).collect()
    assert len(got) == n * min(32, dims)
    by = {}
    for r in got:
        assert r.n == n and r.identity_error < 1e-9 and r.explained == pytest.approx(e[r.component - 1] / e.sum() if dims <= 32 else r.explained, rel=1e-8)
        by.setdefault(r.component, []).append(r)
    largest = max(dev)
    assert sorted(r.deviation for r in by[1] if r.deviation is not None) == sorted(d for d in dev if d < 2**63) and (scale < 1e6 or largest >= 2**63)
    for c, own in by.items():
        want = np.sort(np.abs(centred @ u[:, c - 1]) / math.sqrt(e[c - 1]))
        assert np.allclose(np.sort(np.abs([r.whitened for r in own])), want, atol=1e-6)


def test_few_dimensions_vary(spark):
    """Constant and repeated dimensions add no component."""
    rng = np.random.default_rng(1)
    rows = [(i, [0.25, float(a), float(a), float(b)], 1, "", 0) for i, (a, b) in enumerate(rng.normal(size=(80, 2)))]
    model = W.fit(spark.createDataFrame(rows, SCHEMA))
    assert len(model.variances) == 2
    table = spark.createDataFrame(rows, SCHEMA)
    assert W.identity_error(W.transform(table, model), model) < 1e-9


def test_edges(spark):
    assert whitened_rows(spark.createDataFrame([], SCHEMA), 32).collect() == []
    assert whitened_rows(spark.createDataFrame([(1, [1.0, 2.0], 0, "", 0)] * 3, SCHEMA), 32).collect() == []
