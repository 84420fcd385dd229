"""Mixing: targets against plain sharing, rounding against what it must keep, and the defined edge cases."""

import random
from collections import defaultdict
from math import ceil, floor

import pytest

from veridiff.llm import source_mixing as M

DOCS = "doc_id long, text string, source string, size string, rank int, part double"


def targets(sizes, share=1.5, most=2):
    """{source: words} to targets by sharing again and again what lies above."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    out, left, open_ = dict.fromkeys(order, 0.0), share * sum(sizes.values()), [s for s in order if sizes[s]]
    while open_ and left > 1e-9:
        level = left / sum(weight[s] for s in open_)
        left = 0.0
        for s in open_:
            out[s] += level * weight[s]
            if out[s] > most * sizes[s]:
                left += out[s] - most * sizes[s]
                out[s] = most * sizes[s]
        open_ = [s for s in open_ if out[s] < most * sizes[s]]
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for i in range(700):
        source = "hot" if i % 3 == 0 else rng.choice(["a", "b", "é", "Z", None, "tiny"] if i < 40 else ["a", "b", "é", "Z", None])
        n = rng.choice([0, 1, 3, 10, 40, 200])
        out.append((i, None if n == 0 and i % 2 else " \t".join(["x"] * n), source, "clash", 1, 0.5))
    return out + [(5, "again and again", "hot", "", 0, 0.0)] * 30 + [(None, "no id", None, "", 0, 0.0)] * 9


@pytest.mark.parametrize("fan,broadcast,piece", [(4, 8_000_000, 4096), (3, 0, 7)])
def test_mix(spark, rows, monkeypatch, fan, broadcast, piece):
    monkeypatch.setattr(M, "FAN", fan)
    monkeypatch.setattr(M, "BROADCAST_BYTES", broadcast)
    monkeypatch.setattr(M, "PIECE", piece)
    docs = spark.createDataFrame(rows, DOCS)
    got = M.mix(docs.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, M.mix(docs.repartition(2)).collect()))
    size = lambda t: len((t or "").split())
    words, by_id = defaultdict(int), {}
    for i, text, source, *_ in rows:
        words[source] += size(text)
        by_id[i, size(text)] = source
    assert sorted((r.doc_id or -1, r["size"]) for r in got) == sorted((i or -1, size(t)) for i, t, *_ in rows)
    want, taken, largest = targets(words), defaultdict(int), defaultdict(int)
    for r in got:
        source = by_id[r.doc_id, r["size"]]
        assert r.source_size == words[source] and r.target == pytest.approx(want[source], rel=1e-12)
        rate = want[source] / words[source]
        assert r.taken % max(r["size"], 1) == 0 and floor(rate + 1e-9) * r["size"] <= r.taken <= ceil(rate - 1e-9) * r["size"] <= 2 * r["size"]
        taken[source] += r.taken
        largest[source] = max(largest[source], r["size"])
    for source in words:
        assert abs(taken[source] - want[source]) <= largest[source] / 2 + 1e-6


def test_expectations(spark):
    """Each document's copies are right on average over seeds, and the sum never moves."""
    docs = spark.createDataFrame([(i, "w " * (1 + i % 7), "s" if i else "t", "", 0, 0.0) for i in range(25)], DOCS).coalesce(1)
    total, seeds = defaultdict(int), 10
    for seed in range(seeds):
        for r in M.mix(docs, share=1.3, seed=seed).collect():
            if r.doc_id:
                total[r.doc_id] += r.taken / r["size"]
                rate = r.target / r.source_size
    assert 0.1 < rate % 1 < 0.9
    assert sum(total.values()) / (24 * seeds) == pytest.approx(rate, abs=0.05)
    assert all(abs(v / seeds - rate) < 0.7 for v in total.values())


def test_edges(spark):
    assert M.mix(spark.createDataFrame([], DOCS)).collect() == []
    got = M.mix(spark.createDataFrame([(1, None, "a", "", 0, 0.0), (2, "", None, "", 0, 0.0)], DOCS)).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    long = M.mix(spark.createDataFrame([(1, "w " * 300_000, "a", "", 0, 0.0), (2, "w", "b", "", 0, 0.0)], DOCS)).collect()
    assert sorted((r.doc_id, r["size"], r.taken) for r in long)[1][2] in (1, 2) and sorted(r.taken for r in long)[1] in (300_000, 600_000)
