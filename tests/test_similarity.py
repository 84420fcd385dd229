"""Similarity of the texts of rows in one block: classes of equal texts against all pairs."""

import time
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from veridiff import queries
from veridiff.functions import text as T

PARTS = "p_partkey long, p_name string, p_brand string, p_size int"
NAMES = ["small ring", "ring  small", "blue bolt", None, ""]


def parts(spark, tmp_path, rows):
    spark.createDataFrame(rows, PARTS).write.parquet(str(tmp_path / "part.parquet"))
    return str(tmp_path)


MEASURES = {
    "composite_similarity": lambda s, t: (T.composite_similarity(s, t), T.semantic_similarity(s, t)),
    "text_similarity": lambda s, t: (T.token_jaccard(T.normalize_text(s), T.normalize_text(t)), T.edit_similarity(T.normalize_text(s), T.normalize_text(t))),
}


@pytest.mark.parametrize("name", MEASURES)
def test_all_pairs(spark, tmp_path, name):
    rows = [(i, NAMES[i % 5], "b", i % 2) for i in range(24)] + [(100, "blue bolt", None, 1), (101, "blue bolt", None, 1)]
    texts = spark.createDataFrame([(s, t) for s in NAMES for t in NAMES], "s string, t string")
    of = {(r.s, r.t): (r.m, r.n) for r in texts.select("s", "t", *(x.alias(n) for x, n in zip(MEASURES[name](F.col("s"), F.col("t")), "mn"))).collect()}
    want = sorted((x[0], y[0], *map(str, of[x[1], y[1]])) for x, y in combinations(rows[:24], 2) if x[3] == y[3])
    got = sorted((a, b, str(m), str(n)) for a, b, m, n in queries.QUERIES[name](spark, parts(spark, tmp_path, rows)).collect())
    assert got == want


@pytest.mark.parametrize("name", MEASURES)
def test_many_rows_of_few_texts(spark, tmp_path, name):
    """A class of more than one part; its pairs are given out, not measured again."""
    n = 6000
    folder = parts(spark, tmp_path, [(i, ("large red widget", "red widget", "blue bolt")[i % 3], "b", 1) for i in range(n)])
    start = time.time()
    got = queries.QUERIES[name](spark, folder)
    measure = got.columns[2]
    counts = {r[0]: r[1] for r in got.groupBy(F.col(measure) == 1).agg(F.count("*")).collect()}
    assert counts == {True: 3 * (n // 3) * (n // 3 - 1) // 2, False: 3 * (n // 3) ** 2}
    assert time.time() - start < 40
