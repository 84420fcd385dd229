"""Scan of one source against all pairs by the engine's match."""

from pyspark.sql import functions as F

from veridiff import schemas
from veridiff.functions import text as T
from veridiff.operators import blocking
from veridiff.plans import discover

ROWS = [
    ("payment gateway", "runtime_max_conn", "10"), ("payment-gateways", "max_conn", "20"), ("API Server", "Node Version", "18"), ("api_server", "node-version", "20"),
    ("", "port", "80"), (None, "port", "81"), ("config.yaml", "server_port", "82"), ("postgres", "timeout", "5"), ("postgresql", "timeout_s", "9"), ("gate", "host", "2"), ("gate", "port", "1"),
]


def table(spark):
    fields = [f.split(" ", 1) for f in schemas.CLAIMS.split(", metadata")[0].split(", ")]
    rows = [(f"c{(i * 7) % 22:02}", f"s{i % 2}", s, p, v) for i, (s, p, v) in enumerate([*ROWS, *ROWS])]
    made = spark.createDataFrame(rows, "id string, source_id string, subject string, predicate string, value string")
    made = made.withColumns({"value_type": F.lit("quantity"), "confidence": F.lit(0.9), "environment": F.lit("production"), "scope": F.lit("service"), "source_role": F.lit("configuration"), "is_historical": F.lit(False)})
    return made.select(*(F.col(n) if n in made.columns else F.lit(None).cast(t).alias(n) for n, t in fields), F.lit(None).cast(schemas.METADATA).alias("metadata")).persist()


def test_scan_source_finds_what_the_match_accepts(spark):
    claims = table(spark)
    mine = claims.where("source_id = 's0'")
    a, b = (claims.select(*(F.col(c).alias(f"{n}_{c}") for c in ("id", "source_id", "subject", "predicate"))) for n in "ab")
    every = a.join(b, F.expr("a_id < b_id AND (a_source_id = 's0' OR b_source_id = 's0')"))
    matched = lambda df: {tuple(r) for r in df.where(T.match_claims(*(F.col(c) for c in ("a_subject", "a_predicate", "b_subject", "b_predicate")))["matches"]).select("a_id", "b_id").collect()}
    want = matched(every)
    got = matched(every.join(blocking.source_pairs(mine, claims), ["a_id", "b_id"], "left_semi"))
    assert want and got == want
    found = {frozenset((r.a.subject, r.b.subject)) for r in discover.scan_source("s0", claims).collect()}
    assert frozenset(("payment gateway", "payment-gateways")) in found
    probed = matched(every.join(blocking.probe_pairs(mine, claims), ["a_id", "b_id"], "left_semi"))
    assert probed < got, (len(probed), len(got))


def test_similarity_joins_against_all_pairs(spark):
    """Texts of few words and letters, so that every kind of similarity occurs near its threshold."""
    import random

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(1, 7)))
    subjects = sorted({rng.choice(" _-").join(word() for _ in range(rng.randrange(1, 5))) for _ in range(70)} | {"system", "", "api", "backend", "app", "!!", "payments gateway", "payments gateways"})
    predicates = ["port", "http_port", "max_conn", "max connections", "runtime_max_conn", "owner", "the owner name", "owner_names", "café_port", "license", "x"]
    rows = [(f"c{i:04d}", f"s{i % 5}", s, p) for i, (s, p) in enumerate((s, rng.choice(predicates)) for s in subjects for _ in range(2))]
    claims = spark.createDataFrame([*rows, ("n1", "s0", None, "port"), ("n2", "s1", None, "http_port")], "id string, source_id string, subject string, predicate string").persist()
    mine = claims.where("source_id = 's0'")
    x, y = (df.select(F.col("id").alias(n), F.col("subject").alias(f"{n}s"), F.col("predicate").alias(f"{n}p")) for df, n in ((mine, "x"), (claims, "y")))
    every = x.join(y, F.col("x") != F.col("y")).where(blocking._either_order(F.col("xs"), F.col("xp"), F.col("ys"), F.col("yp")))
    want = {tuple(sorted((r.x, r.y))) for r in every.collect()}
    got = blocking.source_pairs(mine, claims)
    assert {(r.a_id, r.b_id) for r in got.collect()} == want and len(want) > 40
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
