"""Keys of facts and aliases against plain comparison of all."""

import time

import pytest
from pyspark.sql import functions as F

from veridiff.functions import text as T
from veridiff.operators import blocking
from veridiff.operators.index import BlockIndex

SUBJECTS = ["api", "api-server", "backend", "client", "web", "auth", "auth-service", "payments gateway", "gateway payments", "payments-gateway-v2", "billing", "billing2", "system", "default", "app.md", "", "node", "@x/auth", "x auth", "Payments Gateway", "é"]
PREDICATES = ["http_port", "port", "ram", "min_memory", "owner", "owner name", "config_port", "node_version", "license"]
CLAIM = "id string, subject string, predicate string"


@pytest.fixture(scope="module")
def claims(spark):
    rows = [(f"c{i:03d}{j}", s, p) for i, s in enumerate(SUBJECTS) for j, p in enumerate(PREDICATES)] + [("n1", None, "port"), ("n2", "api", None), ("c999", "api", "port")]
    return spark.createDataFrame(rows, CLAIM).cache()


@pytest.fixture(scope="module")
def touched(claims):
    return claims.where("hash(id) % 3 = 0 OR subject IN ('system', 'api') OR subject IS NULL")


@pytest.fixture(scope="module")
def wanted(claims, touched):
    """Every touched claim with every claim, by the rules alone."""
    x, y = (df.select(F.col("id").alias(n), F.col("subject").alias(f"{n}_subject"), F.col("predicate").alias(f"{n}_predicate")) for df, n in ((touched, "x"), (claims, "y")))
    met = x.join(y, F.col("x") != F.col("y"))
    near = blocking.compatible_facts(met.select("x_subject", "x_predicate", "y_subject", "y_predicate"))
    rows = met.join(near, ["x_subject", "x_predicate", "y_subject", "y_predicate"])
    return {tuple(sorted((r.x, r.y))) for r in rows.collect()}


def test_probe(spark, claims, touched, wanted):
    got = [(r.a_id, r.b_id) for r in blocking.probe_pairs(touched, claims).collect()]
    assert len(got) == len(set(got)) and set(got) == wanted and len(wanted) > 500


def test_index(spark, claims, touched, wanted, tmp_path):
    index = BlockIndex.create(spark, str(tmp_path), claims.where("hash(id) % 2 = 0"), buckets=4)
    index.add(claims.where("hash(id) % 2 <> 0"))
    index.add(claims.where("hash(id) % 5 = 0"))
    found = index.probe(touched)
    assert {(r.a_id, r.b_id) for r in found.collect()} == wanted
    index.compact()
    index.remove(claims.where("subject = 'billing'"))
    gone = {r.id for r in claims.where("subject = 'billing'").collect()}
    mine = {r.id for r in touched.collect()}
    assert {(r.a_id, r.b_id) for r in index.probe(touched).collect()} == {p for p in wanted if any(a in mine and b not in gone for a, b in (p, p[::-1]))}


def test_a_small_probe_reads_few_buckets(spark, claims, tmp_path):
    index = BlockIndex.create(spark, str(tmp_path), claims, buckets=64)
    one = claims.where("id = 'c0000'")
    assert len(index.posts.look_up(blocking.asked_keys(blocking.facts(one)).select("block")).inputFiles()) >= 1
    plan = index.members.look_up(one.select("subject", "predicate"))._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and " IN (" not in plan.split("PartitionFilters")[1][:60]


def test_long_subjects(spark):
    """Aliases of subjects of thousands of letters, linear in their length."""
    long = ["".join(chr(97 + (i * i * k + i) % 26) for i in range(n)) for n, k in ((300, 3), (1500, 5), (3000, 7), (6000, 11))]
    subjects = [*long, long[2][:2000], long[2][100:1900], long[0][10:300], long[3][:100], "user_1", "user_12", "user_123", "abcd"]
    start = time.time()
    got = {(r.p, r.q) for r in blocking.alias_keys(blocking.keyed(spark.createDataFrame([(str(i), s, "port") for i, s in enumerate(subjects)], CLAIM))).collect()}
    assert time.time() - start < 30
    keys = [r[0] for r in spark.createDataFrame([(s,) for s in subjects], "s string").select(T.subject_key(F.col("s"))).collect()]
    forms = [k.replace(" ", "") for k in keys]
    want = {tuple(sorted((keys[i], keys[j]))) for i in range(len(keys)) for j in range(len(keys)) if i != j and forms[i] in forms[j] and len(forms[i]) >= 4 and len(forms[i]) >= 0.6 * len(forms[j])}
    assert got == want and len(want) >= 4


def test_alias_tables(spark):
    from veridiff.operators import aliases

    lists = spark.createDataFrame([(0, "api-server"), (0, "Backend"), (1, "zeta"), (1, "backend"), (1, "alpha"), (2, "")], "position int, name string")
    assert {(r.form, r.group, r.canonical) for r in aliases.groups_of_lists(lists).collect()} == {("api", "0", "api"), ("backend", "1", "alpha"), ("zeta", "1", "alpha"), ("alpha", "1", "alpha")}
    pairs = spark.createDataFrame([("a1", "A2"), ("a3", "a2"), ("b1", "b2"), ("a4", "a3"), (None, "x"), ("c", "c")], "a string, b string")
    groups = aliases.groups_of_pairs(pairs)
    assert {(r.form, r.canonical) for r in groups.collect()} == {("a1", "a1"), ("a2", "a1"), ("a3", "a1"), ("a4", "a1"), ("b1", "b1"), ("b2", "b1"), ("c", "c")}
    asked = spark.createDataFrame([("a4", "a 1"), ("a1", "b1"), ("b1", "B1"), ("backend", "api")], "a string, b string")
    got = {(r.a, r.b): (r.r.is_match, r.r.match_type, r.r.confidence) for r in aliases.resolved(asked, groups).collect()}
    assert got == {("a4", "a 1"): (True, "ALIAS", 0.95), ("a1", "b1"): (False, "NONE", 0.1), ("b1", "B1"): (True, "EXACT", 0.98), ("backend", "api"): (True, "ALIAS", 0.88)}
    chain = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(100)], "a string, b string")
    assert {r.label for r in aliases.components(chain).collect()} == {"n000"}


def test_counts_of_a_scan(spark):
    """Counted in the job that gathers the conflicts."""
    from veridiff.plans import discover
    from veridiff.plans.driver_claims import odd_claims

    claims = odd_claims(spark, "/root/testdata/sf0.001").where("subject < 'unit_000006'")
    whole = {r.pair_key for r in discover.scan_all(claims, None, 0.35).collect()}
    stored = [k.split("::") for k in sorted(whole)[::3]]
    new, counts = discover.counted_scan(claims, spark.createDataFrame(stored, "claim_a_id string, claim_b_id string"))
    assert {r.pair_key for r in new.collect()} == whole - {"::".join(k) for k in stored}
    got = counts.get
    assert (got["found"], got["new"], got["existing"]) == (len(whole), len(whole) - len(stored), len(stored)) and got["pairs_analyzed"] > got["found"] and got["uncertain"] > 0


def test_entity_candidates_against_all(spark):
    from veridiff.operators import store

    names = [*SUBJECTS, "User_1", "user 12", "user123", "identity", "idp", "mysql", "db", None]
    table = spark.createDataFrame([(n,) for n in names], "n string")
    q, c = table.select(F.col("n").alias("query")), table.select(F.col("n").alias("candidate"))
    every = q.distinct().join(c.distinct(), F.lit(True)).withColumn("r", T.resolve_entity(F.col("query"), F.col("candidate"))).where("r.is_match AND r.confidence >= 0.7")
    want = {(r["query"], r.candidate, r.r.confidence, r.r.match_type) for r in every.collect()}
    assert {(r["query"], r.candidate, r.confidence, r.match_type) for r in store.entity_candidates(q, c).collect()} == want and len(want) > 40


def numbered(spark, n):
    """Subjects that all begin alike: the letters and the word that they share must not bring them together."""
    return spark.range(n).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("user_"), F.col("id")).alias("subject"), F.lit("port").alias("predicate"))


def inside(n):
    names = {f"user{i}" for i in range(n)}
    parts = {(w, w[i:j]) for w in names for i in range(len(w)) for j in range(i + 4, len(w) + 1) if w[i:j] != w and w[i:j] in names and 5 * (j - i) >= 3 * len(w)}
    return {tuple(sorted((a[4:], b[4:]))) for a, b in parts}


def test_probe_of_subjects_that_begin_alike(spark):
    claims = numbered(spark, 3000)
    every = blocking.facts(claims)
    met = blocking.asked_keys(every, every).join(blocking.posted_keys(every), "block")
    assert met.where("subject <> x_subject").select("subject", "x_subject").distinct().count() < 25 * 3000
    assert {(r.a_id, r.b_id) for r in blocking.probe_pairs(claims, claims).collect()} == inside(3000)


def test_similar_subjects_that_begin_alike(spark):
    claims = numbered(spark, 8000)
    start = time.time()
    got = {(r.a_id, r.b_id) for r in blocking.source_pairs(claims.where("id % 7 = 3"), claims).collect()}
    assert got == {p for p in inside(8000) if any(int(x) % 7 == 3 for x in p)}
    assert time.time() - start < 60
