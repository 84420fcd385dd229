"""Texts, guards and synchronisation on small tables."""

import pytest
from pyspark.sql import functions as F

from veridiff import schemas
from veridiff.functions import text as T
from veridiff.operators import blocking, store, sync
from veridiff.sources import extract


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "ip, want",
    [("8.8.8.8", False), ("10.1.2.3", True), ("172.31.0.1", True), ("172.32.0.1", False), ("::ffff:127.0.0.1", True), ("::1", True), ("2001:db8::1", False), ("fe80::1", True), ("fd00::", True), ("300.1.1.1", True), ("name", True), ("", True)],
)
def test_restricted_address(spark, ip, want):
    assert one(spark, extract.restricted_address(F.lit(ip))) is want


@pytest.mark.parametrize("url, want", [("https://example.org/a", True), ("ftp://example.org", False), ("http://localhost:80/", False), ("http://169.254.169.254/x", False), ("https://10.0.0.1", False), ("nonsense", False), (None, False)])
def test_fetchable(spark, url, want):
    assert one(spark, extract.fetchable(F.lit(url).cast("string"))) is want


@pytest.mark.parametrize(
    "predicate, value, want",
    [
        ("click", "12.34", "quantity"), ("bind_host", "x", "address"), ("owner", "10.0.0.0/8", "address"), ("node", "1.2", "version"), ("size", "1.2", "quantity"), ("any", ">= 3", "version"), ("fee", "1", "price"),
        ("any", "5 EUR", "price"), ("expiry", "soon", "date"), ("any", "2024-01-02", "date"), ("http_port", "80", "quantity"), ("tls_enabled", "x", "status"), ("any", "off", "status"), ("access_rule", "x", "policy"),
        ("a_requirement", "x", "requirement"), (None, None, "configuration"),
    ],
)
def test_value_type(spark, predicate, value, want):
    assert one(spark, extract.value_type(F.lit(predicate).cast("string"), F.lit(value).cast("string"))) == want


def test_redact(spark):
    text = "ghp_" + "a_" * 12 + " Bearer abc.d token x1 access_token=q&z"
    assert one(spark, extract.redact(F.lit(text))) == "[REDACTED_GITHUB_TOKEN] Bearer [REDACTED] token [REDACTED] access_token=[REDACTED]&z"


def test_markdown_headings_badges_and_prose(spark):
    text = """## Getting Started
port: 80
## Cache Layer
![build](https://img.shields.io/badge/Build-passing-green) ![x](https://github.com/a/b/badge.svg?failing)
Needs at least 4 GB of RAM
The server listens on port 9000
- **Timeout**: the request waits at least 30 seconds here
Specification: nothing
Commercial use is strictly prohibited"""
    rows = extract.markdown_claims(spark.createDataFrame([("a/Guide.md", text)], "path string, content string")).collect()
    assert sorted((r.predicate, r.value, r.extraction_method, r.line_no) for r in rows) == [
        ("cache_build_status", "failing", "markdown_badge", 4), ("cache_build_status", "passing", "markdown_badge", 4), ("cache_commercial_use", "prohibited", "prose_heuristic", 9),
        ("cache_min_memory", "4 GB", "prose_heuristic", 5), ("cache_port", "9000", "prose_heuristic", 6), ("cache_timeout", "30 seconds", "markdown_pattern", 7), ("port", "80", "markdown_pattern", 2),
    ]
    assert {r.external_id for r in rows} >= {"document:a/guide.md:port:2"}


def test_readme_and_page_claims(spark):
    readme = "Requires Node.js 18.2\nnode 16 was previously used\nFor example docker run: server running on port 8080\nnpm node 3"
    rows = extract.readme_claims(spark.createDataFrame([("README.md", readme)], "path string, content string")).collect()
    assert sorted((r.predicate, r.value, r.source_role) for r in rows) == [("node_version", "16", "historical"), ("node_version", "18.2", "documentation"), ("port", "8080", "example")]
    html = "<title>My &amp; Site!</title><p>Memory: 4 GB</p><p>It runs on port 443 today</p><p>uses PostgreSQL inside</p>"
    rows = extract.page_claims(spark.createDataFrame([(1, "http://x", html)], "page_id long, url string, html string")).collect()
    assert sorted((r.subject, r.predicate, r.value, r.confidence) for r in rows) == [("My  Site", "database", "postgres", 0.85), ("My  Site", "memory", "4 GB", 0.95), ("My  Site", "port", "443", 0.85)]
    assert all(len(r.external_id) == len("claim:website:") + 16 for r in rows)


def claim(id, source, subject, predicate, value):
    row = dict.fromkeys(f.split(" ")[0] for f in schemas.CLAIMS.split(", metadata")[0].split(", "))
    return row | {"id": id, "external_id": f"{subject}:{predicate}:{source}", "source_id": source, "subject": subject, "predicate": predicate, "value": value, "value_type": "quantity", "confidence": 1.0, "environment": "production", "scope": "service", "source_role": "documentation", "is_historical": False, "metadata": None}


def test_sync_of_two_sources(spark):
    table = lambda rows: spark.createDataFrame([tuple(r.values()) for r in rows], schemas.CLAIMS)
    sources = spark.createDataFrame([("s1", "x:1", "document", "One", "u", None, None, None, 0.4, None)], schemas.SOURCES)
    staged_sources = spark.createDataFrame([("t1", "x:1", "document", "One more", "u", None, None, None, 1.0, None), ("s2", "x:2", "document", "Two", "u", None, None, None, 1.0, None)], schemas.SOURCES)
    old = table([claim("c1", "s1", "gate", "port", "80"), claim("c2", "s1", "gate", "memory", "1 GB")])
    new = table([claim("n1", "s1", "gate", "port", "81"), claim("n2", "s1", "gate", "memory", "1 GB"), claim("n3", "s2", "gate", "port", "82")])
    kept, current, found, summary = sync.sync(sources, old, staged_sources, new)
    assert sorted((r.id, r.name, r.trust_score, r.change) for r in kept.collect()) == [("s1", "One more", 0.4, "updated"), ("s2", "Two", 1.0, "created")]
    assert sorted((r.id, r.value) for r in current.collect()) == [("c1", "81"), ("c2", "1 GB"), ("n3", "82")]
    assert [(r.a_id, r.b_id, r.contradiction_type) for r in found.collect()] == [("c1", "n3", "QUANTITY_MISMATCH")]
    got = {r.id: (r.claims_extracted, r.claims_created, r.claims_updated, r.contradictions_found) for r in summary.collect()}
    assert got == {"s1": (2, 0, 1, 1), "s2": (1, 1, 0, 1)}
    totals = sync.batch_totals(summary, spark.range(1)).first()
    assert (totals.sources_requested, totals.sources_succeeded, totals.claims_created, totals.contradictions_found) == (3, 2, 1, 2)


def test_aliased_keys_without_a_limit(spark):
    rows = [(f"i{k:04d}", f"user_{k}", "click") for k in range(1, 300)]
    k = blocking.keyed(spark.createDataFrame(rows, "id string, subject string, predicate string"))
    names = [f"{x}user" for x in range(1, 300)]
    want = {tuple(sorted((p[:-4] + " user", q[:-4] + " user"))) for p in names for q in names if p != q and p in q and len(p) / len(q) >= 0.6}
    assert {(r.p, r.q) for r in blocking.alias_keys(k).collect()} == want and want


def test_details_of_a_missing_claim_is_an_error(spark):
    claims = spark.createDataFrame([("a", "s")], "id string, source_id string")
    sources = spark.createDataFrame([("s", "One")], "id string, name string")
    pairs = spark.createDataFrame([("k", "a", "a")], "id string, claim_a_id string, claim_b_id string")
    assert store.details(pairs, claims, sources).first()["source_a"]["name"] == "One"
    with pytest.raises(Exception, match="missing claim"):
        store.details(pairs.withColumn("claim_b_id", F.lit("gone")), claims, sources).collect()


def test_synonyms_by_look_up(spark):
    pairs = [("port", "listen_port", True), ("config_port", "http_port", True), ("port", "memory", False), ("x", "x", True), ("settings_x", "x", True), ("ram", "memory", True)]
    rows = spark.createDataFrame(pairs, "a string, b string, want boolean")
    assert all(r.got == r.want for r in rows.select("want", T.synonyms(F.col("a"), F.col("b")).alias("got")).collect())
