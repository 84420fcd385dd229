"""Golden values of the scalar rules, and the registered queries against their SQL on small tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from veridiff import queries as Q
from veridiff import schemas
from veridiff.functions import scores as S
from veridiff.functions import text as T
from veridiff.functions import values as V
from veridiff.operators import pairs
from veridiff.sources import extract

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()[0]


@pytest.mark.parametrize(
    "a, b, kind, equal, compatible, difference",
    [
        ("v22.1.0", "NodeJS 22.1.0", "version", True, True, None),
        ("20.x", "20.10.0", "version", False, True, "RANGE_SATISFIED"),
        ("21.0.0", "20.x", "version", False, False, "RANGE_VIOLATION"),
        (">= 18", "22", "version", False, True, "RANGE_SATISFIED"),
        (">= 18", ">= 16", "version", False, True, "RANGES_INTERSECT"),
        ("< 16", ">= 18", "version", False, False, "DISJOINT_RANGES"),
        ("^4.17.0", "4.18.2", "version", False, True, "RANGE_SATISFIED"),
        ("~1.2.0", "1.3.0", "version", False, False, "RANGE_VIOLATION"),
        ("2026-12-25", "December 25, 2026", "date", True, None, None),
        ("$1,000.50", "1000.50 USD", "price", True, False, None),
        ("€500", "£500", "price", False, None, "CURRENCY_MISMATCH"),
        ("10", "10.00", "number", True, False, None),
        ("1 GB", "1024 MB", "quantity", True, False, None),
        ("1 GB", "1 ms", "quantity", False, None, "UNIT_DIMENSION_MISMATCH"),
        ("1000", "1000 ms", "quantity", False, None, "UNIT_MISMATCH"),
        ("10m", "600s", "quantity", True, False, None),
        ("enabled", "true", "status", True, False, None),
        ("enabled", "disabled", "status", False, False, "STATUS_MISMATCH"),
        ("", "content", "string", False, False, "EMPTY_VS_NONEMPTY"),
        ("", "", "string", True, True, None),
    ],
)
def test_compare(spark, a, b, kind, equal, compatible, difference):
    got = one(spark, V.compare(F.lit(a), F.lit(b), F.lit(kind)))
    assert got.equal == equal and got.difference == difference
    assert bool(got.compatible) == bool(compatible)


def test_rounding_is_half_up_on_the_binary_value(spark):
    assert one(spark, T.fixed(F.lit(0.3) + 0.285 + 0.17 + 0.1 + 0.1, 2)) == 0.95


@pytest.mark.parametrize("a, b, want", [("host", "port", True), ("server_host", "server_port", True), ("min_memory", "max_memory", True), ("db_user", "db_password", True), ("port", "listen_port", False)])
def test_orthogonal(spark, a, b, want):
    assert one(spark, T.orthogonal(F.lit(a), F.lit(b))) is want


def test_match(spark):
    m = one(spark, T.match_claims(F.lit("API Server"), F.lit("Node Version"), F.lit("api_server"), F.lit("node-version")))
    assert m.matches and m.subject_similarity == 1.0
    assert not one(spark, T.match_claims(F.lit("API Server"), F.lit("node_version"), F.lit("API Server"), F.lit("python_version"))).matches
    assert one(spark, T.subject_key(F.lit("Project Alpha"))) == one(spark, T.subject_key(F.lit("alpha-project")))


def test_extraction(spark):
    yaml = spark.createDataFrame([("svc.yaml", "title: \"Developer's Guide\"\nquote: 'He said \"hi\"'\nport: 8080")], "path string, content string")
    assert {r.predicate: r.value for r in extract.yaml_claims(yaml).collect()} == {"title": "Developer's Guide", "quote": 'He said "hi"', "port": "8080"}
    csv = spark.createDataFrame([("s.csv", "service,port,protocol\ngateway,443,https\nauth,8081,http")], "path string, content string")
    assert ("gateway", "port", "443") in {(r.subject, r.predicate, r.value) for r in extract.csv_claims(csv).collect()}
    doc = spark.createDataFrame([("c.json", '{"a": {"node_version": "22", "b": {"port": 1}}, "list": [1]}')], "path string, content string")
    assert {r.predicate: r.value for r in extract.json_claims(doc).collect()} == {"a_node_version": "22", "a_b_port": "1"}


@pytest.mark.parametrize("name", ["pair_block_counts", "candidate_pairs", "global_pairs", "cross_pairs", "probe_claim", "claim_current", "lifecycle_current", "lifecycle_audit", "compare_price", "compare_version", "authority_scores", "top_conflicts"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want = con.execute(Q.ORACLE_SQL[name]).df()
    got = Q.QUERIES[name](spark, SF).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    clean = lambda df: sorted(map(repr, df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False, name=None)))
    assert clean(got) == clean(want)


def test_advice_by_evidence_and_firm_authority(spark):
    """What the registered query cannot reach: evidence that leads, and firm authority against freshness."""
    strong, weak, middle = (F.struct(F.lit(x).alias("score"), F.lit(q).alias("quality")) for x, q in ((0.9, "STRONG"), (0.4, "WEAK"), (0.65, "MODERATE")))
    cases = [
        ((0.6, 0.62, 0.9, 0.9), (strong, weak), ("claimA", 0.62)), ((0.6, 0.62, 0.9, 0.9), (weak, middle), ("claimB", 0.62)), ((0.6, 0.62, 0.9, 0.9), (weak, weak), ("uncertain", 0.5)),
        ((0.9, 0.5, 0.3, 0.9), (weak, weak), ("claimA", 0.72)), ((0.8, 0.5, 0.3, 0.9), (weak, weak), ("uncertain", 0.45)), ((0.8, 0.5, 0.3, 0.9), (weak, strong), ("claimB", 0.62)), ((0.9, 0.5, 0.9, 0.9), (weak, strong), ("claimA", 0.76)),
    ]
    for numbers, (ea, eb), want in cases:
        got = spark.range(1).select(S.advice(*map(F.lit, numbers), ea, eb, F.lit("configuration"), F.lit("documentation")).alias("x")).first().x
        assert (got.likely, got.confidence) == want
    meta = lambda **kw: F.struct(*(F.lit(kw.get(n)).cast(t).alias(n) for n, t in (("line", "int"), ("start_line", "int"), ("end_line", "int"), ("line_range", "array<int>"), ("snippet", "string"), ("evidence", "string"), ("extraction_method", "string"))))
    of = lambda **kw: tuple(spark.range(1).select(S.evidence(meta(**kw)).alias("x")).first().x)
    assert of() == (0.4, "WEAK") and of(line=3) == (0.65, "MODERATE") and of(line=3, snippet="x") == (0.9, "STRONG") and of(line=3, evidence="x", extraction_method="json_parse") == (1.0, "STRONG") and of(snippet=" ", extraction_method="regex") == (0.45, "WEAK")


def test_sentences_of_verdicts(spark):
    """Written out once: the wording of conflicts and of their absence by the gate that decided."""
    rows = [("a", "b", "18.2.0", "^18.0.0", "version"), ("a", "c", "18.2.0", "16.0.0", "version"), ("d", "e", "TBD", "2024-01-05", "date")]
    ids = {i: v for a, b, x, y, _ in rows for i, v in ((a, x), (b, y))}
    kind = {"a": "version", "b": "version", "c": "version", "d": "date", "e": "date"}
    names = [f.split(" ", 1) for f in schemas.CLAIMS.split(", metadata")[0].split(", ")]
    made = spark.createDataFrame([(i, f"s{i}", "gateway", "node_version" if kind[i] == "version" else "launch_date", v, kind[i]) for i, v in ids.items()], "id string, source_id string, subject string, predicate string, value string, value_type string")
    made = made.withColumns({"confidence": F.lit(1.0), "environment": F.lit("production"), "scope": F.lit("service"), "source_role": F.lit("documentation"), "is_historical": F.lit(False), "observed_at": F.lit("2024-03-01").cast("timestamp")})
    claims = made.select(*(F.col(n) if n in made.columns else F.lit(None).cast(t).alias(n) for n, t in names), F.lit(None).cast(schemas.METADATA).alias("metadata"))
    wanted = spark.createDataFrame([*((a, b) for a, b, *_ in rows), ("a", "d")], "a_id string, b_id string")
    got = {(r.a_id, r.b_id): r.explanation for r in pairs.analyze_pairs(wanted, claims).collect()}
    assert got["a", "b"] == "No contradiction detected (COMPATIBLE_FACT): Values '18.2.0' and '^18.0.0' are compatible (e.g. version range satisfied or overlapping constraints)."
    assert got["d", "e"] == "Inconclusive comparison: Values 'TBD' and '2024-01-05' cannot be reliably compared under valueType 'date'."
    assert got["a", "d"].startswith("No contradiction detected: Claims refer to distinct subjects or predicates (")
    text = got["a", "c"]
    assert text.startswith("Both claims describe the node_version for 'gateway' (") and " Operational context: production vs production. However, Source (sa) reports '18.2.0' (observed on 2024-03-01). Meanwhile, Source (sc) reports '16.0.0' (observed on 2024-03-01). " in text
    assert text.endswith(" Classified as VERSION_MISMATCH with HIGH severity.")
