"""Registered queries of the conflict engine and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import lexicon as L
from .functions import context as X
from .functions import scores as S
from .functions import text as T
from .functions import values as V
from .operators import blocking, pairs, store
from .plans import discover
from .plans.driver_claims import event_claims, event_trust
from .sources import extract

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
AS_OF = "2024-02-15 00:00:00"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- SQL fragments -------------------------------------------------------------------------------------------

_CLAIMS = """claims AS (SELECT 'e' || lpad(event_id::VARCHAR, 10, '0') AS id, 'src' || (event_id % 7) AS source_id, 'user_' || user_id AS subject, event_type AS predicate,
    printf('%.2f', value) AS value, 1 - (event_id % 5) * 0.05::DOUBLE AS confidence, ts AS observed_at, event_id, user_id,
    (0.6::DOUBLE + (event_id % 7) * 0.05::DOUBLE) AS trust,
    CASE event_id % 4 WHEN 0 THEN 'production' WHEN 1 THEN 'staging' WHEN 2 THEN 'unknown' ELSE 'deployment' END AS environment,
    CASE event_id % 3 WHEN 0 THEN 'service' WHEN 1 THEN 'repository' ELSE 'unknown' END AS scope,
    CASE event_id % 5 WHEN 0 THEN 'configuration' WHEN 1 THEN 'documentation' WHEN 2 THEN 'deployment' WHEN 3 THEN 'example' ELSE 'historical' END AS source_role FROM events)"""


def _fixed(x: str, digits: int) -> str:
    n = 10**digits
    return f"((({x}) * 1152921504606846976::DOUBLE)::HUGEINT * {n} + 576460752303423488::HUGEINT) // 1152921504606846976::HUGEINT / {float(n)}::DOUBLE"


_INSIDE = "(contains({0}, {1}) OR contains({1}, {0})) AND least(length({0}), length({1})) / greatest(length({0}), length({1})) >= 0.6"
_ENTITY = _fixed("0.7::DOUBLE + (least(length(a.subject), length(b.subject)) - 1)::DOUBLE / (greatest(length(a.subject), length(b.subject)) - 1) * 0.15::DOUBLE", 2)
_PAIRS = f"""keys AS (SELECT DISTINCT subject, replace(subject, 'user_', '') || 'user' AS form FROM claims),
    alias AS (SELECT x.subject AS p, y.subject AS q FROM keys x JOIN keys y ON x.subject <> y.subject AND {_INSIDE.format("x.form", "y.form")} UNION ALL SELECT subject, subject FROM keys),
    pairs AS (SELECT a.id AS a_id, b.id AS b_id, a.id || '::' || b.id AS pair_key, a.subject AS asub, b.subject AS bsub, a.predicate, a.value AS av, b.value AS bv, a.confidence AS ac, b.confidence AS bc, a.trust AS ta, b.trust AS tb,
    a.environment AS ae, b.environment AS be, a.scope AS asc_, b.scope AS bsc, a.source_role AS ar, b.source_role AS br, a.source_id AS as_id, b.source_id AS bs_id, a.observed_at AS a_at, b.observed_at AS b_at,
    CASE WHEN a.subject = b.subject THEN 1.0::DOUBLE WHEN {_INSIDE.format("a.subject", "b.subject").replace("length(a.subject)", "(length(a.subject) - 1)").replace("length(b.subject)", "(length(b.subject) - 1)")} THEN {_ENTITY} ELSE 0.0::DOUBLE END AS same_subject
    FROM claims a JOIN alias ON a.subject = alias.p JOIN claims b ON b.subject = alias.q AND a.predicate = b.predicate AND a.id < b.id)"""
_CONTEXT = """ctx AS (SELECT *, CASE WHEN ar = 'historical' OR br = 'historical' THEN 'HISTORICAL' WHEN ar = 'example' OR br = 'example' THEN 'EXAMPLE'
    WHEN ae <> be AND ae <> 'unknown' AND be <> 'unknown' AND (ae = 'staging' OR be = 'staging') THEN 'DIFFERENT_ENVIRONMENT'
    WHEN (asc_ = 'service' AND bsc = 'repository') OR (asc_ = 'repository' AND bsc = 'service') THEN 'DIFFERENT_SCOPE' ELSE 'SAME_FACT' END AS relation FROM pairs)"""


_CONF = _fixed("same_subject * 0.3::DOUBLE + 1.0::DOUBLE * 0.3::DOUBLE + 0.85::DOUBLE * 0.2::DOUBLE + ((ac + bc) / 2) * 0.1::DOUBLE + ((ta + tb) / 2) * 0.1::DOUBLE - 0.0::DOUBLE", 2)
_FOUND = f"""found AS (SELECT *, 'QUANTITY_MISMATCH' AS contradiction_type, 'MEDIUM' AS severity, {_CONF} AS confidence FROM ctx WHERE same_subject >= 0.75 AND relation = 'SAME_FACT' AND abs(av::DOUBLE - bv::DOUBLE) >= 0.000001)"""
_PRIORITY = _fixed("0.5::DOUBLE * 0.35::DOUBLE + confidence * 0.35::DOUBLE + ((ta + tb) / 2) * 0.15::DOUBLE + ((ac + bc) / 2) * 0.1::DOUBLE + 1.0::DOUBLE * 0.05::DOUBLE", 3)


# --- blocking ------------------------------------------------------------------------------------------------


@query(f"WITH {_CLAIMS} SELECT subject, predicate, count(*) AS n_claims, count(*) * (count(*) - 1) // 2 AS n_pairs FROM claims GROUP BY ALL")
def pair_block_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count("*")
    return event_claims(spark, sf_dir).groupBy("subject", "predicate").agg(n.alias("n_claims"), F.expr("count(*) * (count(*) - 1) div 2").alias("n_pairs"))


@query(f"WITH {_CLAIMS}, {_PAIRS} SELECT a_id, b_id, pair_key FROM pairs")
def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.candidate_pairs(event_claims(spark, sf_dir))


_NATION = """n AS (SELECT 'n' || lpad(n_nationkey::VARCHAR, 3, '0') AS id, CASE WHEN n_nationkey % 3 = 0 THEN 'system' WHEN n_nationkey % 3 = 1 THEN 'cluster_' || n_regionkey ELSE 'spec' END AS subject,
    CASE n_nationkey % 4 WHEN 0 THEN 'http_port' WHEN 1 THEN 'port' WHEN 2 THEN 'ram' ELSE 'owner' END AS predicate FROM nation),
    k AS (SELECT *, CASE predicate WHEN 'port' THEN 'http_port' WHEN 'ram' THEN 'memory' ELSE predicate END AS pkey, subject IN ('system', 'spec') AS generic FROM n)"""


def _nation_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    subject = F.when(k % 3 == 0, "system").when(k % 3 == 1, F.concat(F.lit("cluster_"), F.col("n_regionkey").cast("string"))).otherwise("spec")
    predicate = F.when(k % 4 == 0, "http_port").when(k % 4 == 1, "port").when(k % 4 == 2, "ram").otherwise("owner")
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("n"), F.lpad(k.cast("string"), 3, "0")).alias("id"), subject.alias("subject"), predicate.alias("predicate"))


@query(f"WITH {_NATION} SELECT x.id AS a_id, y.id AS b_id, x.id || '::' || y.id AS pair_key FROM k x JOIN k y ON x.pkey = y.pkey AND x.id < y.id WHERE x.generic AND y.generic")
def global_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.global_pairs(blocking.keyed(_nation_claims(spark, sf_dir)))


@query(f"WITH {_NATION} SELECT least(x.id, y.id) AS a_id, greatest(x.id, y.id) AS b_id, least(x.id, y.id) || '::' || greatest(x.id, y.id) AS pair_key FROM k x JOIN k y ON x.pkey = y.pkey WHERE x.generic AND NOT y.generic AND x.pkey IN ('http_port', 'memory')")
def cross_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.cross_pairs(blocking.keyed(_nation_claims(spark, sf_dir)))


# --- verdicts ------------------------------------------------------------------------------------------------


def _analyzed(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = event_claims(spark, sf_dir)
    return pairs.analyze(pairs.matched(claims, event_trust(spark)))


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discover.scan_all(event_claims(spark, sf_dir), event_trust(spark), 0.0)


@query(f"WITH {_CLAIMS}, {_PAIRS}, {_CONTEXT} SELECT relation, count(*) AS n FROM ctx GROUP BY relation")
def context_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = event_claims(spark, sf_dir)
    p = pairs.matched(claims)
    return p.select(X.relation(F.col("a"), F.col("b"))["type"].alias("relation")).groupBy("relation").agg(F.count("*").alias("n"))


@query(f"WITH {_CLAIMS}, {_PAIRS}, {_CONTEXT}, {_FOUND} SELECT pair_key, contradiction_type, severity, confidence, {_PRIORITY} AS priority FROM found")
def confirmed_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).select("pair_key", "contradiction_type", "severity", "confidence", "priority")


@query(f"WITH {_CLAIMS}, {_PAIRS}, {_CONTEXT}, {_FOUND} SELECT contradiction_type, severity, count(*) AS n, max(confidence) AS top_confidence FROM found GROUP BY ALL")
def conflicts_by_type_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).groupBy("contradiction_type", "severity").agg(F.count("*").alias("n"), F.max("confidence").alias("top_confidence"))


@query(f"WITH {_CLAIMS}, {_PAIRS}, {_CONTEXT}, {_FOUND}, p AS (SELECT pair_key, confidence, {_PRIORITY} AS priority FROM found) SELECT * FROM p ORDER BY priority DESC, pair_key LIMIT 50")
def top_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.ranked(_found(spark, sf_dir).select("pair_key", "confidence", "priority"))


@query(f"""WITH {_CLAIMS}, t AS (SELECT *, replace(subject, '_', '') AS form FROM claims)
    SELECT least(x.id, y.id) || '::' || greatest(x.id, y.id) AS pair_key, 'e0000000007' AS probe FROM t x JOIN t y ON x.predicate = y.predicate AND x.id <> y.id
    WHERE x.id = 'e0000000007' AND (x.form = y.form OR ((contains(x.form, y.form) OR contains(y.form, x.form)) AND least(length(x.form), length(y.form)) / greatest(length(x.form), length(y.form)) >= 0.6))""")
def probe_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = event_claims(spark, sf_dir)
    return blocking.probe_pairs(claims.where("id = 'e0000000007'"), claims).select("pair_key", F.lit("e0000000007").alias("probe"))


# --- text ----------------------------------------------------------------------------------------------------

_SIM = """p AS (SELECT x.p_partkey AS a, y.p_partkey AS b, lower(x.p_name) AS s, lower(y.p_name) AS t FROM part x JOIN part y ON x.p_brand = y.p_brand AND x.p_size = y.p_size AND x.p_partkey < y.p_partkey)"""


def _part_pairs(spark: SparkSession, sf_dir: str, measures) -> DataFrame:
    return blocking.text_pairs(spark.read.parquet(f"{sf_dir}/part.parquet"), ["p_brand", "p_size"], "p_name", "p_partkey", measures)


_NORM = "trim(regexp_replace(regexp_replace(regexp_replace(lower({}), '[_\\-./\\\\:]+', ' ', 'g'), '[^\\p{{L}}\\p{{N}}\\s]', '', 'g'), '\\s+', ' ', 'g'))"


@query(f"SELECT p_partkey, {_NORM.format('p_name')} AS name, {_NORM.format('p_brand')} AS brand FROM part")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", T.normalize_text(F.col("p_name")).alias("name"), T.normalize_text(F.col("p_brand")).alias("brand"))


@query(f"""WITH {_SIM.replace("lower(x.p_name)", _NORM.format("x.p_name")).replace("lower(y.p_name)", _NORM.format("y.p_name"))},
    q AS (SELECT a, b, s, t, list_distinct(string_split(s, ' ')) AS u, list_distinct(string_split(t, ' ')) AS v FROM p)
    SELECT a, b, CASE WHEN s = t THEN 1.0::DOUBLE ELSE len(list_intersect(u, v))::DOUBLE / len(list_distinct(u || v)) END AS jaccard,
        CASE WHEN s = t THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - levenshtein(s, t)::DOUBLE / greatest(length(s), length(t)) END AS edit FROM q""")
def text_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    def measures(s, t):
        s, t = T.normalize_text(s), T.normalize_text(t)
        return T.token_jaccard(s, t).alias("jaccard"), T.edit_similarity(s, t).alias("edit")

    return _part_pairs(spark, sf_dir, measures)


_MEANING = "list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower({}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 2 AND w NOT IN ('the', 'and', 'for', 'with', 'from')))"
_NEAR_WORDS = "list_sum(list_transform(mu, lambda x: len(list_filter(mv, lambda y: x <> y AND (starts_with(x, y) OR starts_with(y, x)) AND least(length(x), length(y)) >= 4))))"


@query(f"""WITH {_SIM.replace("lower(x.p_name)", "x.p_name").replace("lower(y.p_name)", "y.p_name")},
    n AS (SELECT a, b, {_NORM.format("s")} AS s, {_NORM.format("t")} AS t, {_MEANING.format("s")} AS mu, {_MEANING.format("t")} AS mv FROM p),
    q AS (SELECT *, list_distinct(string_split(s, ' ')) AS u, list_distinct(string_split(t, ' ')) AS v FROM n),
    r AS (SELECT *, len(list_intersect(u, v))::DOUBLE / len(list_distinct(u || v)) AS j, 1.0::DOUBLE - levenshtein(s, t)::DOUBLE / greatest(length(s), length(t)) AS e,
        contains(' ' || t || ' ', ' ' || s || ' ') OR contains(' ' || s || ' ', ' ' || t || ' ') AS inside, least(length(s), length(t))::DOUBLE / greatest(length(s), length(t)) * 0.9::DOUBLE AS share,
        CASE WHEN len(mu) = 0 OR len(mv) = 0 THEN NULL ELSE least(1.0::DOUBLE, len(list_intersect(mu, mv))::DOUBLE / len(list_distinct(mu || mv)) + least(0.25::DOUBLE, {_NEAR_WORDS} * 0.1::DOUBLE)) END AS m FROM q)
    SELECT a, b, CASE WHEN s = t THEN 1.0::DOUBLE WHEN s = '' OR t = '' THEN 0.0::DOUBLE WHEN inside THEN greatest(j, e, share) WHEN j >= 0.5 THEN greatest(j, e) ELSE j END AS similarity,
        CASE WHEN m IS NULL THEN 0.0::DOUBLE ELSE {_fixed("m", 3)} END AS semantic FROM r""")
def composite_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part_pairs(spark, sf_dir, lambda s, t: (T.composite_similarity(s, t).alias("similarity"), T.semantic_similarity(s, t).alias("semantic")))


_SYNONYMS = [w for g in L.PREDICATE_SYNONYMS for w in g.split()]
_VALUES = ", ".join(f"('{w}', '{min(g.split())}', {k})" for k, (w, g) in enumerate((w, g) for g in L.PREDICATE_SYNONYMS for w in g.split()))


def _nth(words: list[str], n):
    return F.element_at(F.array(*map(F.lit, words)), (n % len(words) + 1).cast("int"))


@query(f"""SELECT p_partkey, predicate || CASE WHEN p_partkey % 3 = 0 THEN '_' || p_size ELSE '' END AS predicate, CASE WHEN p_partkey % 3 = 0 THEN predicate || '_' || p_size ELSE canonical END AS canonical
    FROM part JOIN (VALUES {_VALUES}) AS t(predicate, canonical, k) ON k = p_partkey % {len(_SYNONYMS)}""")
def canonical_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    p = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("predicate", F.concat(_nth(_SYNONYMS, k), F.when(k % 3 == 0, F.concat(F.lit("_"), F.col("p_size").cast("string"))).otherwise("")))
    return p.select("p_partkey", "predicate", T.canonical_predicate(F.col("predicate")).alias("canonical"))


_ALIAS_LIST = [w for g in L.ALIASES for w in g.split()]
_ALIAS_WORDS = ", ".join(f"('{w}', {k})" for k, g in enumerate(L.ALIASES) for w in g.split())
_ALIAS_PLACES = ", ".join(f"('{w}', {k})" for k, w in enumerate(_ALIAS_LIST))


@query(f"""WITH w AS (SELECT word, gid, regexp_replace(regexp_replace(word, '[._\\-\\s/]+', '', 'g'), '({"|".join(L.NOUN_SUFFIXES.split())})$', '') AS form FROM (VALUES {_ALIAS_WORDS}) AS v(word, gid)),
    g AS (SELECT form, max(gid) AS gid FROM w GROUP BY form), m AS (SELECT g.form AS fa, w.form AS fb FROM g JOIN w ON w.gid = g.gid GROUP BY ALL),
    p AS (SELECT x.word AS a, y.word AS b, x.form AS fa, y.form AS fb, m.fa IS NOT NULL AS alias, least(length(x.form), length(y.form))::DOUBLE / greatest(length(x.form), length(y.form)) AS ratio
        FROM w x CROSS JOIN w y LEFT JOIN m ON m.fa = x.form AND m.fb = y.form),
    r AS (SELECT *, CASE WHEN a = b THEN 'EXACT' WHEN fa <> '' AND fa = fb THEN 'NORMALIZED' WHEN alias THEN 'ALIAS'
        WHEN length(fa) >= 4 AND length(fb) >= 4 AND (contains(fa, fb) OR contains(fb, fa)) AND ratio >= 0.6 THEN 'SUFFIX_PREFIX' ELSE 'NONE' END AS match_type FROM p)
    SELECT o_orderkey, a, b, match_type <> 'NONE' AS is_match, CASE match_type WHEN 'EXACT' THEN 1.0 WHEN 'NORMALIZED' THEN 0.92 WHEN 'ALIAS' THEN 0.88 WHEN 'NONE' THEN 0.1 ELSE {_fixed("0.7::DOUBLE + ratio * 0.15::DOUBLE", 2)} END::DOUBLE AS confidence,
        match_type, match_type = 'SUFFIX_PREFIX' AND ratio < 0.75 AS is_ambiguous
    FROM orders JOIN (VALUES {_ALIAS_PLACES}) AS u(word, i) ON u.i = o_orderkey % {len(_ALIAS_LIST)} JOIN (VALUES {_ALIAS_PLACES}) AS v(word, i) ON v.i = o_custkey % {len(_ALIAS_LIST)} JOIN r ON r.a = u.word AND r.b = v.word""")
def entity_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of the known names for each order."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", _nth(_ALIAS_LIST, F.col("o_orderkey")).alias("a"), _nth(_ALIAS_LIST, F.col("o_custkey")).alias("b"))
    return rows.select("o_orderkey", "a", "b", T.resolve_entity(F.col("a"), F.col("b")).alias("r")).select("o_orderkey", "a", "b", "r.*")


# --- values --------------------------------------------------------------------------------------------------

_OL = "o AS (SELECT o_orderkey, o_totalprice, sum(l_extendedprice) AS line_total FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)"


@query(f"""WITH {_OL}, t AS (SELECT o_orderkey, '$' || printf('%.2f', o_totalprice) AS a, printf('%.2f', line_total) || ' USD' AS b FROM o)
    SELECT o_orderkey, abs(replace(a, '$', '')::DOUBLE - replace(b, ' USD', '')::DOUBLE) < 0.001 AS equal,
        CASE WHEN abs(replace(a, '$', '')::DOUBLE - replace(b, ' USD', '')::DOUBLE) < 0.001 THEN NULL ELSE 'AMOUNT_MISMATCH' END AS difference FROM t""")
def compare_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, l = spark.read.parquet(f"{sf_dir}/orders.parquet"), spark.read.parquet(f"{sf_dir}/lineitem.parquet")  # noqa: E741
    sums = l.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("line_total"))
    t = o.join(sums, "o_orderkey").select("o_orderkey", F.format_string("$%.2f", "o_totalprice").alias("a"), F.concat(F.col("line_total").cast("string"), F.lit(" USD")).alias("b"))
    return t.withColumn("c", V.compare(F.col("a"), F.col("b"), "price")).select("o_orderkey", "c.equal", "c.difference")


@query("""SELECT l_orderkey, l_linenumber, l_quantity = 24 AS equal, CASE WHEN l_quantity = 24 THEN 0.0::DOUBLE ELSE 0.85::DOUBLE END AS strength FROM lineitem""")
def compare_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.compare(F.concat(F.col("l_quantity").cast("bigint").cast("string"), F.lit(" GB")), F.lit("24,576 MB"), "quantity")
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", c.alias("c")).select("l_orderkey", "l_linenumber", "c.equal", "c.strength")


@query("""SELECT o_orderkey, o_orderdate::DATE = DATE '2024-01-15' AS equal,
    CASE WHEN o_orderdate::DATE = DATE '2024-01-15' THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, 0.4::DOUBLE + abs(date_diff('day', o_orderdate::DATE, DATE '2024-01-15')) * 0.1::DOUBLE) END AS strength FROM orders""")
def compare_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.compare(F.date_format("o_orderdate", "MM/dd/yyyy"), F.lit("January 15, 2024"), "date")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", c.alias("c")).select("o_orderkey", "c.equal", "c.strength")


@query("""SELECT o_orderkey, o_orderstatus = 'F' AS equal FROM orders""")
def compare_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.when(F.col("o_orderstatus") == "F", "Enabled").when(F.col("o_orderstatus") == "O", "off").otherwise("pending")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", V.compare(word, F.lit("active"), "status")["equal"].alias("equal"))


@query("""SELECT p_partkey, (p_size // 10) BETWEEN 2 AND 3 AS compatible, CASE WHEN (p_size // 10) BETWEEN 2 AND 3 THEN 'RANGE_SATISFIED' ELSE 'RANGE_VIOLATION' END AS difference FROM part""")
def compare_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.concat(F.expr("p_size div 10"), F.lit("."), F.col("p_size") % 10, F.lit(".0"))
    c = V.compare(v, F.lit(">=2.0.0 <4"), "version")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", c.alias("c")).select("p_partkey", "c.compatible", "c.difference")


# --- scores --------------------------------------------------------------------------------------------------

_ROLE = "CASE source_role WHEN 'configuration' THEN 0.9 WHEN 'documentation' THEN 0.55 WHEN 'deployment' THEN 0.95 WHEN 'example' THEN 0.25 ELSE 0.15 END::DOUBLE"
_AUTH = _fixed(f"{_ROLE} * 0.4::DOUBLE + trust * 0.25::DOUBLE + 0.6::DOUBLE * 0.2::DOUBLE + 0.5::DOUBLE * 0.15::DOUBLE", 4)


@query(f"WITH {_CLAIMS} SELECT id, {_AUTH} AS authority FROM claims")
def authority_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = event_claims(spark, sf_dir).join(F.broadcast(event_trust(spark).withColumnRenamed("id", "source_id")), "source_id")
    return c.select("id", S.authority(F.col("source_role"), F.col("trust_score"), F.col("metadata")).alias("authority"))


@query(f"WITH {_CLAIMS} SELECT id, round({_fixed(f"greatest(0.2, least(1.0, exp(-0.693 * (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(observed_at)) / 86400000000.0 / 180)))::DOUBLE", 4)}, 3) AS freshness FROM claims")
def freshness_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    null = F.lit(None).cast("timestamp")
    score = S.freshness(F.col("is_historical"), F.col("observed_at"), F.col("valid_from"), F.col("valid_until"), null, F.lit(AS_OF).cast("timestamp"))
    return event_claims(spark, sf_dir).select("id", F.round(score, 3).alias("freshness"))


def _advice_side(role: str, trust: str, at: str) -> tuple[str, str]:
    weight = _ROLE.replace("source_role", role)
    fresh = f"greatest(0.2, least(1.0, exp(-0.693 * (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us({at})) / 86400000000.0 / 180)))::DOUBLE"
    return _fixed(f"{weight} * 0.4::DOUBLE + {trust} * 0.25::DOUBLE + 0.6::DOUBLE * 0.2::DOUBLE + 0.5::DOUBLE * 0.15::DOUBLE", 4), _fixed(fresh, 4)


_ADVICE_A, _ADVICE_B = _advice_side("ar", "ta", "a_at"), _advice_side("br", "tb", "b_at")
_WINS = "CASE WHEN abs({0} - {1}) < 0.08::DOUBLE THEN 'tie' WHEN {0} > {1} THEN 'claimA' ELSE 'claimB' END"


# Both sides' evidence is a heuristic without line or snippet, so it leads nowhere.
@query(f"""WITH {_CLAIMS}, {_PAIRS}, {_CONTEXT}, {_FOUND}, s AS (SELECT pair_key, ar, br, {_ADVICE_A[0]} AS xa, {_ADVICE_B[0]} AS xb, {_ADVICE_A[1]} AS fa, {_ADVICE_B[1]} AS fb FROM found),
    w AS (SELECT *, {_WINS.format("xa", "xb")} AS by_auth, {_WINS.format("fa", "fb")} AS by_fresh FROM s),
    v AS (SELECT *, by_auth <> 'tie' AND by_fresh IN (by_auth, 'tie') AS agree, by_auth <> 'tie' AND by_fresh <> 'tie' AND by_fresh <> by_auth AS against,
        CASE by_auth WHEN 'claimA' THEN xa >= 0.85::DOUBLE AND br IN ('documentation', 'example') ELSE xb >= 0.85::DOUBLE AND ar IN ('documentation', 'example') END AS firm FROM w)
    SELECT pair_key, CASE WHEN agree OR (against AND firm) THEN by_auth ELSE 'uncertain' END AS likely,
        CASE WHEN agree THEN least(0.95::DOUBLE, {_fixed("0.6::DOUBLE + abs(xa - xb) * 0.4::DOUBLE", 2)}) WHEN against AND firm THEN 0.72::DOUBLE WHEN against THEN 0.45::DOUBLE ELSE 0.5::DOUBLE END AS confidence,
        by_auth AS authority_winner, by_fresh AS freshness_winner FROM v""")
def resolution_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, now, null = _found(spark, sf_dir), F.lit(AS_OF).cast("timestamp"), F.lit(None).cast("timestamp")
    for n in ("a", "b"):
        c = F.col(n)
        f = f.withColumns({f"{n}_auth": S.authority(c["source_role"], F.col(f"{n}_trust"), c["metadata"]), f"{n}_fresh": S.freshness(c["is_historical"], c["observed_at"], c["valid_from"], c["valid_until"], null, now), f"{n}_evid": S.evidence(c["metadata"])})
    adv = S.advice(F.col("a_auth"), F.col("b_auth"), F.col("a_fresh"), F.col("b_fresh"), F.col("a_evid"), F.col("b_evid"), F.col("a.source_role"), F.col("b.source_role"))
    return f.select("pair_key", adv.alias("x")).select("pair_key", "x.*")


# --- store ---------------------------------------------------------------------------------------------------


@query(f"WITH {_CLAIMS}, o AS (SELECT *, lag(value) OVER w AS before, row_number() OVER w AS n FROM claims WINDOW w AS (PARTITION BY subject, predicate ORDER BY observed_at, id)) SELECT subject, predicate, id, value FROM o WHERE n = 1 OR value IS DISTINCT FROM before")
def claim_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.value_changes(event_claims(spark, sf_dir), ["subject", "predicate"]).select("subject", "predicate", "id", "value")


@query(f"WITH {_CLAIMS} SELECT subject || ':' || predicate AS external_id, arg_max(id, (observed_at, id)) AS id, arg_max(value, (observed_at, id)) AS value FROM claims GROUP BY ALL")
def claim_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.latest(event_claims(spark, sf_dir), ["external_id"], [F.col("observed_at"), F.col("id")]).select("external_id", "id", "value")


@query(f"WITH {_CLAIMS}, h AS (SELECT subject || ':' || predicate AS k, event_id < 5000 AS early, value, observed_at, id FROM claims), l AS (SELECT k, early, arg_max(value, (observed_at, id)) AS value FROM h GROUP BY ALL), j AS (SELECT a.value AS old, b.value AS new FROM (SELECT * FROM l WHERE early) a FULL JOIN (SELECT * FROM l WHERE NOT early) b USING (k)) SELECT CASE WHEN new IS NULL THEN 'kept' WHEN old IS NULL THEN 'created' WHEN old <> new THEN 'updated' ELSE 'unchanged' END AS change, count(*) AS n FROM j GROUP BY ALL")
def upsert_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = event_claims(spark, sf_dir)
    now = [F.col("observed_at"), F.col("id")]
    early, late = (store.latest(c.where(w), ["external_id"], now) for w in ("id < 'e0000005000'", "id >= 'e0000005000'"))
    return store.upsert_claims(early, late).groupBy("change").agg(F.count("*").alias("n"))


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = blocking.candidate_pairs(event_claims(spark, sf_dir))
    hit = F.substring("a_id", -1, 1).isin("0", "5")
    return p.where(hit).select(F.col("pair_key").alias("id"), F.col("a_id").alias("claim_a_id"), F.col("b_id").alias("claim_b_id"), F.lit("OPEN").alias("status"))


@query(f"WITH {_CLAIMS}, {_PAIRS}, {_CONTEXT}, {_FOUND} SELECT count(*) AS found, count(*) FILTER (right(a_id, 1) NOT IN ('0', '5')) AS new, count(*) FILTER (right(a_id, 1) IN ('0', '5')) AS existing, (SELECT count(*) FROM pairs) AS candidate_pairs FROM found")
def new_vs_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discover.summary(_analyzed(spark, sf_dir), _stored(spark, sf_dir))


@query(f"WITH {_CLAIMS}, {_PAIRS}, {_CONTEXT}, {_FOUND} SELECT pair_key FROM found WHERE right(a_id, 1) NOT IN ('0', '5')")
def dismissed_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discover.visible(_found(spark, sf_dir), _stored(spark, sf_dir).withColumn("status", F.lit("DISMISSED"))).select("pair_key")


def _review_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    action = F.when(i % 4 == 0, "REVIEW").when(i % 4 == 1, "RESOLVE").when(i % 4 == 2, "DISMISS").otherwise("REOPEN")
    chosen = F.when(i % 4 == 1, F.concat(F.lit("c"), (i % 2).cast("string")))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat(F.lit("k"), F.col("user_id").cast("string")).alias("contradiction_id"), i.alias("seq"), action.alias("action"), F.col("ts").alias("performed_at"), chosen.alias("chosen_claim_id"))


_LOG = "l AS (SELECT 'k' || user_id AS id, event_id AS seq, CASE event_id % 4 WHEN 0 THEN 'REVIEWED' WHEN 1 THEN 'RESOLVED' WHEN 2 THEN 'DISMISSED' ELSE 'OPEN' END AS status, CASE WHEN event_id % 4 = 1 THEN 'c' || (event_id % 2) END AS chosen FROM events)"


@query(f"WITH {_LOG} SELECT id, arg_max(status, seq) AS status, arg_max(chosen, seq) FILTER (chosen IS NOT NULL) AS chosen_claim_id FROM l GROUP BY id")
def lifecycle_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _review_log(spark, sf_dir)
    base = log.select(F.col("contradiction_id").alias("id"), F.lit("OPEN").alias("status")).distinct()
    return store.current_status(base, log).select("id", "status", "chosen_claim_id")


@query(f"WITH {_LOG} SELECT id AS contradiction_id, seq, status AS new_status, coalesce(lag(status) OVER (PARTITION BY id ORDER BY seq), 'OPEN') AS previous_status FROM l")
def lifecycle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.audit(_review_log(spark, sf_dir)).select("contradiction_id", "seq", "new_status", "previous_status")


@query(f"WITH {_CLAIMS} SELECT id, subject, value FROM claims WHERE predicate = 'click' AND environment = 'production' ORDER BY observed_at DESC, id LIMIT 50 OFFSET 10")
def claims_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.page(event_claims(spark, sf_dir), {"predicate": "click", "environment": "production"}, limit=50, offset=10).select("id", "subject", "value")


@query(f"WITH {_CLAIMS} SELECT id FROM claims WHERE source_id = 'src6'")
def orphan_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.orphans(event_claims(spark, sf_dir), "source_id", event_trust(spark).where("id <> 'src6'")).select("id")


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS hits FROM events")
def rate_limit_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-3_600_000_000, 0)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.count("*").over(w).alias("hits"))


# --- extraction ----------------------------------------------------------------------------------------------


#: Written as in a page, with the lines that it must give; %s is the page's number.
_SAMPLE = "<title>A sample</title>\r\n<p>\tTimeout: %ss\r\n// note\n\t// hidden</p>Port<SCRIPT>var a = '<b>';</SCRIPT>8080 here<br>It&#8217;s &apos;ok&apos; &amp;lt;b&amp;gt; &#x41;BC<table><tr><td>Owner&nbsp;</td><td> <b>team</b> &amp; co</td><td>third</td></tr><tr><td>lone&nbsp;cell</td></tr></table>"
_SAMPLE_LINES = ("A sample", "Timeout: %ss", "Port 8080 here", "It\u2019s 'ok' <b> ABC", "Owner: team  & co", "lone cell")
_ENDS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(65279)"


@query(rf"""WITH l AS (SELECT page_id, unnest(string_split(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>', ' ', 'g'), '<[^>]+>', chr(10), 'g'), chr(10))) AS line FROM pages),
    d AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(line, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', ' ') AS line FROM l),
    t AS (SELECT page_id, trim(unnest(string_split_regex(line, '\r?\n')), {_ENDS}) AS line FROM d)
    SELECT page_id, line FROM t WHERE length(line) > 3 AND line NOT LIKE '//%' AND line NOT LIKE '/*%'
    UNION ALL SELECT -1 - page_id, replace(unnest([{", ".join("'" + x.replace("'", "''") + "'" for x in _SAMPLE_LINES)}]), '%s', page_id::VARCHAR) FROM pages""")
def html_clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of the table, and for each of them one with control characters, references of all kinds, a script inside a line and table rows."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")
    samples = pages.select((-1 - F.col("page_id")).alias("page_id"), F.replace(F.lit(_SAMPLE), F.lit("%s"), F.col("page_id").cast("string")).alias("html"))
    return extract.html_lines(pages.unionByName(samples)).select("page_id", "line")


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
    SELECT doc_id, regexp_extract(line, '(?i)licensed\s+under\s+the\s+([A-Za-z0-9.\-]+)', 1) AS license FROM l WHERE regexp_matches(line, '(?i)licensed\s+under\s+the\s+([A-Za-z0-9.\-]+)')""")
def license_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.license_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
