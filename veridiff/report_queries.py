"""Registered queries on synchronisation, explanations, identity and values of mixed types, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import explain as E
from .operators import aliases, blocking, pairs, store, sync
from .operators.index import BlockIndex
from .operators.versioned import KeyedTable, scratch
from .plans.driver_claims import MIXED, ODD, event_claims, event_trust, mixed_claims, odd_claims
from .queries import _CLAIMS, _INSIDE, _LOG, _PAIRS, _fixed, _review_log, query
from .sources import extract, scan
from .streaming import state

_CASE = lambda x, items: f"CASE {x} " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(items)) + " END"
_QUOTED = lambda x: "'" + x.replace("'", "''") + "'"
_VALUE = _CASE(f"event_id % {len(MIXED)}", [_CASE(f"(event_id // {len(MIXED)}) % {len(v)}", map(_QUOTED, v)) for _, v in MIXED])
_MIXED = f"""m AS (SELECT * REPLACE ({_CASE(f"event_id % {len(MIXED)}", [_QUOTED(n) for n, _ in MIXED])} AS predicate, {_VALUE} AS value, 'unit_' || lpad(user_id::VARCHAR, 6, '0') AS subject) FROM claims)"""


@query(rf"""WITH {_CLAIMS}, {_MIXED}, a AS (SELECT id, predicate AS p, lower(trim(value)) AS v FROM m UNION ALL SELECT id || 'x', predicate, value FROM claims)
    SELECT id, CASE WHEN regexp_matches(v, '^\d{{1,3}}(\.\d{{1,3}}){{3}}(:\d+)?(/\d+)?$|^localhost$') OR regexp_matches(p, 'host|ip_address|^ip$|^address$|_ip$') THEN 'address'
        WHEN regexp_matches(p, 'version|release|semver') OR regexp_matches(v, '^v\d+(\.\d+)*(-\w+)?$|^(>=|<=|>|<|=)\s*\d+') OR regexp_matches(v, '^\^?~?[v=]?\d+\.\d+(\.\d+)*(-\w+)?$') AND regexp_matches(p || '|' || v, 'node|python|ruby|go|java|runtime|ver|\|[~^v=]') THEN 'version'
        WHEN regexp_matches(p, 'price|cost|fee|budget') OR regexp_matches(v, '[$€£¥₹]|\b(inr|usd|eur|gbp|jpy|cad|aud)\b') THEN 'price'
        WHEN regexp_matches(p, 'date|deadline|expires|expiry') OR regexp_matches(v, '^\d{{4}}[-/.]\d{{1,2}}[-/.]\d{{1,2}}|^\d{{1,2}}[/.-]\d{{1,2}}[/.-]\d{{4}}') THEN 'date'
        WHEN regexp_matches(p, 'port|ram|memory|cpu|timeout|ttl|count|limit|capacity|max_|min_') OR regexp_matches(v, '^[-+]?[\d,]+(\.\d+)?\s*(gb|mb|kb|tb|ms|s|min|h|d)?$') THEN 'quantity'
        WHEN regexp_matches(p, 'status|state|enabled|disabled') OR v IN ('true', 'false', 'yes', 'no', 'enabled', 'disabled', 'on', 'off') THEN 'status'
        WHEN regexp_matches(p, 'policy|rule') THEN 'policy' WHEN regexp_matches(p, 'requirement|prerequisite') THEN 'requirement' ELSE 'configuration' END AS value_type FROM a""")
def value_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = event_claims(spark, sf_dir).select(F.concat("id", F.lit("x")).alias("id"), "predicate", "value")
    both = mixed_claims(spark, sf_dir).select("id", "predicate", "value").unionByName(plain)
    return both.select("id", extract.value_type(F.col("predicate"), F.col("value")).alias("value_type"))


# --- verdicts on values of all types: per predicate and pair of values the comparison, written out -------------------


def _compared() -> str:
    """Rows (predicate, av, bv, equal, compatible, strength, difference, na, nb) for the MIXED values, reasoned out by hand per type."""
    rows = []

    def add(p, a, b, equal, strength, difference, na, nb, comparable=True):
        rows.append((p, a, b, equal, strength, difference, na, nb, comparable))

    days = {"2024-01-15": 0, "15.01.2024": 0, "2024-01-19": 4, "2024/03/01": 46}
    iso = {"2024-01-15": "2024-01-15", "15.01.2024": "2024-01-15", "2024-01-19": "2024-01-19", "2024/03/01": "2024-03-01"}
    money = {"$12.50": ("USD", "12.5"), "12.50 USD": ("USD", "12.5"), "$13.00": ("USD", "13"), "12.50 EUR": ("EUR", "12.5")}
    size = {"1 GB": 1024, "1024 MB": 1024, "2 GB": 2048}
    mood = {"enabled": 1, "Active": 1, "failed": 0, "true": 1, "no": 0, "on": 1}
    for p, values in MIXED:
        for a in values:
            for b in values:
                if a == "" or b == "":
                    add(p, a, b, a == b, 0.0 if a == b else 1.0, None if a == b else "EMPTY_VS_NONEMPTY", a, b)
                elif p == "node_version":
                    x, y = a.lstrip("v"), b.lstrip("v")
                    major = x.split(".")[0] != y.split(".")[0]
                    add(p, a, b, x == y, 0.0 if x == y else 1.0 if major else 0.6, None if x == y else "MAJOR_VERSION_MISMATCH" if major else "MINOR_VERSION_MISMATCH", x, y)
                elif p == "launch_date":
                    d = abs(days[a] - days[b])
                    add(p, a, b, d == 0, 0.0 if d == 0 else min(1.0, 0.4 + d * 0.1), None if d == 0 else "DATE_MISMATCH", iso[a], iso[b])
                elif p == "unit_price":
                    (ca, xa), (cb, xb) = money[a], money[b]
                    same = (ca, xa) == (cb, xb)
                    add(p, a, b, same, 0.0 if same else 0.9 if ca == cb else 1.0, None if same else "AMOUNT_MISMATCH" if ca == cb else "CURRENCY_MISMATCH", f"{ca} {xa}", f"{cb} {xb}")
                elif p == "memory":
                    if (a in size) != (b in size):
                        add(p, a, b, False, 0.9, "UNIT_MISMATCH", a, b)
                    else:
                        same = size.get(a, a) == size.get(b, b)
                        add(p, a, b, same, 0.0 if same else 0.85, None if same else "NUMERIC_MISMATCH", a, b)
                elif p == "http_port":
                    add(p, a, b, a == b, 0.0 if a == b else 0.85, None if a == b else "NUMERIC_MISMATCH", a, b)
                elif p in ("build_status", "debug_enabled"):
                    same = a.lower() == b.lower() or a in mood and b in mood and mood[a] == mood[b]
                    add(p, a, b, same, 0.0 if same else 0.95, None if same else "STATUS_MISMATCH", a.lower(), b.lower())
                else:
                    x, y = (" ".join(v.split()) for v in (a, b))
                    same = x.lower() == y.lower()
                    add(p, a, b, same, 0.0 if same else 0.8, None if same else "VALUE_MISMATCH", x, y)
    lit = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else f"{v!r}::DOUBLE" if isinstance(v, float) else _QUOTED(v)
    rows = list(dict.fromkeys(rows))
    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r[:8])) + ")" for r in rows) + ") AS t(predicate, av, bv, equal, strength, difference, na, nb)"


_FACTS = f"""facts AS (SELECT x.id AS a_id, y.id AS b_id, x.id || '::' || y.id AS pair_key, x.subject, x.predicate, c.*EXCLUDE (predicate), x.confidence AS ac, y.confidence AS bc, x.trust AS ta, y.trust AS tb,
    x.environment AS ae, y.environment AS be, x.scope AS asc_, y.scope AS bsc, x.source_role AS ar, y.source_role AS br, x.source_id AS sa, y.source_id AS sb, x.observed_at AS ta_at, y.observed_at AS tb_at
    FROM m x JOIN m y ON x.subject = y.subject AND x.predicate = y.predicate AND x.id < y.id JOIN {_compared()} ON t.predicate = x.predicate AND t.av = x.value AND t.bv = y.value)""".replace("c.*EXCLUDE (predicate)", "t.av, t.bv, t.equal, t.strength, t.difference, t.na, t.nb")
_JUDGED = f"""judged AS (SELECT *, CASE WHEN ar = 'historical' OR br = 'historical' THEN 'HISTORICAL' WHEN ar = 'example' OR br = 'example' THEN 'EXAMPLE'
    WHEN ae <> be AND ae <> 'unknown' AND be <> 'unknown' AND (ae = 'staging' OR be = 'staging') THEN 'DIFFERENT_ENVIRONMENT'
    WHEN (asc_ = 'service' AND bsc = 'repository') OR (asc_ = 'repository' AND bsc = 'service') THEN 'DIFFERENT_SCOPE' ELSE 'SAME_FACT' END AS relation,
    CASE WHEN difference = 'EMPTY_VS_NONEMPTY' THEN 'EXISTENCE_MISMATCH' ELSE CASE predicate WHEN 'node_version' THEN 'VERSION_MISMATCH' WHEN 'launch_date' THEN 'DATE_MISMATCH' WHEN 'unit_price' THEN 'VALUE_MISMATCH'
        WHEN 'access_policy' THEN 'POLICY_MISMATCH' WHEN 'login_requirement' THEN 'REQUIREMENT_MISMATCH' WHEN 'http_port' THEN 'QUANTITY_MISMATCH' WHEN 'memory' THEN 'QUANTITY_MISMATCH'
        WHEN 'build_status' THEN 'STATUS_MISMATCH' WHEN 'debug_enabled' THEN 'STATUS_MISMATCH' ELSE 'CONFIGURATION_MISMATCH' END END AS kind,
    CASE WHEN predicate = 'access_policy' THEN 'CRITICAL' WHEN predicate IN ('environment_name', 'unit_price') OR difference = 'MAJOR_VERSION_MISMATCH' THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
    {_fixed("1.0::DOUBLE * 0.3::DOUBLE + 1.0::DOUBLE * 0.3::DOUBLE + strength * 0.2::DOUBLE + ((ac + bc) / 2) * 0.1::DOUBLE + ((ta + tb) / 2) * 0.1::DOUBLE - 0.0::DOUBLE", 2)} AS score FROM facts)"""
_VERDICT = f"WITH {_CLAIMS}, {_MIXED}, {_FACTS}, {_JUDGED}"


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = mixed_claims(spark, sf_dir)
    return pairs.analyze(pairs.matched(claims, event_trust(spark)))


@query(f"{_VERDICT} SELECT pair_key, kind AS contradiction_type, severity, difference, na AS normalized_a, nb AS normalized_b, score AS confidence FROM judged WHERE relation = 'SAME_FACT' AND NOT equal")
def mixed_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pairs.confirmed(_judged(spark, sf_dir))
    return found.select("pair_key", "contradiction_type", "severity", "cmp.difference", "cmp.normalized_a", "cmp.normalized_b", "confidence")


_FACT = """'Both claims describe the ' || predicate || ' for ''' || subject || ''' (Matches same conceptual fact on subject ''' || replace(subject, '_', ' ') || ''' and predicate ''' || replace(predicate, '_', ' ') || ''' (matched via predicate synonym dictionary)).'"""
_SAID = lambda s, v, t: f"'Source ' || {s} || ' reports ''' || {v} || ''' (observed on ' || strftime({t}, '%Y-%m-%d') || ').'"


@query(f"""{_VERDICT} SELECT pair_key, CASE WHEN relation = 'HISTORICAL' THEN 'No contradiction detected (HISTORICAL): ' || CASE WHEN ar = 'historical' THEN 'Claim A' ELSE 'Claim B' END || {_QUOTED(E.CONTEXTS["HISTORICAL"][2:])}
    WHEN relation = 'EXAMPLE' THEN 'No contradiction detected (EXAMPLE): ' || {_QUOTED(E.CONTEXTS["EXAMPLE"])}
    WHEN relation = 'DIFFERENT_ENVIRONMENT' THEN 'No contradiction detected (DIFFERENT_ENVIRONMENT): ' || format({_QUOTED(E.CONTEXTS["DIFFERENT_ENVIRONMENT"].replace("%s", "{}"))}, ae, be)
    WHEN relation = 'DIFFERENT_SCOPE' THEN 'No contradiction detected (DIFFERENT_SCOPE): ' || format({_QUOTED(E.CONTEXTS["DIFFERENT_SCOPE"].replace("%s", "{}"))}, asc_, bsc)
    WHEN equal THEN 'No contradiction detected: Both claims specify equivalent values for ''' || subject || ''' (''' || na || ''').'
    ELSE {_FACT} || CASE WHEN ae <> 'unknown' THEN ' Operational context: ' || ae || ' vs ' || be || '.' ELSE '' END || ' However, '
        || CASE WHEN sa = sb THEN 'Source ' || sa || ' reports ''' || av || '''.' ELSE {_SAID("sa", "av", "ta_at")} END || ' Meanwhile, '
        || CASE WHEN sa = sb THEN 'Within the same file/source, conflictingly asserted as ''' || bv || '''.' ELSE {_SAID("sb", "bv", "tb_at")} END || ' '
        || CASE kind WHEN 'EXISTENCE_MISMATCH' THEN {_QUOTED(E.ABSENT)} ELSE CASE kind {" ".join(f"WHEN '{k}' THEN {_QUOTED(v)}" for k, v in E.REASONS.items())} ELSE {_QUOTED(E.OTHERWISE)} END
            || CASE WHEN na <> av OR nb <> bv THEN ' Normalized as ''' || na || ''' vs ''' || nb || '''.' ELSE '' END END
        || ' Classified as ' || kind || ' with ' || severity || ' severity.' END AS explanation FROM judged""")
def pair_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = event_trust(spark).select("id", F.concat(F.lit("Source "), "id").alias("name"))
    return pairs.with_explanation(_judged(spark, sf_dir), names).select("pair_key", "explanation")


@query(f"""{_VERDICT} SELECT a_id, b_id, CASE WHEN relation <> 'SAME_FACT' THEN relation WHEN equal THEN 'SAME_FACT' ELSE 'INCOMPATIBLE_FACT' END AS relation,
    CASE WHEN relation = 'SAME_FACT' AND NOT equal THEN 'CONFIRMED_CONTRADICTION' ELSE 'NOT_A_CONTRADICTION' END AS status FROM judged WHERE right(a_id, 2) = '07'""")
def analyze_claim_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = mixed_claims(spark, sf_dir)
    wanted = blocking.candidate_pairs(claims).where("substring(a_id, -2) = '07'").select("a_id", "b_id")
    return pairs.analyze_pairs(wanted, claims).select("a_id", "b_id", "relation", "status")


# --- every gate of the verdict: values that no rule reads, untyped values, ranges, types that clash -----------------------


def _odd_outcomes() -> str:
    """Rows (predicate, ka, kb, gate, difference, strength, na, nb) for the ODD values, reasoned out by hand; a pair reads the same from both sides."""
    shown = {
        "launch_deadline": ("TBD", "2024-01-05", "2024-01-15", "2024-01-15", "next spring"), "remark": ("hello", "world", "8080-01-01", "9090-01-01", "30 d"),
        "retention": ("30 days", "60 days", "30 days"), "node_version": ("18.0.0", "18.2.0", "16.0.0", "18.0.0"), "endpoint": ("10.0.0.1", "80", "localhost"),
    }
    mixed = {  # what differs from "equal to itself, else different"
        ("launch_deadline", 0, 1): ("VAGUE", "UNPARSEABLE_DATE", 0.5, "TBD", "2024-01-05"), ("launch_deadline", 0, 2): ("VAGUE", "UNPARSEABLE_DATE", 0.5, "TBD", "Tue, 15 Jan 2024 10:00:00 +0000"),
        ("launch_deadline", 0, 3): ("VAGUE", "UNPARSEABLE_DATE", 0.5, "TBD", "January 15, 2024"), ("launch_deadline", 0, 4): ("VAGUE", "UNPARSEABLE_DATE", 0.5, "TBD", "next spring"),
        ("launch_deadline", 0, 0): ("EQUAL", "UNPARSEABLE_DATE", 0.5, "TBD", "TBD"), ("launch_deadline", 4, 4): ("EQUAL", "UNPARSEABLE_DATE", 0.5, "next spring", "next spring"),
        ("launch_deadline", 1, 4): ("VAGUE", "UNPARSEABLE_DATE", 0.5, "2024-01-05", "next spring"), ("launch_deadline", 2, 4): ("VAGUE", "UNPARSEABLE_DATE", 0.5, "Tue, 15 Jan 2024 10:00:00 +0000", "next spring"),
        ("launch_deadline", 3, 4): ("VAGUE", "UNPARSEABLE_DATE", 0.5, "January 15, 2024", "next spring"), ("launch_deadline", 1, 2): ("CONFLICT", "DATE_MISMATCH", 1.0, "2024-01-05", "2024-01-15"),
        ("launch_deadline", 1, 3): ("CONFLICT", "DATE_MISMATCH", 1.0, "2024-01-05", "2024-01-15"), ("launch_deadline", 2, 3): ("EQUAL", None, 0.0, "2024-01-15", "2024-01-15"),
        ("remark", 2, 3): ("CONFLICT", "DATE_MISMATCH", 1.0, "8080-01-01", "9090-01-01"), ("remark", 2, 4): ("CONFLICT", "UNIT_MISMATCH", 0.9, "8080", "30 d"), ("remark", 3, 4): ("CONFLICT", "UNIT_MISMATCH", 0.9, "9090", "30 d"),
        ("retention", 0, 1): ("CONFLICT", "NUMERIC_MISMATCH", 0.85, "30 d", "60 d"), ("retention", 0, 2): ("EQUAL", None, 0.0, "30 d", "30 d"),
        ("node_version", 0, 1): ("COMPATIBLE", "RANGE_SATISFIED", 0.0, "18.0.0", "18.2.0"), ("node_version", 0, 2): ("CONFLICT", "RANGE_VIOLATION", 1.0, "18.0.0", "16.0.0"),
        ("node_version", 0, 3): ("COMPATIBLE", "RANGES_INTERSECT", 0.0, "18.0.0", "18.0.0"), ("node_version", 1, 2): ("CONFLICT", "MAJOR_VERSION_MISMATCH", 1.0, "18.2.0", "16.0.0"),
        ("node_version", 1, 3): ("COMPATIBLE", "RANGE_SATISFIED", 0.0, "18.2.0", "18.0.0"), ("node_version", 2, 3): ("CONFLICT", "RANGE_VIOLATION", 1.0, "16.0.0", "18.0.0"),
        ("endpoint", 0, 1): ("TYPES", None, None, None, None), ("endpoint", 1, 2): ("TYPES", None, None, None, None),
    }
    rows = []
    for p, values in ODD.items():
        for a in range(len(values)):
            for b in range(len(values)):
                gate, difference, strength, na, nb = mixed.get((p, min(a, b), max(a, b))) or (("EQUAL", None, 0.0, shown[p][a], shown[p][a]) if a == b else ("CONFLICT", "VALUE_MISMATCH", 0.8, *sorted((values[a][0], values[b][0]), key=lambda v: v == values[max(a, b)][0])))
                if a > b:
                    na, nb = nb, na
                rows.append((p, a, b, gate, difference, strength, na, nb))
    lit = lambda v: "NULL" if v is None else f"{v!r}::DOUBLE" if isinstance(v, float) else str(v) if isinstance(v, int) else _QUOTED(v)
    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + ") AS t(predicate, ka, kb, gate, difference, strength, na, nb)"


_ODD = f"""odd AS (SELECT id, user_id, event_id, {_CASE(f"event_id % {len(ODD)}", [_QUOTED(p) for p in ODD])} AS predicate, (event_id // {len(ODD)}) % {_CASE(f"event_id % {len(ODD)}", [str(len(v)) for v in ODD.values()])} AS k, (event_id // 7) % 5 = 4 AS old FROM claims),
    wanted AS (SELECT x.id AS a_id, y.id AS b_id FROM odd x JOIN odd y ON x.user_id = y.user_id AND x.predicate = y.predicate AND x.id <= y.id
        UNION ALL SELECT a_id, b_id FROM (SELECT id AS a_id, lead(id) OVER w AS b_id, predicate AS p, lead(predicate) OVER w AS q FROM odd WINDOW w AS (PARTITION BY user_id ORDER BY id)) WHERE p <> q),
    gated AS (SELECT a_id, b_id, CASE WHEN a_id = b_id THEN 'SELF' WHEN x.predicate <> y.predicate THEN 'NO_MATCH' WHEN x.old OR y.old THEN 'CONTEXT' ELSE t.gate END AS g, t.*
        FROM wanted JOIN odd x ON x.id = a_id JOIN odd y ON y.id = b_id LEFT JOIN {_odd_outcomes()} ON t.predicate = x.predicate AND x.predicate = y.predicate AND t.ka = x.k AND t.kb = y.k)"""


@query(f"""WITH {_CLAIMS}, {_ODD} SELECT a_id, b_id, g AS gate, CASE g WHEN 'CONFLICT' THEN 'CONFIRMED_CONTRADICTION' WHEN 'VAGUE' THEN 'UNCERTAIN' ELSE 'NOT_A_CONTRADICTION' END AS status,
    CASE g WHEN 'CONFLICT' THEN 'INCOMPATIBLE_FACT' WHEN 'CONTEXT' THEN 'HISTORICAL' WHEN 'SELF' THEN 'SAME_FACT' WHEN 'EQUAL' THEN 'SAME_FACT' WHEN 'COMPATIBLE' THEN 'COMPATIBLE_FACT' ELSE 'UNKNOWN' END AS relation,
    CASE WHEN g IN ('EQUAL', 'COMPATIBLE', 'VAGUE', 'CONFLICT') THEN difference END AS difference, CASE WHEN g IN ('EQUAL', 'COMPATIBLE', 'VAGUE', 'CONFLICT') THEN strength END AS strength,
    CASE WHEN g IN ('EQUAL', 'COMPATIBLE', 'VAGUE', 'CONFLICT') THEN na END AS normalized_a, CASE WHEN g IN ('EQUAL', 'COMPATIBLE', 'VAGUE', 'CONFLICT') THEN nb END AS normalized_b FROM gated""")
def verdict_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of each unit's claims with themselves, with the same predicate, and with the next claim of another predicate."""
    claims = odd_claims(spark, sf_dir)
    x, y = (claims.select(F.col("id").alias(f"{n}_id"), "subject", "predicate") for n in ("a", "b"))
    same = x.join(y, ["subject", "predicate"]).where("a_id <= b_id").select("a_id", "b_id")
    order = Window.partitionBy("subject").orderBy("id")
    after = claims.select(F.col("id").alias("a_id"), F.lead("id").over(order).alias("b_id"), "predicate", F.lead("predicate").over(order).alias("q")).where("predicate <> q")
    got = pairs.analyze(pairs.attach(same.unionByName(after.select("a_id", "b_id")), claims))
    return got.select("a_id", "b_id", "gate", "status", "relation", "cmp.difference", "cmp.strength", "cmp.normalized_a", "cmp.normalized_b")


@query(f"""WITH {_CLAIMS} SELECT id, CASE WHEN event_id % 7 = 6 THEN 'Unlinked claim observed ' ELSE 'Extracted from document source ''Source ' || source_id || ''' at /data/' || source_id || CASE WHEN event_id % 2 = 0 THEN ' (rev abc' || lpad((event_id % 10000)::VARCHAR, 4, '0') || ')' ELSE '' END || ', observed ' END
    || strftime(observed_at, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS summary, event_id % 7 <> 6 AS traceable FROM claims""")
def provenance_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.substring("id", 2, 10).cast("long")
    commit = F.when(i % 2 == 0, F.concat(F.lit("abc"), F.lpad((i % 10000).cast("string"), 4, "0"), F.lit("0123456789")))
    meta = F.struct(F.lit(None).cast("string").alias("file_path"), F.lit(None).cast("string").alias("uri"), commit.alias("commit_sha"))
    sources = event_trust(spark).where("id <> 'src6'").select(F.col("id").alias("source_id"), F.struct(F.lit("document").alias("type"), F.concat(F.lit("Source "), "id").alias("name"), F.concat(F.lit("/data/"), "id").alias("uri")).alias("source"))
    c = event_claims(spark, sf_dir).join(sources, "source_id", "left")
    return c.select("id", E.provenance(F.struct(meta.alias("metadata"), "observed_at"), F.col("source")).alias("p")).select("id", "p.summary", "p.traceable")


# --- identity, redaction, addresses ---------------------------------------------------------------------------------


@query("SELECT c_custkey, 'github:' || lower(trim(c_name)) AS source_key, 'github:' || lower(trim(c_name)) || ':docs/readme.md:' || lower(c_mktsegment) || CASE WHEN c_custkey % 2 = 0 THEN ':' || c_custkey ELSE '' END AS claim_key FROM customer")
def identity_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    source = extract.source_key(F.lit(" GitHub "), F.concat(F.lit("//"), F.trim("c_name"), F.lit("/")))
    number = F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey").cast("string")).otherwise("")
    return c.select("c_custkey", source.alias("source_key"), extract.claim_key(source, F.lit("/docs/README.md"), F.col("c_mktsegment"), number).alias("claim_key"))


@query(r"""SELECT doc_id, sha256(coalesce(text, '')) AS content_hash, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), 'gh[pousr]_[A-Za-z0-9_]{20,255}', '[REDACTED_GITHUB_TOKEN]', 'g'),
    'Bearer\s+[A-Za-z0-9_.-]+', 'Bearer [REDACTED]', 'gi'), 'token\s+[A-Za-z0-9_.-]+', 'token [REDACTED]', 'gi'), 'access_token=[A-Za-z0-9_.-]+', 'access_token=[REDACTED]', 'gi')) AS redacted_hash FROM documents""")
def redacted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", extract.content_hash(text).alias("content_hash"), extract.content_hash(extract.redact(F.col("text"))).alias("redacted_hash"))


_OCTETS = "(event_id * 7919) % 260 AS a, (event_id * 104729) % 257 AS b, (event_id * 31) % 256 AS c, event_id % 256 AS d"


@query(f"""WITH o AS (SELECT event_id, {_OCTETS} FROM events UNION ALL SELECT -event_id - 1, [127, 10, 172, 192, 169, 100, 198, 203, 224, 8][event_id % 10 + 1], [0, 1, 20, 168, 254, 90, 51, 0, 0, 8][event_id % 10 + 1], [0, 0, 0, 0, 0, 0, 100, 113, 0, 8][event_id % 10 + 1], event_id % 256 FROM events)
    SELECT event_id, a > 255 OR b > 255 OR a IN (0, 127, 10) OR a >= 224 OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 169 AND b = 254) OR (a = 100 AND b BETWEEN 64 AND 127)
        OR (a = 192 AND b = 0 AND c = 2) OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113) AS restricted FROM o""")
def restricted_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("event_id")
    some = e.select(i, F.concat_ws(".", i * 7919 % 260, i * 104729 % 257, i * 31 % 256, i % 256).alias("ip"))
    heads = F.array(*(F.lit(x) for x in ("127.0.0", "10.1.0", "172.20.0", "192.168.0", "169.254.0", "100.90.0", "198.51.100", "203.0.113", "224.0.0", "8.8.8")))
    known = e.select((-i - 1).alias("event_id"), F.concat_ws(".", heads[(i % 10).cast("int")], i % 256).alias("ip"))
    return some.unionByName(known).select("event_id", extract.restricted_address(F.col("ip")).alias("restricted"))


# --- synchronisation ------------------------------------------------------------------------------------------------

_SPLIT = "h AS (SELECT *, subject || ':' || predicate AS k, event_id < 5000 AS early FROM claims), l AS (SELECT k, early, arg_max(value, (observed_at, id)) AS value, arg_max(source_id, (observed_at, id)) AS source_id FROM h GROUP BY ALL)"


@query(f"""WITH {_CLAIMS}, {_SPLIT}, n AS (SELECT * FROM l WHERE NOT early), o AS (SELECT * FROM l WHERE early), j AS (SELECT n.source_id, o.k IS NULL AS created, o.k IS NOT NULL AND o.value <> n.value AS updated FROM n LEFT JOIN o USING (k))
    SELECT source_id AS id, count(*) AS claims_extracted, count(*) FILTER (created) AS claims_created, count(*) FILTER (updated) AS claims_updated, 0::BIGINT AS extraction_warnings FROM j GROUP BY source_id
    UNION ALL SELECT 'src' || i, 0, 0, 0, 1 FROM range(7) AS r(i) WHERE 'src' || i NOT IN (SELECT source_id FROM n)""")
def sync_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    early, late = _early_late(spark, sf_dir)
    sources = event_trust(spark).select("id", F.col("id").alias("name"))
    return sync.summaries(sources, store.upsert_claims(early, late), late).select("id", "claims_extracted", "claims_created", "claims_updated", "extraction_warnings")


def _early_late(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c, now = event_claims(spark, sf_dir), [F.col("observed_at"), F.col("id")]
    return store.latest(c.where("id < 'e0000005000'"), ["external_id"], now), store.latest(c.where("id >= 'e0000005000'"), ["external_id"], now)


@query(f"""WITH {_CLAIMS}, {_SPLIT}, n AS (SELECT * FROM l WHERE NOT early), o AS (SELECT * FROM l WHERE early), j AS (SELECT n.source_id, o.k IS NULL AS created, o.k IS NOT NULL AND o.value <> n.value AS updated FROM n LEFT JOIN o USING (k))
    SELECT 7::BIGINT AS sources_succeeded, 2::BIGINT AS sources_failed, 9::BIGINT AS sources_requested, count(*) FILTER (created) AS claims_created, count(*) FILTER (updated) AS claims_updated, 0::BIGINT AS contradictions_found FROM j""")
def sync_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    early, late = _early_late(spark, sf_dir)
    sources = event_trust(spark).select("id", F.col("id").alias("name"))
    each = sync.summaries(sources, store.upsert_claims(early, late), late).withColumn("contradictions_found", F.lit(0).cast("long"))
    return sync.batch_totals(each, spark.range(2))


@query("""WITH s AS (SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier) SELECT 'x:' || s_suppkey AS external_id, CASE WHEN s_suppkey % 3 = 0 THEN 'new ' || s_name ELSE s_name END AS name,
    CASE WHEN s_suppkey % 5 = 0 AND s_suppkey % 3 <> 0 THEN 'kept' WHEN s_suppkey % 3 = 0 AND s_suppkey % 5 <> 0 THEN 'created' WHEN s_suppkey % 15 = 0 THEN 'updated' END AS change,
    CASE WHEN s_suppkey % 5 = 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS trust_score FROM s WHERE s_suppkey % 5 = 0 OR s_suppkey % 3 = 0""")
def source_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = spark.read.parquet(f"{sf_dir}/supplier.parquet"), F.col("s_suppkey")
    row = lambda name, trust, at: [F.concat(F.lit("s"), k).alias("id"), F.concat(F.lit("x:"), k).alias("external_id"), name.alias("name"), F.lit("u").alias("uri"), F.lit(at).cast("timestamp").alias("last_fetched_at"), F.lit(at).cast("timestamp").alias("updated_at"), F.lit(trust).alias("trust_score"), F.lit("{}").alias("metadata")]
    current = s.where(k % 5 == 0).select(*row(F.col("s_name"), 0.5, "2024-01-01"))
    staged = s.where(k % 3 == 0).select(*row(F.concat(F.lit("new "), "s_name"), 1.0, "2024-02-01"))
    return sync.upsert_sources(current, staged).select("external_id", "name", "change", "trust_score")


@query("""WITH c AS (SELECT o_orderkey, 'src' || o_orderkey % 40 AS source_id, 'p' || o_orderkey % 3 AS predicate, substr(o_orderstatus || o_orderpriority, 1, (o_orderkey % 4)::INT) AS value FROM orders WHERE o_orderkey % 40 <> 39)
    SELECT source_id, 'Claim ''' || predicate || ''' extracted with suspiciously short value: ''' || value || '''' AS warning FROM c WHERE length(value) < 2 AND NOT regexp_matches(value, '^[0-9]$') AND lower(value) NOT IN ('y', 'n')
    UNION ALL SELECT 'src' || i, 'No factual claims could be extracted from source ''name' || i || '''. Check document formatting, headings, or key-value structures.' FROM range(40) AS r(i) WHERE 'src' || i NOT IN (SELECT source_id FROM c)""")
def extraction_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderkey % 40 <> 39"), F.col("o_orderkey")
    value = F.concat("o_orderstatus", "o_orderpriority").substr(F.lit(1), (k % 4).cast("int"))
    claims = o.select(F.concat(F.lit("src"), k % 40).alias("source_id"), F.concat(F.lit("p"), k % 3).alias("predicate"), value.alias("value"))
    return sync.warnings(spark.range(40).select(F.concat(F.lit("src"), "id").alias("id"), F.concat(F.lit("name"), "id").alias("name")), claims)


@query("""SELECT event_type AS tool, count(*) FILTER (event_id % 4 = 0) AS calls, count(*) FILTER (event_id % 4 = 1) AS syncs, count(*) FILTER (event_id % 4 = 1 AND user_id % 3 <> 0) AS successful_syncs, count(*) FILTER (event_id % 4 = 1 AND user_id % 3 = 0) AS failed_syncs,
    count(*) FILTER (event_id % 4 = 2) AS scans, coalesce(sum(user_id) FILTER (event_id % 4 = 1 AND user_id % 3 <> 0), 0)::BIGINT AS claims_ingested,
    coalesce(sum(event_id % 10) FILTER ((event_id % 4 = 1 AND user_id % 3 <> 0) OR event_id % 4 = 2), 0)::BIGINT AS contradictions_detected, count(*) FILTER (event_id % 4 = 3) AS errors FROM events GROUP BY ROLLUP (event_type)""")
def operation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i, u = spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("event_id"), F.col("user_id")
    kind = F.when(i % 4 == 0, "call").when(i % 4 == 1, "sync").when(i % 4 == 2, "scan").otherwise("error")
    return sync.operation_metrics(e.select(F.col("event_type").alias("tool"), kind.alias("kind"), (u % 3 != 0).alias("success"), u.cast("long").alias("claims_created"), (i % 10).cast("long").alias("contradictions"), F.lit("").alias("message")))


_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in _TABLES))
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.table_counts({t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES})


# --- the keyed table with versions ------------------------------------------------------------------------------------

_BATCHES = "b AS (SELECT subject || ':' || predicate AS external_id, id, value, observed_at, event_id % 4 AS batch, user_id FROM claims)"
_LAST = "arg_max({0}, (batch, observed_at, id))"


def _versions(spark: SparkSession, sf_dir: str) -> KeyedTable:
    """Four batches of claims as upserts by external_id; after the second a compaction, after the third the keys of every seventh user go."""
    c = event_claims(spark, sf_dir).withColumn("batch", F.substring("id", 2, 10).cast("long") % 4).select("external_id", "id", "value", "observed_at", "batch", "subject")
    rows = lambda k: c.where(F.col("batch") == k).select("external_id", "id", "value", "observed_at")
    table = KeyedTable.create(spark, scratch(spark, "claims"), rows(0), ["external_id"], ["observed_at", "id"], buckets=8)
    table.upsert(rows(1), ["observed_at", "id"])
    table.compact()
    table.upsert(rows(2), ["observed_at", "id"])
    table.delete(c.where(F.regexp_extract("subject", "[0-9]+", 0).cast("int") % 7 == 3).select("external_id"))
    table.upsert(rows(3), ["observed_at", "id"])
    return table


@query(f"""WITH {_CLAIMS}, {_BATCHES} SELECT external_id, {_LAST.format("id")} AS id, {_LAST.format("value")} AS value FROM b WHERE user_id % 7 <> 3 OR batch = 3 GROUP BY external_id""")
def versioned_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _versions(spark, sf_dir).read().select("external_id", "id", "value")


@query(f"""WITH {_CLAIMS}, {_BATCHES} SELECT external_id, {_LAST.format("id")} AS id, {_LAST.format("value")} AS value FROM b WHERE batch <= 1 GROUP BY external_id""")
def versioned_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version before the compaction, read after later ones."""
    return _versions(spark, sf_dir).read(1).select("external_id", "id", "value")


@query(f"""WITH {_CLAIMS}, {_BATCHES}, o AS (SELECT external_id, {_LAST.format("id")} AS id FROM b WHERE batch <= 2 GROUP BY 1), n AS (SELECT external_id, {_LAST.format("id")} AS id FROM b WHERE user_id % 7 <> 3 OR batch = 3 GROUP BY 1)
    SELECT external_id, CASE WHEN o.id IS NULL THEN 'created' WHEN n.id IS NULL THEN 'deleted' ELSE 'updated' END AS change FROM o FULL JOIN n USING (external_id) WHERE o.id IS DISTINCT FROM n.id""")
def versioned_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Between the version before the deletion and the last one."""
    return _versions(spark, sf_dir).changes(3)


@query(f"""WITH {_CLAIMS}, {_BATCHES}, n AS (SELECT count(DISTINCT external_id) FILTER (batch <= 1) AS base, count(DISTINCT external_id) FILTER (batch = 2) AS third, count(DISTINCT external_id) FILTER (user_id % 7 = 3) AS gone, count(DISTINCT external_id) FILTER (batch = 3) AS fourth FROM b)
    SELECT 'ok' AS status, base + third + gone + fourth AS n_rows FROM n""")
def table_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of all files of the last version, by what their digests say."""
    table = _versions(spark, sf_dir)
    m = table.manifest()
    noted = spark.read.parquet(*[f"{table.path}/digests/{n}" for n in (m.base, *m.deltas)])
    return table.verify().join(noted, "file").groupBy("status").agg(F.sum("n_rows").alias("n_rows"))


# Staged claims are the odd batches, all of their rows; the current table has the last row of each key of the even ones.
@query(f"""WITH {_CLAIMS}, {_BATCHES}, c AS (SELECT external_id, arg_max(id, (observed_at, id)) AS id, arg_max(value, (observed_at, id)) AS value FROM b WHERE batch % 2 = 0 GROUP BY 1),
    s AS (SELECT external_id, id, value, 0 AS seq, NULL::TIMESTAMP AS observed_at FROM c UNION ALL SELECT external_id, id, value, 1, observed_at FROM b WHERE batch % 2 = 1),
    o AS (SELECT *, lag(value) OVER w AS before, row_number() OVER w AS n, first_value(id) OVER w AS claim_id FROM s WINDOW w AS (PARTITION BY external_id ORDER BY seq, observed_at, id)),
    r AS (SELECT *, lead(observed_at) OVER (PARTITION BY external_id ORDER BY n) AS superseded_at FROM o WHERE n = 1 OR value IS DISTINCT FROM before)
    SELECT claim_id, value, superseded_at FROM r WHERE superseded_at IS NOT NULL""")
def upsert_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = event_claims(spark, sf_dir)
    odd = F.substring("id", 2, 10).cast("long") % 2 == 1
    current = store.latest(c.where(~odd), ["external_id"], [F.col("observed_at"), F.col("id")])
    return store.history_rows(current, c.where(odd)).select("claim_id", "value", "superseded_at")


_FORMS = "t AS (SELECT *, replace(subject, '_', '') AS form FROM claims)"
_PROBED = f"""SELECT DISTINCT least(x.id, y.id) || '::' || greatest(x.id, y.id) AS pair_key FROM t x JOIN t y ON x.predicate = y.predicate AND x.id <> y.id
    WHERE x.source_id = 'src3' AND (x.form = y.form OR {_INSIDE.format("x.form", "y.form")})"""


@query(f"WITH {_CLAIMS}, {_FORMS} {_PROBED}")
def probe_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate pairs of all claims that one source has brought in."""
    claims = event_claims(spark, sf_dir)
    return blocking.probe_pairs(claims.where("source_id = 'src3'"), claims).select("pair_key")


@query(f"WITH {_CLAIMS}, {_FORMS} {_PROBED}")
def indexed_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from the persisted index, to which the claims of the source have been added last."""
    claims = event_claims(spark, sf_dir)
    index = BlockIndex.create(spark, scratch(spark, "index"), claims.where("source_id <> 'src3'"), buckets=16)
    index.add(claims.where("source_id = 'src3'"))
    return index.probe(claims.where("source_id = 'src3'")).select("pair_key")


@query(f"WITH {_CLAIMS}, {_FORMS} {_PROBED}")
def similar_to_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of the claims of one source that the match accepts, by similarity joins on subjects and predicates."""
    claims = event_claims(spark, sf_dir)
    return blocking.source_pairs(claims.where("source_id = 'src3'"), claims).select("pair_key")


@query("""WITH RECURSIVE up(k, pos) AS (SELECT c_custkey, c_custkey FROM customer UNION ALL SELECT k, pos // 2 FROM up WHERE pos % 5 <> 0 AND pos // 2 >= (SELECT min(c_custkey) FROM customer) AND pos // 2 IN (SELECT c_custkey FROM customer)),
    r AS (SELECT k, min(pos) AS root FROM up GROUP BY k), n AS (SELECT c_custkey, regexp_replace(lower(c_name), '[._\\-\\s/]+', '', 'g') AS form FROM customer),
    e AS (SELECT k FROM r JOIN n ON c_custkey = k WHERE root <> k UNION SELECT root FROM r WHERE root <> k)
    SELECT x.form, y.form AS canonical FROM e JOIN r USING (k) JOIN n x ON x.c_custkey = e.k JOIN n y ON y.c_custkey = r.root""")
def alias_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of customers' names out of pairs that form chains and trees: each with the one of half its number, but for every fifth."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name")
    other = c.select(F.col("c_custkey").alias("half"), F.col("c_name").alias("b"))
    pairs_ = c.where("c_custkey % 5 <> 0").withColumn("half", F.expr("c_custkey div 2")).join(other, "half").select(F.col("c_name").alias("a"), "b")
    return aliases.groups_of_pairs(pairs_).select("form", "canonical")


# --- files of mixed formats, streams ----------------------------------------------------------------------------------


@query(f"""WITH {_CLAIMS} SELECT 'd/' || id || CASE event_id % 4 WHEN 0 THEN '.yaml' WHEN 1 THEN '.json' WHEN 2 THEN '.csv' ELSE '.eml' END AS path, predicate, value,
    CASE event_id % 4 WHEN 2 THEN subject ELSE id END AS subject, CASE WHEN event_id % 4 = 3 THEN observed_at::DATE + INTERVAL 10 HOUR ELSE observed_at END AS observed_at FROM claims""")
def routed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each claim, in four formats, through one scan; a message is observed when it was sent."""
    c, i = event_claims(spark, sf_dir), F.substring("id", 2, 10).cast("long") % 4
    ending = F.when(i == 0, ".yaml").when(i == 1, ".json").when(i == 2, ".csv").otherwise(".eml")
    pair = F.concat_ws(": ", "predicate", "value")
    mail = F.concat(F.lit("From: a@example.org\nSubject: claims\n of today\nDate: "), F.date_format("observed_at", "E, d MMM yyyy"), F.lit("\n\t10:00:00 +0000\n\n"), pair, F.lit("\n"))
    text = F.when(i == 0, pair).when(i == 1, F.to_json(F.create_map("predicate", "value"))).when(i == 2, F.concat(F.lit("name,"), "predicate", F.lit("\n"), "subject", F.lit(","), "value")).otherwise(mail)
    path = F.concat(F.lit("d/"), "id", ending)
    files = c.select(path.alias("path"), F.col("observed_at").cast("timestamp").alias("modified"), scan.document_route(path).alias("route"), text.cast("binary").alias("content"))
    return scan.routed_claims(files).select("path", "predicate", "value", "subject", F.col("observed_at").cast("timestamp_ntz").alias("observed_at"))


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CHANGES of the claims as a stream of four micro-batches, in the order of their times, each by a run from the checkpoint of the one before."""
    folder, out, checkpoint = scratch(spark, "stream-in"), scratch(spark, "stream-out"), scratch(spark, "stream-checkpoint")
    c = event_claims(spark, sf_dir).select("external_id", "id", "value", F.col("observed_at").cast("timestamp").alias("observed_at"))
    cuts = c.agg(F.percentile_approx("observed_at", [0.25, 0.5, 0.75])).first()[0]
    for k in range(4):
        part = c
        if k:
            part = part.where(F.col("observed_at") > F.lit(cuts[k - 1]))
        if k < 3:
            part = part.where(F.col("observed_at") <= F.lit(cuts[k]))
        part.write.mode("append").parquet(folder)
        stream = spark.readStream.schema(c.schema).parquet(folder)
        run = state.claim_changes(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.schema(state.CHANGES).parquet(out)


@query(f"""WITH {_CLAIMS}, o AS (SELECT subject || ':' || predicate AS external_id, id, value, observed_at, lag(value) OVER w AS before, row_number() OVER w AS n, first_value(observed_at) OVER w AS first_seen_at FROM claims WINDOW w AS (PARTITION BY subject, predicate ORDER BY observed_at, id))
    SELECT external_id, CASE n WHEN 1 THEN 'created' ELSE 'updated' END AS change, id, value, before AS previous, first_seen_at FROM o WHERE n = 1 OR value IS DISTINCT FROM before""")
def stream_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _changes(spark, sf_dir).where("change IN ('created', 'updated')")
    return got.select("external_id", "change", "id", "value", "previous", F.col("first_seen_at").cast("timestamp_ntz").alias("first_seen_at"))


@query(f"WITH {_CLAIMS} SELECT subject || ':' || predicate AS external_id, arg_max(id, (observed_at, id)) AS id, arg_max(value, (observed_at, id)) AS value FROM claims GROUP BY ALL")
def stream_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.current_rows(_changes(spark, sf_dir)).select("external_id", "id", "value")


# --- reads -----------------------------------------------------------------------------------------------------------


@query(f"""WITH {_CLAIMS}, k AS (SELECT DISTINCT subject AS candidate, replace(subject, '_', '') AS f FROM claims), q AS (SELECT 'user_' || x AS query, 'user' || x AS g FROM (VALUES (1), (11), (12), (111)) AS v(x)),
    r AS (SELECT query, candidate, CASE WHEN f = g THEN 1.0::DOUBLE ELSE {_fixed("0.7::DOUBLE + least(length(f), length(g))::DOUBLE / greatest(length(f), length(g)) * 0.15::DOUBLE", 2)} END AS confidence, CASE WHEN f = g THEN 'EXACT' ELSE 'SUFFIX_PREFIX' END AS match_type FROM q JOIN k ON {_INSIDE.format("f", "g")})
    SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY confidence DESC, candidate) AS INTEGER) AS rank FROM r WHERE confidence >= 0.7""")
def entity_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = event_claims(spark, sf_dir).select(F.col("subject").alias("candidate")).distinct()
    return store.entity_candidates(spark.createDataFrame([(f"user_{x}",) for x in (1, 11, 12, 111)], "query string"), names)


def _contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = blocking.candidate_pairs(event_claims(spark, sf_dir)).where("substring(a_id, -1) = '3'")
    return p.select(F.col("pair_key").alias("id"), F.col("a_id").alias("claim_a_id"), F.col("b_id").alias("claim_b_id"))


@query(f"""WITH {_CLAIMS}, {_PAIRS}, c AS (SELECT * FROM claims WHERE event_id % 11 <> 0) SELECT pair_key AS id, a_id AS claim_a_id, b_id AS claim_b_id, x.subject AS a_subject, y.value AS b_value, CASE WHEN x.source_id <> 'src6' THEN 'Source ' || x.source_id END AS a_source_name
    FROM pairs LEFT JOIN c x ON x.id = a_id LEFT JOIN c y ON y.id = b_id WHERE right(a_id, 1) = '3'""")
def enriched_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = event_claims(spark, sf_dir).where(F.substring("id", 2, 10).cast("long") % 11 != 0)
    sources = event_trust(spark).where("id <> 'src6'").select("id", F.concat(F.lit("Source "), "id").alias("name"), F.lit("document").alias("type"))
    return store.enriched(_contradictions(spark, sf_dir), claims, sources).select("id", "claim_a_id", "claim_b_id", "a_subject", "b_value", "a_source_name")


@query(f"WITH {_CLAIMS} SELECT id, subject, value FROM claims WHERE id = 'e0000000042'")
def claim_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.by_id(event_claims(spark, sf_dir), "e0000000042").select("id", "subject", "value")


@query(f"WITH {_CLAIMS}, {_PAIRS}, o AS (SELECT min(pair_key) AS k FROM pairs WHERE right(a_id, 1) = '3') SELECT a_id AS claim_a_id, b_id AS claim_b_id FROM pairs JOIN o ON pair_key = k")
def contradiction_by_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _contradictions(spark, sf_dir)
    a, b = c.agg(F.min("id")).first()[0].split("::")
    return store.by_pair(c, b, a).select("claim_a_id", "claim_b_id")


@query("SELECT 's' || s_suppkey AS id, s_name AS name FROM supplier WHERE lower(s_name) = (SELECT lower(s_name) FROM supplier WHERE s_suppkey = 7)")
def source_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    rows = s.select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("u").alias("uri"), F.concat(F.lit("x:"), "s_suppkey").alias("external_id"), F.lit("2024-01-01").cast("timestamp").alias("created_at"))
    return store.find_source(rows, s.where("s_suppkey = 7").first()["s_name"].upper()).select("id", "name")


@query(f"""WITH {_CLAIMS}, {_PAIRS} SELECT 'sources' AS name, 6::BIGINT AS n UNION ALL SELECT 'claims', count(*) FROM claims WHERE source_id <> 'src6'
    UNION ALL SELECT 'contradictions', count(*) FROM pairs WHERE right(a_id, 1) = '3' AND as_id <> 'src6' AND bs_id <> 'src6'""")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, c, k = store.cascade_delete(event_trust(spark), event_claims(spark, sf_dir), _contradictions(spark, sf_dir), event_trust(spark).where("id = 'src6'"))
    return sync.table_counts({"sources": s, "claims": c, "contradictions": k}).withColumnsRenamed({"table_name": "name", "n_rows": "n"})


@query(f"WITH {_LOG} SELECT id AS contradiction_id, seq, status AS new_status, CAST(row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS INTEGER) AS place FROM l")
def review_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit in its order: newest first within a contradiction."""
    rows = store.audit(_review_log(spark, sf_dir)).select("contradiction_id", "seq", "new_status", "performed_at")
    order = F.row_number().over(Window.partitionBy("contradiction_id").orderBy(F.desc("performed_at"), F.desc("seq")))
    return rows.select("contradiction_id", "seq", "new_status", order.alias("place"))
