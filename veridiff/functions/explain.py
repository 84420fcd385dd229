"""Texts about a pair: why two claims match or not, what context they have, why they conflict or not, and where a claim comes from."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .context import normalize_environment
from .text import normalize_text

# The wording of explanations.
MATCHED = "Matches same conceptual fact on subject '%s' and predicate '%s'%s"
APART = "Predicates '%s' and '%s' represent orthogonal, non-conflicting system properties"
NEITHER = "Both subject ('%s' vs '%s') and predicate ('%s' vs '%s') refer to different concepts"
OTHER_SUBJECT = "Subjects '%s' and '%s' do not match (similarity: %s)"
OTHER_PREDICATE = "Predicates '%s' and '%s' do not match (similarity: %s)"
BY_DICTIONARY = " (matched via predicate synonym dictionary)"
BY_TOKENS = " (matched via semantic matcher, score: %s)"
BY_SYSTEM = " (cross-document system specification)"
REASONS = {
    "VERSION_MISMATCH": "The versions are mutually exclusive.",
    "DATE_MISMATCH": "The dates represent conflicting milestones or deadlines.",
    "QUANTITY_MISMATCH": "The specified numeric quantities or limits do not match.",
    "STATUS_MISMATCH": "The reported lifecycle or operational statuses conflict.",
    "POLICY_MISMATCH": "The stated rules or access policies are contradictory.",
}
ABSENT = "One statement asserts presence while the other indicates omission or non-existence."
OTHERWISE = "The reported values are incompatible and cannot both hold simultaneously."
CONTEXTS = {
    "SET_MEMBERSHIP": "Both claims are members of the same multi-value context (%s), representing parallel configurations or matrix dimensions rather than conflicting assertions.",
    "HISTORICAL": "%s describes a historical, previous, or non-overlapping time state. Historical states do not contradict active or subsequent specifications.",
    "EXAMPLE": "At least one claim originates from an illustrative tutorial, sample snippet, or example command rather than a normative production specification.",
    "DIFFERENT_ENVIRONMENT": "Claims apply to distinct non-overlapping environments ('%s' vs '%s'). Distinct environments legitimately maintain different parameter values.",
    "DIFFERENT_SCOPE": "Claims operate at distinct architectural scopes (%s vs %s).",
}


def two_digits(x: Column) -> Column:
    return F.format_string("%.2f", x)


def match_reason(a: Column, b: Column, match: Column, subject_least: float = 0.75, predicate_least: float = 0.65) -> Column:
    """Why the match of two claims holds or not; ``match`` is the struct of ``match_claims``."""
    sa, sb, pa, pb = (normalize_text(x) for x in (a["subject"], b["subject"], a["predicate"], b["predicate"]))
    subject, predicate = match["subject_similarity"], match["predicate_similarity"]
    detail = F.concat(F.when(match["synonym"], BY_DICTIONARY).when(match["semantic"].isNotNull(), F.format_string(BY_TOKENS, two_digits(match["semantic"]))).otherwise(""), F.when(match["across"], BY_SYSTEM).otherwise(""))
    one, other = subject >= subject_least, predicate >= predicate_least
    return (
        F.when(match["orthogonal"], F.format_string(APART, pa, pb)).when(~one & ~other, F.format_string(NEITHER, sa, sb, pa, pb))
        .when(~one, F.format_string(OTHER_SUBJECT, sa, sb, two_digits(subject))).when(~other, F.format_string(OTHER_PREDICATE, pa, pb, two_digits(predicate)))
        .otherwise(F.format_string(MATCHED, sa, pa, detail))
    )


def context_text(a: Column, b: Column, kind: Column) -> Column:
    """What a context relation says, null for those that leave the fact the same."""
    old = F.when(F.coalesce(a["is_historical"], F.lit(False)) | F.coalesce(a["source_role"] == "historical", F.lit(False)), "Claim A").otherwise("Claim B")
    filled = {
        "SET_MEMBERSHIP": (a["multi_value_context"],), "HISTORICAL": (old,), "EXAMPLE": (),
        "DIFFERENT_ENVIRONMENT": (normalize_environment(a["environment"]), normalize_environment(b["environment"])), "DIFFERENT_SCOPE": tuple(F.lower(c["scope"]) for c in (a, b)),
    }
    return F.coalesce(*(F.when(kind == k, F.format_string(CONTEXTS[k], *x) if x else F.lit(CONTEXTS[k])) for k, x in filled.items()))


def conflict(a: Column, b: Column, name_a: Column, name_b: Column, reason: Column, cmp: Column, kind: Column, severity: Column) -> Column:
    """The text of a confirmed conflict."""
    fact = F.format_string("Both claims describe the %s for '%s' (%s).", a["predicate"], a["subject"], reason)
    there = (F.coalesce(a["environment"], F.lit("")) != "") & (F.coalesce(b["environment"], F.lit("")) != "") & (a["environment"] != "unknown")
    where = F.when(there, F.format_string(" Operational context: %s vs %s.", a["environment"], b["environment"])).otherwise("")
    inside = a["source_id"] == b["source_id"]
    named = lambda n, c: F.coalesce(n, F.format_string("Source (%s)", c["source_id"]))
    first_line = lambda c: F.get(c["metadata"]["line_range"], F.lit(0))
    at = lambda c: F.when(F.coalesce(first_line(c), F.lit(0)) != 0, F.format_string(" (line %d)", first_line(c))).otherwise("")
    seen = lambda n, c: F.format_string("%s reports '%s' (observed on %s).", named(n, c), c["value"], F.date_format(c["observed_at"], "yyyy-MM-dd"))
    first = F.when(inside, F.format_string("%s%s reports '%s'.", named(name_a, a), at(a), a["value"])).otherwise(seen(name_a, a))
    second = F.when(inside, F.format_string("Within the same file/source%s, conflictingly asserted as '%s'.", at(b), b["value"])).otherwise(seen(name_b, b))
    differs = (cmp["normalized_a"] != a["value"]) | (cmp["normalized_b"] != b["value"])
    detail = F.when(differs, F.format_string(" Normalized as '%s' vs '%s'.", cmp["normalized_a"], cmp["normalized_b"])).otherwise("")
    plain = reduce(lambda acc, kv: F.when(kind == kv[0], kv[1]).otherwise(acc), REASONS.items(), F.lit(OTHERWISE))
    why = F.when(kind == "EXISTENCE_MISMATCH", ABSENT).otherwise(F.concat(plain, detail))
    summary = F.format_string("Classified as %s with %s severity.", kind, severity)
    return F.concat(fact, where, F.lit(" However, "), first, F.lit(" Meanwhile, "), second, F.lit(" "), why, F.lit(" "), summary)


def no_conflict(a: Column, b: Column, reason: Column, cmp: Column, gate: Column, relation: Column) -> Column:
    """The text of a pair that is no conflict, by the gate that decided."""
    return (
        F.when(gate == "CONTEXT", F.format_string("No contradiction detected (%s): %s", relation, context_text(a, b, relation)))
        .when(gate == "NO_MATCH", F.format_string("No contradiction detected: Claims refer to distinct subjects or predicates (%s).", reason))
        .when(gate == "EQUAL", F.format_string("No contradiction detected: Both claims specify equivalent values for '%s' ('%s').", a["subject"], cmp["normalized_a"]))
        .when(gate == "COMPATIBLE", F.format_string("No contradiction detected (COMPATIBLE_FACT): Values '%s' and '%s' are compatible (e.g. version range satisfied or overlapping constraints).", a["value"], b["value"]))
        .when(gate == "VAGUE", F.format_string("Inconclusive comparison: Values '%s' and '%s' cannot be reliably compared under valueType '%s'.", a["value"], b["value"], a["value_type"]))
        .otherwise("No contradiction detected.")
    )


def provenance(claim: Column, source: Column) -> Column:
    """struct(source_type, source_name, uri, file_path, commit, traceable, summary) of a claim and its source (null without one)."""
    m = claim["metadata"]
    uri = F.coalesce(F.nullif(source["uri"], F.lit("")), m["uri"])
    place = F.when(F.coalesce(m["file_path"], F.lit("")) != "", F.concat(F.lit(" at "), m["file_path"])).when(F.coalesce(uri, F.lit("")) != "", F.concat(F.lit(" at "), uri)).otherwise("")
    rev = F.when(F.coalesce(m["commit_sha"], F.lit("")) != "", F.format_string(" (rev %s)", F.substring(m["commit_sha"], 1, 7))).otherwise("")
    when = F.date_format(claim["observed_at"], "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    known = source.isNotNull()
    text = F.when(known, F.concat(F.lit("Extracted from "), source["type"], F.lit(" source '"), source["name"], F.lit("'"), place, rev, F.lit(", observed "), when)).otherwise(F.concat(F.lit("Unlinked claim observed "), when))
    traceable = known & ((F.coalesce(uri, F.lit("")) != "") | (F.coalesce(m["file_path"], F.lit("")) != ""))
    return F.struct(
        F.coalesce(source["type"], F.lit("unknown")).alias("source_type"), F.coalesce(source["name"], F.lit("unknown")).alias("source_name"), uri.alias("uri"), m["file_path"].alias("file_path"),
        m["commit_sha"].alias("commit"), traceable.alias("traceable"), text.alias("summary"),
    )
