"""Text normal forms and similarities as column expressions (no Python at run time)."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicon as L


def fixed(x: Column, digits: int) -> Column:
    """Round half up on the exact binary value of x in [0, 8), as a fixed-point formatter does; ``round`` works on the shortest decimal text."""
    bits = (x * F.lit(1152921504606846976.0)).cast("bigint").cast("decimal(20,0)") * F.lit(10**digits).cast("decimal(6,0)")
    half, whole = (F.lit(v).cast("decimal(20,0)") for v in (576460752303423488, 1152921504606846976))
    return F.call_function("div", bits + half, whole).cast("double") / F.lit(float(10**digits))


def let(x: Column, body) -> Column:
    """``body`` of a value that is computed once: expressions that use an input many times stay small."""
    return F.element_at(F.transform(F.array(x), body), 1)


#: White space at the ends of texts, as the readers cut it. Fixed values.
BLANKS = "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def trimmed(x: Column | str) -> Column:
    """Without white space of any kind at either end; ``trim`` alone cuts blanks only."""
    return F.trim(x, F.lit(BLANKS))


def one_of(x: Column, words: str) -> Column:
    """Whether x is one of the words; one pattern is one call to the JVM, however many words there are."""
    return x.rlike(rf"\A(?:{'|'.join(map(re.escape, words.split()))})\z")


def table(items: dict[str, str]) -> Column:
    """A constant map from strings to SQL literals, parsed in one call."""
    quoted = lambda k: "'" + k.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return F.expr(f"map({', '.join(f'{quoted(k)}, {v}' for k, v in items.items())})")


def normalize_text(x: Column) -> Column:
    x = F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[_\-./\\:]+", " ")
    x = F.regexp_replace(x, r"(?U)[^\p{L}\p{N}\s]", "")
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def tokens(x: Column) -> Column:
    return F.array_distinct(F.filter(F.split(x, " "), lambda t: t != ""))


def token_jaccard(a: Column, b: Column) -> Column:
    """Of two normalized texts."""
    ta, tb = tokens(a), tokens(b)
    shared = F.size(F.array_intersect(ta, tb))
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(shared / F.size(F.array_union(ta, tb)))


def edit_similarity(a: Column, b: Column) -> Column:
    most = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, 1.0).when(most == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / most)


def composite_similarity(raw_a: Column, raw_b: Column) -> Column:
    return let(F.struct(normalize_text(raw_a).alias("a"), normalize_text(raw_b).alias("b")), lambda v: _composite(v["a"], v["b"]))


def _composite(a: Column, b: Column) -> Column:
    pad = lambda x: F.concat(F.lit(" "), x, F.lit(" "))
    inside = (F.length(a) <= F.length(b)) & F.contains(pad(b), pad(a)) | (F.length(b) <= F.length(a)) & F.contains(pad(a), pad(b))
    share = F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b))
    parts = F.struct(token_jaccard(a, b).alias("j"), edit_similarity(a, b).alias("e"))
    best = let(parts, lambda v: F.when(inside, F.greatest(v["j"], v["e"], share * 0.9)).when(v["j"] >= 0.5, F.greatest(v["j"], v["e"])).otherwise(v["j"]))
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(best)


# --- predicates ----------------------------------------------------------------------------------------------


def predicate_form(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), "[^a-z0-9_]", "_")


def stripped(x: Column) -> Column:
    return F.regexp_replace(predicate_form(x), f"^({'|'.join(L.WRAPPERS.split())})_+", "")


def synonym_groups() -> dict[str, str]:
    """form -> number of its group; no word is in two groups."""
    return {w: str(k) for k, g in enumerate(L.PREDICATE_SYNONYMS) for w in g.split()}


def synonyms(a: Column, b: Column) -> Column:
    groups = synonym_groups()
    forms = F.struct(*(f.alias(n) for n, f in (("fa", predicate_form(a)), ("fb", predicate_form(b)), ("sa", stripped(a)), ("sb", stripped(b)))))

    def same(v: Column) -> Column:
        g = F.transform(F.array(v["fa"], v["sa"], v["fb"], v["sb"]), lambda f: F.try_element_at(table(groups), f))
        shared = F.arrays_overlap(F.filter(F.slice(g, 1, 2), lambda x: x.isNotNull()), F.filter(F.slice(g, 3, 2), lambda x: x.isNotNull()))
        return (v["fa"] == v["fb"]) | (v["sa"] == v["sb"]) & (v["sa"] != "") | shared

    return let(forms, same)


def lookup(x: Column, items: dict[str, str]) -> Column:
    """The entry of a constant table of words, null without one: ``x`` is computed once, however long the table is."""
    return F.try_element_at(table({k: f"'{v}'" for k, v in items.items()}), x)


def canonical_predicate(x: Column) -> Column:
    form = predicate_form(x)
    return F.coalesce(lookup(form, {w: min(g.split()) for g in L.PREDICATE_SYNONYMS for w in g.split()}), form)


def leaf(x: Column) -> Column:
    """Last part between underscores of a predicate form; the form itself if it has none."""
    form = predicate_form(x)
    parts = F.filter(F.split(form, "_"), lambda t: t != "")
    return F.when(F.size(parts) > 0, F.element_at(parts, -1)).otherwise(form)


def orthogonal(a: Column, b: Column) -> Column:
    fa, fb, sa, sb, la, lb = predicate_form(a), predicate_form(b), stripped(a), stripped(b), leaf(a), leaf(b)
    has = lambda f, s, x, words: one_of(f, words) | one_of(s, words) | one_of(x, words)
    return reduce(lambda x, y: x | y, (has(fa, sa, la, p) & has(fb, sb, lb, q) | has(fa, sa, la, q) & has(fb, sb, lb, p) for p, q in L.ORTHOGONAL))


def system_level(x: Column) -> Column:
    return one_of(predicate_form(x), L.SYSTEM_PREDICATES)


def generic_subject(x: Column) -> Column:
    s = F.lower(F.trim(F.coalesce(x, F.lit(""))))
    words = "|".join(L.DOCUMENT_WORDS.split())
    forms = (
        "", f"({'|'.join(L.GENERIC_SUBJECTS.split())})", rf"[\s\S]*\.({'|'.join(L.GENERIC_EXTENSIONS.split())})", "(file|doc|email|cto)[a-z0-9_]*",
        rf"[a-z0-9_-]+[_.]({words})", f"({words})",
    )
    return (F.coalesce(x, F.lit("")) == "") | s.rlike(rf"^({'|'.join(forms[1:])})$")


# --- entities ------------------------------------------------------------------------------------------------


def entity_form(x: Column) -> Column:
    x = F.lower(F.trim(F.coalesce(x, F.lit(""))))
    x = F.regexp_replace(x, r"^@[a-z0-9_-]+/", "")
    x = F.regexp_replace(x, r"^(https?://)?(www\.)?", "")
    x = F.regexp_replace(x, r"[._\-\s/]+", "")
    return F.regexp_replace(x, f"({'|'.join(L.NOUN_SUFFIXES.split())})$", "")


def _entity_form(word: str) -> str:
    """:func:`entity_form` of the plain words of the alias lists."""
    word = "".join(c for c in word.lower() if c not in "._-/ ")
    return next((word[: -len(s)] for s in L.NOUN_SUFFIXES.split() if word.endswith(s)), word)


def alias_groups() -> dict[str, list[str]]:
    """entity form -> members of its alias group; a later group takes over a form of an earlier one."""
    out: dict[str, list[str]] = {}
    for group in L.ALIASES:
        members = sorted({_entity_form(w) for w in group.split()})
        out |= dict.fromkeys(members, members)
    return out


def canonical_alias(x: Column) -> Column:
    """Smallest member of the alias group, null without one or where it is the empty form."""
    return lookup(entity_form(x), {k: v[0] for k, v in alias_groups().items() if v[0]})


def resolve_entity(a: Column, b: Column, custom: dict[str, list[str]] | None = None) -> Column:
    """struct(is_match, confidence, match_type, is_ambiguous)."""
    raw = lambda x: F.trim(F.coalesce(x, F.lit("")))
    forms = F.struct(raw(a).alias("ra"), raw(b).alias("rb"), entity_form(a).alias("fa"), entity_form(b).alias("fb"))
    return let(forms, lambda v: _resolved(v["ra"], v["rb"], v["fa"], v["fb"], custom))


def _resolved(ra: Column, rb: Column, fa: Column, fb: Column, custom: dict[str, list[str]] | None) -> Column:
    own = [{_entity_form(w) for w in (k, *v)} for k, v in (custom or {}).items()]
    in_own = reduce(lambda x, y: x | y, (fa.isin(sorted(g)) & fb.isin(sorted(g)) for g in own), F.lit(False))
    in_alias = reduce(lambda x, y: x | y, ((fa == k) & fb.isin(v) for k, v in alias_groups().items()))
    ratio = F.least(F.length(fa), F.length(fb)) / F.greatest(F.length(fa), F.length(fb))
    overlap = (F.length(fa) >= 4) & (F.length(fb) >= 4) & (F.contains(fa, fb) | F.contains(fb, fa)) & (ratio >= 0.6)
    out = lambda ok, conf, kind, amb=F.lit(False): F.struct(F.lit(ok).alias("is_match"), conf.alias("confidence"), F.lit(kind).alias("match_type"), amb.alias("is_ambiguous"))
    return (
        F.when((ra == "") | (rb == ""), out(False, F.lit(0.0), "NONE")).when(ra == rb, out(True, F.lit(1.0), "EXACT"))
        .when(F.lower(ra) == F.lower(rb), out(True, F.lit(0.98), "EXACT")).when((fa != "") & (fa == fb), out(True, F.lit(0.92), "NORMALIZED"))
        .when(in_own, out(True, F.lit(0.95), "ALIAS")).when(in_alias, out(True, F.lit(0.88), "ALIAS"))
        .when(overlap, out(True, fixed(0.7 + ratio * 0.15, 2), "SUFFIX_PREFIX", ratio < 0.75)).otherwise(out(False, F.lit(0.1), "NONE"))
    )


def subject_key(x: Column) -> Column:
    norm = normalize_text(x)
    return F.when(norm == "", "").otherwise(F.coalesce(F.concat(F.lit("alias:"), canonical_alias(x)), F.array_join(F.array_sort(F.split(norm, " ")), " ")))


def semantic_similarity(a: Column, b: Column) -> Column:
    """Token overlap with a bonus for tokens that begin alike; 0 without tokens."""

    def words(x: Column) -> Column:
        parts = F.split(F.regexp_replace(F.lower(x), r"[^a-z0-9\s]", " "), r"\s+")
        return F.array_distinct(F.filter(parts, lambda t: (F.length(t) > 2) & ~t.isin("the", "and", "for", "with", "from")))

    ta, tb = words(a), words(b)
    alike = lambda x, y: (x != y) & (F.startswith(x, y) | F.startswith(y, x)) & (F.least(F.length(x), F.length(y)) >= 4)
    n = F.aggregate(ta, F.lit(0), lambda acc, x: acc + F.size(F.filter(tb, lambda y: alike(x, y))))
    score = F.size(F.array_intersect(ta, tb)) / F.size(F.array_union(ta, tb)) + F.least(F.lit(0.25), n * 0.1)
    return F.when((F.size(ta) == 0) | (F.size(tb) == 0), 0.0).otherwise(fixed(F.least(F.lit(1.0), score), 3))


def match_claims(sa: Column, pa: Column, sb: Column, pb: Column, subject_least: float = 0.75, predicate_least: float = 0.65, semantic: bool = True) -> Column:
    """struct(matches, subject_similarity, predicate_similarity, synonym, orthogonal, semantic, across) of two claims' subjects and predicates.

    ``semantic`` is the similarity that rescued the predicates, ``across`` tells that a generic subject matched by a system-level predicate.
    """
    equal = F.struct(F.lit(True).alias("matches"), F.lit(1.0).alias("subject_similarity"), F.lit(1.0).alias("predicate_similarity"), F.lit(True).alias("synonym"), F.lit(False).alias("orthogonal"), F.lit(None).cast("double").alias("semantic"), F.lit(False).alias("across"))
    parts = F.struct(
        let(resolve_entity(sa, sb), lambda e: let(composite_similarity(sa, sb), lambda c: F.when(e["is_match"], F.greatest(c, e["confidence"])).otherwise(c))).alias("subject"),
        orthogonal(pa, pb).alias("apart"), synonyms(pa, pb).alias("same"), normalize_text(pa).alias("na"), normalize_text(pb).alias("nb"), composite_similarity(pa, pb).alias("plain"),
        (generic_subject(sa) | generic_subject(sb)).alias("generic"), (system_level(pa) | system_level(pb)).alias("system"),
    )
    full = let(parts, lambda v: _matched(v, subject_least, predicate_least, semantic))
    return F.when((sa == sb) & (pa == pb), equal).otherwise(full)


def _matched(v: Column, subject_least: float, predicate_least: float, semantic: bool) -> Column:
    subject, apart, same, na, nb, plain = (v[k] for k in ("subject", "apart", "same", "na", "nb", "plain"))
    ta, tb = F.split(na, " "), F.split(nb, " ")
    la, lb = F.element_at(ta, -1), F.element_at(tb, -1)
    prefix = lambda t: F.array_join(F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))), " ")
    other_prefix = (prefix(ta) != "") & (prefix(tb) != "") & (prefix(ta) != prefix(tb)) & (la == lb)
    other_leaf = (la != lb) & ~synonyms(la, lb) & ((F.size(ta) > 1) | (F.size(tb) > 1)) & (composite_similarity(la, lb) < predicate_least)
    guarded = ~same & (other_prefix | other_leaf)
    rescue = semantic_similarity(na, nb) if semantic else F.lit(0.0)
    rescued = F.when(~apart & ~same & ~guarded & (plain < predicate_least), let(rescue, lambda r: F.when(r >= predicate_least, r)))
    across = ~apart & (subject < subject_least) & (v["system"] | system_level(la) | system_level(lb)) & v["generic"]
    predicate = lambda r: F.when(apart, 0.0).when(same, F.greatest(plain, F.lit(0.95))).when(guarded, 0.0).otherwise(F.greatest(plain, F.coalesce(r, plain)))
    two = lambda r: F.struct(F.when(across, F.greatest(subject, F.lit(0.85))).otherwise(subject).alias("s"), predicate(r).alias("p"), r.alias("r"), across.alias("x"))
    ok = lambda w: ~apart & (w["s"] >= subject_least) & (w["p"] >= predicate_least)
    out = lambda w: F.struct(
        ok(w).alias("matches"), w["s"].alias("subject_similarity"), w["p"].alias("predicate_similarity"), same.alias("synonym"), apart.alias("orthogonal"), w["r"].alias("semantic"), w["x"].alias("across")
    )
    return let(rescued, lambda r: let(two(r), out))
