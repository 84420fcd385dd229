"""Candidate pairs: one equi-join on block keys, never a cross product of claims.

Each claim is laid under the keys of the rules it takes part in (specific with specific of one key, generic with generic of one predicate,
generic with specific of one system-level predicate, specific with specific of aliased keys). The rules take disjoint kinds of pairs,
so their union needs no distinct, and the claims are read and keyed once for all of them. A hot block is split by the adaptive
skew join: both sides are plain exchanges on the key.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

RULES = ("specific", "generic", "cross")


def keyed(claims: DataFrame) -> DataFrame:
    return claims.withColumns({"skey": T.subject_key(F.col("subject")), "pkey": T.canonical_predicate(F.col("predicate")), "generic": T.generic_subject(F.col("subject"))})


def _ordered(pairs: DataFrame) -> DataFrame:
    """(a_id, b_id, pair_key) with a_id < b_id."""
    a, b = F.least("x", "y"), F.greatest("x", "y")
    return pairs.select(a.alias("a_id"), b.alias("b_id"), F.concat_ws("::", a, b).alias("pair_key"))


def _blocked(k: DataFrame, rules: tuple[str, ...]) -> DataFrame:
    """(id, rule, block, side): the claims under the keys of the rules; side 0 meets itself, side 1 meets side 2."""
    one = lambda on, rule, block, side: F.when(on & F.lit(rule in rules), F.struct(F.lit(rule).alias("rule"), block.alias("block"), side.alias("side")))
    generic, system = F.col("generic"), T.system_level(F.col("pkey"))
    under = F.array(
        one(~generic, "specific", F.to_json(F.array("skey", "pkey")), F.lit(0)),
        one(generic, "generic", F.col("pkey"), F.lit(0)),
        one(system, "cross", F.col("pkey"), F.when(generic, 1).otherwise(2)),
    )
    return k.select("id", F.inline(F.filter(under, lambda x: x.isNotNull())))


def _met(blocks: DataFrame) -> DataFrame:
    x, y = (blocks.select(F.col("id").alias(n), "rule", "block", F.col("side").alias(f"{n}_side")) for n in ("x", "y"))
    meet = (F.col("x_side") == 0) & (F.col("x") < F.col("y")) | (F.col("x_side") == 1) & (F.col("y_side") == 2)
    return _ordered(x.join(y, ["rule", "block"]).where(meet))


def specific_pairs(k: DataFrame) -> DataFrame:
    return _met(_blocked(k, RULES[:1]))


def global_pairs(k: DataFrame) -> DataFrame:
    return _met(_blocked(k, RULES[1:2]))


def cross_pairs(k: DataFrame) -> DataFrame:
    return _met(_blocked(k, RULES[2:]))


GRAM = 4
#: A form within another is at least this part of it, and both have GRAM letters or more.
SHARE = 0.6


def grams(form: Column) -> Column:
    """The distinct runs of GRAM letters of a form; none of a shorter one."""
    n = F.length(form)
    return F.when(n >= GRAM, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - GRAM + 1, F.lit(1))), lambda i: F.substring(form, i, GRAM)))).otherwise(F.array().cast("array<string>"))


def size_class(form: Column) -> Column:
    """Forms of which one can be within the other lie in the same class or in neighbouring ones."""
    return F.floor(F.log(F.greatest(F.length(form), F.lit(1))) / math.log(1 / SHARE) + 1e-9)


def alias_keys(k: DataFrame) -> DataFrame:
    """(p, q), p < q: subject keys that the entity rules match, however many there are.

    Two keys match when their forms are equal, in one alias group, or one within the other at three fifths of its length or more. Of the last kind candidates come from
    runs of four letters: a form is laid under each of its own, and looked for by its rarest one among forms of its size class and the next. That is linear in the length of the forms.
    """
    keys = k.where("NOT generic").select("skey").distinct().withColumn("form", T.entity_form(F.col("skey")))
    whole = F.array(F.col("form"), F.concat(F.lit("alias:"), T.canonical_alias(F.col("skey"))))
    under = keys.select("skey", F.explode(F.filter(whole, lambda f: f.isNotNull() & (f != ""))).alias("under"))
    side = lambda n: under.select(F.col("skey").alias(n), "under")
    alike = side("x").join(side("y"), "under").where("x < y").select(F.col("x").alias("p"), F.col("y").alias("q"))
    forms = keys.select("form").distinct()
    laid = forms.select("form", F.explode(grams(F.col("form"))).alias("gram"), size_class(F.col("form")).alias("class"))
    rare = laid.join(laid.groupBy("gram").agg(F.count("*").alias("n")), "gram").groupBy("form", "class").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    wanted = rare.select(F.col("form").alias("short"), "gram", F.explode(F.array(F.col("class"), F.col("class") + 1)).alias("class"))
    near = wanted.join(laid.withColumnRenamed("form", "long"), ["gram", "class"])
    near = near.where((F.length("short") < F.length("long")) & (F.length("short") >= SHARE * F.length("long") - 1e-9) & F.contains("long", F.col("short"))).select("short", "long")
    inside = near.join(keys.select(F.col("form").alias("short"), F.col("skey").alias("x")), "short").join(keys.select(F.col("form").alias("long"), F.col("skey").alias("y")), "long")
    met = alike.unionByName(inside.select(F.least("x", "y").alias("p"), F.greatest("x", "y").alias("q"))).where("p <> q").distinct()
    return met.where(T.resolve_entity(F.col("p"), F.col("q"))["is_match"])


def alias_pairs(k: DataFrame) -> DataFrame:
    s = k.where("NOT generic").select("id", "skey", "pkey")
    left = s.select(F.col("id").alias("x"), F.col("skey").alias("p"), "pkey").join(alias_keys(k), "p")
    return _ordered(left.join(s.select(F.col("id").alias("y"), F.col("skey").alias("q"), "pkey"), ["q", "pkey"]))


def candidate_pairs(claims: DataFrame) -> DataFrame:
    k = keyed(claims)
    return _met(_blocked(k, RULES)).unionByName(alias_pairs(k))


def compatible_subjects(a, b, predicate):
    same = (a == b) | (T.normalize_text(a) != "") & (T.normalize_text(a) == T.normalize_text(b)) | T.resolve_entity(a, b)["is_match"]
    ga, gb = T.generic_subject(a), T.generic_subject(b)
    return same | ga & gb | (ga | gb) & T.system_level(predicate)


def fact_id(subject: Column | str = "subject", predicate: Column | str = "predicate") -> Column:
    s, p = (F.col(x) if isinstance(x, str) else x for x in (subject, predicate))
    return F.to_json(F.struct(s.alias("s"), p.alias("p")))


def fact_pairs(claims: DataFrame) -> DataFrame:
    """(a_fact, b_fact): the ordered pairs of facts whose claims are candidate pairs, a fact with itself among them. Claims repeat facts many times, facts are compared once."""
    k = keyed(claims.select("subject", "predicate").distinct()).withColumn("id", fact_id())
    other = _met(_blocked(k, RULES)).unionByName(alias_pairs(k)).select("a_id", "b_id")
    own = _blocked(k, RULES[:2]).where("block IS NOT NULL").select(F.col("id").alias("a_id"), F.col("id").alias("b_id"))
    both = other.unionByName(other.select(F.col("b_id").alias("a_id"), F.col("a_id").alias("b_id"))).unionByName(own)
    return both.withColumnsRenamed({"a_id": "a_fact", "b_id": "b_fact"})


# --- probes: facts are the distinct (subject, predicate) of claims; these meet under keys, claims come in at the end ----------


def facts(claims: DataFrame) -> DataFrame:
    """Each (subject, predicate) once, with what its keys are made of."""
    s, p = F.col("subject"), F.col("predicate")
    own = {"skey": T.subject_key(s), "pkey": T.canonical_predicate(p), "form": T.entity_form(s), "norm": T.normalize_text(s), "generic": T.generic_subject(s), "system": T.system_level(p)}
    return claims.select("subject", "predicate").distinct().withColumns(own)


def _alias_forms() -> dict[str, str]:
    """form -> the forms that its alias group, or one that it was taken over from, makes it match, as SQL."""
    groups = T.alias_groups()
    near = {f: sorted({*own, *(g for g, members in groups.items() if f in members)}) for f, own in groups.items()}
    return {f: "array(" + ", ".join(f"'{x}'" for x in forms) + ")" for f, forms in near.items()}


def _key(kind: str, *parts) -> Column:
    return F.concat_ws("\x1f", F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def with_rarest(rows: DataFrame, laid: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``rare``, the run of letters of their ``form`` that the fewest forms of ``laid`` (of the rows themselves without it) have; null of a form without runs.

    A form within another one is found by any of its own runs, so that each side may choose by what it sees; a run that all forms begin with would bring them all together.
    """
    forms = rows.select("form").distinct()
    runs = forms.select("form", F.explode(grams(F.col("form"))).alias("gram"))
    count = (runs if laid is None else laid.select("form").distinct().select(F.explode(grams(F.col("form"))).alias("gram"))).groupBy("gram").agg(F.count("*").alias("n"))
    rare = runs.join(count, "gram", "left").groupBy("form").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("rare"))
    return rows.join(rare, "form", "left")


def posted_keys(f: DataFrame) -> DataFrame:
    """(block, subject, predicate): the keys under which a fact is found."""
    f = with_rarest(f)
    pkey, form, size = F.col("pkey"), F.col("form"), size_class(F.col("form"))
    one = lambda on, key: F.when(on, key)
    fixed = F.array(
        _key("subject", F.col("skey")), _key("predicate", pkey), one(F.col("generic"), _key("generic", pkey)), _key("form", form, pkey), one(F.col("norm") != "", _key("text", F.col("norm"), pkey)),
        one(F.length(form) >= GRAM, _key("short", F.col("rare"), size, pkey)),
    )
    long = F.transform(grams(form), lambda g: _key("long", g, size, pkey))
    rows = f.where("subject IS NOT NULL AND predicate IS NOT NULL").select(F.explode(F.concat(F.filter(fixed, lambda x: x.isNotNull()), long)).alias("block"), "subject", "predicate")
    return rows.distinct()


def asked_keys(f: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """(block, x_subject, x_predicate): the keys under which facts lie that a fact may go with; ``among`` are the facts looked through, where they are known."""
    f = with_rarest(f, among)
    pkey, form, size, generic, system = F.col("pkey"), F.col("form"), size_class(F.col("form")), F.col("generic"), F.col("system")
    forms = F.array_distinct(F.concat(F.array(form), F.coalesce(F.try_element_at(T.table(_alias_forms()), form), F.array().cast("array<string>"))))
    one = lambda on, key: F.when(on, key)
    around = F.array(size, size + 1)
    fixed = F.array(
        _key("subject", F.col("skey")), one(generic | system, _key("generic", pkey)), one(generic & system, _key("predicate", pkey)), one(F.col("norm") != "", _key("text", F.col("norm"), pkey)),
    )
    by_form = F.transform(forms, lambda g: _key("form", g, pkey))
    longer = F.when(F.length(form) >= GRAM, F.transform(around, lambda c: _key("long", F.col("rare"), c, pkey))).otherwise(F.array())
    shorter = F.flatten(F.transform(grams(form), lambda g: F.transform(F.array(size, size - 1), lambda c: _key("short", g, c, pkey))))
    rows = f.select(F.explode(F.concat(F.filter(fixed, lambda x: x.isNotNull()), by_form, longer, shorter)).alias("block"), F.col("subject").alias("x_subject"), F.col("predicate").alias("x_predicate"))
    return rows.distinct()


def compatible_facts(met: DataFrame) -> DataFrame:
    """Those of (x_subject, x_predicate, y_subject, y_predicate) that a probe takes: equal keys, one canonical predicate with compatible subjects, or one subject key with near predicates."""
    own = lambda n: {f"{n}s": T.subject_key(F.col(f"{n}_subject")), f"{n}p": T.canonical_predicate(F.col(f"{n}_predicate"))}
    rows = met.distinct().withColumns(own("x") | own("y"))
    pa, pb = F.col("x_predicate"), F.col("y_predicate")
    la, lb = T.leaf(pa), T.leaf(pb)
    near = T.synonyms(pa, pb) | T.synonyms(la, lb) | (T.composite_similarity(pa, pb) >= 0.65) & ~((la != lb) & (F.contains(pa, F.lit("_")) | F.contains(pb, F.lit("_"))))
    same = F.col("xs") == F.col("ys")
    by_predicate = (F.col("xp") == F.col("yp")) & (same | compatible_subjects(F.col("x_subject"), F.col("y_subject"), pa))
    return rows.where(by_predicate | same & near).select(*met.columns)


def probe_pairs(touched: DataFrame, claims: DataFrame) -> DataFrame:
    """Pairs of touched claims with all claims: equal keys; equal canonical predicate with a compatible subject; equal subject key with a near predicate."""
    every = facts(claims)
    met = asked_keys(facts(touched), every).join(posted_keys(every).withColumnsRenamed({"subject": "y_subject", "predicate": "y_predicate"}), "block").drop("block")
    return claim_pairs(compatible_facts(met), touched, claims)


def claim_pairs(near: DataFrame, touched: DataFrame, claims: DataFrame) -> DataFrame:
    """Pairs of the claims of pairs of facts, each once."""
    side = lambda df, n: df.select(F.col("id").alias(n), F.col("subject").alias(f"{n}_subject"), F.col("predicate").alias(f"{n}_predicate"))
    both = near.join(side(touched, "x"), ["x_subject", "x_predicate"]).join(side(claims, "y"), ["y_subject", "y_predicate"])
    return _ordered(both.where("x <> y")).dropDuplicates(["pair_key"])


# --- rows of equal texts: a measure of two texts is taken once, however many rows hold them ----------------------------

#: Rows of one text that stand together; a larger class is several such parts.
PART = 1000


def text_pairs(rows: DataFrame, block: list[str], text: str, key: str, measures) -> DataFrame:
    """(a, b, measures), a < b: all pairs of rows of one block. ``measures(s, t)`` gives the columns for the texts of a and of b.

    The rows of a block that hold one text are a class. Classes meet, are measured and only then give out their rows.
    """
    place = F.row_number().over(Window.partitionBy(*block, text).orderBy(key))
    parts = rows.select(*block, F.col(text).alias("s"), F.col(key).alias("a"), F.floor((place - 1) / PART).alias("part")).groupBy(*block, "s", "part").agg(F.collect_list("a").alias("a"))
    x, y = parts.drop("part"), parts.select(*block, F.col("s").alias("t"), F.col("a").alias("b"))
    met = x.join(y, block).where(F.array_min("a") < F.array_max("b"))
    measured = met.select("a", "b", *measures(F.col("s"), F.col("t")))
    names = [c for c in measured.columns if c not in ("a", "b")]
    some = measured.select(F.explode("a").alias("a"), "b", *names)
    return some.select("a", F.explode("b").alias("b"), *names).where("a < b")


# --- similarity joins: texts meet under keys that any two similar ones share, and are compared then --------------------


def near_predicates(x: DataFrame, y: DataFrame) -> DataFrame:
    """(x_predicate, y_predicate) of two tables of distinct predicates that can match whatever the subjects are, in either order.

    Two such share a token, a part of a token that the semantic similarity counts, a form, what is left of it without wrappers, or a group of synonyms.
    """

    def laid(df: DataFrame, n: str) -> DataFrame:
        p = F.col(f"{n}_predicate")
        norm, form, bare = T.normalize_text(p), T.predicate_form(F.coalesce(p, F.lit(""))), T.stripped(F.coalesce(p, F.lit("")))
        words = F.array_union(T.tokens(norm), F.filter(F.split(F.regexp_replace(norm, "[^a-z0-9]", " "), " "), lambda w: w != ""))
        groups = F.filter(F.transform(F.array(form, bare), lambda f: T.lookup(f, T.synonym_groups())), lambda g: g.isNotNull())
        keys = F.flatten(F.array(F.transform(words, lambda w: _key("word", w)), F.array(_key("form", form), _key("bare", bare)), F.transform(groups, lambda g: _key("group", g)), F.array(_key("text", norm))))
        return df.select(f"{n}_predicate", F.explode(F.array_distinct(keys)).alias("key"))

    met = laid(x, "x").join(laid(y, "y"), "key").select("x_predicate", "y_predicate").distinct()
    one = F.lit("x")
    return met.where(_either_order(one, F.col("x_predicate"), one, F.col("y_predicate")))


def _either_order(sa: Column, pa: Column, sb: Column, pb: Column) -> Column:
    return T.match_claims(sa, pa, sb, pb)["matches"] | T.match_claims(sb, pb, sa, pa)["matches"]


def near_entities(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query, candidate) of two tables of names that the entity rules can match: under equal names, forms, alias groups, and runs of letters of a form within another."""

    def laid(df: DataFrame, name: str, asking: bool) -> DataFrame:
        x = with_rarest(df.select(name).distinct().withColumn("form", T.entity_form(F.col(name))), candidates.select(T.entity_form(F.col("candidate")).alias("form")) if asking else None)
        form, size = F.col("form"), size_class(F.col("form"))
        short = F.length(form) >= GRAM
        classes = (lambda *c: F.array(*c)) if asking else (lambda *c: F.array(c[0]))
        forms = F.array_distinct(F.concat(F.array(form), F.coalesce(F.try_element_at(T.table(_alias_forms()), form), F.array().cast("array<string>")))) if asking else F.array(form)
        chosen = F.when(short, F.transform(classes(size, size + 1), lambda c: _key("long" if asking else "short", F.col("rare"), c))).otherwise(F.array())
        runs = F.flatten(F.transform(grams(form), lambda g: F.transform(classes(size, size - 1), lambda c: _key("short" if asking else "long", g, c))))
        same = F.array(_key("name", F.lower(F.trim(F.coalesce(F.col(name), F.lit(""))))))
        return x.select(name, F.explode(F.array_distinct(F.concat(same, F.transform(forms, lambda f: _key("form", f)), chosen, runs))).alias("key"))

    return laid(queries, "query", True).join(laid(candidates, "candidate", False), "key").select("query", "candidate").distinct()


def near_subjects(x: DataFrame, y: DataFrame, least: float = 0.75) -> DataFrame:
    """(x_subject, y_subject) of two tables of distinct subjects whose similarity or entities match; an exact similarity join.

    A similarity of ``least`` needs half of all tokens in common, or one text's words in a row within the other. Of the first kind two texts share one of their rarest tokens: of the one with
    fewer tokens (or as many) they share two thirds at least, so it is among a third of its own and one, and among half and one of the other's. Of the second kind the rarest token of one
    is any token of the other. Entities meet under their forms, alias groups and runs of letters.
    """
    subjects = lambda df, n: df.select(F.col(f"{n}_subject").alias("subject"))
    every = subjects(x, "x").unionByName(subjects(y, "y")).distinct()
    words = every.select("subject", F.explode(T.tokens(T.normalize_text(F.col("subject")))).alias("word"))
    count = words.groupBy("word").agg(F.count("*").alias("n"))
    ranked = words.join(count, "word").groupBy("subject").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "word"))), lambda w: w["word"]).alias("words"))  # of one text, bounded by it
    forms = T.entity_form(F.col("subject"))
    ranked = ranked.withColumnRenamed("subject", "_of")
    rows = every.join(ranked, F.col("subject").eqNullSafe(F.col("_of")), "left").select("subject", F.coalesce("words", F.array().cast("array<string>")).alias("words"), forms.alias("form"))
    rows = with_rarest(rows.withColumn("class", size_class(F.col("form"))))
    first = lambda part: F.slice("words", 1, F.floor(F.size("words") / part).cast("int") + 1)
    form = F.col("form")
    rarest = F.slice("words", 1, 1)
    with_kind = lambda kind, words: F.transform(words, lambda w: _key(kind, w))
    always = F.array(_key("form", form), F.when(F.size("words") == 0, _key("none")))
    short = F.when(F.length(form) >= GRAM, F.array(_key("short", F.col("rare"), F.col("class")))).otherwise(F.array())
    posted = F.concat(with_kind("third", first(3)), with_kind("half", first(2)), with_kind("any", F.col("words")), with_kind("rarest", rarest), always, short, F.transform(grams(form), lambda g: _key("long", g, F.col("class"))))
    near = F.array_distinct(F.concat(F.array(form), F.coalesce(F.try_element_at(T.table(_alias_forms()), form), F.array().cast("array<string>"))))
    longer = F.when(F.length(form) >= GRAM, F.transform(F.array(F.col("class"), F.col("class") + 1), lambda c: _key("long", F.col("rare"), c))).otherwise(F.array())
    shorter = F.flatten(F.transform(grams(form), lambda g: F.transform(F.array(F.col("class"), F.col("class") - 1), lambda c: _key("short", g, c))))
    asked = F.concat(with_kind("third", first(2)), with_kind("half", first(3)), with_kind("any", rarest), with_kind("rarest", F.col("words")), F.transform(near, lambda f: _key("form", f)), F.array(F.when(F.size("words") == 0, _key("none"))), longer, shorter)
    keyed_by = lambda keys: rows.select("subject", F.explode(F.array_distinct(F.filter(keys, lambda k: k.isNotNull()))).alias("key"))
    side = lambda df, n, keys: keyed_by(keys).join(df, F.col("subject").eqNullSafe(F.col(f"{n}_subject")), "left_semi").withColumnRenamed("subject", f"{n}_subject")
    met = side(x, "x", asked).join(side(y, "y", posted), "key").select("x_subject", "y_subject").distinct()
    a, b = F.col("x_subject"), F.col("y_subject")
    return met.where((T.composite_similarity(a, b) >= least) | T.resolve_entity(a, b)["is_match"] | T.resolve_entity(b, a)["is_match"])


def source_pairs(mine: DataFrame, claims: DataFrame) -> DataFrame:
    """Pairs of the claims of one source with all claims that the match accepts: no block keys of the engine, so none is missed.

    The match looks at subjects and predicates only, so these are compared instead of claims, each once, by two similarity joins. A subject that means the whole system goes with any
    other under a predicate of that level; such pairs come in by their predicates alone. Both orders are tried, as the pair's order decides later.
    """
    texts = lambda df, a: df.select(F.col("subject").alias(f"{a}_subject"), F.col("predicate").alias(f"{a}_predicate")).distinct()
    x, y = texts(mine, "x"), texts(claims, "y")
    predicates = near_predicates(x.select("x_predicate").distinct(), y.select("y_predicate").distinct())
    subjects = near_subjects(x.select("x_subject").distinct(), y.select("y_subject").distinct())
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    s = subjects.withColumnsRenamed({"x_subject": "_xs", "y_subject": "_ys"})
    p = predicates.withColumnsRenamed({"x_predicate": "_xp", "y_predicate": "_yp"})
    facts = ["x_subject", "x_predicate", "y_subject", "y_predicate"]
    alike = x.join(s, same("x_subject", "_xs")).join(p, F.col("x_predicate") == F.col("_xp")).join(y, same("_ys", "y_subject") & (F.col("_yp") == F.col("y_predicate"))).select(*facts)
    whole = lambda n: T.generic_subject(F.col(f"{n}_subject"))
    by_level = [x.where(on_x).join(p, F.col("x_predicate") == F.col("_xp")).join(y.where(on_y), F.col("_yp") == F.col("y_predicate")).select(*facts) for on_x, on_y in ((whole("x"), F.lit(True)), (~whole("x"), whole("y")))]
    near = alike.unionByName(by_level[0]).unionByName(by_level[1]).distinct()
    near = near.where(_either_order(F.col("x_subject"), F.col("x_predicate"), F.col("y_subject"), F.col("y_predicate")))
    side = lambda df, a: df.select(F.col("id").alias(a), F.col("subject").alias(f"{a}_s"), F.col("predicate").alias(f"{a}_p"))
    on = lambda a: same(f"{a}_s", f"{a}_subject") & (F.col(f"{a}_p") == F.col(f"{a}_predicate"))
    return _ordered(near.join(side(mine, "x"), on("x")).join(side(claims, "y"), on("y")).where("x <> y")).dropDuplicates(["pair_key"])
