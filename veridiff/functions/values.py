"""Typed value comparison as one column expression."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicon as L
from . import versions as V
from .text import let, one_of, table, trimmed

FIELDS = ("comparable", "equal", "compatible", "normalized_a", "normalized_b", "value_type", "strength", "difference")


def _result(comparable, equal, compatible, a, b, kind, strength, difference) -> Column:
    lit = lambda x, t: (x if isinstance(x, Column) else F.lit(x)).cast(t)
    kinds = ("boolean", "boolean", "boolean", "string", "string", "string", "double", "string")
    return F.struct(*(lit(v, t).alias(n) for v, t, n in zip((comparable, equal, compatible, a, b, kind, strength, difference), kinds, FIELDS)))


def _plain(equal: Column, a, b, kind, strength, difference: str, compatible=False) -> Column:
    return _result(True, equal, compatible, a, b, kind, F.when(equal, 0.0).otherwise(strength), F.when(~equal, difference))


def number_text(x: Column) -> Column:
    """A double without a trailing ``.0``."""
    return F.when(x == x.cast("bigint"), x.cast("bigint").cast("string")).otherwise(x.cast("string"))


def compare_strings(a: Column, b: Column, kind) -> Column:
    ca, cb = (F.regexp_replace(F.trim(x), r"(?U)\s+", " ") for x in (a, b))
    return _plain(F.lower(ca) == F.lower(cb), ca, cb, kind, 0.8, "VALUE_MISMATCH")


def compare_versions(a: Column, b: Column) -> Column:
    texts = {"pa": V.canonical(a), "pb": V.canonical(b), "ra": V.cleaned(a), "rb": V.cleaned(b), "va": V.coerced(a), "vb": V.coerced(b)}

    def with_intervals(v: Column) -> Column:
        known = {k: v[k] for k in texts} | {"ia": V.intervals(v["ra"]), "ib": V.intervals(v["rb"])}
        return let(F.struct(*(x.alias(k) for k, x in known.items())), lambda w: _versions(a, b, *(w[k] for k in known)))

    return let(F.struct(*(x.alias(k) for k, x in texts.items())), with_intervals)


def _versions(a: Column, b: Column, pa: Column, pb: Column, ra: Column, rb: Column, va: Column, vb: Column, ia: Column, ib: Column) -> Column:
    op = r"[><=~^\s*|xX]"
    has_a, has_b = F.coalesce(ra.rlike(op), F.lit(False)), F.coalesce(rb.rlike(op), F.lit(False))

    def within(ok: Column, na: Column, nb: Column) -> Column:
        return _result(True, False, ok, na, nb, "version", F.when(ok, 0.0).otherwise(1.0), F.when(ok, "RANGE_SATISFIED").otherwise("RANGE_VIOLATION"))

    meets = V.intersects(ia, ib)
    major = F.split(pa, r"\.")[0] != F.split(pb, r"\.")[0]
    same = pa == pb
    return (
        F.when((a == b) & pa.isNotNull(), _result(True, True, True, pa, pa, "version", 0.0, None))
        .when(has_a & ~has_b & vb.isNotNull(), within(V.satisfies(vb, ia), F.coalesce(pa, ra), vb))
        .when(~has_a & has_b & va.isNotNull(), within(V.satisfies(va, ib), va, F.coalesce(pb, rb)))
        .when(has_a & has_b, _result(True, ra == rb, meets, F.coalesce(pa, ra), F.coalesce(pb, rb), "version", F.when(meets, 0.0).otherwise(1.0), F.when(meets, "RANGES_INTERSECT").otherwise("DISJOINT_RANGES")))
        .when(pa.isNull() | pb.isNull(), compare_strings(a, b, "string"))
        .otherwise(_result(True, same, same, pa, pb, "version", F.when(same, 0.0).when(major, 1.0).otherwise(0.6), F.when(~same, F.when(major, "MAJOR_VERSION_MISMATCH").otherwise("MINOR_VERSION_MISMATCH"))))
    )


#: Names of months by their first letters, and what may stand for the zone of UTC. Fixed values.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
ZONES = "utc|ut|gmt|z"
_CLOCK = rf"[\s,t]+(\d{{1,2}}):(\d{{2}})(?::(\d{{2}})(?:\.\d+)?)?\s*(am|pm)?\s*(?:{ZONES})?\s*(?:([+-])(\d{{2}}):?(\d{{2}}))?\s*$"
_MONTH = rf"(?:{'|'.join(MONTHS)})[a-z]*"
#: Words before the first number are skipped, after it only months may stand.
_FREE = rf"^(?:[a-z]+[\s,./-]+)*(?:\d{{1,6}})(?:(?:st|nd|rd|th)?[\s,./-]+(?:\d{{1,6}}|{_MONTH}))*[\s,.]*$"


def free_date(x: Column) -> Column:
    """``yyyy-MM-dd`` of a date in words or numbers, null if there is none.

    Up to three numbers and one month's name, and a time of day with its offset. With a name the number above 31 is the year; without one the order is
    month, day, year, or year, month, day where the first is above 31. What is missing is the first month, the first day and the year 2001; years of two digits lie
    between 1950 and 2049. So a lone number is a month or a year.
    """
    low = F.lower(F.trim(F.regexp_replace(x, r"\([^)]*\)", " ")))

    def parts(t: Column) -> Column:
        day = F.regexp_replace(t, _CLOCK, "")
        part = lambda k: F.coalesce(F.regexp_extract(t, _CLOCK, k).try_cast("int"), F.lit(0))
        half = F.regexp_extract(t, _CLOCK, 4)
        hour = F.when(half == "pm", part(1) % 12 + 12).when(half == "am", part(1) % 12).otherwise(part(1))
        ahead = F.when(F.regexp_extract(t, _CLOCK, 5) == "-", -1).otherwise(1) * (part(6) * 60 + part(7))
        numbers = F.transform(F.regexp_extract_all(day, F.lit(r"\d+"), F.lit(0)), lambda n: n.try_cast("int"))
        name = F.regexp_extract(day, rf"(?:^|[^a-z])({'|'.join(MONTHS)})[a-z]*", 1)
        minutes = hour * 60 + part(2) - ahead
        return F.struct(numbers.alias("n"), F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), name), F.lit(0)).cast("int").alias("name"), F.floor(minutes / 1440).cast("int").alias("days"), (day.rlike(_FREE) & (hour < 25)).alias("ok"))

    def composed(v: Column) -> Column:
        at = lambda k: F.coalesce(F.get(v["n"], F.lit(k)), F.lit(1))
        is_day = at(0).between(1, 31)
        named = F.struct(F.when(is_day, at(1)).otherwise(at(0)).alias("y"), v["name"].alias("m"), F.when(is_day, at(0)).otherwise(at(1)).alias("d"))
        plain = F.when(is_day, F.struct(at(2).alias("y"), at(0).alias("m"), at(1).alias("d"))).otherwise(F.struct(at(0).alias("y"), at(1).alias("m"), at(2).alias("d")))
        return F.when(v["ok"] & (F.size(v["n"]) <= 3), let(F.when(v["name"].isNotNull(), named).otherwise(plain), lambda w: dated(w, v["days"])))

    def dated(w: Column, days: Column) -> Column:
        year = F.when(w["y"] <= 49, w["y"] + 2000).when(w["y"] <= 99, w["y"] + 1900).otherwise(w["y"])
        ok = w["m"].between(1, 12) & w["d"].between(1, 31) & (year <= 9999)
        return F.when(ok, F.date_format(F.date_add(F.make_date(F.when(ok, year), F.when(ok, w["m"]), F.lit(1)), w["d"] - 1 + days), "yyyy-MM-dd"))

    return F.when(x.rlike(r"\d"), let(low, lambda t: let(parts(t), composed)))


_ISO = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})"


def normalize_date(x: Column, day_first: bool = False) -> Column:
    slash = r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})$"
    p, q, y = (F.regexp_extract(x, slash, k).try_cast("int") for k in (1, 2, 3))
    flip = F.when((p > 12) & (q <= 12), True).when((q > 12) & (p <= 12), False).otherwise(day_first)
    return (
        F.when(x.rlike(_ISO), F.concat_ws("-", F.regexp_extract(x, _ISO, 1), *(F.lpad(F.regexp_extract(x, _ISO, k), 2, "0") for k in (2, 3))))
        .when(x.rlike(slash), F.concat_ws("-", y, F.lpad(F.when(flip, q).otherwise(p).cast("string"), 2, "0"), F.lpad(F.when(flip, p).otherwise(q).cast("string"), 2, "0")))
        .otherwise(free_date(x))
    )


def compare_dates(a: Column, b: Column, day_first: bool = False) -> Column:
    forms = F.struct(normalize_date(a, day_first).alias("na"), normalize_date(b, day_first).alias("nb"))
    return let(forms, lambda v: _dates(a, b, v["na"], v["nb"]))


def _dates(a: Column, b: Column, na: Column, nb: Column) -> Column:
    days = F.abs(F.date_diff(na.try_cast("date"), nb.try_cast("date")))
    unread = _result(False, F.lower(F.trim(a)) == F.lower(F.trim(b)), None, F.trim(a), F.trim(b), "date", 0.5, "UNPARSEABLE_DATE")
    return F.when(na.isNull() | nb.isNull(), unread).otherwise(_plain(na == nb, na, nb, "date", F.least(F.lit(1.0), 0.4 + F.coalesce(days, F.lit(0)) * 0.1), "DATE_MISMATCH"))


def currency(x: Column) -> Column:
    return F.coalesce(*(F.when(F.contains(F.upper(x), F.lit(sign)), code) for sign, code in L.CURRENCIES))


def amount(x: Column) -> Column:
    digits = F.regexp_replace(x, "[^0-9.]", "")
    return F.regexp_extract(digits, r"^(\d+(?:\.\d*)?|\.\d+)", 1).try_cast("double")


def compare_prices(a: Column, b: Column) -> Column:
    ca, cb, xa, xb = currency(a), currency(b), amount(a), amount(b)
    na, nb = (F.concat_ws(" ", c, number_text(x)) for c, x in ((ca, xa), (cb, xb)))
    return (
        F.when(xa.isNull() | xb.isNull(), compare_strings(a, b, "price"))
        .when(ca != cb, _result(True, False, None, na, nb, "price", 1.0, "CURRENCY_MISMATCH"))
        .otherwise(_plain(F.abs(xa - xb) < 0.001, na, nb, "price", 0.9, "AMOUNT_MISMATCH"))
    )


_QUANTITY = r"^([-+]?\d+(?:\.\d+)?)\s*([a-z]*)$"


_UNITS = {word: f"named_struct('factor', {factor!r}D, 'unit', '{unit}', 'shown', ' {shown}')" for words, factor, unit, shown in L.UNITS for word in words.split()}


def quantity(x: Column) -> Column:
    """struct(amount, unit, display) or null; sizes in bytes and times in milliseconds, ``m`` is minutes."""
    t = F.lower(F.regexp_replace(F.trim(x), ",", ""))

    def parts(t: Column) -> Column:
        unit = F.regexp_extract(t, _QUANTITY, 2)
        found = F.struct(F.regexp_extract(t, _QUANTITY, 1).try_cast("double").alias("n"), unit.alias("unit"), F.try_element_at(table(_UNITS), unit).alias("u"))
        return F.when(t.rlike(_QUANTITY), let(found, lambda v: F.struct(
            (v["n"] * F.coalesce(v["u"]["factor"], F.lit(1.0))).alias("amount"), F.coalesce(v["u"]["unit"], F.nullif(v["unit"], F.lit(""))).alias("unit"),
            F.concat(number_text(v["n"]), F.coalesce(v["u"]["shown"], F.lit(""))).alias("display"))))

    return let(t, parts)


def compare_numbers(a: Column, b: Column, kind) -> Column:
    return let(F.struct(quantity(a).alias("qa"), quantity(b).alias("qb")), lambda v: _numbers(a, b, v["qa"], v["qb"], kind))


def _numbers(a: Column, b: Column, qa: Column, qb: Column, kind) -> Column:
    ua, ub = qa["unit"], qb["unit"]
    close = F.abs(qa["amount"] - qb["amount"]) < 0.000001
    loose = lambda x: F.regexp_extract(F.regexp_replace(F.trim(x), ",", ""), r"^\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)", 1).try_cast("double")
    xa, xb = loose(a), loose(b)
    return (
        F.when(qa.isNotNull() & qb.isNotNull(),
            F.when(ua.isNotNull() & ub.isNotNull() & (ua != ub), _result(True, False, None, qa["display"], qb["display"], kind, 1.0, "UNIT_DIMENSION_MISMATCH"))
            .when(ua.isNull() != ub.isNull(), _result(True, False, None, qa["display"], qb["display"], kind, 0.9, "UNIT_MISMATCH"))
            .otherwise(_plain(close, qa["display"], qb["display"], kind, 0.85, "NUMERIC_MISMATCH")))
        .when(xa.isNull() | xb.isNull(), compare_strings(a, b, kind))
        .otherwise(_plain(F.abs(xa - xb) < 0.000001, number_text(xa), number_text(xb), kind, 0.85, "NUMERIC_MISMATCH"))
    )


def compare_statuses(a: Column, b: Column) -> Column:
    la, lb = F.lower(F.trim(a)), F.lower(F.trim(b))
    both = lambda words: one_of(la, words) & one_of(lb, words)
    return _plain((la == lb) | both(L.AFFIRMATIVE) | both(L.NEGATIVE), la, lb, "status", 0.95, "STATUS_MISMATCH")


def boolean(x: Column) -> Column:
    v = F.lower(F.trim(x))
    return F.when(one_of(v, L.TRUE_WORDS), True).when(one_of(v, L.FALSE_WORDS), False)


def compare_booleans(a: Column, b: Column) -> Column:
    ba, bb = boolean(a), boolean(b)
    return F.when(ba.isNull() | bb.isNull(), compare_strings(a, b, "boolean")).otherwise(_plain(ba == bb, ba.cast("string"), bb.cast("string"), "boolean", 1.0, "BOOLEAN_MISMATCH"))


def infer_pair_type(a: Column, b: Column) -> Column:
    """Type of two untyped values."""
    def version(x: Column) -> Column:
        s = F.trim(x)
        dotted = s.rlike(r"(?i)(?<![A-Za-z0-9_])v?\d+(\.\d+)+(?![A-Za-z0-9_])")
        return ~s.rlike(r"^\d+$") & ~V.not_a_version(s) & (dotted | V.is_range(s) & s.rlike(r"[\^~><=v.]"))

    date = lambda x: free_date(x).isNotNull()
    price = lambda x: x.rlike(r"(?i)[$€£¥₹]|(?<![A-Za-z0-9_])(?:INR|USD|EUR|GBP|JPY|CAD|AUD)(?![A-Za-z0-9_])")
    units = "|".join(sorted((w for u in L.UNITS for w in u[0].split()), key=len, reverse=True))
    number = lambda x: F.trim(x).rlike(rf"(?i)^[-+]?[\d,]+(?:\.\d+)?\s*(?:{units})?$")
    return (
        F.when(version(a) & version(b), "version").when(date(a) & date(b), "date").when(price(a) | price(b), "price")
        .when(boolean(a).isNotNull() & boolean(b).isNotNull(), "boolean").when(number(a) & number(b), "number").otherwise("string")
    )


def compare(a: Column, b: Column, kind: Column | str | None = None, day_first: bool = False) -> Column:
    """Struct of FIELDS; ``kind`` null or missing means inference. A kind that is known beforehand, as a string, needs its own comparison only."""
    a, b = trimmed(F.coalesce(a, F.lit(""))), trimmed(F.coalesce(b, F.lit("")))
    if isinstance(kind, str) and kind:
        return let(F.struct(a.alias("a"), b.alias("b")), lambda v: _dispatch(v["a"], v["b"], kind.lower(), F.lit(kind), day_first))
    given = F.lit(None).cast("string") if kind is None else F.when(F.lit(kind) != "", F.lit(kind))
    inferred = infer_pair_type(a, b) if kind is None else F.when(given.isNull(), infer_pair_type(a, b))
    one = F.struct(a.alias("a"), b.alias("b"), F.lower(F.coalesce(given, inferred)).alias("t"), F.coalesce(given, F.lit("string")).alias("named"))
    return let(one, lambda v: _dispatch(v["a"], v["b"], v["t"], v["named"], day_first))


def _dispatch(a: Column, b: Column, t: Column | str, named: Column, day_first: bool) -> Column:
    kind = F.lit(t)
    cases = [
        (("version",), lambda: compare_versions(a, b)), (("date",), lambda: compare_dates(a, b, day_first)), (("price",), lambda: compare_prices(a, b)),
        (("number", "quantity"), lambda: compare_numbers(a, b, kind)), (("status",), lambda: compare_statuses(a, b)), (("boolean",), lambda: compare_booleans(a, b)),
    ]
    empty = F.when((a == "") & (b == ""), _result(True, True, True, "", "", named, 0.0, None)).when((a == "") | (b == ""), _result(True, False, False, a, b, named, 1.0, "EMPTY_VS_NONEMPTY"))
    if isinstance(t, str):
        return empty.otherwise(next((f() for names, f in cases if t in names), compare_strings(a, b, kind)))
    for names, f in cases:
        empty = empty.when(one_of(t, " ".join(names)), f())
    return empty.otherwise(compare_strings(a, b, t))
