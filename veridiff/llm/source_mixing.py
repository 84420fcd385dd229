"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only.

Every document of a source is wanted ``target / source_size`` times. Whole copies are given at once; what is left is a copy
probability between 0 and 1 that must become 0 or 1. Two documents meet in a *duel*: words move from one probability to the
other, in a random direction that leaves both expectations as they are, until one of them is integral. The words wanted of the
pair do not change. Documents meet in leaves of about ``FAN``, each leaf keeps at most one document undecided, and these meet
again level by level, so that in the end one document of a source at most is rounded without a partner.

All random numbers are keyed hashes of the documents that meet, and leaves depend on the data alone: reruns agree, whatever
the partitioning. Repeated rows are counted before anything else, so that a crowd of copies is one entry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: A word of the contract: whatever stands between blanks, tabs, line feeds, vertical tabs, form feeds and carriage returns.
WORD = r"[^\x20\x09-\x0D]+"
FAN = 64
#: Below this a copy probability counts as 0, and as near to 1 as 1.
LEAST = 1e-9
#: Sources are broadcast up to this many bytes of names and figures; beyond it they are joined by salted keys.
BROADCAST_BYTES = 8_000_000
SALTS = 16
#: Repeated rows of one document that are dealt out as one piece.
PIECE = 4096

ITEM = "struct<size: bigint, doc_id: bigint, n: bigint, whole: bigint, part: double>"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def draw(seed: int, *by: Column) -> Column:
    """A number in [0, 1) that depends on ``seed`` and ``by`` alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *by), 11) * F.lit(2.0**-53)


def rank_sources(sources: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """One row per source with ``rank`` (by code point, null last) and its ``weight``; sorted in ranges, no task sees all sources."""
    last = F.col("source").isNull()
    parts = C.shuffle_partitions(sources.sparkSession)
    dealt = C.materialize(sources.repartitionByRange(parts, last, "source").withColumn("range", F.spark_partition_id()), "mix-sources")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))  # a row per range
    place = F.row_number().over(Window.partitionBy("range").orderBy(last, "source")) - 1
    ranked = dealt.join(F.broadcast(starts), "range").withColumn("rank", F.col("start") + place)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    return ranked.select("source", "rank", "n_rows", "source_size", weight.alias("weight"))


def water_level(ranked: DataFrame, budget: float, most: float) -> float:
    """The level at which targets of ``weight * level``, none above ``most`` times its source's size, add up to ``budget``.

    Each round shares what is left by weight among the sources that are not full; only three sums come to the driver.
    """
    cap, level = F.col("source_size") * F.lit(float(most)), 0.0
    while True:
        full = cap <= F.col("weight") * F.lit(level)
        got = ranked.agg(F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)), F.sum(F.when(~full, F.col("weight")))).first()
        if got[1] is None:
            return float("inf")  # all are full
        rise = (budget - got[0]) / got[1]
        if rise <= level * (1 + 1e-12):
            return level
        level = rise


def with_targets(sizes: DataFrame, share: float, weights: tuple[float, ...], most: float) -> DataFrame:
    """(source, rank, n_rows, source_size, target) of all sources of a table of sizes."""
    sources = sizes.groupBy("source").agg(F.count("*").alias("n_rows"), F.sum("size").alias("source_size"))
    ranked = C.materialize(rank_sources(sources, weights), "mix-ranks")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level = water_level(ranked, share * total, most)
    target = F.least(F.col("source_size") * F.lit(float(most)), F.col("weight") * F.lit(level))
    return ranked.withColumn("target", F.when(F.col("source_size") > 0, target).otherwise(0.0))


def join_sources(rows: DataFrame, sources: DataFrame, key: str, broadcast: bool) -> DataFrame:
    """Each row with its source's columns. Few sources are broadcast; of many, a hot one is spread over ``SALTS`` keys."""
    other = sources.withColumnRenamed(key, "_key")
    if broadcast:
        return rows.join(F.broadcast(other), rows[key].eqNullSafe(F.col("_key"))).drop("_key")
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "size"), F.lit(SALTS)))
    spread = other.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(spread, salted[key].eqNullSafe(F.col("_key")) & (F.col("_salt") == F.col("_copy"))).drop("_key", "_salt", "_copy")


def settle(part: Column) -> Column:
    return F.when(part < LEAST, 0.0).when(part > 1 - LEAST, 1.0).otherwise(part)


def duel(a: Column, b: Column, seed: int) -> Column:
    """Both items after words have moved between them until one copy probability is 0 or 1; expectations stay."""
    gain = F.least((1 - a.part) * a["size"], b.part * b["size"])  # words that a can take from b
    give = F.least(a.part * a["size"], (1 - b.part) * b["size"])

    def moved(x: Column) -> Column:
        words = F.when(draw(seed, a.doc_id, a["size"], b.doc_id, b["size"]) * (x.gain + x.give) < x.give, x.gain).otherwise(-x.give)
        return let(words, lambda w: F.array(a.withField("part", settle(a.part + w / a["size"])), b.withField("part", settle(b.part - w / b["size"]))))

    return let(F.struct(gain.alias("gain"), give.alias("give")), moved)


def undecided(x: Column) -> Column:
    return (x.part > 0) & (x.part < 1) & (x["size"] > 0)


def reduce_group(items: Column, seed: int) -> Column:
    """struct(done, rest) of one group: duels in falling order of size; ``rest`` has one undecided item at most."""
    empty = F.array().cast(f"array<{ITEM}>")
    start = F.struct(F.filter(items, lambda x: ~undecided(x)).alias("done"), empty.alias("rest"))

    def step(acc: Column, x: Column) -> Column:
        met = let(
            duel(acc.rest[0], x, seed),
            lambda pair: F.struct(F.concat(acc.done, F.filter(pair, lambda y: ~undecided(y))).alias("done"), F.filter(pair, undecided).alias("rest")),
        )
        return F.when(F.size(acc.rest) == 0, F.struct(acc.done.alias("done"), F.array(x).alias("rest"))).otherwise(met)

    return F.aggregate(F.filter(items, undecided), start, step)


def reduce_level(rows: DataFrame, seed: int, label: str) -> DataFrame:
    """(rank, leaf, item) rows to one row per (rank, leaf) with ``done`` and ``rest``."""
    groups = rows.groupBy("rank", "leaf").agg(F.sort_array(F.collect_list("item"), asc=False).alias("items"))
    met = groups.select("rank", "leaf", reduce_group(F.col("items"), seed).alias("met"))
    return C.materialize(met.select("rank", "leaf", "met.done", "met.rest"), label)


def mix(docs: DataFrame, share: float = 1.5, weights: tuple[float, ...] = (3.0, 1.0, 2.0), most: float = 2.0, seed: int = 13) -> DataFrame:
    """doc_id, size, source_size, target and taken for each row of ``docs`` (doc_id, text, source).

    Sources, ordered by code point with null last, have the weights in turn and share ``share`` times all words; no target is above
    ``most`` times its source's words, what is cut is shared again by weight. ``taken`` is a multiple of ``size``, at most the least
    whole number of copies that is not below the target's ratio.

    Null texts and texts without words have size 0 and give nothing; a null source is a source; a null or repeated doc_id is an id
    like any other: the copies of equal (source, doc_id, size) are shared as evenly as whole copies allow. An empty table gives
    none; further columns are not looked at. Ties of size go by doc_id.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sizes = C.materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size.alias("size")), "mix-sizes")
    sources = C.materialize(with_targets(sizes, share, weights, most), "mix-targets")
    top = sources.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("source")), F.lit(0)), F.coalesce(F.max("n_rows"), F.lit(0))).first()
    small = 64 * top[0] + top[1] <= BROADCAST_BYTES

    # a group of repeated rows is one entry
    entries = join_sources(sizes.groupBy("source", "doc_id", "size").agg(F.count("*").alias("n")), sources, "source", small)
    wanted = F.when(F.col("size") > 0, F.col("n") * F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(F.col("wanted") + LEAST)
    part = settle(F.greatest(F.col("wanted") - F.col("whole"), F.lit(0.0)))
    leaves = F.greatest(F.ceil(F.col("n_rows") / FAN), F.lit(1))
    item = F.struct("size", "doc_id", "n", "whole", part.alias("part")).cast(ITEM).alias("item")
    rows = entries.withColumn("wanted", wanted).withColumn("whole", whole).select("rank", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), leaves).alias("leaf"), item)

    levels = [reduce_level(rows, seed, "mix-level")]
    count = max(1, -(-top[2] // FAN))
    while count > 1:
        up = levels[-1].select("rank", F.floor(F.col("leaf") / FAN).alias("leaf"), F.explode("rest").alias("item"))
        levels.append(reduce_level(up, seed + len(levels), "mix-level"))
        count = -(-count // FAN)

    # the one item of a source that found no partner goes to the nearer side
    last = levels[-1].select("rank", F.explode("rest").alias("item")).withColumn("item", F.col("item").withField("part", F.round(F.col("item.part"))))
    decided = last
    for level in levels:
        decided = decided.unionByName(level.select("rank", F.explode("done").alias("item")))
    copies = decided.select("rank", "item.doc_id", "item.size", "item.n", (F.col("item.whole") + F.col("item.part").cast("long")).alias("copies"))
    dealt = join_sources(deal(copies), sources.select("rank", "source_size", "target"), "rank", small)
    return dealt.select("doc_id", "size", "source_size", "target", "taken")


def deal(copies: DataFrame) -> DataFrame:
    """A row for each of the ``n`` repeated rows of an entry, its copies shared evenly; many rows are made by many tasks."""
    first = lambda rows: rows.withColumn("start", F.lit(0).cast("long"))
    few = first(copies.where(F.col("n") <= PIECE))
    pieces = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(PIECE).cast("long")))
    many = copies.where(F.col("n") > PIECE).withColumn("start", pieces).repartition(C.shuffle_partitions(copies.sparkSession), "doc_id", "size", "start")
    rows = few.unionByName(many)
    row = F.explode(F.sequence(F.col("start"), F.least(F.col("start") + PIECE, F.col("n")) - 1))
    each = F.floor(F.col("copies") / F.col("n")) + F.when(F.col("row") < F.col("copies") % F.col("n"), 1).otherwise(0)
    return rows.withColumn("row", row).select("rank", "doc_id", "size", (each * F.col("size")).alias("taken"))
