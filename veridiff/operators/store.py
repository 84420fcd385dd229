"""Keyed upsert with history, review lifecycle, integrity and reads, as set operations over append-only tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schemas
from ..functions import text as T
from . import blocking


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key; partial aggregation, no window over hot keys."""
    return rows.groupBy(*key).agg(F.max_by(F.struct("*"), F.struct(*order)).alias("r")).select("r.*")


def _steps(current: DataFrame, staged: DataFrame) -> tuple[DataFrame, list[str]]:
    """The rows that start a run of equal values of a key: the current row first, then the staged ones by observed_at and id, one after the other.

    Adds ``old`` (whether the key was there), ``first`` (its first row), ``staged`` (rows staged for it), ``before`` and ``after`` (the neighbouring runs' rows).
    """
    cols = [c for c in current.columns if c != "external_id"]
    names = ["external_id", *cols]
    both = current.select(*names, F.lit(0).alias("_seq")).unionByName(staged.select(*names, F.lit(1).alias("_seq")))
    key = Window.partitionBy("external_id")
    order = key.orderBy("_seq", "observed_at", "id")
    whole, before = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, -1)
    known = F.last("normalized_value", ignorenulls=True).over(before)
    differs = ~F.col("value").eqNullSafe(F.lag("value").over(order)) | F.col("normalized_value").isNotNull() & ~F.col("normalized_value").eqNullSafe(known)
    marked = both.withColumns({
        "_starts": (F.row_number().over(order) == 1) | differs, "_old": F.min("_seq").over(key) == 0, "_staged": F.sum("_seq").over(key),
        "_first": F.first(F.struct("id", "first_seen_at", "created_at")).over(whole),
    })
    starts = marked.where("_starts").withColumn("_row", F.struct(*cols))
    return starts.withColumns({"_before": F.lag("_row").over(order), "_after": F.lead("_row").over(order), "_run": F.row_number().over(order)}), cols


def upsert_claims(current: DataFrame, staged: DataFrame) -> DataFrame:
    """One row for each external_id of either table, with ``change``: created, updated, unchanged or kept, and the row that was ``superseded`` last.

    Staged rows of one key are taken in one after the other, by observed_at and id. An unchanged claim keeps its old row; id, first sight and creation are those of the key's
    first row. :func:`history_rows` has all values between.
    """
    steps, cols = _steps(current, staged)
    moved = F.when(~F.col("_old"), "created").when(F.col("_staged") == 0, "kept").when(F.col("_run") > 1, "updated").otherwise("unchanged")
    stable = {x: F.col("_first")[x] for x in ("id", "first_seen_at", "created_at")}
    last = steps.where("_after IS NULL")
    return last.select("external_id", *(stable.get(x, F.col(x)).alias(x) for x in cols), moved.alias("change"), F.when(F.col("_run") > 1, F.col("_before")).alias("superseded"))


def history_rows(current: DataFrame, staged: DataFrame) -> DataFrame:
    """A row for each value that a staged row replaced, also where several rows are staged for one key."""
    steps, _ = _steps(current, staged)
    gone = steps.where("_after IS NOT NULL")
    own = [F.col(x) for x in ("source_id", "value", "normalized_value", "observed_at", "first_seen_at", "last_seen_at")]
    return gone.select(F.concat_ws("@", "_first.id", "_run").alias("id"), F.col("_first.id").alias("claim_id"), *own, F.col("_after.observed_at").alias("superseded_at"), F.lit(None).cast("string").alias("superseded_by"))


def value_changes(claims: DataFrame, key: list[str]) -> DataFrame:
    """SCD rows from an observation log: one per run of equal values of a key."""
    w = Window.partitionBy(*key).orderBy("observed_at", "id")
    marked = claims.withColumn("before", F.lag("value").over(w)).withColumn("n", F.row_number().over(w))
    return marked.where((F.col("n") == 1) | ~F.col("value").eqNullSafe(F.col("before"))).drop("before", "n")


def new_pairs(found: DataFrame, stored: DataFrame) -> DataFrame:
    return found.join(stored.select(pair_key("claim_a_id", "claim_b_id").alias("pair_key")), "pair_key", "left_anti")


def known_pairs(found: DataFrame, stored: DataFrame) -> DataFrame:
    return found.join(stored.select(pair_key("claim_a_id", "claim_b_id").alias("pair_key")), "pair_key", "left_semi")


def pair_key(a: str, b: str) -> Column:
    return F.concat_ws("::", F.least(a, b), F.greatest(a, b))


def orphans(child: DataFrame, fk: str, parent: DataFrame) -> DataFrame:
    return child.join(parent.select(F.col("id").alias(fk)), fk, "left_anti")


def cascade_delete(sources: DataFrame, claims: DataFrame, contradictions: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the sources whose ids are in ``gone`` and all that hangs on them."""
    s = sources.join(gone.select("id"), "id", "left_anti")
    c = claims.join(gone.select(F.col("id").alias("source_id")), "source_id", "left_anti")
    lost = claims.join(c.select("id"), "id", "left_anti").select("id")
    k = contradictions.join(lost.select(F.col("id").alias("claim_a_id")), "claim_a_id", "left_anti").join(lost.select(F.col("id").alias("claim_b_id")), "claim_b_id", "left_anti")
    return s, c, k


def check_event(action: str, reason: str | None, chosen: str | None, pair: tuple[str, str]) -> str:
    """The status an action leads to, or an error."""
    if action not in schemas.ACTIONS:
        raise ValueError(f"unknown action {action}")
    if action in ("RESOLVE", "DISMISS") and not (reason or "").strip():
        raise ValueError(f"{action} needs a reason")
    if chosen is not None and chosen not in pair:
        raise ValueError("the chosen claim is not one of the pair")
    return schemas.ACTIONS[action]


def current_status(contradictions: DataFrame, events: DataFrame) -> DataFrame:
    """Each contradiction with the status of its last event; a chosen claim stays until another one is chosen."""
    to = F.create_map(*[F.lit(x) for kv in schemas.ACTIONS.items() for x in kv])
    last = events.groupBy("contradiction_id").agg(F.max_by(to[F.col("action")], "seq").alias("now"), F.max_by("chosen_claim_id", F.when(F.col("chosen_claim_id").isNotNull(), F.col("seq"))).alias("chosen_claim_id"), F.max("performed_at").alias("changed_at"))
    return contradictions.join(last.withColumnRenamed("contradiction_id", "id"), "id", "left").withColumn("status", F.coalesce("now", "status")).drop("now")


def audit(events: DataFrame) -> DataFrame:
    """Newest first, of equal times the last one recorded, with the status before and after each action."""
    to = F.create_map(*[F.lit(x) for kv in schemas.ACTIONS.items() for x in kv])
    w = Window.partitionBy("contradiction_id").orderBy("seq")
    out = events.withColumn("new_status", to[F.col("action")])
    return out.withColumn("previous_status", F.coalesce(F.lag("new_status").over(w), F.lit("OPEN"))).orderBy("contradiction_id", F.desc("performed_at"), F.desc("seq"))


def by_id(rows: DataFrame, value: str, column: str = "id") -> DataFrame:
    """The row of an id or external id."""
    return rows.where(F.col(column) == F.lit(value))


def by_pair(contradictions: DataFrame, one: str, other: str) -> DataFrame:
    """The contradiction of two claims, whichever comes first."""
    return contradictions.where(pair_key("claim_a_id", "claim_b_id") == F.lit("::".join(sorted((one, other)))))


def find_source(sources: DataFrame, name: str) -> DataFrame:
    """The source with this id, or with this name, uri or external id in any case; of several the first in the order of lists."""
    low = F.lower(F.lit(name))
    hit = sources.where((F.col("id") == name) | (F.lower("name") == low) | (F.lower("uri") == low) | (F.lower("external_id") == low))
    return hit.orderBy(F.desc("created_at"), "id").limit(1)


def entity_candidates(queries: DataFrame, candidates: DataFrame, least: float = 0.7) -> DataFrame:
    """(query, candidate, confidence, match_type, rank): of each query the candidates that it matches, best first. Both are tables of any size; repeated names count once."""
    met = blocking.near_entities(queries, candidates).withColumn("r", T.resolve_entity(F.col("query"), F.col("candidate")))
    order = Window.partitionBy("query").orderBy(F.desc("r.confidence"), "candidate")
    hits = met.where(F.col("r.is_match") & (F.col("r.confidence") >= least))
    return hits.select("query", "candidate", "r.confidence", "r.match_type", F.row_number().over(order).alias("rank"))


def enriched(contradictions: DataFrame, claims: DataFrame, sources: DataFrame) -> DataFrame:
    """Contradictions with the short form of both claims (the id alone where a claim is missing) and of their sources (null where missing)."""
    out = contradictions
    for n in ("a", "b"):
        c = claims.select(F.col("id").alias(f"claim_{n}_id"), *(F.col(x).alias(f"{n}_{x}") for x in ("subject", "predicate", "value", "source_id")))
        s = sources.select(F.col("id").alias(f"{n}_source_id"), F.col("name").alias(f"{n}_source_name"), F.col("type").alias(f"{n}_source_type"))
        out = out.join(c, f"claim_{n}_id", "left").join(s, f"{n}_source_id", "left")
    return out


def page(rows: DataFrame, equal: dict | None = None, least: dict | None = None, order: str = "created_at", limit: int | None = None, offset: int = 0) -> DataFrame:
    """Filtered, ordered (newest first, then id) and cut; all filters reach the scan."""
    for c, v in (equal or {}).items():
        rows = rows.where(F.col(c) == F.lit(v))
    for c, v in (least or {}).items():
        rows = rows.where(F.col(c) >= F.lit(v))
    rows = rows.orderBy(F.desc(order), "id").offset(offset)
    return rows if limit is None else rows.limit(limit)


def details(contradictions: DataFrame, claims: DataFrame, sources: DataFrame) -> DataFrame:
    """Contradictions with both claims and their sources (null where missing). A missing claim is an error when its row is read."""
    out = contradictions
    for n in ("a", "b"):
        c = claims.select(F.col("id").alias(f"claim_{n}_id"), F.struct("*").alias(f"claim_{n}"))
        s = sources.select(F.col("id").alias(f"sid_{n}"), F.struct("*").alias(f"source_{n}"))
        out = out.join(c, f"claim_{n}_id", "left")
        broken = F.raise_error(F.concat(F.lit("missing claim "), F.col(f"claim_{n}_id"))).cast(claims.select(F.struct("*")).schema[0].dataType)
        out = out.withColumn(f"claim_{n}", F.when(F.col(f"claim_{n}").isNull(), broken).otherwise(F.col(f"claim_{n}")))
        out = out.join(s, F.col(f"claim_{n}.source_id") == F.col(f"sid_{n}"), "left").drop(f"sid_{n}")
    return out


def snapshot(df: DataFrame, path: str) -> int:
    """A versioned copy with a check of its row count."""
    df.write.mode("errorifexists").parquet(path)
    n, there = df.count(), df.sparkSession.read.parquet(path).count()
    if n != there:
        raise OSError(f"snapshot at {path} has {there} of {n} rows")
    return n
