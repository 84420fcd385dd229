"""Synchronisation of sources as set operations: extracted claims in, upserted tables and a summary per source out.

Every step takes any number of sources at once. A source that could not be fetched is a row of ``failed``; the others are not held up by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import discover
from . import store


def upsert_sources(current: DataFrame, staged: DataFrame) -> DataFrame:
    """Full outer join by external_id with ``change``: created, updated or kept. An update takes over name, uri, fetch time and metadata; id, trust and creation stay.

    A staged source without external_id is always a new one.
    """
    cols = current.columns
    old, new = (df.select(F.col("external_id").alias("key"), F.struct(*cols).alias(n)) for df, n in ((current, "old"), (staged, "new")))
    j = old.join(new, "key", "full")
    taken = ("name", "uri", "last_fetched_at", "metadata", "updated_at")
    pick = lambda c: F.when(F.col("new").isNull() | F.col("old").isNotNull() & F.lit(c not in taken), F.col("old")[c]).otherwise(F.coalesce(F.col("new")[c], F.col("old")[c]))
    change = F.when(F.col("new").isNull(), "kept").when(F.col("old").isNull(), "created").otherwise("updated")
    return j.select(*(pick(c).alias(c) for c in cols), change.alias("change"))


def warnings(sources: DataFrame, claims: DataFrame) -> DataFrame:
    """(source_id, warning): sources (id, name) without any claim, and claims whose value is suspiciously short (single digits, y and n are not)."""
    short = claims.where((F.length("value") < 2) & ~F.lower("value").isin("y", "n") & ~F.col("value").rlike("^[0-9]$"))
    texts = short.select("source_id", F.format_string("Claim '%s' extracted with suspiciously short value: '%s'", "predicate", "value").alias("warning"))
    none = sources.join(claims.select(F.col("source_id").alias("id")), "id", "left_anti")
    empty = "No factual claims could be extracted from source '%s'. Check document formatting, headings, or key-value structures."
    return none.select(F.col("id").alias("source_id"), F.format_string(empty, "name").alias("warning")).unionByName(texts)


def summaries(sources: DataFrame, upserted: DataFrame, staged: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """A row per synchronised source: claims extracted, created and updated, warnings, and conflicts that its touched claims take part in."""
    moved = upserted.groupBy(F.col("source_id").alias("id")).agg(F.count_if(F.col("change") == "created").alias("claims_created"), F.count_if(F.col("change") == "updated").alias("claims_updated"))
    read = staged.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("claims_extracted"))
    warned = warnings(sources, staged).groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("extraction_warnings"))
    out = sources.select("id").join(read, "id", "left").join(moved, "id", "left").join(warned, "id", "left")
    if found is not None:
        touched = upserted.where("change IN ('created', 'updated')").select(F.col("id").alias("claim"), "source_id")
        sides = found.select("pair_key", F.explode(F.array("a_id", "b_id")).alias("claim")).join(touched, "claim").select("pair_key", "source_id").distinct()
        out = out.join(sides.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("contradictions_found")), "id", "left")
    return out.na.fill(0)


def batch_totals(summary: DataFrame, failed: DataFrame) -> DataFrame:
    """One row: sources requested, succeeded and failed, and the sums over those that succeeded."""
    totals = summary.agg(F.count("*").alias("sources_succeeded"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("claims_created", "claims_updated", "contradictions_found")))
    both = totals.crossJoin(failed.agg(F.count("*").alias("sources_failed")))  # one row with one row
    return both.withColumn("sources_requested", F.col("sources_succeeded") + F.col("sources_failed"))


def sync(sources: DataFrame, claims: DataFrame, staged_sources: DataFrame, staged: DataFrame, trust: DataFrame | None = None, least: float = 0.35) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(sources, claims, conflicts of touched claims, summary per source) after staged sources and claims have been taken in."""
    kept = upsert_sources(sources, staged_sources)
    upserted = store.upsert_claims(claims, staged)
    current = upserted.drop("change", "superseded")
    touched = upserted.where("change IN ('created', 'updated')").drop("change", "superseded")
    found = discover.scan_claims(touched, current, trust, least)
    names = staged_sources.select("external_id").join(kept.select("external_id", "id", "name"), "external_id")
    return kept, current, found, summaries(names, upserted, staged, found)


def operation_metrics(log: DataFrame) -> DataFrame:
    """Counters by tool, and over all tools under a null one: calls, syncs that succeeded and failed, scans, claims taken in, conflicts found, errors.

    ``log`` has (tool, kind, success, claims_created, contradictions, message) with kind ``call``, ``sync``, ``scan`` or ``error``.
    """
    kind, ok = F.col("kind"), F.coalesce("success", F.lit(False))
    return log.rollup("tool").agg(
        F.count_if(kind == "call").alias("calls"), F.count_if(kind == "sync").alias("syncs"), F.count_if((kind == "sync") & ok).alias("successful_syncs"),
        F.count_if((kind == "sync") & ~ok).alias("failed_syncs"), F.count_if(kind == "scan").alias("scans"),
        F.coalesce(F.sum(F.when((kind == "sync") & ok, F.col("claims_created"))), F.lit(0)).alias("claims_ingested"),
        F.coalesce(F.sum(F.when((kind == "sync") & ok | (kind == "scan"), F.col("contradictions"))), F.lit(0)).alias("contradictions_detected"),
        F.count_if(kind == "error").alias("errors"),
    )


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows) of each table, in one job."""
    parts = [df.agg(F.lit(name).alias("table_name"), F.count("*").alias("n_rows")) for name, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
