"""Incremental upsert and discovery on a stream of staged claims, and a rate limit with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import schemas
from ..operators import store
from ..operators.index import BlockIndex
from ..operators.versioned import KeyedTable
from ..plans import discover
from .state import without_empty_batches

FOUND = "pair_key string, claim_a_id string, claim_b_id string, contradiction_type string, severity string, confidence double"


class Store:
    """Claims by external_id, the index of their facts, and the conflicts found: three keyed tables under one path."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        none = spark.createDataFrame([], schemas.CLAIMS)
        self.spark = spark
        self.claims, self.found = KeyedTable(spark, f"{path}/claims"), KeyedTable(spark, f"{path}/found")
        if not self.claims.versions():
            KeyedTable.create(spark, f"{path}/found", spark.createDataFrame([], FOUND), ["pair_key"], buckets=buckets)
            BlockIndex.create(spark, f"{path}/index", none, buckets)
            KeyedTable.create(spark, f"{path}/claims", none, ["external_id"], buckets=buckets)  # last: with it the store is there
        self.index = BlockIndex(spark, f"{path}/index")

    def take_in(self, staged: DataFrame, trust: DataFrame | None = None, least: float = 0.35) -> None:
        """Upsert staged claims, and store the conflicts of those that are new or changed with all claims, unless they are stored already.

        Only the buckets of the staged keys, of their facts' blocks and of the claims that these find are read. The claims are committed last: a call that
        is broken off and made again finds the same claims changed, and whatever it writes twice is there once.
        """
        staged = staged.persist()
        try:
            known = self.claims.look_up(staged.select("external_id"))
            upserted = store.upsert_claims(known, staged)
            touched = upserted.where("change IN ('created', 'updated')").drop("superseded").persist()
            fresh = touched.drop("change")
            if not fresh.isEmpty():
                self.index.add(fresh)
                pairs = self.index.probe(fresh).persist()
                new = pairs.join(self.found.look_up(pairs.select("pair_key")).select("pair_key"), "pair_key", "left_anti").persist()
                if not new.isEmpty():
                    keys = self.index.keys_of(new.select(F.explode(F.array("a_id", "b_id")).alias("id")).distinct())
                    there = self.claims.look_up(keys.select("external_id")).join(fresh.select("external_id"), "external_id", "left_anti")
                    rows = discover.scan_pairs(new, there.unionByName(fresh), trust, least)
                    self.found.upsert(rows.select("pair_key", F.col("a_id").alias("claim_a_id"), F.col("b_id").alias("claim_b_id"), "contradiction_type", "severity", "confidence"))
                new.unpersist()
                pairs.unpersist()
                self.claims.upsert(fresh)
            touched.unpersist()
        finally:
            staged.unpersist()


def run(staged: DataFrame, path: str, checkpoint: str, least: float = 0.35, compact_every: int = 16, buckets: int = 64) -> StreamingQuery:
    """Take each micro-batch into the :class:`Store` under ``path``; what is there so far is worked on, then the query ends."""

    def step(batch: DataFrame, number: int) -> None:
        kept = Store(batch.sparkSession, path, buckets)
        kept.take_in(batch, None, least)
        if number % compact_every == compact_every - 1:
            kept.index.compact()
            kept.claims.compact()
            kept.found.compact()

    return staged.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rate_limited(hits: DataFrame, most: int = 60, seconds: int = 60) -> DataFrame:
    """(key, ts, allowed): a hit is rejected when ``most`` allowed ones lie in the window before it; rejected hits do not count.

    Keeps at most ``most`` times per key, and drops a key's state when its window has passed.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = list(state.get[0]) if state.exists else []
        for batch in batches:
            ok = []
            for t in (batch := batch.sort_values("ts"))["ts"]:
                now = t.value // 1000
                kept = [x for x in kept if x > now - seconds * 1_000_000]
                ok.append(len(kept) < most)
                if ok[-1]:
                    kept.append(now)
            yield batch.assign(key=key[0], allowed=ok)[["key", "ts", "allowed"]]
        state.update((kept,))
        state.setTimeoutDuration(seconds * 1000)

    without_empty_batches(hits.sparkSession)
    return hits.groupBy("key").applyInPandasWithState(step, "key string, ts timestamp, allowed boolean", "kept array<long>", "append", GroupStateTimeout.ProcessingTimeTimeout)
