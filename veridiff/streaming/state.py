"""Keyed state over a stream of claims: the current value of each key, what it was before, and when it changed.

Keys are dealt to a fixed number of buckets; the state of a bucket is a table of its keys' current claims and one of their changes of the last while, in RocksDB. A bucket takes all of its
rows of a micro-batch at once, so that a micro-batch costs what its rows and the buckets that they fall into hold, whatever the length of the log.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CHANGES = "external_id string, change string, id string, value string, previous string, observed_at timestamp, first_seen_at timestamp, recent_changes int"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Of a stream, for its checkpoint's life: a bucket's state is rewritten when one of its keys has rows, and lies in memory then.
BUCKETS = 256

_NAMES = [c.split()[0] for c in CHANGES.split(", ")]
_ROWS = CHANGES.replace("timestamp", "long")
_CURRENT = pa.schema({"external_id": pa.string(), "id": pa.string(), "value": pa.string(), "observed_at": pa.int64(), "first_seen_at": pa.int64()})
_RECENT = pa.schema({"external_id": pa.string(), "at_ms": pa.int64(), "n": pa.int64()})


def _packed(rows: pd.DataFrame, schema: pa.Schema) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as out:
        out.write_table(pa.Table.from_pandas(rows, schema, preserve_index=False))
    return sink.getvalue().to_pybytes()


def _unpacked(body: bytes | None, schema: pa.Schema) -> pd.DataFrame:
    return (schema.empty_table() if body is None else pa.ipc.open_stream(bytes(body)).read_all()).to_pandas()


def take_in(rows: pd.DataFrame, current: pd.DataFrame, recent: dict[str, int]) -> tuple[pd.DataFrame, pd.DataFrame]:
    """(changes, current claims) of a bucket by its rows and current claims, times in microseconds; ``recent`` has the number of changes that each key had before.

    Rows of a key are taken by observed_at and id. ``created``: the first row. ``updated``: another value. ``seen``: the last of the rows, where it repeats the value.
    ``late``: observed before the current row; it is passed on and changes nothing.
    """
    rows = rows.assign(_id=rows["id"].fillna("")).sort_values(["external_id", "observed_at", "_id"], kind="stable")
    known = current.set_index("external_id").reindex(rows["external_id"])
    before = {c: known[c].to_numpy() for c in ("id", "value")}
    at, first_at = (known[c].fillna(0).astype("int64").to_numpy() for c in ("observed_at", "first_seen_at"))
    rows = rows.assign(is_known=known["observed_at"].notna().to_numpy(), before=before["value"], first_at=first_at, base=rows["external_id"].map(recent).fillna(0).astype("int64"))
    late = rows["is_known"].to_numpy() & ((rows["observed_at"].to_numpy() < at) | (rows["observed_at"].to_numpy() == at) & (rows["_id"].to_numpy() < pd.Series(before["id"], dtype=object).fillna("").to_numpy()))
    passed, on = rows[late], rows[~late]
    key = on["external_id"]
    first = (key != key.shift()).to_numpy()
    last = (key != key.shift(-1)).to_numpy()
    previous = on["value"].shift().where(~first, on["before"])
    same = ((on["value"] == previous) | on["value"].isna() & previous.isna()).to_numpy()
    created = first & ~on["is_known"].to_numpy()
    change = np.select([created, ~same], ["created", "updated"], "seen")
    on = on.assign(change=change, previous=previous.where(~created, None), first_seen_at=on["first_at"].where(on["is_known"], on.groupby("external_id")["observed_at"].transform("first")))
    on["recent_changes"] = on["base"] + (on["change"] == "updated").groupby(on["external_id"]).cumsum()
    passed = passed.assign(change="late", previous=passed["before"], first_seen_at=passed["first_at"], recent_changes=passed["base"])
    out = pd.concat([x[_NAMES] for x in (passed, on[(change != "seen") | last]) if len(x)] or [on.reindex(columns=_NAMES)])
    now = on.loc[last, _CURRENT.names]
    kept = current[~current["external_id"].isin(now["external_id"])]
    return out, pd.concat([x for x in (kept, now) if len(x)] or [now])


def without_empty_batches(spark: SparkSession) -> None:
    """State with a time to live or a time-out asks for batches without rows for ever, so that a run over what is there would not end: such batches are off, what has expired goes with the next rows."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    without_empty_batches(spark)


def claim_changes(claims: DataFrame, keep_days: int = 30, buckets: int = BUCKETS) -> DataFrame:
    """CHANGES of a stream of claims (external_id, id, value, observed_at); rows without a key or a time take no part.

    ``recent_changes`` counts the changes that were taken in during the last ``keep_days`` days, the row's own among them. The number of buckets stays for the life of a checkpoint.
    """
    keep_ms = keep_days * 86_400_000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else (None, None)
        now = state.getCurrentProcessingTimeMs()
        recent = _unpacked(held[1], _RECENT)
        recent = recent[recent["at_ms"] > now - keep_ms]
        out, current = take_in(pd.concat(list(batches)), _unpacked(held[0], _CURRENT), recent.groupby("external_id")["n"].sum().to_dict())
        added = out[out["change"] == "updated"].groupby("external_id").size()
        added = pd.DataFrame({"external_id": added.index, "at_ms": now, "n": added.to_numpy()})
        recent = pd.concat([x for x in (recent, added) if len(x)] or [recent])
        state.update((_packed(current, _CURRENT), _packed(recent, _RECENT)))
        yield out

    keep_state_in_rocksdb(claims.sparkSession)
    rows = claims.where("external_id IS NOT NULL AND observed_at IS NOT NULL").select(
        F.pmod(F.xxhash64("external_id"), F.lit(buckets)).cast("int").alias("bucket"), "external_id", "id", "value", F.unix_micros(F.col("observed_at").cast("timestamp")).alias("observed_at")
    )
    got = rows.groupBy("bucket").applyInPandasWithState(step, _ROWS, "current binary, recent binary", "append", GroupStateTimeout.NoTimeout)
    return got.withColumns({c: F.timestamp_micros(c) for c in ("observed_at", "first_seen_at")})


def current_rows(changes: DataFrame) -> DataFrame:
    """The current row of each key out of its changes, by partial aggregation."""
    on_time = changes.where("change <> 'late'")
    last = on_time.groupBy("external_id").agg(F.max_by(F.struct("id", "value", "observed_at", "first_seen_at"), F.struct("observed_at", "id")).alias("r"))
    return last.select("external_id", "r.*")
