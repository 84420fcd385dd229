"""Streams against the batch operators: state, restarts, incremental discovery, rate limit, periodic runs."""

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from veridiff.operators import store
from veridiff.report_queries import query  # noqa: F401  registers its queries
from veridiff.queries import QUERIES
from veridiff.streaming import incremental, runner, state

LOG = "external_id string, id string, value string, observed_at timestamp"


def log(n, keys=6, seed=1):
    rng = random.Random(seed)
    start = datetime(2024, 1, 1)
    return [(f"k{rng.randrange(keys)}", f"i{i:04d}", rng.choice(["a", "b", None, "c"]), start + timedelta(minutes=i)) for i in range(n)]


def files(spark, folder, rows, schema, parts):
    """Each part as a file of its own, one after the other."""
    for k in range(parts):
        spark.createDataFrame(rows[k * len(rows) // parts : (k + 1) * len(rows) // parts], schema).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def changes(spark, folder, out, checkpoint):
    q = state.claim_changes(stream(spark, folder, LOG)).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(state.CHANGES).parquet(out)


def test_state_over_batches_and_a_restart(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    rows = log(90)
    files(spark, folder, rows[:60], LOG, 3)
    first = changes(spark, folder, out, checkpoint).collect()
    files(spark, folder, [*rows[60:], ("k0", "z", "old", datetime(2023, 1, 1)), (None, "n", "x", datetime(2024, 5, 1))], LOG, 2)
    got = changes(spark, folder, out, checkpoint)  # from the checkpoint
    assert len(first) < got.count()
    whole = spark.createDataFrame(rows, LOG)
    want = {(r.external_id, r.id, r.value) for r in store.value_changes(whole, ["external_id"]).collect()}
    assert {(r.external_id, r.id, r.value) for r in got.where("change IN ('created', 'updated')").collect()} == want
    assert [(r.id, r.value) for r in got.where("change = 'late'").collect()] == [("z", "old")]
    last = {(r.external_id, r.id, r.value) for r in state.current_rows(got).collect()}
    best = {}
    for k, i, v, t in rows:
        best[k] = max(best.get(k, (t, i, v)), (t, i, v), key=lambda x: x[:2])
    assert last == {(k, i, v) for k, (_, i, v) in best.items()}
    each = got.where("change = 'updated' AND external_id = 'k1'").orderBy("observed_at").collect()
    assert [r.recent_changes for r in each] == list(range(1, len(each) + 1))
    assert all(a.value == b.previous for a, b in zip(each, each[1:]))


def test_many_keys_in_few_buckets(spark, tmp_path):
    """Keys of a bucket are taken in together; rows of one time by id, nulls as values, rows behind the current one late."""
    t = datetime(2024, 1, 1)
    first = [("a", "2", None, t), ("a", "1", None, t), ("b", "1", "x", t), ("b", None, "y", t), ("c", "1", "x", datetime(1500, 1, 1))]
    second = [("a", "0", "z", t), ("a", "2", "x", t), ("a", "3", "x", t), ("b", "2", "x", t), ("c", "2", None, datetime(9000, 1, 1)), ("d", "1", "x", t), ("d", "2", "x", t)]
    folder, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    got = []
    for rows in (first, second):
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(folder)
        q = state.claim_changes(stream(spark, folder, LOG), buckets=2).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
        got = sorted(tuple(map(str, r)) for r in spark.read.schema(state.CHANGES).parquet(out).select("external_id", "change", "id", "value", "previous", F.date_format("first_seen_at", "yyyy"), "recent_changes").collect())
    want = [
        ("a", "created", "1", None, None, "2024", 0), ("a", "seen", "2", None, None, "2024", 0), ("a", "late", "0", "z", None, "2024", 0), ("a", "updated", "2", "x", None, "2024", 1),
        ("a", "seen", "3", "x", "x", "2024", 1), ("b", "created", None, "y", None, "2024", 0), ("b", "updated", "1", "x", "y", "2024", 1), ("b", "seen", "2", "x", "x", "2024", 1),
        ("c", "created", "1", "x", None, "1500", 0), ("c", "updated", "2", None, "x", "1500", 1), ("d", "created", "1", "x", None, "2024", 0), ("d", "seen", "2", "x", "x", "2024", 0),
    ]
    assert got == sorted(tuple(map(str, r)) for r in want)


@pytest.mark.parametrize("name", ["stream_changes", "stream_current"])
def test_stream_of_many_keys(spark, tmp_path, name):
    """20,000 keys in four micro-batches: no call to the state for each key and row."""
    events = spark.range(80_000).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(1_700_000_000 + F.col("id")).cast("timestamp_ntz").alias("ts"), (F.col("id") % 20_000).alias("user_id"), F.lit("view").alias("event_type"), (F.col("id") % 7).cast("double").alias("value"),
    )
    events.write.parquet(str(tmp_path / "events.parquet"))
    start = time.time()
    n = QUERIES[name](spark, str(tmp_path)).count()
    assert n == {"stream_changes": 80_000, "stream_current": 20_000}[name] and time.time() - start < 45


def test_rate_limit(spark, tmp_path):
    start = datetime(2024, 1, 1)
    hits = [("a", start + timedelta(seconds=s)) for s in (0, 1, 2, 3, 11, 12, 13)] + [("b", start)]
    files(spark, str(tmp_path / "in"), hits, "key string, ts timestamp", 2)
    limited = incremental.rate_limited(stream(spark, str(tmp_path / "in"), "key string, ts timestamp"), most=2, seconds=10)
    q = limited.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.key, (r.ts - start).seconds): r.allowed for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("a", 0): True, ("a", 1): True, ("a", 2): False, ("a", 3): False, ("a", 11): True, ("a", 12): True, ("a", 13): False, ("b", 0): True}


def test_periodic_runs_do_not_overlap(spark, tmp_path):
    seen = []

    def step(batch, number):
        begin = time.time()
        n = batch.count()
        time.sleep(0.6)
        seen.append((number, begin, time.time(), n))
        if number == 4:
            raise ValueError("enough")

    progress = runner.ProgressLog(spark, str(tmp_path / "progress"), {"ticks"}, hold=2)
    spark.streams.addListener(progress)
    try:
        source = spark.readStream.format("rate").option("rowsPerSecond", 50).load()
        q = runner.every(source, step, 0.3, str(tmp_path / "c"), "ticks")
        with pytest.raises(Exception, match="enough"):
            q.awaitTermination(60)
        time.sleep(2)
        rows = progress.table().orderBy("started_at").collect()
    finally:
        spark.streams.removeListener(progress)
    assert all(a[2] <= b[1] for a, b in zip(seen, seen[1:]))
    done = [r for r in rows if r.error is None]
    assert [r.batch for r in done] == [0, 1, 2, 3] and all(a.ended_at <= b.started_at + timedelta(milliseconds=1) for a, b in zip(done, done[1:]))
    assert [r.n_rows for r in done] == [n for _, _, _, n in seen[:4]] and sum("enough" in (r.error or "") for r in rows) == 1
