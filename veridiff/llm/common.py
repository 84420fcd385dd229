"""Shared building blocks of the training-data operators: shared storage, blocks of whole documents,
word hashing and packed key exchange.

The heavy operators do not shuffle one row per word. They cut the documents into *blocks* (whole documents,
bounded text), work on each block with numpy, and exchange packed arrays of sorted 64-bit keys: one row holds the
keys that one block sends to one range of the key space. A key that is frequent everywhere therefore costs one
entry per block, not one per occurrence, and no reducer sees more than its share of the key space.
"""

from __future__ import annotations

import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
BLOCK_CHARS = 4_000_000
BLOCK_SCHEMA = "block long, n_words long, doc_ids binary, nulls binary, tags binary, lens binary, body binary"
REQUEST_SCHEMA = "bucket int, block long, kind int, keys binary, vals binary"
REPLY_SCHEMA = "block long, kind int, bucket int, body binary"


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that all executors share (``spark.checkpoint.dir``); sets one only where unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not got.isDefined():
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="veridiff-"))
            got = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = got.get()
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python in batches of bounded bytes: texts are long, and a worker has a few hundred MB. A session's own settings stay."""
    for key, usual, ours in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"), ("spark.sql.execution.arrow.maxBytesPerBatch", None, "8388608")):
        if spark.conf.get(key, usual) in (usual, "-1", "2147483647", "9223372036854775807"):
            spark.conf.set(key, ours)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back, so that a lost executor costs no recomputation.

    What no caller releases before goes when the driver ends.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete a table that :func:`materialize` wrote, once nothing lazy reads it any more."""
    path = getattr(df, "_shared_path", None)
    if path:
        spark = df.sparkSession
        jvm = spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """For each name one like it that no column of ``df`` has, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: What modules keep in a worker from task to task: a function that lets go of it, and the modules whose tasks use it.
HELD: list[tuple[Callable, frozenset[str]]] = []


def let_go(user: str) -> None:
    """Workers live on from stage to stage; a task drops what other modules' tasks have left."""
    for forget, users in HELD:
        if user not in users:
            forget()


def tidy(run: Callable) -> Callable:
    """A function for ``mapInPandas`` that gives freed memory back to the system when a task ends: workers live on, and what the
    allocators would keep of one stage counts against the next one's memory."""

    @functools.wraps(run)
    def bounded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go(run.__module__)
        try:
            yield from run(batches)
        finally:
            give_back()

    return bounded


def give_back() -> None:
    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --- packed arrays -------------------------------------------------------------------------------------------


def pack(a: np.ndarray) -> bytes:
    """Byte planes of an integer array under zstandard; high planes of similar values all but vanish."""
    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(b: bytes, dtype) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(bytes(b))
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(dtype).reshape(-1)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted unsigned keys as differences."""
    return pack(np.diff(keys, prepend=U64(0)))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b, U64), dtype=U64)


# --- hashing -------------------------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x9E3779B97F4A7C15)
    x = x ^ (x >> U64(29))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


class WordHashes(dict):
    """word bytes -> 64-bit hash, remembered; ``trim`` keeps the memory bounded between batches."""

    def __init__(self, seed: int = 0) -> None:
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word, self.seed)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U64, len(words))

    def trim(self, most: int = 250_000) -> None:
        if len(self) > most:
            self.clear()


_BASES = (0x5851F42D4C957F2D, 0xC6A4A7935BD1E995)
_INVERSES = [pow(b, -1, 1 << 64) for b in _BASES]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out, dtype=U64)


def window_hashes(h: np.ndarray, k: int, base: int = 0) -> np.ndarray:
    """Hash of every run of k consecutive word hashes, from prefix sums of a polynomial modulo 2**64; ``base`` chooses one of two polynomials."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    total = np.zeros(len(h) + 1, U64)
    np.cumsum(h * _powers(_BASES[base], len(h)), out=total[1:])
    return mix((total[k:] - total[:-k]) * _powers(_INVERSES[base], n) + U64(k))


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; with fewer words the whole sequence is the only one."""
    if not len(h):
        return np.zeros(0, U64)
    return np.unique(window_hashes(h, min(k, len(h))))


# --- blocks of documents -------------------------------------------------------------------------------------


def write_blocks(docs: DataFrame, label: str, block_chars: int = BLOCK_CHARS, tagged: bool = False) -> DataFrame:
    """Materialize (doc_id, text) as blocks of whole documents with about ``block_chars`` characters each.

    Later passes see the same blocks whatever the scheduler does. Null texts stay null, null ids get a flag. With ``tagged``,
    a column ``tag`` of integers goes with the ids.
    """

    small_batches(docs.sparkSession)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        base, seq = TaskContext.get().partitionId() << 32, 0
        ids: list[int] = []
        null: list[bool] = []
        tags: list[int] = []
        body: list[bytes] = []
        lens: list[int] = []
        held = 0

        def flush():
            nonlocal seq, held
            raw = b"".join(body)
            row = pd.DataFrame({
                "block": [base + seq], "n_words": [sum(len(x.split()) for x in body)], "doc_ids": [np.array(ids, np.int64).tobytes()],
                "nulls": [np.array(null, np.bool_).tobytes()], "tags": [np.array(tags, np.int64).tobytes()], "lens": [np.array(lens, np.int64).tobytes()],
                "body": [zstandard.ZstdCompressor(level=3).compress(raw)],
            })
            seq, held = seq + 1, 0
            for x in (ids, null, tags, body, lens):
                x.clear()
            return row

        for batch in batches:
            for i, t, tag in zip(batch["doc_id"], batch["text"], batch["tag"]):
                tags.append(int(tag))
                ids.append(0 if pd.isna(i) else int(i))
                null.append(bool(pd.isna(i)))
                raw = t.encode() if isinstance(t, str) else b""
                lens.append(len(raw) if isinstance(t, str) else -1)
                body.append(raw)
                held += len(raw) + 64
                if held >= block_chars:
                    yield flush()
        if ids:
            yield flush()

    tag = F.col("tag") if tagged else F.lit(0)
    return materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", tag.cast("long").alias("tag")).mapInPandas(tidy(cut), BLOCK_SCHEMA), label)


class Block:
    """One row of the table of :func:`write_blocks`."""

    def __init__(self, row) -> None:
        self.id = int(row.block)
        self.doc_ids = np.frombuffer(bytes(row.doc_ids), np.int64)
        self.null_ids = np.frombuffer(bytes(row.nulls), np.bool_)
        self.tags = np.frombuffer(bytes(row.tags), np.int64)
        lens = np.frombuffer(bytes(row.lens), np.int64)
        self.null_text = lens < 0
        self._ends = np.cumsum(np.maximum(lens, 0))
        self._raw = zstandard.ZstdDecompressor().decompress(bytes(row.body))

    def texts(self) -> Iterator[bytes]:
        start = 0
        for end in self._ends.tolist():
            yield self._raw[start:end]
            start = end

    def words(self, lower: bool = False) -> tuple[list[bytes], np.ndarray]:
        """All words in order, and each document's number of them; bytes.split() parts at ASCII white space only."""
        out: list[bytes] = []
        counts = np.zeros(len(self.doc_ids), np.int64)
        for i, t in enumerate(self.texts()):
            w = (t.lower() if lower else t).split()
            counts[i] = len(w)
            out += w
        return out, counts


def n_buckets(spark: SparkSession, records: int, per_bucket: int = 1_000_000) -> int:
    return int(max(shuffle_partitions(spark), -(-records // per_bucket), 1))


def bucket_slices(keys: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, start, end) of sorted keys; bucket b holds one range of the key space."""
    if not len(keys):
        return []
    b = ((keys >> U64(32)) * U64(buckets)) >> U64(32)
    cuts = np.flatnonzero(np.diff(b)) + 1
    starts = np.concatenate(([0], cuts))
    ends = np.concatenate((cuts, [len(keys)]))
    return [(int(b[s]), int(s), int(e)) for s, e in zip(starts, ends)]


def requests(block: int, kind: int, keys: np.ndarray, vals: np.ndarray, buckets: int) -> Iterator[tuple]:
    """Rows of REQUEST_SCHEMA for sorted distinct keys with one value each."""
    for b, s, e in bucket_slices(keys, buckets):
        yield b, block, kind, pack_sorted(keys[s:e]), pack(vals[s:e])


def frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(",")])


def exchange(asked: DataFrame, buckets: int, reduce: Callable, dtype) -> DataFrame:
    """Bring the packed keys of one bucket together and answer each block.

    ``reduce(groups, keys, vals, owner)`` gets, for one (bucket, kind), the inverse index of every record's distinct
    key, all keys, values and the record's row number, and returns an array of one answer (bytes) per row.
    """

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for kind, part in pdf.groupby("kind"):
            ks = [unpack_sorted(x) for x in part["keys"]]
            vs = [unpack(x, dtype) for x in part["vals"]]
            sizes = [len(k) for k in ks]
            _, inverse = np.unique(np.concatenate(ks), return_inverse=True)
            for block, body in zip(part["block"], reduce(int(kind), inverse, np.concatenate(vs), sizes)):
                if body is not None:
                    out.append((block, int(kind), key[0], body))
        return frame(out, REPLY_SCHEMA)

    return asked.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(run, REPLY_SCHEMA)


def with_replies(blocks: DataFrame, replies: DataFrame) -> DataFrame:
    """Each block with the list of its replies, by bucket; blocks without any have null."""
    got = replies.groupBy("block").agg(F.collect_list(F.struct("kind", "bucket", "body")).alias("replies"))
    return blocks.join(got, "block", "left")
