"""MinHash near-dedup with fast similarity sketches, banding and exact verification.

Documents are sets of distinct five-word shingles (A-Z lowered; with fewer words the whole sequence is the one
shingle; without words the set is empty and linked with nothing). Two documents are linked when
100 * |intersection| >= 75 * |union|; a component is what links reach.

1. *Classes.* Documents with the same set form a class, named by its smallest doc_id; only classes go on, so a
   text that occurs a million times is sketched into buckets once.
2. *Sketch.* ``T`` coordinates filled by rounds of hashed bin placement: in round i < T every element goes into a
   hashed bin with value i + v, in round T + j every element goes into bin j. The smallest value of a bin counts, so rounds can
   stop as soon as all bins are filled, which the last T rounds guarantee. Two sets agree in a coordinate with
   probability equal to their similarity, and the number of agreements is concentrated around that mean.
3. *Bands* of ``ROWS`` coordinates. At similarity 0.75 a pair shares none of the 42 bands with probability 1e-10.
4. *Verification* on whole shingle sets, of pairs whose sketches allow the similarity (four bits of each coordinate; a pair at the
   threshold is told apart wrongly with probability 1e-10). In each bucket all classes are compared with one hub (the smallest), and
   linked classes are joined. Buckets that still hold more than one component are *contested*. For each of their members the *private*
   shingles, those of its own component alone, are counted exactly; members with more than a quarter of them can be linked to no other
   component and leave, until hardly any leave. Members a, b of different components can share at most o = min(n_a - p_a, n_b - p_b)
   shingles, so a pair with o / (n_a + n_b - o) < 0.75 is not linked. First all are compared with the member of the bucket that has the least private shingles;
   of the rest every pair is looked at where it first meets, and those that the counts and a finer sketch (one bit of ``FINE`` coordinates) cannot tell apart are
   verified. No bucket is capped, no task holds a whole bucket, and what is emitted are pairs about to be verified.
5. *Components* by minimum labels with pointer jumping, as joins; labels never leave the executors.

Defined cases. Null text and text without words: n_shingles 0, own component. Null doc_id: takes no part in any
link, component_id null, kept true. Repeated rows (same doc_id, same text) share a component and are returned each by :func:`components`, once by
:func:`deduplicate`; rows of one doc_id with different texts are told apart. An empty table gives an empty table. Extra
columns are ignored by :func:`components` and kept by :func:`deduplicate`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

T, ROWS, WORDS, PART = 128, 3, 5, 2_048
BUCKET_WORDS = 500_000
BANDS = T // ROWS
FINE = 2048
#: Pairs at similarity 0.75 differ in more coordinates than these (of 4 bits of T, of 1 bit of FINE) with probability 1e-10.
APART, FINE_APART = 66, 365
_NIBBLES = 0x1111111111111111
_SEEDS = C.mix(np.arange(1, 2 * FINE + 1, dtype=C.U64) * C.U64(0x9E3779B97F4A7C15))


def sketch(x: np.ndarray, t: int = T) -> np.ndarray:
    """The t (a power of two) coordinates of a non-empty set of 64-bit hashes."""
    bins = np.full(t, np.iinfo(np.uint64).max, C.U64)
    for i in range(2 * t):
        v = C.mix(x ^ _SEEDS[i])
        value = (v >> C.U64(16)) | (C.U64(i) << C.U64(48))
        if i < t:
            np.minimum.at(bins, (v & C.U64(t - 1)).astype(np.int64), value)
            if int(bins.max()) >> 48 <= i:
                break
        else:
            bins[i - t] = min(bins[i - t], value.min())
    return bins


def band_keys(bins: np.ndarray) -> np.ndarray:
    part = bins[: BANDS * ROWS].reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=C.U64)
    for j in range(ROWS):
        key = C.mix(key * C.U64(0x9E3779B97F4A7C15) + part[:, j])
    return key.view(np.int64)


def nibbles(bins: np.ndarray) -> np.ndarray:
    """Four bits of each coordinate, 16 coordinates to a number."""
    low = (C.mix(bins) & C.U64(15)).reshape(-1, 16) << (np.arange(16, dtype=C.U64) * C.U64(4))
    return np.bitwise_or.reduce(low, axis=1).view(np.int64)


def alike(a: Column, b: Column) -> Column:
    """Whether two rows' ``nibbles`` differ in at most ``APART`` of the ``T`` coordinates."""
    out = F.lit(0)
    for k in range(T // 16):
        z = F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))
        z = z.bitwiseOR(F.shiftrightunsigned(z, 1))
        z = z.bitwiseOR(F.shiftrightunsigned(z, 2))
        out = out + F.bit_count(z.bitwiseAND(F.lit(_NIBBLES)))
    return out <= APART


def fine_bits(x: np.ndarray) -> np.ndarray:
    """One bit of each coordinate of a sketch of ``FINE`` coordinates, 64 to a number."""
    return np.packbits((C.mix(sketch(x, FINE)) & C.U64(1)).astype(np.uint8)).view(np.int64)


def shingle_set(text: str | None, hashes: C.WordHashes, words: int = WORDS) -> np.ndarray:
    return C.shingles(hashes.of(text.encode().lower().split()), words) if isinstance(text, str) else np.zeros(0, C.U64)


def _sketched(docs: DataFrame, words: int) -> DataFrame:
    C.small_batches(docs.sparkSession)
    schema = "doc_id long, n_shingles long, set_a long, set_b long, bands binary, nibbles array<long>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = C.WordHashes()
        for batch in batches:
            for s in range(0, len(batch), 500):
                rows = []
                for i, t in zip(batch["doc_id"].iloc[s : s + 500], batch["text"].iloc[s : s + 500]):
                    x = shingle_set(t, hashes, words)
                    if len(x) and not pd.isna(i):
                        d, bins = xxhash.xxh3_128_intdigest(x.tobytes()), sketch(x)
                        rows.append((i, len(x), (d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63), band_keys(bins).tobytes(), nibbles(bins)))
                    else:
                        rows.append((i, len(x), None, None, None, None))
                out = pd.DataFrame(rows, columns=["doc_id", "n_shingles", "set_a", "set_b", "bands", "nibbles"], dtype=object)
                for c in ("doc_id", "n_shingles", "set_a", "set_b"):
                    out[c] = pd.array([None if pd.isna(v) else int(v) for v in out[c]], "Int64")
                yield out
                hashes.trim()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(C.tidy(run), schema)


def _buckets(classes: DataFrame) -> DataFrame:
    """(bucket, id) of each class, only of buckets with two or more."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in range(0, len(b), 2000):
                part = b.iloc[s : s + 2000]
                yield pd.DataFrame({"bucket": np.frombuffer(b"".join(map(bytes, part["bands"])), np.int64), "id": np.repeat(part["id"].to_numpy(), BANDS)})

    return classes.select("id", "bands").mapInPandas(C.tidy(run), "bucket long, id long")


def verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Those (a, b) of ``pairs`` whose whole shingle sets are similar enough. The partners of one ``a`` travel with its text in one row."""
    left = pairs.select("a", "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = C.WordHashes()
        last, hub = None, np.zeros(0, C.U64)
        for batch in batches:
            out = []
            for a, b, ta, tb in zip(batch["a"], batch["b"], batch["text_a"], batch["text_b"]):
                if b != last:
                    last, hub = b, shingle_set(tb, hashes, words)
                x = shingle_set(ta, hashes, words)
                if 100 * min(len(x), len(hub)) < percent * max(len(x), len(hub)):
                    continue
                both = len(np.intersect1d(x, hub, assume_unique=True))
                if both and 100 * both >= percent * (len(x) + len(hub) - both):
                    out.append((a, b))
            yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")
            hashes.trim()

    return both.select("a", "b", "text_a", "text_b").mapInPandas(C.tidy(run), "a long, b long")


def connect(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, label) of all nodes: label is the smallest id that the edges reach. Nodes that touch no edge are left out."""
    both = C.materialize(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct(), "links")
    labels = C.materialize(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("id"), F.least("u", "v").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        step = labels.join(near.withColumnRenamed("u", "id"), "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = step.join(labels.select(F.col("id").alias("label"), F.col("label").alias("further")), "label", "left")
        new = C.materialize(jump.select("id", "old", F.least("label", F.coalesce("further", "label")).alias("label")), "labels")
        done = new.where("label < old").isEmpty()
        C.release(labels)
        labels = new.select("id", "label")
        labels._shared_path = new._shared_path
        if done:
            C.release(both)
            return labels


def _private(texts: DataFrame, words: int) -> DataFrame:
    """Of a table (id, text, label): (id, n, p), the numbers of shingles and of those that no row of another label has.

    A block sends each of its shingles once, with its smallest and largest label, however many of its documents have it.
    """
    tagged = texts.select(F.col("id").alias("doc_id"), "text", F.col("label").alias("tag"))
    blocks = C.write_blocks(tagged, "contested-blocks", tagged=True)
    buckets = max(1, -(-(blocks.agg(F.sum("n_words")).first()[0] or 0) // BUCKET_WORDS))

    def sets(row, hashes) -> tuple[C.Block, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The block, each document's number of shingles, the distinct shingles, and of each occurrence its shingle and document."""
        block = C.Block(row)
        each = [C.shingles(hashes.of(t.lower().split()), words) for t in block.texts()]
        hashes.trim()
        n = np.array([len(x) for x in each], np.int64)
        flat, of = np.unique(np.concatenate(each) if each else np.zeros(0, C.U64), return_inverse=True)
        return block, n, flat, of, np.repeat(np.arange(len(n)), n)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = C.WordHashes()
        for batch in batches:
            for row in batch.itertuples(index=False):
                block, _, flat, of, doc = sets(row, hashes)
                span = np.empty((len(flat), 2), np.int64)
                span[:] = np.iinfo(np.int64).max, np.iinfo(np.int64).min
                np.minimum.at(span[:, 0], of, block.tags[doc])
                np.maximum.at(span[:, 1], of, block.tags[doc])
                yield C.frame([(b, block.id, 1, C.pack_sorted(flat[s:e]), C.pack(span[s:e].ravel())) for b, s, e in C.bucket_slices(flat, buckets)], C.REQUEST_SCHEMA)

    def judge(kind: int, inverse: np.ndarray, vals: np.ndarray, sizes: list[int]) -> Iterator[bytes]:
        span = vals.reshape(-1, 2)
        low, high = (np.full(inverse.max() + 1, x) for x in (np.iinfo(np.int64).max, np.iinfo(np.int64).min))
        np.minimum.at(low, inverse, span[:, 0])
        np.maximum.at(high, inverse, span[:, 1])
        alone, at = (low == high)[inverse], 0
        for n in sizes:
            yield C.pack(np.packbits(alone[at : at + n]).view(np.uint8))
            at += n

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = C.WordHashes()
        for batch in batches:
            for row in batch.itertuples(index=False):
                block, n, flat, of, doc = sets(row, hashes)
                got = {r["bucket"]: r["body"] for r in (row.replies if row.replies is not None else ())}
                alone = np.zeros(len(flat), np.bool_)
                for b, s, e in C.bucket_slices(flat, buckets):
                    alone[s:e] = np.unpackbits(C.unpack(got[b], np.uint8), count=e - s)
                yield pd.DataFrame({"id": block.doc_ids, "n": n, "p": np.bincount(doc, weights=alone[of], minlength=len(n)).astype(np.int64)})

    replies = C.materialize(C.exchange(blocks.mapInPandas(C.tidy(ask), C.REQUEST_SCHEMA), buckets, judge, np.int64), "contested-replies")
    out = C.materialize(C.with_replies(blocks, replies).mapInPandas(C.tidy(count), "id long, n long, p long"), "private-shingles")
    C.release(blocks)
    C.release(replies)
    return out


def _reachable(texts: DataFrame, meeting: DataFrame, words: int, percent: int) -> DataFrame:
    """(id, n, p) of the rows of ``meeting`` (id, label) that a row of another label can be similar to, by their private shingles.

    A row that goes takes its shingles along, so more of the others' may be private then: counted again while a tenth of the rows goes.
    """
    n = meeting.count()
    while True:
        stats = _private(texts.join(meeting, "id"), words)
        alive = C.materialize(stats.where(F.lit(100) * F.col("p") <= F.lit(100 - percent) * F.col("n")).join(meeting, "id").drop("label"), "reachable")
        C.release(stats)
        left = alive.count()
        if left == 0 or 10 * left > 9 * n:
            return alive
        n, meeting = left, meeting.join(alive.select("id"), "id", "left_semi")


def _fine(texts: DataFrame, words: int) -> DataFrame:
    """id and the ``fine_bits`` of a table (id, text), as bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = C.WordHashes()
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "fine": [fine_bits(shingle_set(t, hashes, words)).tobytes() for t in batch["text"]]})
            hashes.trim()

    return texts.select("id", "text").mapInPandas(C.tidy(run), "id long, fine binary")


def _unlinked(rest: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of a bucket with different labels that neither private shingles nor fine sketches rule out, each from the first bucket that it shares.

    A bucket is cut into parts of about ``PART`` members by a hash, and each two parts meet in one task: no task holds a whole bucket.
    """
    parts = rest.groupBy("bucket").agg(F.count("*").alias("size")).select("bucket", F.ceil(F.col("size") / PART).cast("int").alias("parts"))
    part = rest.join(parts, "bucket").withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    other = part.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = other.select("bucket", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "id", "label", "n", "p", "fine", "bands")
    tasks = C.shuffle_partitions(rest.sparkSession)
    rows = rows.repartition(tasks, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")

    def pairs(group: pd.DataFrame) -> pd.DataFrame:
        bucket, i, j = (int(group[c].iloc[0]) for c in ("bucket", "i", "j"))
        label, n, p, part, ids = (group[c].to_numpy() for c in ("label", "n", "p", "part", "id"))
        found = []
        if label.min() != label.max():
            fine = np.frombuffer(b"".join(map(bytes, group["fine"])), C.U64).reshape(len(group), -1)
            bands = np.frombuffer(b"".join(map(bytes, group["bands"])), np.int64).reshape(len(group), -1)
            for s in range(0, len(group), 256):
                at = np.arange(s, min(s + 256, len(group)))
                most = np.minimum((n - p)[at][:, None], (n - p)[None, :])
                may = (100 * most >= percent * (n[at][:, None] + n[None, :] - most)) & (label[at][:, None] != label[None, :])
                may &= (part[at][:, None] < part[None, :]) if i < j else (ids[at][:, None] < ids[None, :])
                x, y = np.nonzero(may)
                x = at[x]
                for t in range(0, len(x), 100_000):
                    u, v = x[t : t + 100_000], y[t : t + 100_000]
                    near = np.bitwise_count(fine[u] ^ fine[v]).sum(axis=1) <= FINE_APART
                    u, v = u[near], v[near]
                    first = (bands[u] == bands[v]).argmax(axis=1)
                    here = bands[u, first] == bucket
                    found.append((ids[u[here]], ids[v[here]]))
        a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*found) if found else ((), ())))
        return pd.DataFrame({"a": np.maximum(a, b), "b": np.minimum(a, b)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            key = batch[["bucket", "i", "j"]].to_numpy()
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            if held and (held[-1][["bucket", "i", "j"]].iloc[-1].to_numpy() != key[0]).any():
                yield pairs(pd.concat(held))
                held = []
            ends = [0, *cuts.tolist(), len(batch)]
            for s, e in zip(ends[:-1], ends[1:]):
                held.append(batch.iloc[s:e])
                if e < len(batch):
                    yield pairs(pd.concat(held) if len(held) > 1 else held[0])
                    held = []
        if held:
            yield pairs(pd.concat(held))

    return rows.mapInPandas(C.tidy(run), "a long, b long")


def links(sketched: DataFrame, docs: DataFrame, words: int = WORDS, percent: int = 75) -> tuple[DataFrame, DataFrame]:
    """(classes, labels) of a sketched table: all classes with their smallest id, and the labels of linked classes."""
    classes = C.materialize(sketched.where("set_a IS NOT NULL").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("id")), "classes")
    reps = sketched.where("set_a IS NOT NULL").select(F.col("doc_id").alias("id"), "set_a", "set_b", "bands", "nibbles").join(classes, ["id", "set_a", "set_b"], "left_semi")
    raw = C.materialize(_buckets(reps), "bands")
    shared = raw.groupBy("bucket").agg(F.min("id").alias("hub"), F.max("id").alias("top")).where("hub < top").select("bucket", "hub")
    members = C.materialize(raw.join(shared, "bucket"), "buckets")
    C.release(raw)
    touched = C.materialize(reps.select("id", "nibbles").join(members.select("id").distinct(), "id").dropDuplicates(["id"]), "touched")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(touched.select("id"), "id", "left_semi").dropDuplicates(["id"])
    texts = C.materialize(texts, "candidate-texts")

    def near(pairs: DataFrame, finer: bool = False) -> DataFrame:
        """Those distinct pairs whose sketches do not tell them apart, compared on their whole sets; ``finer`` sketches have been looked at before."""
        if finer:
            return C.materialize(verified(pairs.distinct(), texts, words, percent), "edges")
        one = lambda c: touched.select(F.col("id").alias(c), F.col("nibbles").alias(f"of_{c}"))
        some = pairs.distinct().join(one("a"), "a").join(one("b"), "b").where(alike(F.col("of_a"), F.col("of_b")))
        return C.materialize(verified(some.select("a", "b"), texts, words, percent), "edges")

    found = [near(members.where("id > hub").select(F.col("id").alias("a"), F.col("hub").alias("b")))]
    ids = touched.select("id")
    labels = connect(ids, found[0])
    label = F.coalesce("label", "id").alias("label")
    met = members.select("bucket", "id").join(labels, "id", "left").select("bucket", label)
    mixed = C.materialize(met.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("bucket"), "mixed")
    if not mixed.isEmpty():
        some = members.join(mixed, "bucket", "left_semi").select("id").distinct()
        meeting = C.materialize(some.join(labels, "id", "left").select("id", label), "meeting")
        alive = _reachable(texts, meeting, words, percent)
        known = alive.join(_fine(texts.join(alive.select("id"), "id", "left_semi"), words), "id").join(reps.select("id", "bands").dropDuplicates(["id"]), "id")
        rest = C.materialize(members.select("bucket", "id").join(known, "id").join(mixed, "bucket", "left_semi"), "reachable-buckets")

        def contested() -> DataFrame:
            """What is left with its labels, of the buckets that hold more than one."""
            now = rest.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
            several = now.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("bucket")
            return C.materialize(now.join(several, "bucket", "left_semi"), "contested")

        left = contested()
        best = left.groupBy("bucket").agg(F.min_by(F.struct("id", "label", "n", "p"), F.struct(F.col("p") / F.col("n"), "id")).alias("hub"))
        most = F.least(F.col("n") - F.col("p"), F.col("hub.n") - F.col("hub.p"))
        may = (F.col("label") != F.col("hub.label")) & (100 * most >= percent * (F.col("n") + F.col("hub.n") - most))
        hubs = left.select("bucket", "id", "label", "n", "p").join(best, "bucket").where(may).select(F.col("id").alias("a"), F.col("hub.id").alias("b"))
        for pairs, finer in ((lambda: hubs, False), (lambda: _unlinked(left, percent), True)):
            more = near(pairs(), finer)
            if not more.isEmpty():
                found.append(more)
                C.release(labels)
                labels = connect(ids, reduce(DataFrame.unionByName, found))
                C.release(left)
                left = contested()
        for x in (rest, alive, meeting, left):
            C.release(x)
    for x in (members, texts, touched, *found):
        C.release(x)
    return classes, labels


def _digest() -> Column:
    return F.coalesce(F.md5("text"), F.lit(""))


def _row_keys(docs: DataFrame) -> DataFrame | None:
    """None, or if some doc_id names two texts: (named, digest, key), keys in the order of doc_ids, so that the smallest key of a component has its smallest doc_id."""
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("named"), F.col("text"))
    many = rows.groupBy("named").count().where("count > 1").select("named")
    if many.isEmpty():
        return None
    if rows.join(many, "named", "left_semi").select("named", _digest()).distinct().groupBy("named").count().where("count > 1").isEmpty():
        return None
    each = rows.select("named", _digest().alias("digest")).distinct().orderBy("named", "digest")
    return C.materialize(each.withColumn("key", F.monotonically_increasing_id()), "row-keys")


def _keyed(docs: DataFrame, keys: DataFrame, old: str) -> DataFrame:
    """``docs`` with the row's key for its doc_id, which is kept under the name ``old``."""
    named, digest, key, own = C.fresh(docs, "named", "digest", "key", "own_digest")
    known = keys.toDF(named, digest, key)
    rows = docs.withColumn(own, _digest()).withColumnRenamed("doc_id", old)
    rows = rows.join(known, (rows[old] == known[named]) & (rows[own] == known[digest]), "left")
    return rows.withColumnRenamed(key, "doc_id").drop(own, named, digest)


def components(docs: DataFrame, words: int = WORDS, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (doc_id = component_id) for each row of ``docs``; rows of one doc_id with different texts are told apart."""
    if not 66 <= percent <= 100:
        raise ValueError("the banding is laid out for a similarity of at least two thirds")
    keys = _row_keys(docs)
    if keys is not None:
        found = components(_keyed(docs, keys, C.fresh(docs, "old_id")[0]), words, percent)
        name = lambda key, to: keys.select(F.col("key").alias(key), F.col("named").alias(to))
        found = found.withColumnsRenamed({"doc_id": "row", "component_id": "component"}).join(name("row", "doc_id"), "row", "left")
        return found.join(name("component", "component_id"), "component", "left").select("doc_id", "n_shingles", "component_id", "kept")
    sketched = C.materialize(_sketched(docs, words), "sketches")
    classes, labels = links(sketched, docs, words, percent)
    ids = classes.join(labels, "id", "left").select("set_a", "set_b", F.coalesce("label", "id").alias("component_id"))
    ids = C.materialize(ids, "components")
    C.release(classes)
    C.release(labels)
    out = sketched.drop("bands").join(ids, ["set_a", "set_b"], "left")
    component = F.coalesce("component_id", F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, words: int = WORDS, percent: int = 75) -> DataFrame:
    """The rows of ``docs`` that are kept: of each component the one with the smallest doc_id; of rows that repeat doc_id and text one."""
    keys = _row_keys(docs)
    if keys is not None:
        old = C.fresh(docs, "old_id")[0]
        return deduplicate(_keyed(docs, keys, old), words, percent).withColumn("doc_id", F.col(old)).select(docs.columns)
    found = C.materialize(components(docs, words, percent), "near-result")
    gone = C.fresh(docs, "gone_id")[0]
    leaves = C.materialize(found.where("NOT kept").select(F.col("doc_id").alias(gone)).distinct(), "duplicates")
    out = docs.join(leaves, F.col("doc_id") == F.col(gone), "left_anti")
    repeated = not found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty()
    C.release(found)
    if not repeated:
        return out
    return out.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).unionByName(out.where("doc_id IS NULL"))
