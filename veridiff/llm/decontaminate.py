"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

An item leaks into a document when the document has at least ``percent`` of the item's distinct five-word shingles
(A-Z lowered). An item with fewer words is one shingle, its whole sequence, which leaks wherever it stands in a document; for that documents are
looked at in windows of the lengths that such items have.

A document may be a thousand times longer than an item, so their similarity says nothing; containment has to be
searched per size of the item. Items are partitioned by their number of shingles, q, in powers of two. Within a
partition the sketch of an item is its bottom-m MinHash with m = q - ceil(percent * q) + 1 for its own size: a
document that contains enough of the item must contain one of any m of its shingles, hence of these m, so each
sketch value is a band of one row and the search has no false negatives. A document is scanned once; its
shingle hashes are looked up in the union of the sketches, a partition at a time, through a bitmap and a sorted array. Hits are verified on
the whole sets.

The sketch is sent to the executors behind a check of its size: items are dealt to as many parts as keep each
part under ``part_shingles`` shingles (16 bytes each), and each part is one scan. An item larger than a part is a part by itself.

Defined cases. Null or wordless texts on either side leak nothing. Null item_id or doc_id: the row takes no part in
the pairs (a document with null doc_id always stays). Repeated items or documents give one pair; several texts of one item_id are one item with the shingles of all. Empty tables give no pair. Extra columns are
ignored by :func:`leaks` and kept by :func:`decontaminate`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .near_dedup import WORDS

PAIRS = "doc_id long, item_id long, shared long, n_item_shingles long"
PART_SHINGLES = 2_000_000
_BITS = 20


def needed(q: int, percent: int) -> int:
    return -(-percent * q // 100)


class Sketches:
    """The items of one part: size partitions with sorted sketch values, and the whole sets for verification."""

    def __init__(self, items: list[tuple[int, np.ndarray]], percent: int) -> None:
        self.items = items
        self.percent = percent
        self.parts = []
        by_size: dict[int, list[int]] = {}
        for k, (_, x) in enumerate(items):
            by_size.setdefault(len(x).bit_length(), []).append(k)
        for _, ks in sorted(by_size.items()):
            vals, owner = [], []
            for k in ks:
                x = items[k][1]
                m = len(x) - needed(len(x), percent) + 1
                vals.append(np.sort(C.mix(x))[:m])
                owner.append(np.full(m, k))
            v, o = np.concatenate(vals), np.concatenate(owner)
            order = np.argsort(v, kind="stable")
            bitmap = np.zeros(1 << _BITS, np.bool_)
            bitmap[(v >> C.U64(64 - _BITS)).astype(np.int64)] = True
            self.parts.append((bitmap, v[order], o[order]))

    def search(self, x: np.ndarray) -> list[tuple[int, int, int]]:
        """(item_id, shared, item's size) of each item that leaks into a document with the sorted shingles x."""
        out = []
        low = C.mix(x)
        top = (low >> C.U64(64 - _BITS)).astype(np.int64)
        for bitmap, values, owner in self.parts:
            near = low[bitmap[top]]
            if not len(near):
                continue
            a, b = np.searchsorted(values, near, "left"), np.searchsorted(values, near, "right")
            for k in sorted({int(owner[j]) for s, e in zip(a, b) for j in range(s, e)}):
                item, y = self.items[k]
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                shared = int((x[at] == y).sum())
                if shared >= needed(len(y), self.percent):
                    out.append((item, shared, len(y)))
        return out


def _item_parts(benchmark: DataFrame, words: int, part_shingles: int) -> Iterator[tuple[list[tuple[int, np.ndarray]], list[int]]]:
    """The items in parts of bounded size, with the lengths of their short texts. Executors hash them, the driver holds one part at a time."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = C.WordHashes()
        for batch in batches:
            h = [hashes.of(t.encode().lower().split()) for t in batch["text"]]
            yield pd.DataFrame({"item_id": batch["item_id"], "n_words": [min(len(x), words) for x in h], "keys": [C.pack_sorted(C.shingles(x, words)) if len(x) else b"" for x in h]})
            hashes.trim()

    rows = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text").dropDuplicates()
    sets = rows.mapInPandas(C.tidy(hashed), "item_id long, n_words int, keys binary").where("n_words > 0").orderBy("item_id")
    held: list[tuple[int, np.ndarray]] = []
    short: set[int] = set()
    size, last = 0, None
    for item, n, keys in sets.toLocalIterator():
        x = C.unpack_sorted(keys)
        if item == last:
            size -= len(held[-1][1])
            x = np.union1d(held.pop()[1], x)
        elif held and size + len(x) > part_shingles:
            yield held, sorted(short)
            held, short, size = [], set(), 0
        held.append((item, x))
        size, last = size + len(x), item
        if n < words:
            short.add(n)
    if held:
        yield held, sorted(short)


def leaks(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, percent: int = 75, part_shingles: int = PART_SHINGLES) -> DataFrame:
    """(doc_id, item_id, shared, n_item_shingles): every leak of every item into every document."""
    spark = docs.sparkSession
    C.small_batches(spark)
    source = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = spark.createDataFrame([], PAIRS)
    for part, short in _item_parts(benchmark, words, part_shingles):
        ids = np.array([i for i, _ in part], np.int64)
        sets = spark.sparkContext.broadcast((ids, np.cumsum([len(x) for _, x in part]), np.concatenate([x for _, x in part])))

        def scan(batches: Iterator[pd.DataFrame], sets=sets, short=short) -> Iterator[pd.DataFrame]:
            ids, ends, flat = sets.value
            sketches = Sketches([(int(i), x) for i, x in zip(ids, np.split(flat, ends[:-1]))], percent)
            hashes = C.WordHashes()
            for batch in batches:
                found = []
                for i, t in zip(batch["doc_id"], batch["text"]):
                    h = hashes.of(t.encode().lower().split())
                    x = C.shingles(h, words)
                    if short and len(h) >= short[0]:
                        x = np.unique(np.concatenate([x, *(C.window_hashes(h, k) for k in short if k <= len(h))]))
                    if len(x):
                        found += [(int(i), *hit) for hit in sketches.search(x)]
                hashes.trim()
                yield pd.DataFrame(found, columns=["doc_id", "item_id", "shared", "n_item_shingles"]).astype("int64")

        out = out.unionByName(source.mapInPandas(C.tidy(scan), PAIRS))
    return out.dropDuplicates(["doc_id", "item_id"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, percent: int = 75) -> DataFrame:
    """The rows of ``docs`` into which no item leaks."""
    leak = C.fresh(docs, "leak_id")[0]
    gone = C.materialize(leaks(docs, benchmark, words, percent).select(F.col("doc_id").alias(leak)).distinct(), "leaks")
    return docs.join(gone, F.col("doc_id") == F.col(leak), "left_anti")
