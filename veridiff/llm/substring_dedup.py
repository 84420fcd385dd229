"""Substring dedup by level-wise doubling.

A window is ``window`` consecutive words of one document. A word is removed when a window that covers it has the
same word sequence as a window of a document with a smaller doc_id.

Levels. The first level looks at runs of a quarter of the window (13 words for 50), each further one at twice the length (26, then 50, the window).
Not every run has to be sent: in each window the run with the smallest hash stands for it, and since the choice depends on the words alone, equal
windows are stood for by equal runs at equal places. A run that starts in one document only cannot lie in a repeated
window. So only windows repeated at one length are extended to twice that length, and what no level has ruled out is compared whole.
Longer repeats need no level of their own, for each of them is covered by repeated windows.

Runs are compared by 64-bit hashes, which can only let a window live on to the next level. Whole windows are compared by 128 bits, two
independent polynomials over two independent hashes of each word: among 10**13 windows a false match has a probability below 10**-12. For each distinct run a block sends the
smallest doc_id it knows and gets one bit back, whether a smaller one exists elsewhere; a passage that
half of all documents share is one entry per block.

Defined cases. Very long texts are taken whole, each in a block of its own where need be. Null text: no words, nothing removed, ``text`` stays null. Null doc_id: the row is kept whole and never
makes others lose words. Rows with the same doc_id are one document for the comparison, each returned. Documents shorter than the
window keep everything. An empty table gives an empty table. Extra columns are ignored by :func:`substring_dedup`
and kept by :func:`removed_repeats`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

WINDOW = 50
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _starts(counts: np.ndarray, ok: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the block's words at which a run of k words of one usable document starts, and its document."""
    doc = np.repeat(np.arange(len(counts)), np.where(ok, np.maximum(counts - k + 1, 0), 0))
    first = np.cumsum(counts) - counts
    fits = np.where(ok, np.maximum(counts - k + 1, 0), 0)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(fits) - fits, fits) + first[doc]
    return at, doc


def _anchors(runs: np.ndarray, starts: np.ndarray, span: int) -> np.ndarray:
    """For each window start the place of the smallest of the ``span`` run hashes from there, the leftmost of equals."""
    if not len(starts):
        return starts
    low, at, width = runs, np.arange(len(runs)), 1
    while width * 2 <= span:  # a sparse table: the minimum over 2 * width from two of width
        a, b = low[:-width], low[width:]
        take = b < a
        low, at, width = np.where(take, b, a), np.where(take, at[width:], at[:-width]), width * 2
    other = starts + span - width
    return np.where(low[other] < low[starts], at[other], at[starts])


class _Plan:
    """Hashes and windows of one block; windows are named by their number in the block."""

    def __init__(self, block: C.Block, hashes: tuple[C.WordHashes, C.WordHashes], window: int) -> None:
        self.block, self.window, self._second = block, window, hashes[1]
        self.words, self.counts = block.words()
        self._h = hashes[0].of(self.words)
        for x in hashes:
            x.trim()
        self.starts, self.doc = _starts(self.counts, ~block.null_ids, window)

    def docs(self, which: np.ndarray) -> np.ndarray:
        return self.block.doc_ids[self.doc[which]]

    def runs(self, which: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The runs of ``length`` words that stand for these windows (in order): their hashes and documents, and of each window its run."""
        if not len(which):
            return np.zeros(0, C.U64), np.zeros(0, np.int64), which
        h = C.window_hashes(self._h, length)
        at = _anchors(h, self.starts[which], self.window - length + 1)
        new = np.concatenate(([True], at[1:] != at[:-1]))  # the place of the leftmost smallest hash never moves back as the window moves on
        return C.mix(h[at[new]] ^ C.U64(length)), self.docs(which[new]), np.cumsum(new) - 1

    def whole(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes of these windows, from two hashes of each word."""
        if not len(which):
            return np.zeros(0, C.U64), np.zeros(0, C.U64)
        start = self.starts[which]
        edge = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(edge, start, 1)
        np.add.at(edge, start + self.window, -1)
        inside = np.flatnonzero(np.cumsum(edge[:-1]))
        other = np.zeros(len(self.words), C.U64)
        other[inside] = self._second.of([self.words[k] for k in inside.tolist()])
        return C.window_hashes(self._h, self.window)[start], C.window_hashes(other, self.window, 1)[start]


def _smallest(keys: np.ndarray, docs: np.ndarray, other: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys, the smallest and the largest document of each, each record's key, and the second halves of the keys."""
    if other is None:
        distinct, inverse = np.unique(keys, return_inverse=True)
        least, most = np.full(len(distinct), np.iinfo(np.int64).max), np.full(len(distinct), np.iinfo(np.int64).min)
        np.minimum.at(least, inverse, docs)
        np.maximum.at(most, inverse, docs)
        return distinct, least, most, inverse, np.zeros(len(distinct), C.U64)
    order = np.lexsort((other, keys))
    k, o = keys[order], other[order]
    new = np.concatenate(([True], (k[1:] != k[:-1]) | (o[1:] != o[:-1]))) if len(k) else np.zeros(0, np.bool_)
    inverse = np.empty(len(k), np.int64)
    inverse[order] = np.cumsum(new) - 1
    least, most = np.full(new.sum(), np.iinfo(np.int64).max), np.full(new.sum(), np.iinfo(np.int64).min)
    np.minimum.at(least, inverse, docs)
    np.maximum.at(most, inverse, docs)
    return k[new], least, most, inverse, o[new]


def _flags(kind: int, inverse: np.ndarray, vals: np.ndarray, sizes: list[int]):
    """Answer of a bucket: bit 1, whether a smaller document than the asked one has the key; bit 2, whether a larger one."""
    docs, other = vals.reshape(-1, 2).T
    _, low, high, inverse, _ = _smallest(inverse, docs, other)
    flag = (low[inverse] < docs).astype(np.uint8) | ((high[inverse] > docs).astype(np.uint8) << 1)
    at = 0
    for n in sizes:
        part = flag[at : at + n]
        at += n
        yield C.pack(part) if part.any() else None


def _requests(block: int, kind: int, keys: np.ndarray, least: np.ndarray, other: np.ndarray, buckets: int) -> list[tuple]:
    vals = np.stack([least, other.view(np.int64)], axis=1)
    return [(b, block, kind, C.pack_sorted(keys[s:e]), C.pack(vals[s:e].ravel())) for b, s, e in C.bucket_slices(keys, buckets)]


def _answers(row, kind: int, keys: np.ndarray, buckets: int) -> np.ndarray:
    replies = getattr(row, "replies", None)
    got = {r["bucket"]: r["body"] for r in (replies if replies is not None else ()) if r["kind"] == kind}
    out = np.zeros(len(keys), np.uint8)
    for b, s, e in C.bucket_slices(keys, buckets):
        if b in got:
            out[s:e] = C.unpack(got[b], np.uint8)
    return out


def levels(window: int) -> list[int]:
    """Lengths of the runs that are compared: doubled from a quarter of the window, the last one is the window."""
    out = [-(-window // 4)]
    while out[-1] < window:
        out.append(min(2 * out[-1], window))
    return out


def _survivors(plan: _Plan, row, asked: list[tuple[int, int]]) -> np.ndarray:
    """Windows whose runs of all lengths asked for so far, (length, buckets), start in two documents or more."""
    which = np.arange(len(plan.starts))
    for length, buckets in asked:
        h, docs, of = plan.runs(which, length)
        keys, least, most, inverse, _ = _smallest(h, docs)
        alive = (_answers(row, length, keys, buckets) > 0) | (most > least)
        which = which[alive[inverse][of]] if len(h) else which
    return which


def _blockwise(make):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = C.WordHashes(), C.WordHashes(1)
        for batch in batches:
            for row in batch.itertuples(index=False):
                yield from make(row, hashes)

    return C.tidy(run)


def removed_words(docs: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """Per document its numbers of words and removed words and the digest of what is kept; ``with_text`` adds the kept text.

    The kept text is null for a null text, the input text itself where nothing goes, else the kept words joined by one space.
    """
    if window < 2:
        raise ValueError("window must be at least 2")
    spark = docs.sparkSession
    blocks = C.write_blocks(docs, "substring-blocks")
    total = blocks.agg(F.sum("n_words")).first()[0] or 0
    asked: list[tuple[int, int]] = []
    replies: list[DataFrame] = []
    for length in levels(window)[:-1]:
        buckets = C.n_buckets(spark, total // 8)

        def ask(row, hashes, length=length, buckets=buckets, before=tuple(asked)):
            plan = _Plan(C.Block(row), hashes, window)
            which = _survivors(plan, row, before)
            h, docs_of, _ = plan.runs(which, length)
            keys, least, _, _, other = _smallest(h, docs_of)
            yield C.frame(_requests(plan.block.id, length, keys, least, other, buckets), C.REQUEST_SCHEMA)

        asking = C.with_replies(blocks, reduce(DataFrame.unionByName, replies)) if replies else blocks
        replies.append(C.materialize(C.exchange(asking.mapInPandas(_blockwise(ask), C.REQUEST_SCHEMA), buckets, _flags, np.int64), f"substring-{length}"))
        asked.append((length, buckets))
    last = C.n_buckets(spark, total // 2)

    def compare(row, hashes):
        plan = _Plan(C.Block(row), hashes, window)
        which = _survivors(plan, row, asked)
        h, second = plan.whole(which)
        keys, least, _, _, other = _smallest(h, plan.docs(which), second)
        yield C.frame(_requests(plan.block.id, window, keys, least, other, last), C.REQUEST_SCHEMA)

    asking = C.with_replies(blocks, reduce(DataFrame.unionByName, replies))
    replies.append(C.materialize(C.exchange(asking.mapInPandas(_blockwise(compare), C.REQUEST_SCHEMA), last, _flags, np.int64), "substring-whole"))

    def result(row, hashes):
        plan = _Plan(C.Block(row), hashes, window)
        which = _survivors(plan, row, asked)
        h, second = plan.whole(which)
        doc_ids = plan.docs(which)
        keys, least, _, inverse, _ = _smallest(h, doc_ids, second)
        gone = ((_answers(row, window, keys, last) & 1) > 0)[inverse] | (doc_ids > least[inverse]) if len(keys) else np.zeros(0, bool)
        edge = np.zeros(len(plan.words) + 1, np.int64)
        np.add.at(edge, plan.starts[which][gone], 1)
        np.add.at(edge, plan.starts[which][gone] + window, -1)
        covered = np.cumsum(edge[:-1]) > 0
        out, at = [], 0
        for i, (n, text) in enumerate(zip(plan.counts.tolist(), plan.block.texts())):
            words, mask = plan.words[at : at + n], covered[at : at + n]
            removed = int(mask.sum())
            kept = b" ".join(words if not removed else [w for w, m in zip(words, mask) if not m])
            line = (None if plan.block.null_ids[i] else int(plan.block.doc_ids[i]), n, removed, hashlib.sha256(kept).hexdigest())
            if with_text:
                line = (*line, None if plan.block.null_text[i] else (kept if removed else text).decode(), hashlib.md5(text).hexdigest())
            out.append(line)
            at += n
        for s in range(0, len(out), 2000):
            part = pd.DataFrame(out[s : s + 2000], columns=[*[c.split()[0] for c in RESULT.split(", ")], *["text", "text_md5"] * with_text])
            part["doc_id"] = part["doc_id"].astype("Int64")
            yield part

    asking = C.with_replies(blocks, reduce(DataFrame.unionByName, replies))
    return asking.mapInPandas(_blockwise(result), RESULT + ", text string, text_md5 string" * with_text)


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    return removed_words(docs, window)


def removed_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The table of documents with repeated passages cut out of ``text`` (``n_chars`` follows); documents of which nothing is left go."""
    at, digest, kept = C.fresh(docs, "cut_id", "cut_md5", "cut_text")
    cut = removed_words(docs, window, with_text=True).where("n_removed > 0").select(F.col("doc_id").alias(at), F.col("text_md5").alias(digest), F.col("text").alias(kept))
    changed = C.materialize(cut.dropDuplicates([at, digest]), "substring-changed")
    out = docs.join(changed, (F.col("doc_id") == F.col(at)) & (F.md5(docs["text"]) == F.col(digest)), "left").where(F.col(at).isNull() | (F.length(kept) > 0))
    text = F.coalesce(F.col(kept), docs["text"])
    cols = [text.alias(c) if c == "text" else F.length(text).cast("long").alias(c) if c == "n_chars" else docs[c] for c in docs.columns]
    return out.select(*cols)
