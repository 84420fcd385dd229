"""LM scoring with a weighted backoff automaton.

The model is an n-gram model with hierarchical smoothing. Base: p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)). With a context h
of k words, p(w | h) = (c(h w) + K p(w | h')) / (c(h) + K), where h' is h without its first word. Every n-gram of fewer than ``order`` words that
training has seen is a state of the automaton; its arcs carry p for each word seen after it and lead to the longest suffix that is a state. Where no arc fits,
its *failure arc* with the weight K / (c(h) + K) leads to the state of h', in the end to the root, which has an arc for every word.
A text is read once from left to right: the state carried along is the longest seen suffix of at most ``order - 1`` words, and each token adds the
logarithms of the weights of the failure arcs taken and of the arc that fits. One end token follows each text and ends its context.

Scale. The n-grams of all texts do not fit on one machine, but those of a block of documents do. Each block sends its
distinct n-grams with its own training counts, packed and by ranges of their hashes; each range is summed; and a block gets back, for its own
n-grams, what the other blocks have counted. One- and two-word n-grams go first; a longer one is sent only if both n-grams within it that are one word shorter occur in other blocks too, for
else it occurs in none of them. With that a block holds exactly the part of the global automaton that its texts
can visit. It is walked by all texts at once, token by token; long texts are read in segments of ``SEGMENT`` tokens, each begun ``order - 1`` tokens early, which is
all that a state can remember. Counts cover all training documents; nothing is pruned. N-grams are told apart by 64-bit hashes: of 10**13 n-grams
one in two million shares its hash with another one, which adds up their counts.

Defined cases. Very long texts are scored whole. Null text: as empty (the end token alone). Null doc_id: a training document with null id in the result. No training
document: N is 0 and every token has the base of an empty model. Repeated rows count as often as they occur. An empty table
gives an empty table. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

ORDER = 3
K = 5.0
SEGMENT = 512
STATS = -1
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_END = C.U64(xxhash.xxh64_intdigest(b" end"))


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


class _Grams:
    """The n-grams of a block: per order the distinct keys, their counts in training texts, and each position's key."""

    def __init__(self, block: C.Block, order: int, held_out: Callable) -> None:
        self.block = block
        vocab: dict[bytes, int] = defaultdict()
        vocab.default_factory = vocab.__len__
        look = vocab.__getitem__
        look(b" ")  # id 0 is the end token: no word is white space
        ids: list[int] = []
        self.n_tokens = np.zeros(len(block.doc_ids), np.int64)
        for i, text in enumerate(block.texts()):
            before = len(ids)
            ids += map(look, text.lower().split())
            ids.append(0)
            self.n_tokens[i] = len(ids) - before
        word = np.fromiter((xxhash.xxh64_intdigest(w) for w in vocab), C.U64, len(vocab))
        word[0] = _END
        del vocab
        self.held = np.array([held_out(None if z else int(d)) for d, z in zip(block.doc_ids, block.null_ids)], np.bool_)
        tok = word[np.array(ids, np.int32)] if ids else np.zeros(0, C.U64)
        del ids, word
        self.first = np.cumsum(self.n_tokens) - self.n_tokens
        place = (np.arange(len(tok)) - np.repeat(self.first, self.n_tokens)).astype(np.int32)
        train = np.repeat(~self.held, self.n_tokens)
        self.keys, self.local, self.key_of, self.has = [], [], [], []
        gram = tok
        for n in range(1, order + 1):
            if n > 1:
                gram = np.concatenate((gram[:1], C.mix(gram[:-1] * C.U64(0x9E3779B97F4A7C15) + tok[1:] + C.U64(n)))) if len(tok) else tok
            has = place >= n - 1
            keys, inverse = np.unique(gram[has], return_inverse=True)
            key_of = np.zeros(len(tok), np.int32)
            key_of[has] = inverse
            self.keys.append(keys)
            self.local.append(np.bincount(inverse, weights=train[has], minlength=len(keys)).astype(np.int64))
            self.key_of.append(key_of)
            self.has.append(has)


def _sum(kind: int, inverse: np.ndarray, counts: np.ndarray, sizes: list[int]):
    """Answer of a bucket: for each n-gram twice what all other blocks have counted, and one more where another block holds it at all."""
    total = np.bincount(inverse, weights=counts).astype(np.int64)
    more = 2 * (total[inverse] - counts) + (np.bincount(inverse)[inverse] > 1)
    at = 0
    for n in sizes:
        part = more[at : at + n]
        at += n
        yield C.pack(part) if part.any() else None


def _reducer(key, pdf: pd.DataFrame) -> pd.DataFrame:
    out = []
    for kind, part in pdf.groupby("kind"):
        ks = [C.unpack_sorted(x) for x in part["keys"]]
        vs = np.concatenate([C.unpack(x, np.int64) for x in part["vals"]])
        distinct, inverse = np.unique(np.concatenate(ks), return_inverse=True)
        for block, body in zip(part["block"], _sum(int(kind), inverse, vs, [len(k) for k in ks])):
            if body is not None:
                out.append((int(block), int(kind), key[0], body))
        if kind == 1:
            total = np.bincount(inverse, weights=vs)
            out.append((STATS, 0, key[0], np.array([total.sum(), (total > 0).sum()], np.int64).tobytes()))
    return C.frame(out, C.REPLY_SCHEMA)


class Automaton:
    """The states and arcs that the texts of one block can visit; ``counts`` has the global count of each of its n-grams, by order.

    A state of n words is named by n and the number of its n-gram, the root by 0 words. An arc that leaves a state of n words is named by the
    n-gram of n + 1 words that it completes; which one fits at a position of the block is the n-gram that ends there.
    """

    def __init__(self, g: _Grams, counts: list[np.ndarray], n_all: int, n_distinct: int, k: float) -> None:
        self.g, self.order = g, len(counts)
        c = counts[0].astype(float)
        p = (c + 0.5) / (n_all + 0.5 * (n_distinct + 1))
        self.base = np.log10(p)
        self.known = [x > 0 for x in counts]
        #: by number of words of the state left: weights of arcs and of failure arcs, states that failure leads to, the arc at each position or -1
        self.weight, self.failure, self.suffix, self.arc = [self.base], [np.zeros(1)], [np.zeros(1, np.int32)], [g.key_of[0]]
        for n in range(1, self.order):
            at = np.zeros(len(counts[n]), np.int64)  # a position where each n-gram ends
            here = np.flatnonzero(g.has[n])
            at[g.key_of[n][here]] = here
            context, shorter = g.key_of[n - 1][at - 1], g.key_of[n - 1][at]
            seen = counts[n - 1][context].astype(float)
            p = (counts[n] + k * p[shorter]) / (seen + k)
            self.weight.append(np.log10(p))
            self.failure.append(np.log10(k / (counts[n - 1] + k)))
            self.suffix.append(self._shorter(n))
            self.arc.append(np.where(g.has[n] & self.known[n][g.key_of[n]], g.key_of[n], -1) if len(counts[n]) else np.full(len(g.has[n]), -1, np.int32))

    def _shorter(self, n: int) -> np.ndarray:
        """The state of n - 1 words that ends each state of n words."""
        out = np.zeros(len(self.g.keys[n - 1]), np.int32)
        if n > 1:
            here = np.flatnonzero(self.g.has[n - 1])
            out[self.g.key_of[n - 1][here]] = self.g.key_of[n - 2][here]
        return out

    def walk(self) -> np.ndarray:
        """The weight that each token of the block adds."""
        g, early = self.g, self.order - 1
        out = np.zeros(len(g.key_of[0]))
        parts = -(-g.n_tokens // SEGMENT)
        doc = np.repeat(np.arange(len(parts)), parts)
        start = (np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)) * SEGMENT
        warm = np.where(start > 0, early, 0)
        size = np.minimum(g.n_tokens[doc] - start, SEGMENT) + warm
        at = g.first[doc] + start - warm
        lanes = np.argsort(-size, kind="stable")
        at, warm, size = at[lanes], warm[lanes], size[lanes]
        words, state = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)  # all lanes begin at the root
        for t in range(int(size[0]) if len(size) else 0):
            n_live = int(np.searchsorted(-size, -t, "left"))  # lanes with more than t tokens come first
            i = at[:n_live] + t
            words, state = words[:n_live], state[:n_live]
            gain, open_ = np.zeros(n_live), np.ones(n_live, np.bool_)
            new_words, new_state = np.zeros(n_live, np.int64), np.zeros(n_live, np.int64)
            for n in range(early, -1, -1):
                here = np.flatnonzero(open_ & (words == n))
                if not len(here):
                    continue
                arc = self.arc[n][i[here]]
                fits = arc >= 0
                go, arc = here[fits], arc[fits]
                gain[go] += self.weight[n][arc]
                open_[go] = False
                if n < early:  # the completed n-gram is a state, but for words that training has not seen
                    is_state = self.known[n][arc]
                    new_words[go], new_state[go] = np.where(is_state, n + 1, 0), np.where(is_state, arc, 0)
                elif n:  # a state has at most order - 1 words: the n-gram of as many that ends here
                    new_words[go], new_state[go] = n, self.g.key_of[n - 1][i[go]]
                back = here[~fits]
                if len(back):
                    gain[back] += self.failure[n][state[back]]
                    state[back] = self.suffix[n][state[back]]
                    words[back] = n - 1
            told = warm[:n_live] <= t
            out[i[told]] = gain[told]
            words, state = new_words, new_state
        return out


def automaton_scores(g: _Grams, counts: list[np.ndarray], n_all: int, n_distinct: int, k: float) -> tuple[np.ndarray, np.ndarray]:
    """log10 weights of the base and of the automaton for each position of a block."""
    a = Automaton(g, counts, n_all, n_distinct, k)
    return a.base[g.key_of[0]], a.walk()


class _Elsewhere:
    """What other blocks have counted of a block's n-grams, from its replies; n is one less than the number of words."""

    def __init__(self, g: _Grams, row, buckets: int) -> None:
        replies = getattr(row, "replies", None)
        self.g, self.buckets, self._known = g, buckets, {}
        self._got = {(r["kind"], r["bucket"]): r["body"] for r in (replies if replies is not None else ())}

    def asked(self, n: int) -> np.ndarray:
        """Numbers of the n-grams that are asked for: no other block can hold the others."""
        if n < 2:
            return np.arange(len(self.g.keys[n]))
        here = np.flatnonzero(self.g.has[n])
        shorter, of = (self._replies(n - 1) & 1) > 0, self.g.key_of[n - 1]
        worth = np.zeros(len(self.g.keys[n]), np.bool_)
        worth[self.g.key_of[n][here]] = shorter[of[here]] & shorter[of[here - 1]]
        return np.flatnonzero(worth)

    def counts(self, n: int) -> np.ndarray:
        return self._replies(n) >> 1

    def _replies(self, n: int) -> np.ndarray:
        if n not in self._known:
            some = self.asked(n)
            keys, out = self.g.keys[n][some], np.zeros(len(self.g.keys[n]), np.int64)
            for b, s, e in C.bucket_slices(keys, self.buckets):
                if (n + 1, b) in self._got:
                    out[some[s:e]] = C.unpack(self._got[n + 1, b], np.int64)
            self._known[n] = out
        return self._known[n]


def score(docs: DataFrame, order: int = ORDER, k: float = K, held_out: Callable = is_held_out) -> DataFrame:
    """RESULT for each row of ``docs``; ``held_out(doc_id)`` tells which documents training must not see."""
    if order < 1:
        raise ValueError("order must be at least 1")
    spark = docs.sparkSession
    blocks = C.write_blocks(docs, "lm-blocks")
    total = blocks.agg(F.sum("n_words")).first()[0] or 0
    buckets = C.n_buckets(spark, 2 * total)
    replies: list[DataFrame] = []

    def blockwise(make) -> Callable:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for row in batch.itertuples(index=False):
                    yield from make(row)

        return C.tidy(run)

    for orders in (range(min(order, 2)), *([n] for n in range(2, order))):

        def ask(row, orders=tuple(orders)) -> Iterator[pd.DataFrame]:
            g = _Grams(C.Block(row), orders[-1] + 1, held_out)
            elsewhere = _Elsewhere(g, row, buckets)
            for n in orders:
                some = elsewhere.asked(n)
                yield C.frame(list(C.requests(g.block.id, n + 1, g.keys[n][some], g.local[n][some], buckets)), C.REQUEST_SCHEMA)

        asking = C.with_replies(blocks, reduce(DataFrame.unionByName, replies).where(f"block <> {STATS}")) if replies else blocks
        asked = asking.mapInPandas(blockwise(ask), C.REQUEST_SCHEMA).repartition(buckets, "bucket")
        replies.append(C.materialize(asked.groupBy("bucket").applyInPandas(_reducer, C.REPLY_SCHEMA), f"lm-counts-{orders[-1] + 1}"))

    def numbers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            both = [np.frombuffer(bytes(b), np.int64) for b in batch["body"]]
            yield pd.DataFrame({"tokens": [int(x[0]) for x in both], "words": [int(x[1]) for x in both]}, dtype="int64")

    sums = replies[0].where(f"block = {STATS}").select("body").mapInPandas(numbers, "tokens long, words long").agg(F.sum("tokens"), F.sum("words")).first()
    n_all, n_distinct = (int(x or 0) for x in sums)

    def walk(row) -> Iterator[pd.DataFrame]:
        g = _Grams(C.Block(row), order, held_out)
        elsewhere = _Elsewhere(g, row, buckets)
        counts = [g.local[n] + elsewhere.counts(n) for n in range(order)]
        base, model = automaton_scores(g, counts, n_all, n_distinct, k)
        known = (counts[0][g.key_of[0]] > 0).astype(np.int64)
        sums = [np.add.reduceat(x, g.first) for x in (known, base, model)]
        yield pd.DataFrame({
            "doc_id": pd.array([None if z else int(d) for d, z in zip(g.block.doc_ids, g.block.null_ids)], "Int64"), "held_out": g.held,
            "n_tokens": g.n_tokens, "n_known": sums[0], "train_tokens": n_all, "base_score": sums[1], "score": sums[2],
        })

    known = reduce(DataFrame.unionByName, replies).where(f"block <> {STATS}")
    return C.with_replies(blocks, known).mapInPandas(blockwise(walk), RESULT)
