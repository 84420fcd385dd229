"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams (1 to 3 letters, lower case, words set off by one blank) of all labelled texts in 2**16
buckets per language. Each task adds up its own counts and sends one sparse row per language and range of buckets,
so the corpus is reduced map-side to at most languages * 65,536 numbers. The matrix of log-probabilities, 65,536
doubles for each language, is broadcast (``MAX_LANGUAGES`` bounds its size; more is an error, not a truncation). Scoring hashes a
batch of texts at once, counts their n-grams as sparse rows (text, bucket, times), and multiplies these with the matrix.
The number of languages is looked at before anything is counted.

Defined cases. Very long texts are scored whole, in overlapping pieces. A null text, or one without a letter: ``und`` with score 0. A null lang is not learned from. Nothing
to learn from: every text is ``und``. Ties go to the alphabetically first language. Empty tables give empty tables. Extra columns are
ignored by :func:`predict` and kept by :func:`keep_identified`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

BUCKETS = 1 << 16
GRAMS = (1, 2, 3)
ALPHA = 0.5
MAX_LANGUAGES = 512
CHUNK = 400_000


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.bool_, 0x110000)


def _codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text, each run of other characters than letters as one blank, a blank at each end; empty without a letter."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    keep = _letters()[c]
    if not keep.any():
        return np.zeros(0, np.uint32)
    c = np.concatenate(([32], np.where(keep, c, 32), [32])).astype(np.uint32)
    return c[~((c == 32) & (np.concatenate(([0], c[:-1])) == 32))]


def _grams(c: np.ndarray) -> Iterator[np.ndarray]:
    """Bucket of every n-gram of a sequence of code points, for each n."""
    c = c.astype(np.uint32)
    h = c * np.uint32(0x9E3779B1)
    for n in range(1, max(GRAMS) + 1):
        if n > 1:
            if len(c) < n:
                return
            h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + c[n - 1 :] * np.uint32(0xC2B2AE35)
        if n in GRAMS:
            x = h ^ (h >> np.uint32(16))
            yield ((x * np.uint32(0x27D4EB2F)) >> np.uint32(16)).astype(np.int64)


def held_out(column: str, mod: int, rest: int) -> Column:
    """crc32 of a column as text, modulo ``mod``, equals ``rest``; false for null."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % mod == rest, F.lit(False))


def train(labelled: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log priors, log-probabilities by bucket and language) from all rows with a text and a language."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[str, np.ndarray] = {}
        n_docs: dict[str, int] = {}
        for batch in batches:
            for t, lang in zip(batch["text"], batch["lang"]):
                acc = totals.setdefault(lang, np.zeros(BUCKETS, np.int64))
                n_docs[lang] = n_docs.get(lang, 0) + 1
                c = _codes(t)
                for s in range(0, len(c), CHUNK):  # n-grams across the ends of a chunk are counted once, with the earlier one
                    for n, g in zip(GRAMS, _grams(c[s : s + CHUNK + max(GRAMS) - 1])):
                        acc += np.bincount(g[: min(CHUNK, len(c) - s)], minlength=BUCKETS)
        yield pd.DataFrame([(k, n_docs[k], C.pack(v)) for k, v in totals.items()], columns=["lang", "docs", "counts"])

    def add(key, pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(BUCKETS, np.int64)
        for b in pdf["counts"]:
            total += C.unpack(b, np.int64)
        return pd.DataFrame([(key[0], int(pdf["docs"].sum()), C.pack(total))], columns=["lang", "docs", "counts"])

    C.small_batches(labelled.sparkSession)
    schema = "lang string, docs long, counts binary"
    if labelled.where(F.col(text).isNotNull()).select(lang).distinct().limit(MAX_LANGUAGES + 2).count() > MAX_LANGUAGES + 1:  # null may be one of them
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    parts = rows.mapInPandas(C.tidy(count), schema)
    # two steps: sums of up to 64 tasks, then of these, so no task gathers more than a bounded share
    some = parts.withColumn("part", F.pmod(F.hash("counts"), F.lit(64))).groupBy("lang", "part").applyInPandas(add, schema)
    got = some.groupBy("lang").applyInPandas(add, schema).orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(got) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    counts = np.stack([C.unpack(r.counts, np.int64) for r in got], axis=1).astype(float) if got else np.zeros((BUCKETS, 0))
    docs = np.array([r.docs for r in got], float)
    logp = np.log(counts + ALPHA) - np.log(counts.sum(axis=0) + ALPHA * BUCKETS)
    return [r.lang for r in got], np.log(docs / max(docs.sum(), 1)), logp


def _pieces(texts: list) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The letters of texts in batches of about ``CHUNK``: code points, the text of each, and whether an n-gram may start there.

    A text longer than that comes in pieces that overlap, so that each n-gram starts in one of them.
    """
    held: list[tuple[np.ndarray, int, int]] = []
    size = 0
    for i, t in enumerate(texts):
        c = _codes(t) if isinstance(t, str) else np.zeros(0, np.uint32)
        for s in range(0, len(c), CHUNK):
            part = c[s : s + CHUNK + max(GRAMS) - 1]
            held.append((part, i, min(CHUNK, len(c) - s)))
            size += len(part)
            if size >= CHUNK:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[tuple[np.ndarray, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lens = np.array([len(c) for c, _, _ in held])
    place = np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)
    left = np.repeat(lens, lens) - place  # code points of the piece from here on
    left[place >= np.repeat([n for _, _, n in held], lens)] = 0
    return np.concatenate([c for c, _, _ in held]), np.repeat([i for _, i, _ in held], lens), left


def sparse_counts(texts: list) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sparse rows of the matrix texts x buckets in batches: text, bucket and how often it occurs. A text longer than a batch has rows in several."""
    for codes, of, left in _pieces(texts):
        keys = []
        for n, g in zip(GRAMS, _grams(codes)):
            fits = left[: len(g)] >= n
            keys.append(of[: len(g)][fits] * BUCKETS + g[fits])
        key, times = np.unique(np.concatenate(keys), return_counts=True)
        yield key // BUCKETS, key % BUCKETS, times


def score_texts(texts: list, langs: list[str], prior: np.ndarray, logp: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Best language and its posterior probability for each text: the sparse counts of a batch times the matrix, a language at a time."""
    pred, score = ["und"] * len(texts), np.zeros(len(texts))
    if not langs:
        return pred, score
    total = np.tile(prior, (len(texts), 1))
    some = np.zeros(len(texts), np.bool_)
    for row, bucket, times in sparse_counts(texts):
        some[row] = True
        for k in range(len(langs)):
            total[:, k] += np.bincount(row, weights=times * logp[bucket, k], minlength=len(texts))
    for i in np.flatnonzero(some).tolist():
        best = int(total[i].argmax())
        pred[i] = langs[best]
        score[i] = 1.0 / np.exp(total[i] - total[i, best]).sum()
    return pred, score


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of each row with ``lang_pred`` and ``score``; only the text is scored."""
    spark = docs.sparkSession
    C.small_batches(spark)
    sent = spark.sparkContext.broadcast(model)
    rows = docs.select(*keep, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("text").schema) + ", lang_pred string, score double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        langs, prior, logp = sent.value
        for batch in batches:
            pred, score = score_texts(list(batch["text"]), langs, prior, logp)
            yield batch.drop(columns="text").assign(lang_pred=pred, score=score)

    return rows.mapInPandas(C.tidy(run), schema)


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Rows of ``docs`` with a recognised language (score at least ``least``), learned from their own labels outside the held-out quarter."""
    model = train(docs.where(~held_out("doc_id", 4, 2)))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def known(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        C.let_go(__name__)
        try:
            for text in texts:
                pred, score = score_texts(list(text), *sent.value)
                yield pd.Series([p != "und" and s >= least for p, s in zip(pred, score)], dtype=bool)
        finally:
            C.give_back()

    return docs.where(known("text"))
