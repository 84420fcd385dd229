"""SentencePiece (byte-pair kind) encoding with seeded merge-dropout, and lossless decoding.

A text gets one leading blank, blanks become U+2581, and pieces merge by their score, best first, leftmost of
equals. The agenda holds all adjacent pairs that form a piece. When a merge is taken from it, a keyed hash of (seed,
variant, chunk, place, piece) decides whether it is skipped; a skipped merge is dropped for good unless a neighbour's merge forms
the pair anew. Characters without a piece, and any U+2581 of the text itself, become byte pieces, so every segmentation
decodes to the text exactly, whatever the dropout.

No piece of the vocabulary spans from another character to a blank, nor holds a line feed (checked when the model is
loaded), so texts are encoded by chunks: a run of blanks with what follows it up to the next blank. The variant of each
chunk is a keyed hash of (seed, doc_id, place of the chunk), so each occurrence of a word is cut by itself, and anew with each seed. Remembered are
the merges of a chunk without dropout and what they give: an occurrence that skips none of them is that; any other one runs its own agenda.

Defined cases. Null text: ids null and null decoded. Empty text: no ids, decoded empty. Null doc_id: hashed as -1. Repeated rows give equal
ids. Empty tables give empty tables. Extra columns are ignored. The vocabulary file is a parameter; it is read on each executor.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import count

import numpy as np
import pandas as pd
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

BLANK = "▁"
DROPOUT, SEED = 0.1, 20240229
GROUP_CHARS, LONG, MEMORY = 1_000_000, 48, 400_000
_NEVER = np.int32(2**31 - 1)
_TABLE = 1 << 20


def _slot(key: np.ndarray) -> np.ndarray:
    return (key.astype(C.U64) * C.U64(0x9E3779B97F4A7C15) >> C.U64(44)).astype(np.int64)


def _skips(entry, key, keep_above):
    """Whether the merge of an agenda's entry is skipped under a chunk's key; for arrays of 64-bit numbers."""
    return (((entry * C.U64(0x9E3779B97F4A7C15) ^ key) * C.U64(0xD6E8FEB86659FD93)) >> C.U64(24)) & C.U64(0xFFFFFFFF) < C.U64(keep_above)


def _keys(hashes: np.ndarray, variants: np.ndarray) -> np.ndarray:
    return C.mix(hashes ^ variants * C.U64(0x9E3779B97F4A7C15))


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of each run, one run after the other."""
    total = np.cumsum(size)
    return np.repeat(start - total + size, size) + np.arange(total[-1] if len(total) else 0)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Decoder:
    """The pieces of a vocabulary, and what ids decode to."""

    def __init__(self, path: str) -> None:
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bytes_of = [b""] * n
        self.ids: dict[str, int] = {}
        self.byte_ids = [0] * 256
        self.score = [0.0] * n
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                b = int(piece[3:5], 16)
                self.byte_ids[b] = i
                self.bytes_of[i] = bytes([b])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[piece] = i
                self.score[i] = sp.get_score(i)
                self.bytes_of[i] = piece.replace(BLANK, " ").encode()
        width = max(map(len, self.bytes_of))
        self._padded = np.frombuffer(b"".join(b.ljust(width, b"\0") for b in self.bytes_of), np.uint8).reshape(n, width)
        self._filled = np.arange(width)[None, :] < np.array([len(b) for b in self.bytes_of])[:, None]

    def decode(self, ids) -> str:
        ids = np.asarray(ids, np.int64)
        parts = []
        for s in range(0, len(ids), 100_000):
            part = ids[s : s + 100_000]
            parts.append(self._padded[part][self._filled[part]].tobytes())
        return b"".join(parts)[1:].decode()


class Codec(Decoder):
    def __init__(self, path: str, dropout: float = 0.0, seed: int = SEED) -> None:
        super().__init__(path)
        breaks = re.compile(f"[^{BLANK}]{BLANK}")
        if any(breaks.search(p) or "\n" in p for p in self.ids):
            raise ValueError("a piece spans a chunk boundary; this vocabulary cannot be encoded by chunks")
        self._chunk = re.compile(" +[^ \n]*|[^ \n]+|\n")
        # (left id, right id) -> (place in the order of merges, merged id), for every way to cut a piece into two
        order = {i: r for r, i in enumerate(sorted(self.ids.values(), key=lambda i: -self.score[i]))}
        self._merges = {
            (self.ids[p[:k]], self.ids[p[k:]]): (order[i], i) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids
        }
        # U+2581 of the text is no blank: it has no symbol of its own and becomes bytes
        self._symbol = {p: i for p, i in self.ids.items() if len(p) == 1 and p != BLANK} | {" ": self.ids[BLANK]}
        self.keep_above = int(dropout * 2**32)
        self.seed = seed
        keys = np.array([a << 32 | b for a, b in self._merges], np.int64)
        if 2 * len(keys) > _TABLE:
            raise ValueError("the vocabulary has too many merges for the table")
        self._pair, self._order_of, self._merged_of = np.full(_TABLE, -1, np.int64), np.full(_TABLE, _NEVER, np.int32), np.zeros(_TABLE, np.int32)
        at, todo, found = _slot(keys), np.arange(len(keys)), np.array(list(self._merges.values()), np.int32)
        while len(todo):
            open_ = self._pair[at] == -1
            place, first = np.unique(at[open_], return_index=True)
            put = np.flatnonzero(open_)[first]
            self._pair[place] = keys[todo[put]]
            self._order_of[place], self._merged_of[place] = found[todo[put]].T
            rest = np.ones(len(todo), np.bool_)
            rest[put] = False
            todo, at = todo[rest], at[rest] + 1 & _TABLE - 1
        self._byte_ids = np.array(self.byte_ids, np.int32)
        self.forget()
        self._code = np.full(0x110000, -1, np.int32)
        for c, i in self._symbol.items():
            self._code[ord(c)] = i

    def _lookup(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order (or ``_NEVER``) and merged id of pairs of ids, from a table with linear probing."""
        key = (a.astype(np.int64) << 32 | b).reshape(-1)
        at = _slot(key)
        got = self._pair[at]
        order, merged = self._order_of[at], self._merged_of[at]
        far = np.flatnonzero((got != key) & (got != -1))
        at = at[far]
        while len(far):
            at = at + 1 & _TABLE - 1
            got = self._pair[at]
            order[far], merged[far] = self._order_of[at], self._merged_of[at]
            more = (got != key[far]) & (got != -1)
            far, at = far[more], at[more]
        return order.reshape(a.shape), merged.reshape(a.shape)

    def encode_many(self, chunks: list[str], variants: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """:meth:`encode_chunk` of many chunks at once: the order in which the chunks were taken, and in that order all ids and each chunk's number of ids."""
        return self._run(chunks, _keys(self._hashes(chunks), np.array(variants, C.U64)) if self.keep_above else None)[:3]

    def _hashes(self, chunks: list[str]) -> np.ndarray:
        return np.fromiter((xxhash.xxh64_intdigest(c, self.seed) for c in chunks), C.U64, len(chunks))

    def _run(self, chunks: list[str], keys: np.ndarray | None) -> tuple[np.ndarray, ...]:
        """Each step takes the best entry of every chunk's agenda; without keys nothing is skipped.

        The order in which the chunks were taken, and in that order all ids, each chunk's number of ids, all merges taken and each chunk's number of merges.
        """
        lens = np.array([len(c) for c in chunks], np.int64)
        order = np.argsort(lens, kind="stable")
        ids, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        merges, n_merges = [np.zeros(0, C.U64)], [np.zeros(0, np.int64)]
        for s in range(0, len(order), 8192):
            rows = order[s : s + 8192]
            n, width = lens[rows], int(lens[rows[-1]])
            raw = np.zeros((len(rows), width + 1), np.uint32)
            inside = np.arange(width + 1)[None, :] < n[:, None]
            raw[inside] = np.frombuffer("".join([chunks[k] for k in rows]).encode("utf-32-le", "surrogatepass"), np.uint32)
            sym = np.full(raw.shape, -3, np.int32)  # -1: bytes, -2: merged away, -3: beyond the end
            sym[inside] = self._code[raw[inside]]
            taken: list[tuple[np.ndarray, np.ndarray]] = []
            final = self._agenda(sym, None if keys is None else keys[rows], taken)
            who = np.concatenate([np.zeros(0, np.int64), *(r for r, _ in taken)])
            merges.append(np.concatenate([np.zeros(0, C.U64), *(e for _, e in taken)])[np.argsort(who, kind="stable")])
            n_merges.append(np.bincount(who, minlength=len(rows)))
            left = final >= -1
            flat, row = final[left], np.nonzero(left)[0]
            spelt = flat == -1
            if spelt.any():  # characters without a piece
                chars = raw[left]
                size = np.where(spelt, 1 + (chars > 0x7F) + (chars > 0x7FF) + (chars > 0xFFFF), 1)
                flat, row, spelt = np.repeat(flat, size), np.repeat(row, size), np.repeat(spelt, size)
                flat[spelt] = self._byte_ids[np.frombuffer("".join(map(chr, chars[final[left] == -1].tolist())).encode(), np.uint8)]
            ids.append(flat)
            counts.append(np.bincount(row, minlength=len(rows)))
        return order, np.concatenate(ids), np.concatenate(counts), np.concatenate(merges), np.concatenate(n_merges)

    def _agenda(self, sym: np.ndarray, key: np.ndarray | None, taken: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Run the agendas of all rows; the symbols left, each at the place of its first character. Without keys ``taken`` gets (rows, entries) of each step.

        Neighbours are linked by places, so a step costs a search for the best entry of each row and a few reads. The last column is beyond the end of every row.
        """
        width = sym.shape[1]
        done, rows = np.empty_like(sym), np.arange(len(sym))
        right = np.broadcast_to(np.minimum(np.arange(1, width + 1), width - 1).astype(np.int32), sym.shape).copy()
        left = np.broadcast_to(np.roll(np.arange(width, dtype=np.int32), 1), sym.shape).copy()  # the first one's left is the last column
        order, merged = np.full(sym.shape, _NEVER, np.int32), np.zeros(sym.shape, np.int32)
        order[:, :-1], merged[:, :-1] = self._lookup(sym[:, :-1], sym[:, 1:])
        while True:
            at = order.argmin(axis=1)
            best = order[np.arange(len(rows)), at]
            live = best != _NEVER
            n_live = np.count_nonzero(live)
            if n_live < 0.7 * len(rows):
                over = ~live
                done[rows[over]] = sym[over]
                if not n_live:
                    return done
                rows, sym, right, left, order, merged, at, best = rows[live], sym[live], right[live], left[live], order[live], merged[live], at[live], best[live]
                key = key[live] if key is not None else None
                live = np.ones(n_live, np.bool_)
            elif not n_live:
                done[rows] = sym
                return done
            r = np.flatnonzero(live)
            a = at[r]
            entry = best[r].astype(C.U64) << C.U64(32) | a.astype(C.U64)
            if key is None:
                taken.append((rows[r], entry))
            else:
                skip = _skips(entry, key[r], self.keep_above)
                order[r[skip], a[skip]] = _NEVER
                r, a = r[~skip], a[~skip]
            base = r * width
            f_sym, f_right, f_left, f_order, f_merged = (x.reshape(-1) for x in (sym, right, left, order, merged))
            i = base + a
            j = base + f_right[i]
            after, before = f_right[j], f_left[i]
            new = f_merged[i]
            f_sym[i], f_sym[j], f_order[j] = new, -2, _NEVER
            f_right[i] = after
            f_left[base + after] = a
            f_order[i], f_merged[i] = self._lookup(new, f_sym[base + after])
            p = base + before
            f_order[p], f_merged[p] = self._lookup(f_sym[p], new)
            last = base + width - 1  # what was written there for the first or last symbol of a row
            f_left[last], f_order[last] = width - 2, _NEVER

    def encode_chunk(self, chunk: str, variant: int = 0) -> list[int]:
        """Ids of one chunk (its blanks still plain), by the agenda."""
        merges, drop = self._merges, self.keep_above
        sym = [self._symbol.get(c, -1) for c in chunk]
        n = len(sym)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        # an entry is order * 2**32 + place: best first, leftmost of equals; it holds while the pair at the place has that order
        agenda = []
        for i in range(n - 1):
            m = merges.get((sym[i], sym[i + 1]))
            if m is not None:
                agenda.append(m[0] << 32 | i)
        heapq.heapify(agenda)
        key = int(_keys(self._hashes([chunk]), np.array([variant], C.U64))[0]) if drop else 0
        while agenda:
            entry = heapq.heappop(agenda)
            i = entry & 0xFFFFFFFF
            j = right[i]
            if j >= n:
                continue
            m = merges.get((sym[i], sym[j]))
            if m is None or m[0] != entry >> 32:
                continue
            if drop and ((entry * 0x9E3779B97F4A7C15 ^ key) * 0xD6E8FEB86659FD93 >> 24) & 0xFFFFFFFF < drop:
                continue
            sym[i], sym[j] = m[1], -2
            k = right[i] = right[j]
            right[j] = n  # a place merged away never matches again
            if k < n:
                left[k] = i
                m = merges.get((sym[i], sym[k]))
                if m is not None:
                    heapq.heappush(agenda, m[0] << 32 | i)
            k = left[i]
            if k >= 0:
                m = merges.get((sym[k], sym[i]))
                if m is not None:
                    heapq.heappush(agenda, m[0] << 32 | k)
        if -1 not in sym:
            return [x for x in sym if x >= 0]
        out: list[int] = []
        for x, c in zip(sym, chunk):
            if x >= 0:
                out.append(x)
            elif x == -1:
                out += [self.byte_ids[b] for b in c.encode()]
        return out

    def forget(self) -> None:
        """Empty the memory: numbers of chunks; by number the hash, and start and length of the ids and of the merges without dropout."""
        self._number: defaultdict[str, int] = defaultdict(count().__next__)
        self._hash, self._ids, self._taken = np.zeros(0, C.U64), np.zeros(0, np.int32), np.zeros(0, C.U64)
        self._start, self._size, self._first, self._n_taken = (np.zeros(0, np.int64) for _ in range(4))

    def encode_all(self, texts: list[str], doc_ids: list[int]) -> list[np.ndarray]:
        """Ids of each text. Texts are taken in groups of bounded length; the new chunks of a group run their agendas together."""
        out, group, chars = [], 0, 0
        for k, text in enumerate(texts):
            chars += len(text)
            if chars >= GROUP_CHARS or k == len(texts) - 1:
                out += self._encode_group(texts[group : k + 1], doc_ids[group : k + 1])
                group, chars = k + 1, 0
        return out

    def _encode_group(self, texts: list[str], doc_ids: list[int]) -> list[np.ndarray]:
        chunks: list[str] = []
        ends = np.zeros(len(texts) + 1, np.int64)
        for k, text in enumerate(texts):
            if text:
                chunks += self._chunk.findall(" " + text)
            ends[k + 1] = len(chunks)
        number = np.fromiter(map(self._number.__getitem__, chunks), np.int64, len(chunks))
        self._learn(chunks, number)
        start, size, pool = self._start[number], self._size[number], self._ids
        n = np.diff(ends)
        long = np.fromiter((len(c) >= LONG for c in chunks), np.bool_, len(chunks))
        variant = np.zeros(len(chunks), C.U64)
        if self.keep_above:
            place = np.arange(len(chunks)) - np.repeat(ends[:-1], n)
            doc = np.array([xxhash.xxh64_intdigest(f"{self.seed}:{doc}") for doc in doc_ids], C.U64)
            variant = C.mix(place.astype(C.U64) * C.U64(0x9E3779B97F4A7C15) ^ np.repeat(doc, n))
            key = _keys(self._hash[number], variant)
            n_taken = self._n_taken[number]
            skip = _skips(self._taken[_spread(self._first[number], n_taken)], np.repeat(key, n_taken), self.keep_above)
            own = np.unique(np.repeat(np.arange(len(chunks)), n_taken)[skip])
            order, ids, lens, _, _ = self._run([chunks[k] for k in own.tolist()], key[own])
            own = own[order]
            start[own], size[own] = len(pool) + np.cumsum(lens) - lens, lens
            pool = np.concatenate((pool, ids))
        slow = np.flatnonzero(long)
        each = [np.array(self.encode_chunk(chunks[k], int(variant[k])), np.int32) for k in slow.tolist()]
        lens = np.array([len(x) for x in each], np.int64)
        start[slow], size[slow] = len(pool) + np.cumsum(lens) - lens, lens
        flat = np.concatenate((pool, *each))[_spread(start, size)]
        cuts = np.concatenate(([0], np.cumsum(size)))[ends].tolist()
        if len(slow) or len(self._size) > MEMORY:
            self.forget()  # long chunks are kept for these texts only
        return [flat[s:e] for s, e in zip(cuts[:-1], cuts[1:])]

    def _learn(self, chunks: list[str], number: np.ndarray) -> None:
        """Remember the new chunks without dropout; long ones get an empty place."""
        unknown = np.flatnonzero(number >= len(self._size))
        _, first = np.unique(number[unknown], return_index=True)
        some = [chunks[k] for k in unknown[first].tolist()]
        short = np.array([k for k, c in enumerate(some) if len(c) < LONG], np.int64)
        order, ids, lens, taken, n_taken = self._run([some[k] for k in short.tolist()], None)
        at = short[order]
        new = np.zeros((4, len(some)), np.int64)
        new[:, at] = len(self._ids) + np.cumsum(lens) - lens, lens, len(self._taken) + np.cumsum(n_taken) - n_taken, n_taken
        self._start, self._size, self._first, self._n_taken = (np.concatenate(x) for x in zip((self._start, self._size, self._first, self._n_taken), new))
        self._hash = np.concatenate((self._hash, self._hashes(some) if self.keep_above else np.zeros(len(some), C.U64)))
        self._ids, self._taken = np.concatenate((self._ids, ids)), np.concatenate((self._taken, taken))

    def encode(self, text: str, doc_id: int = 0) -> np.ndarray:
        return self.encode_all([text], [doc_id])[0]


@cache
def decoder(path: str) -> Decoder:
    return Decoder(path)


@cache
def codec(path: str, dropout: float, seed: int) -> Codec:
    return Codec(path, dropout, seed)


def _forget() -> None:
    decoder.cache_clear()
    codec.cache_clear()


C.HELD.append((_forget, frozenset({__name__, f"{__package__}.chat_format"})))


def encode(docs: DataFrame, model: str, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """doc_id and ids (array<int>) of each row; null ids for a null text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(model, dropout, seed)
        for batch in batches:
            for s in range(0, len(batch), 1000):
                part = batch.iloc[s : s + 1000]
                key = [None if pd.isna(i) else int(i) for i in part["doc_id"]]
                found = c.encode_all([t if isinstance(t, str) else "" for t in part["text"]], [-1 if i is None else i for i in key])
                ids = [x if isinstance(t, str) else None for x, t in zip(found, part["text"])]
                yield pd.DataFrame({"doc_id": pd.array(key, "Int64"), "ids": ids})

    C.small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(C.tidy(run), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and the decoded text of each row of ids; null for null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = decoder(model)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "decoded": [None if x is None else c.decode(x) for x in batch["ids"]]})

    return encoded.select("doc_id", "ids").mapInPandas(C.tidy(run), "doc_id long, decoded string")


def decode_digest(encoded: DataFrame, model: str) -> DataFrame:
    """Each row of ids with n_tokens, ids_crc32 (of little-endian unsigned 32-bit ids) and decoded_sha256 of the text that they decode to."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = decoder(model)
        for batch in batches:
            ids = [np.zeros(0, np.int32) if x is None else np.asarray(x, np.int32) for x in batch["ids"]]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].astype("Int64"), "ids": batch["ids"], "n_tokens": [len(x) for x in ids],
                "ids_crc32": [zlib.crc32(x.astype("<u4").tobytes()) for x in ids],
                "decoded_sha256": [None if x is None else hashlib.sha256(c.decode(x).encode()).hexdigest() for x in batch["ids"]],
            })

    return encoded.select("doc_id", "ids").mapInPandas(C.tidy(run), "doc_id long, ids array<int>, n_tokens long, ids_crc32 long, decoded_sha256 string")
