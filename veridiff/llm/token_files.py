"""Token-ID files: bit-plane shuffled blocks of ids under zstandard, with a chunk index.

Layout of a file: magic; per chunk of ``CHUNK`` ids (the last may be shorter) its planes, one after another; the
documents (ids, flags of null ids and lengths, compressed); a JSON footer with the chunk index (offset, number of ids, sizes of the
planes) and the place of the documents; the footer's length as 8 bytes; magic. In ``bit`` mode plane j holds bit j of each id, in
``byte`` mode byte j. Planes above the highest used bit are left out, and a plane that zstandard cannot shrink is kept as it is.
A reader that wants ids [a, b) decodes only the chunks that hold them.

Writing. Rows are dealt to ranges of doc_id and sorted inside each, so the files in order of (part, number) hold the ids
in ascending doc_id order. A task streams: it holds one chunk and the list of the file's documents, and starts a new file every
``FILE_TOKENS`` ids. It writes under a name of its own attempt and renames at the end, so a repeated or lost attempt leaves no
half file. The files go through pyarrow's file systems to the shared folder. What tasks return is the manifest.

Defined cases. Null text: as empty, so the end id alone. Null doc_id: sorted first, null in the result. Repeated rows
are written each. An empty table gives no file and an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

MAGIC = b"IDPLANE1"
CHUNK = 1 << 16
FILE_TOKENS = 1 << 26
JOINED = 500
END_ID = 2
RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# --- planes --------------------------------------------------------------------------------------------------


def to_planes(ids: np.ndarray, mode: str = "bit") -> list[bytes]:
    """The planes of unsigned 32-bit ids, lowest first, each compressed (a leading 1) or as it is (a leading 0)."""
    ids = np.ascontiguousarray(ids, "<u4")
    used = int(ids.max()).bit_length() if len(ids) else 0
    if mode == "bit":
        width = 2 if used <= 16 else 4
        raw = ids.astype(f"<u{width}").view(np.uint8).reshape(-1, width)
        bits = np.unpackbits(raw, axis=1, bitorder="little")
        planes = [np.packbits(bits[:, j]).tobytes() for j in range(used)]
    else:
        planes = [ids.view(np.uint8).reshape(-1, 4)[:, j].tobytes() for j in range(-(-used // 8))]
    z = zstandard.ZstdCompressor(level=1)
    out = []
    for p in planes:
        small = z.compress(p)
        out.append(b"\1" + small if len(small) < len(p) else b"\0" + p)
    return out


def from_planes(planes: list[bytes], n: int, mode: str = "bit") -> np.ndarray:
    d = zstandard.ZstdDecompressor()
    raw = [d.decompress(p[1:]) if p[:1] == b"\1" else p[1:] for p in planes]
    out = np.zeros(n, np.uint32)
    for j, p in enumerate(raw):
        if mode == "bit":
            out |= np.unpackbits(np.frombuffer(p, np.uint8), count=n).astype(np.uint32) << np.uint32(j)
        else:
            out |= np.frombuffer(p, np.uint8).astype(np.uint32) << np.uint32(8 * j)
    return out


# --- files ---------------------------------------------------------------------------------------------------


def _fs(uri: str):
    from pyarrow import fs

    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri) if ":" in uri else (fs.LocalFileSystem(), uri)


class Writer:
    """One file; documents are added in order."""

    def __init__(self, uri: str, attempt: str, mode: str = "bit") -> None:
        self.fs, self.path = _fs(uri)
        self.temp = f"{self.path}.{attempt}"
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.out = self.fs.open_output_stream(self.temp)
        self.mode, self.at, self.n_ids, self.held = mode, 0, 0, 0
        self.index: list = []
        self.parts: list[np.ndarray] = []
        self.doc_ids: list[int] = []
        self.null: list[bool] = []
        self.lens: list[int] = []
        self._put(MAGIC)

    def _put(self, b: bytes) -> None:
        self.out.write(b)
        self.at += len(b)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id or 0)
        self.null.append(doc_id is None)
        self.lens.append(len(ids))
        self.parts.append(ids)
        self.held += len(ids)
        self.n_ids += len(ids)
        if self.held >= CHUNK:
            flat = np.concatenate(self.parts)
            whole = len(flat) // CHUNK * CHUNK
            for s in range(0, whole, CHUNK):
                self._chunk(flat[s : s + CHUNK])
            self.parts, self.held = [flat[whole:]], len(flat) - whole

    def _chunk(self, ids: np.ndarray) -> None:
        planes = to_planes(ids, self.mode)
        self.index.append([self.at, len(ids), [len(p) for p in planes]])
        self._put(b"".join(planes))

    def close(self) -> tuple[int, int]:
        if self.held:
            self._chunk(np.concatenate(self.parts))
        docs = [C.pack(np.array(self.doc_ids, np.int64)), C.pack(np.array(self.null, np.uint8)), C.pack(np.array(self.lens, np.int64))]
        footer = json.dumps({"mode": self.mode, "chunks": self.index, "docs_at": self.at, "docs": [len(x) for x in docs]}).encode()
        self._put(b"".join(docs))
        self._put(zstandard.ZstdCompressor().compress(footer))
        size = self.at - sum(len(x) for x in docs) - json.loads(footer)["docs_at"]
        self._put(size.to_bytes(8, "little") + MAGIC)
        self.out.close()
        from pyarrow import fs

        if self.fs.get_file_info(self.path).type != fs.FileType.NotFound:
            self.fs.delete_file(self.path)
        self.fs.move(self.temp, self.path)
        return len(self.doc_ids), self.n_ids


class Reader:
    """Random access to a file by its footer."""

    def __init__(self, uri: str) -> None:
        self.fs, self.path = _fs(uri)
        self.file = self.fs.open_input_file(self.path)
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        if tail[8:] != MAGIC or self.file.read_at(8, 0) != MAGIC:
            raise ValueError(f"{uri} is not a token file")
        n = int.from_bytes(tail[:8], "little")
        self.meta = json.loads(zstandard.ZstdDecompressor().decompress(self.file.read_at(n, size - 16 - n)))
        at, docs = self.meta["docs_at"], []
        for length, kind in zip(self.meta["docs"], (np.int64, np.uint8, np.int64)):
            docs.append(C.unpack(self.file.read_at(length, at), kind))
            at += length
        self.doc_ids, self.null, self.lens = docs

    def chunk(self, k: int) -> np.ndarray:
        at, n, sizes = self.meta["chunks"][k]
        raw = self.file.read_at(sum(sizes), at)
        ends = np.cumsum(sizes).tolist()
        return from_planes([raw[e - s : e] for s, e in zip(sizes, ends)], n, self.meta["mode"])

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """Each document's id and ids, a chunk in memory at a time (and the documents that span it)."""
        held, k = np.zeros(0, np.uint32), 0
        for doc, null, n in zip(self.doc_ids.tolist(), self.null.tolist(), self.lens.tolist()):
            if len(held) < n:
                parts, got = [held], len(held)
                while got < n:
                    parts.append(self.chunk(k))
                    got += len(parts[-1])
                    k += 1
                held = np.concatenate(parts)
            yield (None if null else doc), held[:n]
            held = held[n:]

    def read(self, start: int, end: int) -> np.ndarray:
        """Ids [start, end) of the file, from the chunks that hold them."""
        if end <= start:
            return np.zeros(0, np.uint32)
        first = start // CHUNK
        flat = np.concatenate([self.chunk(k) for k in range(first, (end - 1) // CHUNK + 1)])
        return flat[start - first * CHUNK : end - first * CHUNK]

    def close(self) -> None:
        self.file.close()


# --- tokenizer -----------------------------------------------------------------------------------------------


class Encoder:
    """The tokenizers library with a memory of blank-separated pieces.

    Blanks and line feeds always part this vocabulary's tokens, so a text's ids are those of its pieces in order. New
    pieces of letters alone go to the library many at a time, joined by blanks. Where each of them is one word to the library its
    ids end in just one id with the end-of-word suffix; if the ends are not as many as the pieces, the pieces go one by one.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 32:
            raise ValueError("ids need 32 bits at most")
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.zeros(0, np.bool_)
        if suffix:
            vocab = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocab.values()) + 1, np.bool_)
            self.ends[[i for w, i in vocab.items() if w.endswith(suffix)]] = True
        self.forget()

    def forget(self) -> None:
        """Empty the memory: numbers of pieces, and start, length and ids of each number."""
        self.number: defaultdict[str, int] = defaultdict(count().__next__)
        self.start, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _each(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids and the number of ids of each piece."""
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for s in range(0, len(pieces), 10_000):
            got = [e.ids for e in self.tokenizer.encode_batch_fast(pieces[s : s + 10_000], add_special_tokens=False)]
            ids.append(np.fromiter(chain.from_iterable(got), np.uint32))
            sizes.append(np.fromiter(map(len, got), np.int64, len(got)))
        return np.concatenate(ids), np.concatenate(sizes)

    def _joined(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for s in range(0, len(pieces), JOINED):
            part = pieces[s : s + JOINED]
            flat, _ = self._each([" ".join(part)])
            at = np.flatnonzero(self.ends[flat])
            if len(at) == len(part) and at[-1] == len(flat) - 1:
                ids.append(flat)
                sizes.append(np.diff(at, prepend=-1))
            else:
                for kept, x in zip((ids, sizes), self._each(part)):
                    kept.append(x)
        return np.concatenate(ids), np.concatenate(sizes)

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text and the end id, all in one array cut by text."""
        pieces: list[str] = []
        stop = np.zeros(len(texts), np.int64)
        for k, t in enumerate(texts):
            pieces += t.replace("\n", " ").split(" ")
            stop[k] = len(pieces)
        number = np.fromiter(map(self.number.__getitem__, pieces), np.int64, len(pieces))
        known = len(self.size)
        fresh = len(self.number) - known
        if fresh:
            at = np.zeros(fresh, np.int64)
            late = np.flatnonzero(number >= known)
            at[number[late] - known] = late
            new = [pieces[k] for k in at.tolist()]
            letters = np.fromiter(map(str.isalpha, new), np.bool_, fresh) & (len(self.ends) > 0)
            start, size = np.zeros(fresh, np.int64), np.zeros(fresh, np.int64)
            for which, encode in ((np.flatnonzero(letters), self._joined), (np.flatnonzero(~letters), self._each)):
                ids, n = encode([new[k] for k in which.tolist()])
                size[which], start[which] = n, len(self.ids) + np.cumsum(n) - n
                self.ids = np.concatenate((self.ids, ids))
            self.start, self.size = np.concatenate((self.start, start)), np.concatenate((self.size, size))
        size = self.size[number]
        total = np.cumsum(size)
        flat = self.ids[np.repeat(self.start[number] - total + size, size) + np.arange(total[-1] if len(total) else 0)]
        ends = total[stop - 1]
        out = np.insert(flat, ends, np.uint32(END_ID))
        if len(self.number) > 500_000 or len(self.ids) > 4_000_000:
            self.forget()
        return np.split(out, ends[:-1] + np.arange(1, len(texts))) if texts else []


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


# --- operator ------------------------------------------------------------------------------------------------


def write(docs: DataFrame, uri: str, tokenizer: str, mode: str = "bit", file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Write all documents under ``uri``; the manifest: part, number, file, n_docs, n_tokens, start (ids in all files before)."""
    spark = docs.sparkSession
    C.small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ranged = rows.repartitionByRange(C.shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    schema = "part int, number int, file string, n_docs long, n_tokens long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task = TaskContext.get()
        part, number, out = task.partitionId(), 0, None
        enc = encoder(tokenizer)
        done = []

        def close():
            nonlocal out, number
            done.append((part, number, out.name, *out.close()))
            out, number = None, number + 1

        for batch in batches:
            for s in range(0, len(batch), 256):
                texts = batch["text"].iloc[s : s + 256].tolist()
                for doc, ids in zip(batch["doc_id"].iloc[s : s + 256], enc.encode_all(texts)):
                    if out is None:
                        name = f"{uri}/part-{part:06d}-{number:06d}.ids"
                        out = Writer(name, f"attempt-{task.taskAttemptId()}", mode)
                        out.name = name
                    out.add(None if pd.isna(doc) else int(doc), ids)
                    if out.n_ids >= file_tokens:
                        close()
        if out is not None:
            close()
        yield pd.DataFrame(done, columns=["part", "number", "file", "n_docs", "n_tokens"])

    files = C.materialize(ranged.mapInPandas(run, schema), "token-manifest")
    # parts are as many as shuffle partitions, so their totals fit the driver; files within a part are summed by a window
    totals = sorted(tuple(r) for r in files.groupBy("part").agg(F.sum("n_tokens")).collect())
    before, rows_of = 0, []
    for part, n in totals:
        rows_of.append((part, before))
        before += n
    starts = spark.createDataFrame(rows_of, "part int, before long")
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1))
    return files.join(F.broadcast(starts), "part").select("*", (F.col("before") + F.coalesce(within, F.lit(0))).alias("start")).drop("before")


def read_digests(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, read back from the files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, start in zip(batch["file"], batch["start"]):
                reader, out = Reader(file), []
                for doc, ids in reader.documents():
                    out.append((doc, int(start), len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(out) == 5000:
                        yield _digest_frame(out)
                        out = []
                yield _digest_frame(out)
                reader.close()

    n = C.shuffle_partitions(manifest.sparkSession)
    return manifest.select("file", "start").repartition(n, "file").mapInPandas(run, RESULT)


def _digest_frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
    out["doc_id"] = out["doc_id"].astype("Int64")
    return out
