r"""Chat formatting by token-level assembly.

A turn is ``<s>[INST] role [/INST] text</s>``. The two ends are the reserved ids 1 and 2, spliced between segments; role header and text
are encoded separately, so no piece spans a boundary and no text can produce a reserved id. Control strings that occur inside a
role or text (``<s>``, ``</s>``, ``<unk>``, ``[INST]``, ``[/INST]``) get a backslash behind their first character, and those that
already have backslashes there one more; reading takes one away, so every text comes back.

The segments of a turn and their lengths give, by prefix sums, where each one starts; the loss mask marks the tokens of the
assistant's text and nothing else, and ``start`` is the place of the turn in its conversation's token sequence.

Scale. Encoding works on single turns, before any grouping. Then turns are dealt by conversation, sorted, and streamed: a
conversation of any length is never held in memory, each turn is a row of the output.

Defined cases. Null role or text: empty. Null turn: sorts first. Null conv_id: these rows form one conversation with a null id. Rows that
tie in turn are ordered by role and text; repeated rows are turns of their own. Extra columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .sentencepiece_codec import codec

BOS, EOS = 1, 2
TURN = "conv_id long, turn long, position long, start long, ids binary, mask binary"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
HEAD, TAIL = "[INST] ", " [/INST] "
_ESCAPE = re.compile(r"([<\[])(\\*/?(?:s>|unk>|INST\]))")
_UNESCAPE = re.compile(r"([<\[])\\(\\*/?(?:s>|unk>|INST\]))")


def escape(text: str) -> str:
    r"""Controls are ``<`` or ``[``, backslashes (none in a bare one), an optional slash and a name with its bracket."""
    return _ESCAPE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def format_turns(conversations: DataFrame, model: str) -> DataFrame:
    """One row of TURN per turn, ids as 16-bit and mask as 8-bit arrays; a conversation's rows are together and in order."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    spark = conversations.sparkSession
    C.small_batches(spark)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(model, 0.0, 0)
        if len(c.bytes_of) > 1 << 16:
            raise ValueError("ids need 16 bits at most")
        for batch in batches:
            ids, mask = [], []
            heads = {r: c.encode(HEAD + escape(r) + TAIL) for r in set(batch["role"])}
            texts = [x for s in range(0, len(batch), 500) for x in c.encode_all([escape(t) for t in batch["text"].iloc[s : s + 500]], [0] * len(batch["text"].iloc[s : s + 500]))]
            for role, text in zip(batch["role"], texts):
                parts = [np.array([BOS], np.int32), heads[role], text, np.array([EOS], np.int32)]
                ends = np.cumsum([len(p) for p in parts])
                m = np.zeros(ends[-1], np.uint8)
                if role == "assistant":
                    m[ends[1] : ends[2]] = 1
                ids.append(np.concatenate(parts).astype("<u2").tobytes())
                mask.append(np.packbits(m).tobytes())
            yield pd.DataFrame({"conv_id": batch["conv_id"].astype("Int64"), "turn": batch["turn"].astype("Int64"), "role": batch["role"], "text": batch["text"], "ids": ids, "mask": mask})

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: object = ()
        position = start = 0
        for batch in batches:
            positions, starts = [], []
            for conv, ids in zip(batch["conv_id"], batch["ids"]):
                conv = None if pd.isna(conv) else int(conv)
                if conv != now:
                    now, position, start = conv, 0, 0
                positions.append(position)
                starts.append(start)
                position, start = position + 1, start + len(ids) // 2
            yield pd.DataFrame({"conv_id": batch["conv_id"].astype("Int64"), "turn": batch["turn"].astype("Int64"), "position": positions, "start": starts, "ids": batch["ids"], "mask": batch["mask"]})

    encoded = rows.mapInPandas(encode, "conv_id long, turn long, role string, text string, ids binary, mask binary")
    dealt = encoded.repartition(C.shuffle_partitions(spark), F.xxhash64("conv_id")).sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "turn", "ids", "mask").mapInPandas(place, TURN)


def read_turn(ids: bytes, mask: bytes, c) -> tuple[str, str, str, str]:
    """role, text, text under the loss mask (both unescaped) and the formatted string of one turn's tokens."""
    x = np.frombuffer(bytes(ids), "<u2").astype(np.int64)
    m = np.unpackbits(np.frombuffer(bytes(mask), np.uint8), count=len(x)).astype(bool)
    if x[0] != BOS or x[-1] != EOS or (x[1:-1] == BOS).any() or (x[1:-1] == EOS).any():
        raise ValueError("not a turn")
    # the header ends where its closing control ends; a text has none, for it is escaped
    whole = c.decode(x[1:-1])  # one blank of the header's start is cut, the one between the segments is left
    at = whole.index("[/INST] ") + len("[/INST] ")
    header, text = whole[:at], whole[at + 1 :]
    role = unescape(header[len(HEAD) : -len(TAIL)])
    return role, unescape(text), unescape(c.decode(x[m])) if m.any() else "", f"<s>{header}{text}</s>"


def read_digests(turns: DataFrame, model: str) -> DataFrame:
    """DIGEST of each conversation, read back from rows of TURN that are together and in order; a running hash, nothing is gathered."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(model, 0.0, 0)
        now: object = ()
        state: list = []

        def close(out: list) -> None:
            if state:
                out.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for batch in batches:
            out: list = []
            for conv, ids, mask in zip(batch["conv_id"], batch["ids"], batch["mask"]):
                conv = None if pd.isna(conv) else int(conv)
                if conv != now:
                    close(out)
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text, loss, formatted = read_turn(ids, mask, c)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += len(formatted)
            yield _frame(out)
        out = []
        close(out)
        yield _frame(out)

    return turns.mapInPandas(run, DIGEST)


def _frame(rows: list) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in DIGEST.split(", ")])
    out["conv_id"] = out["conv_id"].astype("Int64")
    return out
