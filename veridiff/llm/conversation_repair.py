"""Conversation structure repair: the cheapest edits that turn the rows of a conversation into ``system? (user assistant)+``.

Conversations are dealt to tasks by hash and read there in order, a batch at a time. In each batch one recursive DuckDB query
advances all conversations by one turn in each recursion and keeps, for each state of the grammar, the least cost and the audit
of its edits. Only flags of the rows go to DuckDB, the texts stay behind and are hashed along the audit that won.

A long conversation is worked on in segments: what is carried from one to the next are at most four states with their cost,
what their audits do not have in common, and a running hash of the rows repaired so far. Its hash depends on all its text in
order, so that one conversation is read by one task, whose memory does not grow with it but for the audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from os.path import commonprefix

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

REPAIR = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
BATCH_ROWS = 8192
BATCH_BYTES = 16_000_000
#: Rows of one conversation that take part in one recursive query.
SEGMENT = 512
LARGEST = 2**63 - 1

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
NAMES = {"u": "user", "a": "assistant"}
#: state -> the initials that may follow; states are the last initial, "" at the start. A conversation may end in "" or "a".
FOLLOWS = {"": "su", "s": "u", "u": "a", "a": "u"}
ENDS = ("", "a")


def insertions(state: str) -> list[tuple[str, int, str]]:
    """(state, cost, audit) after inserting no, one or two rows; more come back to a state that was there."""
    out = [(state, 0, "")]
    for audit in ("I", "II"):
        out.append((next(c for c in FOLLOWS[out[-1][0]] if c in NAMES), len(audit) * INSERT, audit))
    return out


def edits() -> list[tuple[str, str, str | None, bool, int, str]]:
    """(state, next state, initial of the row that it needs, whether the row stays, cost, audit): insertions, then one row."""
    out = []
    for state in FOLLOWS:
        for at, cost, audit in insertions(state):
            out.append((state, at, None, False, cost + DELETE, audit + "D"))
            for c in FOLLOWS[at]:
                out.append((state, c, c, True, cost, audit + "K"))
                if c in NAMES:
                    out.append((state, c, None, True, cost + REROLE, audit + "R"))
    return out


WALK = f"""
    WITH RECURSIVE walk(seg, i, state, best) AS (
        SELECT seg, 0, state, {{'cost': cost, 'audit': audit, 'origin': state}} FROM starts
        UNION ALL
        SELECT w.seg, t.i, e.dst, min({{
            'cost': w.best.cost + e.cost + CASE WHEN e.stays AND t.truncated THEN {TRUNCATED} ELSE 0 END + {DELETE} * t.extra,
            'audit': w.best.audit || e.audit || repeat('D', t.extra), 'origin': w.best.origin}})
        FROM walk AS w JOIN turns AS t ON t.seg = w.seg AND t.i = w.i + 1
        JOIN edits AS e ON e.src = w.state AND (NOT e.stays OR t.sound) AND (e.needs IS NULL OR e.needs = t.initial)
        GROUP BY w.seg, t.i, e.dst)
    SELECT seg, state, best.cost, best.audit, best.origin FROM walk JOIN lengths USING (seg) WHERE walk.i = lengths.n"""


class Conversation:
    """What is known of one conversation so far, and its rows that no query has seen yet."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id = conv_id
        self.rows: list[tuple] = []  # (role, text, extra, sound, truncated)
        self.faults = [0, 0, 0]
        self.illegal = 0
        self.turns: tuple | None = None  # first, last, distinct
        self.last = None
        self.states = {"": (0, "", hashlib.sha256(), True)}  # cost, audit after ``common``, hash, whether nothing was hashed yet
        self.common: list[str] = []

    def add(self, turn, role: str, text: str, n: int, seen: bool, blank: bool, truncated: bool) -> None:
        if blank:
            self.faults[0] += n
        else:
            self.faults[1] += n if seen else n - 1
            self.faults[2] += truncated and not seen
        if self.last is not None:
            self.illegal += self.last + role[:1] not in ("su", "ua", "au")
        self.illegal += n - 1  # an initial does not follow itself
        self.last = role[:1]
        if turn is not None:
            if self.turns is None:
                self.turns = (turn, turn, 1)
            elif turn != self.turns[1]:
                self.turns = (self.turns[0], turn, self.turns[2] + 1)
        sound = not (blank or seen)
        self.rows.append((role, text, n - 1, sound, sound and truncated))

    def advance(self, found: list[tuple]) -> None:
        """Take the (state, cost, audit, origin) of the end of ``rows``; hash what each path made of them."""
        states = {}
        for state, cost, audit, origin in found:
            _, had, digest, empty = self.states[origin]
            digest, empty = digest.copy(), empty
            for line in self.repaired(origin, audit[len(had) :]):
                digest.update(line if empty else b"\n" + line)
                empty = False
            states[state] = (cost, audit, digest, empty)
        shared = commonprefix([s[1] for s in states.values()])
        self.common.append(shared)
        self.states = {k: (c, a[len(shared) :], d, e) for k, (c, a, d, e) in states.items()}
        self.rows = []

    def repaired(self, state: str, audit: str) -> Iterator[bytes]:
        """``role:text`` of the rows that edits leave; ``audit`` may end with insertions that need no row."""
        at, rows = 0, iter(self.rows)
        while at < len(audit):
            edit = audit[at]
            at += 1
            role = text = ""
            if edit != "I":
                role, text, extra, *_ = next(rows)
                at += extra  # the copies that are deleted with it
            if edit == "D":
                continue
            state = role[:1] if edit == "K" else next(c for c in FOLLOWS[state] if c in NAMES)
            yield f"{role if edit == 'K' else NAMES[state]}:{text}".encode()

    def close(self) -> tuple:
        """A row of REPAIR, after the insertions that are still due."""
        cost, audit, state, more = min((c + k, a + x, s, x) for s, (c, a, *_) in self.states.items() for to, k, x in insertions(s) if to in ENDS)
        _, _, digest, empty = self.states[state]
        for line in self.repaired(state, more):
            digest.update(line if empty else b"\n" + line)
            empty = False
        gaps = min(self.turns[1] - self.turns[0] + 1 - self.turns[2], LARGEST) if self.turns else 0
        return (self.conv_id, gaps, *self.faults, self.illegal, cost, "".join(self.common) + audit, digest.hexdigest())


def advance(con: duckdb.DuckDBPyConnection, batch: list[Conversation]) -> None:
    """One recursive query over the rows that wait in ``batch``."""
    batch = [x for x in batch if x.rows]
    if not batch:
        return
    turns = [(seg, i, x[0][:1], x[3], x[4], x[2]) for seg, c in enumerate(batch) for i, x in enumerate(c.rows, 1)]
    starts = [(seg, s, cost, audit) for seg, c in enumerate(batch) for s, (cost, audit, *_) in c.states.items()]
    con.register("turns", pa.table(dict(zip(("seg", "i", "initial", "sound", "truncated", "extra"), map(pa.array, zip(*turns))))))
    con.register("starts", pa.table(dict(zip(("seg", "state", "cost", "audit"), map(pa.array, zip(*starts))))))
    con.register("lengths", pa.table({"seg": range(len(batch)), "n": [len(c.rows) for c in batch]}))
    found: dict[int, list[tuple]] = {}
    for seg, *end in con.execute(WALK).fetchall():
        found.setdefault(seg, []).append(tuple(end))
    for seg, c in enumerate(batch):
        c.advance(found[seg])


def connect() -> duckdb.DuckDBPyConnection:
    con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
    kinds = pa.schema([("src", pa.string()), ("dst", pa.string()), ("needs", pa.string()), ("stays", pa.bool_()), ("cost", pa.int64()), ("audit", pa.string())])
    con.register("found", pa.table([pa.array(x, t) for x, t in zip(zip(*edits()), kinds.types)], schema=kinds))
    con.execute("CREATE TEMP TABLE edits AS SELECT * FROM found")
    return con


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of conversations that are together and in order to rows of REPAIR."""
    names = [c.split()[0] for c in REPAIR.split(", ")]
    kinds = [pa.string() if c.endswith("string") else pa.int64() for c in REPAIR.split(", ")]
    con, done, now, rows, held = connect(), [], None, 0, 0

    def close() -> pa.RecordBatch:
        nonlocal done, rows, held
        advance(con, [*done, *([now] if now else [])])
        out, done, rows, held = [c.close() for c in done], [], 0, 0
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * len(kinds), kinds)], names=names)

    try:
        for batch in batches:
            for conv, *row in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "turn", "role", "text", "n", "seen", "blank", "truncated"))):
                if now is None or conv != now.conv_id:
                    if now is not None:
                        done.append(now)
                    now = Conversation(conv)
                if row[3]:
                    now.add(*row)
                rows, held = rows + 1, held + len(row[2] or "")
                if len(now.rows) >= SEGMENT or rows >= BATCH_ROWS or held >= BATCH_BYTES:
                    yield close()
        if now is not None:
            done.append(now)
            now = None
        yield close()
    finally:
        con.close()
        C.give_back()


def _turn_order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


def repair(rows: DataFrame) -> DataFrame:
    """A row of REPAIR for each conv_id of ``rows`` (conv_id, turn, role, text and, if there, ``copies``).

    Rows are taken by turn, nulls first, ties by role and text in code points. A row counts ``copies`` times (once where the column
    is missing); with 0 it only says that its conversation exists, and a conversation without others gives zeros, an empty audit
    and the hash of nothing. Equal rows of one turn are one entry with a count. Null roles and texts are one space; a null
    conv_id is a conversation; an empty role fits nowhere; further columns are not looked at; an empty table gives none. ``gaps`` stops at the largest long.
    """
    C.small_batches(rows.sparkSession)
    copies = F.col("copies").cast("long") if "copies" in rows.columns else F.lit(1).cast("long")
    there = copies > 0
    said = lambda name: F.when(there, F.coalesce(F.col(name), F.lit(" "))).alias(name)
    counted = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.when(there, F.col("turn").cast("long")).alias("turn"), said("role"), said("text"), copies.alias("n"))
    runs = counted.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    left = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    flagged = runs.withColumn("blank", left == "").withColumn("truncated", ~F.right(left, F.lit(1)).isin(".", "!", "?"))
    dealt = flagged.repartition(C.shuffle_partitions(rows.sparkSession), "conv_id")
    same = Window.partitionBy("conv_id", "role", F.sha2("text", 256)).orderBy(F.col("turn").asc_nulls_first())  # within the same deal
    marked = dealt.withColumn("seen", F.row_number().over(same) > 1)
    return marked.sortWithinPartitions("conv_id", *_turn_order()).mapInArrow(_run, REPAIR)


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): every row damaged, or not, by the checksum of ``conv_id:turn``; nulls are one space.

    Of twenty remainders 0 drops the row (0 copies), 1 empties its text, 2 takes out its ``.!?``, 3 doubles it and 4 makes it a user's.
    """
    space = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    role = F.when(kind == 4, "user").otherwise(space("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))
