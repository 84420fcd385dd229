"""Repair against an exhaustive search over all edits, and the SQL of the query."""

import hashlib
import random
import zlib

import duckdb
import pytest

from veridiff.llm import conversation_repair as R
from veridiff.llm.queries import ORACLE_SQL

ROWS = "conv_id long, turn long, role string, text string, cost string, best int"


def searched(rows):
    """(cost, audit, repaired lines) of the best of all edit sequences over rows of (role, text, fault)."""

    def fits(out):
        s = "".join(r[:1] or "?" for r, _ in out).removeprefix("s")
        return not out or (s and s == "ua" * (len(s) // 2))

    def grow(i, out, gap):
        """All (cost, audit, lines) from row i on, after ``out``."""
        s = "".join(r[:1] or "?" for r, _ in out)
        body = s.removeprefix("s")
        if body != ("ua" * len(body))[: len(body)]:
            return
        if i == len(rows) and fits(out):
            yield 0, "", out
        if gap < 2:
            for role in ("user", "assistant"):
                for c, a, o in grow(i, [*out, (role, "")], gap + 1):
                    yield c + 3, "I" + a, o
        if i < len(rows):
            role, text, fault = rows[i]
            for c, a, o in grow(i + 1, out, 0):
                yield c + 4, "D" + a, o
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                for c, a, o in grow(i + 1, [*out, (role, text)], 0):
                    yield c + more, "K" + a, o
                for other in ("user", "assistant"):
                    for c, a, o in grow(i + 1, [*out, (other, text)], 0):
                        yield c + 3 + more, "R" + a, o

    return min(grow(0, [], 0), key=lambda x: x[:2])


def expected(conv, rows):
    """A row of REPAIR from the rows of one conversation before damage."""
    after = []
    for turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        after += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults, seen = [], set()
    for _, role, text in after:
        end = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = {t for t, _, _ in after if t is not None}
    cost, audit, out = searched([(r, t, f) for (_, r, t), f in zip(after, faults)])
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(after, after[1:])]
    return (
        conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest(),
    )


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = [(None, 3, "user", "No id."), (None, None, None, None), (None, 3, "user", "No id.")]
    for conv in range(250):
        for turn in range(rng.randrange(1, 6)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            text = rng.choice(["Yes.", "No!", "cut off", "é. \t\n", "", " \x0b", None, "Yes.", " ", "😀"])
            out.append((conv, rng.choice([turn, turn, turn * 3, None, 1]), role, text))
    return out


@pytest.mark.parametrize("segment,batch", [(512, 8192), (1, 8192), (2, 5)])
def test_repair(spark, rows, monkeypatch, segment, batch):
    if segment < 512:  # _run reads its bounds where it runs
        monkeypatch.setattr(R, "SEGMENT", segment)
        monkeypatch.setattr(R, "BATCH_ROWS", batch)
        import pyarrow as pa

        whole = {}
        for conv, turn, role, text in rows:
            whole.setdefault(conv, []).append((turn, role, text))
        flagged = spark.createDataFrame([(*r, "x", 1) for r in rows], ROWS)
        got = {}
        monkeypatch.setattr(type(flagged), "mapInArrow", lambda self, f, schema: self)
        table = R.repair(R.damaged(flagged)).coalesce(1).toPandas()
        table["key"] = table["conv_id"].fillna(-1)
        table = table.groupby("key", sort=False).apply(lambda x: x, include_groups=False).reset_index(drop=True)
        for out in R._run(iter(pa.Table.from_pandas(table, schema=pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("n", pa.int64()), ("seen", pa.bool_()), ("blank", pa.bool_()), ("truncated", pa.bool_())])).to_batches(7))):
            got |= {r["conv_id"]: tuple(r.values()) for r in out.to_pylist()}
    else:
        docs = spark.createDataFrame([(*r, "x", 1) for r in rows], ROWS).repartition(3)
        got = {r.conv_id: tuple(r) for r in R.repair(R.damaged(docs)).collect()}
    by_conv = {}
    for conv, turn, role, text in rows:
        by_conv.setdefault(conv, []).append((turn, role, text))
    assert set(got) == set(by_conv)
    for conv, own in by_conv.items():
        assert got[conv] == expected(conv, own), own


def test_long_and_edges(spark):
    assert R.repair(R.damaged(spark.createDataFrame([], ROWS))).collect() == []
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.", "", 0) for t in range(2000)] + [(2, 0, "user", "x" * 3_000_000 + ".", "", 0), (2, 1, "assistant", "Fine.", "", 0)]
    got = {r.conv_id: r for r in R.repair(spark.createDataFrame(rows, ROWS)).collect()}
    assert got[1].audit == "K" * 2000 and got[1].cost == 0 and got[1].repaired_sha256 == hashlib.sha256("\n".join(f"{r[2]}:{r[3]}" for r in rows[:2000]).encode()).hexdigest()
    assert got[2].audit == "KK"
    crowd = spark.createDataFrame([(7, 1, "user", "Again.", "", 0)] * 3000 + [(7, 2, "assistant", "Once.", "", 0)], ROWS)
    (row,) = R.repair(crowd).collect()
    assert (row.duplicate, row.illegal, row.cost, row.audit) == (2999, 2999, 4 * 2999, "K" + "D" * 2999 + "K")


def test_sql(spark, rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    by_conv = {}
    for conv, turn, role, text in rows:
        by_conv.setdefault(conv, []).append((turn, role, text))
    got = con.execute(f"SELECT conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 FROM ({ORACLE_SQL['op12_conversation_repair']})").fetchall()
    assert sorted(got, key=str) == sorted((expected(c, own) for c, own in by_conv.items()), key=str)
