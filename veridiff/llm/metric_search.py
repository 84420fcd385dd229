"""Exact top-k search by inner product with M-trees searched best first.

Vectors are dealt to *cells* by their nearest pivot (at most ``PIVOTS`` pivots, from a bounded sample by hash) and within a cell to
trees of about ``MOST`` rows by a hash of vec_id, so that no cell is too large for a task however many vectors are alike. Each tree is bulk-loaded into paged nodes. An inner
page holds routing objects with their covering radius and their distance to the parent's routing object; a leaf page holds
distinct vectors with their distances to its routing object. Equal vectors are one entry with all their ids in order.

For a query q and a routing object c whose ball has radius r, no vector below has an inner product above
q.c + |q| r. Each query opens its page with the highest bound first, and ends when that bound falls below its k-th score
so far. Before q.c is computed at all, the stored distance d to the parent p bounds it by q.p + |q| (d + r), and a leaf's entries by
q.p + |q| d; what cannot reach the k-th score is not computed. Queries that open the same page at the same time share one matrix product.
Scores are exact integers; bounds are compared with a slack for rounding and keep ties.

All trees share a bound: each query first searches one tree of its own cell; its k-th score there goes along to
the others, and it is sent only to cells whose ball (pivot and covering radius, at most ``PIVOTS`` rows, broadcast) can still reach it. Where the data have no
metric structure (random directions) every ball reaches everything and the search costs queries times vectors.

Defined cases. Vectors that are null, or hold null or non-finite components (also after the factor), take no part; empty vectors have length 0 and score 0.
Vectors meet only vectors of their own length. Null vec_id: no part. Rows that repeat a vec_id: each is an entry, none is
matched with its own id; queries that repeat one are ranked together, as one query with several vectors. Scores beyond a signed 64-bit integer are an error.
Empty tables give empty tables. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

MOST, LEAST, BLOCK, PAGE, FANOUT, PIVOTS, TASKS = 65_536, 2_048, 8_192, 512, 16, 1_024, 24
RESULT = "query_id long, vec_id long, score long"


def quantized(embedding, factor: int = 64) -> np.ndarray | None:
    """floor(factor * x) of each component, or None when the vector takes no part."""
    if embedding is None:
        return None
    with np.errstate(over="ignore"):
        x = np.floor(factor * np.array([np.nan if v is None else v for v in embedding], np.float64))
    return x if np.isfinite(x).all() else None


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of integers held in doubles: doubles, or integers where doubles could round."""
    if not q.size or not x.size:
        return np.zeros((len(q), len(x)))
    most = float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1]
    if most < 2**52:
        return q @ x.T
    if most < 2**62:
        return q.astype(np.int64) @ x.astype(np.int64).T
    whole = [[sum(int(u) * int(v) for u, v in zip(a, b)) for b in x] for a in q]
    return np.array(whole, np.int64)  # an error beyond 64 bits


def _floor(score: np.ndarray) -> np.ndarray:
    """Integers as doubles, none above its integer."""
    x = score.astype(float)
    return np.where(np.abs(x) < 2**53, x, np.nextafter(x, -np.inf))


class Tree:
    """An M-tree over the rows of ``x`` (integers in doubles)."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, page: int = PAGE, fanout: int = FANOUT) -> None:
        order = np.argsort(ids, kind="stable")
        self.x, inverse = np.unique(x[order], axis=0, return_inverse=True)
        inverse = inverse.reshape(-1)
        by = np.argsort(inverse, kind="stable")
        self.ids = ids[order][by]
        ends = np.cumsum(np.bincount(inverse, minlength=len(self.x)))
        self.id_from, self.id_to = ends - np.diff(ends, prepend=0), ends
        self.norms = (self.x**2).sum(axis=1)
        self.pages: list[tuple] = []  # (leaf?, members or child pages, routing objects, radii, distances to the parent)
        sizes = ends - self.id_from
        self.repeats = np.zeros(len(self.x), np.int64)  # of the id that a vector's rows repeat most
        _, first, times = np.unique(np.stack([np.repeat(np.arange(len(self.x)), sizes), self.ids]), axis=1, return_index=True, return_counts=True)
        np.maximum.at(self.repeats, np.repeat(np.arange(len(self.x)), sizes)[first], times)
        self.most_repeated = int(np.unique(ids, return_counts=True)[1].max()) if len(ids) else 0
        self.root = self._load(np.arange(len(self.x)), 0, page, fanout)[0] if len(self.x) else -1

    def _far(self, members: np.ndarray, c: int) -> np.ndarray:
        d = self.norms[members] + self.norms[c] - 2 * (self.x[members] @ self.x[c])
        return np.sqrt(np.maximum(d, 0))

    def _load(self, members: np.ndarray, c: int, page: int, fanout: int) -> tuple[int, float]:
        """Page number of the subtree over ``members`` with the routing object ``c``, and its covering radius."""
        far = self._far(members, c)
        if len(members) <= page:
            near = np.argsort(far, kind="stable")
            self.pages.append((True, members[near], c, None, far[near]))
            return len(self.pages) - 1, float(far.max())
        kids, routes, radii = [], [], []
        for own in self._parts(members, min(fanout, -(-len(members) // page))):
            centre = own[((self.x[own] - self.x[own].mean(axis=0)) ** 2).sum(axis=1).argmin()]  # the member nearest to the mean routes
            kid, radius = self._load(own, int(centre), page, fanout)
            kids.append(kid)
            routes.append(int(centre))
            radii.append(radius)
        routes = np.array(routes)
        self.pages.append((False, np.array(kids), routes, np.array(radii), self._far(routes, c)))
        return len(self.pages) - 1, float(far.max())

    def _parts(self, members: np.ndarray, k: int) -> list[np.ndarray]:
        """``members`` in k parts of like size, halved again and again along the line between two that are far apart."""
        if k < 2:
            return [members]
        one = members[self._far(members, int(members[0])).argmax()]
        other = members[self._far(members, int(one)).argmax()]
        order = np.argsort(self._far(members, int(one)) - self._far(members, int(other)), kind="stable")
        cut = len(members) * (k // 2) // k
        return self._parts(members[order[:cut]], k // 2) + self._parts(members[order[cut:]], k - k // 2)

    def search(self, q: np.ndarray, own: np.ndarray, k: int, least: np.ndarray | None = None, count: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each row of ``q`` the k best entries without the row's ``own`` id, ties to the smaller id: (row, vec_id, score), rows ascending, best first.

        ``least`` holds a score for each row below which nothing is asked for. ``count`` gets the number of products computed.
        """
        kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        if self.root < 0 or not len(q):
            return kept
        least = np.full(len(q), -np.inf) if least is None else least.astype(float)
        norm = np.sqrt((q**2).sum(axis=1))
        slack = 1e-6 * (1 + norm * float(np.sqrt(self.norms.max())))
        bound = np.full((len(q), len(self.pages)), -np.inf)
        at = np.zeros((len(q), len(self.pages)))
        bound[:, self.root] = np.inf
        at[:, self.root] = products(q, self.x[:1])[:, 0]
        computed = len(q)
        while True:
            page = bound.argmax(axis=1)
            best = bound[np.arange(len(q)), page]
            rows = np.flatnonzero((best > -np.inf) & (best >= least - slack))
            if not len(rows):
                break
            rows = rows[np.argsort(page[rows], kind="stable")]
            cuts = np.flatnonzero(np.diff(page[rows])) + 1
            found = []
            for group in np.split(rows, cuts):
                number = int(page[group[0]])
                bound[group, number] = -np.inf
                leaf, members, routes, radii, dist = self.pages[number]
                reach = at[group, number][:, None] + norm[group][:, None] * (dist if leaf else dist + radii)[None, :]
                may = reach >= (least - slack)[group][:, None]
                some = np.flatnonzero(may.any(axis=0))
                if not len(some):
                    continue
                score = products(q[group], self.x[members[some] if leaf else routes[some]])
                computed += score.size
                if leaf:
                    enough = k + self.most_repeated  # vectors among which k are not all the row's own
                    if score.shape[1] > enough and (least[group] == -np.inf).any():
                        last = np.partition(score, score.shape[1] - enough, axis=1)[:, score.shape[1] - enough]
                        r, m = np.nonzero(score >= np.maximum(last, least[group])[:, None])
                    else:
                        r, m = np.nonzero(score >= least[group][:, None])
                    found.append((group[r], members[some][m], score[r, m].astype(np.int64)))
                else:
                    kids = members[some]
                    at[group[:, None], kids[None, :]] = score
                    bound[group[:, None], kids[None, :]] = np.where(may[:, some], score + norm[group][:, None] * radii[some][None, :], -np.inf)
            if found:
                kept = self._best(kept, *(np.concatenate(x) for x in zip(*found)), own, k)
                full = np.flatnonzero(np.bincount(kept[0], minlength=len(q)) >= k)
                last = np.searchsorted(kept[0], full, "right") - 1
                least[full] = np.maximum(least[full], _floor(kept[2][last]))
        if count is not None:
            count.append(computed)
        return kept

    def _best(self, kept: tuple, row: np.ndarray, member: np.ndarray, score: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``kept`` with the ids of further entries, of each row the first k."""
        size = np.minimum(self.id_to[member] - self.id_from[member], k + self.repeats[member])  # enough, whichever of them is the own id
        ends = np.cumsum(size)
        ids = self.ids[np.repeat(self.id_from[member] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        row, score = np.repeat(row, size), np.repeat(score, size)
        other = ids != own[row]
        row, ids, score = (np.concatenate((x, y[other])) for x, y in zip(kept, (row, ids, score)))
        order = np.lexsort((ids, -score, row))
        row, ids, score = row[order], ids[order], score[order]
        first = np.searchsorted(row, row, "left")
        top = np.arange(len(row)) - first < k
        return row[top], ids[top], score[top]


def _zip(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x, np.float64).tobytes())


def _matrix(row_ids: bytes, body: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(bytes(row_ids), np.int64)
    return ids, np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(body)), np.float64).reshape(len(ids), dim)


def _pivots(rows: DataFrame, n: int, most: int) -> dict[int, np.ndarray]:
    """Pivots by vector length, numbered over all lengths: vectors of a sample of at most ``PIVOTS`` rows by hash."""
    few = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(int(min(PIVOTS, max(1, n // most)))).collect()
    by: dict[int, list[np.ndarray]] = {}
    for r in few:
        x = quantized(r["embedding"])
        if x is not None:
            by.setdefault(len(x), []).append(x)
    return {dim: np.array(xs) for dim, xs in by.items()}


def _nearest(x: np.ndarray, pivots: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Number and distance of each row's nearest pivot; without one the origin is the only one."""
    if pivots is None:
        return np.zeros(len(x), np.int64), np.sqrt((x**2).sum(axis=1))
    d = (x**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None, :] - 2 * (x @ pivots.T)
    near = d.argmin(axis=1)
    return near, np.sqrt(np.maximum(d[np.arange(len(x)), near], 0))


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query row the k rows with the highest scores."""
    spark = vectors.sparkSession
    C.small_batches(spark)
    rows = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.coalesce(is_query, F.lit(False)).alias("asks"))
    n = rows.count()
    most = min(most, max(LEAST, -(-n // TASKS)))
    sent = spark.sparkContext.broadcast(_pivots(rows, n, most))
    schema = "dim int, cell int, far double, vec_id long, asks boolean, body binary"

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            xs = [quantized(e) for e in batch["embedding"]]
            for dim in sorted({len(x) for x in xs if x is not None}):
                at = [i for i, x in enumerate(xs) if x is not None and len(x) == dim]
                x = np.array([xs[i] for i in at]).reshape(len(at), dim)
                cell, far = _nearest(x, sent.value.get(dim))
                yield pd.DataFrame({"dim": dim, "cell": cell, "far": far, "vec_id": batch["vec_id"].iloc[at].to_numpy(), "asks": batch["asks"].iloc[at].to_numpy(), "body": [r.tobytes() for r in x]})

    dealt = C.materialize(rows.mapInPandas(C.tidy(deal), schema), "vectors")
    cells = {(r["dim"], r["cell"]): (r["n"], r["far"]) for r in dealt.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}  # at most PIVOTS rows and one for each further length
    if not cells:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sizes = spark.createDataFrame([(d, c, -(-size // most)) for (d, c), (size, _) in cells.items()], "dim int, cell int, trees long")

    def pack(key, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(map(bytes, pdf["body"])), np.float64).reshape(len(pdf), key[0])
        return pd.DataFrame({"dim": [key[0]], "cell": [key[1]], "part": [key[2]], "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "body": [_zip(x)]})

    packed = "dim int, cell int, part long, ids binary, body binary"
    placed = dealt.join(F.broadcast(sizes), ["dim", "cell"]).select("dim", "cell", F.pmod(F.xxhash64("vec_id"), "trees").alias("part"), "vec_id", "body")
    trees = C.materialize(placed.groupBy("dim", "cell", "part").applyInPandas(pack, packed), "trees")
    asking = dealt.where("asks").withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(max(1, -(-n // block)))))
    asked = C.materialize(asking.groupBy("dim", "cell", "part").applyInPandas(pack, packed), "query-blocks")

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The queries with their k-th scores in one tree of their own cell."""
        for batch in batches:
            for r in batch.itertuples(index=False):
                q_ids, q = _matrix(r.q_ids, r.q_body, r.dim)
                least = np.full(len(q), -np.inf)
                if r.ids is not None:
                    ids, x = _matrix(r.ids, r.body, r.dim)
                    row, _, score = Tree(x, ids).search(q, q_ids, k)
                    full = np.flatnonzero(np.bincount(row, minlength=len(q)) >= k)
                    least[full] = _floor(score[np.searchsorted(row, full, "right") - 1])
                yield pd.DataFrame({"dim": [r.dim], "q_ids": [r.q_ids], "q_body": [r.q_body], "least": [least.tobytes()]})

    ball = spark.sparkContext.broadcast({key: far for key, (_, far) in cells.items()})

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """For each cell the queries that its ball may answer."""
        for batch in batches:
            for r in batch.itertuples(index=False):
                q_ids, q = _matrix(r.q_ids, r.q_body, r.dim)
                least, norm = np.frombuffer(bytes(r.least), np.float64), np.sqrt((q**2).sum(axis=1))
                pivots = sent.value.get(r.dim)
                for (dim, cell), far in ball.value.items():
                    if dim == r.dim:
                        middle = np.zeros(dim) if pivots is None else pivots[cell]
                        top = q @ middle + norm * far
                        may = np.flatnonzero(top + 1e-6 * (1 + norm * (far + float(np.sqrt((middle**2).sum())))) >= least)
                        if len(may):
                            yield pd.DataFrame({"dim": [dim], "cell": [cell], "q_ids": [q_ids[may].tobytes()], "q_body": [_zip(q[may])], "least": [least[may].tobytes()]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, tree = None, None
        for batch in batches:
            for r in batch.itertuples(index=False):
                if (r.dim, r.cell, r.part) != last:
                    last, tree = (r.dim, r.cell, r.part), Tree(*_matrix(r.ids, r.body, r.dim)[::-1])
                q_ids, q = _matrix(r.q_ids, r.q_body, r.dim)
                for s in range(0, len(q), 2048):
                    row, ids, score = tree.search(q[s : s + 2048], q_ids[s : s + 2048], k, np.frombuffer(bytes(r.least), np.float64)[s : s + 2048])
                    yield pd.DataFrame({"query_id": q_ids[s : s + 2048][row], "vec_id": ids, "score": score})

    tasks = max(C.shuffle_partitions(spark), sum(-(-size // most) for size, _ in cells.values()))
    ask = asked.select("dim", "cell", F.col("ids").alias("q_ids"), F.col("body").alias("q_body"))
    own = ask.join(trees.where("part = 0"), ["dim", "cell"], "left").select("dim", "ids", "body", "q_ids", "q_body").repartition(C.shuffle_partitions(spark))
    bounded = C.materialize(own.mapInPandas(C.tidy(first), "dim int, q_ids binary, q_body binary, least binary"), "bounded-queries")
    sent_queries = "dim int, cell int, q_ids binary, q_body binary, least binary"

    def join_blocks(key, pdf: pd.DataFrame) -> pd.DataFrame:
        body = np.concatenate([_matrix(i, b, key[0])[1] for i, b in zip(pdf["q_ids"], pdf["q_body"])])
        return pd.DataFrame({"dim": [key[0]], "cell": [key[1]], "q_ids": [b"".join(map(bytes, pdf["q_ids"]))], "q_body": [_zip(body)], "least": [b"".join(map(bytes, pdf["least"]))]})

    # what the home cells send to one cell travels on as blocks of queries, not as a row from each
    blocks = max(1, -(-n // (20 * block)))
    wide = bounded.mapInPandas(C.tidy(send), sent_queries).withColumn("salt", F.pmod(F.xxhash64("q_ids"), F.lit(blocks)))
    wide = wide.groupBy("dim", "cell", "salt").applyInPandas(join_blocks, sent_queries)
    meet = trees.join(wide, ["dim", "cell"]).select("dim", "cell", "part", "ids", "body", "q_ids", "q_body", "least").repartition(tasks, "dim", "cell", "part").sortWithinPartitions("dim", "cell", "part")
    found = meet.mapInPandas(C.tidy(run), RESULT)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
