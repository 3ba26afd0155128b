"""Approximate nearest neighbours by counting collisions of single projections.

The vectors are dealt by hash into shards of about SHARD vectors. A shard keeps HASHES sorted arrays, one
for each random projection. Around a query's own projections, windows of half-width r collide with the
vectors in them; a vector that collides in THRESHOLD of the arrays is verified by its true cosine. Virtual
rehashing: while fewer than WANT vectors are found, or the k-th best is farther than what a window of this
width makes likely, r grows by GROWTH, and only what the wider windows add is counted. Equal vectors are
one entry that keeps its least ids, so copies cost nothing and ties stay exact. Queries come in blocks of
about BLOCK, each of which meets each shard, so a task holds one shard and one block however many rows there are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SHARD, BLOCK, HASHES, THRESHOLD, START, GROWTH, WANT = 8192, 8192, 32, 18, 0.5, 1.6, 60
#: Half-widths of a window, in distances, at which a vector is all but sure to reach the threshold.
REACH = 1.1


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def lengths(rows: np.ndarray) -> np.ndarray:
    return np.sqrt((rows * rows).sum(axis=1))


def cosine(a: np.ndarray, b: np.ndarray, size: np.ndarray | None = None) -> np.ndarray:
    """Cosines of b's rows with the vector a, each a function of the two vectors alone; size: lengths(b), if known."""
    return (b * a).sum(axis=1) / ((lengths(b) if size is None else size) * lengths(a[None])[0])


class Shard:
    def __init__(self, ids: np.ndarray, rows: np.ndarray, k: int, seed: int = 3):
        """ids and finite, non-zero rows; ids of equal rows are kept up to the k + 1 least."""
        order = np.lexsort((ids, *rows.T[::-1]))
        ids, rows = ids[order], rows[order]
        new = np.concatenate(([True], (rows[1:] != rows[:-1]).any(axis=1))) if len(rows) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        self.rows = rows[first]
        ends = np.append(first[1:], len(rows))
        self.ids = [ids[a : min(b, a + k + 1)] for a, b in zip(first.tolist(), ends.tolist())]
        self.size = lengths(self.rows)
        self.k, dim = k, rows.shape[1] if len(rows) else 1
        self.planes = np.random.default_rng(seed).standard_normal((HASHES, dim))
        points = unit(self.rows) @ self.planes.T if len(rows) else np.zeros((0, HASHES))
        # the sorted arrays stand end to end, each moved beyond all windows of the one before, so one search serves all
        self.reach = float(np.sqrt((self.planes**2).sum(axis=1)).max()) + 1
        self.starts = np.arange(HASHES) * (4 * self.reach)
        self.order = np.argsort(points, axis=0, kind="stable").T.reshape(-1)
        self.sorted = (np.sort(points, axis=0) + self.starts).T.reshape(-1)

    def _edge(self, scores: np.ndarray) -> float:
        """The (k + 1)-th largest, or the least of fewer."""
        at = max(0, len(scores) - self.k - 1)
        return np.partition(scores, at)[at]

    def near(self, query: np.ndarray) -> list[tuple[int, float]]:
        """Up to k + 1 of the nearest found, nearest first, ties to the smaller id."""
        n = len(self.rows)
        if not n:
            return []
        spot = unit(query[None])[0] @ self.planes.T + self.starts
        lo = hi = np.searchsorted(self.sorted, spot)
        count, scores, radius = np.zeros(n, np.int16), np.full(n, -np.inf), START
        while True:
            # a window as wide as 2 * reach holds a whole array and nothing of its neighbours
            width = min(radius, 2 * self.reach)
            a, b = np.searchsorted(self.sorted, spot - width), np.searchsorted(self.sorted, spot + width, side="right")
            parts = [self.order[x:y] for x, y in zip(np.concatenate((a, hi)).tolist(), np.concatenate((lo, b)).tolist())]
            count += np.bincount(np.concatenate(parts), minlength=n).astype(np.int16)
            lo, hi = a, b
            fresh = np.flatnonzero((count >= THRESHOLD) & np.isinf(scores))
            if len(fresh):
                scores[fresh] = cosine(query, self.rows[fresh], self.size[fresh])
            found = np.flatnonzero(np.isfinite(scores))
            if len(found) == n or (b - a == n).all():
                break
            if len(found) >= min(n, WANT):
                # a vector at distance d stays within r in a share erf(r / (d sqrt 2)) of the arrays
                best = self._edge(scores[found])
                distance = np.sqrt(max(0.0, 2 - 2 * best))
                if radius >= REACH * distance:
                    break
            radius *= GROWTH
        if (hi - lo == n).all() and len(found) < n:
            rest = np.flatnonzero(np.isinf(scores))
            scores[rest] = cosine(query, self.rows[rest], self.size[rest])
            found = np.arange(n)
        # entries tied with the last place count too
        top = found[scores[found] >= self._edge(scores[found])]
        out = sorted((-float(scores[t]), int(i)) for t in top for i in self.ids[t])
        return [(i, -s) for s, i in out[: self.k + 1]]


def _matrix(col: pa.ChunkedArray) -> np.ndarray:
    """Rows of equally long lists without nulls, from Arrow's flat buffer."""
    return col.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def nearest(table: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for rows whose id is divisible by every, the k nearest other rows found.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do null ids. Vectors
    of another length than the query's aren't compared with it. Of rows that repeat an id and vector one counts; rows that
    repeat an id with other vectors are candidates of their own, none of them for a query of that id. With
    fewer than k candidates all are returned; a query without candidates returns no row.
    """
    spark = table.sparkSession
    values = F.transform(F.col(vector), lambda x: x.cast("double"))
    fine = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    rows = table.select(F.col(id_col).cast("long").alias("id"), values.alias("v")).where(F.col("id").isNotNull() & fine).withColumn("dim", F.size("v"))
    asks = F.col("id") % every == 0
    n_rows, n_asking = table.select(F.count("*"), F.count(F.when(F.col(id_col).cast("long") % every == 0, 1))).first()
    shards, blocks = max(1, -(-n_rows // SHARD)), max(1, -(-n_asking // BLOCK))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    # each block of queries meets each shard: the stated query set against all rows, block by block
    stored = rows.select("id", "v", "dim", F.lit(False).alias("asks"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(shards)).alias("shard"), upto(blocks).alias("block"))
    asking = rows.where(asks).dropDuplicates(["id", "v"])
    asking = asking.select("id", "v", "dim", F.lit(True).alias("asks"), upto(shards).alias("shard"), F.pmod(F.xxhash64("id", F.lit(2)), F.lit(blocks)).alias("block"))

    def search(part: pa.Table) -> pa.Table:
        asks = part.column("asks").to_numpy()
        mine = part.filter(pa.array(~asks))
        out: list[tuple[int, int, float]] = []
        if mine.num_rows and asks.any():
            held = Shard(mine.column("id").to_numpy(), _matrix(mine.column("v")), k)
            ask = part.filter(pa.array(asks))
            known: dict[bytes, list[tuple[int, float]]] = {}
            for i, q in zip(ask.column("id").to_pylist(), _matrix(ask.column("v"))):
                # one more than k for all queries of this vector; each then leaves its own id out
                if q.tobytes() not in known:
                    known[q.tobytes()] = held.near(q)
                found = [(v, s) for v, s in known[q.tobytes()] if v != i]
                out += [(i, v, s) for v, s in found[:k]]
        ids, near, score = zip(*out) if out else ((), (), ())
        return pa.table({"query_id": pa.array(ids, pa.int64()), "vec_id": pa.array(near, pa.int64()), "score": pa.array(score, pa.float64())})

    found = stored.unionByName(asking).groupBy("shard", "block", "dim").applyInArrow(search, "query_id long, vec_id long, score double").distinct()
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
