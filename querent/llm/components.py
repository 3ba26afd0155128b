"""Connected components: tasks join their links into trees; while that takes several tasks, large and small stars alternate between them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querent.llm.runtime import cut, drop_cut

#: Links that a task joins into trees at once.
TREE_LINKS = 200_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v), u > v. Large: each node's larger neighbours point to the least of its neighbourhood. Small: its smaller ones do, and itself."""
    near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    out = near.join(least, "u")
    out = out.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else out.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same components by fewer links: of TREE_LINKS links at a time, one from each node to the least id of its tree."""
    held = 0
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def out() -> pa.RecordBatch:
        ids = [i for i in parent if top(i) != i]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([top(i) for i in ids], pa.int64())], ["u", "v"])

    for batch in batches:
        if held and held + batch.num_rows > TREE_LINKS:
            yield out()
            parent.clear()
            held = 0
        held += batch.num_rows
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            x, y = top(a), top(b)
            parent[max(x, y)] = min(x, y)
    yield out()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node that has an edge (a, b) to another; component is the least id reachable.

    There are as many tasks as links need. The trees of a single task are the components; with several, a turn
    of stars makes fewer links of them. Alternating stars end on any graph, so turns aren't limited.
    """
    spark = edges.sparkSession
    given = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    now = cut(given.mapInArrow(_trees, "u long, v long").distinct(), "edges")
    sums = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    mark = sums(now)
    while mark[0] > TREE_LINKS:
        after = cut(_star(_star(now, True), False), "edges")
        last, mark = mark, sums(after)
        drop_cut(spark, now)
        now = after
        if last == mark:
            break
    else:
        now = cut(now.coalesce(1).mapInArrow(_trees, "u long, v long"), "edges")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
