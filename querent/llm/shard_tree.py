"""Sharding by a hierarchical weighted hash tree.

A key descends region, rack and shard. At each node every child draws -ln(u) / weight with
u from md5(key, child), and the least draw wins, so a child gets its share of the weight, and a
changed weight moves keys only into or out of that child's subtree. A node weighs the sum of its
shards. Growth opens a new region of one rack with the new shard, so a key that leaves a subtree
has nowhere to go but the new shard: the `key` law.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from querent.llm.runtime import cut

#: Shards in a rack and racks in a region of the part of the tree that is built first.
RACK, REGION = 5, 2
#: md5 digits that make a draw: 13 hexadecimal digits are 52 bits, exact as a double.
DIGITS = 13
#: Rows of a shard that one bucket ranks, about.
SLICE = 100_000


@dataclass(frozen=True)
class Tree:
    """nodes: (region, rack, shard, weight) of each shard."""

    leaves: tuple[tuple[int, int, int, float], ...]

    @classmethod
    def of(cls, shards: int, base: int | None = None, weights: dict[int, float] | None = None) -> "Tree":
        """base shards in full racks and regions; each one beyond opens a region of its own."""
        if shards < 1:
            raise ValueError("shards must be at least 1")
        base = min(shards, base or shards)
        first = -(-base // (RACK * REGION))
        where = lambda s: (s // (RACK * REGION), s // RACK) if s < base else (first + s - base, 10**6 + s)
        return cls(tuple((*where(s), s, float((weights or {}).get(s, 1.0))) for s in range(shards)))

    def children(self, level: int, parent: int | None) -> dict[int, float]:
        """Id and weight of the nodes of a level (0 regions, 1 racks, 2 shards) under a parent."""
        out: dict[int, float] = {}
        for leaf in self.leaves:
            if (level == 0 or leaf[level - 1] == parent) and leaf[3] > 0:
                out[leaf[level]] = out.get(leaf[level], 0.0) + leaf[3]
        return out


def _draw(key: Column, level: int, node: int, weight: float) -> Column:
    number = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"{level}:{node}"), key)), 1, DIGITS), 16, 10).cast("long")
    return -F.log((number.cast("double") + 0.5) / F.lit(float(16**DIGITS))) / F.lit(weight)


def _pick(key: Column, level: int, nodes: dict[int, float]) -> Column:
    if len(nodes) == 1:
        return F.lit(next(iter(nodes)))
    draws = F.array(*[F.struct(_draw(key, level, n, w).alias("d"), F.lit(n).alias("n")) for n, w in nodes.items()])
    return F.array_min(draws)["n"]


def place(df: DataFrame, key: str, tree: Tree, out: str) -> DataFrame:
    """Adds the shard of each row; a null key is placed as the empty text."""
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    at = "__node"
    df = df.withColumn(at, _pick(text, 0, tree.children(0, None)))
    for level in (1, 2):
        parents = list(tree.children(level - 1, None)) if level == 1 else list({leaf[1]: 0 for leaf in tree.leaves})
        step = None
        for p in parents:
            nodes = tree.children(level, p)
            if nodes:
                cond, value = F.col(at) == p, _pick(text, level, nodes)
                step = F.when(cond, value) if step is None else step.when(cond, value)
        df = df.withColumn(at, step)
    return df.withColumn(out, F.col(at).cast("int")).drop(at)


def shard_documents(docs: DataFrame, shards: int = 40, buckets: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of docs.

    Law `key`: doc_id and the shard count decide, whatever else a row holds; rows that repeat a doc_id
    share its shard. A null text is sized and summed as empty; a null doc_id is placed as the empty key
    and stays null. Columns besides doc_id and text are ignored; an empty table gives an empty table.
    Slots run from 0 in each shard by hash bucket, then doc_id (null first), text_crc32 and size; rows
    equal in all of these differ by slot only. No task sorts a whole shard: a slot is the rank within a
    (shard, bucket) plus the counts of the buckets before it.
    """
    # one more bucket for each SLICE rows of a shard, so that a rank's task stays small at any size
    buckets = buckets or max(8, docs.count() // (shards * SLICE))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = place(place(rows, "doc_id", Tree.of(shards), "shard"), "doc_id", Tree.of(shards + 1, shards), "grown_shard")
    spots = F.concat_ws(":", F.lit("slot"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_crc32"))
    rows = cut(rows.withColumn("bucket", (F.conv(F.substring(F.md5(spots), 1, 7), 16, 10).cast("long") % buckets).cast("int")), "shards")
    # shards * buckets counts at most, whatever the number of rows
    before = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = before.select("shard", "bucket", (F.sum("n").over(W.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("base"))
    rank = F.row_number().over(W.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")) - 1
    return (
        rows.withColumn("rank", rank)
        .join(F.broadcast(before), ["shard", "bucket"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("base") + F.col("rank")).cast("long").alias("slot"), "grown_shard")
    )
