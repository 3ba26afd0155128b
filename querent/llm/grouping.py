"""Best-fit packing by a grouping genetic algorithm: documents in as few sequences as it can.

Only a document of more than WINDOW ids is cut: into pieces of WINDOW, of which the first may be shorter. Whole
pieces are sequences by themselves; the first pieces are packed. They are dealt at random into shards of about SHARD,
so hot sources and copies are spread. A shard is evolved on ISLANDS islands: an individual is a grouping of the
shard's pieces into bins. Crossover injects whole well-filled bins of one parent into the other, takes out the bins
that hold the same pieces, and best-fits what these displace; mutation empties badly filled bins. After an epoch an
island's best one moves to the next island, through a shuffle. A shard whose bins are as few as its ids allow is done.
The worst-filled bins of all shards are packed again together, level by level, until one shard is left.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querent.llm import byte_bpe, textscan
from querent.llm.runtime import cut
from querent.llm.textscan import tidied

WINDOW, END = 2048, 0
#: Pieces of a shard, bins of it that the next level may take, islands, individuals of one, epochs, crossovers in one.
SHARD, OPEN, ISLANDS, INDIVIDUALS, EPOCHS, CROSSOVERS = 4096, 8, 4, 6, 3, 20
_STATE = "shard long, island int, bins long, done boolean, sizes binary, population array<binary>"


def best_fit(group: np.ndarray, sizes: np.ndarray, items: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """group with the items placed, in their order: each in the fullest bin that it fits in, or else in a new one.

    group: a bin for each item; those of items don't count before.
    """
    out = group.copy()
    held = np.ones(len(group), bool)
    held[items] = False
    fill = np.bincount(group[held], sizes[held]).astype(np.int64)
    by_room: list[list[int]] = [[] for _ in range(window + 1)]
    for b in np.flatnonzero(fill).tolist():
        by_room[window - int(fill[b])].append(b)
    rooms = sum(1 << r for r, bins in enumerate(by_room) if bins)  # bit r: some bin has room r
    new = len(fill)
    for item in items.tolist():
        size = int(sizes[item])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b, new = window, new, new + 1
        out[item] = b
        by_room[room - size].append(b)
        rooms |= 1 << (room - size)
    return out


def worth(group: np.ndarray, sizes: np.ndarray) -> tuple[int, float]:
    """Less is better: the number of bins, then how evenly they are filled (full and empty is best)."""
    fill = np.bincount(group, sizes)
    return int((fill > 0).sum()), -float((fill * fill).sum())


def crossed(into: np.ndarray, of: np.ndarray, sizes: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A child of two groupings: whole well-filled bins of one in the other, whose bins with the same pieces go;
    what these displace is best-fitted, large pieces first."""
    fill = np.bincount(of, sizes)
    good = np.flatnonzero(fill >= np.median(fill[fill > 0]))
    chosen = np.zeros(len(fill), bool)
    chosen[rng.choice(good, max(1, len(good) // int(rng.integers(2, 6))), replace=False)] = True
    injected = chosen[of]
    broken = np.zeros(int(into.max()) + 1, bool)
    broken[into[injected]] = True
    child = np.where(injected, of + len(broken), into)
    displaced = np.flatnonzero(broken[into] & ~injected)
    return compact(best_fit(child, sizes, displaced[np.lexsort((rng.random(len(displaced)), -sizes[displaced]))]))


def mutated(group: np.ndarray, sizes: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The worst-filled bins and some others are emptied, and their pieces best-fitted in a random order."""
    fill = np.bincount(group, sizes)
    used = np.flatnonzero(fill)
    emptied = np.zeros(len(fill), bool)
    emptied[used[np.argsort(fill[used], kind="stable")[:3]]] = True
    emptied[rng.choice(used, min(len(used), 6), replace=False)] = True
    return compact(best_fit(group, sizes, rng.permutation(np.flatnonzero(emptied[group]))))


def compact(group: np.ndarray) -> np.ndarray:
    return np.unique(group, return_inverse=True)[1].astype(np.int32)


def fewest(sizes: np.ndarray, window: int = WINDOW) -> int:
    """No grouping has fewer bins: pieces over half a window are alone, and all need room."""
    return max(-(-int(sizes.sum()) // window), int((2 * sizes > window).sum()))


def beginners(sizes: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
    """The first population: best-fit of the large pieces first, and of ever more shuffled orders."""
    none = np.zeros(len(sizes), np.int32)
    noise = [0.0, *np.geomspace(0.01, 1.0, INDIVIDUALS - 1)]
    return [compact(best_fit(none, sizes, np.argsort(-sizes * (1 - x * rng.random(len(sizes))), kind="stable"))) for x in noise]


def evolved(sizes: np.ndarray, population: list[np.ndarray], rng: np.random.Generator) -> list[np.ndarray]:
    """An epoch: children replace the worst, until the fewest bins that can be are reached. The best comes first."""
    least = fewest(sizes)
    ranked = sorted(((worth(g, sizes), k, g) for k, g in enumerate(population)), key=lambda x: x[:2])
    for n in range(CROSSOVERS):
        if ranked[0][0][0] <= least:
            break
        a, b = sorted(rng.choice(len(ranked), 2, replace=False).tolist()) if len(ranked) > 1 else (0, 0)
        child = crossed(ranked[a][2], ranked[b][2], sizes, rng)
        if n % 2:
            child = mutated(child, sizes, rng)
        ranked[-1] = (worth(child, sizes), len(ranked) + n, child)
        ranked.sort(key=lambda x: x[:2])
    return [g for _, _, g in ranked]


def _tokenise(path: str, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, row = byte_bpe.tokenizer(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            data, offsets = textscan.utf8(batch.column("text"))
            for first, last in textscan.blocks(offsets, 1_000_000):
                base = offsets[first]
                ids, at = encoder.encode(data[base : offsets[last]], offsets[first : last + 1] - base)
                sizes, sums, kept = [], [], []
                for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
                    own = np.append(ids[lo:hi], END).astype("<u4")
                    head = (len(own) - 1) % WINDOW + 1
                    sizes.append(len(own))
                    sums.append([zlib.crc32(own[max(0, k) : k + WINDOW].tobytes()) for k in range(head - WINDOW, len(own), WINDOW)])
                    kept.append(own.tobytes() if keep_ids else None)
                rows = (part << 32) + row + np.arange(last - first)
                row += last - first
                yield pa.RecordBatch.from_arrays([pa.array(rows), batch.column("doc_id").slice(first, last - first), pa.array(sizes, pa.int64()), pa.array(sums, pa.list_(pa.int64())), pa.array(kept, pa.binary())], ["row", "doc_id", "tokens", "sums", "ids"])

    return tidied(run)


def _dealt(pieces: DataFrame, shards: int) -> DataFrame:
    """(row, size, shard) of (row, size)."""
    return pieces.select("row", "size", F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard"))


def _order(table: pa.Table) -> pa.Table:
    return table.sort_by([("size", "descending"), ("row", "ascending")])


def _begin(table: pa.Table) -> pa.Table:
    """A shard's islands with their first populations."""
    sizes = _order(table).column("size").to_numpy().astype(np.int64)
    shard = table.column("shard")[0].as_py()
    rows = []
    for island in range(ISLANDS):
        population = beginners(sizes, np.random.default_rng([shard, island]))
        population.sort(key=lambda g: worth(g, sizes))
        bins = worth(population[0], sizes)[0]
        rows.append({"shard": shard, "island": island, "bins": bins, "done": bins <= fewest(sizes), "sizes": sizes.astype(np.int32).tobytes(), "population": [g.tobytes() for g in population]})
        if rows[-1]["done"]:
            break
    return pa.Table.from_pylist(rows, _schema())


def _schema() -> pa.Schema:
    return pa.schema([("shard", pa.int64()), ("island", pa.int32()), ("bins", pa.int64()), ("done", pa.bool_()), ("sizes", pa.binary()), ("population", pa.list_(pa.binary()))])


def _epoch(number: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                sizes = np.frombuffer(r["sizes"], np.int32).astype(np.int64)
                population = evolved(sizes, [np.frombuffer(g, np.int32) for g in r["population"]], np.random.default_rng([r["shard"], r["island"], number]))
                r["bins"] = worth(population[0], sizes)[0]
                r["done"], r["population"] = r["bins"] <= fewest(sizes), [g.tobytes() for g in population]
            yield pa.RecordBatch.from_pylist(rows, _schema())

    return run


def _migrated(state: DataFrame) -> DataFrame:
    """Each island's best replaces the worst of the next island of its shard."""
    moving = state.select("shard", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("population")[0].alias("guest"))
    kept = F.slice("population", 1, F.greatest(F.size("population") - 1, F.lit(1)))
    return state.join(moving, ["shard", "island"], "left").withColumn("population", F.when(F.col("guest").isNull(), F.col("population")).otherwise(F.concat(kept, F.array("guest")))).select(*state.columns)


def _place(pieces: pa.Table, best: pa.Table) -> pa.Table:
    """Bins and offsets of a shard's pieces by its best grouping; loose: those of the OPEN worst-filled bins that
    aren't full, up to half of the pieces."""
    pieces = _order(pieces)
    group = np.frombuffer(best.column("grouping")[0].as_py(), np.int32)
    sizes, rows = pieces.column("size").to_numpy(), pieces.column("row").to_numpy()
    fill = np.bincount(group, sizes)
    worst = np.argsort(fill, kind="stable")[:OPEN]
    loose = np.zeros(len(fill), bool)
    loose[worst] = (fill[worst] < WINDOW) & (np.cumsum(np.bincount(group)[worst]) <= len(group) // 2)
    order = np.lexsort((rows, group))
    ends = np.cumsum(sizes[order])
    starts = ends - sizes[order]
    first = np.concatenate(([True], group[order][1:] != group[order][:-1]))
    offset = starts - np.repeat(starts[first], np.diff(np.append(np.flatnonzero(first), len(order))))
    shard = best.column("shard")[0].as_py()
    return pa.table({"row": rows[order], "size": pa.array(sizes[order], pa.int64()), "shard": pa.array([shard] * len(order), pa.int64()), "bin": pa.array(group[order], pa.int64()), "offset": pa.array(offset, pa.int64()), "loose": loose[group[order]]})


def _packed(pieces: DataFrame, shards: int) -> DataFrame:
    """row, size, shard, bin, offset and loose of the pieces (row, size) after all epochs."""
    dealt = _dealt(pieces, shards)
    state = cut(dealt.groupBy("shard").applyInArrow(_begin, _STATE), "islands")
    found = [state.where("done")]
    state = state.where("not done")
    for number in range(EPOCHS):
        if state.isEmpty():
            break
        state = cut((_migrated(state) if number else state).mapInArrow(_epoch(number), _STATE), "islands")
        found.append(state)
    every = found[0]
    for own in found[1:]:
        every = every.unionByName(own)
    best = every.groupBy("shard").agg(F.min_by(F.col("population")[0], F.struct("bins", "island")).alias("grouping"))
    return dealt.groupBy("shard").cogroup(best.groupBy("shard")).applyInArrow(_place, "row long, size long, shard long, bin long, offset long, loose boolean")


def pack_documents(docs: DataFrame, vocabulary: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of all pieces; keep_ids adds ids, little-endian
    unsigned 32-bit numbers.

    vocabulary: path of the tokenizer's file, the same on every machine. A text that is null or empty has the end id
    alone. Rows that repeat a doc_id, or are equal in all columns, are documents of their own; a null doc_id stays
    null. An empty table gives an empty one; a text of any length is cut as stated; pieces of equal size are
    interchangeable, so ties change nothing but which of them shares a sequence. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_tokenise(vocabulary, keep_ids), "row long, doc_id long, tokens long, sums array<long>, ids binary")
    rows = cut(rows, "pieces")
    head = (F.col("tokens") - 1) % WINDOW + 1
    left, level, settled = rows.select("row", head.alias("size")), 0, None
    while True:
        shards = max(1, -(-left.count() // SHARD))
        packed = cut(_packed(left, shards), "packed")
        again = F.col("loose") if shards > 1 else F.lit(False)
        own = packed.where(~again).select("row", "offset", (F.lit(level << 56) + F.shiftleft("shard", 20) + F.col("bin")).alias("sequence_id"))
        settled = own if settled is None else settled.unionByName(own)
        if shards == 1:
            break
        left, level = packed.where(again).select("row", "size"), level + 1
    ids = lambda start, length: [F.expr(f"substring(ids, cast(4 * ({start}) + 1 as int), cast(4 * ({length}) as int))").alias("ids")] if keep_ids else []
    first = rows.join(settled, "row").withColumn("length", head)
    first = first.select("doc_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), "length", F.col("sums")[0].alias("ids_crc32"), "sequence_id", "offset", *ids("0", "length"))
    later = rows.select("doc_id", head.alias("head"), F.posexplode("sums").alias("piece", "ids_crc32"), *(["ids"] if keep_ids else [])).where("piece > 0")
    later = later.withColumn("start", F.col("head") + (F.col("piece") - 1) * WINDOW)
    later = later.select("doc_id", "piece", "start", F.lit(WINDOW).cast("long").alias("length"), "ids_crc32", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *ids("start", str(WINDOW)))
    return first.unionByName(later)
