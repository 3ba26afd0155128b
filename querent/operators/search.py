"""Top-k search of a stored index: many queries at once, block by block, blocks that can't reach the k-th score skipped.

A task reads whole blocks, some at a time, and keeps every query's k best of all that it has read, so what leaves it
doesn't grow with the documents. A list's head (its largest count, with the least side value of its block) bounds what
a term can add there. The blocks of highest bound are scored first, up to the first whose bound is under the k-th score
so far. The index isn't shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querent.operators.stats import Postings, Sought, Words
from querent.shipping import ship

#: Blocks scored together, pairs of query and term (or terms) in a turn, blocks scored before the first look at the threshold.
GROUP, ASKED, FIRST = 32, 1 << 20, 4
#: Scores count to this many places, and bounds are trusted to one in the last.
PLACES = 6
_NAMES = ["block", "numbers", "sizes", "mosts", "ats", "tfs", "docs", "sides"]
_KINDS = [pa.int64(), *[pa.binary()] * 5, pa.list_(pa.int64()), pa.list_(pa.float64())]


@dataclass(frozen=True)
class Scheme:
    """weigh: of counts and the documents' side values; the more counts and the smaller side, the more. finish: of
    summed weights, side values and the query's value; growing with the sum, falling with side."""

    weigh: Callable[[np.ndarray, np.ndarray], np.ndarray]
    finish: Callable[[np.ndarray, np.ndarray, float], np.ndarray] = lambda total, side, value: total


@dataclass(frozen=True)
class Sides:
    """A side value of each document: the root of its summed squared count times weight, or the number of its terms in
    names, which are as many as a vocabulary has."""

    names: pa.Array
    weights: np.ndarray
    squares: bool

    @staticmethod
    def of(weights: DataFrame, squares: bool) -> Sides:
        """weights: (term, weight)."""
        own = weights.select("term", F.col("weight").cast("double").alias("weight")).toArrow().combine_chunks()
        return Sides(own.column("term").combine_chunks() if own.num_rows else pa.array([], pa.string()), own.column("weight").to_numpy(), squares)

    def values(self, n: int, number: np.ndarray, at: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """Of n documents, by the postings of names: number, document and count."""
        if not self.squares:
            return np.bincount(at, minlength=n).astype(np.float64)
        x = self.weights[number] * tf
        return np.sqrt(np.bincount(at, x * x, n))


def runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def numbers_of(terms: pa.Array, names: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.index_in(terms, names), -1).to_numpy()


def blocks_of(batches: Iterator[pa.RecordBatch], names: pa.Array, sides: Sides | None) -> Iterator[tuple[tuple, tuple]]:
    """Of each block the lists of some terms (their numbers in names, sizes, largest counts, places and counts), and its
    documents with their side values, by default their lengths."""
    sought = found = None
    for batch in batches:
        if "codes" in batch.schema.names:
            sought, found = sought or Sought(names), found or sides and Sought(sides.names)
            yield from _worded(batch, sought, found, sides)
            continue
        terms = batch.column("terms")
        ends = np.concatenate([[0], np.cumsum(terms.value_lengths().to_numpy())])
        number = numbers_of(terms.flatten(), names)
        beside = numbers_of(terms.flatten(), sides.names) if sides else None
        for row in range(batch.num_rows):
            value = lambda c: batch.column(c)[row]  # noqa: E731, B023
            its, block, docs = slice(ends[row], ends[row + 1]), value("block").as_py(), value("docs").values
            sizes = value("sizes").values.to_numpy().astype(np.int64)
            start = np.cumsum(sizes) - sizes
            tfs, ats = np.frombuffer(value("tfs").as_buffer(), "<i4"), np.frombuffer(value("ats").as_buffer(), "<u2")
            own = np.flatnonzero(number[its] >= 0)
            at = runs(start[own], sizes[own])
            columns = number[its][own].astype("<i4"), sizes[own].astype("<i4"), value("mosts").values.to_numpy()[own].astype("<i4"), ats[at], tfs[at]
            if sides:
                good = np.flatnonzero(beside[its] >= 0)
                at = runs(start[good], sizes[good])
                side = sides.values(len(docs), np.repeat(beside[its][good], sizes[good]), ats[at], tfs[at])
            else:
                side = value("dls").values.to_numpy().astype(np.float64)
            yield (block, *(c.tobytes() for c in columns), None, None), (block, *[None] * 5, docs.to_pylist(), side.tolist())


def _worded(batch: pa.RecordBatch, sought: Sought, beside: Sought | None, sides: Sides | None) -> Iterator[tuple[tuple, tuple]]:
    """The same of blocks of words."""
    for row in range(batch.num_rows):
        words, block = Words.at(batch, row), batch.column("block")[row].as_py()
        number, at, tf = sought.postings(words)
        own, start = np.unique(number, return_index=True)
        most = np.maximum.reduceat(tf, start) if len(own) else tf
        columns = own.astype("<i4"), np.diff(np.append(start, len(at))).astype("<i4"), most.astype("<i4"), at.astype("<u2"), tf.astype("<i4")
        side = sides.values(words.n, *beside.postings(words)) if sides else batch.column("dls")[row].values.to_numpy().astype(np.float64)
        yield (block, *(c.tobytes() for c in columns), None, None), (block, *[None] * 5, batch.column("docs")[row].as_py(), side.tolist())


def tables_of(batches: Iterator[pa.RecordBatch], names: pa.Array, sides: Sides | None, group: int) -> Iterator[pa.Table]:
    """The same, group blocks in a table."""
    held: list[tuple] = []
    made = lambda: pa.table([pa.array(c, k) for c, k in zip(zip(*held), _KINDS)], _NAMES)
    for lists, docs in blocks_of(batches, names, sides):
        held += [lists, docs]
        if len(held) >= 2 * group:
            yield made()
            held = []
    if held:
        yield made()


def dealt(p: Postings) -> DataFrame:
    """The blocks in as many parts as there are cores, each of which reads on where it is."""
    cores = p.blocks.sparkSession.sparkContext.defaultParallelism
    return p.blocks.select(*p.READ).coalesce(cores)


class Lists:
    """Some blocks with the lists of asked terms, in memory: lists by number, then block; documents by block."""

    def __init__(self, table: pa.Table):
        whole = table.filter(pc.is_valid(table.column("docs"))).combine_chunks().sort_by("block")
        rows = table.filter(pc.is_null(table.column("docs"))).combine_chunks()
        flat = lambda c: pc.list_flatten(whole.column(c)).to_numpy()
        joined = lambda c, kind: np.frombuffer(b"".join(rows.column(c).to_pylist()), kind).astype(np.int64)
        self.ids, self.side = flat("docs"), flat("sides")
        sizes = pc.list_value_length(whole.column("docs")).to_numpy().astype(np.int64)
        self.base = np.cumsum(sizes) - sizes
        number, size, most, at, tf = joined("numbers", "<i4"), joined("sizes", "<i4"), joined("mosts", "<i4"), joined("ats", "<u2"), joined("tfs", "<i4")
        each = [len(n) // 4 for n in rows.column("numbers").to_pylist()]
        block = np.repeat(np.searchsorted(whole.column("block").to_numpy(), rows.column("block").to_numpy()), each)
        order = np.lexsort((block, number))
        at_order = runs((np.cumsum(size) - size)[order], size[order])
        self.number, self.block, self.size, self.most = number[order], block[order], size[order], most[order]
        self.start = np.cumsum(self.size) - self.size
        self.doc, self.tf = np.repeat(self.base[self.block], self.size) + at[at_order], tf[at_order]


class Group(Lists):
    """The same, weighed."""

    def __init__(self, table: pa.Table, scheme: Scheme):
        super().__init__(table)
        self.scheme = scheme
        some = np.where(self.side > 0, self.side, np.inf)  # documents without any term are in no list
        self.least = np.minimum.reduceat(some, self.base) if len(self.base) else some
        self.weight = scheme.weigh(self.tf.astype(np.float64), self.side[self.doc])
        self.bound = scheme.weigh(self.most.astype(np.float64), self.least[self.block])
        self.read = 0  # postings that searches have looked at

    def best(self, terms: np.ndarray, weights: np.ndarray, value: float, k: int, floor: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Places in ids and scores of the k best for terms of non-negative weights, ties to the smaller id; no zeros, and none
        that must be found of a score under floor."""
        lo, hi = np.searchsorted(self.number, terms), np.searchsorted(self.number, terms, side="right")
        rows, weight = runs(lo, hi - lo), np.repeat(weights, hi - lo)
        block = self.block[rows]
        bound = self.scheme.finish(np.bincount(block, weight * self.bound[rows], len(self.least)), self.least, value)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        held, score, threshold, done, some = np.zeros(0, np.int64), np.zeros(0), floor, 0, FIRST
        while done < len(order) and bound[order[done]] >= threshold - 10.0**-PLACES:
            chosen = np.zeros(len(bound), bool)
            chosen[order[done : done + some]] = True
            chosen &= bound >= threshold - 10.0**-PLACES
            done, some = done + some, 2 * some
            own = np.flatnonzero(chosen[block])
            at = runs(self.start[rows[own]], self.size[rows[own]])
            self.read += len(at)
            total = np.bincount(self.doc[at], np.repeat(weight[own], self.size[rows[own]]) * self.weight[at], len(self.ids))
            found = np.flatnonzero(total)
            reached = self.scheme.finish(total[found], self.side[found], value)
            held, score = np.concatenate([held, found]), np.concatenate([score, reached])
            rounded = np.round(score, PLACES)
            first = np.lexsort((self.ids[held], -rounded))
            first = first[rounded[first] > 0][:k]
            held, score = held[first], score[first]
            if len(held) == k:
                threshold = max(threshold, float(np.round(score[-1], PLACES)))
        return held, score


def _searched(scheme: Scheme, queries: pa.Array, at: np.ndarray, terms: np.ndarray, weights: np.ndarray, values: np.ndarray, k: int, names: pa.Array, sides: Sides | None, some: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, scores = [np.zeros(0, np.int64)] * len(queries), [np.zeros(0)] * len(queries)
        for table in tables_of(batches, names, sides, some):
            group = Group(table, scheme)
            for q in range(len(queries)):
                own, held = slice(at[q], at[q + 1]), scores[q]
                places, score = group.best(terms[own], weights[own], float(values[q]), k, float(np.round(held[-1], PLACES)) if len(held) == k else 0.0)
                if len(places):
                    ids, score = np.concatenate([docs[q], group.ids[places]]), np.concatenate([held, score])
                    first = np.lexsort((ids, -np.round(score, PLACES)))[:k]
                    docs[q], scores[q] = ids[first], score[first]
        for first in range(0, len(queries), 1000):
            last = min(first + 1000, len(queries))
            asked = np.repeat(np.arange(first, last), [len(d) for d in docs[first:last]])
            yield pa.RecordBatch.from_arrays([queries.take(pa.array(asked, pa.int64())), pa.array(np.concatenate(docs[first:last])), pa.array(np.concatenate(scores[first:last]))], ["query_id", "doc_id", "score"])

    return run


def search(p: Postings, asked: DataFrame, k: int, scheme: Scheme, sides: Sides | None = None) -> DataFrame:
    """(query_id, doc_id, score): at least all of the k best documents of each query with a score over 0.

    asked: (query_id, term, weight, value), a row a term of a query, weights not negative, value the query's own.
    sides: what gives each document its side value; by default it is the length.
    """
    spark, kind = asked.sparkSession, asked.schema["query_id"].dataType.simpleString()
    ship(spark)
    asked = asked.where("weight > 0").select("query_id", "term", F.col("weight").cast("double").alias("weight"), F.col("value").cast("double").alias("value"))
    found = None
    for own in turns_of(asked, "query_id", ASKED):
        own = own.sort_by([("query_id", "ascending"), ("term", "ascending")])
        names, coded = pc.unique(own.column("term")), pc.unique(own.column("query_id"))
        numbers, code = (pc.index_in(own.column(c), x).to_numpy() for c, x in (("term", names), ("query_id", coded)))
        at = np.searchsorted(code, np.arange(len(coded) + 1))
        values = own.column("value").to_numpy()[at[:-1]] if own.num_rows else np.zeros(0)
        run = _searched(scheme, coded, at, numbers.astype(np.int64), own.column("weight").to_numpy(), values, k, names, sides, GROUP)
        part = dealt(p).mapInArrow(run, f"query_id {kind}, doc_id long, score double")
        found = part if found is None else found.unionByName(part)
    return found


def turns_of(rows: DataFrame, key: str, some: int) -> Iterator[pa.Table]:
    """Rows on the driver, about some at a time, all of a key together. What workers hold of them is so bounded."""
    turns = max(1, -(-rows.count() // some))
    for turn in range(turns):
        yield (rows if turns == 1 else rows.where(F.pmod(F.xxhash64(key), F.lit(turns)) == turn)).toArrow().combine_chunks()


def postings_of(p: Postings, wanted: DataFrame, only: DataFrame | None = None, sides: Sides | None = None) -> DataFrame:
    """(doc_id, term, tf, side), a row a posting, of the terms in wanted; of the documents in only (doc_id), if given."""
    ship(wanted.sparkSession)
    rows, found = dealt(p), None
    if only is not None:
        places = p.blocks.select("block", F.posexplode("docs").alias("at", "doc_id")).join(only.select("doc_id").distinct(), "doc_id", "left_semi")
        rows = rows.join(places.groupBy("block").agg(F.collect_list("at").alias("picked")), "block")
    for own in turns_of(wanted.select("term").distinct(), "term", ASKED):
        part = rows.mapInArrow(_unfolded(pc.unique(own.column("term")), sides), "doc_id long, term string, tf long, side double")
        found = part if found is None else found.unionByName(part)
    return found


def _unfolded(names: pa.Array, sides: Sides | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            picked = batch.column("picked").to_pylist() if "picked" in batch.schema.names else None
            for row, table in enumerate(tables_of(iter([batch]), names, sides, 1)):
                lists = Lists(table)
                keep = np.ones(len(lists.doc), bool)
                if picked:
                    good = np.zeros(len(lists.ids), bool)
                    good[picked[row]] = True
                    keep = good[lists.doc]
                doc = lists.doc[keep]
                columns = [pa.array(lists.ids[doc], pa.int64()), names.take(pa.array(np.repeat(lists.number, lists.size)[keep])), pa.array(lists.tf[keep]), pa.array(lists.side[doc])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "term", "tf", "side"])

    return run
