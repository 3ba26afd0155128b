"""Corpus statistics: a stored inverted index, stored words for grams, lengths, frequencies, vocabularies.

Tokens are made by column expressions and inverted inside tasks, block by block of documents, so no shuffle has a row
a token, or any row. What is stored is a row a block: its documents, the terms, heads of their lists (how long, the
largest count, all counts) and the lists end to end. Where a row is, there is all that scoring its documents takes.

Grams are words and pairs of words, most of them met once or twice. An index of them is larger than the texts, so a
block's words are stored in their order, and tasks make the grams that are asked for of these.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import ClassVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querent.functions import text
from querent.functions.text import STOP_WORDS, plain_tokens
from querent.shipping import ship
from querent.sources.store import Store, digest, fingerprint

#: Documents of a block.
BLOCK = 256
#: Sums of gram counts by hash, and how many of them in a row; blocks whose counts show which grams are frequent.
BUCKETS, SLOT, EARLY = 1 << 20, 1 << 14, 32
_ROWS = "block long, docs array<long>, dls array<int>, terms array<string>, sizes array<int>, mosts array<int>, cfs array<long>, ats binary, tfs binary"


def spread(df: DataFrame) -> DataFrame:
    """A file that is one split is dealt over the cores before it is exploded."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < min(cores, 4) else df


def some_rows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The same rows, size in a batch."""
    rest = None
    for batch in batches:
        rows = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        whole = rows.num_rows // size * size
        yield from (rows.slice(at, size) for at in range(0, whole, size))
        rest = rows.slice(whole) if whole < rows.num_rows else None
    if rest is not None:
        yield rest


def _inverted(size: int):
    """A row for each block of size documents (doc_id, terms)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for number, rows in enumerate(some_rows(batches, size)):
            docs, terms = rows.column("doc_id"), rows.column("terms")
            lengths = terms.value_lengths().fill_null(0).to_numpy().astype(np.int64)
            coded = terms.flatten().dictionary_encode()
            names = coded.dictionary
            # postings by term, then document
            doc = np.repeat(np.arange(len(docs)), lengths)
            pairs, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * len(docs) + doc, return_counts=True)
            at, tf = (pairs % len(docs)).astype("<u2"), tf.astype("<i4")
            start = np.searchsorted(pairs, np.arange(len(names) + 1) * len(docs))
            mosts = np.maximum.reduceat(tf, start[:-1]) if len(names) else tf
            cfs = np.add.reduceat(tf.astype(np.int64), start[:-1]) if len(names) else start[:0]
            listed = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            columns = [
                pa.array([(part << 32) + number]), listed(docs), listed(pa.array(lengths, pa.int32())), listed(names), listed(pa.array(np.diff(start), pa.int32())),
                listed(pa.array(mosts, pa.int32())), listed(pa.array(cfs, pa.int64())), pa.array([at.tobytes()], pa.binary()), pa.array([tf.tobytes()], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in _ROWS.split(", ")])

    return run


_WORDS = "block long, docs array<long>, dls array<int>, words array<string>, codes binary"


def _coded(size: int):
    """A row for each block of size documents (doc_id, terms), where terms are words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for number, rows in enumerate(some_rows(batches, size)):
            docs, terms = rows.column("doc_id"), rows.column("terms")
            lengths = terms.value_lengths().fill_null(0).to_numpy().astype(np.int64)
            coded = terms.flatten().dictionary_encode()
            codes = coded.indices.to_numpy().astype("<u2" if len(coded.dictionary) <= 1 << 16 else "<u4")
            listed = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            columns = [pa.array([(part << 32) + number]), listed(docs), listed(pa.array(np.maximum(2 * lengths - 1, 0), pa.int32())), listed(coded.dictionary), pa.array([codes.tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in _WORDS.split(", ")])

    return run


@dataclass(frozen=True)
class Words:
    """A block's words: their names, and the documents' words end to end, as numbers of names and of documents."""

    n: int
    names: pa.Array
    codes: np.ndarray
    doc: np.ndarray

    @staticmethod
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
        for batch in batches:
            yield from (Words.at(batch, row) for row in range(batch.num_rows))

    @staticmethod
    def at(batch: pa.RecordBatch, row: int) -> Words:
        names = batch.column("words")[row].values
        lengths = (batch.column("dls")[row].values.to_numpy().astype(np.int64) + 1) // 2
        codes = np.frombuffer(batch.column("codes")[row].as_buffer(), "<u2" if len(names) <= 1 << 16 else "<u4").astype(np.int64)
        return Words(len(lengths), names, codes, np.repeat(np.arange(len(lengths)), lengths))

    def grams(self, number: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes and documents of all words and pairs of neighbours, of words whose number isn't 0: number * base, and for a
        pair the second one's number more."""
        w = number[self.codes]
        one, two = w > 0, (w[:-1] > 0) & (w[1:] > 0) & (self.doc[:-1] == self.doc[1:])
        return np.concatenate([w[one] * base, w[:-1][two] * base + w[1:][two]]), np.concatenate([self.doc[one], self.doc[:-1][two]])

    def counted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each different gram: its words' places in names (the second -1 for a single word), its documents and its count."""
        base = len(self.names) + 1
        code, doc = self.grams(np.arange(1, base), base)
        pairs, tf = np.unique(code * self.n + doc, return_counts=True)
        code, start = np.unique(pairs // max(self.n, 1), return_index=True)
        cf = np.add.reduceat(tf, start) if len(start) else start
        return code // base - 1, code % base - 1, np.diff(np.append(start, len(pairs))), cf

    def buckets(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """A number under BUCKETS of each gram, the same in all blocks."""
        marks = np.append(np.array([zlib.crc32(w.encode()) + 1 for w in self.names.to_pylist()], np.uint64), np.uint64(0))
        mixed = (marks[first] * np.uint64(0x9E3779B97F4A7C15)) ^ ((marks[second] + np.uint64(0x632BE5AB)) * np.uint64(0xC2B2AE3D27D4EB4F))
        return (((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)).astype(np.int64) % BUCKETS


class Sought:
    """Different grams that are looked for in blocks of words."""

    def __init__(self, names: pa.Array):
        parts = [n.split(" ") for n in names.to_pylist()]
        self.words = pa.array(sorted({w for p in parts for w in p}), pa.string())
        place = {w: k for k, w in enumerate(self.words.to_pylist(), 1)}
        self.base = len(place) + 1
        codes = np.array([place[p[0]] * self.base + (place[p[1]] if len(p) == 2 else 0) if len(p) <= 2 else -1 for p in parts], np.int64)
        self.number = np.argsort(codes, kind="stable")
        self.codes = codes[self.number]

    def postings(self, block: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number in names, document and count of each that a block has, by number, then document."""
        code, doc = block.grams(pc.fill_null(pc.index_in(block.names, self.words), -1).to_numpy().astype(np.int64) + 1, self.base)
        at = np.searchsorted(self.codes, code)
        good = np.flatnonzero(at < len(self.codes))
        good = good[self.codes[at[good]] == code[good]]
        pairs, tf = np.unique(self.number[at[good]] * block.n + doc[good], return_counts=True)
        return pairs // max(block.n, 1), pairs % max(block.n, 1), tf


def _frequent(flags: np.ndarray | None):
    """(term, df, cf) of each block's grams, of those whose bucket is flagged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in Words.of(batches):
            first, second, df, cf = block.counted()
            if flags is not None:
                good = np.flatnonzero(flags[block.buckets(first, second)])
                first, second, df, cf = first[good], second[good], df[good], cf[good]
            one = np.flatnonzero(second < 0)
            two = np.flatnonzero(second >= 0)
            named = lambda at: block.names.take(pa.array(at, pa.int64()))  # noqa: E731, B023
            terms = pa.concat_arrays([named(first[one]), pc.binary_join_element_wise(named(first[two]), named(second[two]), " ")])
            order = np.concatenate([one, two])
            yield pa.RecordBatch.from_arrays([terms, pa.array(df[order], pa.int64()), pa.array(cf[order], pa.int64())], ["term", "df", "cf"])

    return run


def _bucketed(names: pa.Array):
    """(slot, dfs, cfs): a task's sums of the counts of all grams by bucket, then of those in names, SLOT in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sought, dfs, cfs = Sought(names), np.zeros(BUCKETS + len(names), np.int64), np.zeros(BUCKETS + len(names), np.int64)
        for block in Words.of(batches):
            first, second, df, cf = block.counted()
            bucket = block.buckets(first, second)
            np.add.at(dfs, bucket, df)
            np.add.at(cfs, bucket, cf)
            number, _, tf = sought.postings(block)
            dfs[BUCKETS:] += np.bincount(number, minlength=len(names))
            cfs[BUCKETS:] += np.bincount(number, tf, len(names)).astype(np.int64)
        for at in range(0, len(dfs), SLOT):
            yield pa.RecordBatch.from_arrays([pa.array([at // SLOT], pa.int32()), *(pa.array([x[at : at + SLOT].tobytes()], pa.binary()) for x in (dfs, cfs))], ["slot", "dfs", "cfs"])

    return run


def _added(rows: pa.Table) -> pa.Table:
    total = lambda c: sum(np.frombuffer(x, np.int64) for x in rows.column(c).to_pylist()).tobytes()
    return pa.table([rows.column("slot").slice(0, 1), pa.array([total("dfs")], pa.binary()), pa.array([total("cfs")], pa.binary())], ["slot", "dfs", "cfs"])


@dataclass(frozen=True)
class Postings:
    """A stored index. blocks: (block, docs, dls, terms, sizes, mosts, cfs, ats, tfs), where dls are lengths, 0 for documents
    without terms, ats places in the block, 16 bits each, and tfs counts of 32 bits; n documents of mean length avgdl.
    """

    READ: ClassVar = ("block", "docs", "dls", "terms", "sizes", "mosts", "ats", "tfs")

    store: Store
    key: str
    blocks: DataFrame
    n: int
    n_blocks: int
    avgdl: float

    @property
    def docs(self) -> DataFrame:
        """(doc_id, dl)."""
        return self.blocks.select(F.inline(F.arrays_zip("docs", "dls")).alias("doc_id", "dl")).select("doc_id", F.col("dl").cast("long").alias("dl"))

    @property
    def frequencies(self) -> DataFrame:
        """(term, df, cf) of each term, from the heads of its lists."""
        heads = self.blocks.select(F.inline(F.arrays_zip("terms", "sizes", "cfs")).alias("term", "size", "cf"))
        return heads.groupBy("term").agg(F.sum("size").alias("df"), F.sum("cf").alias("cf"))

    @property
    def terms(self) -> DataFrame:
        """The same, kept."""
        return self.kept("terms", lambda: self.frequencies)

    def leading(self, max_df: float, min_df: int, some: int) -> DataFrame:
        """(term, df, cf) of as many terms as it takes that the some most counted ones, by df or by cf, of those in at most
        max_df of the documents and at least min_df are among them."""
        return self.terms

    def kept(self, name: str, make) -> DataFrame:
        """A table that is made of this index once."""
        return self.store.build(digest(self.key, name), make)


@dataclass(frozen=True)
class Grams(Postings):
    """The same of words and pairs of neighbours. blocks: (block, docs, dls, words, codes), where words are a block's different
    ones, and codes its documents' words end to end, as places in words of 16 bits, or 32 where there are too many."""

    READ: ClassVar = ("block", "docs", "dls", "words", "codes")

    def _counts(self, blocks: DataFrame, flags: np.ndarray | None = None) -> DataFrame:
        rows = blocks.select(*self.READ).coalesce(blocks.sparkSession.sparkContext.defaultParallelism).mapInArrow(_frequent(flags), "term string, df long, cf long")
        return rows.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))

    @property
    def frequencies(self) -> DataFrame:
        return self._counts(self.blocks)

    def leading(self, max_df: float, min_df: int, some: int) -> DataFrame:
        """No shuffle has a row a gram: sums by hash say which grams can't be frequent enough, as the frequent ones of some
        blocks, counted in all, show how often the last wanted one is met at least."""
        return self.kept(f"leading {max_df} {min_df} {some}", lambda: self._leading(max_df, min_df, some))

    def _leading(self, max_df: float, min_df: int, some: int) -> DataFrame:
        if self.n_blocks <= EARLY:
            return self.frequencies
        early = self.blocks.where(F.pmod(F.xxhash64("block"), F.lit(-(-self.n_blocks // EARLY))) == 0)
        names = self._counts(early).orderBy(F.col("cf").desc(), "term").limit(3 * some).select("term").toArrow().column("term").combine_chunks()
        names = names if len(names) else pa.array([], pa.string())
        rows = self.blocks.select(*self.READ).coalesce(self.blocks.sparkSession.sparkContext.defaultParallelism).mapInArrow(_bucketed(names), "slot int, dfs binary, cfs binary")
        added = sorted(rows.groupBy("slot").applyInArrow(_added, "slot int, dfs binary, cfs binary").collect())
        dfs, cfs = (np.concatenate([np.frombuffer(r[c], np.int64) for r in added]) for c in ("dfs", "cfs"))
        good = (dfs[BUCKETS:] <= max_df * self.n) & (dfs[BUCKETS:] >= min_df)
        least = lambda x: int(np.partition(x, -some)[-some]) if len(x) >= some else 0
        df, cf = least(dfs[BUCKETS:][good]), least(cfs[BUCKETS:][good])
        flags = (dfs[:BUCKETS] >= df) | (cfs[:BUCKETS] >= cf)
        return self._counts(self.blocks, flags).where((F.col("df") >= df) | (F.col("cf") >= cf))


def postings(docs: DataFrame, terms: Column, name: str, store: Store | None = None, grams: bool = False) -> Postings:
    """The stored index of docs (doc_id, ...) by an array column of terms; name says which, in the store. grams: of the terms
    and of pairs of neighbours, where terms are words without spaces.

    doc_ids are unique longs. Built where the store has none of these documents.
    """
    ship(docs.sparkSession)
    store = store or Store(docs.sparkSession)
    key = digest("postings", name, fingerprint(docs), BLOCK)

    def blocks() -> DataFrame:
        return spread(docs).select(F.col("doc_id").cast("long").alias("doc_id"), terms.alias("terms")).mapInArrow(*((_coded(BLOCK), _WORDS) if grams else (_inverted(BLOCK), _ROWS)))

    def facts(whole: DataFrame) -> dict:
        n_blocks, n, total = whole.agg(F.count("*"), F.sum(F.size("docs")), F.sum(F.aggregate("dls", F.lit(0).cast("long"), lambda a, x: a + x))).first()
        return {"n_blocks": n_blocks, "n": n or 0, "total": total or 0}

    whole = store.build(key, blocks, facts)
    held = store.manifest(key)
    return (Grams if grams else Postings)(store, key, whole, held["n"], held["n_blocks"], held["total"] / held["n"] if held["n"] else 0.0)


def plain_postings(docs: DataFrame, field: str, store: Store | None = None) -> Postings:
    return postings(docs.select("doc_id", field), plain_tokens(F.col(field)), f"plain {field}", store)


def gram_postings(docs: DataFrame, field: str, stop=None, store: Store | None = None) -> Postings:
    words = STOP_WORDS if stop is None else list(stop)
    return postings(docs.select("doc_id", field), text.words(F.col(field), words), f"grams {field} {digest(*words)}", store, grams=True)


def vocabulary(p: Postings, binary: bool, max_df: float = 0.4, min_df: int = 1, max_features: int = 10_000) -> DataFrame:
    """(term, df, cf) of the terms in at most max_df of the documents and at least min_df, the max_features most
    counted (by documents if binary), ties by term. max_features is the model's size, so the result is bounded."""
    kept = p.leading(max_df, min_df, max_features).where((F.col("df") <= max_df * p.n) & (F.col("df") >= min_df))
    chosen = kept.orderBy(F.col("df" if binary else "cf").desc(), "term").limit(max_features)
    return p.kept(f"vocabulary {binary} {max_df} {min_df} {max_features}", lambda: chosen)


def query_terms(queries: DataFrame, terms: Column) -> DataFrame:
    """(query_id, term, qtf)."""
    return queries.select("query_id", F.explode(terms).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
