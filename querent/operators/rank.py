"""Rankers: many queries at once, one ranking table (query_id, doc_id, score, rank) each.

Scores are rounded to six places; ties go to the smaller doc_id. An exhaustive ranker gives every query
min(k, documents) rows, zero scores included, unless drop_zero is set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from querent.functions.text import ngrams, plain_tokens
from querent.operators.encode import matrix, unit
from querent.operators.search import Scheme, Sides, postings_of, search, turns_of
from querent.operators.stats import Postings, query_terms, some_rows, vocabulary
from querent.shipping import ship


def bounded_top_k(k: int, n: int) -> int:
    """How many of n rows a top-k has; k under 1 or n under 0 is an error."""
    if k < 1 or n < 0:
        raise ValueError("top_k must be at least 1 and the size at least 0")
    return min(k, n)


def top_k(scored: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).select("query_id", "doc_id", "score", "rank")


def filled(parts: DataFrame, queries: DataFrame, p: Postings, k: int, drop_zero: bool) -> DataFrame:
    """parts (query_id, doc_id, part) and, unless zero scores are dropped, a zero for each query with each of the 2k
    least doc_ids: at least k of them are unscored if fewer than k documents are scored. So one pass over the parts
    scores and fills up, and adding a zero changes no score."""
    least = [] if drop_zero or not p.n else [r[0] for r in p.docs.select("doc_id").orderBy("doc_id").limit(2 * bounded_top_k(k, p.n)).collect()]
    own = parts.select("query_id", "doc_id", F.col("part").cast("double").alias("part"))
    if not least:
        return own
    return own.unionByName(queries.select("query_id", F.explode(F.array(*map(F.lit, least))).alias("doc_id"), F.lit(0.0).alias("part")))


def best(scored: DataFrame, p: Postings, k: int, drop_zero: bool) -> DataFrame:
    rounded = scored.select("query_id", "doc_id", F.round("score", 6).alias("score"))
    return top_k(rounded.where("score <> 0") if drop_zero else rounded, bounded_top_k(k, p.n) if p.n else k)


def exhaustive(parts: DataFrame, queries: DataFrame, p: Postings, k: int, drop_zero: bool) -> DataFrame:
    """The top k by the sum of parts, with zero-score rows to fill up."""
    return _summed(filled(parts, queries, p, k, drop_zero), p, k, drop_zero)


def _summed(parts: DataFrame, p: Postings, k: int, drop_zero: bool) -> DataFrame:
    return best(parts.groupBy("query_id", "doc_id").agg(F.sum("part").alias("score")), p, k, drop_zero)


def merged(found: DataFrame, queries: DataFrame, p: Postings, k: int, drop_zero: bool) -> DataFrame:
    """The same of what a search found, (query_id, doc_id, score), dealt by query once."""
    return _summed(filled(found.withColumnRenamed("score", "part"), queries, p, k, drop_zero).repartition("query_id"), p, k, drop_zero)


def bm25_idf(p: Postings) -> DataFrame:
    """(term, df, idf); a negative idf becomes a quarter of the mean over all terms."""

    def make() -> DataFrame:
        raw = p.terms.select("term", "df", (F.log(p.n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
        mean = raw.agg(F.avg("raw")).first()[0] or 0.0
        return raw.select("term", "df", F.when(F.col("raw") < 0, 0.25 * mean).otherwise(F.col("raw")).alias("idf"))

    return p.kept("idf", make)


def bm25_asked(p: Postings, queries: DataFrame, text: str) -> DataFrame:
    """(query_id, term, weight): the terms of queries that the corpus has, with their idf as often as the query has them."""
    return query_terms(queries, plain_tokens(F.col(text))).join(bm25_idf(p), "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("weight"))


def _asked_postings(p: Postings, asked: DataFrame, only: DataFrame | None, sides: Sides | None = None) -> DataFrame:
    """Postings with the queries that ask for their terms; of the pairs in only, if it has query_id, each hit with its own
    query's terms, so that there are no more rows than hits have terms asked."""
    hits = postings_of(p, asked, only, sides)
    if only is None or "query_id" not in only.columns:
        return hits.join(asked, "term")
    return only.select("query_id", "doc_id").distinct().join(asked, "query_id").join(hits, ["doc_id", "term"])


def bm25_parts(p: Postings, queries: DataFrame, text: str = "query", k1: float = 1.5, b: float = 0.75, only: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, term, part): what each query term adds to a document's score. A term counts as often as the
    query has it. only: documents (doc_id), or hits (query_id, doc_id), whose parts are wanted; others are left out before
    queries join."""
    asked = bm25_asked(p, queries, text)
    hits = _asked_postings(p, asked, only)
    norm = F.col("tf") + k1 * (1 - b + b * F.col("side") / F.lit(p.avgdl or 1.0))
    return hits.select("query_id", "doc_id", "term", (F.col("weight") * F.col("tf") * (k1 + 1) / norm).alias("part"))


def bm25(p: Postings, queries: DataFrame, k: int = 10, text: str = "query", k1: float = 1.5, b: float = 0.75, drop_zero: bool = False) -> DataFrame:
    """Okapi BM25. A query without tokens has no rows. Where frequent terms weigh less than nothing, as in a corpus of
    few documents, no block can be skipped and all parts are summed; zero-score rows then come from the 2k least ids only."""
    bounded_top_k(k, p.n)
    some = queries.where(F.size(plain_tokens(F.col(text))) > 0)
    asked = bm25_asked(p, some, text)
    if not p.n or not asked.where("weight < 0").isEmpty():
        return exhaustive(bm25_parts(p, some, text, k1, b), some, p, k, drop_zero)
    mean = p.avgdl or 1.0
    scheme = Scheme(lambda tf, dl: tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / mean)))
    found = search(p, asked.withColumn("value", F.lit(0.0)), k, scheme)
    return merged(found, some, p, k, drop_zero)


def tfidf_idf(p: Postings, vocab: DataFrame) -> DataFrame:
    """(term, idf): ln((1 + n) / (1 + df)) + 1."""
    return vocab.select("term", (F.log((1.0 + p.n) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


def _norm_sides(p: Postings, vocab: DataFrame) -> Sides:
    return Sides.of(tfidf_idf(p, vocab).withColumnRenamed("idf", "weight"), squares=True)


def tfidf_asked(p: Postings, queries: DataFrame, vocab: DataFrame, text: str, terms: Column | None = None) -> DataFrame:
    """(query_id, term, weight): weights of length 1 for each query, times the term's idf, which documents weigh by too."""
    idf = tfidf_idf(p, vocab)
    own = query_terms(queries, terms if terms is not None else ngrams(F.col(text))).join(idf, "term").withColumn("qw", F.col("qtf") * F.col("idf"))
    q_norm = own.groupBy("query_id").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("q_norm"))
    return own.join(q_norm, "query_id").select("query_id", "term", (F.col("qw") / F.col("q_norm") * F.col("idf")).alias("weight"))


def tfidf_parts(p: Postings, queries: DataFrame, vocab: DataFrame, text: str = "query", terms: Column | None = None, only: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, term, part): products of the weights of query and document, which sum to their cosine. Both
    weigh by counts times idf over vocabulary terms and have length 1. only: as for bm25_parts."""
    asked = tfidf_asked(p, queries, vocab, text, terms)
    hits = _asked_postings(p, asked, only, _norm_sides(p, vocab))
    return hits.select("query_id", "doc_id", "term", (F.col("weight") * F.col("tf") / F.col("side")).alias("part"))


def tfidf(p: Postings, queries: DataFrame, k: int = 10, text: str = "query", vocab: DataFrame | None = None, drop_zero: bool = False) -> DataFrame:
    """TF-IDF cosine over words and word pairs. A query without vocabulary terms scores 0 everywhere."""
    bounded_top_k(k, p.n)
    vocab = vocab if vocab is not None else vocabulary(p, binary=False)
    asked = tfidf_asked(p, queries, vocab, text).withColumn("value", F.lit(0.0))
    found = search(p, asked, k, Scheme(lambda tf, norm: tf / norm), _norm_sides(p, vocab))
    return merged(found, queries, p, k, drop_zero)


def shared_parts(p: Postings, queries: DataFrame, vocab: DataFrame, text: str = "query", only: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, term, part): the vocabulary terms that a query and a document share, each once with part 1."""
    asked = query_terms(queries, ngrams(F.col(text))).select("query_id", "term").join(vocab.select("term"), "term")
    hits = _asked_postings(p, asked, only)
    return hits.select("query_id", "doc_id", "term", F.lit(1.0).alias("part"))


def jaccard(p: Postings, queries: DataFrame, k: int = 10, text: str = "query", vocab: DataFrame | None = None, drop_zero: bool = False) -> DataFrame:
    """Set overlap over union, of vocabulary terms only."""
    bounded_top_k(k, p.n)
    vocab = vocab if vocab is not None else vocabulary(p, binary=True)
    own = vocab.select("term", F.lit(1.0).alias("weight"))
    asked = query_terms(queries, ngrams(F.col(text))).join(own, "term").select("query_id", "term", "weight")
    asked = asked.join(asked.groupBy("query_id").agg(F.count("*").alias("value")), "query_id")
    # of a bound: a document that shares so many terms has as many at least
    scheme = Scheme(lambda tf, size: np.where(tf > 0, 1.0, 0.0), lambda shared, size, asked: shared / np.maximum(np.maximum(size, shared) + asked - shared, 1e-12))
    found = search(p, asked, k, scheme, Sides.of(own, squares=False))
    return merged(found, queries, p, k, drop_zero)


#: Vectors that a task scores at once, and queries of a turn.
BLOCK, ASKING = 16_384, 16_384


def dense(vectors: DataFrame, queries: DataFrame, k: int = 10, exclude_self: bool = False) -> DataFrame:
    """Exact cosine: vectors (doc_id, v array<double>), queries (query_id, v). Zero vectors score 0.

    Each turn of queries goes to all tasks, which read vectors where they are, some at a time. A product of two matrices
    scores them, and a task keeps each query's k best of all that it has read; these merge.
    """
    spark, kind = vectors.sparkSession, queries.schema["query_id"].dataType.simpleString()
    ship(spark)
    rows = vectors.select(F.col("doc_id").cast("long").alias("doc_id"), "v").coalesce(spark.sparkContext.defaultParallelism)
    found = None
    for own in turns_of(queries.select("query_id", "v"), "query_id", ASKING):
        part = rows.mapInArrow(_nearest(own.column("query_id"), unit(matrix(own.column("v"))), k, exclude_self, BLOCK), f"query_id {kind}, doc_id long, score double")
        found = part if found is None else found.unionByName(part)
    return top_k(found, k)


def _nearest(asked: pa.ChunkedArray, ask: np.ndarray, k: int, exclude_self: bool, size: int):
    own_ids = asked.to_numpy() if exclude_self else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))] * -(-len(ask) // 256)  # query, doc, score of 256 queries
        for some in some_rows(batches, size):
            ids, rows = some.column("doc_id").to_numpy(), unit(matrix(some.column("v")))
            if len(ask) and rows.shape[1] != ask.shape[1]:
                raise ValueError("vectors of one width are needed")
            for n, at in enumerate(range(0, len(ask), 256)):
                own = ask[at : at + 256]
                q, d, s = held[n]
                scores = rows @ own.T
                # rounded scores under the k-th so far, or under the k-th of these rows, are of no use; one more may be the query itself
                full = np.bincount(q, minlength=len(own)) == k
                floor = np.full(len(own), -np.inf)
                last = np.searchsorted(q, np.arange(len(own)), side="right") - 1
                floor[full] = s[last[full]]
                open_, most = np.flatnonzero(~full), k + exclude_self
                if len(open_) and len(ids) > most:
                    floor[open_] = -np.partition(-scores[:, open_], most - 1, axis=0)[most - 1]
                near, asks = np.nonzero(scores >= floor - 2e-6)
                if exclude_self:
                    other = ids[near] != own_ids[at + asks]
                    near, asks = near[other], asks[other]
                q, d, s = np.concatenate([q, asks]), np.concatenate([d, ids[near]]), np.concatenate([s, np.round(scores[near, asks], 6) + 0.0])
                order = np.lexsort((d, -s, q))
                place = np.arange(len(q)) - np.searchsorted(q[order], q[order])
                order = order[place < k]
                held[n] = q[order], d[order], s[order]
        for n, (q, d, s) in enumerate(held):
            yield pa.RecordBatch.from_arrays([asked.take(pa.array(256 * n + q, pa.int64())).combine_chunks(), pa.array(d), pa.array(s)], ["query_id", "doc_id", "score"])

    return run


def rrf(rankings: list[DataFrame], k: int, rrf_k: int = 60) -> DataFrame:
    """Reciprocal rank fusion: a list adds 1 / (rrf_k + rank), or 0 where it lacks the document. Ties go to the
    document of the earlier list, then of the better rank there."""
    if not rankings or rrf_k < 0:
        raise ValueError("fusion takes at least one ranking and rrf_k of at least 0")
    bounded_top_k(k, 0)
    rows = None
    for n, r in enumerate(rankings):
        own = r.select("query_id", "doc_id", "rank", F.lit(n).alias("list"))
        rows = own if rows is None else rows.unionByName(own)
    fused = rows.groupBy("query_id", "doc_id").agg(F.sum(1.0 / (rrf_k + F.col("rank"))).alias("score"), F.min(F.struct("list", "rank")).alias("first"))
    order = W.partitionBy("query_id").orderBy(F.round("score", 10).desc(), "first.list", "first.rank", "doc_id")
    return fused.withColumn("r", F.row_number().over(order).cast("long")).where(F.col("r") <= k).select("query_id", "doc_id", F.round("score", 10).alias("score"), F.col("r").alias("rank"))


def lexical_scorer(query: Column, text: Column) -> Column:
    """The default pair scorer: the share of the query's distinct tokens that the text has."""
    asked = F.array_distinct(plain_tokens(query))
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, plain_tokens(text))) / F.size(asked)).otherwise(0.0)


def rerank(base: DataFrame, queries: DataFrame, docs: DataFrame, text: str = "text", k: int = 10, depth: int = 50, scorer=lexical_scorer) -> DataFrame:
    """The first depth rows of a ranking in the order of a scorer of (query, text). At most depth rows a query.

    scorer gives a column from two; a model comes as a pandas UDF. Only candidates reach it.
    """
    bounded_top_k(k, 0)
    few = base.where(F.col("rank") <= depth).select("query_id", "doc_id")
    pairs = docs.select("doc_id", F.col(text).alias("__text")).join(few, "doc_id").join(queries.select("query_id", F.col("query").alias("__query")), "query_id")
    scored = pairs.select("query_id", "doc_id", F.round(scorer(F.col("__query"), F.col("__text")), 6).alias("score"))
    return top_k(scored, min(k, depth))
