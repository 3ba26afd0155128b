"""Ranked lexical search by variable-block-max WAND: the k best documents of each item, exactly.

Documents are reduced to the counts of the terms that items ask for (hashes of 64 bits; items go in blocks of about
ASKED terms, so what workers hold of them is bounded), dealt at random into shards of about POSTINGS postings, and
indexed there: a posting is a document and what the term, by its weight, adds to its score. Dynamic programming chooses the block
boundaries of each posting list so that the error of the blocks' maxima as bounds, plus a price for each block, is
least. A search adds up the maxima between all boundaries of the item's lists, scores the stretches of highest bound
first, block by block, and skips every stretch whose bound is under the k-th score so far; that is the pivot test of
WAND, put to all stretches at once. So no document that could be among the k best is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from querent.llm import textscan
from querent.llm.runtime import cut
from querent.llm.textscan import _BASE, _INVERSE, _RANDOM, mix, power_table, tidied, word_spans

#: Pairs of item and term in a block of items, postings in a shard.
ASKED, POSTINGS = 1 << 19, 500_000
#: Postings in a cell, between which block boundaries may lie; cells in a block at most; what a block costs, in mean postings.
CELL, LONGEST, PRICE = 8, 32, 16
#: Stretches that a search scores before it looks at its threshold for the first time; twice as many each time after.
FIRST = 16

_GAP = np.ones(256, bool)
_GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_VALUES = _RANDOM.copy()
_VALUES[65:91] = _VALUES[97:123]
_VALUES[_GAP] = 0


def term_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each term (runs of ASCII letters and digits and of all beyond ASCII, A-Z lower-cased), and the texts' offsets in them."""
    at, rows = word_spans(data, offsets, _GAP)
    if not len(at):
        return np.zeros(0, np.uint64), rows
    sums = np.add.reduceat(_VALUES[data] * power_table(_BASE, len(data)), at)
    return mix(sums * power_table(_INVERSE, len(data))[at]), rows


def counted(row: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, term), in this order, and how often each occurs."""
    order = np.lexsort((term, row))
    row, term = row[order], term[order]
    first = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (term[1:] != term[:-1])))) if len(row) else np.zeros(0, np.int64)
    return row[first], term[first], np.diff(np.append(first, len(row)))


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes, rows = term_hashes(*textscan.utf8(batch.column("text")))
        row = np.repeat(np.arange(batch.num_rows), np.diff(rows))
        row, term, _ = counted(row, hashes)
        yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(row)), pa.array(term.view(np.int64))], ["item_id", "term"])


def _bags(asked: np.ndarray):
    """Documents as counts of the asked terms (numbers of the sorted hashes) and the number of all terms."""
    known = np.zeros(1 << 22, bool)
    known[(asked >> np.uint64(42)).astype(np.int64)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            data, offsets = textscan.utf8(batch.column("text"))
            for first, last in textscan.blocks(offsets, 1_000_000):
                base = offsets[first]
                hashes, rows = term_hashes(data[base : offsets[last]], offsets[first : last + 1] - base)
                n = np.diff(rows)
                row = np.repeat(np.arange(last - first), n)
                maybe = np.flatnonzero(known[(hashes >> np.uint64(42)).astype(np.int64)])
                place = np.minimum(np.searchsorted(asked, hashes[maybe]), max(len(asked) - 1, 0))
                right = asked[place] == hashes[maybe] if len(asked) else np.zeros(0, bool)
                row, term, tf = counted(row[maybe[right]], place[right])
                at = np.searchsorted(row, np.arange(last - first + 1)).tolist()
                term, tf = term.astype("<u4"), tf.astype("<u4")
                slices = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary())
                keys = (part << 32) + seen + np.arange(last - first)
                seen += last - first
                yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column("doc_id").slice(first, last - first), pa.array(n, pa.int64()), slices(term), slices(tf)], ["row", "doc_id", "n", "terms", "tfs"])

    return tidied(run)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents hold each term; under -1 those with terms, under -2 all their terms, under -3 postings."""
    for batch in batches:
        terms = np.frombuffer(b"".join(batch.column("terms").to_pylist()), np.uint32)
        term, df = np.unique(terms, return_counts=True)
        n = batch.column("n").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(np.append(term.astype(np.int64), [-1, -2, -3])), pa.array(np.append(df, [(n > 0).sum(), n.sum(), len(terms)]))], ["term", "n"])


def weights(documents: int, df: np.ndarray) -> np.ndarray:
    """floor(1000 ln((2 N + 2) / (2 df + 1)))."""
    return np.floor(1000 * np.log((2.0 * documents + 2) / (2.0 * df + 1))).astype(np.int64)


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """What a term of weight 1 adds to the score of a document of n terms that holds it tf times: under 10**6."""
    m = 10 + (90 * n * documents) // max(length, 1)
    return ((1_000_000_000 * tf) // (1000 * tf + 8 * m)).astype(np.int32)


def block_ends(value: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether a block ends with each posting. Lists (start, size of at least 1) lie end to end in value.

    Over cells of CELL postings, for all lists at once, longest first: the least sum over blocks of postings times
    maximum less their values, plus PRICE mean values a block.
    """
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    cells = -(-size // CELL)
    total = int(cells.sum())
    first = np.cumsum(cells) - cells
    inside = np.arange(total) - np.repeat(first, cells)
    begin = np.repeat(start, cells) + inside * CELL
    count = np.minimum(CELL, np.repeat(start + size, cells) - begin)
    sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(value)])
    cell_sum = sums[begin + count] - sums[begin]
    cell_max = np.array([value[begin + np.minimum(k, count - 1)] for k in range(CELL)]).max(axis=0)
    price = PRICE * ((sums[start + size] - sums[start]) / size)
    back = np.ones(total, np.int64)
    # for each list: cost up to the last LONGEST boundaries, nearest first, and counts, sums and maxima since then
    cost = np.full((len(size), LONGEST), np.inf)
    cost[:, 0] = 0.0
    since, added, highest = (np.zeros((len(size), LONGEST)) for _ in range(3))
    active = len(size)
    for j in range(int(cells[0]) if len(cells) else 0):
        active = int(np.searchsorted(-cells[:active], -j, side="left"))  # lists with more than j cells
        at = first[:active] + j
        since[:active] += count[at, None]
        added[:active] += cell_sum[at, None]
        np.maximum(highest[:active], cell_max[at, None], out=highest[:active])
        here = cost[:active] + since[:active] * highest[:active] - added[:active]
        chosen = here.argmin(axis=1)
        back[at] = chosen + 1
        for held, new in ((cost, here[np.arange(active), chosen] + price[:active]), (since, 0.0), (added, 0.0), (highest, 0.0)):
            held[:active, 1:] = held[:active, :-1].copy()
            held[:active, 0] = new
    ends, at, left = np.zeros(len(value), bool), first + cells - 1, cells.copy()
    while len(at):
        ends[begin[at] + count[at] - 1] = True
        step = back[at]
        left = left - step
        keep = left > 0
        at, left = at[keep] - step[keep], left[keep]
    return ends


class Shard:
    """Posting lists by term, each cut into blocks with the largest share in them."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, share: np.ndarray):
        """Postings by term, then document (numbers from 0 up)."""
        at = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1]))) if len(term) else np.zeros(0, np.int64)
        self.terms, self.doc, self.share = term[at], doc, share
        self.list_at = np.append(at, len(term))
        ends = block_ends(share, at, np.diff(np.append(at, len(term))))
        self.end = np.flatnonzero(ends) + 1
        self.begin = np.concatenate([np.zeros(min(len(self.end), 1), np.int64), self.end[:-1]])
        self.most = np.maximum.reduceat(share, self.begin) if len(self.begin) else np.zeros(0, np.int64)
        self.block_at = np.searchsorted(self.begin, np.append(at, len(term)))
        self.score = np.zeros(int(doc.max()) + 1 if len(doc) else 0, np.int64)
        self.floors: dict[tuple[int, int], int] = {}
        self.read = 0  # postings that searches have looked at

    def floor(self, place: int, k: int) -> int:
        """The k-th largest share of a list, told once: no k-th score of an item that asks for it is less."""
        if (place, k) not in self.floors:
            own = self.share[self.list_at[place] : self.list_at[place + 1]]
            self.floors[place, k] = int(np.partition(own, -k)[-k]) if len(own) >= k else 0
        return self.floors[place, k]

    def search(self, terms: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of the k best by summed shares, ties to the smaller number; terms: distinct, ascending."""
        place = np.searchsorted(self.terms, terms)
        place = place[(place < len(self.terms)) & (self.terms[np.minimum(place, max(len(self.terms) - 1, 0))] == terms)] if len(self.terms) else place[:0]
        if not len(place):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lists = self.block_at[place + 1] - self.block_at[place]
        block, of = _runs(self.block_at[place], lists), np.repeat(np.arange(len(place)), lists)
        begin, end, most = self.begin[block], self.end[block], self.most[block]
        top = np.maximum.reduceat(most, np.cumsum(lists) - lists)
        rising = np.argsort(top, kind="stable")
        reach = np.cumsum(top[rising])
        last = self.doc[end - 1].astype(np.int64)
        # a list's block covers the documents after the block before it
        ahead = np.concatenate(([-1], last[:-1]))
        ahead[np.cumsum(lists) - lists] = -1
        bounds = np.unique(np.append(last, -1))
        lo, hi = np.searchsorted(bounds, ahead), np.searchsorted(bounds, last)  # stretches lo .. hi - 1; stretch i is (bounds[i], bounds[i + 1]]
        rises = np.zeros(len(bounds), np.int64)
        np.add.at(rises, lo, most)
        np.add.at(rises, hi, -most)
        bound = np.cumsum(rises)[:-1]
        order = np.argsort(-bound, kind="stable")
        held = np.zeros(0, np.int64)
        held_score, done, some = held.copy(), 0, FIRST
        threshold = max(self.floor(p, k) for p in place.tolist())
        while done < len(order) and bound[order[done]] > 0 and bound[order[done]] >= threshold:
            now = order[done : done + some]
            now = now[(bound[now] >= threshold) & (bound[now] > 0)]
            done += some
            some *= 2
            chosen = np.zeros(len(bounds) + 1, np.int64)
            chosen[now + 1] = 1
            ahead_chosen = np.cumsum(chosen)
            names = np.ones(len(place), bool)  # lists that can name a document
            names[rising[reach < threshold]] = False
            meets = np.flatnonzero((ahead_chosen[hi] > ahead_chosen[lo]) & names[of])
            at = _runs(begin[meets], (end - begin)[meets])
            self.read += len(at)
            doc = self.doc[at]
            inside = chosen[np.searchsorted(bounds, doc)] > 0
            doc, at = doc[inside], at[inside]
            np.add.at(self.score, doc, self.share[at])
            found = np.unique(doc)
            for own in place[~names].tolist():
                first, past = self.list_at[own], self.list_at[own + 1]
                where = np.minimum(first + np.searchsorted(self.doc[first:past], found), past - 1)
                held_there = self.doc[where] == found
                self.score[found[held_there]] += self.share[where[held_there]]
                self.read += int(held_there.sum())
            doc, score = np.concatenate([held, found]), np.concatenate([held_score, self.score[found]])
            self.score[found] = 0
            best = np.lexsort((doc, -score))[:k]
            held, held_score = doc[best], score[best]
            if len(held) == k:
                threshold = max(threshold, int(held_score[-1]))
        positive = held_score > 0
        return held[positive], held_score[positive]


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


_INDEX = "shard long, ids binary, terms binary, docs binary, impacts binary"


def _index(documents: int, length: int):
    """A shard's postings, documents numbered by ascending id."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("row", "ascending")])
        terms, tfs = (table.column(c).to_pylist() for c in ("terms", "tfs"))
        term, tf = np.frombuffer(b"".join(terms), np.uint32), np.frombuffer(b"".join(tfs), np.uint32).astype(np.int64)
        doc = np.repeat(np.arange(table.num_rows, dtype=np.int32), [len(t) // 4 for t in terms])
        impact = impacts(tf, table.column("n").to_numpy()[doc], documents, length)
        order = np.argsort(term, kind="stable")
        columns = [table.column("doc_id").to_numpy().astype("<i8"), term[order], doc[order], impact[order]]
        return pa.table([pa.array([table.column("shard")[0].as_py()], pa.int64()), *(pa.array([c.tobytes()], pa.binary()) for c in columns)], ["shard", "ids", "terms", "docs", "impacts"])

    return run


def _find(items: pa.Array, at: np.ndarray, asked: np.ndarray, weight: np.ndarray, k: int):
    """Each item's k best documents of a shard; an item's terms are asked[at[i]:at[i + 1]], their weights are by term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, term = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["terms"], np.uint32).astype(np.int64)
                shard = Shard(term, np.frombuffer(row["docs"], np.int32), weight[term] * np.frombuffer(row["impacts"], np.int32))
                which, docs, scores = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for i in range(len(items)):
                    doc, score = shard.search(asked[at[i] : at[i + 1]], k)
                    which += [i] * len(doc)
                    docs.append(ids[doc])
                    scores.append(score)
                yield pa.RecordBatch.from_arrays([items.take(pa.array(which, pa.int64())), pa.array(np.concatenate(docs)), pa.array(np.concatenate(scores))], ["item_id", "doc_id", "score"])

    return tidied(run)


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents (doc_id, text) of highest score above 0 of each item (item_id, text).

    A null text has no terms; an item without terms, or of none that a document holds, has no row. Rows of one item_id
    are one item with the terms of all; a null item_id is an item too. Rows that repeat a doc_id are documents of their
    own; a row without doc_id is none and counts nowhere. Equal scores are ranked by ascending doc_id. Empty tables
    give an empty one; texts are read whole, of any length. Other columns are ignored.
    """
    kind = items.schema["item_id"].dataType.simpleString()
    asked = items.select("item_id", "text").mapInArrow(_asked, f"item_id {kind}, term long").distinct()
    asked = cut(asked, "asked")
    blocks = max(1, -(-asked.count() // ASKED))
    found = None
    for block in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).toArrow().combine_chunks()
        part = cut(_search_block(docs, own, kind, k), "found")
        found = part if found is None else found.unionByName(part)
    order = W.partitionBy("item_id").orderBy(F.col("score").desc(), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _search_block(docs: DataFrame, own: pa.Table, kind: str, k: int) -> DataFrame:
    """own: (item_id, term) of a block of items."""
    hashes = own.column("term").to_numpy().view(np.uint64)
    terms, number = np.unique(hashes, return_inverse=True)
    coded = own.column("item_id").combine_chunks().dictionary_encode(null_encoding="encode") if own.num_rows else pa.array([], own.schema.field("item_id").type).dictionary_encode()
    code = coded.indices.to_numpy().astype(np.int64)
    order = np.lexsort((number, code))
    at, ask = np.searchsorted(code[order], np.arange(len(coded.dictionary) + 1)), number[order]
    present = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bags = cut(present.mapInArrow(_bags(terms), "row long, doc_id long, n long, terms binary, tfs binary"), "bags")
    counts = dict(bags.mapInArrow(_frequencies, "term long, n long").groupBy("term").agg(F.sum("n")).collect())
    documents, length, postings = (counts.pop(c, 0) for c in (-1, -2, -3))
    df = np.zeros(len(terms), np.int64)
    df[list(counts)] = list(counts.values())
    shards = max(1, -(-postings // POSTINGS))
    dealt = bags.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))
    index = cut(dealt.groupBy("shard").applyInArrow(_index(documents, length), _INDEX), "index")
    return index.mapInArrow(_find(coded.dictionary, at, ask, weights(documents, df), k), f"item_id {kind}, doc_id long, score long")

