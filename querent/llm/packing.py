"""Packing by lexical retrieval: windows of related documents, cut to fit.

Tokenising writes each document as its full windows (checksums only), a tail of ids, and the whole document's
distinct terms with their counts. Counts of terms and the mean length are those of all documents. Documents are
dealt by content: k-means over a sample's hashed BM25 weights makes cells, near ones make up a shard of about
SHARD rows, and a cell of more is dealt by hash. Each shard is a BM25 inverted index over whole documents, and a
seed asks with all its terms that others hold too; other shards aren't asked. A seed's window is filled with its
best unused neighbours; the one that overflows is cut, and its rest seeds the next window. So a shard has one
sequence that isn't full, its last.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querent.llm import textscan
from querent.llm.byte_bpe import SpanCache
from querent.llm.runtime import cut
from querent.llm.textscan import tidied, tidy

WINDOW, END, SHARD = 2048, 1, 2000
K1, B, DENSE = 1.2, 0.75, 4
#: Cells for a shard and at most, sampled documents for a cell and at most, dimensions that terms are hashed to, k-means rounds.
PER_SHARD, CELLS, PER_CELL, SAMPLE, DIMENSIONS, ROUNDS = 16, 1024, 40, 20_000, 256, 12
TERM_IDS = 1 << 16
_rng = np.random.default_rng(9)
_PLACE, _SIGN = _rng.integers(0, DIMENSIONS, TERM_IDS), _rng.integers(0, 2, TERM_IDS) * 2.0 - 1
#: Distinct pieces of words, and characters of them, whose ids a worker keeps besides those of whole words.
PIECES, PIECE_CHARS = 400_000, 32_000_000
#: What goes through the tokenizer itself: characters from U+0250 on and beginnings of special tokens.
_HARD = re.compile("[\u0250-\U0010ffff]|<\\|")


class WordTokenizer:
    """Ids of whole texts, word by word: no token of this kind of vocabulary crosses white space.

    Words of characters up to U+024F take a short way (lower case, the vocabulary's own split, its BPE);
    any other word, and any that may hold a special token, goes through the tokenizer itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.model = self.full.model
        found = re.search(r'Regex\("(.*)"\), behavior=Removed, invert=True', str(self.full.pre_tokenizer))
        self.plain = found is not None and "NFC(), Replace(pattern=Regex" in str(self.full.normalizer)
        self.split = regex.compile("\n|" + found[1]) if found else None
        # the byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(own)]
        self.alphabet = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.reset()

    def reset(self) -> None:
        self.cache = SpanCache(self._learn)
        self.reset_pieces()

    def reset_pieces(self) -> None:
        self.pieces, self.piece_ids = _Numbered(), _Lists()
        self.pieces["\n"] = 0
        self.piece_ids.put(np.array([0]), [], np.array([0]))

    def _split(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain words end to end, and how many each has: one pass of the split over all of them."""
        found = self.split.findall("\n".join(words).lower())
        index = np.fromiter(map(self.pieces.__getitem__, found), np.int64, len(found))
        if self.pieces.fresh:
            tokenize, alphabet = self.model.tokenize, self.alphabet.__getitem__
            lists = [[t.id for t in tokenize(p if p.isascii() and p.isprintable() else "".join(map(alphabet, p.encode())))] for p in self.pieces.fresh]
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            self.piece_ids.put(len(self.pieces) - len(lists) + np.arange(len(lists)), list(chain.from_iterable(lists)), sizes)
            self.pieces.fresh = []
        ids, lengths = self.piece_ids.gather(index)
        ends = np.append(np.cumsum(lengths)[index == 0], lengths.sum())
        return ids, np.diff(ends, prepend=0)

    def _learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words end to end, and how many each has; none depends on what stands beside it."""
        if len(self.pieces) > PIECES or self.pieces.chars > PIECE_CHARS:
            self.reset_pieces()
        none = np.zeros(len(words), bool)
        joined = b"\n".join(words).decode("utf-8", "replace")
        if self.plain and not _HARD.search(joined):
            return *self._split(joined.split("\n")), none
        texts = joined.split("\n")
        easy = np.array([self.plain and not _HARD.search(t) for t in texts])
        lists = _Lists()
        if easy.any():
            lists.put(np.flatnonzero(easy), *self._split([t for t, e in zip(texts, easy.tolist()) if e]))
        slow = [e.ids for e in self.full.encode_batch_fast([t for t, e in zip(texts, easy.tolist()) if not e], add_special_tokens=False)]
        lists.put(np.flatnonzero(~easy), list(chain.from_iterable(slow)), np.array([len(x) for x in slow], np.int64))
        return *lists.gather(np.arange(len(texts))), none

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each text's followed by END, and the texts' offsets in them."""
        start, rows = textscan.word_spans(data, offsets)
        gap = np.append(np.flatnonzero(textscan.SPACE[data]), len(data))
        row = np.searchsorted(offsets, start, side="right") - 1
        end = np.minimum(gap[np.searchsorted(gap, start)], offsets[row + 1])
        ids, lengths, other = self.cache.look_up(data, start, end)
        if other.any():  # words whose hash another word has
            whole = data.tobytes()
            lists = np.split(ids, np.cumsum(lengths)[:-1])
            for k in np.flatnonzero(other).tolist():
                lists[k] = self._learn([whole[start[k] : end[k]]])[0]
            ids, lengths = np.concatenate(lists), np.array([len(x) for x in lists])
        ends = np.concatenate(([0], np.cumsum(lengths)))[rows[1:]]
        return np.insert(ids, ends, END).astype(np.uint16), np.concatenate(([0], ends + np.arange(1, len(ends) + 1)))


class _Lists:
    """Numbered lists of ids, kept end to end."""

    def __init__(self):
        self.flat, self.end = np.zeros(1 << 16, np.uint16), 0
        self.start, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def put(self, numbers: np.ndarray, ids: np.ndarray | list[int], sizes: np.ndarray) -> None:
        if self.end + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ids)), np.uint16)])
        if len(numbers) and numbers.max() >= len(self.start):
            more = np.zeros(max(len(self.start), int(numbers.max()) + 1), np.int64)
            self.start, self.size = np.concatenate([self.start, more]), np.concatenate([self.size, more])
        self.flat[self.end : self.end + len(ids)] = ids
        self.start[numbers] = self.end + np.cumsum(sizes) - sizes
        self.size[numbers] = sizes
        self.end += len(ids)

    def gather(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists' ids end to end, and their lengths."""
        lengths = self.size[index]
        ends = np.cumsum(lengths)
        return self.flat[np.repeat(self.start[index] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)], lengths


class _Numbered(dict):
    """Numbers its keys as they are asked for; fresh has the new ones."""

    def __init__(self):
        super().__init__()
        self.fresh: list[bytes] = []
        self.chars = 0

    def __missing__(self, word):
        self[word] = n = len(self)
        self.fresh.append(word)
        self.chars += len(word)
        return n


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One per worker and file."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def terms_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids, ascending, and how often each occurs."""
    own = np.sort(ids.astype(np.uint16), kind="stable")
    at = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else np.zeros(0, np.int64)
    return own[at], np.diff(np.append(at, len(own))).astype(np.int32)


_TOKENS = "doc_id long, doc_tokens long, full array<long>, tail binary, terms binary, counts binary"


def _tokenise(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer(path)
        for batch in batches:
            data, offsets = textscan.utf8(batch.column("text"))
            for first, last in textscan.blocks(offsets):
                base = offsets[first]
                ids, at = encoder.encode(data[base : offsets[last]], offsets[first : last + 1] - base)
                sizes = np.diff(at)
                full, tails, terms, counts = [], [], [], []
                for lo, size in zip(at[:-1].tolist(), sizes.tolist()):
                    whole = size // WINDOW * WINDOW
                    full.append([crc(ids[lo + k : lo + k + WINDOW]) for k in range(0, whole, WINDOW)])
                    tails.append(ids[lo + whole : lo + size].tobytes())
                    own, tf = terms_of(ids[lo : lo + size])
                    terms.append(own.tobytes())
                    counts.append(tf.tobytes())
                columns = [pa.array(sizes), pa.array(full, pa.list_(pa.int64())), *(pa.array(x, pa.binary()) for x in (tails, terms, counts))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, last - first), *columns], ["doc_id", "doc_tokens", "full", "tail", "terms", "counts"])

    return tidied(run)


class Bags:
    """Documents as bags of terms, end to end: term, doc and tf of each entry, by document and then term."""

    def __init__(self, terms: list[bytes], counts: list[bytes]):
        self.n = len(terms)
        self.term = np.frombuffer(b"".join(terms), np.uint16).astype(np.int64)
        self.tf = np.frombuffer(b"".join(counts), np.int32)
        self.doc = np.repeat(np.arange(self.n), [len(t) // 2 for t in terms])
        self.sizes = np.bincount(self.doc, self.tf, self.n)

    @classmethod
    def of(cls, docs: list[np.ndarray]) -> Bags:
        found = [terms_of(d) for d in docs]
        return cls([t.tobytes() for t, _ in found], [c.tobytes() for _, c in found])


class Statistics:
    """How many documents there are, how many hold each term, and their mean length."""

    def __init__(self, n: int, df: np.ndarray, mean: float):
        self.n, self.df, self.mean = n, df, mean
        self.idf = np.log1p((n - df + 0.5) / (df + 0.5))

    @classmethod
    def of(cls, bags: Bags) -> Statistics:
        return cls(bags.n, np.bincount(bags.term, minlength=TERM_IDS), float(bags.sizes.mean()) if bags.n else 0.0)

    def weights(self, bags: Bags) -> np.ndarray:
        norm = K1 * (1 - B + B * bags.sizes / max(self.mean, 1e-9))
        return self.idf[bags.term] * bags.tf * (K1 + 1) / (bags.tf + norm[bags.doc])


def vectors(bags: Bags, statistics: Statistics) -> np.ndarray:
    """The documents' BM25 weights hashed to DIMENSIONS, of length 1."""
    weight = statistics.weights(bags) * (statistics.df[bags.term] > 1)
    out = np.bincount(bags.doc * DIMENSIONS + _PLACE[bags.term], weight * _SIGN[bags.term], bags.n * DIMENSIONS).reshape(bags.n, DIMENSIONS)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def cells_of(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest of the centres by angle for each point."""
    return np.concatenate([(points[k : k + 1024] @ centres.T).argmax(axis=1) for k in range(0, len(points), 1024)] or [np.zeros(0, np.int64)])


def centres_of(points: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means; a centre that nothing is near moves to a point of the fullest cells."""
    rng = np.random.default_rng(11)
    centres = points[rng.permutation(len(points))[:k]].copy()
    for _ in range(ROUNDS):
        cell = cells_of(points, centres)
        count = np.bincount(cell, minlength=len(centres))
        order = np.argsort(cell, kind="stable")
        full = np.flatnonzero(count)
        centres[full] = np.add.reduceat(points[order], (np.cumsum(count) - count)[full], axis=0)
        empty = np.flatnonzero(count == 0)
        if len(empty):
            share = count[cell] / count[cell].sum()
            centres[empty] = points[rng.choice(len(points), len(empty), p=share)]
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
    return centres


def neighbourly(centres: np.ndarray) -> list[int]:
    """The centres, each followed by the one nearest to it of those not yet named."""
    left, out = np.ones(len(centres), bool), [0]
    for _ in range(len(centres) - 1):
        left[out[-1]] = False
        out.append(int(np.where(left, centres @ centres[out[-1]], -2.0).argmax()))
    return out


class Index:
    """BM25 over a shard's documents: postings by term, but a column of a dense matrix for each term that more than
    a DENSE-th of the shard's documents hold. Weights are by the statistics of all documents."""

    def __init__(self, bags: Bags, statistics: Statistics):
        self.n = bags.n
        shared = statistics.df[bags.term] > 1  # other terms can't score
        term, doc, weight = bags.term[shared], bags.doc[shared], statistics.weights(bags)[shared]
        frequent = np.flatnonzero(np.bincount(term, minlength=TERM_IDS) * DENSE > self.n)
        column = np.full(TERM_IDS, -1)
        column[frequent] = np.arange(len(frequent))
        dense = column[term] >= 0
        self.matrix = np.zeros((self.n, len(frequent)))
        self.matrix[doc[dense], column[term[dense]]] = weight[dense]
        self.holds = (self.matrix != 0).astype(np.float64)
        term, doc, weight = term[~dense], doc[~dense], weight[~dense]
        self.query_at, self.query_terms = np.searchsorted(doc, np.arange(self.n + 1)), term
        order = np.argsort(term.astype(np.uint16), kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.start = np.searchsorted(term[order], np.arange(TERM_IDS + 1))

    def scores(self, doc: int) -> np.ndarray:
        """BM25 of all documents for the distinct terms of one."""
        terms = self.query_terms[self.query_at[doc] : self.query_at[doc + 1]]
        lo, sizes = self.start[terms], self.start[terms + 1] - self.start[terms]
        ends = np.cumsum(sizes)
        at = np.repeat(lo - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)
        return np.bincount(self.doc[at], self.weight[at], self.n) + self.matrix @ self.holds[doc]


def best_first(score: np.ndarray, k: int, some: int = 16) -> Iterator[int]:
    """The k places of most score, ties by place; sorted in full only if more than some are asked for."""
    if k > some:
        least = np.partition(score, -some)[-some]
        top = np.flatnonzero(score >= least)
        yield from top[np.argsort(-score[top], kind="stable")].tolist()
        yield from np.argsort(-score, kind="stable")[len(top) : k].tolist()
    else:
        yield from np.argsort(-score, kind="stable")[:k].tolist()


def pack(tails: list[np.ndarray], index: Index) -> list[tuple[int, int, int, int, int]]:
    """(document, start in its tail, length, sequence, offset) of each piece of the tails; sequences from 0."""
    unused, left = np.array([len(t) > 0 for t in tails], bool), int(sum(len(t) > 0 for t in tails))
    out, sequence, fill, carried, cursor = [], 0, 0, None, 0
    while left or carried:
        if carried:
            seed, start = carried
            carried = None
        else:
            while not unused[cursor]:
                cursor += 1
            seed, start = cursor, 0
            unused[seed] = False
            left -= 1
        order = iter(())
        if left and len(tails[seed]) - start < WINDOW:
            score = np.where(unused, index.scores(seed), -1.0)
            order = best_first(score, left)
        doc = seed
        while doc is not None:
            size = min(len(tails[doc]) - start, WINDOW - fill)
            out.append((doc, start, size, sequence, fill))
            fill, start = fill + size, start + size
            if start < len(tails[doc]):
                carried = (doc, start)
            if fill == WINDOW:
                sequence, fill = sequence + 1, 0
                break
            doc, start = next(order, None), 0
            if doc is not None:
                unused[doc] = False
                left -= 1
    return out


def _pack_shard(table: pa.Table, statistics: Statistics) -> pa.Table:
    """Pieces of a shard's documents. Its sequences are numbered from shard * 2**32."""
    table = table.sort_by([("doc_id", "ascending"), ("doc_tokens", "ascending"), ("tail", "ascending"), ("terms", "ascending")])
    shard = table.column("shard")[0].as_py()
    ids, sizes, full, terms, counts = (table.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "full", "terms", "counts"))
    tails = [np.frombuffer(t, np.uint16) for t in table.column("tail").to_pylist()]
    rows, last = [], -1
    for doc, start, size, sequence, offset in pack(tails, Index(Bags(terms, counts), statistics)):
        whole = sizes[doc] - len(tails[doc])
        rows.append((ids[doc], whole + start, size, crc(tails[doc][start : start + size]), sizes[doc], sequence, offset))
        last = sequence
    for doc, sums in enumerate(full):
        for k, value in enumerate(sums):
            last += 1
            rows.append((ids[doc], k * WINDOW, WINDOW, value, sizes[doc], last, 0))
    columns = list(zip(*rows)) if rows else [()] * 7
    columns[5] = [(shard << 32) + s for s in columns[5]]
    return pa.table([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def _bags(batch: pa.RecordBatch) -> Bags:
    return Bags(batch.column("terms").to_pylist(), batch.column("counts").to_pylist())


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that hold each term; under -1 all documents, under -2 their ids."""
    df, n, size = np.zeros(TERM_IDS, np.int64), 0, 0
    for batch in batches:
        bags = _bags(batch)
        df += np.bincount(bags.term, minlength=TERM_IDS)
        n, size = n + bags.n, size + int(bags.sizes.sum())
    term = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(term, [-1, -2])), pa.array(np.append(df[term], [n, size]))], ["term", "n"])


def corpus_statistics(rows: DataFrame) -> Statistics:
    """Those of all documents of rows; what is collected is bounded by the vocabulary."""
    found = {r.term: r.n for r in rows.select("terms", "counts").mapInArrow(_count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n, size = found.pop(-1, 0), found.pop(-2, 0)
    df = np.zeros(TERM_IDS, np.int64)
    df[list(found)] = list(found.values())
    return Statistics(n, df, size / max(n, 1))


def _deal(rows: DataFrame, statistics: Statistics) -> DataFrame:
    """rows with the column shard: documents of like content in one, about SHARD in each. How many rows a cell has
    is told by its share of the sample, so the documents pass once."""
    shards = max(1, -(-statistics.n // SHARD))
    key = F.xxhash64("doc_id", "doc_tokens", "tail", "terms")
    cells = min(PER_SHARD * shards, CELLS)
    share = min(1.0, min(PER_CELL * cells, SAMPLE) / max(statistics.n, 1))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = [vectors(_bags(b), statistics) for b in batches]
        points = np.concatenate(points) if points else np.zeros((0, DIMENSIONS), np.float32)
        centres = centres_of(points, cells)
        counts = np.bincount(cells_of(points, centres), minlength=len(centres))
        yield pa.RecordBatch.from_arrays([pa.array([c.tobytes() for c in centres], pa.binary()), pa.array(counts, pa.int64())], ["centre", "n"])

    sample = rows.where(F.pmod(key, F.lit(1 << 30)) < int(share * (1 << 30))).select("terms", "counts")
    found = sorted((bytes(r.centre), r.n) for r in sample.repartition(1).mapInArrow(tidied(learn), "centre binary, n long").collect())
    centres = np.frombuffer(b"".join(c for c, _ in found), np.float32).reshape(-1, DIMENSIONS)
    each = statistics.n / max(1, sum(n for _, n in found))
    firsts, parts, shard, fill = np.zeros(max(1, len(found)), np.int64), np.ones(max(1, len(found)), np.int64), 0, 0.0
    for cell in neighbourly(centres) if found else ():
        count = found[cell][1] * each
        own = max(1, -(-int(count) // SHARD))
        if fill and fill + count > SHARD * 5 // 4:
            shard, fill = shard + 1, 0.0
        firsts[cell], parts[cell] = shard, own
        shard, fill = (shard + own, 0.0) if own > 1 else (shard, fill + count)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = cells_of(vectors(_bags(batch), statistics), centres) if len(centres) else np.zeros(batch.num_rows, np.int64)
            place = firsts[cell] + batch.column("key").to_numpy() % parts[cell]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(place, pa.int64())], [*batch.schema.names[:-1], "shard"])

    return rows.withColumn("key", key).mapInArrow(tidied(assign), _TOKENS + ", shard long")


def pack_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """The pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    vocabulary: path of the tokenizer's file, the same on every machine. A text that is null or empty has
    the end id alone. Rows that repeat a doc_id are packed as documents of their own; a null doc_id stays
    null. Each id of each row lies in one piece; a sequence holds up to WINDOW ids. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_tokenise(vocabulary), _TOKENS)
    rows = cut(rows, "tokens")
    statistics = corpus_statistics(rows)

    def run(table: pa.Table) -> pa.Table:
        try:
            return _pack_shard(table, statistics)
        finally:
            tidy()

    return _deal(rows, statistics).groupBy("shard").applyInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
