"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A sentence's odds grow with its words and their prefixes, none of which speaks for it, over a base that
scoring takes off again: without any learned feature a sentence is clean, however many there are. A document
is toxic unless each of its sentences is clean (noisy-or). Gradients of the document likelihood reach the sentences, so the
labels of documents teach which sentences offend, and those are then located.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querent.llm import learning, textscan
from querent.llm.runtime import crc_mod
from querent.llm.textscan import tidied

_U = np.uint64
BITS, EPOCHS, BATCH, RATE, PREFIXES = 18, 10, 64, 0.5, (3, 4, 5)
START_BIAS, SPARSITY = -6.0, 0.01
#: Features of fewer sampled documents are not learned: they would only memorise the documents they stand in.
LEAST_DOCS = 8
SCALES = (0.7, 0.85, 1.0, 1.15, 1.3, 1.5, 1.75, 2.0)
TOXIC, SENTENCE = 0.7, 0.5
_rng = np.random.default_rng(6)
_STEP = _rng.integers(0, 2**63, 8, dtype=_U) * _U(2) + _U(1)
#: Of the first 2**16 code points (later ones are letters): the lower case where it is one code point, and whether it is in a word.
_LOWER = np.array([ord(chr(i).lower()) if len(chr(i).lower()) == 1 else i for i in range(1 << 16)], np.uint32)
_WORD = np.array([chr(i).isalnum() for i in range(1 << 16)])
_END = np.zeros(1 << 16, bool)
_END[[ord(c) for c in ".!?\n。！？"]] = True


def sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets (words x features, -1 for none); the first word of each sentence; each sentence's row, and its
    first and last code point in the row (of words, end exclusive)."""
    points, rows = textscan.code_points(data, offsets)
    low = np.minimum(points, 0xFFFF)
    inside, end = _WORD[low], _END[low]
    points = np.where(points < 0x10000, _LOWER[low], points).astype(_U)
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    heads = rows[:-1][rows[:-1] < rows[1:]]
    start[heads] = inside[heads]
    at = np.flatnonzero(start)
    if not len(at):
        none = np.zeros(0, np.int64)
        return np.zeros((0, 1 + len(PREFIXES)), np.int64), none, none, none, none
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    tails = rows[1:][rows[:-1] < rows[1:]] - 1
    stop[tails] = inside[tails]
    after = np.flatnonzero(stop) + 1
    length = after - at
    size = len(points)
    whole = np.add.reduceat(np.where(inside, points, _U(0)) * textscan.power_table(textscan._BASE, size), at) * textscan.power_table(textscan._INVERSE, size)[at]
    columns, h = [textscan.mix(whole)], np.zeros(len(at), _U)
    for n in range(1, max(PREFIXES) + 1):
        h = h + points[np.minimum(at + n - 1, size - 1)] * _STEP[n]
        if n in PREFIXES:
            columns.append(textscan.mix(h + _U(n)))
    buckets = np.stack([(c >> _U(64 - BITS)).astype(np.int64) for c in columns], axis=1)
    for k, n in enumerate(PREFIXES):
        buckets[length < n, k + 1] = -1
    row = np.searchsorted(rows, at, side="right") - 1
    number = np.cumsum(end)[at]
    new = np.concatenate(([True], (number[1:] != number[:-1]) | (row[1:] != row[:-1])))
    # a word said again at once adds nothing
    buckets[1:][(columns[0][1:] == columns[0][:-1]) & (row[1:] == row[:-1])] = -1
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return buckets, first, row[first], at[first] - rows[row[first]], after[last] - rows[row[first]]


def train(texts: pa.Array, y: list[int]) -> tuple[np.ndarray, float]:
    """(weight of each bucket and a last 0 for no feature, bias)."""
    data, offsets = textscan.utf8(texts)
    docs: list[tuple[np.ndarray, np.ndarray]] = []
    for first, last in textscan.blocks(offsets):
        base = offsets[first]
        buckets, at, row, _, _ = sentences(data[base : offsets[last]], offsets[first : last + 1] - base)
        cuts, ends = np.searchsorted(row, np.arange(last - first + 1)), np.append(at, len(buckets))
        for k in range(last - first):
            lo, hi = cuts[k], cuts[k + 1]
            docs.append((buckets[ends[lo] : ends[hi]].astype(np.int32), at[lo:hi] - ends[lo]))
    seen = np.zeros((1 << BITS) + 1, np.int32)
    for words, _ in docs:
        seen[np.unique(words)] += 1
    learned = seen >= LEAST_DOCS
    docs = [(np.where(learned[words], words, -1), heads) for words, heads in docs]
    label, rng = np.array(y, np.float64), np.random.default_rng(23)
    weight, gain, bias, g_bias = np.zeros((1 << BITS) + 1), np.full((1 << BITS) + 1, 1e-2), START_BIAS, 1.0
    usable = np.array([i for i, d in enumerate(docs) if len(d[1])], np.int64)
    for epoch in range(EPOCHS if len(usable) else 0):
        rate = RATE * (1 - 0.9 * epoch / EPOCHS)
        for batch in np.array_split(rng.permutation(usable), max(1, len(usable) // BATCH)):
            sizes = np.array([len(docs[i][0]) for i in batch])
            base = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            words = np.concatenate([docs[i][0] for i in batch])
            heads = np.concatenate([docs[i][1] + b for i, b in zip(batch, base)])
            doc = np.repeat(np.arange(len(batch)), [len(docs[i][1]) for i in batch])
            z = np.add.reduceat(weight[words].sum(axis=1), heads) + bias
            p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
            clean = np.exp(-np.bincount(doc, np.logaddexp(0, z), len(batch)))
            pull = np.where(label[batch] > 0, -clean / np.maximum(1 - clean, 1e-9), 1.0)
            g = pull[doc] * p
            flat = words.ravel()
            used, spot = np.unique(flat, return_inverse=True)
            per_word = np.repeat(g, np.diff(np.append(heads, len(words))))
            own = np.bincount(spot.ravel(), np.repeat(per_word, words.shape[1]), len(used)) + SPARSITY
            gain[used] += own * own
            # no word speaks for a sentence, and what adds nothing stays 0
            weight[used] = np.maximum(weight[used] - rate * own / np.sqrt(gain[used]), 0)
            weight[-1] = 0.0
            g_bias += g.sum() ** 2
            bias -= rate * g.sum() / np.sqrt(g_bias)
    # scoring takes the base off, so the weights are scaled to the best likelihood without it
    if len(usable):
        doc = np.repeat(np.arange(len(usable)), [len(docs[i][1]) for i in usable])
        evidence = np.concatenate([np.add.reduceat(weight[docs[i][0]].sum(axis=1), docs[i][1]) for i in usable])

        def likelihood(scale: float) -> float:
            clean = np.bincount(doc, np.logaddexp(0, scale * evidence + bias) - np.logaddexp(0, bias), len(usable))
            toxic = np.log(np.maximum(-np.expm1(-clean), 1e-12))
            return float(np.where(label[usable] > 0, toxic, -clean).sum())

        weight *= max(SCALES, key=likelihood)
    return weight, float(bias)


def score_texts(col: pa.Array, model: tuple[np.ndarray, float]) -> tuple[np.ndarray, list[str]]:
    """Each text's probability, and `start:end` of its offending sentences in code points, comma-joined."""
    weight, bias = model
    data, offsets = textscan.utf8(col)
    out, spans = np.zeros(len(offsets) - 1), [[] for _ in range(len(offsets) - 1)]
    for first, last in textscan.blocks(offsets):
        base = offsets[first]
        buckets, at, row, lo, hi = sentences(data[base : offsets[last]], offsets[first : last + 1] - base)
        if not len(at):
            continue
        z = np.add.reduceat(weight[buckets].sum(axis=1), at) + bias
        heads = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        out[first + row[heads]] = -np.expm1(-np.add.reduceat(np.logaddexp(0, z) - np.logaddexp(0, bias), heads))
        bad = np.flatnonzero(z >= np.log(SENTENCE / (1 - SENTENCE)))
        for k in bad.tolist():
            spans[first + int(row[k])].append(f"{lo[k]}:{hi[k]}")
    return out, [",".join(own) for own in spans]


def scorer(docs: DataFrame, labels: DataFrame, fold: int = 3, held: int = 1) -> Callable[[Column], Column]:
    """Trains on labelled documents outside the held-out fold, and gives a function from a text column to a
    column of structs (score, offending). Only texts go to the workers and only results come back, so other
    columns, whatever their names, are never touched."""
    model = learning.fit(learning.sample(docs, labels, "toxic", crc_mod("doc_id", fold) != held), train)
    shared = docs.sparkSession.sparkContext.broadcast(model or (np.zeros((1 << BITS) + 1), START_BIAS))

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            score, spans = score_texts(column, shared.value)
            yield pa.StructArray.from_arrays([pa.array(score), pa.array(spans, pa.string())], ["score", "offending"])

    def found(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return tidied(run)(columns)

    return F.arrow_udf(found, "score double, offending string")


def classify(docs: DataFrame, labels: DataFrame, fold: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted, and offending: the sentences at 0.5 or more of each row.

    Trained on up to learning.SAMPLE_DOCS labelled documents outside the held-out fold. A text that is null
    or without words scores 0; without usable labels every text scores 0. Equal texts get equal scores, so
    repeated rows do; a null doc_id stays null and counts as empty text for its fold; an empty table gives an
    empty table. Other columns are never looked at.
    """
    found = scorer(docs, labels, fold, held)
    out = docs.select("doc_id", (crc_mod("doc_id", fold) == held).alias("held_out"), found(F.col("text")).alias("x"))
    return out.select("doc_id", "held_out", "x.score", (F.col("x.score") >= TOXIC).cast("int").alias("predicted"), "x.offending")
