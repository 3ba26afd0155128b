"""Quality classifier: supervised subword embeddings.

A document is the mean of its words' vectors plus the mean of its character n-grams' vectors, all
hashed into one table. Words enter as spelled and as their shape (runs of capitals, letters, digits and
each mark), and a word equal to the one before enters as a mark of repetition. A softmax over two
classes is trained by stochastic gradient descent with AdaGrad steps in numpy. As the output is linear
in the vectors, scoring needs one number of each bucket: the difference of its two logits.
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
BITS, DIM, EPOCHS, BATCH, RATE, GRAMS = 17, 8, 6, 32, 0.3, (3, 4)
KEEP = 0.3
_rng = np.random.default_rng(2)
_STEP = _rng.integers(0, 2**63, 8, dtype=_U) * _U(2) + _U(1)
_SHAPE_RANDOM = _rng.integers(1, 2**63, 256, dtype=_U)
#: Capitals, other letters (bytes over 127 too) and digits are one class each; any other byte is its own.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[48:58], _SHAPE[128:] = 65, 97, 48, 97
_REPEAT = _U(0x9E3779B97F4A7C15)


def _bucket(h: np.ndarray) -> np.ndarray:
    return (textscan.mix(h) >> _U(64 - BITS)).astype(np.int64)


def _shapes(data: np.ndarray, at: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A hash of each word's shape: its byte classes in order, runs as one."""
    kind = _SHAPE[data]
    value = _SHAPE_RANDOM[kind]
    value[1:][kind[1:] == kind[:-1]] = 0
    first = at[at > 0]
    value[first] = _SHAPE_RANDOM[kind[first]]
    value[textscan.SPACE[data]] = 0
    # each change of class counts by its place among the changes of the word
    changes = np.cumsum(value != 0)
    place = changes - np.repeat(changes[at] - 1, np.diff(np.append(at, len(data)))) if len(at) else changes
    return np.add.reduceat(value * _STEP[np.clip(place, 0, 7)], at)


def features(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For words, shapes, repetitions and n-grams: buckets in text order and (start, end) of each row's."""
    words, rows = textscan.word_hashes(data, offsets, lower=False)
    out = []
    if len(words):
        at, _ = textscan.word_spans(data, offsets)
        same = np.concatenate(([False], words[1:] == words[:-1]))
        same[rows[:-1][rows[:-1] < len(words)]] = False
        spans = np.stack([rows[:-1], rows[1:]], axis=1)
        out += [(_bucket(np.where(same, _REPEAT, words)), spans), (_bucket(_shapes(data[at[0] :], at - at[0], offsets)), spans)]
    points, ends = textscan.code_points(data, offsets)
    points, h = points.astype(_U), None
    for n in range(1, max(GRAMS) + 1):
        if len(points) >= n:
            part = points[n - 1 :] * _STEP[n - 1]
            h = part if h is None else h[: len(part)] + part
            if n in GRAMS:
                out.append((_bucket(h + _U(n)), np.stack([ends[:-1], np.maximum(ends[:-1], ends[1:] - n + 1)], axis=1)))
    return out


def _row_sums(values: np.ndarray, spans: np.ndarray) -> np.ndarray:
    some = spans[:, 1] > spans[:, 0]
    out = np.zeros(len(spans))
    if some.any():
        # rows follow each other; what lies between two rows' spans is summed apart and dropped
        flat = spans[some].ravel()
        out[some] = np.add.reduceat(np.append(values, 0.0), flat)[::2]
    return out


def train(texts: pa.Array, y: list[int]) -> tuple[np.ndarray, float]:
    """(logit difference of each bucket, bias)."""
    data, offsets = textscan.utf8(texts)
    ids, weights, label = [], [], np.array(y)
    for first, last in textscan.blocks(offsets):
        base = offsets[first]
        found = features(data[base : offsets[last]], offsets[first : last + 1] - base)
        groups = [found[:-len(GRAMS)], found[-len(GRAMS) :]] if len(found) > len(GRAMS) else [found]
        for row in range(last - first):
            own = []
            for group in groups:
                parts = [b[s[row, 0] : s[row, 1]] for b, s in group]
                size = sum(map(len, parts))
                if size:
                    k, n = np.unique(np.concatenate(parts), return_counts=True)
                    own.append((k, n / size))
            ids.append(np.concatenate([k for k, _ in own]).astype(np.int32) if own else np.zeros(0, np.int32))
            weights.append(np.concatenate([w for _, w in own]).astype(np.float32) if own else np.zeros(0, np.float32))
    rng = np.random.default_rng(17)
    share = np.clip(label.mean(), 1e-3, 1 - 1e-3)
    table = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    head, bias = rng.uniform(-1, 1, (DIM, 2)).astype(np.float32), np.array([np.log(1 - share), np.log(share)], np.float32)
    g_table, g_head = np.full((1 << BITS, DIM), 1e-6, np.float32), np.full((DIM, 2), 1e-6, np.float32)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for batch in np.array_split(rng.permutation(len(label)), max(1, len(label) // BATCH)):
            k, w = np.concatenate([ids[i] for i in batch]), np.concatenate([weights[i] for i in batch])
            doc = np.repeat(np.arange(len(batch)), [len(ids[i]) for i in batch])
            used, spot = np.unique(k, return_inverse=True)
            vectors = table[used]
            hidden = np.stack([np.bincount(doc, w * vectors[spot, d], len(batch)) for d in range(DIM)], axis=1)
            logits = hidden @ head + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(batch)), label[batch]] -= 1
            back, step = p @ head.T, hidden.T @ p
            for d in range(DIM):
                g = np.bincount(spot, w * back[doc, d], len(used)).astype(np.float32)
                g_table[used, d] += g * g
                table[used, d] -= rate * g / np.sqrt(g_table[used, d])
            g_head += step * step
            head -= (rate * step / np.sqrt(g_head)).astype(np.float32)
            bias -= (0.1 * rate * p.mean(axis=0)).astype(np.float32)
    return (table @ (head[:, 1] - head[:, 0])).astype(np.float64), float(bias[1] - bias[0])


def score_texts(col: pa.Array, model: tuple[np.ndarray, float]) -> np.ndarray:
    data, offsets = textscan.utf8(col)
    worth, bias = model
    out = []
    for first, last in textscan.blocks(offsets):
        base = offsets[first]
        found = features(data[base : offsets[last]], offsets[first : last + 1] - base)
        logit = np.full(last - first, bias)
        for group in (found[: -len(GRAMS)], found[-len(GRAMS) :]) if len(found) > len(GRAMS) else (found,):
            total, size = np.zeros(last - first), np.zeros(last - first)
            for b, spans in group:
                total += _row_sums(worth[b], spans)
                size += spans[:, 1] - spans[:, 0]
            logit += total / np.maximum(size, 1)
        out.append(1 / (1 + np.exp(-np.clip(logit, -500, 500))))
    return np.concatenate(out) if out else np.zeros(0)


def scorer(docs: DataFrame, labels: DataFrame, fold: int = 5, held: int = 0) -> Callable[[Column], Column]:
    """Trains on labelled documents outside the held-out fold, and gives a function from a text column to a
    score column. Only texts go to the workers and only scores come back, so other columns, whatever their
    names, are never touched."""
    model = learning.fit(learning.sample(docs, labels, "quality", crc_mod("doc_id", fold) != held), train)
    shared = docs.sparkSession.sparkContext.broadcast(model or (np.zeros(1 << BITS), 0.0))

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array(score_texts(column, shared.value))

    def score(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return tidied(run)(columns)

    return F.arrow_udf(score, "double")


def classify(docs: DataFrame, labels: DataFrame, fold: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score and predicted of each row.

    Trained on up to learning.SAMPLE_DOCS labelled documents outside the held-out fold. A null text is
    scored as the empty one, which gets the prior of the classes; without usable labels every score is
    0.5. Equal texts get equal scores whatever rows surround them, so repeated rows do; a null doc_id stays
    null and counts as empty text for its fold; an empty table gives an empty table. Other columns are never
    looked at.
    """
    score = scorer(docs, labels, fold, held)
    out = docs.select("doc_id", (crc_mod("doc_id", fold) == held).alias("held_out"), score(F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= KEEP).cast("int"))
