"""Document fingerprints: a homomorphic multiset hash of paragraphs.

Each paragraph gives a wide vector: LANES values of -3, -1, 1 or 3 from its 256-bit hash, plus those of its
sentences if it has several, so that a change inside a long paragraph leaves a likeness. A text's fingerprint
is the sum of its paragraphs' vectors modulo 2**32 a lane, so the order of paragraphs doesn't matter,
and adding or taking away a paragraph is adding or subtracting its vector. Read as signed numbers, which no
text of under 700 million paragraphs and sentences wraps, the angle between two sums estimates what share of
paragraphs two texts have in common. Written out, a sum whose lanes all fit in 16 bits takes 16 a lane.

Documents are put in order by ranges, and each task reads its range as a stream: a document is done when the
next one comes. The last of a range waits for the first of the next range; these few are joined at the end.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from querent.llm.runtime import cut
from querent.llm.textscan import BLOCK, tidied

LANES = 128
_FIELDS = np.array([[2 * ((b >> s) & 3) - 3 for s in (0, 2, 4, 6)] for b in range(256)], np.int8)


def paragraphs(text: str) -> list[str]:
    """Lines with something besides white space."""
    return [p for p in text.split("\n") if p.strip()]


_BREAK = re.compile(r"(?<=[.!?])\s+")


def units(paragraph: str) -> list[str]:
    """The paragraph, and its sentences if there are several."""
    found = _BREAK.split(paragraph.strip())
    return [paragraph, *(f"\0{s}" for s in found)] if len(found) > 1 else [paragraph]


def vectors(parts: list[str]) -> np.ndarray:
    """The wide vector of each unit."""
    raw = b"".join(hashlib.blake2b(p.encode("utf-8", "replace"), digest_size=LANES // 4).digest() for p in parts)
    return _FIELDS[np.frombuffer(raw, np.uint8)].reshape(len(parts), LANES)


def fingerprints(texts: list[str]) -> np.ndarray:
    """A row of LANES unsigned 32-bit sums for each text; zeros without paragraphs."""
    held = [[u for p in paragraphs(t) for u in units(p)] for t in texts]
    out = np.zeros((len(texts), LANES), np.int64)
    sizes = np.array([len(p) for p in held], np.int64)
    some = np.flatnonzero(sizes)
    if len(some):
        rows = vectors([p for own in held for p in own])
        out[some] = np.add.reduceat(rows, np.cumsum(sizes)[some] - sizes[some], axis=0, dtype=np.int64)
    return (out & 0xFFFFFFFF).astype(np.uint32)


def packed(lanes: np.ndarray) -> bytes:
    """The sums in 16 bits a lane if all fit as signed numbers, else in 32."""
    signed = lanes.astype(np.uint32).view(np.int32)
    return lanes.astype("<u2" if ((signed >= -(2**15)) & (signed < 2**15)).all() else "<u4").tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    if len(raw) == 2 * LANES:
        return np.frombuffer(raw, "<i2").astype(np.int32).view(np.uint32)
    return np.frombuffer(raw, "<u4").astype(np.uint32)


def update(fingerprint: str, added: Iterable[str] = (), removed: Iterable[str] = ()) -> str:
    """A fingerprint after paragraphs are put in or taken out, without the text."""
    lanes = unpacked(bytes.fromhex(fingerprint)).astype(np.int64)
    for parts, sign in ((list(added), 1), (list(removed), -1)):
        if parts:
            lanes = lanes + sign * vectors([u for p in parts for u in units(p)]).sum(axis=0, dtype=np.int64)
    return packed((lanes & 0xFFFFFFFF).astype(np.uint32)).hex()


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The rows' cosine as signed lanes, at least 0: 1 for equal fingerprints, 0 where one of two different ones is zero."""
    x, y = a.view(np.int32).astype(np.float64), b.view(np.int32).astype(np.float64)
    size = np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
    found = np.clip((x * y).sum(axis=1) / np.maximum(size, 1e-12), 0, 1)
    return np.where((a == b).all(axis=1), 1.0, found)


def edit(text: str, following: str) -> str:
    """The last quarter of the code points (rounded down) gives way to as many first ones of the next text, or all."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


#: What a task writes. kind 0: a result. kind 1: the last document of a range with its text, waiting for its next
#: one, to be returned copies times. kind 2: the first text of a range.
_ROW = "kind int, part int, copies long, doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, text string"
_NAMES = [x.split()[0] for x in _ROW.split(", ")]
_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.string()]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * len(_NAMES), _TYPES)], _NAMES)


def _results(ids: list, texts: list[str], following: list[str], prints: np.ndarray, nexts: np.ndarray) -> list[tuple]:
    edited = [edit(t, f) for t, f in zip(texts, following)]
    changed = fingerprints(edited)
    near, after = likeness(prints, changed), likeness(prints, nexts)
    return [(0, 0, 1, i, len(t), hashlib.sha256(e.encode("utf-8", "replace")).digest(), packed(p), packed(c), float(x), float(y), None) for i, t, e, p, c, x, y in zip(ids, texts, edited, prints, changed, near, after)]


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of a range in its order; rows that repeat key and text are one document, with one next."""
    part, first = TaskContext.get().partitionId(), True
    ids, texts, copies, size = [], [], [], 0  # documents in hand

    def out(last: bool) -> list[tuple]:
        """Results of the documents in hand; all but the last one leave."""
        prints = fingerprints(texts)
        found = _results(ids[:-1], texts[:-1], texts[1:], prints[:-1], prints[1:])
        rows = [r for r, n in zip(found, copies) for _ in range(n)]
        if last:
            rows.append((1, part, copies[-1], ids[-1], None, None, None, None, None, None, texts[-1]))
        del ids[:-1], texts[:-1], copies[:-1]
        return rows

    for batch in batches:
        for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            if first:
                first = False
                yield _rows([(2, part, 1, i, None, None, None, None, None, None, text)])
            if ids and ids[-1] == i and texts[-1] == text:
                copies[-1] += 1
                continue
            if size > BLOCK:
                ids.append(i)
                texts.append(text)
                copies.append(1)
                yield _rows(out(False))
                size = len(text)
                continue
            ids.append(i)
            texts.append(text)
            copies.append(1)
            size += len(text)
    if ids:
        yield _rows(out(True))


def _last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of the last documents of ranges, each beside its next text."""
    for batch in batches:
        ids, texts, following, copies = (batch.column(c).to_pylist() for c in ("doc_id", "text", "next", "copies"))
        found = _results(ids, texts, following, fingerprints(texts), fingerprints(following))
        yield _rows([(0, 0, n, *r[3:]) for r, n in zip(found, copies)])


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row.

    The next document is the one of the next doc_id, after the last the first; a single document is its own
    next. Documents of one doc_id follow each other by the xxhash64 of their texts, so many of one id (or of none)
    still spread over ranges; rows equal in both are one document with one result. A null doc_id comes before
    all others; a null text is empty. An empty table gives an empty table. Other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("mark"), F.col("text")]
    ranged = given.repartitionByRange(*order[:2]).sortWithinPartitions(*order).select("doc_id", "text")
    rows = cut(ranged.mapInArrow(tidied(_stream), _ROW), "fingerprints")
    # one row a range from here on
    waiting = rows.where("kind = 1").select("part", "copies", "doc_id", "text")
    parts = waiting.select("part")
    after = F.coalesce(F.lead("part").over(W.orderBy("part")), F.first("part").over(W.orderBy("part")))
    heads = rows.where("kind = 2").select(F.col("part").alias("after"), F.col("text").alias("next"))
    ends = waiting.join(parts.select("part", after.alias("after")), "part").join(heads, "after").select("doc_id", "copies", "text", "next")
    ended = ends.mapInArrow(_last, _ROW).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copy")
    text_of = lambda c: F.lower(F.hex(c)).alias(c)
    out = rows.where("kind = 0").unionByName(ended)
    return out.select("doc_id", "n_chars", text_of("edited_sha256"), text_of("fingerprint"), text_of("edited_fingerprint"), "near_edited", "near_next")
