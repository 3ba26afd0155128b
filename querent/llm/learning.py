"""Bounded, fixed training samples of labelled documents, trained on in one task."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querent.llm.textscan import tidied

#: A sample holds at most so many documents of at most so many characters (longer ones are scored, not learned from).
SAMPLE_DOCS, SAMPLE_CHARS = 6000, 20_000


def sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, limit: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> DataFrame:
    """(doc_id, text, y) of up to limit labelled documents, those of the least hash of doc_id.

    Labels other than 0 and 1, null ids and documents with contradicting labels are left out.
    The ids are drawn from the labels alone, so at most limit rows are broadcast. Rows that repeat an id with the same
    text count once, and of more than limit rows, as where an id has many texts, those of least hash stay.
    """
    found = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & usable)
    found = found.groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("y2")).where("y = y2").select("doc_id", "y")
    found = found.orderBy(F.xxhash64(F.col("doc_id").cast("long")), "doc_id").limit(limit)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(found), "doc_id").where(F.length("text") <= chars).distinct()
    return rows.orderBy(F.xxhash64(F.col("doc_id").cast("long"), "text"), "doc_id", "text").limit(limit)


def fit(rows: DataFrame, train: Callable[[pa.Array, list[int]], object]) -> object | None:
    """train(texts, labels) run in one task over a bounded sample, in the order of (doc_id, text); None without rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            table = pa.Table.from_batches(held).sort_by([("doc_id", "ascending"), ("text", "ascending")])
            model = train(table.column("text").combine_chunks(), table.column("y").to_pylist())
            yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(model)], pa.binary())})

    got = rows.select("doc_id", "text", "y").repartition(1).mapInArrow(tidied(run), "model binary").collect()
    return pickle.loads(got[0][0]) if got else None
