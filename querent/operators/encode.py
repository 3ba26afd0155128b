"""Encoders by name, batched encoding inside tasks, and stored vectors that answer only for the texts they are of."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querent.shipping import ship
from querent.sources.store import Store

#: Texts that a model gets at once.
BATCH = 64


@dataclass(frozen=True)
class Encoder:
    """load: called once in a worker, gives a function from a list of texts to a matrix of width columns."""

    name: str
    width: int
    load: Callable[[], Callable[[list[str]], np.ndarray]]


_known: dict[str, Encoder] = {}
_loaded: dict[str, Callable[[list[str]], np.ndarray]] = {}


def register(encoder: Encoder) -> Encoder:
    """Makes an encoder known by its name; another one of that name is replaced."""
    if encoder.width < 1:
        raise ValueError("an encoder has a width of at least 1")
    _known[encoder.name] = encoder
    return encoder


def encoder(name: str) -> Encoder:
    """An unknown name is an error."""
    if name not in _known:
        raise ValueError(f"no encoder {name}; there are {sorted(_known)}")
    return _known[name]


class HashedTerms:
    """An encoder without a model: each term adds its count, with a sign, at one place, both from its MD5."""

    KEPT = 500_000

    def __init__(self, width: int):
        self.width, self.places = width, {}

    def _place(self, term: str) -> tuple[int, int]:
        found = self.places.get(term)
        if found is None:
            if len(self.places) >= self.KEPT:
                self.places.clear()
            code = hashlib.md5(term.encode()).hexdigest()
            found = self.places[term] = int(code[:6], 16) % self.width, -1 if int(code[6], 16) % 2 else 1
        return found

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.width))
        for row, text in zip(out, texts):
            for term in re.findall("[a-z0-9]+", text.lower()):
                place, sign = self._place(term)
                row[place] += sign
        return out


HASHED = register(Encoder("hashed-terms-64", 64, lambda: HashedTerms(64)))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; one that is shorter than 1e-12 is divided by that."""
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


def vectors_of(texts: list[str], model: Callable[[list[str]], np.ndarray], width: int, batch: int = BATCH) -> np.ndarray:
    """Unit vectors in the order of texts. A model gets texts of like length together, the longest first."""
    out = np.zeros((len(texts), width))
    order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
    for at in range(0, len(order), batch):
        own = order[at : at + batch]
        found = np.asarray(model([texts[k] for k in own]), np.float64)
        if found.shape != (len(own), width):
            raise ValueError(f"an encoder of width {width} gave {found.shape} for {len(own)} texts")
        out[own] = unit(found)
    return out


def flat(vectors: np.ndarray) -> pa.Array:
    n, width = vectors.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(np.ascontiguousarray(vectors).reshape(-1)))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of equally long lists as a matrix, from its flat buffer."""
    if not len(column):
        return np.zeros((0, 0))
    sizes = pc.list_value_length(column)
    if sizes.null_count or pc.min(sizes).as_py() != pc.max(sizes).as_py():
        raise ValueError("vectors of one width are needed")
    found = pc.list_flatten(column)
    if found.null_count:
        raise ValueError("a vector has no null components")
    return found.to_numpy().astype(np.float64, copy=False).reshape(len(column), -1)


def encode(df: DataFrame, id_column: str, text_column: str, chosen: Encoder, batch: int = BATCH) -> DataFrame:
    """(id_column, v) of each row; a null text is empty. The model is loaded once a worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if chosen.name not in _loaded:
            _loaded[chosen.name] = chosen.load()
        for rows in batches:
            texts = pc.fill_null(rows.column("text"), "").to_pylist()
            yield pa.RecordBatch.from_arrays([rows.column("id"), flat(vectors_of(texts, _loaded[chosen.name], chosen.width, batch))], ["id", "v"])

    ship(df.sparkSession)
    kind = df.schema[id_column].dataType.simpleString()
    found = df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(run, f"id {kind}, v array<double>")
    return found.withColumnRenamed("id", id_column)


def content_key(docs: DataFrame, id_column: str, text_column: str, model: str, field: str) -> tuple[str, int]:
    """A key of the texts of docs, and how many there are: model, field, count and the sum of hashes of (id, text). A sum
    needs no task to hold them, and any changed, lost or moved text changes it."""
    mark = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(id_column), F.md5(F.coalesce(F.col(text_column), F.lit(""))))), 1, 12), 16, 10).cast("decimal(38,0)")
    n, total = docs.agg(F.count("*"), F.sum(mark)).first()
    return hashlib.sha256(f"{model}|{field}\0{n}\0{total or 0}".encode()).hexdigest()[:32], n


def stored_vectors(docs: DataFrame, field: str, chosen: Encoder = HASHED, store: Store | None = None) -> DataFrame:
    """(doc_id, v) of a text field, encoded once and kept by the texts' content. A stored table counts only if it is whole
    and has as many rows and as wide vectors as it should; of several writers the first wins."""
    store = store or Store(docs.sparkSession)
    key, n = content_key(docs, "doc_id", field, chosen.name, field)
    wanted = {"encoder": chosen.name, "field": field, "rows": n, "width": chosen.width}

    def facts(written: DataFrame) -> dict:
        rows, width = written.agg(F.count("*"), F.max(F.size("v"))).first()
        return {**wanted, "rows": rows, "width": width or chosen.width}

    return store.build(f"vectors-{key}", lambda: encode(docs, "doc_id", field, chosen), facts, fits=lambda held: all(held.get(c) == v for c, v in wanted.items()))


def manifests(keys: dict[str, tuple[str, int]], store: Store) -> DataFrame:
    """(field, encoder, key, rows, width) of stored vectors by their keys; fields without a whole table have no row."""
    found = [(field, store.manifest(f"vectors-{key}"), key) for field, (key, _) in keys.items()]
    rows = [(field, m["encoder"], key, m["rows"], m["width"]) for field, m, key in found if m]
    return store.spark.createDataFrame(rows, "field string, encoder string, key string, rows long, width long")
