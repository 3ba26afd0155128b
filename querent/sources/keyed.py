"""Records by key that grow batch by batch: a stop in the middle loses the running batch only."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querent.sources.store import Store


class Keyed:
    """A table of batches below a store's folder, each written aside and renamed into place under the next number. Of the
    rows of a key the one of the last batch counts."""

    def __init__(self, store: Store, name: str, key: str, schema: T.StructType):
        if key not in schema.names:
            raise ValueError(f"the records have no {key}")
        self.store, self.name, self.key, self.schema = store, name, key, schema

    def batches(self) -> list[int]:
        """Numbers of the whole batches."""
        path, fs = self.store._path(self.name)
        if not fs.exists(path):
            return []
        numbers = sorted(int(s.getPath().getName()) for s in fs.listStatus(path) if s.getPath().getName().isdigit())
        return [n for n in numbers if self.store.manifest(f"{self.name}/{n:09d}") is not None]

    def read(self) -> DataFrame:
        """One row a key; of a batch's rows of one key any."""
        spark, numbers = self.store.spark, self.batches()
        if not numbers:
            return spark.createDataFrame([], self.schema)
        rows = spark.read.schema(self.schema).parquet(*(f"{self.store.root}/{self.name}/{n:09d}/data" for n in numbers))
        rows = rows.withColumn("__batch", F.regexp_extract(F.input_file_name(), r"/(\d{9})/data/[^/]*$", 1).cast("long"))
        fields = [F.col(f"`{c}`") for c in self.schema.names if c != self.key]
        last = rows.groupBy(self.key).agg(F.max_by(F.struct(*fields), "__batch").alias("__last"))
        return last.select(*(F.col(self.key) if c == self.key else F.col(f"__last.`{c}`").alias(c) for c in self.schema.names))

    def add(self, frame: DataFrame) -> int:
        """Writes a batch under the next number, whole or not at all. Another writer's batch takes a number of its own."""
        aside = f"aside/{self.name.replace('/', '-')}-{uuid.uuid4().hex}"
        try:
            frame.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema)).write.parquet(f"{self.store.root}/{aside}/data")
            self.store._describe(aside, {"schema": self.schema.jsonValue()})
            while True:
                path, fs = self.store._path(self.name)
                taken = [int(s.getPath().getName()) for s in fs.listStatus(path) if s.getPath().getName().isdigit()] if fs.exists(path) else []
                number = max(taken, default=0) + 1
                if self.store._into_place(aside, f"{self.name}/{number:09d}"):
                    return number
        finally:
            path, fs = self.store._path(aside)
            fs.delete(path, True)


def enrich(held: Keyed, rows: DataFrame, make: Callable[[DataFrame], DataFrame], batch_rows: int = 100_000, force: bool = False, only: DataFrame | None = None, first: tuple[str, int] | None = None) -> int:
    """Makes records of the rows that have none yet, batch by batch, and says how many batches it wrote.

    only: keys (of gold rows) that others are left out for; first: (column, n) for the n least rows by a column; force: makes
    those of rows that have one again, which then counts. After a stop the next call goes on with what is missing.
    """
    if first is not None and first[1] < 1 or batch_rows < 1:
        raise ValueError("at least one row")
    wanted = rows if only is None else rows.join(only.select(held.key).distinct(), held.key, "left_semi")
    if first is not None:
        wanted = wanted.orderBy(first[0]).limit(first[1])
    pending = wanted if force else wanted.join(held.read().select(held.key), held.key, "left_anti")
    batches = -(-pending.count() // batch_rows)
    for batch in range(batches):
        held.add(make(pending.where(F.pmod(F.xxhash64(held.key), F.lit(batches)) == batch)))
    return batches
