"""Running values along sorted groups of any size, and joins with hot keys.

A group may span many tasks: rows are range-sorted, each task runs over its own rows, and what a task's last group
has so far is carried to the next tasks. What the driver adds up is one row a partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querent.llm.runtime import cut

#: A key that as many rows as this part of all have is hot: there are fewer such keys, so they fit a broadcast.
HOT = 1000


def _local(key: str, sums: list[str], xors: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, runs, last = TaskContext.get().partitionId(), 0, -1, None
        count, held = 0, dict.fromkeys(sums + xors, 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key).to_numpy()
            starts = np.concatenate(([last is None or keys[0] != last], keys[1:] != keys[:-1]))
            run_no = runs + np.cumsum(starts)
            at = np.arange(batch.num_rows)
            first = np.maximum.accumulate(np.where(starts, at, -1))  # -1: the run began in an earlier batch
            position = at - np.maximum(first, 0) + 1 + np.where(first < 0, count, 0)
            columns = []
            for name in sums + xors:
                values = batch.column(name).to_numpy()
                add, op = (np.add, np.subtract) if name in sums else (np.bitwise_xor, np.bitwise_xor)
                whole = add.accumulate(values)
                before = np.where(first > 0, whole[np.maximum(first, 1) - 1], 0)
                running = op(whole, before)
                running = np.where(first < 0, add(running, held[name]), running)
                held[name] = running[-1]
                columns.append(pa.array(running))
            runs, last, count = int(run_no[-1]), keys[-1], int(position[-1])
            marks = [pa.array(np.full(batch.num_rows, part)), pa.array(row + at), pa.array(run_no == 0), pa.array(position)]
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, *marks, *columns], [*batch.schema.names, "__part", "__row", "__first", "at", *(f"run_{c}" for c in sums + xors)])

    return run


def running(df: DataFrame, key: str, order: list[Column], sums: tuple[str, ...] = (), xors: tuple[str, ...] = ()) -> DataFrame:
    """df with at, the row's place from 1 in its group, and run_<name>, the sum or exclusive or of a column up to it.

    key: a column of longs without nulls; order: key first, then what sorts a group. No column may be named at or __*.
    """
    names = [*sums, *xors]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "__part long, __row long, __first boolean, at long", *(f"run_{c} long" for c in names)])
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    local = cut(sorted_rows.mapInArrow(_local(key, list(sums), list(xors)), schema), "running")
    ends = local.groupBy("__part").agg(F.min(key).alias("first_key"), F.max_by(F.struct(key, "at", "__first", *(f"run_{c}" for c in names)), "__row").alias("end"), F.min_by(key, "__row").alias("begin"))
    carried, so_far = [], None
    for r in sorted(ends.select("__part", "begin", "end").collect(), key=lambda r: r["__part"]):
        own = {c: r.end[f"run_{c}"] for c in names} | {"at": r.end["at"]}
        goes_on = so_far is not None and so_far[0] == r.begin
        if goes_on:
            carried.append((r["__part"], so_far[1]["at"], *(so_far[1][c] for c in names)))
        if goes_on and r.end["__first"]:  # the whole part is of the group that goes on
            own = {c: own[c] ^ so_far[1][c] if c in xors else own[c] + so_far[1][c] for c in own}
        so_far = r.end[key], own
    spark = df.sparkSession
    carry = spark.createDataFrame(carried, ", ".join(["__part long, __at long", *(f"__{c} long" for c in names)]))
    joined = local.join(F.broadcast(carry), "__part", "left")
    more = lambda c: F.when(F.col("__first"), F.coalesce(F.col(f"__{c}"), F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long"))
    out = [*(F.col(f"`{c}`") for c in df.columns), (F.col("at") + more("at")).alias("at")]
    out += [(F.col(f"run_{c}") + more(c)).alias(f"run_{c}") for c in sums]
    out += [F.col(f"run_{c}").bitwiseXOR(more(c)).alias(f"run_{c}") for c in xors]
    return joined.select(*out)


def meet(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """left joined with the one row that right has for each of its keys.

    weight: a column of right, at least the rows of left with its key, which sum to total or less. Rows of hot keys,
    HOT of them at most, are broadcast; the other keys have a HOT-th of total each at most.
    """
    hot = F.broadcast(right.where(F.col(weight) * HOT > total))
    return left.join(hot, keys).unionByName(left.join(hot.select(*keys), keys, "left_anti").join(right.where(F.col(weight) * HOT <= total), keys))
