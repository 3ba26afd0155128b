"""Pooling, blinding, sampling and rescoring of judged evaluations."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from querent.operators.metrics import Judgments
from querent.shipping import ship
from querent.sources.store import Store

#: What a judge sees of a candidate, and nothing else.
CARD = ("show_id", "title", "type", "release_year", "listed_in", "cast", "director", "description")


def pool(runs: DataFrame, methods: list[str], depth: int = 10) -> DataFrame:
    """(query_id, doc_id, position): the distinct union of the methods' first depth rows, in the order of methods, then rank."""
    number = F.create_map(*[x for i, m in enumerate(methods) for x in (F.lit(m), F.lit(i))])
    rows = runs.where((F.col("rank") <= depth) & F.col("method").isin(methods)).select("query_id", "doc_id", "rank", number[F.col("method")].alias("number"))
    first = rows.groupBy("query_id", "doc_id").agg(F.min(F.struct("number", "rank")).alias("first"))
    return first.select("query_id", "doc_id", F.row_number().over(W.partitionBy("query_id").orderBy("first", "doc_id")).cast("long").alias("position"))


def pool_stats(pooled: DataFrame) -> DataFrame:
    sizes = pooled.groupBy("query_id").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("n_queries"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_slots"), F.coalesce(F.min("n"), F.lit(0)).alias("least"), F.coalesce(F.max("n"), F.lit(0)).alias("most"))


def blind(pooled: DataFrame, seed: int = 20260928) -> DataFrame:
    """(query_id, doc_id, position) in an order that says nothing about systems: by md5 of seed, query and document."""
    mark = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("query_id"), F.col("doc_id")))
    return pooled.select("query_id", "doc_id", F.row_number().over(W.partitionBy("query_id").orderBy(mark)).cast("long").alias("position"))


def blind_exact(pooled: DataFrame, seed: int = 20260928) -> DataFrame:
    """As numpy shuffles: one generator over all queries in the order of query_id. The pooled ids are one group, as the generator is."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rng, out = np.random.default_rng(seed), []
        for q, own in pdf.sort_values(["query_id", "position"]).groupby("query_id", sort=True):
            ids = own["doc_id"].to_numpy()[rng.permutation(len(own))]
            out.append(pd.DataFrame({"query_id": q, "doc_id": ids, "position": np.arange(1, len(ids) + 1)}))
        return pd.concat(out)

    return pooled.withColumn("__all", F.lit(True)).groupBy("__all").applyInPandas(run, "query_id long, doc_id long, position long")


def cards(catalog: DataFrame) -> DataFrame:
    """The blinded fields of a catalog; nulls empty, the year whole or null. Missing fields are an error."""
    missing = sorted(set(CARD) - set(catalog.columns))
    if missing:
        raise ValueError(f"a card needs {missing}")
    year = F.col("release_year").cast("string").try_cast("double").try_cast("int")
    return catalog.select(*[year.alias(c) if c == "release_year" else F.coalesce(F.col(c), F.lit("")).alias(c) for c in CARD])


def assert_blinded(df: DataFrame) -> None:
    if set(df.columns) != set(CARD):
        raise ValueError(f"not the fields of a blinded card: {sorted(set(df.columns) ^ set(CARD))}")


#: Places of a hash (hex digits) that a histogram counts by, and rows of a bin that a window may sort.
DIGITS, BIN = 3, 10_000


def least_by_hash(rows: DataFrame, sizes: DataFrame, mark: Column, deepest: int = 12) -> DataFrame:
    """Of each stratum the k rows of least hash: rows has stratum, sizes (stratum, k), mark is a column of 32 hex digits.

    No task sorts a stratum. Rows are counted by the first digits of their hash; bins under the one that holds the k-th
    row are taken whole, and that one is counted by more digits, until it is small enough for a window.
    """
    rows = rows.withColumn("__mark", mark)
    open_, taken, depth = sizes.select("stratum", F.lit("").alias("prefix"), F.col("k").cast("long").alias("k")).where("k > 0"), None, 0
    while True:
        depth += DIGITS
        inside = rows.withColumn("prefix", F.substring("__mark", 1, depth - DIGITS)).join(F.broadcast(open_), ["stratum", "prefix"])
        bins = inside.groupBy("stratum", "prefix", "k", F.substring("__mark", 1, depth).alias("bin")).agg(F.count("*").alias("n"))
        so_far = F.sum("n").over(W.partitionBy("stratum").orderBy("bin"))
        cut = bins.withColumn("upto", so_far).where("upto >= k and upto - n < k").select("stratum", F.col("bin").alias("edge"), (F.col("k") - F.col("upto") + F.col("n")).alias("left"), "n")
        edges = cut.collect()  # a row a stratum
        spark = rows.sparkSession
        edge = spark.createDataFrame([(r["stratum"], r["edge"]) for r in edges], f"stratum {rows.schema['stratum'].dataType.simpleString()}, edge string")
        below = inside.join(F.broadcast(edge), "stratum", "left").where(F.col("edge").isNull() | (F.substring("__mark", 1, depth) < F.col("edge"))).drop("prefix", "k", "edge")
        taken = below if taken is None else taken.unionByName(below)
        deeper = [(r["stratum"], r["edge"], r["left"]) for r in edges]
        open_ = spark.createDataFrame(deeper, f"stratum {rows.schema['stratum'].dataType.simpleString()}, prefix string, k long")
        if depth >= deepest or all(r["n"] <= BIN for r in edges):
            break
    last = rows.withColumn("prefix", F.substring("__mark", 1, depth)).join(F.broadcast(open_), ["stratum", "prefix"])
    ranked = last.withColumn("__r", F.row_number().over(W.partitionBy("stratum").orderBy("__mark"))).where(F.col("__r") <= F.col("k"))
    return taken.unionByName(ranked.drop("prefix", "k", "__r")).drop("__mark")


def sample_sizes(rows: DataFrame, fraction: float, least: int) -> DataFrame:
    """(stratum, n, k): of n rows max(round(fraction * n), least), at most n; halves are rounded to the even number."""
    counts = rows.groupBy("stratum").agg(F.count("*").alias("n"))
    return counts.withColumn("k", F.least(F.greatest(F.bround(F.col("n") * fraction).cast("long"), F.lit(least).cast("long")), F.col("n")))


def stratified_sample(rows: DataFrame, fraction: float = 0.1, least: int = 1, seed: int = 20260930) -> DataFrame:
    """rows: (query_id, doc_id, stratum). Of each stratum max(round(fraction * n), least), at most n, by md5 of seed and ids."""
    mark = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("query_id"), F.col("doc_id")))
    return least_by_hash(rows, sample_sizes(rows, fraction, least), mark).select("query_id", "doc_id", "stratum")


#: Rows of all strata up to which the driver holds a draw itself; draws that a task makes of a longer one.
DRAWN, DRAWS = 1_000_000, 1 << 20


def drawn_sample(rows: DataFrame, order: list[str], fraction: float = 0.1, least: int = 1, seed: int = 20260930, store: Store | None = None) -> DataFrame:
    """rows and place, from 1: a draw as numpy's default generator makes it with the seed, for samples that are frozen.

    Strata are drawn from in ascending order, each without putting back, from its rows in the order of the columns of
    order; then the drawn rows are shuffled together. The driver knows counts only. Of more than DRAWN rows it keeps the
    generator's state before each stretch of draws; tasks make the draws of a stretch again, and joins follow the swaps.
    """
    spark, kind = rows.sparkSession, rows.schema["stratum"].dataType.simpleString()
    sizes = sorted(map(tuple, sample_sizes(rows, fraction, least).select("stratum", "n", "k").collect()))
    rng, store = np.random.default_rng(seed), store or Store(rows.sparkSession)
    if sum(n for _, n, _ in sizes) <= DRAWN:
        picked = [(stratum, int(at) + 1) for stratum, n, k in sizes for at in rng.choice(n, size=k, replace=False)]
        places = [(*picked[i], place) for place, i in enumerate(rng.permutation(len(picked)), 1)]
        chosen = F.broadcast(spark.createDataFrame([(s, at, int(p)) for s, at, p in places], f"stratum {kind}, __at long, place long"))
    else:
        few, parts, decks, first = [], [], [], 0
        for number, (stratum, n, k) in enumerate(sizes):
            if n > 10_000 and k > n // 50:  # numpy then shuffles the tail of all places, else it keeps a set of those drawn
                parts += _stretches(rng, number, n, k)
                decks.append((number, stratum, n - k, first))
            elif k > DRAWN:
                raise ValueError(f"more than {DRAWN} rows are drawn from a stratum of which they are less than a fiftieth")
            else:
                few += [(stratum, int(at) + 1, first + i) for i, at in enumerate(rng.choice(n, size=k, replace=False))]
            first += k
        drawn = _dealt(spark, parts, store).join(F.broadcast(spark.createDataFrame(decks, f"deck int, stratum {kind}, skipped long, first long")), "deck")
        drawn = drawn.select("stratum", (F.col("value") + 1).alias("__at"), (F.col("first") + F.col("i") - F.col("skipped")).alias("i"))
        drawn = drawn.unionByName(spark.createDataFrame(few, f"stratum {kind}, __at long, i long"))
        shuffled = _dealt(spark, _stretches(rng, 0, first, first, masked=True), store).select(F.col("value").alias("i"), (F.col("i") + 1).alias("place"))
        chosen = store.build(f"drawn-{uuid.uuid4().hex}", lambda: drawn.join(shuffled, "i").drop("i"))
    # a row's number: the rows of lesser first columns, and its own among those of the same one
    heads = rows.groupBy("stratum", order[0]).agg(F.count("*").alias("__n"))
    heads = heads.select("stratum", order[0], (F.sum("__n").over(W.partitionBy("stratum").orderBy(order[0])) - F.col("__n")).alias("__before"))
    own = rows.withColumn("__own", F.row_number().over(W.partitionBy("stratum", order[0]).orderBy(*order)))
    numbered = own.join(heads, ["stratum", order[0]]).withColumn("__at", (F.col("__own") + F.col("__before")).cast("long")).drop("__own", "__before")
    return numbered.join(chosen, ["stratum", "__at"]).select(*rows.columns, "place")


def _swaps(bits: np.random.BitGenerator, masked: bool, last: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Places from last down and a draw for each, up to the place itself: as choice makes them, or masked as permutation does."""
    i = np.arange(last, last - count, -1)
    return i, np.random.RandomState(bits).randint(0, i + 1, dtype=np.int64) if masked else np.random.Generator(bits).integers(0, i, endpoint=True)


def _stretches(rng: np.random.Generator, deck: int, n: int, k: int, masked: bool = False) -> list[tuple[int, bool, int, int, str]]:
    """(deck, masked, last, count, state) of stretches of the k draws by which numpy shuffles the last k of n places, a draw under
    last + 1, under last and so on. The generator is moved past them; no stretch is held."""
    out = []
    for last in range(n - 1, n - k - 1, -DRAWS):
        count = min(DRAWS, last - (n - k) + 1)
        out.append((deck, masked, last, count, json.dumps(rng.bit_generator.state)))
        _swaps(rng.bit_generator, masked, last, count)
    return out


def _dealt(spark: SparkSession, parts: list[tuple[int, bool, int, int, str]], store: Store) -> DataFrame:
    """(deck, i, value): what stands at the place i of a deck of ascending numbers once place i has been swapped with its
    draw, from the last place down to i.

    A swap leaves at its draw what stood at its place. So place i gets what stood at its draw: what the swap before, of
    the same draw, left there, which stood at that swap's place, where an earlier one may have left it in turn. These
    chains are followed by doubling.
    """

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.random.PCG64()
        for batch in batches:
            for row in batch.to_pylist():
                bits.state = json.loads(row["state"])
                i, j = _swaps(bits, row["masked"], row["last"], row["count"])
                for at in range(0, len(i), 1 << 16):
                    own = slice(at, at + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array([row["deck"]] * len(i[own]), pa.int32()), pa.array(i[own]), pa.array(j[own])], ["deck", "i", "j"])

    ship(spark)
    states = spark.createDataFrame(parts, "deck int, masked boolean, last long, count long, state string").repartition(min(max(len(parts), 1), 1000), "deck", "last")
    draws = store.build(f"draws-{uuid.uuid4().hex}", lambda: states.mapInArrow(draw, "deck int, i long, j long"))
    hops = draws.where("i > j").groupBy("deck", F.col("j").alias("i")).agg(F.min("i").alias("to"))
    while True:  # what stood at i stood at its hop's end; each turn doubles the hops of a row
        hops = store.build(f"hops-{uuid.uuid4().hex}", lambda hops=hops: hops)
        ahead = hops.select("deck", F.col("i").alias("to"), F.col("to").alias("far"))
        if hops.join(ahead, ["deck", "to"], "left_semi").isEmpty():
            break
        hops = hops.join(ahead, ["deck", "to"], "left").select("deck", "i", F.coalesce("far", "to").alias("to"))
    before = F.lead("i").over(W.partitionBy("deck", "j").orderBy("i"))
    ends = hops.select("deck", F.col("i").alias("before"), "to")
    found = draws.withColumn("before", before).join(ends, ["deck", "before"], "left")
    return found.select("deck", "i", F.coalesce("to", "before", "j").alias("value"))


def sample_id(split: Column, query_id: Column, doc_id: Column) -> Column:
    return F.concat_ws(":", split, query_id.cast("string"), doc_id.cast("string"))


def override(judged: DataFrame, second: DataFrame) -> DataFrame:
    """Grades with those of second in place of the first where it has one."""
    new = second.select("query_id", "doc_id", F.col("grade").alias("new"))
    return judged.join(new, ["query_id", "doc_id"], "left").select("query_id", "doc_id", F.coalesce("new", "grade").alias("grade"))


def aligned(first: DataFrame, second: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, doc_id, a, b) of two judges; a key of second that first lacks, or a grade outside 0 to 3, is an error."""
    bad = second.join(first, [key, "doc_id"], "left_anti")
    if not bad.isEmpty() or not second.where(~F.col("grade").between(0, 3) | F.col("grade").isNull()).isEmpty():
        raise ValueError("the second labels hold unknown pairs or grades")
    return second.withColumnRenamed("grade", "b").join(first.withColumnRenamed("grade", "a"), [key, "doc_id"])


def aligned_topics(first: Judgments, second: Judgments) -> Judgments:
    """The same of grades that queries share, (topic, doc_id, a, b); both judges have the same topics."""
    return Judgments(aligned(first.grades, second.grades, "topic"), first.topics)


def newly_relevant(new: DataFrame, old: DataFrame, grade: int = 2) -> DataFrame:
    """Pairs relevant by the new grades that the old relevance list lacks."""
    return new.where(F.col("grade") >= grade).select("query_id", "doc_id").join(old, ["query_id", "doc_id"], "left_anti")


def merge_metrics(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by method: new rows replace, old order first, new names after in theirs. Both have (method, place, metrics...)."""
    names = [c for c in old.columns if c not in ("method", "place")]
    both = old.alias("o").join(new.alias("n"), "method", "full_outer")
    pick = [F.when(F.col("n.place").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in names]
    order = F.struct(F.col("o.place").isNull().alias("new"), F.coalesce("o.place", "n.place").alias("at"))
    return both.select("method", F.row_number().over(W.orderBy(order)).cast("long").alias("place"), *pick)


def preferred_order(methods: DataFrame, preferred: list[str]) -> DataFrame:
    """(method, place): those of the list in its order, then the others by name."""
    number = F.coalesce(*[F.when(F.col("method") == m, F.lit(n)) for n, m in enumerate(preferred)], F.lit(1000))
    return methods.select("method", F.row_number().over(W.orderBy(number, "method")).cast("long").alias("place"))


def same_sample(a: DataFrame, b: DataFrame) -> bool:
    """Whether two samples of (query_id, doc_id) hold the same pairs, each as often."""
    x, y = (df.select("query_id", "doc_id") for df in (a, b))
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()


def explorer(run: DataFrame, judged: DataFrame, queries: DataFrame) -> DataFrame:
    """A row a query: its text, each system's ids in rank order, and its judgments, as one nested JSON text."""
    lists = run.groupBy("query_id", "method").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))).alias("x"))
    systems = lists.groupBy("query_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("method", F.col("x.doc_id").alias("ids"))))).alias("rankings"))
    grades = judged.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("doc_id", "grade"))).alias("judgments"))
    out = queries.join(systems, "query_id", "left").join(grades, "query_id", "left")
    return out.select("query_id", F.to_json(F.struct("query", "rankings", "judgments")).alias("data"))
