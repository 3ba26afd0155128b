"""Paired comparisons and agreement between judges."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querent.shipping import ship


def paired(scores: DataFrame, baseline: str, metric: str) -> DataFrame:
    """(method, query_id, diff) against a baseline method; pairs with a null or non-finite side are left out."""
    fine = scores.where(F.col(metric).isNotNull() & ~F.isnan(metric) & (F.abs(metric) < float("inf")))
    base = fine.where(F.col("method") == baseline).select("query_id", F.col(metric).alias("base"))
    return fine.where(F.col("method") != baseline).join(base, "query_id").select("method", "query_id", (F.col(metric) - F.col("base")).alias("diff"))


#: Draws of a part of a method's resamples, and of those that a task holds at once (a resample is held whole).
PART, CHUNK = 1 << 26, 1 << 22


def raw_words(seed: int, start: int, count: int) -> np.ndarray:
    """32-bit words start to start + count of the stream behind numpy's default generator: each 64-bit output gives its
    lower half first."""
    bits = np.random.PCG64(seed).advance(start // 2)
    return bits.random_raw((count + start % 2 + 1) // 2).astype("<u8").view("<u4")[start % 2 : start % 2 + count]


def accepted(words: np.ndarray, n: int) -> np.ndarray:
    """The whole numbers under n that the generator makes of words: the upper half of the product, unless the lower half
    is one of the 2**32 % n that would favour some numbers."""
    product = words.astype(np.uint64) * np.uint64(n)
    lower = product & np.uint64(0xFFFFFFFF)
    return (product[lower >= np.uint64((2**32 - n) % n)] >> np.uint64(32)).astype(np.int64)


def rejected(seed: int, n: int, start: int, count: int) -> int:
    """How many of count words from start on are passed over."""
    return sum(min(CHUNK, start + count - at) - len(accepted(raw_words(seed, at, min(CHUNK, start + count - at)), n)) for at in range(start, start + count, CHUNK))


def draws(seed: int, n: int, start: int, skip: int, count: int) -> Iterator[np.ndarray]:
    """Numbers under n, in pieces: those made of the words from start on, without the first skip, count in all."""
    if n == 1:  # numpy draws nothing then
        yield np.zeros(count, np.int64)
        return
    while count:
        size = min(CHUNK, skip + count + 64)
        found = accepted(raw_words(seed, start, size), n)
        own = found[skip : skip + count]
        start, skip, count = start + size, max(0, skip - len(found)), count - len(own)
        yield own


def _resampled(seed: int):
    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by("query_id")
        x = part.column("diff").to_numpy()
        head = {c: part.column(c)[0].as_py() for c in ("method", "rows", "start", "skip")}
        means, rest = [], np.zeros(0, np.int64)
        for piece in draws(seed, len(x), head["start"], head["skip"], head["rows"] * len(x)):
            rest = np.concatenate([rest, piece])
            whole = len(rest) // len(x)
            means.append(x[rest[: whole * len(x)].reshape(whole, len(x))].mean(axis=1))
            rest = rest[whole * len(x) :]
        found = np.concatenate(means)
        return pa.table({"method": [head["method"]] * len(found), "n": pa.array([len(x)] * len(found), pa.int64()), "mean": [float(x.mean())] * len(found), "resampled": found})

    return run


def bootstrap(diffs: DataFrame, n_resamples: int = 10_000, seed: int = 20260928, level: float = 0.95, part: int = PART) -> DataFrame:
    """(method, n, mean, lo, hi): percentile interval of the mean difference over resampled queries.

    Draws are those of numpy's default generator with the seed, one resample after the other, queries in the order of
    query_id. A method's resamples are dealt into parts of about part draws: a part advances the generator to its first
    word, less what earlier parts passed over, which is counted before. So the result is the same in any number of parts.
    """
    if n_resamples < 1 or not 0 < level < 1:
        raise ValueError("at least one resample and a level between 0 and 1")
    spark = diffs.sparkSession
    ship(spark)
    sizes = [(r["method"], r["n"]) for r in diffs.groupBy("method").agg(F.count("*").alias("n")).collect()]
    if any(n >= 2**32 for _, n in sizes):
        raise ValueError("a method has at most 2 ** 32 - 1 queries")
    each = {n: max(1, min(n_resamples, part // n)) for _, n in sizes}
    cuts = {n: list(range(0, n_resamples, each[n])) for n in each}
    counted = [(n, at, n * at, n * min(each[n], n_resamples - at)) for n in each for at in cuts[n][:-1] if n & (n - 1)]
    passed = {}
    if counted:
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = batch.to_pylist()
                yield pa.RecordBatch.from_pylist([{"n": r["n"], "first": r["first"], "lost": rejected(seed, r["n"], r["start"], r["words"])} for r in rows], pa.schema([("n", pa.int64()), ("first", pa.int64()), ("lost", pa.int64())]))

        spread = spark.createDataFrame(counted, "n long, first long, start long, words long").repartition(min(len(counted), 1000), "n", "first")
        passed = {(r["n"], r["first"]): r["lost"] for r in spread.mapInArrow(count, "n long, first long, lost long").collect()}
    parts = []
    for method, n in sizes:
        lost = 0
        for at in cuts[n]:
            parts.append((method, at, min(each[n], n_resamples - at), n * at, lost))
            lost += passed.get((n, at), 0)
    dealt = diffs.join(F.broadcast(spark.createDataFrame(parts, "method string, first long, rows long, start long, skip long")), "method")
    found = dealt.groupBy("method", "first").applyInArrow(_resampled(seed), "method string, n long, mean double, resampled double")

    def interval(means: pa.Table) -> pa.Table:  # as many as there are resamples
        lo, hi = np.quantile(means.column("resampled").to_numpy(), [(1 - level) / 2, (1 + level) / 2])
        return pa.table({"method": [means.column("method")[0].as_py()], "n": pa.array([means.column("n")[0].as_py()], pa.int64()), "mean": [means.column("mean")[0].as_py()], "lo": [float(lo)], "hi": [float(hi)]})

    return found.groupBy("method").applyInArrow(interval, "method string, n long, mean double, lo double, hi double")


def compared(scores: DataFrame, baseline: str, metric: str, n_resamples: int = 10_000, seed: int = 20260928) -> DataFrame:
    """A row a method other than the baseline: the mean paired difference with its interval, wins, losses, ties and the sign
    test's p. Queries on which either side is undefined are left out of all of them."""
    diffs = paired(scores, baseline, metric)
    return bootstrap(diffs, n_resamples, seed).join(sign_test(diffs), "method").select("method", F.lit(baseline).alias("baseline"), "n", "mean", "lo", "hi", "wins", "losses", "ties", "p")


def sign_test(diffs: DataFrame) -> DataFrame:
    """(method, wins, losses, ties, p): exact two-sided binomial p of the smaller side; null if all are ties."""
    counts = diffs.groupBy("method").agg(F.count_if(F.col("diff") > 0).alias("wins"), F.count_if(F.col("diff") < 0).alias("losses"), F.count_if(F.col("diff") == 0).alias("ties"))
    n, low = F.col("wins") + F.col("losses"), F.least("wins", "losses")
    # each term of the tail by its logarithm, which the last one's gives
    start = F.struct((-n * math.log(2)).alias("term"), F.exp(-n * math.log(2)).alias("sum"))

    def add(a: Column, i: Column) -> Column:
        term = a["term"] + F.log((n - i + 1).cast("double") / i)
        return F.struct(term.alias("term"), (a["sum"] + F.exp(term)).alias("sum"))

    tail = F.aggregate(F.when(low > 0, F.sequence(F.lit(1).cast("long"), low)).otherwise(F.array().cast("array<bigint>")), start, add)["sum"]
    return counts.select("method", "wins", "losses", "ties", F.when(n > 0, F.least(F.lit(1.0), 2 * tail)).alias("p"))


def kappas(pairs: DataFrame, by: tuple[str, ...] = (), categories: int = 4, relevant: int = 2) -> DataFrame:
    """Agreement of two judges: pairs has (a, b) grades. n, exact and relevance agreement, quadratic weighted kappa and
    binary kappa of grade >= relevant; a kappa is null where chance alone would agree fully."""
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    ra, rb = (F.col("a") >= relevant).cast("double"), (F.col("b") >= relevant).cast("double")
    # the expected squared difference of independent draws is E a2 + E b2 - 2 E a E b
    m = pairs.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg((a == b).cast("double")).alias("exact"), F.avg((ra == rb).cast("double")).alias("same"),
        F.avg((a - b) * (a - b)).alias("seen"), (F.avg(a * a) + F.avg(b * b) - 2 * F.avg(a) * F.avg(b)).alias("expected"), F.avg(ra).alias("pa"), F.avg(rb).alias("pb"),
    )
    chance = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    return m.select(*by, "n", "exact", F.col("same").alias("relevance"), F.when(F.col("expected") > 1e-12, 1 - F.col("seen") / F.col("expected")).alias("quadratic_kappa"), F.when(chance < 1 - 1e-12, (F.col("same") - chance) / (1 - chance)).alias("binary_kappa"))


def confusion(pairs: DataFrame, categories: int = 4) -> DataFrame:
    """A row a grade of the first judge (empty ones too), a column a grade of the second."""
    grid = pairs.groupBy(F.col("a").cast("long").alias("a")).pivot("b", list(range(categories))).agg(F.count(F.lit(1)))
    rows = pairs.sparkSession.range(categories).withColumnRenamed("id", "a").join(F.broadcast(grid), "a", "left")
    return rows.select("a", *[F.coalesce(F.col(str(c)), F.lit(0)).alias(f"b{c}") for c in range(categories)])


def disagreements(pairs: DataFrame) -> DataFrame:
    """(query_id, doc_id, a, b) of the pairs that two judges grade apart."""
    return pairs.where("a <> b").select("query_id", "doc_id", "a", "b")


def agreement_tables(pairs: DataFrame, runs: DataFrame, split) -> DataFrame:
    """n, exact agreement and both kappas over all pairs, by split, by first grade, and by system (of pairs that it has in its
    first ten), in one pass over the pairs: the rows of a grouping have nulls in the other columns.

    split: a column of query_id. runs: (method, query_id, doc_id, rank).
    """
    systems = runs.where("rank <= 10").groupBy("query_id", "doc_id").agg(F.collect_set("method").alias("systems"))
    rows = pairs.join(systems, ["query_id", "doc_id"], "left").withColumn("split", split)
    # a pair stands once under no system, and once under each that has it
    named = rows.select("split", "a", "b", F.explode(F.concat(F.array(F.lit(None).cast("string")), F.coalesce("systems", F.array().cast("array<string>")))).alias("method"))
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    ra, rb = (F.col("a") >= 2).cast("double"), (F.col("b") >= 2).cast("double")
    sums = {"n": F.count(F.lit(1)), "same": F.sum((a == b).cast("double")), "near": F.sum((ra == rb).cast("double")), "sa": F.sum(a), "sb": F.sum(b), "saa": F.sum(a * a), "sbb": F.sum(b * b), "apart": F.sum((a - b) * (a - b)), "pa": F.sum(ra), "pb": F.sum(rb)}
    cells = named.groupBy("split", F.col("a").alias("grade"), "method").agg(*[c.alias(n) for n, c in sums.items()])
    kinds = [("all", F.col("method").isNull(), []), ("split", F.col("method").isNull(), ["split"]), ("grade", F.col("method").isNull(), ["grade"]), ("method", F.col("method").isNotNull(), ["method"])]
    marked = cells.withColumn("kind", F.explode(F.array(*[F.when(when, F.struct(F.lit(k).alias("kind"), *[(F.col(c).cast("string") if c in own else F.lit(None).cast("string")).alias(c) for c in ("split", "grade", "method")])) for k, when, own in kinds])))
    total = marked.where("kind is not null").groupBy("kind").agg(*[F.sum(n).alias(n) for n in sums])
    mean = lambda c: F.col(c) / F.col("n")
    expected = mean("saa") + mean("sbb") - 2 * mean("sa") * mean("sb")
    chance = mean("pa") * mean("pb") + (1 - mean("pa")) * (1 - mean("pb"))
    return total.select(
        "kind.kind", "kind.split", "kind.grade", "kind.method", F.col("n").cast("long").alias("n"), mean("same").alias("exact"), mean("near").alias("relevance"),
        F.when(expected > 1e-12, 1 - mean("apart") / expected).alias("quadratic_kappa"), F.when(chance < 1 - 1e-12, (mean("near") - chance) / (1 - chance)).alias("binary_kappa"),
    )
