"""Retrieval metrics per query, as grouped plans over many systems at once.

run: (method, query_id, doc_id, rank); judged: (query_id, doc_id, grade). A metric that is undefined for a
query is null, so means leave it out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RELEVANT = 2


@dataclass(frozen=True)
class Judgments:
    """Grades that queries share: grades (topic, doc_id, grade), topics (query_id, topic). As pairs they would be as many as
    queries times documents, so metrics join them to the rows of runs and count them by topic."""

    grades: DataFrame
    topics: DataFrame

    @staticmethod
    def of(judged: DataFrame | Judgments) -> Judgments:
        """Of pairs (query_id, doc_id, ...) each query is a topic."""
        if isinstance(judged, Judgments):
            return judged
        return Judgments(judged.withColumnRenamed("query_id", "topic"), judged.select("query_id", F.col("query_id").alias("topic")).distinct())

    def where(self, condition: Column | str) -> Judgments:
        return Judgments(self.grades.where(condition), self.topics)

    def pairs(self) -> DataFrame:
        return self.grades.join(self.topics, "topic").drop("topic")

    def joined(self, run: DataFrame, how: str = "inner") -> DataFrame:
        """run's rows with the grades of their documents; those without one are lost, or null if how is left."""
        return run.join(self.topics, "query_id", how).join(self.grades, ["topic", "doc_id"], how).drop("topic")

    def by_query(self, counted: DataFrame) -> DataFrame:
        """counted (topic, ...) with a row a query."""
        return self.topics.join(counted, "topic").drop("topic")


def gain(grade: Column) -> Column:
    """2 ** grade - 1; a negative grade is an error."""
    return F.when(grade < 0, F.raise_error(F.lit("grades can't be negative"))).otherwise(F.pow(F.lit(2.0), grade) - 1.0)


def discount(rank: Column) -> Column:
    return F.log2(rank.cast("double") + 1.0)


def ideal_binary(n: Column, k: int) -> Column:
    """The best discounted sum of n relevant documents in k places."""
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(n, F.lit(k)), F.lit(1)).cast("int")), F.lit(0.0), lambda a, i: a + 1.0 / discount(i))


def in_order(part: Column) -> Column:
    """The sum of parts in the order of rank, so that equal rows have equal sums in whatever order they come."""
    return F.aggregate(F.array_sort(F.collect_list(F.struct("rank", part.alias("part")))), F.lit(0.0), lambda a, x: a + x["part"])


def binary_metrics(run: DataFrame, relevant: DataFrame | Judgments, queries: DataFrame, ks: tuple[int, ...] = (5, 10), depth: int | None = None) -> DataFrame:
    """(method, query_id, recall_k, ndcg_k of each k, mrr): relevant has (query_id, doc_id); null without relevant documents.

    A document that a ranking repeats counts once, at its best rank for recall and mrr. mrr looks at depth places, the largest k by default."""
    depth = depth or max(ks)
    relevant = Judgments.of(relevant)
    sizes = Judgments(relevant.grades.select("topic", "doc_id").distinct(), relevant.topics)
    n = sizes.by_query(sizes.grades.groupBy("topic").agg(F.count("*").alias("n")))
    frame = run.select("method").distinct().crossJoin(F.broadcast(queries.select("query_id").distinct())).join(n, "query_id", "left")
    hits = sizes.joined(run)
    parts = [F.count_distinct(F.when(F.col("rank") <= k, F.col("doc_id"))).alias(f"hit_{k}") for k in ks]
    parts += [in_order(F.when(F.col("rank") <= k, 1.0 / discount(F.col("rank"))).otherwise(0.0)).alias(f"dcg_{k}") for k in ks]
    found = hits.groupBy("method", "query_id").agg(F.min(F.when(F.col("rank") <= depth, F.col("rank"))).alias("first"), *parts)
    all_rows = frame.join(found, ["method", "query_id"], "left")
    some = F.col("n") > 0
    out = [F.when(some, F.coalesce(F.col(f"hit_{k}"), F.lit(0)) / F.col("n")).alias(f"recall_{k}") for k in ks]
    out += [F.when(some, F.coalesce(F.col(f"dcg_{k}"), F.lit(0.0)) / ideal_binary(F.col("n"), k)).alias(f"ndcg_{k}") for k in ks]
    return all_rows.select("method", "query_id", *out, F.when(some, F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"))


def graded_ndcg(run: DataFrame, judged: DataFrame | Judgments, queries: DataFrame, k: int = 10, judged_only: bool = False) -> DataFrame:
    """(method, query_id, ndcg): gains of grades over the best order of all judged documents of the query; unjudged
    documents gain 0, or with judged_only are taken out and the rest closes up. Null where no grade is over 0."""
    judged = Judgments.of(judged)
    counts = judged.grades.groupBy("topic", "grade").agg(F.count("*").alias("n"))
    best = counts.groupBy("topic").agg(F.sort_array(F.collect_list(F.struct("grade", F.least("n", F.lit(k)).cast("int").alias("n"))), asc=False).alias("x"))
    order = F.slice(F.flatten(F.transform("x", lambda c: F.array_repeat(c["grade"], c["n"]))), 1, k)
    ideal = judged.by_query(best.select("topic", F.aggregate(F.transform(order, lambda g, i: F.coalesce(gain(g), F.lit(0.0)) / discount(i + 1)), F.lit(0.0), lambda a, x: a + x).alias("ideal")))
    rows = judged.joined(run, "inner" if judged_only else "left")
    if judged_only:
        rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("method", "query_id").orderBy("rank")))
    dcg = rows.where(F.col("rank") <= k).groupBy("method", "query_id").agg(in_order(F.coalesce(gain(F.col("grade")), F.lit(0.0)) / discount(F.col("rank"))).alias("dcg"))
    frame = run.select("method").distinct().crossJoin(F.broadcast(queries.select("query_id").distinct()))
    out = frame.join(dcg, ["method", "query_id"], "left").join(ideal, "query_id", "left")
    return out.select("method", "query_id", F.when(F.col("ideal") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).alias("ndcg"))


def query_scores(run: DataFrame, judged: DataFrame | Judgments, queries: DataFrame) -> DataFrame:
    """Per query: recall_5, recall_10, graded ndcg_10 and mrr over ten places; relevant means a grade of at least 2."""
    binary = binary_metrics(run.where("rank <= 10"), judged.where(F.col("grade") >= RELEVANT), queries, (5, 10))
    graded = graded_ndcg(run, judged, queries).withColumnRenamed("ndcg", "ndcg_10")
    return binary.drop("ndcg_5", "ndcg_10").join(graded, ["method", "query_id"])


def means(scores: DataFrame, by: tuple[str, ...] = ("method",), places: int = 4) -> DataFrame:
    """The mean of each metric, nulls left out, and how many queries have the first and the ndcg."""
    names = [c for c in scores.columns if c not in (*by, "query_id", "method", "split")]
    return scores.groupBy(*by).agg(*[F.round(F.avg(c), places).alias(c) for c in names], *[F.count(c).alias(f"n_{c}") for c in names])


def unjudged_slots(run: DataFrame, judged: DataFrame | Judgments, depth: int = 10) -> DataFrame:
    """(method, slots, unjudged) of the first depth places."""
    rows = Judgments.of(judged).joined(run.where(F.col("rank") <= depth), "left")
    return rows.groupBy("method").agg(F.count("*").alias("slots"), F.count_if(F.col("grade").isNull()).alias("unjudged"))


def grade_histogram(judged: DataFrame) -> DataFrame:
    """(grade, n) of 0 to 3, empty ones too."""
    counts = judged.groupBy(F.col("grade").cast("long").alias("grade")).agg(F.count("*").alias("n"))
    return judged.sparkSession.range(4).withColumnRenamed("id", "grade").join(F.broadcast(counts), "grade", "left").select("grade", F.coalesce("n", F.lit(0)).alias("n"))


def split_tables(scores: DataFrame, run: DataFrame, judged: DataFrame | Judgments, split: Column, depth: int = 10, places: int = 4) -> DataFrame:
    """A row a split and system, one for all splits of a system (split null): n_queries, n_scored by ndcg and
    n_scored_recall, unjudged places among the first depth, and the means, nulls left out; one grouping with sets."""
    slots = Judgments.of(judged).joined(run.where(F.col("rank") <= depth), "left").groupBy("method", "query_id").agg(F.count_if(F.col("grade").isNull()).alias("unjudged"))
    names = [c for c in scores.columns if c not in ("method", "query_id")]
    rows = scores.join(slots, ["method", "query_id"], "left").withColumn("split", split)
    parts = [F.count("*").alias("n_queries"), F.count("ndcg_10").alias("n_scored"), F.count("recall_10").alias("n_scored_recall"), F.coalesce(F.sum("unjudged"), F.lit(0)).alias("unjudged")]
    return rows.groupingSets([["split", "method"], ["method"]], "split", "method").agg(*parts, *[F.round(F.avg(c), places).alias(c) for c in names])


def label_counts(judged: DataFrame, queries: DataFrame, split: Column) -> DataFrame:
    """A row a split and one for all (split null): queries, those with a grade over 0 and with a relevant one, judged
    pairs, pairs of a grade over 0, relevant pairs."""
    own = judged.groupBy("query_id").agg(F.count("*").alias("n"), F.count_if(F.col("grade") > 0).alias("positive"), F.count_if(F.col("grade") >= RELEVANT).alias("relevant"))
    rows = queries.select("query_id").join(own, "query_id", "left").fillna(0, ["n", "positive", "relevant"]).withColumn("split", split)
    return rows.groupingSets([["split"], []], "split").agg(
        F.count("*").alias("n_queries"), F.count_if(F.col("positive") > 0).alias("n_with_positive"), F.count_if(F.col("relevant") > 0).alias("n_with_relevant"),
        F.sum("n").alias("n_judged"), F.sum("positive").alias("n_positive"), F.sum("relevant").alias("n_relevant"),
    )
