"""Files in and out: catalogs, side tables, query sets, keyed JSON lines, result files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querent.operators.fields import text_fields

#: Texts that a catalog file means nothing by.
NULLS = ("", "NA", "N/A", "NaN", "nan", "null", "NULL", "None", "n/a")
PLOTS = T.StructType([T.StructField(c, T.StringType()) for c in ("show_id", "plot_text", "wiki_title", "wiki_url", "status", "confidence")])


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A header CSV with quoted line breaks; every column a string, NULLS as null, doc_id in the order of the file."""
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    out = raw.select(*[F.when(~F.trim(F.col(f"`{c}`")).isin(*NULLS), F.col(f"`{c}`")).alias(c) for c in raw.columns])
    return out.withColumn("__at", F.monotonically_increasing_id()).withColumn("doc_id", F.row_number().over(W.orderBy("__at")).cast("long") - 1).drop("__at")


def load_plots(spark: SparkSession, path: str) -> DataFrame:
    """show_id, plot, wiki_title, wiki_url, plot_status, plot_confidence of JSON lines: text of matched rows only, the first
    line of an id wins. A file that isn't there is an empty table."""
    try:
        lines = spark.read.schema(PLOTS).json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        lines = spark.createDataFrame([], PLOTS)
    text = F.when((F.col("status") == "matched") & (F.trim(F.coalesce("plot_text", F.lit(""))) != ""), F.col("plot_text")).otherwise("")
    rows = lines.where("show_id is not null").select("show_id", text.alias("plot"), "wiki_title", "wiki_url", F.col("status").alias("plot_status"), F.col("confidence").alias("plot_confidence"), F.monotonically_increasing_id().alias("at"))
    fields = [c for c in rows.columns if c not in ("show_id", "at")]
    first = rows.groupBy("show_id").agg(F.min_by(F.struct(*fields), "at").alias("x"))
    return first.select("show_id", *[F.col(f"x.{c}").alias(c) for c in fields])


def load_catalog(spark: SparkSession, csv: str, plots: str | None = None) -> DataFrame:
    return text_fields(read_csv(spark, csv), load_plots(spark, plots) if plots else None)


def load_queries(spark: SparkSession, path: str, split: str | None = None, labels: bool = True) -> tuple[DataFrame, DataFrame]:
    """(query_id, query, split) and (query_id, show_id) of a query file. With labels, a query without relevant ids is an error."""
    relevant = T.StructField("relevant_show_ids", T.ArrayType(T.StringType()))
    item = T.StructType([T.StructField("id", T.StringType()), T.StructField("query", T.StringType()), relevant])
    rows = spark.read.schema(T.StructType([T.StructField("queries", T.ArrayType(item))])).json(path, multiLine=True).select(F.inline("queries"))
    if labels:
        bad = rows.where("relevant_show_ids is null").limit(1).collect()
        if bad:
            raise ValueError(f"query {bad[0]['id']} has no relevant_show_ids")
    return rows.select(F.col("id").alias("query_id"), "query", F.lit(split).alias("split")), rows.select(F.col("id").alias("query_id"), F.explode("relevant_show_ids").alias("show_id"))


def load_splits(spark: SparkSession, dev: str, test: str) -> DataFrame:
    """The queries of both files with their split; labels aren't read."""
    return load_queries(spark, dev, "dev", labels=False)[0].unionByName(load_queries(spark, test, "test", labels=False)[0])


def read_keyed(spark: SparkSession, path: str, key: str, schema: T.StructType) -> DataFrame:
    """JSON lines by key; the last line of a key wins."""
    rows = spark.read.schema(schema).json(path).withColumn("__at", F.monotonically_increasing_id())
    fields = [c for c in rows.columns if c not in (key, "__at")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*fields), "__at").alias("x")).select(key, "x.*")


def write_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def only_new(rows: DataFrame, done: DataFrame, key: str, force: bool = False) -> DataFrame:
    """Rows whose key isn't done yet."""
    return rows if force else rows.join(done.select(key).distinct(), key, "left_anti")


def metrics_json(metrics: DataFrame, n_queries: int) -> str:
    """A small table of metrics, one row a system, as the text of a results file."""
    return json.dumps({"n_queries": n_queries, "metrics": [r.asDict() for r in metrics.collect()]}, indent=2) + "\n"


def metrics_markdown(metrics: DataFrame) -> str:
    """The same as a Markdown table: four places, without n_queries; what is undefined is empty."""
    columns = [c for c in metrics.columns if c != "n_queries"]
    say = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    rows = [[say(r[c]) for c in columns] for r in metrics.collect()]
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns), *("| " + " | ".join(r) + " |" for r in rows)]) + "\n"


def replace_block(text: str, name: str, body: str) -> str:
    """Text with what stands between the markers of a name replaced; missing markers are an error."""
    begin, end = f"<!-- {name}:begin -->", f"<!-- {name}:end -->"
    if text.count(begin) != 1 or text.count(end) != 1 or text.index(begin) > text.index(end):
        raise ValueError(f"no markers of {name}")
    return text[: text.index(begin) + len(begin)] + "\n" + body.strip("\n") + "\n" + text[text.index(end) :]
