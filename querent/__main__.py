"""python -m querent --catalog FILE query TEXT | eval | index: the command line over a catalog file."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querent import sources
from querent.functions.text import preview
from querent.operators import encode, metrics
from querent.operators.fields import FIELDS
from querent.plans.systems import SYSTEMS, Engine, resolve
from querent.sources.store import Store


def positive(value: str) -> int:
    n = int(value)
    if n < 1:
        raise argparse.ArgumentTypeError("must be at least 1")
    return n


def some_text(value: str) -> str:
    if not value.strip():
        raise argparse.ArgumentTypeError("must not be blank")
    return value


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("querent")
    p.add_argument("--catalog", required=True)
    p.add_argument("--plots")
    p.add_argument("--store", help="folder of indexes and vectors; below spark.checkpoint.dir by default")
    p.add_argument("--encoder", default=encode.HASHED.name)
    sub = p.add_subparsers(dest="command", required=True)
    q = sub.add_parser("query", help="ranks the catalog for a text")
    q.add_argument("text", type=some_text)
    q.add_argument("--method", default="dense", type=resolve)
    q.add_argument("--top-k", default=10, type=positive)
    q.add_argument("--json", action="store_true")
    q.add_argument("--explain", action="store_true", help="say why each hit is there")
    e = sub.add_parser("eval", help="metrics of systems over labelled queries")
    e.add_argument("--labels", "--queries", dest="labels", required=True)
    e.add_argument("--ks", nargs="+", default=[5, 10], type=positive)
    e.add_argument("--methods", nargs="+", default=list(SYSTEMS), type=resolve)
    e.add_argument("--out", help="JSON file of the metrics")
    e.add_argument("--preserve-existing", action="store_true", help="keep the systems in the file that aren't evaluated now")
    e.add_argument("--failures", metavar="FILE", help="JSON file of each query's first five hits in each system")
    i = sub.add_parser("index", help="encodes and stores vectors of text fields")
    i.add_argument("--fields", nargs="+", default=list(FIELDS), choices=FIELDS)
    return p


def merged(old: dict | None, rows: list[dict], n_queries: int) -> dict:
    """What a metrics file says after an evaluation: new rows replace those of their system, others stay; systems in the order
    of SYSTEMS, unknown ones after them by name. Files of other numbers of queries don't mix."""
    held = {r["method"]: r for r in (old or {}).get("metrics", [])}
    if held and old["n_queries"] != n_queries:
        raise ValueError(f"the file has metrics of {old['n_queries']} queries, these are of {n_queries}")
    order = {name: n for n, name in enumerate(SYSTEMS)}
    held |= {r["method"]: r for r in rows}
    return {"n_queries": n_queries, "metrics": sorted(held.values(), key=lambda r: (order.get(r["method"], len(order)), r["method"]))}


def examples(run: DataFrame, asked: DataFrame, relevant: DataFrame, catalog: DataFrame, k: int = 5) -> list[dict]:
    """Each query with its relevant ids and the first k hits of each system, of a query set for reading."""
    titles = catalog.select("doc_id", "show_id", "title")
    hits = run.where(F.col("rank") <= k).join(titles, "doc_id").groupBy("query_id", "method").agg(F.array_sort(F.collect_list(F.struct("rank", "show_id", "title", "score"))).alias("hits"))
    runs = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("method", "hits"))).alias("runs"))
    wanted = relevant.groupBy("query_id").agg(F.array_sort(F.collect_list("show_id")).alias("relevant_show_ids"))
    rows = asked.join(wanted, "query_id", "left").join(runs, "query_id", "left").orderBy("query_id")
    shown = [json.loads(r["j"]) for r in rows.select(F.to_json(F.struct(F.col("query_id").alias("id"), "query", "relevant_show_ids", "runs")).alias("j")).collect()]
    return [{**s, "runs": {r["method"]: r["hits"] for r in s.get("runs", [])}} for s in shown]


def evaluate(a: argparse.Namespace, spark: SparkSession, engine: Engine) -> None:
    asked, relevant = sources.load_queries(spark, a.labels)
    ids = engine.catalog.groupBy("show_id").agg(F.min("doc_id").alias("doc_id"))
    wanted = relevant.join(ids, "show_id", "left")
    lost = wanted.where("doc_id is null").limit(1).collect()
    if lost:
        raise ValueError(f"query {lost[0].query_id}: {lost[0].show_id} isn't in the catalog")
    run = None
    for name in a.methods:
        own = engine.rank(name, asked, max(a.ks)).select(F.lit(name).alias("method"), "query_id", "doc_id", "rank", "score")
        run = own if run is None else run.unionByName(own)
    table = metrics.means(metrics.binary_metrics(run, wanted, asked, tuple(a.ks)))
    table = table.select("method", *[c for c in table.columns if c != "method" and not c.startswith("n_")])
    rows, out = [r.asDict() for r in table.collect()], Path(a.out) if a.out else None
    found = merged(json.loads(out.read_text()) if out and a.preserve_existing and out.exists() else None, rows, asked.count())
    print(sources.metrics_markdown(spark.createDataFrame([tuple(r.get(c) for c in table.columns) for r in found["metrics"]], table.schema)))
    for path, body in ((out, found), (Path(a.failures) if a.failures else None, a.failures and examples(run, asked, relevant, engine.catalog))):
        if path:
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(json.dumps(body, indent=2, ensure_ascii=False) + "\n", encoding="utf-8")


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    engine = Engine(sources.load_catalog(spark, a.catalog, a.plots), Store(spark, a.store), encoder=a.encoder)
    if a.command == "eval":
        evaluate(a, spark, engine)
    elif a.command == "index":
        for field in a.fields:
            key, _ = encode.content_key(engine.catalog, "doc_id", field, engine.encoder.name, field)
            engine.index(field)
            facts = engine.store.manifest(f"vectors-{key}")
            print(f"{field}: {facts['rows']} vectors of {facts['width']} by {facts['encoder']}, {key}")
    else:
        asked = spark.createDataFrame([(0, a.text)], "query_id long, query string")
        hits = engine.query(a.method, asked, a.top_k).orderBy("rank")
        said = {r.doc_id: r.said for r in engine.explain(a.method, asked, a.top_k).collect()} if a.explain else {}
        for r in hits.select(F.to_json(F.struct("*")).alias("j"), "doc_id", "rank", "score", "title", preview(F.col("description")).alias("d")).collect():
            print(r.j if a.json else f"{r['rank']:>3}  {r.score:.4f}  {r.title}\n     {r.d}" + (f"\n     {said[r.doc_id]}" if r.doc_id in said else ""))


if __name__ == "__main__":
    main()
