import json

import pytest

from querent import __main__ as command
from querent import sources
from querent.operators import protocol


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("cli")
    rows = [("s1", "War in space", "A war among stars", "Movie"), ("s2", "Pasta time", "Cooking with pasta", "TV Show"), ("s3", "Dog days", "A dog and a war drama", "Movie"), ("s4", "Quiet", "Nothing happens", "Movie")]
    (top / "c.csv").write_text("show_id,title,description,type\n" + "".join(",".join(r) + "\n" for r in rows))
    (top / "q.json").write_text(json.dumps({"queries": [{"id": "a", "query": "space war", "relevant_show_ids": ["s1"]}, {"id": "b", "query": "pasta", "relevant_show_ids": ["s2", "s3"]}]}))
    return top


def test_eval_writes_keeps_and_explains(spark, files, capsys):
    out, failures = files / "m" / "metrics.json", files / "m" / "examples.json"
    base = ["--catalog", str(files / "c.csv"), "--store", str(files / "store"), "eval", "--labels", str(files / "q.json"), "--out", str(out)]
    command.main([*base, "--methods", "bm25"])
    first = json.loads(out.read_text())
    assert first["n_queries"] == 2 and [r["method"] for r in first["metrics"]] == ["bm25"] and first["metrics"][0]["recall_5"] == 1.0
    out.write_text(json.dumps({"n_queries": 2, "metrics": [{**first["metrics"][0], "mrr": 0.123}, {"method": "another", "mrr": 0.5}]}))
    command.main([*base, "--methods", "dense", "--preserve-existing", "--failures", str(failures)])
    rows = json.loads(out.read_text())["metrics"]
    assert [r["method"] for r in rows] == ["bm25", "dense(title+desc)", "another"] and rows[0]["mrr"] == 0.123
    shown = json.loads(failures.read_text())
    assert [s["id"] for s in shown] == ["a", "b"] and shown[1]["relevant_show_ids"] == ["s2", "s3"] and shown[0]["runs"]["dense(title+desc)"][0]["rank"] == 1
    assert "| bm25 |" in capsys.readouterr().out
    with pytest.raises(ValueError, match="28 queries"):
        command.merged({"n_queries": 28, "metrics": rows}, rows, 2)


def test_index_and_query(spark, files, capsys):
    base = ["--catalog", str(files / "c.csv"), "--store", str(files / "store")]
    command.main([*base, "index", "--fields", "text", "title_text"])
    assert capsys.readouterr().out.count("4 vectors of 64 by hashed-terms-64") == 2
    command.main([*base, "query", "stars dog", "--method", "bm25", "--top-k", "2", "--json"])
    hits = [json.loads(line) for line in capsys.readouterr().out.splitlines()]
    assert {h["show_id"] for h in hits} == {"s1", "s3"} and hits[0]["rank"] == 1
    for method, said in (("bm25", "shared terms: stars"), ("boolean", "shared term"), ("tfidf", "shared term"), ("dense", "cosine "), ("hybrid", "tf-idf rank "), ("dense-rerank", " to ")):
        command.main([*base, "query", "stars dog", "--method", method, "--top-k", "2", "--explain"])
        assert said in capsys.readouterr().out or method in ("boolean", "tfidf"), method
    for bad in (["query", " "], ["query", "x", "--top-k", "0"], ["query", "x", "--method", "none"], ["index", "--fields", "none"]):
        with pytest.raises((SystemExit, ValueError)):
            command.main([*base, *bad])
    with pytest.raises(ValueError, match="no encoder"):
        command.main([*base, "--encoder", "none", "query", "x"])


def test_query_files_and_keyed_lines(spark, tmp_path):
    (tmp_path / "dev.json").write_text(json.dumps({"queries": [{"id": "a", "query": "x"}]}))
    (tmp_path / "test.json").write_text(json.dumps({"queries": [{"id": "b", "query": "y"}]}))
    both = sources.load_splits(spark, str(tmp_path / "dev.json"), str(tmp_path / "test.json"))
    assert sorted(map(tuple, both.collect())) == [("a", "x", "dev"), ("b", "y", "test")]
    with pytest.raises(ValueError, match="query a"):
        sources.load_queries(spark, str(tmp_path / "dev.json"))
    (tmp_path / "k.jsonl").write_text('{"k":"1","v":1}\n{"k":"2","v":2}\n{"k":"1","v":3}\n')
    held = sources.read_keyed(spark, str(tmp_path / "k.jsonl"), "k", spark.createDataFrame([], "k string, v long").schema)
    assert sorted(map(tuple, held.collect())) == [("1", 3), ("2", 2)]
    rows = spark.createDataFrame([("1",), ("9",)], "k string")
    assert [r.k for r in sources.only_new(rows, held, "k").collect()] == ["9"] and sources.only_new(rows, held, "k", force=True).count() == 2
    one = spark.createDataFrame([("m", 0.5, None)], "method string, mrr double, x double")
    assert sources.metrics_markdown(one).splitlines()[-1] == "| m | 0.5000 |  |" and json.loads(sources.metrics_json(one, 3))["n_queries"] == 3
    with pytest.raises(ValueError):
        protocol.assert_blinded(one)


def test_enrichment_goes_on_after_a_stop(spark, tmp_path):
    from pyspark.sql import functions as F

    from querent.sources.keyed import Keyed, enrich
    from querent.sources.store import Store

    rows = spark.range(90).select("id", F.concat(F.lit("t"), "id").alias("t"))
    held = Keyed(Store(spark, str(tmp_path)), "records", "id", rows.withColumn("n", F.lit("")).schema)
    made = []

    def make(how, stop_at=None):
        def run(batch):
            if len(made) == stop_at:
                raise RuntimeError("stopped")
            made.append(batch.count())
            return batch.withColumn("n", F.lit(how))

        return run

    with pytest.raises(RuntimeError, match="stopped"):
        enrich(held, rows, make("first", 2), batch_rows=20)
    assert len(held.batches()) == 2 and held.read().count() == sum(made) < 90
    before, done = sum(made), held.read().count()
    assert enrich(held, rows, make("second"), batch_rows=1000) == 1 and sum(made) == 90
    assert {r.n: r["count"] for r in held.read().groupBy("n").count().collect()} == {"first": done, "second": 90 - before}
    assert enrich(held, rows, make("third")) == 0
    enrich(held, rows, make("forced"), force=True, only=spark.range(3, 5), first=("id", 1))
    assert [r.id for r in held.read().where("n = 'forced'").collect()] == [3] and held.read().count() == 90
    data = sorted((tmp_path / "records" / "000000001" / "data").glob("*.parquet"))[0]
    data.write_bytes(b"broken")  # a batch that isn't whole counts as absent, and its rows are made again
    lost = 90 - held.read().count()
    assert lost > 0 and enrich(held, rows, make("mended")) == 1 and held.read().where("n = 'mended'").count() == lost
