import pytest


@pytest.mark.parametrize("held", [1, 10**6])
def test_components(shipped, monkeypatch, held):
    from querent.llm import components as c

    monkeypatch.setattr(c, "TREE_LINKS", held)
    links = [(9, 8), (8, 7), (7, 6), (1, 6), (20, 21), (21, 22), (30, 30), (20, 22)] + [(100 + k, 101 + k) for k in range(40)]
    got = {r.id: r.component for r in c.components(shipped.createDataFrame(links, "a long, b long").repartition(5)).collect()}
    assert got == {1: 1, 6: 1, 7: 1, 8: 1, 9: 1, 20: 20, 21: 20, 22: 20} | {100 + k: 100 for k in range(41)}
    assert c.components(shipped.createDataFrame([], "a long, b long")).count() == 0


def test_a_sample_keeps_to_its_limit_where_one_id_has_many_rows(shipped):
    from pyspark.sql import functions as F

    from querent.llm.learning import sample

    docs = shipped.range(50_000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 700).cast("string")).alias("text"))
    docs = docs.unionByName(shipped.range(2, 60).select(F.col("id").alias("doc_id"), F.lit("other").alias("text")))
    labels = shipped.range(1, 60).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    found = sample(docs, labels, "toxic", F.lit(True), limit=200).collect()
    assert len(found) == 200 and {tuple(r) for r in found} == {tuple(r) for r in sample(docs.orderBy(F.desc("text")), labels, "toxic", F.lit(True), limit=200).collect()}
    few = sample(docs, labels, "toxic", F.lit(True), limit=5000).collect()
    assert len(few) == 700 + 58 and {r.y for r in few if r.doc_id == 1} == {1}
