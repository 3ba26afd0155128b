"""The stored index, its searches, the store, encoders and exact dense search."""

import glob
import json
import math
import os
import re
import threading
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from querent.functions import text
from querent.functions.text import STOP_WORDS
from querent.operators import encode, fields, rank, search, stats
from querent.plans import systems
from querent.sources.store import Store, fingerprint


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def corpus(n=400, words=80, seed=3):
    rng = np.random.default_rng(seed)
    odds = 1.0 / np.arange(1, words + 1)
    return [(k, " ".join(f"w{x}" for x in rng.choice(words, int(rng.integers(0, 30)), p=odds / odds.sum()))) for k in range(n)]


def plain_bm25(docs, query, k):
    bags = {i: Counter(re.findall("[a-z0-9]+", t.lower())) for i, t in docs}
    n, mean = len(bags), sum(sum(b.values()) for b in bags.values()) / len(bags)
    df = Counter(t for b in bags.values() for t in b)
    raw = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    low = 0.25 * sum(raw.values()) / len(raw)
    idf = {t: low if x < 0 else x for t, x in raw.items()}
    score = lambda b: sum(idf[t] * b[t] * 2.5 / (b[t] + 1.5 * (0.25 + 0.75 * sum(b.values()) / mean)) for t in re.findall("[a-z0-9]+", query) if b[t])
    ranked = sorted((-round(score(b), 6), i) for i, b in bags.items())[:k]
    return [(i, -s + 0.0) for s, i in ranked]


def test_search_of_the_stored_index_equals_scoring_every_document(spark, store, monkeypatch):
    monkeypatch.setattr(stats, "BLOCK", 16)
    monkeypatch.setattr(search, "GROUP", 3)
    monkeypatch.setattr(search, "ASKED", 20)
    docs = corpus() + [(1000 + k, "w70 w71 w72 w70") for k in range(40)]
    queries = [(q, " ".join(f"w{x}" for x in np.random.default_rng(q).choice(80, 5))) for q in range(12)] + [(20, "w70 w72"), (21, "nothing")]
    p = stats.plain_postings(spark.createDataFrame(docs, "doc_id long, text string"), "text", store)
    assert p.n == len(docs) and p.n_blocks > 20
    got = rank.bm25(p, spark.createDataFrame(queries, "query_id long, query string"), 10).orderBy("query_id", "rank").collect()
    for q, text in queries:
        assert [(r.doc_id, pytest.approx(r.score, abs=2e-6)) for r in got if r.query_id == q] == plain_bm25(docs, text, 10)


def group_of(weights, blocks, scheme):
    """A group of blocks of 10 documents with lists (number, document, count)."""
    rows = {"block": [], "numbers": [], "sizes": [], "mosts": [], "ats": [], "tfs": [], "docs": [], "sides": []}
    for b in range(blocks):
        lists = {}
        for number, doc, tf in weights:
            if doc // 10 == b:
                lists.setdefault(number, []).append((doc % 10, tf))
        pack = lambda values, kind: np.array(values, kind).tobytes()
        numbers = sorted(lists)
        flat = [x for n in numbers for x in sorted(lists[n])]
        values = [b, pack(numbers, "<i4"), pack([len(lists[n]) for n in numbers], "<i4"), pack([max(t for _, t in lists[n]) for n in numbers], "<i4"), pack([a for a, _ in flat], "<u2"), pack([t for _, t in flat], "<i4"), None, None]
        for row in (values, [b, None, None, None, None, None, list(range(10 * b, 10 * b + 10)), [1.0] * 10]):
            for column, value in zip(rows.values(), row):
                column.append(value)
    kinds = [pa.int64(), *[pa.binary()] * 5, pa.list_(pa.int64()), pa.list_(pa.float64())]
    return search.Group(pa.table([pa.array(v, k) for v, k in zip(rows.values(), kinds)], list(rows)), scheme)


def test_blocks_are_skipped_and_no_row_changes():
    rng = np.random.default_rng(7)
    held = [(0, d, int(rng.integers(1, 4))) for d in range(1000)] + [(1, int(d), 50) for d in rng.choice(300, 20, replace=False)]
    group = group_of(held, 100, search.Scheme(lambda tf, side: tf / side))
    for terms, weights in (([0, 1], [1.0, 1.0]), ([1], [2.0]), ([0], [1.0]), ([5], [1.0])):
        total = np.zeros(1000)
        for number, doc, tf in held:
            total[doc] += tf * dict(zip(terms, weights)).get(number, 0.0)
        best = [d for d in np.lexsort((np.arange(1000), -total)) if total[d] > 0][:10]
        places, score = group.best(np.array(terms), np.array(weights), 0.0, 10)
        assert group.ids[places].tolist() == best and score.tolist() == total[best].tolist()
    group.read = 0
    group.best(np.array([0, 1]), np.array([1.0, 1.0]), 0.0, 10)
    assert 0 < group.read < len(held) // 2


def test_postings_of_named_documents(spark, store):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, None), (4, "a c c c")], "doc_id long, text string")
    p = stats.plain_postings(docs, "text", store)
    wanted, only = (spark.createDataFrame([(x,) for x in values], kind) for values, kind in ((["a", "c", "z"], "term string"), ([2, 4, 9], "doc_id long")))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(search.postings_of(p, wanted)) == [(1, "a", 2, 3.0), (2, "c", 1, 2.0), (4, "a", 1, 4.0), (4, "c", 3, 4.0)]
    assert rows(search.postings_of(p, wanted, only)) == [(2, "c", 1, 2.0), (4, "a", 1, 4.0), (4, "c", 3, 4.0)]
    assert rows(p.frequencies) == [("a", 2, 3), ("b", 2, 2), ("c", 2, 4)] and rows(p.docs) == [(1, 3), (2, 2), (3, 0), (4, 4)]


def test_an_index_is_built_once_and_again_for_other_files(spark, store, tmp_path):
    docs = str(tmp_path / "docs")
    spark.createDataFrame([(1, "a b"), (2, "b")], "doc_id long, text string").write.parquet(docs)
    p = stats.plain_postings(spark.read.parquet(docs), "text", store)
    assert stats.plain_postings(spark.read.parquet(docs), "text", store).key == p.key
    spark.createDataFrame([(1, "a b"), (2, "b"), (3, "c")], "doc_id long, text string").write.mode("overwrite").parquet(docs)
    assert stats.plain_postings(spark.read.parquet(docs), "text", store).n == 3
    empty = stats.plain_postings(spark.createDataFrame([], "doc_id long, text string"), "text", store)
    assert empty.n == 0 and rank.bm25(empty, spark.createDataFrame([(1, "a")], "query_id long, query string"), 3).count() == 0


def test_of_two_writers_one_wins_and_both_read_the_same(spark, store):
    made, found = [], []

    def make():
        made.append(1)
        return spark.range(50)

    def build():
        found.append(store.build("key", make).count())

    writers = [threading.Thread(target=build) for _ in range(2)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert found == [50, 50] and store.build("key", make).count() == 50 and len(made) <= 2
    path, fs = store._path("aside")
    assert len(fs.listStatus(path)) == 0


def test_an_interrupted_write_leaves_nothing_and_a_broken_table_is_made_again(spark, store, tmp_path):
    def stopped():
        raise OSError("stopped")

    with pytest.raises(OSError, match="stopped"):
        store.build("key", lambda: spark.range(3), lambda written: stopped())
    assert store.manifest("key") is None and store.read("key") is None
    assert store.build("key", lambda: spark.range(3)).count() == 3
    data = sorted((tmp_path / "store" / "key" / "data").glob("*.parquet"))[0]
    data.write_bytes(data.read_bytes()[:10])
    assert store.manifest("key") is None
    assert store.build("key", lambda: spark.range(4)).count() == 4
    (tmp_path / "store" / "key" / "manifest.json").write_text("{")
    assert store.manifest("key") is None


def test_fingerprints_tell_files_and_rows_apart(spark, tmp_path):
    a, b = (spark.createDataFrame([(1, x)], "i long, t string") for x in "ab")
    assert fingerprint(a) != fingerprint(b) and fingerprint(a) == fingerprint(spark.createDataFrame([(1, "a")], "i long, t string"))
    a.write.parquet(str(tmp_path / "x"))
    x = spark.read.parquet(str(tmp_path / "x"))
    assert fingerprint(x) == fingerprint(spark.read.parquet(str(tmp_path / "x"))) != fingerprint(x.where("i > 1"))


def test_batches_are_sorted_by_length_and_order_is_restored():
    seen = []

    def model(texts):
        seen.append([len(t) for t in texts])
        return np.array([[len(t), 1.0] for t in texts])

    texts = ["aaa", "", "aaaaaaa", "a", "aaaaa"]
    found = encode.vectors_of(texts, model, 2, batch=2)
    assert seen == [[7, 5], [3, 1], [0]]
    assert np.allclose(found, [np.array([len(t), 1]) / math.hypot(len(t), 1) for t in texts])
    assert np.allclose(encode.unit(np.array([[0.0, 0.0], [1e-20, 0.0]])), [[0, 0], [1e-8, 0]])
    with pytest.raises(ValueError, match="width"):
        encode.vectors_of(texts, model, 3)


def test_encoders_by_name(spark):
    with pytest.raises(ValueError, match="no encoder"):
        encode.encoder("nothing")
    own = encode.register(encode.Encoder("test-lengths", 2, lambda: lambda texts: np.array([[len(t), 1.0] for t in texts])))
    assert encode.encoder("test-lengths") is own
    docs = spark.createDataFrame([(1, "abc"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.v for r in encode.encode(docs, "doc_id", "text", own).collect()}
    assert got[2] == [0.0, 1.0] and got[1] == pytest.approx([3 / math.sqrt(10), 1 / math.sqrt(10)])


def test_stored_vectors_answer_for_their_texts_only(spark, store):
    docs = spark.createDataFrame([(1, "big cat"), (2, "a dog")], "doc_id long, text string")
    key, n = encode.content_key(docs, "doc_id", "text", encode.HASHED.name, "text")
    first = encode.stored_vectors(docs, "text", store=store).collect()
    assert store.manifest(f"vectors-{key}")["rows"] == n == len(first) == 2
    other = spark.createDataFrame([(1, "big cat"), (2, "a cow")], "doc_id long, text string")
    assert encode.content_key(other, "doc_id", "text", encode.HASHED.name, "text")[0] != key
    path, fs = store._path(f"vectors-{key}", "manifest.json")
    facts = {**store.manifest(f"vectors-{key}"), "rows": 7}  # as if it were of other texts
    stream = fs.create(path, True)
    stream.write(bytearray(json.dumps(facts).encode()))
    stream.close()
    assert sorted(map(tuple, encode.stored_vectors(docs, "text", store=store).collect())) == sorted(map(tuple, first))
    assert store.manifest(f"vectors-{key}")["rows"] == 2


@pytest.mark.parametrize("exclude", [False, True])
def test_dense_search_over_several_blocks_of_both_sides(spark, monkeypatch, exclude):
    monkeypatch.setattr(rank, "BLOCK", 40)
    monkeypatch.setattr(rank, "ASKING", 7)
    rng = np.random.default_rng(5)
    x = rng.integers(-3, 4, (150, 4)).astype(float)  # with ties and zero vectors
    v = spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(x)], "doc_id long, v array<double>")
    asked = v.where("doc_id % 5 = 0").withColumnRenamed("doc_id", "query_id")
    got = rank.dense(v, asked, 6, exclude_self=exclude).orderBy("query_id", "rank").collect()
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    for q in range(0, 150, 5):
        scores = np.round(unit @ unit[q], 6) + 0.0
        best = [d for d in np.lexsort((np.arange(150), -scores)) if not (exclude and d == q)][:6]
        assert [(r.doc_id, r.score) for r in got if r.query_id == q] == [(d, scores[d]) for d in best]
    with pytest.raises(Exception, match="one width"):
        rank.dense(v.unionByName(spark.createDataFrame([(999, [1.0])], "doc_id long, v array<double>")), asked, 3).collect()


def test_what_leaves_a_search_does_not_grow_with_blocks(spark, store, monkeypatch):
    monkeypatch.setattr(stats, "BLOCK", 4)
    monkeypatch.setattr(search, "GROUP", 1)
    docs = spark.createDataFrame([(k, "w " * (1 + k % 7) + f"x{k}") for k in range(2000)], "doc_id long, text string")
    p = stats.plain_postings(docs, "text", store)
    asked = spark.createDataFrame([(q, "w", 1.0, 0.0) for q in range(3)], "query_id long, term string, weight double, value double")
    found = search.search(p, asked, 2, search.Scheme(lambda tf, side: tf / side))
    assert p.n_blocks >= 400 and 6 <= found.count() <= 3 * 2 * spark.sparkContext.defaultParallelism
    assert "Exchange" not in found._jdf.queryExecution().toString()


def test_parts_of_hits_are_those_of_their_own_queries(spark, store):
    docs = spark.createDataFrame([(d, "a b c" if d % 2 else "a c d") for d in range(20)] + [(100 + d, f"z{d}") for d in range(40)], "doc_id long, text string")
    p = stats.plain_postings(docs, "text", store)
    queries = spark.createDataFrame([(q, "a b") for q in range(5)], "query_id long, query string")
    hits = spark.createDataFrame([(0, 1), (1, 1), (2, 4)], "query_id long, doc_id long")
    got = sorted((r.query_id, r.doc_id, r.term) for r in rank.bm25_parts(p, queries, only=hits).collect())
    assert got == [(0, 1, "a"), (0, 1, "b"), (1, 1, "a"), (1, 1, "b"), (2, 4, "a")]


def test_texts_of_markup_go_to_workers_in_small_batches(spark):
    from querent.functions import markup

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(name)
    try:
        spark.conf.set(name, "64m")  # Spark's default
        markup.plain_text(F.lit("x"))
        assert spark.conf.get(name) == "8m"
    finally:
        spark.conf.set(name, held)


def test_long_rows_of_an_index_are_not_read_thousands_at_once(spark, store):
    p = stats.plain_postings(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), "text", store)
    plan = p.blocks._jdf.queryExecution().executedPlan().toString()
    assert "Batched: false" in plan


def plain_grams(text):
    words = [w for w in re.findall(r"[^\W]{2,}", text.lower()) if w not in STOP_WORDS]
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def gram_corpus():
    return corpus(300, words=40) + [(1000, None), (1001, ""), (1002, "w1"), (1003, "Straße straße w1 the w2"), (1004, "w1 w1 w1 w1")] + [(2000 + k, "w30 w31 w30 w31") for k in range(20)]


@pytest.mark.parametrize("early", [2, 1000])
def test_frequent_grams_are_those_of_counting_all(spark, store, monkeypatch, early):
    monkeypatch.setattr(stats, "BLOCK", 16)
    monkeypatch.setattr(stats, "EARLY", early)
    docs = gram_corpus()
    bags = [Counter(plain_grams(t or "")) for _, t in docs]
    df, cf = Counter(t for b in bags for t in b), sum(bags, Counter())
    p = stats.gram_postings(spark.createDataFrame(docs, "doc_id long, text string"), "text", store=store)
    assert p.n == len(docs) and p.avgdl == pytest.approx(sum(cf.values()) / len(docs))
    assert {r.term: (r.df, r.cf) for r in p.frequencies.collect()} == {t: (df[t], cf[t]) for t in df}
    for binary, counts in ((True, df), (False, cf)):
        for some, most, least in ((10, 0.4, 1), (60, 0.1, 2), (100_000, 0.4, 1)):
            fit = sorted((-counts[t], t) for t in counts if least <= df[t] <= most * len(docs))[:some]
            got = stats.vocabulary(p, binary, most, least, some).collect()
            assert sorted((-(r.df if binary else r.cf), r.term) for r in got) == fit


def test_postings_of_grams_equal_those_of_the_inverted_index(spark, store, monkeypatch):
    monkeypatch.setattr(stats, "BLOCK", 16)
    docs = spark.createDataFrame(gram_corpus(), "doc_id long, text string")
    grams = stats.gram_postings(docs, "text", store=store)
    inverted = stats.postings(docs, text.ngrams(F.col("text")), "inverted", store)
    wanted = spark.createDataFrame([(t,) for t in ("w1", "w2", "w1 w2", "w30 w31", "straße", "w1 w1", "none", "a b c", "")], "term string")
    rows = lambda p, only=None, sides=None: sorted(map(tuple, search.postings_of(p, wanted, only, sides).collect()))
    weights = spark.createDataFrame([("w1", 2.0), ("w2", 0.5), ("w3 w1", 1.5)], "term string, weight double")
    assert rows(grams) == rows(inverted) != []
    few = spark.createDataFrame([(k,) for k in (1, 5, 1002, 1003, 2004)], "doc_id long")
    assert rows(grams, few) == rows(inverted, few) != []
    for squares in (True, False):
        sides = search.Sides.of(weights, squares)
        assert [(*r[:3], pytest.approx(r[3])) for r in rows(inverted, sides=sides)] == rows(grams, sides=sides)
    queries = spark.createDataFrame([(1, "w1 w2 w3"), (2, "w30 w31"), (3, "none")], "query_id long, query string")
    for ranker in (rank.tfidf, rank.jaccard):
        assert sorted(map(tuple, ranker(grams, queries, 10).collect())) == sorted(map(tuple, ranker(inverted, queries, 10).collect()))


def test_fields_are_made_of_texts_that_are_kept_once(spark, tmp_path):
    rows = [(k, f"title {k}\n" + "".join(np.random.default_rng(k).choice(list("abcdefghij "), 2000)), "de", "web") for k in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, k % 2, 1) for k in range(0, 300, 2)] + [(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "abc title")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    e = systems.engine(spark, str(tmp_path))
    size = lambda names: sum(os.path.getsize(n.removeprefix("file:")) for n in names)
    assert size(e.catalog.inputFiles()) < 1.2 * size(spark.read.parquet(f"{tmp_path}/documents.parquet").inputFiles())
    got = {r.doc_id: r for r in e.catalog.collect()}
    assert len(got) == 300 and got[1].plot == "toxic 0" and got[2].plot == "" and got[1].title_text == "title 1"
    assert got[1].text_plot == got[1].text + " toxic 0" and got[1].text_meta == got[1].text + " web de" and got[2].text_plot == got[2].text


def test_what_is_stored_for_grams_is_smaller_than_the_texts(spark, tmp_path):
    store, rng = Store(spark, str(tmp_path / "store")), np.random.default_rng(5)
    docs = [(k, " ".join(f"word{x}" for x in rng.zipf(1.3, 300) % 3000)) for k in range(600)]
    p = stats.gram_postings(spark.createDataFrame(docs, "doc_id long, text string"), "text", store=store)
    stats.vocabulary(p, False, max_features=100)
    assert store.manifest(p.key)["bytes"] < 0.5 * sum(len(t) for _, t in docs)


def test_an_index_goes_when_its_systems_are_ranked(spark, store, monkeypatch):
    docs = [(k, str(k), f"t{k}", t or "x", "tag") for k, t in corpus(60)]
    catalog = fields.text_fields(spark.createDataFrame(docs, "doc_id long, show_id string, title string, description string, listed_in string"))
    queries = spark.createDataFrame([(1, "w1 w2"), (2, "w3 t5")], "query_id long, query string")
    names = ("boolean", "tf-idf", "bm25(desc+meta)", "dense+rerank", "hybrid(tfidf+dense)")
    own, made, build = Store(spark, f"{store.root}-2"), [], stats.postings
    monkeypatch.setattr(stats, "postings", lambda *a, **b: made.append(a[2]) or build(*a, **b))
    got = systems.Engine(catalog, own).rank_all(names, queries, 5)
    assert len(made) == 3  # two systems read the one of grams
    tables = [json.loads(open(f).read())["schema"]["fields"] for f in glob.glob(f"{own.root}/**/manifest.json", recursive=True)]
    assert tables and all([f["name"] for f in t] == ["query_id", "doc_id", "score", "rank"] for t in tables)
    e = systems.Engine(catalog, store)
    for name in names:
        assert sorted(map(tuple, got[name].collect())) == sorted(map(tuple, e.rank(name, queries, 5).collect())) != []
    with pytest.raises(ValueError), own.scratch() as inner:
        inner.build("key", lambda: spark.range(5))
        raise ValueError
    assert not glob.glob(f"{own.root}/aside/scratch-*")
