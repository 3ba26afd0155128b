import html
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from querent.functions import text
from querent.operators import explain, metrics, protocol, rank, signif, stats
from querent.plans import catalogue, inputs

DOCS = [(0, "space war in space"), (1, "cooking show with pasta"), (2, "war drama and cooking"), (3, "")]


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    return docs, stats.plain_postings(docs, "text")


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).orderBy("query_id", "rank").collect()]


def test_bm25_order_zero_rows_and_empty_query(spark, corpus):
    _, p = corpus
    got = rows(rank.bm25(p, asked(spark, "space pasta", "!!!", "absent"), 3), "query_id", "doc_id")
    assert got[:2] == [(0, 0), (0, 1)] and [q for q, _ in got].count(1) == 0
    assert [d for q, d in got if q == 2] == [0, 1, 2]
    assert rank.bm25(p, asked(spark, "space"), 3, drop_zero=True).count() == 1


def test_bounds():
    assert rank.bounded_top_k(5, 3) == 3
    for k, n in ((0, 3), (-1, 3), (1, -1)):
        with pytest.raises(ValueError):
            rank.bounded_top_k(k, n)


def test_contributions_sum_to_scores_and_repeats_double(spark, corpus):
    _, p = corpus
    q = asked(spark, "pasta show", "pasta pasta show")
    parts = {(r.query_id, r.term): r.part for r in rank.bm25_parts(p, q).where("doc_id = 1").collect()}
    score = {r.query_id: r.score for r in rank.bm25(p, q, 1).collect()}
    assert parts[1, "pasta"] == pytest.approx(2 * parts[0, "pasta"])
    assert score[0] == pytest.approx(parts[0, "pasta"] + parts[0, "show"], abs=1e-6)


def test_tfidf_self_match_is_one_and_jaccard(spark):
    docs = spark.createDataFrame([(0, "alpha beta gamma"), (1, "delta epsilon"), (2, "zeta eta"), (3, "theta iota")], "doc_id long, text string")
    p = stats.gram_postings(docs, "text")
    assert rows(rank.tfidf(p, asked(spark, "alpha beta gamma"), 1), "doc_id", "score") == [(0, 1.0)]
    # alpha, beta and their pair of the document's five terms
    assert rows(rank.jaccard(p, asked(spark, "alpha beta"), 1), "doc_id", "score") == [(0, 0.6)]


def test_fusion_sums_ranks_and_breaks_ties_by_list(spark):
    make = lambda ids: spark.createDataFrame([(0, d, float(-n), n + 1) for n, d in enumerate(ids)], "query_id long, doc_id long, score double, rank long")
    got = {d: s for d, s in rows(rank.rrf([make([0, 1]), make([1, 2])], 10), "doc_id", "score")}
    assert got[1] == pytest.approx(1 / 62 + 1 / 61) and got[0] == pytest.approx(1 / 61)
    assert rows(rank.rrf([make([5, 1]), make([3, 1])], 3), "doc_id") == [(1,), (5,), (3,)]
    with pytest.raises(ValueError):
        rank.rrf([], 3)


def test_rerank_takes_a_scorer_and_keeps_depth(spark, corpus):
    docs, p = corpus
    base = rank.bm25(p, asked(spark, "drama"), 4)
    got = rank.rerank(base, asked(spark, "drama"), docs, k=10, depth=2, scorer=lambda q, t: F.length(t).cast("double"))
    assert rows(got, "doc_id") == [(2,), (0,)]


def test_dense_skips_zero_vectors_and_self(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 0.0])], "doc_id long, v array<double>")
    got = rows(rank.dense(v, v.withColumnRenamed("doc_id", "query_id").where("query_id = 0"), 2, exclude_self=True), "doc_id", "score")
    assert got == [(1, 0.707107), (2, 0.0)]


def run_of(spark, ids, method="m"):
    return spark.createDataFrame([(method, 0, d, n + 1) for n, d in enumerate(ids)], "method string, query_id long, doc_id long, rank long")


def test_binary_and_graded_metrics(spark):
    q = asked(spark, "x", "y")
    rel = spark.createDataFrame([(0, 1), (0, 7)], "query_id long, doc_id long")
    got = {r.query_id: r for r in metrics.binary_metrics(run_of(spark, [5, 1, 9]), rel, q, (2, 5)).collect()}
    assert got[0].recall_2 == 0.5 and got[0].mrr == 0.5 and got[1].recall_2 is None
    assert got[0].ndcg_5 == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)))
    judged = spark.createDataFrame([(0, 1, 2), (1, 4, 0)], "query_id long, doc_id long, grade long")
    full = {r.query_id: r.ndcg for r in metrics.graded_ndcg(run_of(spark, [5, 1]), judged, q).collect()}
    only = {r.query_id: r.ndcg for r in metrics.graded_ndcg(run_of(spark, [5, 1]), judged, q, judged_only=True).collect()}
    assert full[0] < 1 and only[0] == 1 and full[1] is None


def test_gains(spark):
    got = spark.range(4).select(metrics.gain(F.col("id"))).collect()
    assert [r[0] for r in got] == [0, 1, 3, 7]


def diffs(spark, *values):
    return spark.createDataFrame([("m", n, float(v)) for n, v in enumerate(values)], "method string, query_id long, diff double")


def test_sign_test_and_bootstrap(spark):
    p = lambda *v: signif.sign_test(diffs(spark, *v)).first().p
    assert p(*[1] * 8, *[-1] * 2) == pytest.approx(112 / 1024)
    assert p(1, -1, 0, 0) == 1 and p(0, 0) is None
    got = signif.bootstrap(diffs(spark, 0.2, 0.2, 0.2), 500).first()
    assert got.lo == got.hi == pytest.approx(0.2)
    a, b = (signif.bootstrap(diffs(spark, 0.1, 0.5, -0.2), 500, seed=7).first() for _ in range(2))
    assert (a.lo, a.hi) == (b.lo, b.hi) and a.lo <= a["mean"] <= a.hi


def test_bootstrap_equals_plain_numpy(spark):
    """Means of resampled queries, one resample a time, from one generator; 1,500 need two blocks of draws."""
    x = np.random.default_rng(2).normal(0.1, 1, 23)
    got = signif.bootstrap(diffs(spark, *x), 1500, seed=11, level=0.9).first()
    draws = np.random.default_rng(11).integers(0, 23, (1500, 23))
    means = sorted(sum(x[k] for k in draw) / 23 for draw in draws)

    def quantile(share: float) -> float:
        at = share * 1499
        low = math.floor(at)
        return means[low] + (at - low) * (means[min(low + 1, 1499)] - means[low])

    assert (got.n, got.lo, got.hi) == (23, pytest.approx(quantile(0.05)), pytest.approx(quantile(0.95)))
    assert got["mean"] == pytest.approx(sum(x) / 23)


@pytest.mark.parametrize("n", [1, 2, 7, 40, 1000, 2**31 + 1, 3 * 2**30])
def test_draws_are_those_of_numpy_from_any_word_on(n):
    """Under 2 ** 31 + 1 nearly half of the words are passed over."""
    want = np.random.default_rng(13).integers(0, n, 5000)
    for at in (0, 1, 4, 1001):
        lost = signif.rejected(13, n, 0, at) if n > 1 else 0
        got = np.concatenate(list(signif.draws(13, n, at, lost, 3000)))
        assert (got == want[at : at + 3000]).all()


def test_bootstrap_is_the_same_in_any_number_of_parts(spark):
    rng = np.random.default_rng(4)
    rows = [(m, q, float(x)) for m, n in (("a", 23), ("b", 40), ("c", 1)) for q, x in enumerate(rng.normal(0.1, 1, n))]
    frame = spark.createDataFrame(rows, "method string, query_id long, diff double")
    want = sorted(map(tuple, signif.bootstrap(frame, 700, seed=9).collect()))
    assert sorted(map(tuple, signif.bootstrap(frame, 700, seed=9, part=1000).collect())) == want
    x = np.array([d for m, _, d in rows if m == "a"])
    means = x[np.random.default_rng(9).integers(0, 23, (700, 23))].mean(axis=1)
    assert want[0] == ("a", 23, x.mean(), *np.quantile(means, [(1 - 0.95) / 2, (1 + 0.95) / 2]))


def test_compared_systems_leave_out_undefined_queries(spark):
    rows = [("base", 0, 0.5), ("base", 1, 0.2), ("base", 2, None), ("base", 3, 0.1), ("m", 0, 0.7), ("m", 1, 0.2), ("m", 2, 0.9), ("m", 3, float("nan"))]
    got = signif.compared(spark.createDataFrame(rows, "method string, query_id long, ndcg double"), "base", "ndcg", 50).collect()
    assert [(r["method"], r.baseline, r.n, r.wins, r.losses, r.ties, r.p) for r in got] == [("m", "base", 2, 1, 0, 1, 1.0)]


def test_equal_rankings_are_ties_in_any_order_of_rows(spark):
    grades = [3, 1, 2, 3, 1, 1, 2, 3, 1, 2]
    judged = spark.createDataFrame([(0, 100 * m + r, g) for m in range(2) for r, g in enumerate(grades, 1)], "query_id long, doc_id long, grade long")
    places = {0: range(1, 11), 1: [7, 2, 9, 4, 10, 1, 8, 3, 6, 5]}  # the same grades at the same ranks, read in two orders
    run = spark.createDataFrame([(f"m{m}", 0, 100 * m + r, r) for m, order in places.items() for r in order], "method string, query_id long, doc_id long, rank long").coalesce(1)
    queries = spark.createDataFrame([(0,)], "query_id long")
    for scores in (metrics.graded_ndcg(run, judged, queries), metrics.binary_metrics(run, judged.where("grade >= 2"), queries)):
        column = "ndcg" if "ndcg" in scores.columns else "ndcg_10"
        assert signif.sign_test(signif.paired(scores, "m0", column)).select("wins", "losses", "ties").collect() == [(0, 0, 1)]


def test_the_sign_test_of_many_queries_is_exact(spark):
    diffs = spark.createDataFrame([("m", q, 1.0 if q % 20 < 9 else -1.0) for q in range(2000)], "method string, query_id long, diff double")
    want = 2 * sum(math.comb(2000, i) for i in range(901)) / 2**2000
    assert signif.sign_test(diffs).first().p == pytest.approx(want, rel=1e-9)


def test_grades_that_queries_share_count_as_pairs_do(spark):
    rng = np.random.default_rng(4)
    grades = spark.createDataFrame([(d % 2, d, int(rng.integers(0, 4))) for d in range(40)], "topic long, doc_id long, grade long")
    topics = spark.createDataFrame([(q, q % 3) for q in range(9)], "query_id long, topic long")  # the third has no grade
    shared, queries = metrics.Judgments(grades, topics), topics.select("query_id")
    run = spark.createDataFrame([("m", q, int(d), r) for q in range(9) for r, d in enumerate(rng.choice(60, 12, replace=False), 1)], "method string, query_id long, doc_id long, rank long")
    rows = lambda df: sorted(map(str, df.collect()))
    pairs = shared.pairs().select("query_id", "doc_id", "grade")
    for own in (metrics.query_scores, lambda *a: metrics.graded_ndcg(*a, judged_only=True), lambda a, b, c: metrics.unjudged_slots(a, b)):
        assert rows(own(run, shared, queries)) == rows(own(run, pairs, queries))


def plain_draw(rows, fraction, least, seed):
    rng, chosen = np.random.default_rng(seed), []
    for stratum in sorted({s for *_, s in rows}):
        own = sorted(r for r in rows if r[2] == stratum)
        chosen += [own[k] for k in rng.choice(len(own), size=min(max(round(fraction * len(own)), least), len(own)), replace=False)]
    return [(*chosen[k], place) for place, k in enumerate(rng.permutation(len(chosen)), 1)]


def test_drawn_sample_is_that_of_one_generator(spark):
    rows = [(q, d, int((q * d) % 5 == 0)) for q in range(9) for d in range(25)] + [(99, 1, 2)]
    frame = spark.createDataFrame(rows, "query_id long, doc_id long, stratum int").repartition(3)
    got = sorted(map(tuple, protocol.drawn_sample(frame, ["query_id", "doc_id"], 0.1, 2, 77).collect()), key=lambda r: r[3])
    assert got == plain_draw(rows, 0.1, 2, 77)
    assert protocol.same_sample(frame, frame.orderBy("doc_id")) and not protocol.same_sample(frame, frame.limit(5))


def test_a_large_drawn_sample_is_made_in_tasks(spark, monkeypatch):
    monkeypatch.setattr(protocol, "DRAWN", 5000)  # fewer than there are rows
    monkeypatch.setattr(protocol, "DRAWS", 700)
    rows = [(q, d, 2 if q == 7 and d < 30 else int(d % 4 == 0)) for q in range(60) for d in range(300)]
    frame = spark.createDataFrame(rows, "query_id long, doc_id long, stratum int").repartition(3)
    for fraction in (0.1, 1.0):
        got = sorted(map(tuple, protocol.drawn_sample(frame, ["query_id", "doc_id"], fraction, 2, 77).collect()), key=lambda r: r[3])
        assert got == plain_draw(rows, fraction, 2, 77)


def test_stratified_sample_takes_the_least_hashes(spark, monkeypatch):
    import hashlib

    monkeypatch.setattr(protocol, "BIN", 2)  # bins are counted by more digits, again and again
    monkeypatch.setattr(protocol, "DIGITS", 1)
    rows = [(q, d, q % 3) for q in range(12) for d in range(60)]
    got = protocol.stratified_sample(spark.createDataFrame(rows, "query_id long, doc_id long, stratum int"), 0.07, 1, 5).collect()
    want = []
    for stratum in range(3):
        own = sorted((hashlib.md5(f"5:{q}:{d}".encode()).hexdigest(), q, d) for q, d, s in rows if s == stratum)
        want += [(q, d, stratum) for _, q, d in own[: round(0.07 * len(own))]]
    assert sorted(map(tuple, got)) == sorted(want)


def test_blinding_takes_one_permutation_a_query_from_one_generator(spark):
    pool = [(q, 100 * q + d, d + 1) for q in (3, 1, 2) for d in range(4 + q)]
    frame = spark.createDataFrame(pool, "query_id long, doc_id long, position long").repartition(3)
    got = sorted(map(tuple, protocol.blind_exact(frame, seed=5).collect()))
    rng, want = np.random.default_rng(5), []
    for q in (1, 2, 3):
        ids = [d for p, d, _ in pool if p == q]
        want += [(q, ids[at], n + 1) for n, at in enumerate(rng.permutation(len(ids)))]
    assert got == sorted(want)


def test_results_are_explained_by_kind(spark, corpus):
    docs, postings = corpus
    q = asked(spark, "drama and", "zebra")
    hits = rank.bm25(postings, q, 3)
    said = {(r.query_id, r.doc_id): r.said for r in explain.said_of_terms(hits, rank.bm25_parts(postings, q), "bm25").collect()}
    assert said[0, 2] == "2 shared terms: and, drama" and said[1, 0] == "no shared terms" and len(said) == hits.count()
    other = hits.where("doc_id = 2")
    fused = {(r.query_id, r.doc_id): r.said for r in explain.said_of_sources(hits, {"a": hits, "b": other}, 5).collect()}
    assert fused[0, 2] == "a rank 1, b rank 1" and fused[1, 0] == "a rank 1, b outside top 5"
    assert {r.said for r in explain.said_of_movement(hits, hits).collect()} == {f"stays at {n}" for n in (1, 2, 3)}
    assert explain.said_of_scores(hits.withColumn("score", F.lit(0.51249))).first().said == "cosine 0.512"


def test_kappas(spark):
    make = lambda a, b: spark.createDataFrame(list(zip(a, b)), "a long, b long")
    assert signif.kappas(make([0, 3], [1, 2])).first().quadratic_kappa == pytest.approx(0.6)
    assert signif.kappas(make([0, 3], [3, 0])).first().binary_kappa == pytest.approx(-1)
    assert signif.kappas(make([1, 1], [1, 1])).first().quadratic_kappa is None


def test_pool_order_and_alignment(spark):
    runs = run_of(spark, [3, 1], "a").unionByName(run_of(spark, [1, 2], "b"))
    got = protocol.pool(runs, ["b", "a"]).orderBy("position").collect()
    assert [r.doc_id for r in got] == [1, 2, 3]
    one = spark.createDataFrame([(0, 1, 2)], "query_id long, doc_id long, grade long")
    other = spark.createDataFrame([(0, 9, 2)], "query_id long, doc_id long, grade long")
    assert protocol.aligned(one, one).count() == 1
    with pytest.raises(ValueError):
        protocol.aligned(one, other)


def test_movement_and_names(spark):
    make = lambda ids: run_of(spark, ids).drop("method")
    got = {r.doc_id: (r.moved, r.said) for r in explain.movement(make([2, 1, 9]), make([1, 2])).collect()}
    assert got == {2: (1, "up 1 to 1"), 1: (-1, "down 1 to 2"), 9: (None, "not in the first stage")}
    assert explain.source_names(["bm25", "dense", "bm25"]) == ["bm25 1", "dense", "bm25 2"]


def test_system_wiring():
    from querent.plans.systems import SYSTEMS, resolve

    assert len(SYSTEMS) == 15 and SYSTEMS["hybrid+rerank"].parts == ("hybrid(bm25+dense,meta)",)
    assert resolve("HYBRID_rerank") == "hybrid+rerank" and resolve("bow") == "boolean"
    with pytest.raises(ValueError):
        resolve("nothing")


def plain_highlight(raw, query):
    words = sorted({w for w in query.lower().split() if len(w) >= 2 and w.isalnum()}, key=len, reverse=True)
    if not words:
        return html.escape(raw)
    found = re.split(r"\b(" + "|".join(map(re.escape, words)) + r")\b", raw, flags=re.IGNORECASE)
    return "".join(f"<mark>{html.escape(x)}</mark>" if k % 2 else html.escape(x) for k, x in enumerate(found))


def test_highlighted_marks_each_querys_own_tokens_in_all_hits(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in inputs.table(spark, sf, "documents").collect()}
    queries = {r.query_id: r.query for r in inputs.queries(spark, sf).collect()}
    hits = [(r.query_id, r.doc_id) for r in inputs.ranking(spark, sf, "bm25").collect()]
    got = {(r.query_id, r.doc_id): r.html for r in catalogue.QUERIES["highlighted"](spark, sf).collect()}
    assert got == {(q, d): plain_highlight(texts[d], queries[q]) for q, d in hits}
    assert len(hits) > len(queries) and sum("<mark>" in x for x in got.values()) > len(queries)


def test_highlight_of_odd_queries(spark):
    odd = [("Cat & concat <cat> _cat Ärger", "a cat amp CAT x&y ärger"), ("a & b", "a ! b"), ("quot lt", "lt quot")]
    df = spark.createDataFrame(odd, "t string, q string")
    assert [r.h for r in df.select(text.highlight_query(F.col("t"), F.col("q")).alias("h")).collect()] == [plain_highlight(*x) for x in odd]
