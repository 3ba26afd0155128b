"""Every registered query with the SQL that gives the same rows; a query without SQL is tested by hand-made cases."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querent.functions import markup, text
from querent.operators import encode, explain, fields, linkage, metrics, protocol, rank, signif, stats
from querent.plans import inputs as i
from querent.plans import systems
from querent.sources.keyed import Keyed, enrich
from querent.sources.store import Store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = i.sql(oracle)
        return f

    return add


def _ranked(name: str, k: int = 10):
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return i.ranking(spark, sf_dir, name, k)

    f.__name__ = f"{name}_top{k}"
    query(f"select query_id, doc_id, score, rank from {name} where rank <= {k}")(f)


for _name in ("bm25", "tfidf", "jaccard", "hashed", "hybrid", "rerank"):
    _ranked(_name)


@query(
    """select query_id, doc_id, score, rank from (select *, cast(row_number() over (partition by query_id order by score desc, doc_id) as bigint) as rank from (
select q.vec_id as query_id, d.vec_id as doc_id, round(list_cosine_similarity(cast(q.embedding as double[]), cast(d.embedding as double[])), 6) + 0.0 as score
from (select * from embeddings where vec_id % 100 = 0) q cross join embeddings d where q.vec_id <> d.vec_id)) where rank <= 10"""
)
def dense_top10(spark, sf_dir):
    """Exact cosine; queries are the vectors whose id is divisible by 100."""
    v = i.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return rank.dense(v, v.where("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id"), 10, exclude_self=True)


@query(
    """select query_id, doc_id, score, rank from (select query_id, doc_id, score, cast(row_number() over (partition by query_id order by score desc, first, doc_id) as bigint) as rank from (
select query_id, doc_id, round(sum(1.0 / (60 + rank)), 10) as score, min(l * 1000 + rank) as first from (select 0 as l, query_id, doc_id, rank from bm25 union all select 1, query_id, doc_id, rank from tfidf union all select 2, query_id, doc_id, rank from hashed) group by query_id, doc_id)) where rank <= 10"""
)
def rrf_three_lists(spark, sf_dir):
    return rank.rrf([i.ranking(spark, sf_dir, n, 100) for n in ("bm25", "tfidf", "hashed")], 10)


@query()
def all_systems(spark, sf_dir):
    """The fifteen named systems over the catalog's text fields: method, query_id, doc_id, score, rank."""
    return systems.run_all(spark, sf_dir, 10)


@query("select doc_id, show_id, title as title_text, trim(concat_ws(' ', title, description), chr(32) || chr(9) || chr(10) || chr(13)) as text, trim(concat_ws(' ', title, description, nullif(listed_in, ''), nullif(country, '')), chr(32) || chr(9) || chr(10) || chr(13)) as text_meta from (select doc_id, show_id, trim(title, chr(32) || chr(9) || chr(13)) as title, trim(description, chr(32) || chr(9) || chr(10) || chr(13)) as description, listed_in, country from cat)")
def text_fields(spark, sf_dir):
    return fields.text_fields(i.catalog(spark, sf_dir)).select("doc_id", "show_id", "title_text", "text", "text_meta")


@query("select c.show_id, case when l.doc_id is null then '' when l.quality = 1 then 'matched' else 'no_plot' end as status, case when l.quality = 1 then 'toxic ' || l.toxic else '' end as plot from cat c left join labels l using (doc_id)")
def catalog_left_join(spark, sf_dir):
    """Catalog rows with the side table of plots; rows without one have empty fields."""
    side = i.table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("show_id"), F.when(F.col("quality") == 1, "matched").otherwise("no_plot").alias("status"), F.when(F.col("quality") == 1, F.concat(F.lit("toxic "), F.col("toxic"))).otherwise("").alias("plot"))
    out = i.catalog(spark, sf_dir).select("show_id").join(side, "show_id", "left")
    return out.select("show_id", F.coalesce("status", F.lit("")).alias("status"), F.coalesce("plot", F.lit("")).alias("plot"))


@query("select b.item_id as query_id, cast(b.item_id * 37 as varchar) as show_id from benchmark b where not exists (select 1 from cat where cat.show_id = cast(b.item_id * 37 as varchar))")
def unknown_labels(spark, sf_dir):
    """Relevant ids that the catalog lacks."""
    labels = i.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") * 37).cast("string").alias("show_id"))
    return fields.validate_labels(labels, i.catalog(spark, sf_dir))


@query("select count(*) as n, sum(dl)::bigint as tokens, round(avg(dl), 6) as avgdl, (select count(distinct term) from tf) as terms from dl")
def corpus_stats(spark, sf_dir):
    p = i.plain(spark, sf_dir)
    return p.docs.agg(F.count("*").alias("n"), F.sum("dl").alias("tokens"), F.round(F.avg("dl"), 6).alias("avgdl")).crossJoin(F.broadcast(p.terms.agg(F.count("*").alias("terms"))))


@query("select term, df, round(idf, 6) as idf from idf")
def bm25_idf(spark, sf_dir):
    return rank.bm25_idf(i.plain(spark, sf_dir)).select("term", "df", F.round("idf", 6).alias("idf"))


@query("select term, df, cast(cf as bigint) as cf from gstats order by cf desc, term limit 10000")
def tfidf_vocabulary(spark, sf_dir):
    """The 10,000 most counted words and word pairs: the model's size, as the vectorizer defines it."""
    return i.vocabulary(spark, sf_dir, False).select("term", "df", F.col("cf").cast("long").alias("cf"))


@query("select query_id, method_no, doc_ids from (select query_id, cast(0 as int) as method_no, string_agg(cast(doc_id as varchar), ',' order by rank) as doc_ids from bm25 where rank <= 5 group by query_id union all select query_id, 1, string_agg(cast(doc_id as varchar), ',' order by rank) from tfidf where rank <= 5 group by query_id)")
def side_by_side(spark, sf_dir):
    """The top five of systems beside each other."""
    out = None
    for n, name in enumerate(("bm25", "tfidf")):
        own = i.ranking(spark, sf_dir, name, 5).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))).alias("x"))
        own = own.select("query_id", F.lit(n).alias("method_no"), F.array_join(F.transform("x", lambda s: s["doc_id"].cast("string")), ",").alias("doc_ids"))
        out = own if out is None else out.unionByName(own)
    return out


@query("select method, query_id, round(recall_5, 6) as recall_5, round(recall_10, 6) as recall_10, round(mrr, 6) as mrr, round(ndcg_10, 6) as ndcg_10 from scores")
def query_metrics(spark, sf_dir):
    return i.scores(spark, sf_dir).select("method", "query_id", *[F.round(c, 6).alias(c) for c in ("recall_5", "recall_10", "mrr", "ndcg_10")])


@query("select method, round(avg(recall_5), 4) as recall_5, round(avg(recall_10), 4) as recall_10, round(avg(mrr), 4) as mrr, round(avg(ndcg_10), 4) as ndcg_10, count(recall_5) as n_recall_5, count(ndcg_10) as n_ndcg_10 from scores group by method")
def mean_metrics(spark, sf_dir):
    return metrics.means(i.scores(spark, sf_dir)).select("method", "recall_5", "recall_10", "mrr", "ndcg_10", "n_recall_5", "n_ndcg_10")


@query("select method, case when query_id % 2 = 0 then 'dev' else 'test' end as split, round(avg(recall_5), 4) as recall_5, round(avg(ndcg_10), 4) as ndcg_10, count(ndcg_10) as n_ndcg_10 from scores group by all")
def split_metrics(spark, sf_dir):
    rows = i.scores(spark, sf_dir).withColumn("split", F.expr("case when query_id % 2 = 0 then 'dev' else 'test' end"))
    return metrics.means(rows, ("method", "split")).select("method", "split", "recall_5", "ndcg_10", "n_ndcg_10")


@query("select f.method, f.query_id, case when n > 0 then round((coalesce(d5, 0)) / (select sum(1 / log2(j + 1)) from (select unnest(range(1, 1 + least(n, 5))) as j)), 6) end as ndcg_5, case when n > 0 then round((coalesce(d10, 0)) / (select sum(1 / log2(j + 1)) from (select unnest(range(1, 1 + least(n, 10))) as j)), 6) end as ndcg_10 from frame f left join hits using (method, query_id)")
def binary_ndcg(spark, sf_dir):
    out = metrics.binary_metrics(i.run(spark, sf_dir), i.judgments(spark, sf_dir).where("grade >= 2"), i.queries(spark, sf_dir))
    return out.select("method", "query_id", F.round("ndcg_5", 6).alias("ndcg_5"), F.round("ndcg_10", 6).alias("ndcg_10"))


@query("select f.method, f.query_id, case when ideal > 0 then round(coalesce(d, 0) / ideal, 6) end as ndcg from frame f left join (select method, query_id, sum((pow(2, grade) - 1) / log2(r + 1)) as d from (select r.*, j.grade, row_number() over (partition by r.method, r.query_id order by r.rank) as r from run r join judged j using (query_id, doc_id)) group by all) using (method, query_id) left join ideal using (query_id)")
def condensed_ndcg(spark, sf_dir):
    out = metrics.graded_ndcg(i.run(spark, sf_dir), i.judgments(spark, sf_dir), i.queries(spark, sf_dir), judged_only=True)
    return out.select("method", "query_id", F.round("ndcg", 6).alias("ndcg"))


@query("select method, count(*) as slots, count(*) filter (grade is null) as unjudged from run left join judged using (query_id, doc_id) group by method")
def unjudged_slots(spark, sf_dir):
    return metrics.unjudged_slots(i.run(spark, sf_dir), i.judgments(spark, sf_dir))


@query("select g as grade, count(j.grade) as n from (select unnest(range(4)) as g) left join judged j on j.grade = g group by g")
def grade_histogram(spark, sf_dir):
    return metrics.grade_histogram(i.judged(spark, sf_dir))


_DIFFS = "select a.method, a.query_id, a.ndcg_10 - b.ndcg_10 as diff from scores a join scores b on a.query_id = b.query_id and b.method = 'bm25' where a.method <> 'bm25' and a.ndcg_10 is not null and b.ndcg_10 is not null"


def _diffs(spark, sf_dir):
    return signif.paired(i.scores(spark, sf_dir), "bm25", "ndcg_10")


@query(f"select method, query_id, round(diff, 6) as diff from ({_DIFFS})")
def paired_differences(spark, sf_dir):
    return _diffs(spark, sf_dir).select("method", "query_id", F.round("diff", 6).alias("diff"))


@query()
def paired_bootstrap(spark, sf_dir):
    return signif.bootstrap(_diffs(spark, sf_dir))


@query()
def compared_systems(spark, sf_dir):
    """Each system against BM25: mean difference, interval, wins, losses, ties and p in one table."""
    return signif.compared(i.scores(spark, sf_dir), "bm25", "ndcg_10")


@query("select 'constant' as method, count(*) as n, 0.25 as mean, 0.25 as lo, 0.25 as hi from queries")
def constant_bootstrap(spark, sf_dir):
    """A constant difference has a point as interval."""
    out = signif.bootstrap(i.queries(spark, sf_dir).select(F.lit("constant").alias("method"), "query_id", F.lit(0.25).alias("diff")))
    return out.select("method", "n", *[F.col(c).cast("decimal(3,2)").alias(c) for c in ("mean", "lo", "hi")])


@query(
    f"""select method, wins, losses, ties, case when wins + losses > 0 then round(least(1.0, 2 * (select sum(exp(lgamma(wins + losses + 1) - lgamma(j + 1) - lgamma(wins + losses - j + 1) - (wins + losses) * ln(2))) from (select unnest(range(0, least(wins, losses) + 1)) as j))), 6) end as p
from (select method, count(*) filter (diff > 0) as wins, count(*) filter (diff < 0) as losses, count(*) filter (diff = 0) as ties from ({_DIFFS}) group by method)"""
)
def sign_test(spark, sf_dir):
    return signif.sign_test(_diffs(spark, sf_dir)).withColumn("p", F.round("p", 6))


_PAIRS = "(select s.query_id, s.doc_id, j.grade as a, s.grade as b from second s join judged j using (query_id, doc_id))"
_KAPPA = """round(avg((a = b)::int), 6) as exact, round(avg(((a >= 2) = (b >= 2))::int), 6) as relevance,
case when avg(a * a) + avg(b * b) - 2 * avg(a) * avg(b) > 1e-12 then round(1 - avg((a - b) * (a - b)) / (avg(a * a) + avg(b * b) - 2 * avg(a) * avg(b)), 6) end as quadratic_kappa,
round((avg(((a >= 2) = (b >= 2))::int) - (avg((a >= 2)::int) * avg((b >= 2)::int) + (1 - avg((a >= 2)::int)) * (1 - avg((b >= 2)::int)))) / nullif(1 - (avg((a >= 2)::int) * avg((b >= 2)::int) + (1 - avg((a >= 2)::int)) * (1 - avg((b >= 2)::int))), 0), 6) as binary_kappa"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(f"select count(*) as n, {_KAPPA} from {_PAIRS}")
def judge_agreement(spark, sf_dir):
    return _rounded(signif.kappas(protocol.aligned(i.judged(spark, sf_dir), i.second(spark, sf_dir))))


@query(f"select method, count(*) as n, {_KAPPA} from {_PAIRS} join run using (query_id, doc_id) group by method")
def agreement_by_system(spark, sf_dir):
    pairs = protocol.aligned_topics(i.judgments(spark, sf_dir), i.second_judgments(spark, sf_dir))
    return _rounded(signif.kappas(pairs.joined(i.run(spark, sf_dir).select("method", "query_id", "doc_id")), ("method",)))


@query(f"select g as a, count(*) filter (b = 0) as b0, count(*) filter (b = 1) as b1, count(*) filter (b = 2) as b2, count(*) filter (b = 3) as b3 from (select unnest(range(4)) as g) left join {_PAIRS} p on p.a = g group by g")
def confusion_matrix(spark, sf_dir):
    return signif.confusion(protocol.aligned(i.judged(spark, sf_dir), i.second(spark, sf_dir)))


@query(f"select query_id, doc_id, a, b from {_PAIRS} where a <> b")
def judge_disagreements(spark, sf_dir):
    return signif.disagreements(protocol.aligned(i.judged(spark, sf_dir), i.second(spark, sf_dir)))


_CELLS = f"(select p.*, case when query_id % 2 = 0 then 'dev' else 'test' end as split from {_PAIRS} p)"


@query(
    f"""select 'all' as kind, null as split, null as grade, null as method, count(*) as n, {_KAPPA} from {_CELLS} union all select 'split', split, null, null, count(*), {_KAPPA} from {_CELLS} group by split
union all select 'grade', null, cast(a as varchar), null, count(*), {_KAPPA} from {_CELLS} group by a
union all select 'method', null, null, method, count(*), {_KAPPA} from {_CELLS} join run using (query_id, doc_id) group by method"""
)
def agreement_tables(spark, sf_dir):
    """Agreement of two judges over all pairs, by split, by first grade and by system, from one pass over the pairs."""
    split = F.expr("case when query_id % 2 = 0 then 'dev' else 'test' end")
    return _rounded(signif.agreement_tables(protocol.aligned(i.judged(spark, sf_dir), i.second(spark, sf_dir)), i.run(spark, sf_dir), split))


_OVER = "(select query_id, doc_id, coalesce(s.grade, j.grade) as grade from judged j left join second s using (query_id, doc_id))"


@query(
    f"""select method, round(avg(case when ideal > 0 then coalesce(d, 0) / ideal end), 4) as ndcg_10 from frame
left join (select method, query_id, sum((pow(2, grade) - 1) / log2(rank + 1)) as d from run join {_OVER} o using (query_id, doc_id) group by all) using (method, query_id)
left join (select query_id, sum((pow(2, grade) - 1) / log2(r + 1)) as ideal from (select *, row_number() over (partition by query_id order by grade desc, doc_id) as r from {_OVER} o) where r <= 10 group by all) using (query_id) group by method"""
)
def sensitivity(spark, sf_dir):
    """Frozen rankings scored again with the second judge's grades in place."""
    over = protocol.override(i.judged(spark, sf_dir), i.second(spark, sf_dir))
    return metrics.graded_ndcg(i.run(spark, sf_dir), over, i.queries(spark, sf_dir)).groupBy("method").agg(F.round(F.avg("ndcg"), 4).alias("ndcg_10"))


_POOL = "(select query_id, doc_id, cast(row_number() over (partition by query_id order by first, doc_id) as bigint) as position from (select query_id, doc_id, min(case method when 'bm25' then 0 when 'tfidf' then 1000 else 2000 end + rank) as first from run group by all))"


def _pool(spark, sf_dir):
    return protocol.pool(i.run(spark, sf_dir), list(i.SYSTEMS))


@query(f"select * from {_POOL}")
def pooled_candidates(spark, sf_dir):
    return _pool(spark, sf_dir)


@query(f"select count(*) as n_queries, sum(n)::bigint as n_slots, min(n) as least, max(n) as most from (select query_id, count(*) as n from {_POOL} group by all)")
def pool_statistics(spark, sf_dir):
    return protocol.pool_stats(_pool(spark, sf_dir))


@query(f"select query_id, doc_id, cast(row_number() over (partition by query_id order by md5('20260928:' || query_id || ':' || doc_id)) as bigint) as position from {_POOL}")
def blinded_pool(spark, sf_dir):
    return protocol.blind(_pool(spark, sf_dir))


@query()
def blinded_pool_numpy(spark, sf_dir):
    return protocol.blind_exact(_pool(spark, sf_dir))


@query("select query_id, doc_id, stratum from (select query_id, doc_id, case when grade >= 2 then 1 else 0 end as stratum, row_number() over (partition by case when grade >= 2 then 1 else 0 end order by md5('20260930:' || query_id || ':' || doc_id)) as r, count(*) over (partition by case when grade >= 2 then 1 else 0 end) as n from judged) where r <= least(greatest(round_even(n * 0.1, 0)::bigint, 1), n)")
def stratified_sample(spark, sf_dir):
    rows = i.judged(spark, sf_dir).select("query_id", "doc_id", F.when(F.col("grade") >= 2, 1).otherwise(0).alias("stratum"))
    return protocol.stratified_sample(rows)


@query()
def drawn_sample(spark, sf_dir):
    """The same strata drawn and shuffled by one generator, in the order of query and document."""
    rows = i.judged(spark, sf_dir).select("query_id", "doc_id", F.when(F.col("grade") >= 2, 1).otherwise(0).alias("stratum"))
    return protocol.drawn_sample(rows, ["query_id", "doc_id"])


@query("select query_id, doc_id from second where grade >= 2 except select query_id, doc_id from judged where grade >= 2")
def newly_relevant(spark, sf_dir):
    return protocol.newly_relevant(i.second(spark, sf_dir), i.judged(spark, sf_dir).where("grade >= 2").select("query_id", "doc_id"))


@query("select method, cast(row_number() over (order by is_new, place) as bigint) as place, n from (select coalesce(b.method, a.method) as method, a.method is null as is_new, coalesce(a.place, b.place) as place, coalesce(b.n, a.n) as n from (select source as method, row_number() over (order by source) as place, count(*) as n from documents where doc_id % 2 = 0 group by source) a full join (select source as method, row_number() over (order by source) as place, count(*) + 1 as n from documents where doc_id % 3 = 0 group by source) b on a.method = b.method)")
def merged_metrics(spark, sf_dir):
    """Upsert of a metrics table by method."""
    d = i.table(spark, sf_dir, "documents")
    side = lambda m, plus: d.where(f"doc_id % {m} = 0").groupBy(F.col("source").alias("method")).agg((F.count("*") + plus).alias("n")).withColumn("place", F.row_number().over(W.orderBy("method")))
    return protocol.merge_metrics(side(2, 0), side(3, 1))


@query("select query_id, doc_id, term, round(part, 6) as part from bm25_parts join (select query_id, doc_id from bm25 where rank <= 10) using (query_id, doc_id) where part <> 0")
def bm25_contributions(spark, sf_dir):
    hits = i.ranking(spark, sf_dir, "bm25")
    return explain.contributions(rank.bm25_parts(i.plain(spark, sf_dir), i.queries(spark, sf_dir), only=hits), hits).withColumn("part", F.round("part", 6)).select("query_id", "doc_id", "term", "part")


@query("select query_id, doc_id, term, round(part, 6) as part from tfidf_parts join (select query_id, doc_id from tfidf where rank <= 10) using (query_id, doc_id) where part <> 0")
def tfidf_contributions(spark, sf_dir):
    hits = i.ranking(spark, sf_dir, "tfidf")
    parts = rank.tfidf_parts(i.grams(spark, sf_dir), i.queries(spark, sf_dir), i.vocabulary(spark, sf_dir, False), only=hits)
    return explain.contributions(parts, hits).withColumn("part", F.round("part", 6)).select("query_id", "doc_id", "term", "part")


@query("select query_id, doc_id, term, concat_ws(',', case when list_contains(regexp_extract_all(lower(c.title), '[a-z0-9]+'), term) then 'title' end, case when list_contains(regexp_extract_all(lower(c.description), '[a-z0-9]+'), term) then 'description' end, case when list_contains(regexp_extract_all(lower(c.listed_in), '[a-z0-9]+'), term) then 'genres' end) as fields from bm25_parts join (select query_id, doc_id from bm25 where rank <= 10) using (query_id, doc_id) join cat c using (doc_id) where part <> 0")
def matched_fields(spark, sf_dir):
    hits = i.ranking(spark, sf_dir, "bm25")
    parts = explain.contributions(rank.bm25_parts(i.plain(spark, sf_dir), i.queries(spark, sf_dir), only=hits), hits)
    return explain.term_fields(parts, i.catalog(spark, sf_dir), ["title", "description", "listed_in"]).withColumn("fields", F.array_join("fields", ","))


def _words(column: str) -> str:
    return f"list_filter(regexp_extract_all(lower({column}), '[\\pL\\pN_]{{2,}}'), lambda w: w not in ({i._STOP}))"


def _grams(words: str) -> str:
    return f"list_concat({words}, list_transform(range(1, len({words})), lambda i: {words}[i] || ' ' || {words}[i + 1]))"


@query(
    f"""select kind, query_id, doc_id, term, concat_ws(',', case when list_contains({_grams("t")}, term) then 'title' end, case when list_contains({_grams("d")}, term) then 'description' end, case when list_contains({_grams("g")}, term) then 'genres' end) as fields
from (select 'tfidf' as kind, query_id, doc_id, term from tfidf_parts join (select query_id, doc_id from tfidf where rank <= 10) using (query_id, doc_id) where part <> 0
union all select 'jaccard', query_id, doc_id, term from bown join bq using (term) join (select query_id, doc_id from jaccard where rank <= 10) using (query_id, doc_id))
join (select doc_id, {_words("title")} as t, {_words("description")} as d, {_words("listed_in")} as g from cat) using (doc_id)"""
)
def matched_gram_fields(spark, sf_dir):
    """Which fields hold each word and word pair that the hits of TF-IDF and of set overlap share with their query."""
    q, grams, catalog = i.queries(spark, sf_dir), i.grams(spark, sf_dir), i.catalog(spark, sf_dir)
    tfidf, jaccard = i.ranking(spark, sf_dir, "tfidf"), i.ranking(spark, sf_dir, "jaccard")
    found = [
        ("tfidf", explain.contributions(rank.tfidf_parts(grams, q, i.vocabulary(spark, sf_dir, False), only=tfidf), tfidf)),
        ("jaccard", explain.contributions(rank.shared_parts(grams, q, i.vocabulary(spark, sf_dir, True), only=jaccard), jaccard)),
    ]
    named = [explain.term_fields(parts, catalog, ["title", "description", "listed_in"], text.ngrams).withColumn("kind", F.lit(kind)) for kind, parts in found]
    return reduce(DataFrame.unionByName, named).select("kind", "query_id", "doc_id", "term", F.array_join("fields", ",").alias("fields"))


@query(
    """select doc_id, cast(place as bigint) as place, round(x / sqrt(sum(x * x) over (partition by doc_id)), 6) as x from hv where x <> 0"""
)
def encoded_documents(spark, sf_dir):
    """Unit vectors of whole documents by the registered encoder without a model, a row a component that isn't 0."""
    v = encode.encode(i.table(spark, sf_dir, "documents"), "doc_id", "text", encode.HASHED)
    return v.select("doc_id", F.posexplode("v").alias("place", "x")).where("x <> 0").select("doc_id", F.col("place").cast("long").alias("place"), F.round("x", 6).alias("x"))


_MARK = "sum(cast('0x' || substr(md5(doc_id || ':' || md5(coalesce({}, ''))), 1, 12) as bigint))"


@query(" union all ".join(f"select '{c}' as field, 'hashed-terms-64' as encoder, substr(sha256('hashed-terms-64|{c}' || chr(0) || count(*) || chr(0) || {_MARK.format(c)}), 1, 32) as key, count(*) as rows, cast(64 as bigint) as width from {t}" for c, t in (("text", "documents"), ("title", "cat"))))
def vector_manifests(spark, sf_dir):
    """What the store says of the vectors of two text fields, which are encoded and kept where they aren't yet."""
    store, keys = Store(spark), {}
    for field, docs in (("text", i.table(spark, sf_dir, "documents")), ("title", i.catalog(spark, sf_dir))):
        encode.stored_vectors(docs, field, store=store)
        keys[field] = encode.content_key(docs, "doc_id", field, encode.HASHED.name, field)
    return encode.manifests(keys, store)


@query("select query_id, doc_id, len(list_distinct(list_intersect(list_distinct(regexp_extract_all(lower(query), '[a-z0-9]+')), regexp_extract_all(lower(text), '[a-z0-9]+')))) as shared, len(list_distinct(list_concat(regexp_extract_all(lower(query), '[a-z0-9]+'), regexp_extract_all(lower(text), '[a-z0-9]+')))) as united from jaccard join queries using (query_id) join documents using (doc_id) where rank <= 10")
def shared_terms(spark, sf_dir):
    rows = i.ranking(spark, sf_dir, "jaccard").join(i.queries(spark, sf_dir), "query_id").join(i.table(spark, sf_dir, "documents"), "doc_id")
    a, b = text.plain_tokens(F.col("query")), text.plain_tokens(F.col("text"))
    return rows.select("query_id", "doc_id", F.size(F.array_intersect(a, b)).cast("long").alias("shared"), explain.union_size(a, b).cast("long").alias("united"))


@query("select h.query_id, h.doc_id, b.rank as rank_bm25, d.rank as rank_hashed, round(coalesce(1.0 / (60 + b.rank), 0), 10) as share_bm25, round(coalesce(1.0 / (60 + d.rank), 0), 10) as share_hashed from hybrid h left join bm25 b using (query_id, doc_id) left join hashed d using (query_id, doc_id) where h.rank <= 10")
def fusion_sources(spark, sf_dir):
    out = explain.source_shares(i.ranking(spark, sf_dir, "hybrid").select("query_id", "doc_id"), {n: i.ranking(spark, sf_dir, n, 100) for n in ("bm25", "hashed")})
    return out.select("query_id", "doc_id", "rank_bm25", "rank_hashed", F.round("share_bm25", 10).alias("share_bm25"), F.round("share_hashed", 10).alias("share_hashed"))


@query("select r.query_id, r.doc_id, h.rank as first_rank, r.rank as final_rank, h.rank - r.rank as moved, case when h.rank > r.rank then 'up ' || (h.rank - r.rank) || ' to ' || r.rank when h.rank < r.rank then 'down ' || (r.rank - h.rank) || ' to ' || r.rank when h.rank = r.rank then 'stays at ' || r.rank else 'not in the first stage' end as said from rerank r left join hybrid h using (query_id, doc_id) where r.rank <= 10")
def rank_movement(spark, sf_dir):
    return explain.movement(i.ranking(spark, sf_dir, "rerank"), i.ranking(spark, sf_dir, "hybrid", 100))


def _listed(kind: str, parts: str) -> str:
    return f"""select '{kind}' as kind, h.query_id, h.doc_id, h.rank, case when n is null then 'no shared terms' else n || ' shared terms: ' || array_to_string(l[1:10], ', ') || case when n > 10 then ' and ' || (n - 10) || ' more' else '' end end as said
from {kind} h left join (select query_id, doc_id, count(*) as n, list(term order by round(part, 6) desc, term) as l from ({parts}) join (select query_id, doc_id from {kind} where rank <= 10) using (query_id, doc_id) where part <> 0 group by all) p on p.query_id = h.query_id and p.doc_id = h.doc_id where h.rank <= 10"""


_PLACED = " || ', ' || ".join(f"case when {a}.rank <= 100 then '{n} rank ' || {a}.rank else '{n} outside top 100' end" for a, n in (("b", "bm25"), ("d", "hashed")))


@query(
    " union all ".join([_listed("bm25", "select * from bm25_parts"), _listed("tfidf", "select * from tfidf_parts"), _listed("jaccard", "select query_id, doc_id, term, 1.0 as part from bown join bq using (term)")])
    + f" union all select 'hybrid', h.query_id, h.doc_id, h.rank, {_PLACED} from hybrid h left join bm25 b using (query_id, doc_id) left join hashed d using (query_id, doc_id) where h.rank <= 10"
    + " union all select 'rerank', r.query_id, r.doc_id, r.rank, case when h.rank > r.rank then 'up ' || (h.rank - r.rank) || ' to ' || r.rank when h.rank < r.rank then 'down ' || (r.rank - h.rank) || ' to ' || r.rank when h.rank = r.rank then 'stays at ' || r.rank else 'not in the first stage' end from rerank r left join hybrid h using (query_id, doc_id) where r.rank <= 10"
)
def explained_results(spark, sf_dir):
    """Why each of the ten hits of each system is there, in the way of its kind: kind, query_id, doc_id, rank, said."""
    q, top = i.queries(spark, sf_dir), lambda n, k=10: i.ranking(spark, sf_dir, n, k)
    grams = i.grams(spark, sf_dir)
    kinds = [
        explain.said_of_terms(top("bm25"), rank.bm25_parts(i.plain(spark, sf_dir), q, only=top("bm25")), "bm25"),
        explain.said_of_terms(top("tfidf"), rank.tfidf_parts(grams, q, i.vocabulary(spark, sf_dir, False), only=top("tfidf")), "tfidf"),
        explain.said_of_terms(top("jaccard"), rank.shared_parts(grams, q, i.vocabulary(spark, sf_dir, True), only=top("jaccard")), "jaccard"),
        explain.said_of_sources(top("hybrid"), {n: top(n, 100) for n in ("bm25", "hashed")}, 100),
        explain.said_of_movement(top("rerank"), top("hybrid", 100)),
    ]
    return reduce(DataFrame.unionByName, kinds)


@query("select doc_id, case when length(t) <= 280 then t else regexp_replace(substr(t, 1, 280), ' [^ ]*$', '') || '…' end as short, replace(substr(text, 1, 80), chr(10), ' ') as preview, lang || ' · ' || source as meta from (select doc_id, text, lang, source, regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g') as t from documents)")
def display_texts(spark, sf_dir):
    d = i.table(spark, sf_dir, "documents")
    return d.select("doc_id", text.shorten(F.col("text")).alias("short"), text.preview(F.col("text")).alias("preview"), text.meta_line(F.col("lang"), F.lit("nan"), F.col("source"), F.lit("")).alias("meta"))


@query()
def highlighted(spark, sf_dir):
    """The hits of each query with its tokens marked."""
    rows = i.ranking(spark, sf_dir, "bm25").join(i.table(spark, sf_dir, "documents"), "doc_id").join(i.queries(spark, sf_dir), "query_id")
    return rows.select("query_id", "doc_id", text.highlight_query(F.col("text"), F.col("query")).alias("html"))


@query("select doc_id, show_id, array_to_string(list_concat(case when type = 'Movie' then [title || ' (' || release_year || ' film)', title || ' (film)'] else [title || ' (' || release_year || ' TV series)', title || ' (' || release_year || ' television series)', title || ' (' || release_year || ' miniseries)', title || ' (TV series)', title || ' (television series)', title || ' (miniseries)', title || ' (TV program)'] end, [title]), '|') as variants from (select doc_id, show_id, type, release_year, regexp_replace(regexp_replace(title, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g') as title from cat) where title <> '' union all select doc_id, show_id, '' from cat where regexp_replace(title, '\\s+', '', 'g') = ''")
def title_variants(spark, sf_dir):
    c = i.catalog(spark, sf_dir)
    return c.select("doc_id", "show_id", F.array_join(linkage.title_variants(F.col("title"), F.col("release_year"), text.media_type(F.col("type"))), "|").alias("variants"))


def _linked(spark, sf_dir):
    """Catalog rows against pages of made-up titles and descriptions."""
    c = i.catalog(spark, sf_dir).withColumn("media", text.media_type(F.col("type")))
    form = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Work "), F.col("show_id"), F.lit(" ("), F.col("release_year"), F.lit(" film)"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("Work "), F.col("show_id"))).otherwise(F.concat(F.lit("Work "), F.col("show_id"), F.lit(" (TV series)")))
    said = F.when(F.col("doc_id") % 5 == 0, F.lit("")).when(F.col("doc_id") % 5 == 1, F.concat((F.col("release_year") + 1).cast("string"), F.lit(" film"))).when(F.col("doc_id") % 5 == 2, F.concat(F.col("release_year").cast("string"), F.lit(" television series"))).when(F.col("doc_id") % 5 == 3, F.lit("1950 film")).otherwise(F.lit("sitcom"))
    page = F.struct(form.alias("title"), said.alias("description"), (F.col("doc_id") % 11 == 0).alias("missing"), (F.col("doc_id") % 13 == 0).alias("disambiguation"))
    base = F.concat(F.lit("Work "), F.col("show_id"))
    return c.select("doc_id", "show_id", form.alias("page_title"), linkage.score(base, F.col("release_year"), F.col("media"), page, form).alias("m")).select("doc_id", "show_id", "page_title", "m.confidence", "m.reason")


@query(
    """select doc_id, show_id, case when doc_id % 3 = 0 then 'Work ' || show_id || ' (' || release_year || ' film)' when doc_id % 3 = 1 then 'Work ' || show_id else 'Work ' || show_id || ' (TV series)' end as page_title,
split_part(v, '/', 1) as confidence, split_part(v, '/', 2) as reason from (select *, case
when doc_id % 11 = 0 then 'none/missing' when doc_id % 13 = 0 then 'none/disambiguation'
when kind is not null and kind <> media then 'none/type_mismatch:' || kind
when t = 0 and media = 'film' and (d not in (1, 2, 3) or d in (1, 2) or d = 3) then 'high/' || case when d = 3 or d in (0, 1, 2, 4) then 'year_qualified_title' end
when t = 2 and media = 'tv' and d in (1, 2) then 'medium/type_title_plus_desc_year'
when t = 1 and kind = media and d in (1, 2) then 'high/bare_title_desc_corroborated'
when kind = media and d in (0, 4) then 'low/type_without_year_corroboration'
when d = 1 or d = 2 then 'none/insufficient_evidence' when d = 3 then 'none/year_mismatch' else 'none/insufficient_evidence' end as v
from (select *, doc_id % 3 as t, doc_id % 5 as d, case when type = 'Movie' then 'film' else 'tv' end as media,
case when doc_id % 3 = 0 then 'film' when doc_id % 3 = 2 then 'tv' when doc_id % 5 in (1, 3) then 'film' when doc_id % 5 in (2, 4) then 'tv' end as kind from cat))"""
)
def link_scores(spark, sf_dir):
    return _linked(spark, sf_dir)


@query()
def link_choices(spark, sf_dir):
    return linkage.choose(_linked(spark, sf_dir))


@query(
    """select slice, count(*) as n, count(*) filter (status = 'matched' and plot <> '') as with_plot, round(count(*) filter (status = 'matched' and plot <> '') / count(*), 4) as ratio from (
select 'catalog' as slice, case quality when 1 then 'matched' else 'ambiguous' end as status, case when quality = 1 and toxic = 0 then 'p' else '' end as plot from labels
union all select 'gold', case l.quality when 1 then 'matched' when 0 then 'ambiguous' else 'not_found' end, case when l.quality = 1 and l.toxic = 0 then 'p' else '' end from documents d left join labels l using (doc_id) where d.doc_id % 7 = 0) group by slice"""
)
def plot_coverage(spark, sf_dir):
    records = i.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("show_id"), F.when(F.col("quality") == 1, "matched").otherwise("ambiguous").alias("status"), F.expr("case when quality = 1 and toxic = 0 then 'p' else '' end").alias("plot"), F.lit("high").alias("confidence"))
    gold = i.table(spark, sf_dir, "documents").where("doc_id % 7 = 0").select(F.col("doc_id").alias("show_id"))
    return linkage.coverage(records, gold).select("slice", "n", "with_plot", "ratio")


@query(
    """select page_id, regexp_replace(regexp_replace(lines, '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') as plain from (
select page_id, regexp_replace(regexp_replace(untagged, '[ \\t]+\\n', chr(10), 'g'), '[ \\t]{2,}', ' ', 'g') as lines from (
select page_id, regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<[^>]+>', '', 'g') as untagged from pages))"""
)
def stripped_markup(spark, sf_dir):
    return i.table(spark, sf_dir, "pages").select("page_id", markup.plain_text(F.col("html")).alias("plain"))


_BODY = "trim(regexp_replace(lower(coalesce(text, '')), '[^a-z]+', ' '{}))"


@query(f"select doc_id, concat_ws(' ', 'a', nullif({_BODY.format(", 'g'")}, ''), lang, source, 'see open }} z') as plain from documents")
def wikitext_plain(spark, sf_dir):
    """Plain text of wiki markup around each document: nested templates, a table, a reference, links, marks left open."""
    body = F.expr(_BODY.format(""))
    raw = F.concat(
        F.lit("== Plot ==\na {{cite|x {{y|"), "lang", F.lit("}}}} "), body, F.lit(" [["), "source", F.lit("|"), "lang",
        F.lit("]] {| t |}<ref name=a>r</ref> [[File:p.png|thumb|c]] '''"), "source", F.lit("''' [https://e.org see] {{open } z]]"),
    )
    return i.table(spark, sf_dir, "documents").select("doc_id", markup.plain_text(raw).alias("plain"))


@query(
    """select doc_id, case when length(t) <= 400 then t when a >= 200 then %s when b >= 200 then %s when c >= 200 then %s when d >= 200 then %s else regexp_replace(regexp_replace(head, ' [^ ]*$', ''), '^\\s+|\\s+$', '', 'g') || '…' end as short
from (select *, %s as a, %s as b, %s as c, %s as d from (select doc_id, t, substr(t, 1, 400) as head from (select doc_id, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') as t from documents)))"""
    % (*[f"regexp_replace(substr(head, 1, {x} + 1), '^\\s+|\\s+$', '', 'g')" for x in "abcd"], *[f"case when contains(head, {s}) then length(head) - length(list_extract(string_split(head, {s}), -1)) - 2 end" for s in ("'. '", "'.' || chr(10)", "'? '", "'! '")])
)
def truncated_texts(spark, sf_dir):
    return i.table(spark, sf_dir, "documents").select("doc_id", text.truncate(F.col("text"), 400).alias("short"))


@query("select page_id, 'https://en.wikipedia.org/wiki/' || replace(replace(url_encode(replace(url, ' ', '_')), '%2F', '/'), '*', '%2A') as link from pages")
def page_links(spark, sf_dir):
    return i.table(spark, sf_dir, "pages").select("page_id", text.page_url(F.col("url")).alias("link"))


@query("select text, min(doc_id) as doc_id from documents group by text")
def first_wins(spark, sf_dir):
    """The first document of each text."""
    return i.table(spark, sf_dir, "documents").select(F.col("text").alias("show_id"), "doc_id").transform(fields.first_index).select(F.col("show_id").alias("text"), "doc_id")


@query("select t.p_partkey as title, coalesce(r3.target, r2.target, r1.target, t.p_partkey) as target from part t left join red r1 on r1.source = t.p_partkey left join red r2 on r2.source = r1.target left join red r3 on r3.source = r2.target".replace("red ", "(select p_partkey as source, p_partkey + 1 as target from part where p_partkey % 4 <> 0) "))
def redirect_chase(spark, sf_dir):
    p = i.table(spark, sf_dir, "part")
    red = p.where("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("source"), (F.col("p_partkey") + 1).alias("target"))
    return linkage.follow(p.select(F.col("p_partkey").alias("title")), red)


_NEXT = "case when p_partkey % 50 = 10 then p_partkey + 1 when p_partkey % 50 = 11 then p_partkey - 1 when p_partkey % 4 <> 0 then p_partkey + 1 end"


@query(
    f"""with red as (select 'Work ' || p_partkey as source, 'Work ' || ({_NEXT}) as target from part where {_NEXT} is not null), asked as (select case when p_partkey % 5 = 0 then 'work ' else 'Work ' end || p_partkey as title, 'Work ' || p_partkey as start from part),
reached as (select title, coalesce(r3.target, r2.target, r1.target, start) as page_title from asked left join red r1 on r1.source = start left join red r2 on r2.source = r1.target left join red r3 on r3.source = r2.target),
pages as (select 'Work ' || p_partkey as page_title, p_partkey as id, p_type as description, p_partkey % 11 = 0 as gone, p_partkey % 13 = 0 as several from part where p_partkey % 7 <> 0)
select title, page_title, case when not gone then id end as pageid, coalesce(description, '') as description, gone is null or gone as missing, coalesce(several, false) as disambiguation from reached left join pages using (page_title)"""
)
def resolved_titles(spark, sf_dir):
    """Titles normalised, followed through chains and cycles of redirects, with the flags of the page that is reached."""
    p, of = i.table(spark, sf_dir, "part"), lambda c, w="Work ": F.concat(F.lit(w), c.cast("string"))
    key, target = F.col("p_partkey"), F.expr(_NEXT)
    asked = p.select(F.when(key % 5 == 0, of(key, "work ")).otherwise(of(key)).alias("title"))
    normalized = p.where("p_partkey % 5 = 0").select(of(key, "work ").alias("source"), of(key).alias("target"))
    redirects = p.where(target.isNotNull()).select(of(key).alias("source"), of(target).alias("target"))
    pages = p.where("p_partkey % 7 <> 0").select(of(key).alias("title"), key.alias("pageid"), F.col("p_type").alias("description"), (key % 11 == 0).alias("missing"), (key % 13 == 0).alias("disambiguation"))
    return linkage.resolve_titles(asked, normalized, redirects, pages)


@query("select doc_id, case when doc_id % 3 = 0 then 'again' when doc_id % 2 = 0 then 'gold' else 'rest' end as made, md5(coalesce(text, '')) as mark from documents")
def resumed_enrichment(spark, sf_dir):
    """Records made in three calls: of gold rows, of those still missing, and of some rows once more."""
    d = i.table(spark, sf_dir, "documents").select("doc_id", "text")
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("made", T.StringType()), T.StructField("mark", T.StringType())])
    held = Keyed(Store(spark), f"records-{uuid.uuid4().hex}", "doc_id", schema)
    make = lambda how: lambda rows: rows.select("doc_id", F.lit(how).alias("made"), F.md5(F.coalesce("text", F.lit(""))).alias("mark"))
    enrich(held, d, make("gold"), only=d.where("doc_id % 2 = 0").select("doc_id"))
    enrich(held, d, make("rest"), batch_rows=max(1, d.count() // 3))
    enrich(held, d.where("doc_id % 3 = 0"), make("again"), force=True)
    return held.read()


_SPLIT = "case when query_id % 2 = 0 then 'dev' else 'test' end"


@query(
    f"""select split, method, count(*) as n_queries, count(ndcg_10) as n_scored, count(recall_10) as n_scored_recall, coalesce(sum(u), 0)::bigint as unjudged, round(avg(recall_5), 4) as recall_5, round(avg(recall_10), 4) as recall_10, round(avg(mrr), 4) as mrr, round(avg(ndcg_10), 4) as ndcg_10
from (select s.*, u, {_SPLIT} as split from scores s left join (select method, query_id, count(*) filter (grade is null) as u from run left join judged using (query_id, doc_id) group by all) using (method, query_id)) group by grouping sets ((split, method), (method))"""
)
def split_tables(spark, sf_dir):
    """What the evaluation says of each system, by split and over both."""
    return metrics.split_tables(i.scores(spark, sf_dir), i.run(spark, sf_dir), i.judgments(spark, sf_dir), F.expr(_SPLIT))


@query(
    f"""select split, count(*) as n_queries, count(*) filter (p > 0) as n_with_positive, count(*) filter (r > 0) as n_with_relevant, sum(n)::bigint as n_judged, sum(p)::bigint as n_positive, sum(r)::bigint as n_relevant
from (select query_id, {_SPLIT} as split, count(grade) as n, count(*) filter (grade > 0) as p, count(*) filter (grade >= 2) as r from queries left join judged using (query_id) group by query_id) group by grouping sets ((split), ())"""
)
def label_counts(spark, sf_dir):
    return metrics.label_counts(i.judged(spark, sf_dir), i.queries(spark, sf_dir), F.expr(_SPLIT))


@query("select show_id, title, type, release_year, listed_in, coalesce(\"cast\", '') as \"cast\", coalesce(director, '') as director, description from cat")
def blinded_cards(spark, sf_dir):
    return protocol.cards(i.catalog(spark, sf_dir))


@query("select source as field, substr(sha256('model|' || source || chr(0) || count(*) || chr(0) || sum(cast('0x' || substr(md5(doc_id || ':' || md5(text)), 1, 12) as bigint))), 1, 32) as key from documents group by source")
def cache_keys(spark, sf_dir):
    """A content key of each source's texts: model, field, count and the sum of hashes of (doc_id, text). A sum needs no
    task to hold a source, and any changed, lost or moved text changes it."""
    mark = F.conv(F.substring(F.md5(F.concat_ws(":", "doc_id", F.md5("text"))), 1, 12), 16, 10).cast("decimal(38,0)")
    d = i.table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(mark).cast("string").alias("x"), F.count("*").alias("n"))
    body = F.concat(F.lit("model|"), F.col("source"), F.lit("\0"), F.col("n").cast("string"), F.lit("\0"), F.col("x"))
    return d.select(F.col("source").alias("field"), F.substring(F.sha2(body, 256), 1, 32).alias("key"))


@query("select f.method, f.query_id, case when ideal > 0 then round(coalesce(d, 0) / ideal, 6) end as ndcg from frame f left join (select method, query_id, sum((pow(2, grade) - 1) / log2(place + 1)) as d from (select r.*, j.grade, row_number() over (partition by r.method, r.query_id order by r.rank) as place from run r join second j using (query_id, doc_id)) group by all) using (method, query_id) left join (select query_id, sum((pow(2, grade) - 1) / log2(place + 1)) as ideal from (select *, row_number() over (partition by query_id order by grade desc, doc_id) as place from second) where place <= 10 group by all) using (query_id)")
def second_judge_ndcg(spark, sf_dir):
    """Condensed nDCG from the second judge's grades only."""
    out = metrics.graded_ndcg(i.run(spark, sf_dir), i.second_judgments(spark, sf_dir), i.queries(spark, sf_dir), judged_only=True)
    return out.select("method", "query_id", F.round("ndcg", 6).alias("ndcg"))


@query("select method, cast(row_number() over (order by case method when 'src3' then 0 when 'src1' then 1 else 1000 end, method) as bigint) as place from (select distinct source as method from documents)")
def preferred_order(spark, sf_dir):
    return protocol.preferred_order(i.table(spark, sf_dir, "documents").select(F.col("source").alias("method")).distinct(), ["src3", "src1"])


@query("select query_id, string_agg(method || '=' || ids, ';' order by method) as rankings, coalesce(max(n), 0) as n_judged from (select query_id, method, string_agg(cast(doc_id as varchar), ',' order by rank) as ids from run group by all) left join (select query_id, count(*) as n from judged group by all) using (query_id) group by query_id")
def explorer_rankings(spark, sf_dir):
    """What the explorer's nested data says, flat."""
    lists = i.run(spark, sf_dir).groupBy("query_id", "method").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))).alias("x"))
    text_of = F.concat(F.col("method"), F.lit("="), F.array_join(F.transform("x", lambda s: s["doc_id"].cast("string")), ","))
    rows = lists.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list(text_of)), ";").alias("rankings"))
    counts = i.judged(spark, sf_dir).groupBy("query_id").agg(F.count("*").alias("n"))
    return rows.join(counts, "query_id", "left").select("query_id", "rankings", F.coalesce("n", F.lit(0)).alias("n_judged"))


@query()
def explorer_data(spark, sf_dir):
    return protocol.explorer(i.run(spark, sf_dir), i.judged(spark, sf_dir), i.queries(spark, sf_dir))


@query()
def link_records(spark, sf_dir):
    linked = _linked(spark, sf_dir)
    plots = linked.where("doc_id % 2 = 0").select("page_title", F.concat(F.lit("Story of "), F.col("page_title")).alias("plot"))
    return linkage.records(i.catalog(spark, sf_dir), linkage.choose(linked), plots)
