"""The driver's tables in the roles of a retrieval corpus, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querent.functions.text import STOP_WORDS, plain_tokens
from querent.operators import encode, metrics, rank, stats
from querent.sources.store import Store, digest, fingerprint

GRADE = "case when quality = 1 and toxic = 0 then 3 when quality = 1 then 2 when toxic = 0 then 1 else 0 end"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog_of(table(spark, sf_dir, "documents"))


def catalog_of(documents: DataFrame, *more: str) -> DataFrame:
    return documents.select(
        "doc_id", F.col("doc_id").cast("string").alias("show_id"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("description"),
        F.expr("case when doc_id % 2 = 0 then 'Movie' else 'TV Show' end").alias("type"), F.col("source").alias("listed_in"), F.lit("").alias("cast"), F.lit(None).cast("string").alias("director"),
        F.col("lang").alias("country"), F.expr("cast(1990 + doc_id % 30 as int)").alias("release_year"), *more,
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item's whole text, as its tokens."""
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), F.array_join(plain_tokens(F.col("text")), " ").alias("query"))


def judgments(spark: SparkSession, sf_dir: str) -> metrics.Judgments:
    """Labels as grades: a query's are those of the documents with its remainder by 4."""
    grades = table(spark, sf_dir, "labels").select(F.expr("doc_id % 4").alias("topic"), "doc_id", F.expr(GRADE).cast("long").alias("grade"))
    return metrics.Judgments(grades, queries(spark, sf_dir).select("query_id", F.expr("query_id % 4").alias("topic")))


def second_judgments(spark: SparkSession, sf_dir: str) -> metrics.Judgments:
    j = judgments(spark, sf_dir)
    return metrics.Judgments(j.grades.where("doc_id % 3 = 0").select("topic", "doc_id", F.expr("least(3, grade + case when doc_id % 5 = 0 then 1 else 0 end)").alias("grade")), j.topics)


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judgments(spark, sf_dir).pairs().select("query_id", "doc_id", "grade")


def second(spark: SparkSession, sf_dir: str) -> DataFrame:
    return second_judgments(spark, sf_dir).pairs().select("query_id", "doc_id", "grade")


def kept(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    """A table made from documents, queries and labels, once in a session for the files that these are."""
    files = [fingerprint(table(spark, sf_dir, t)) for t in ("documents", "benchmark", "labels")]
    return Store(spark).build(digest(name, spark.sparkContext.applicationId, *files), make)


def plain(spark: SparkSession, sf_dir: str) -> stats.Postings:
    return stats.plain_postings(table(spark, sf_dir, "documents"), "text")


def grams(spark: SparkSession, sf_dir: str) -> stats.Postings:
    return stats.gram_postings(table(spark, sf_dir, "documents"), "text")


def vocabulary(spark: SparkSession, sf_dir: str, binary: bool) -> DataFrame:
    return stats.vocabulary(grams(spark, sf_dir), binary)


def ranking(spark: SparkSession, sf_dir: str, name: str, k: int = 10) -> DataFrame:
    """A named system's rows; depth 100 for those that feed fusion."""
    q = queries(spark, sf_dir)

    def build() -> DataFrame:
        if name == "bm25":
            return rank.bm25(plain(spark, sf_dir), q, 100)
        if name == "tfidf":
            return rank.tfidf(grams(spark, sf_dir), q, 100)
        if name == "jaccard":
            return rank.jaccard(grams(spark, sf_dir), q, 100)
        if name == "hashed":
            return rank.dense(encode.stored_vectors(table(spark, sf_dir, "documents"), "text"), encode.encode(q, "query_id", "query", encode.HASHED), 100)
        if name == "hybrid":
            return rank.rrf([ranking(spark, sf_dir, "bm25", 100), ranking(spark, sf_dir, "hashed", 100)], 100)
        if name == "rerank":
            return rank.rerank(ranking(spark, sf_dir, "hybrid", 100), q, table(spark, sf_dir, "documents"), k=50)
        raise ValueError(f"no system {name}")

    return kept(spark, sf_dir, f"ranking {name}", build).where(F.col("rank") <= k)


SYSTEMS = ("bm25", "tfidf", "jaccard")


def run(spark: SparkSession, sf_dir: str, systems: tuple[str, ...] = SYSTEMS) -> DataFrame:
    out = None
    for name in systems:
        own = ranking(spark, sf_dir, name).select(F.lit(name).alias("method"), "query_id", "doc_id", "rank", "score")
        out = own if out is None else out.unionByName(own)
    return out


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, sf_dir, "scores", lambda: metrics.query_scores(run(spark, sf_dir), judgments(spark, sf_dir), queries(spark, sf_dir)))


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def _top(name: str, scored: str, k: int = 100, asked: str = "queries") -> str:
    """Zero-score rows fill up; ties by doc_id."""
    return f"""{name} as (select query_id, doc_id, score, rank from (select query_id, doc_id, score, cast(row_number() over (partition by query_id order by score desc, doc_id) as bigint) as rank
from (select q.query_id, d.doc_id, round(coalesce(s.score, 0.0), 6) as score from {asked} q cross join documents d left join {scored} s on s.query_id = q.query_id and s.doc_id = d.doc_id)) where rank <= {k})"""


#: Common table expressions in order; a query takes them all, and what it doesn't read isn't run.
CTES = [
    "queries as (select item_id as query_id, array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') as query from benchmark)",
    "cat as (select doc_id, cast(doc_id as varchar) as show_id, split_part(text, chr(10), 1) as title, text as description, case when doc_id % 2 = 0 then 'Movie' else 'TV Show' end as type, source as listed_in, '' as \"cast\", cast(null as varchar) as director, lang as country, cast(1990 + doc_id % 30 as int) as release_year from documents)",
    f"judged as (select q.query_id, l.doc_id, cast({GRADE} as bigint) as grade from labels l join queries q on l.doc_id % 4 = q.query_id % 4)",
    "second as (select query_id, doc_id, least(3, grade + case when doc_id % 5 = 0 then 1 else 0 end) as grade from judged where doc_id % 3 = 0)",
    "tf as materialized (select doc_id, term, count(*) as tf from (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from documents) group by all)",
    "dl as (select doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) as dl from documents)",
    "raw_idf as (select term, df, ln(n - df + 0.5) - ln(df + 0.5) as r from (select term, count(*) as df from tf group by term), (select count(*) as n from documents))",
    "idf as (select term, df, case when r < 0 then 0.25 * (select avg(r) from raw_idf) else r end as idf from raw_idf)",
    "qtf as (select query_id, term, count(*) as qtf from (select query_id, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) as term from queries) group by all)",
    "bm25_parts as (select q.query_id, t.doc_id, t.term, q.qtf * i.idf * t.tf * 2.5 / (t.tf + 1.5 * (1 - 0.75 + 0.75 * dl.dl / (select avg(dl) from dl))) as part from qtf q join tf t using (term) join idf i using (term) join dl on dl.doc_id = t.doc_id)",
    "bm25_scores as (select query_id, doc_id, sum(part) as score from bm25_parts group by all)",
    _top("bm25", "bm25_scores"),
    f"words as (select doc_id, list_filter(regexp_extract_all(lower(text), '[\\pL\\pN_]{{2,}}'), lambda w: w not in ({_STOP})) as w from documents)",
    "gtf as materialized (select doc_id, term, count(*) as tf from (select doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as term from words) group by all)",
    "gstats as materialized (select term, count(*) as df, sum(tf) as cf from gtf group by term having count(*) <= 0.4 * (select count(*) from documents))",
    "vocab as materialized (select term, df from gstats order by cf desc, term limit 10000)",
    "bvocab as materialized (select term from gstats order by df desc, term limit 10000)",
    f"qwords as (select query_id, list_filter(regexp_extract_all(lower(query), '[\\pL\\pN_]{{2,}}'), lambda w: w not in ({_STOP})) as w from queries)",
    "qgtf as (select query_id, term, count(*) as qtf from (select query_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as term from qwords) group by all)",
    "gidf as (select term, ln((1.0 + n) / (1.0 + df)) + 1.0 as idf from vocab, (select count(*) as n from documents))",
    "gw as (select doc_id, term, tf * idf as w from gtf join gidf using (term))",
    "gnorm as (select doc_id, sqrt(sum(w * w)) as norm from gw group by doc_id)",
    "gq as (select query_id, term, qtf * idf as qw from qgtf join gidf using (term))",
    "gqnorm as (select query_id, sqrt(sum(qw * qw)) as qnorm from gq group by query_id)",
    "tfidf_parts as (select query_id, doc_id, term, qw * w / norm / qnorm as part from gw join gq using (term) join gnorm using (doc_id) join gqnorm using (query_id))",
    "tfidf_scores as (select query_id, doc_id, sum(part) as score from tfidf_parts group by all)",
    _top("tfidf", "tfidf_scores"),
    "bown as (select doc_id, term from gtf join bvocab using (term))",
    "bq as (select query_id, term from qgtf join bvocab using (term))",
    "jaccard_scores as (select query_id, doc_id, c / greatest(nd + nq - c, 1e-12) as score from (select query_id, doc_id, count(*) as c from bown join bq using (term) group by all) join (select doc_id, count(*) as nd from bown group by all) using (doc_id) join (select query_id, count(*) as nq from bq group by all) using (query_id))",
    _top("jaccard", "jaccard_scores"),
    "hv as (select doc_id, cast(('0x' || substr(md5(term), 1, 6)) as bigint) % 64 as place, sum(tf * case when cast(('0x' || substr(md5(term), 7, 1)) as bigint) % 2 = 0 then 1 else -1 end)::double as x from tf group by all)",
    "hq as (select query_id, cast(('0x' || substr(md5(term), 1, 6)) as bigint) % 64 as place, sum(qtf * case when cast(('0x' || substr(md5(term), 7, 1)) as bigint) % 2 = 0 then 1 else -1 end)::double as x from qtf group by all)",
    "hdot as (select query_id, doc_id, sum(hq.x * hv.x) as d from hq join hv using (place) group by all)",
    "hashed_scores as (select query_id, doc_id, d / greatest(sqrt(a), 1e-12) / greatest(sqrt(b), 1e-12) as score from hdot join (select doc_id, sum(x * x) as a from hv group by all) using (doc_id) join (select query_id, sum(x * x) as b from hq group by all) using (query_id))",
    _top("hashed", "hashed_scores"),
    "fused as (select query_id, doc_id, round(sum(1.0 / (60 + rank)), 10) as score, min(l * 1000 + rank) as first from (select 0 as l, query_id, doc_id, rank from bm25 union all select 1, query_id, doc_id, rank from hashed) group by query_id, doc_id)",
    "hybrid as (select query_id, doc_id, score, rank from (select *, cast(row_number() over (partition by query_id order by score desc, first, doc_id) as bigint) as rank from fused) where rank <= 100)",
    "pairs as (select query_id, doc_id, round(case when len(a) > 0 then len(list_intersect(a, b)) / len(a) else 0.0 end, 6) as score from (select h.query_id, h.doc_id, list_distinct(regexp_extract_all(lower(q.query), '[a-z0-9]+')) as a, regexp_extract_all(lower(d.text), '[a-z0-9]+') as b from hybrid h join queries q using (query_id) join documents d using (doc_id) where h.rank <= 50))",
    "rerank as (select query_id, doc_id, score, cast(row_number() over (partition by query_id order by score desc, doc_id) as bigint) as rank from pairs)",
    "run as materialized (select 'bm25' as method, query_id, doc_id, rank, score from bm25 where rank <= 10 union all select 'tfidf', query_id, doc_id, rank, score from tfidf where rank <= 10 union all select 'jaccard', query_id, doc_id, rank, score from jaccard where rank <= 10)",
    "rel as (select query_id, doc_id from judged where grade >= 2)",
    "nrel as (select query_id, count(*) as n from rel group by all)",
    "frame as (select method, query_id, n from (select unnest(['bm25', 'tfidf', 'jaccard']) as method) cross join queries left join nrel using (query_id))",
    "hits as (select method, query_id, count(*) filter (rank <= 5) as h5, count(*) as h10, min(rank) as first, sum(case when rank <= 5 then 1 / log2(rank + 1) else 0 end) as d5, sum(1 / log2(rank + 1)) as d10 from run join rel using (query_id, doc_id) group by all)",
    "ideal as (select query_id, sum((pow(2, grade) - 1) / log2(r + 1)) as ideal from (select *, row_number() over (partition by query_id order by grade desc, doc_id) as r from judged) where r <= 10 group by all)",
    "dcg as (select method, query_id, sum(coalesce(pow(2, grade) - 1, 0) / log2(rank + 1)) as dcg from run left join judged using (query_id, doc_id) group by all)",
    "scores as materialized (select f.method, f.query_id, case when n > 0 then coalesce(h5, 0) / n end as recall_5, case when n > 0 then coalesce(h10, 0) / n end as recall_10, case when n > 0 then coalesce(1.0 / first, 0) end as mrr, case when ideal > 0 then coalesce(dcg, 0) / ideal end as ndcg_10 from frame f left join hits h using (method, query_id) left join dcg using (method, query_id) left join ideal using (query_id))",
]


def sql(select: str) -> str:
    """A query with the expressions that it needs, directly or through others."""
    import re

    named = {c.split(" as ", 1)[0]: c for c in CTES}
    want, queue = set(), [select]
    while queue:
        text = queue.pop()
        for name in named:
            if name not in want and re.search(rf"\b{name}\b", text):
                want.add(name)
                queue.append(named[name].split(" as ", 1)[1])
    return ("with " + ",\n".join(named[n] for n in named if n in want) + "\n" if want else "") + select
