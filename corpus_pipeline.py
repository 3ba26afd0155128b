"""Toxicity, quality, near-dedup, PII and packing over documents.

Each stage takes what its predecessor kept. Toxic and low-quality documents go, one document of each group
of near-duplicates stays, personal data is replaced by its kind, and the rest is packed. All stages but the
last return the columns of documents; n_chars is kept true to the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querent.llm import minhash, packing, pii, quality, toxicity
from querent.llm.runtime import cut, read, ship

#: SQL can't express the trained stages.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject; it learns from labels and the documents at hand.

    A text that is null or without words scores 0 and stays, as does a score on the threshold's other side;
    repeated rows share their fate; null ids are scored like others. An empty table stays empty. Extra columns
    of any name come through as they are, for the score is no column of the result.
    """
    ship(spark)
    found = toxicity.scorer(docs, read(spark, sf_dir, "labels"))
    return docs.where(found(F.col("text"))["score"] < toxicity.TOXIC)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model accepts, scores on its threshold among them.

    A null text is scored as the empty one; repeated rows share their fate; null ids are scored like others.
    An empty table stays empty. Extra columns of any name come through as they are.
    """
    ship(spark)
    score = quality.scorer(docs, read(spark, sf_dir, "labels"))
    return docs.where(score(F.col("text")) >= quality.KEEP)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: of the least doc_id, and of its texts the one that stands for the group.

    Rows equal in doc_id and text are one document and stay once. Rows that share an id with unlike texts are
    judged each for itself. Null ids, null texts and texts without words link with nothing and stay. An empty
    table stays empty. Extra columns of any name come through as they are.
    """
    ship(spark)
    return minhash.drop_copies(docs)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and secrets replaced by <kind>, and n_chars kept true to the text.

    A null text stays null with its n_chars; rows are changed each for itself, so repeated rows and null ids
    stay. An empty table stays empty. Extra columns of any name come through as they are.
    """
    redacted = pii.redact(docs)
    if "n_chars" in docs.columns:
        redacted = redacted.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")))
    return _same(redacted, docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of related ones.

    A text that is null or empty has the end id alone; repeated rows are packed as documents of their own; a
    null id stays null. An empty table gives an empty table. Extra columns are left behind.
    """
    from public_tokenizers import path

    ship(spark)
    return packing.pack_documents(docs, path("word_bpe_49k.json"))


def _same(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in docs.schema.fields])


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("PII", hide_personal_data),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result is written to the shared scratch folder and read again by the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs, "stage")
    return docs
