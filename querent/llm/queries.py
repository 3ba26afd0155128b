"""The thirteen operators as queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from querent.llm.runtime import read, ship


def op1_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from querent.llm.pii import find

    return find(read(spark, sf_dir, "documents"))


def op2_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from querent.llm.quality import classify

    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op3_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from querent.llm.collision import nearest

    return nearest(read(spark, sf_dir, "embeddings"), k=5, every=50)


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    from querent.llm.pieces import encode_documents

    return encode_documents(read(spark, sf_dir, "documents"), path("piece_bpe_32k.model"), keep_ids=False)


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from querent.llm.minhash import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"))


def op6_noisy_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    from querent.llm.toxicity import classify

    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted", "offending")


def op7_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from querent.llm.shard_tree import shard_documents

    return shard_documents(read(spark, sf_dir, "documents"), shards=40)


def op8_host_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    from querent.llm.url_filter import judge, word_counts

    pages = read(spark, sf_dir, "pages")
    return judge(pages, word_counts(pages, "html"))


def op9_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    from querent.llm.packing import pack_documents

    return pack_documents(read(spark, sf_dir, "documents"), path("word_bpe_49k.json"))


def op10_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from querent.llm.multiset import fingerprint_documents

    return fingerprint_documents(read(spark, sf_dir, "documents"))


def op11_grouping_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    from querent.llm.grouping import pack_documents

    return pack_documents(read(spark, sf_dir, "documents"), path("byte_bpe_50k.json"))


def op12_block_max_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    from querent.llm.lexical import search

    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), k=10)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from querent.llm.prefix_trie import trie

    return trie(read(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def shipped(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        return run

    return {name: shipped(f) for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    """The others are trained, approximate or hashed in ways that SQL can't express: tests hold them against brute force."""
    from querent.llm import oracles

    return {"op5_minhash": oracles.NEAR_DUPLICATES, "op7_hash_tree": oracles.hash_tree(), "op12_block_max_wand": oracles.LEXICAL_SEARCH, "op13_prefix_trie": oracles.PREFIX_TRIE}
