"""Registered queries of the dealt operators, each over its whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import byte_bpe, centroids, chat, decontam, jaccard_join, langid, near_vectors, oracle, pii, prefix_trie, quality_rules, sharding, token_count, toxicity
from .common import documents, in_held_out_fold, read

SHARDS = 8


def op1_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 of a 2 x 2 x 2 tree; law ``key``."""
    out = sharding.shard(documents(spark, sf_dir), sharding.uniform_tree())
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(documents(spark, sf_dir).select("doc_id", "text"))


def op2_link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_counts(documents(spark, sf_dir).select("doc_id", "text"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = documents(spark, sf_dir).select("doc_id", "text"), in_held_out_fold(F.col("doc_id"))
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), ~held)
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", *[f"n_{k}" for k in pii.BASE], "base_sha256", "spans", "scores")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.hits(documents(spark, sf_dir).select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op5_removed_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the hit spans of a window's length or more cut out of their texts."""
    found = decontam.hits(documents(spark, sf_dir).select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    body = F.coalesce("text", F.lit(""))
    return decontam.remove_spans(found).select("doc_id", "n_words", "n_hit", F.length(body).cast("bigint").alias("n_chars"),
                                               F.sha2(body.cast("binary"), 256).alias("text_sha256"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = documents(spark, sf_dir), in_held_out_fold(F.col("doc_id"))
    model = langid.fit(docs, ~held)
    return (langid.predict(docs.select("doc_id", "text"), model)
            .select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -1, whose texts are made of the template's control strings."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
                                   F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                   F.lit("<|im_end|><|im_start|>assistant ok").alias("text"))
    return chat.digests(chat.pieces(turns.unionByName(tricky)))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_count.count_tokens(documents(spark, sf_dir).select("doc_id", "text"),
                                   public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    rules = quality_rules.fit(docs, read(spark, sf_dir, "labels"))
    return quality_rules.apply(docs, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def bpe_vocabulary() -> byte_bpe.Vocabulary:
    return byte_bpe.Vocabulary(byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")),
                               public_tokenizers.PATTERN)


def bpe_digests(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) encoded, and decoded from the ids."""
    out = byte_bpe.round_trip(docs, bpe_vocabulary(), keep=["doc_id"])
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
                      F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(documents(spark, sf_dir).select("doc_id", "text"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(read(spark, sf_dir, "embeddings"))


def op12_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_duplicates(read(spark, sf_dir, "embeddings"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of all conversations, each rebuilt on the beginning of the first one of its hundred."""
    turns = prefix_trie.sequences(read(spark, sf_dir, "conversations"))
    return prefix_trie.trie(prefix_trie.shared_heads(turns))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_hash_tree_sharding, op2_jaccard_join, op2_link_counts, op3_toxicity, op4_personal_data, op5_decontamination, op5_removed_spans, op6_language,
        op7_chat_format, op8_token_counts, op9_quality_rules, op10_byte_bpe,
        op11_centroid_clustering, op12_near_vectors, op13_prefix_trie)}


def oracle_sql() -> dict[str, str]:
    """SQL where SQL can express a query; the others are tested against brute force or held-out rows."""
    return oracle.oracle_sql()
