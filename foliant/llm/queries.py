"""The registered queries of the training-data operators, each over its whole table, and their SQL where it exists."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import additive, alignment, byte_bpe, common, embedding_dedup, hard_negatives, language_id, minhash, mixing, simhash, substring_dedup, suffix_dedup, token_shards, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.scratch_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), folder, min_bytes=0)
    return warc.read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With n_near: how many other fingerprints of the table are within 3 bits."""
    made, _ = common.stored(simhash.edited(table(spark, sf_dir, "documents")), "simhash")
    near = simhash.near_fingerprints(made, 3)
    both = near.select(F.col("a").alias("fingerprint")).unionByName(near.select(F.col("b").alias("fingerprint")))
    n_near = both.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n_near"))
    return made.join(n_near, "fingerprint", "left").select(*made.columns, F.coalesce("n_near", F.lit(0)).alias("n_near"))


def op3_additive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return additive.nearest(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op4_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_earlier(table(spark, sf_dir, "documents"), 100).drop("kept")


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeated(table(spark, sf_dir, "documents"), 35).drop("kept", "row")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "taken")


def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.scratch_path(spark, "sst")
    shards = token_shards.write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder, 2)
    return token_shards.read(spark, shards, folder)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.learn(docs)).drop("rejected")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken")).drop("ids", "offsets")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).drop("row")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment.align(table(spark, sf_dir, "documents"), a, b)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (op1_warc, op2_simhash, op3_additive, op4_suffix_array, op5_substrings, op6_mixing, op7_token_shards, op8_language, op9_byte_bpe, op10_minhash, op11_alignment, op12_hard_negatives, op13_embedding_dedup)
}

ORACLES: dict[str, str] = {
    "op1_warc": warc.ORACLE,
    "op3_additive": additive.ORACLE,
    "op4_suffix_array": suffix_dedup.ORACLE,
    "op5_substrings": substring_dedup.ORACLE,
    "op6_mixing": mixing.ORACLE,
    "op12_hard_negatives": hard_negatives.ORACLE,
    "op13_embedding_dedup": embedding_dedup.ORACLE,
}
