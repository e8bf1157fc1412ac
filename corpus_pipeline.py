"""Training-corpus pipeline over ``documents``: language, near-duplicates, repeated passages, mixing, tokens.

Each stage gets the documents that its predecessor kept and returns a DataFrame; the columns of documents (doc_id,
text, lang, source, n_chars) stay, save in the last stage, which adds tokens. run() writes each stage's result to the
shared folder and reads it again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import byte_bpe, common, language_id, minhash, mixing, substring_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
WINDOW = 35
CAP = 3


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of documents alone, with ``row``: unique to each row, doc_id where that is."""
    return common.numbered(docs.select(*COLUMNS), "doc_id")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that language identification rejects: no letters, or like no learned language."""
    docs = docs.select(*COLUMNS)
    return language_id.keep_known(docs, language_id.learn(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: that with the least doc_id (of those with equal ids, the first row)."""
    docs = _documents(docs)
    classes = minhash.near_duplicates(docs, id_col="row")
    return docs.join(classes.where("row = class_id").select("row"), "row", "left_semi").select(*COLUMNS)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages of WINDOW words that occur elsewhere too; emptied documents go.

    A document that lost words has the others joined by spaces; the rest keep their text as it was.
    """
    cut = substring_dedup.remove_repeated(docs.select(*COLUMNS), WINDOW, keep_text=True, carry=("lang", "source"))
    cut = cut.where("n_removed < n_words or n_words = 0")
    return cut.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix copies it: sources weigh 5, 2, 1 in turn, nothing comes more than CAP times."""
    docs = _documents(docs)
    copies = mixing.mix(docs, cap=CAP, id_col="row").where("copies > 0").select(F.col("doc_id").alias("row"), "copies")
    return docs.join(copies, "row").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each copy of each document, and digests of the ids and of the bytes they decode to."""
    made = byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), keep_ids=True)
    return made.select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language ID", language),
    ("MinHash near-dedup", near_duplicates),
    ("substring dedup", substrings),
    ("mixing to target weights", mixture),
    ("byte-level BPE", tokens),
]
#: The samplers, models and hashes of the stages have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs, _ = common.stored(stage(spark, docs, sf_dir), "stage-" + "".join(x for x in name if x.isalpha()))
    return docs
