"""Vectors without a model: hashed trigrams; a two-dimensional view of vectors; deterministic point ids."""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Code points whose trigrams are told apart at once; a longer text stands alone.
RUN = 1 << 20


def trigram_vectors(texts: list[str], size: int) -> np.ndarray:
    """Lower-case trigrams of each text with white space collapsed; each adds a sign to the place that its digest picks.

    A text of one or two code points is one trigram. Rows have length 1, or are zero for empty texts.
    """
    plain = [" ".join(t.lower().split()) for t in texts]
    keys, counts = [], []
    for t in plain:
        code = np.frombuffer(t.encode("utf-32-le"), np.uint32).astype(np.int64) + 1  # below 2^21; 0 stands for none
        code = np.append(code, np.zeros(max(0, 3 - len(code)), np.int64)) if len(code) else code
        keys.append(code[:-2] | code[1:-1] << 21 | code[2:] << 42)
        counts.append(len(keys[-1]))
    distinct, which = np.unique(np.concatenate([np.zeros(0, np.int64), *keys]), return_inverse=True)
    grams = ("".join(chr(c - 1) for c in (k & 0x1FFFFF, k >> 21 & 0x1FFFFF, k >> 42) if c) for k in distinct.tolist())
    digest = np.frombuffer(b"".join(hashlib.blake2b(g.encode(), digest_size=8).digest() for g in grams), "<u8")
    place, sign = (digest % np.uint64(size)).astype(np.int64), 1.0 - 2.0 * (digest >> np.uint64(63)).astype(np.float64)
    text = np.repeat(np.arange(len(texts)), counts)
    v = np.bincount(text * size + place[which], sign[which], len(texts) * size).reshape(-1, size)
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(norm > 0, norm, 1)


def hash_embedding(df: DataFrame, text: str, size: int) -> DataFrame:
    """df with ``vector`` in place of its text; a null text has a zero vector."""

    @F.pandas_udf("array<float>")
    def run(batch: pd.Series) -> pd.Series:
        texts = [t or "" for t in batch]
        ends = np.cumsum([len(t) for t in texts])
        out, at = [], 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + RUN, "right")))
            out.extend(trigram_vectors(texts[at:end], size).astype(np.float32))
            at = end
        return pd.Series(out, dtype=object)

    return df.select(*(x for x in df.columns if x != text), run(F.col(text)).alias("vector"))


def projection(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, x, y, explained_x, explained_y): the two main axes of the centred vectors; three vectors are needed.

    Sums and products of components are aggregated in Spark; only their matrix, dimensions squared, is decomposed.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    some = df.select(F.col(id_col).alias("id"), array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    if some.limit(3).count() < 3:
        return df.sparkSession.createDataFrame([], "id long, x double, y double, explained_x double, explained_y double")
    model = PCA(k=2, inputCol="v", outputCol="p").fit(some)
    share = [float(x) for x in model.explainedVariance.toArray()]
    p = vector_to_array("p")
    return model.transform(some).select("id", p[0].alias("x"), p[1].alias("y"), F.lit(share[0]).alias("explained_x"), F.lit(share[1]).alias("explained_y"))


def point_id(chunk_id: Column) -> Column:
    """The same identifier for the same chunk, each time."""

    @F.pandas_udf("string")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda x: None if x is None else str(uuid.uuid5(uuid.NAMESPACE_URL, x)))

    return run(chunk_id)


def replace_document(new: DataFrame, path: str) -> None:
    """Writes vectors by doc_id: documents in ``new`` are replaced as a whole, others stay."""
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc_id").parquet(path)


#: Rows of one length that are numbered together.
NUMBERED = 1 << 20


def batched(rows: DataFrame, id_col: str, length_col: str, budget: int, longest: int) -> DataFrame:
    """(id, length, batch): rows by ascending length, cut greedily so that a batch's longest times its rows fits the budget.

    Lengths count up to ``longest``; a row that is over the budget by itself is a batch of its own. Null lengths count
    as 0. How many rows each length has, at most ``longest`` + 1 figures, settles where batches begin; a row's number
    among those of its length then gives its batch. Lengths that many rows share are numbered in shares.
    """
    spark = rows.sparkSession
    held = rows.select(F.col(id_col).alias("id"), F.least(F.coalesce(length_col, F.lit(0)).cast("int"), F.lit(longest)).alias("length"))
    counts = sorted((r.length, r.n) for r in held.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect())
    plan, batch, open_rows = [], -1, 0
    for length, n in counts:
        room = max(1, budget // length) if length > 0 else 1 << 62
        more = min(n, max(0, room - open_rows)) if batch >= 0 else 0
        rest = n - more
        plan.append((length, -(-n // NUMBERED), more, batch, batch + 1, room))
        batch, open_rows = (batch + -(-rest // room), (rest - 1) % room + 1) if rest else (batch, open_rows + more)
    cuts = F.broadcast(spark.createDataFrame(plan, "length int, shares int, more long, open long, next long, room long"))
    dealt = held.join(cuts, "length").withColumn("share", F.pmod(F.xxhash64("id"), F.col("shares")))
    sizes = dealt.groupBy("length", "share").agg(F.count(F.lit(1)).alias("n"))
    base = sizes.select("length", "share", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    placed = dealt.withColumn("k", F.row_number().over(Window.partitionBy("length", "share").orderBy("id")) - 1).join(base, ["length", "share"])
    rank = F.col("base") + F.col("k")
    number = F.when(rank < F.col("more"), F.col("open")).otherwise(F.col("next") + F.floor((rank - F.col("more")) / F.col("room")))
    return placed.select("id", "length", number.cast("long").alias("batch"))
