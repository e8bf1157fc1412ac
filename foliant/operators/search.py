"""Lexical, dense, hybrid and reranked search over chunks, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.functions import vectors as V

K1, B, RRF = 1.5, 0.75, 60


def postings(docs: DataFrame, id_col: str, text_col: str, only: list[str] | None = None) -> DataFrame:
    """(id, term, tf, length) of each document's terms: the inverted index, to be kept as Parquet.

    only: for a search without an index, the terms asked for; others are left out before anything moves.
    """
    terms = docs.select(F.col(id_col).alias("id"), T.search_terms(F.coalesce(F.col(text_col), F.lit(""))).alias("terms"))
    if only is not None:
        asked = F.filter("terms", lambda x: x.isin(sorted(set(only))))
        terms = terms.select("id", F.size("terms").alias("length"), F.explode(asked).alias("term"))
        return terms.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length"))
    return terms.select("id", F.size("terms").alias("length"), F.explode("terms").alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length"))


def corpus_stats(docs: DataFrame, text_col: str) -> DataFrame:
    """One row: documents (empty ones too) and their average number of terms."""
    return docs.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(T.search_terms(F.coalesce(F.col(text_col), F.lit(""))))).alias("average"))


def bm25(index: DataFrame, stats: DataFrame, terms: list[str]) -> DataFrame:
    """(id, score) of the documents with any of the terms, each counted once."""
    found = index.where(F.col("term").isin(sorted(set(terms))))
    df = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # a row for each term asked for
    scored = found.join(F.broadcast(df), "term").join(F.broadcast(stats))  # stats are one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("average")))
    return scored.groupBy("id").agg(F.sum(idf * tf).alias("score"))


def ranked(scores: DataFrame, n: int, ties: Column | None = None) -> DataFrame:
    """The n best by score with ranks from 1; ties by id descending unless said otherwise."""
    ties = F.desc("id") if ties is None else ties
    best = scores.where("score > 0").orderBy(F.desc("score"), ties).limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), ties)).cast("long"))  # n rows


def dense(vectors: DataFrame, query: list[float], n: int, id_col: str, vector_col: str) -> DataFrame:
    """The n nearest by cosine, with ranks; the query is one literal, so there is no join."""
    q = F.array(*(F.lit(float(x)) for x in query))
    scores = vectors.select(F.col(id_col).alias("id"), V.cosine(F.col(vector_col), q).alias("score"))
    best = scores.orderBy(F.desc("score"), "id").limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")).cast("long"))


def fused(dense_hits: DataFrame, lexical_hits: DataFrame, dense_weight: float = 1.0, lexical_weight: float = 1.0) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists; a list that lacks an id adds nothing."""
    d = dense_hits.select("id", F.col("score").alias("dense"), F.col("rank").alias("dense_rank"))
    x = lexical_hits.select("id", F.col("score").alias("lexical"), F.col("rank").alias("lexical_rank"))
    part = lambda w, r: F.coalesce(F.lit(float(w)) / (F.lit(float(RRF)) + F.col(r)), F.lit(0.0))
    both = d.join(x, "id", "full_outer").withColumn("fused", part(dense_weight, "dense_rank") + part(lexical_weight, "lexical_rank"))
    return both.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("fused"), "id")).cast("long"))


def bigrams(text: Column) -> Column:
    plain = F.lower(text)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(plain) - 1, F.lit(1))), lambda i: F.substring(plain, i, F.lit(2))))


def overlap_score(query: Column, text: Column) -> Column:
    """Share of the query's character pairs that the text has, to four digits: stands in for a reranking model."""
    q = bigrams(query)
    has = lambda plain: F.size(F.filter(q, lambda x: ((F.length(x) == 2) & F.contains(plain, x)) | (plain == x)))  # noqa: E731  the text's own pairs would take its length squared
    return F.round(F.transform(F.array(F.lower(text)), has)[0] / F.size(q), 4)


def budget(k: int) -> tuple[int, int]:
    """Candidates that each search draws, and that a reranker gets, for k results."""
    return max(4 * k, 20), 3 * k


def neighbours(vectors: DataFrame, of, k: int, id_col: str, vector_col: str) -> DataFrame:
    """The k nearest of one vector without itself, k held to 50, scores to four digits."""
    own = vectors.where(F.col(id_col) == of).select(F.col(vector_col).alias("_own"))  # one row
    others = vectors.where(F.col(id_col) != of).join(F.broadcast(own))
    scored = others.select(F.col(id_col).alias("id"), F.round(V.cosine(F.col(vector_col), F.col("_own")), 4).alias("score"))
    return scored.orderBy(F.desc("score"), "id").limit(min(k, 50))


def provenance(chunks: DataFrame, answer: str, least: float = 0.3, share: float = 0.65) -> DataFrame:
    """Which of some retrieved chunks (id, page, text) an answer rests on.

    A chunk scores the sum, over the answer's terms that it has, of one by the number of chunks with the term, as a share
    of the greatest possible. Those of at least ``least`` and of ``share`` of the best stay, else the first chunk.
    """
    spark = chunks.sparkSession
    asked = spark.range(1).select(F.explode(T.evidence_terms(F.lit(answer))).alias("term"))
    terms = chunks.select("id", F.explode(T.evidence_terms(F.col("text"))).alias("term")).distinct().join(asked, "term", "left_semi")
    weights = terms.groupBy("term").agg((1.0 / F.count(F.lit(1))).alias("w"))
    scored = terms.join(weights, "term").groupBy("id").agg(F.sum("w").alias("sum"))
    total = weights.agg(F.sum("w").alias("all"))
    scored = scored.join(F.broadcast(total)).select("id", (F.col("sum") / F.col("all")).alias("score"))
    placed = chunks.join(scored, "id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    placed = placed.crossJoin(F.broadcast(placed.agg(F.max("score").alias("best"), F.min("id").alias("first"))))
    kept = (F.col("score") >= least) & (F.col("score") >= share * F.col("best"))
    kept = kept | ((F.col("best") < least) & (F.col("id") == F.col("first")))
    return placed.where(kept).select("id", "page", "score").orderBy(F.desc("score"), "id")


def first_pages(hits: DataFrame) -> DataFrame:
    """Each (document, page) once, where it comes first by rank."""
    w = Window.partitionBy("doc", "page").orderBy("rank")
    return hits.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def with_prefix(prefix: str, text: Column, title: Column) -> Column:
    """Text for an embedding model: a prefix that may name the title, white space collapsed in it, none where empty."""
    plain = F.trim(F.regexp_replace(F.coalesce(title, F.lit("")), r"\s+", " "))
    return F.concat(F.replace(F.lit(prefix), F.lit("{title}"), F.when(plain == "", "none").otherwise(plain)), text)
