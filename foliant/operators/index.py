"""A stored search index: postings in buckets of terms, lengths and vectors, statistics and a manifest beside them.

    <folder>/postings/gen=<g>/bucket=<b>/   (term, id, doc, tf, length), sorted by term
    <folder>/chunks/gen=<g>/                (id, doc, length, payload, vector, terms with how often each occurs)
    <folder>/stats/                         (gen, chunks, terms): what each generation added
    <folder>/gone/                          (doc, gen, chunks, terms): what a later generation replaced
    <folder>/manifest/                      (model, query_prefix, buckets)

Texts are tokenised once, when they are added; terms are counted in their row, and postings move once. A search opens the buckets of its own terms only. A document that is
added again replaces what earlier generations have of it: a note of that is kept, and searches leave it out.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import search as S

BUCKETS = 64
POSTINGS = "term string, id {id}, doc {doc}, tf long, length int, gen int, bucket int"
STATS = "gen int, chunks long, terms long"
#: Postings that a task sorts; above that there are more tasks than spark.sql.shuffle.partitions.
SORTED = 4_000_000


@dataclass
class Hits:
    """rows: (rank, id, dense, dense_rank, lexical, lexical_rank, fused, rerank, score); notes: what the search lacked."""

    rows: DataFrame
    notes: list[str]


class Index:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        m = spark.read.parquet(f"{self.folder}/manifest").first()
        self.model, self.query_prefix, self.buckets, self.id, self.doc, self.payload = m.model, m.query_prefix, m.buckets, m.id, m.doc, m.payload

    @classmethod
    def create(cls, spark: SparkSession, folder: str, id_type: str = "long", doc_type: str = "string", payload: str = "", model: str = "", query_prefix: str = "", buckets: int = BUCKETS) -> "Index":
        """An empty index. payload: a schema of columns that filters may name; model and query_prefix: what its vectors were made with."""
        row = [(model, query_prefix, buckets, id_type, doc_type, payload)]
        spark.createDataFrame(row, "model string, query_prefix string, buckets int, id string, doc string, payload string").coalesce(1).write.parquet(f"{folder.rstrip('/')}/manifest")
        return cls(spark, folder)

    # ---- files ----

    def _read(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    @property
    def _chunk_schema(self) -> str:
        return f"id {self.id}, doc {self.doc}, length int, {self.payload + ', ' if self.payload else ''}vector array<double>, gen int"

    @property
    def _gone(self) -> DataFrame:
        return self._read("gone", f"doc {self.doc}, gen int, chunks long, terms long")

    def _alive(self, rows: DataFrame) -> DataFrame:
        """Rows whose document no later generation has replaced."""
        return rows.join(self._gone.select("doc", "gen"), ["doc", "gen"], "left_anti")

    def chunks(self) -> DataFrame:
        return self._alive(self._read("chunks", self._chunk_schema))

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        """Postings that hold: all of them, or some terms', of which only the buckets are read."""
        rows = self._read("postings", POSTINGS.format(id=self.id, doc=self.doc))
        if terms is not None:
            rows = rows.where(F.col("bucket").isin(sorted({self._bucket(t) for t in terms})) & F.col("term").isin(sorted(set(terms))))
        return self._alive(rows)

    def _bucket(self, term: str) -> int:
        return zlib.crc32(term.encode()) % self.buckets

    def stats(self) -> DataFrame:
        """One row: chunks and their average number of terms, from what generations added and lost."""
        gone = self._gone.select("gen", (-F.col("chunks")).alias("chunks"), (-F.col("terms")).alias("terms"))
        both = self._read("stats", STATS).unionByName(gone).agg(F.coalesce(F.sum("chunks"), F.lit(0)).cast("double").alias("n"), F.coalesce(F.sum("terms"), F.lit(0)).alias("terms"))
        return both.select("n", F.coalesce(F.try_divide("terms", "n"), F.lit(0.0)).alias("average"))

    # ---- adding ----

    def add(self, chunks: DataFrame) -> None:
        """Adds a generation of chunks (id, doc, text, payload, vector array<double> or none); documents it has are replaced.

        Ids tell an index's chunks apart, also after a replacement. Readers see the generation once its statistics are
        written, which comes last.
        """
        gen = (self._read("stats", STATS).agg(F.max("gen")).first()[0] + 1) if self._read("stats", STATS).limit(1).count() else 0
        vector = F.col("vector").cast("array<double>") if "vector" in chunks.columns else F.lit(None).cast("array<double>")
        named = [c.split()[0] for c in self.payload.split(", ")] if self.payload else []
        made = chunks.select(F.col("id").cast(self.id), F.col("doc").cast(self.doc), T.search_terms(F.coalesce("text", F.lit(""))).alias("terms"), *named, vector.alias("vector"))
        made = made.withColumn("length", F.size("terms")).withColumn("terms", T.counted_terms(F.col("terms")))
        bucket = F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(self.buckets)).cast("int")
        made.select("id", "doc", "length", *named, "vector", "terms").write.parquet(f"{self.folder}/chunks/gen={gen}")
        once = self.spark.read.schema(f"id {self.id}, doc {self.doc}, length int, terms array<struct<term:string,tf:long>>").parquet(f"{self.folder}/chunks/gen={gen}")
        most = once.agg(F.sum("length")).first()[0] or 0
        n = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-most // SORTED))
        counted = once.select("id", "doc", "length", F.inline("terms")).withColumn("bucket", bucket)
        # shares by id split a bucket with a frequent term; there are about two for each task
        share = F.pmod(F.xxhash64("id"), F.lit(max(1, 2 * n // self.buckets)))
        counted.repartition(n, "bucket", share).sortWithinPartitions("bucket", "term", "id").select("term", "id", "doc", "tf", "length", "bucket").write.partitionBy("bucket").parquet(f"{self.folder}/postings/gen={gen}")
        added = self.spark.read.schema(self._chunk_schema).parquet(f"{self.folder}/chunks/gen={gen}")
        if gen:
            again = added.select("doc").distinct()
            old = self._alive(self._read("chunks", self._chunk_schema).where(F.col("gen") < gen)).join(again, "doc", "left_semi")
            old.groupBy("doc", "gen").agg(F.count(F.lit(1)).alias("chunks"), F.sum("length").alias("terms")).write.mode("append").parquet(f"{self.folder}/gone")
        added.agg(F.lit(gen).alias("gen"), F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("terms")).coalesce(1).write.mode("append").parquet(f"{self.folder}/stats")

    # ---- searching ----

    def bm25(self, terms: list[str]) -> DataFrame:
        """(id, score) of chunks with any of the terms."""
        return S.bm25(self.postings(terms), self.stats(), terms)

    def search(self, terms: list[str], vector: list[float] | None = None, k: int = 5, mode: str = "hybrid", where: Column | None = None, weights: tuple[float, float] = (1.0, 1.0), rerank: Callable[[DataFrame], DataFrame] | None = None) -> Hits:
        """The k best chunks by terms, by a query's vector, or by both ranks, and each stage's scores and ranks.

        The query's vector must come of the index's model, the query after ``query_prefix``. where: a condition on the
        payload, doc or id. rerank: turns candidates (id) into (id, rerank); they are then ordered by it. Each search
        draws max(4k, 20) candidates, and 3k are reranked. Equal scores: the greater id first among terms, else the smaller.
        """
        if mode not in ("hybrid", "dense", "lexical"):
            raise ValueError(f"unknown mode {mode}")
        drawn, pool = S.budget(k)
        notes, chunks = [], self.chunks()
        some = chunks if where is None else chunks.where(where)
        dense = self.spark.createDataFrame([], f"id {self.id}, score double, rank long")
        if mode != "lexical":
            if vector is None or not some.where("vector is not null").limit(1).count():
                notes.append("the index has no vectors for this search")
            else:
                dense = S.dense(some.where("vector is not null"), vector, drawn, "id", "vector")
        scores = self.bm25(terms) if mode != "dense" else dense.select("id", "score").limit(0)
        if where is not None:
            scores = scores.join(some.select("id"), "id", "left_semi")
        lexical = S.ranked(scores, drawn)
        both = S.fused(dense, lexical, *weights).drop("rank")
        final = {"hybrid": F.col("fused"), "dense": F.col("dense"), "lexical": F.col("lexical")}[mode]
        both = both.withColumn("score", final).orderBy(F.desc("score"), "id").limit(pool if rerank else k)
        if rerank:
            both = both.join(rerank(both.select("id")), "id", "left").withColumn("score", F.coalesce("rerank", "score"))
        else:
            both = both.withColumn("rerank", F.lit(None).cast("double"))
        if mode != "hybrid":
            both = both.withColumn("fused", F.lit(None).cast("double"))
        order = [F.desc("rerank"), F.desc("fused" if mode == "hybrid" else mode), F.asc("id")] if rerank else [F.desc("score"), F.asc("id")]
        best = both.orderBy(*order).limit(k)  # k rows
        rows = best.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))
        return Hits(rows.select("rank", "id", "dense", "dense_rank", "lexical", "lexical_rank", "fused", "rerank", "score"), notes)


def query_vector(vectors: DataFrame, of, id_col: str, vector_col: str) -> list[float] | None:
    """One stored vector, for searches by example; None where there is none."""
    row = vectors.where(F.col(id_col) == of).select(F.col(vector_col).cast("array<double>").alias("v")).first()
    return row.v if row else None
