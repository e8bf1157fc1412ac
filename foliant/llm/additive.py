"""Approximate nearest neighbours by additive quantisation.

A vector is the sum of one codeword from each of several full-dimensional codebooks. Codebooks are learnt on residuals
and then refined together by least squares on a bounded sample; all vectors are encoded by beam search. A query scores
a code by look-up tables and the code's stored norm; the best codes of each block are reranked by exact cosine. Equal
vectors are coded once, as a class with its least ids, so copies don't push each other out.

Codes travel in blocks of rows and queries in blocks too, so a block of queries meets every block of codes: a stated
set of queries against all rows. What comes within a margin of the block's best is a candidate; the margin is what
drawn queries need to find all their nearest. Where a block has very many candidates for a query (near copies), they
aren't sent one by one: the query goes to the block's vectors and is scored there, so no number of candidates is cut.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm import common as c

#: Vectors that the codebooks learn from, at most: those with the least digests of their ids.
SAMPLE = 8192
BOOKS, WORDS, BEAM = 16, 256, 4
#: Candidates that a block sends for a query one by one; a block with more scores the query on its vectors.
RERANK = 512
#: Drawn queries that the margin of candidates is fitted on, and the share of them that must find all their nearest.
FITTED, FOUND = 512, 0.99
CODE_BLOCK, QUERY_BLOCK = 16384, 512


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, steps: int = 6) -> np.ndarray:
    centres = x[rng.permutation(len(x))[:k]].copy()
    if len(centres) < k:
        centres = np.concatenate([centres, np.zeros((k - len(centres), x.shape[1]), x.dtype)])
    for _ in range(steps):
        near = np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        count = np.bincount(near, minlength=k)
        some = count > 0
        centres[some] = sums[some] / count[some, None]
    return centres


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """The codes (a row of bytes) whose sum is nearest to each vector, as far as a beam search finds."""
    n, (m, k, d) = len(x), books.shape
    codes = np.zeros((n, 1, m), np.uint8)
    residual = x[:, None, :].copy()
    for i in range(m):
        width = residual.shape[1]
        book = books[i]
        error = (residual**2).sum(2)[:, :, None] + (book**2).sum(1) - 2 * (residual.reshape(-1, d) @ book.T).reshape(n, width, k)
        error = error.reshape(n, width * k)
        keep = min(beam, width * k)
        best = np.argpartition(error, keep - 1, axis=1)[:, :keep]
        best = np.take_along_axis(best, np.argsort(np.take_along_axis(error, best, 1), axis=1, kind="stable"), 1)
        source, word = best // k, best % k
        codes = np.take_along_axis(codes, source[:, :, None], 1)
        codes[:, :, i] = word
        residual = np.take_along_axis(residual, source[:, :, None], 1) - book[word]
    return codes[:, 0]


def train(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 1, seed: int = 11) -> np.ndarray:
    """Codebooks (books, words, dimensions) from a sample: residual k-means, then joint least squares on its codes."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float32)
    made, residual = [], x.copy()
    for _ in range(books):
        book = _kmeans(residual, words, rng)
        residual -= book[np.argmin((book**2).sum(1) - 2 * residual @ book.T, axis=1)]
        made.append(book)
    out = np.stack(made)
    for _ in range(rounds if len(x) >= words * 2 else 0):
        codes = encode(x, out).astype(np.int64) + np.arange(books) * words
        gram = np.zeros((books * words, books * words), np.float32)
        for a in range(books):
            for b in range(books):
                np.add.at(gram, (codes[:, a], codes[:, b]), 1)
        right = np.zeros((books * words, x.shape[1]), np.float32)
        for a in range(books):
            np.add.at(right, codes[:, a], x)
        gram[np.diag_indices_from(gram)] += 0.5
        right += 0.5 * out.reshape(-1, x.shape[1])  # towards the books before, where a word is rare
        out = np.linalg.solve(gram, right).reshape(out.shape).astype(np.float32)
    return out


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>) of the vectors that take part: not null, not zero, all components finite."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.size(v) > 0
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null").where(fine & whole.isNotNull() & whole)


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def approximate(table: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Scores of codes by a query's look-up table."""
    s = table[0][codes[:, 0]]
    for m in range(1, len(table)):
        s = s + table[m][codes[:, m]]
    return s / norms


def _decoded(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return np.maximum(np.linalg.norm(sum(books[i][codes[:, i]] for i in range(len(books))), axis=1), 1e-6).astype(np.float32)


def fitted_margin(unit: np.ndarray, books: np.ndarray, k: int) -> float:
    """How far below the k-th best approximate score the candidates go: the share FOUND of drawn queries need no more."""
    if len(unit) <= k + 1:
        return math.inf
    codes, x = encode(unit, books), unit[:FITTED]
    norms, tables = _decoded(codes, books), np.einsum("qd,mkd->qmk", x, books, optimize=True)
    needed = []
    for i in range(len(x)):
        about, exact = approximate(tables[i], codes, norms), unit @ x[i]
        about[i] = exact[i] = -np.inf
        best = np.argpartition(-exact, k - 1)[:k]
        needed.append(np.partition(about, len(about) - k)[len(about) - k] - about[best].min())
    return float(np.quantile(needed, FOUND, method="higher")) + 1e-4


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows that belong together, added from left to right, as SQL adds."""
    total = lambda x: np.cumsum(x, axis=1)[:, -1]
    return total(a * b) / (np.sqrt(total(a * a)) * np.sqrt(total(b * b)))


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", rerank: int = RERANK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose id is divisible by ``every``.

    Nearest by cosine, in double precision on the original vectors; ties go to the smaller id. A query is no candidate
    of its own: rows with its id are left out. Vectors that are null, zero or hold null or non-finite components take
    no part, nor do null ids. Of rows that share an id the one with the greatest vector counts. All vectors must have
    one length. An empty table gives an empty result. Other columns are ignored.
    """
    spark = vectors.sparkSession
    known = usable(vectors, id_col, vector_col).groupBy("vec_id").agg(F.max("v").alias("v"))
    known, _ = c.stored(known, "vectors")
    # of equal vectors, k + 1 least ids are all that a query can need: its own may be one of them
    turn = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    least = known.withColumn("turn", turn).where(F.col("turn") <= k + 1).groupBy("v")
    classes, _ = c.stored(least.agg(F.min("vec_id").alias("vec_id"), F.sort_array(F.collect_list("vec_id")).alias("members")), "classes")
    sample = classes.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow()
    schema = "query_id long, rank int, vec_id long, score double"
    if sample.num_rows == 0:
        return spark.createDataFrame([], schema)
    unit = _matrix(sample.column("v"))
    unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
    books = train(unit)
    margin = fitted_margin(unit.astype(np.float32), books, k)
    shape, packed = books.shape, books.tobytes()  # BOOKS * WORDS * dimensions numbers, at any size of the table

    def blocks(batches):
        """Codes, norms and vectors of up to CODE_BLOCK rows in a row."""
        book = np.frombuffer(packed, np.float32).reshape(shape)
        ids, codes, norms, exact = [], [], [], []

        def flush():
            columns = [np.concatenate(x).tobytes() for x in (ids, codes, norms, exact)]
            first = pa.array([int(ids[0][0])], pa.int64())
            for x in (ids, codes, norms, exact):
                x.clear()
            return pa.RecordBatch.from_arrays([first, *(pa.array([x], pa.binary()) for x in columns)], ["part", "ids", "codes", "norms", "vectors"])

        for batch in batches:
            v = _matrix(batch.column("v"))
            x = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
            for a in range(0, len(x), 1024):
                code = encode(x[a : a + 1024], book)
                ids.append(c.longs(batch.column("vec_id"))[a : a + 1024])
                codes.append(code)
                norms.append(_decoded(code, book))
                exact.append(v[a : a + 1024])
                if sum(map(len, ids)) >= CODE_BLOCK:
                    yield flush()
        if ids:
            yield flush()

    coded, _ = c.stored(classes.select("vec_id", "v").mapInArrow(blocks, "part long, ids binary, codes binary, norms binary, vectors binary"), "codes")
    asked = known.where(F.pmod("vec_id", F.lit(every)) == 0)
    n_asked = asked.count()
    if not n_asked:
        return spark.createDataFrame([], schema)
    n_blocks = -(-n_asked // QUERY_BLOCK)
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int"))
    queries = asked.groupBy("block").agg(F.collect_list(F.struct("vec_id", "v")).alias("q"))  # QUERY_BLOCK rows or so
    spread = coded.select("part", "ids", "codes", "norms").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).repartition(c.partitions(spark), "block", "part")

    def score(batches):
        """Candidates of each query, and those queries (vec_id null) that must be scored on all of the block."""
        book = np.frombuffer(packed, np.float32).reshape(shape)
        for batch in batches:
            for i in range(batch.num_rows):
                q = batch.column("q")[i].values
                asked_ids, x = c.longs(q.field("vec_id")), _matrix(q.field("v")).astype(np.float32)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                tables = np.einsum("qd,mkd->qmk", x, book, optimize=True)
                part = batch.column("part")[i].as_py()
                ids = np.frombuffer(batch.column("ids")[i].as_py(), np.int64)
                codes = np.frombuffer(batch.column("codes")[i].as_py(), np.uint8).reshape(len(ids), -1)
                norms = np.frombuffer(batch.column("norms")[i].as_py(), np.float32)
                keep = min(k + 1, len(ids))  # one may be the query alone
                rows = []
                for j in range(len(x)):
                    s = approximate(tables[j], codes, norms)
                    bar = np.partition(s, len(s) - keep)[len(s) - keep] - margin
                    best = np.flatnonzero(s >= bar)
                    if len(best) > rerank:
                        rows.append((np.array([asked_ids[j]]), np.zeros(1, np.int64), np.zeros(1, np.float32), np.ones(1, bool)))
                    else:
                        rows.append((np.full(len(best), asked_ids[j]), ids[best], s[best], np.zeros(len(best), bool)))
                query, vec, about, whole = map(np.concatenate, zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(query), part)), pa.array(query), pa.array(vec, pa.int64(), mask=whole), pa.array(about, pa.float32())], ["part", "query_id", "vec_id", "about"])

    found, found_path = c.stored(spread.join(queries, "block").select("part", "ids", "codes", "norms", "q").mapInArrow(score, "part long, query_id long, vec_id long, about float"), "found", large=False)
    # candidates that no block's best would keep among all blocks' go
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("about"), "vec_id"))
    bars = found.where("vec_id is not null").withColumn("n", place).where(F.col("n") <= k + 1).groupBy("query_id").agg(F.min("about").alias("bar"), F.count(F.lit(1)).alias("n"))
    few = found.where("vec_id is not null").join(bars, "query_id").where((F.col("n") <= k) | (F.col("about") >= F.col("bar") - F.lit(margin))).select("query_id", "vec_id")
    of_query = known.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    pairs = few.join(classes.select("vec_id", "v"), "vec_id").join(of_query, "query_id")

    def exact(batches):
        for batch in batches:
            if batch.num_rows:
                dot = _cosines(_matrix(batch.column("q")), _matrix(batch.column("v")))
                yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("vec_id"), pa.array(dot)], ["query_id", "vec_id", "score"])

    scored = pairs.select("query_id", "vec_id", "q", "v").mapInArrow(exact, "query_id long, vec_id long, score double")
    # queries with many candidates in a block: shares of them meet its vectors
    wide = found.where("vec_id is null").join(of_query, "query_id").withColumn("share", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)))
    groups = wide.groupBy("part", "share").agg(F.collect_list(F.struct("query_id", "q")).alias("q"))  # QUERY_BLOCK rows or so

    def whole(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                q = batch.column("q")[i].values
                asked_ids, x = c.longs(q.field("query_id")), _matrix(q.field("q"))
                ids = np.frombuffer(batch.column("ids")[i].as_py(), np.int64)
                v = np.frombuffer(batch.column("vectors")[i].as_py(), float).reshape(len(ids), -1)
                for j in range(len(x)):
                    s = _cosines(np.broadcast_to(x[j], v.shape), v)
                    best = np.lexsort((ids, -s))[: k + 1]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), asked_ids[j])), pa.array(ids[best]), pa.array(s[best])], ["query_id", "vec_id", "score"])

    scored = scored.unionByName(groups.join(coded.select("part", "ids", "vectors"), "part").select("q", "ids", "vectors").mapInArrow(whole, "query_id long, vec_id long, score double"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = scored.withColumn("n", rank).where(F.col("n") <= k + 1).drop("n")  # each class but the query's own has a row to give
    scored = best.join(classes.select("vec_id", "members"), "vec_id").select("query_id", F.explode("members").alias("vec_id"), "score").where("query_id <> vec_id")
    made, _ = c.stored(scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "nearest", large=False)
    c.delete(spark, found_path)
    return made


#: Exact search; the same rows where recall is whole.
ORACLE = """
with v as (select vec_id, max(embedding::double[]) as v from embeddings
           where embedding is not null and vec_id is not null and len(embedding) > 0
             and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0 group by vec_id),
n as (select vec_id, v, sqrt(list_reduce(list_transform(v, lambda x: x * x), lambda a, b: a + b)) as n from v),
s as (select q.vec_id as query_id, c.vec_id as vec_id,
             list_reduce(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]), lambda a, b: a + b) / (q.n * c.n) as score
      from n q join n c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""
