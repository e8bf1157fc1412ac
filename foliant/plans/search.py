"""Search over documents and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.functions import vectors as V
from foliant.operators import search as S
from foliant.operators.index import Index, query_vector
from foliant.plans.registry import query, scratch, table

TERMS = ["the", "und", "pour", "que", "thing"]
_TOKENS = r"""
tok as (select doc_id as id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+|[가-힣]+') as terms from documents),
pos as (select id, len(terms) as length, unnest(terms) as term from tok),
idx as (select id, term, count(*) as tf, any_value(length) as length from pos group by id, term),
st as (select count(*)::double as n, avg(len(terms)) as average from tok)"""
_BM25 = (
    "with "
    + _TOKENS
    + """,
hit as (select * from idx where term in ('the', 'und', 'pour', 'que', 'thing')),
fr as (select term, count(*) as df from hit group by term),
bm as (select id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * length / average)))) as score
       from hit join fr using (term), st group by id)"""
)


_indexes: dict[tuple[str, str], str] = {}


def _index(spark, sf_dir):
    """The documents' index, with the vectors of the same ids: written by a session's first search, opened by others."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _indexes:
        folder = scratch(spark, "index")
        docs, vectors = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
        made = docs.join(vectors.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")), "doc_id", "left")
        Index.create(spark, folder, doc_type="long", payload="source string, lang string", model="given", query_prefix="query: ").add(made.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("doc"), "text", "source", "lang", "vector"))
        _indexes[key] = folder
    return Index(spark, _indexes[key])


def _scores(spark, sf_dir):
    return _index(spark, sf_dir).bm25(TERMS)


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


@query(_BM25 + " select id, round(score, 6) as score, row_number() over (order by score desc, id desc) as rank from bm order by score desc, id desc limit 20")
def bm25_topk(spark, sf_dir):
    return _rounded(S.ranked(_scores(spark, sf_dir), 20), "score")


@query(_BM25 + " select id, round(score, 6) as score from bm")
def bm25_all_scores(spark, sf_dir):
    return _rounded(_scores(spark, sf_dir), "score")


@query("with " + _TOKENS + " select term, count(*) as df, sum(tf)::bigint as tf, max(length)::bigint as longest from idx group by term")
def postings_stats(spark, sf_dir):
    return _index(spark, sf_dir).postings().groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"), F.max("length").cast("long").alias("longest"))


@query("with " + _TOKENS + " select id, length::bigint as length, count(*) as terms, min(term) as first, max(term) as last from (select id, term, length from pos) group by id, length")
def tokenize_terms(spark, sf_dir):
    terms = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), T.search_terms(F.coalesce("text", F.lit(""))).alias("t")).where(F.size("t") > 0)
    return terms.select("id", F.size("t").cast("long").alias("length"), F.size("t").cast("long").alias("terms"), F.array_min("t").alias("first"), F.array_max("t").alias("last"))


@query(
    """with q as (select embedding::double[] as q from embeddings where vec_id = 0)
    select vec_id as id, round(list_dot_product(embedding::double[], q) / (sqrt(list_dot_product(embedding::double[], embedding::double[])) * sqrt(list_dot_product(q, q))), 6) as score,
           row_number() over (order by list_dot_product(embedding::double[], q) / (sqrt(list_dot_product(embedding::double[], embedding::double[])) * sqrt(list_dot_product(q, q))) desc, vec_id) as rank
    from embeddings, q order by 3 limit 20"""
)
def dense_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    own = vectors.where("vec_id = 0").select("embedding").first()
    return _rounded(S.dense(vectors, own.embedding if own else [0.0], 20, "vec_id", "embedding"), "score")


@query(
    """with q as (select embedding::double[] as q from embeddings where vec_id = 7)
    select vec_id as id, round(list_dot_product(embedding::double[], q) / (sqrt(list_dot_product(embedding::double[], embedding::double[])) * sqrt(list_dot_product(q, q))), 4) as score
    from embeddings, q where vec_id <> 7 order by 2 desc, 1 limit 10"""
)
def neighbors_knn(spark, sf_dir):
    return S.neighbours(table(spark, sf_dir, "embeddings"), 7, 10, "vec_id", "embedding")


@query("select label, count(*) as n, round(min(s), 6) as low, round(avg(s), 6) as mean, round(max(s), 6) as high from (select label, sqrt(list_dot_product(embedding::double[], embedding::double[])) as s from embeddings) group by label")
def vector_norms(spark, sf_dir):
    n = table(spark, sf_dir, "embeddings").select("label", V.norm(F.col("embedding")).alias("s"))
    return n.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("s"), 6).alias("low"), F.round(F.avg("s"), 6).alias("mean"), F.round(F.max("s"), 6).alias("high"))


@query(
    """select vec_id, round(h[1] / n, 6) as first, round(h[16] / n, 6) as last, 16::int as size from (
       select vec_id, embedding[1:16]::double[] as h, sqrt(list_dot_product(embedding[1:16]::double[], embedding[1:16]::double[])) as n from embeddings)"""
)
def truncate_renorm(spark, sf_dir):
    t = table(spark, sf_dir, "embeddings").select("vec_id", V.truncated(F.col("embedding"), 16).alias("t"))
    return t.select("vec_id", F.round(F.col("t")[0], 6).alias("first"), F.round(F.col("t")[15], 6).alias("last"), F.size("t").alias("size"))


_RERANK = r"""
rr as (select doc_id as id, round(len(list_intersect(q, d))::double / len(q), 4) as score from (
  select doc_id, list_distinct(list_transform(range(1, greatest(length(lower(text)) - 1, 1) + 1), lambda i: substr(lower(text), i, 2))) as d,
         list_distinct(list_transform(range(1, 22), lambda i: substr('the thing of that ones', i, 2))) as q from documents where text is not null))"""


@query("with " + _RERANK.strip() + " select id, score, row_number() over (order by score desc, id) as rank from rr order by score desc, id limit 25")
def rerank_mock(spark, sf_dir):
    return S.ranked(_overlaps(spark, sf_dir), 25, F.asc("id"))


def _overlaps(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select(F.col("doc_id").alias("id"), S.overlap_score(F.lit("the thing of that ones"), F.col("text")).alias("score"))


_NEAR = """
em as (select e.vec_id as id, source, lang, list_dot_product(e.embedding::double[], q.embedding::double[]) / (sqrt(list_dot_product(e.embedding::double[], e.embedding::double[])) * sqrt(list_dot_product(q.embedding::double[], q.embedding::double[]))) as score
       from embeddings e join documents on doc_id = e.vec_id, embeddings q where q.vec_id = 0)"""
_FUSED = """
lx as (select id, score, row_number() over (order by score desc, id desc) as rank from bm where {some} order by score desc, id desc limit {n}),
de as (select id, score, row_number() over (order by score desc, id) as rank from em where {some} order by score desc, id limit {n}),
fu as (select coalesce(de.id, lx.id) as id, de.score as dense, de.rank as dense_rank, lx.score as lexical, lx.rank as lexical_rank,
       coalesce(1.0::double / (60 + de.rank), 0) + coalesce(0.5::double / (60 + lx.rank), 0) as fused from de full outer join lx on de.id = lx.id)"""


def _shown(hits):
    return hits.withColumns({"dense": F.round("dense", 6), "lexical": F.round("lexical", 6), "fused": F.round("fused", 9)})


@query(
    f"""{_BM25}, {_NEAR}, {_FUSED.format(some="true", n=80)}
    select row_number() over (order by fused desc, id) as rank, id, round(dense, 6) as dense, dense_rank, round(lexical, 6) as lexical, lexical_rank, round(fused, 9) as fused from fu order by fused desc, id limit 20"""
)
def hybrid_rrf(spark, sf_dir):
    """Terms and a vector's neighbours together: twenty of eighty candidates of each, by the sum of reciprocal ranks."""
    index = _index(spark, sf_dir)
    near = query_vector(table(spark, sf_dir, "embeddings"), 0, "vec_id", "embedding")
    return _shown(index.search(TERMS, near, 20, weights=(1.0, 0.5)).rows).drop("rerank", "score")


@query(
    f"""{_BM25}, {_NEAR}, {_RERANK.strip()}, {_FUSED.format(some="id in (select doc_id from documents where lang = 'en')", n=40)},
    po as (select fu.*, rr.score as rerank from (select * from fu order by fused desc, id limit 30) fu left join rr on rr.id = fu.id)
    select row_number() over (order by rerank desc nulls last, fused desc, id) as rank, id, round(dense, 6) as dense, dense_rank, round(lexical, 6) as lexical, lexical_rank, round(fused, 9) as fused, rerank from po
    order by rerank desc nulls last, fused desc, id limit 10"""
)
def search_reranked(spark, sf_dir):
    """The same among English documents only, thirty of them reranked by shared pairs of characters, with every stage's rank."""
    index = _index(spark, sf_dir)
    near = query_vector(table(spark, sf_dir, "embeddings"), 0, "vec_id", "embedding")
    texts = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("id"), "text")
    again = lambda some: texts.join(F.broadcast(some), "id").select("id", S.overlap_score(F.lit("the thing of that ones"), F.col("text")).alias("rerank"))  # noqa: E731  thirty ids
    return _shown(index.search(TERMS, near, 10, where=F.col("lang") == "en", weights=(1.0, 0.5), rerank=again).rows).drop("score")


@query((_BM25 + " select id, round(score, 6) as score from bm").replace("coalesce(text, '')", "case when source = 'src1' then 'the und ' || coalesce(text, '') when source = 'src2' then 'the' else coalesce(text, '') end"))
def index_replaced(spark, sf_dir):
    """Scores after two sources' documents have come again with other texts, one of them twice."""
    docs = table(spark, sf_dir, "documents")
    index = Index.create(spark, scratch(spark, "index"), doc_type="long", buckets=16)
    rows = docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("doc"), "text", "source")
    index.add(rows)
    index.add(rows.where("source in ('src1', 'src2')").withColumn("text", F.concat(F.lit("the und "), F.coalesce("text", F.lit("")))))
    index.add(rows.where("source = 'src2'").withColumn("text", F.lit("the")))
    return _rounded(index.bm25(TERMS), "score")


@query("select doc_id, 'doc: ' || case when trim(source) = '' then 'none' else source end || ' | ' || left(text, 40) as prefixed, round(1 / (1 + exp(-(n_chars / 1000.0::double - 2))), 6) as sigmoid from documents")
def embedding_prefix(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", S.with_prefix("doc: {title} | ", F.left("text", F.lit(40)), F.col("source")).alias("prefixed"), F.round(V.sigmoid(F.col("n_chars") / 1000 - 2), 6).alias("sigmoid"))


@query("select vec_id, label, n from embeddings join (select label, count(*) as n from embeddings group by label) using (label) where label in (select quality from labels)")
def embedding_meta_join(spark, sf_dir):
    """Vectors with what is known of them; vectors without a match go, then only those that another list has."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    meta = vectors.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    guard = table(spark, sf_dir, "labels").select(F.col("quality").alias("label"))
    return vectors.join(meta, "label").join(guard, "label", "left_semi").select("vec_id", "label", "n")


@query(
    r"""with t as (select conv_id, turn, text, list_distinct(list_concat(
      list_filter(list_transform(regexp_extract_all(lower(text), '\d[\d,.]*\d|\d+'), lambda x: replace(x, ',', '')), lambda x: length(x) > 1),
      list_transform(list_filter(regexp_extract_all(lower(text), '[a-z]{3,}'), lambda x: x not in ('the','and','for','with','that','this','from','are','was','which','what','how')), lambda x: left(x, 6)))) as terms
      from conversations where text is not null)
    select conv_id, turn, len(terms)::int as n, list_min(terms) as first, list_max(terms) as last from t"""
)
def provenance_terms(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", T.evidence_terms(F.col("text")).alias("t"))
    return c.select("conv_id", "turn", F.size("t").alias("n"), F.array_min("t").alias("first"), F.array_max("t").alias("last"))


@query()
def provenance_select(spark, sf_dir):
    """Which of the documents an answer made of one of them rests on."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("page"), "text")
    first = docs.where("id = 3").select(F.col("text").alias("t")).first()
    return S.provenance(docs, (first.t or "") if first else "")


@query("select doc, page, rank from (select source as doc, lang as page, doc_id as rank, row_number() over (partition by source, lang order by doc_id) as n from documents) where n = 1")
def first_pages(spark, sf_dir):
    return S.first_pages(table(spark, sf_dir, "documents").select(F.col("source").alias("doc"), F.col("lang").alias("page"), F.col("doc_id").alias("rank")))


@query()
def hash_embed(spark, sf_dir):
    """Signed trigram vectors of all documents."""
    from foliant.operators.embed import hash_embedding

    return hash_embedding(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", 64)


@query()
def pca_2d(spark, sf_dir):
    from foliant.operators.embed import projection

    return projection(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


@query("select '__' || label as name, count(*) as points, max(len(embedding))::int as dim from embeddings group by label")
def collections(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.groupBy(F.concat(F.lit("__"), F.col("label").cast("string")).alias("name")).agg(F.count(F.lit(1)).alias("points"), F.max(F.size("embedding")).alias("dim"))


@query(
    """with recursive t as (select least(greatest(1, ceil(length(text) / 2.5::double)), 900)::bigint as l from documents), o as (select l, row_number() over (order by l) as i from t),
    g as (select i, l, 0::bigint as batch, 1 as n from o where i = 1
      union all select o.i, o.l, case when o.l * (g.n + 1) <= 8192 then batch else batch + 1 end, case when o.l * (g.n + 1) <= 8192 then n + 1 else 1 end from g join o on o.i = g.i + 1)
    select batch, count(*) as texts, max(l)::int as longest, sum(l)::bigint as tokens, max(l) * count(*) as padded from g group by batch"""
)
def length_batches(spark, sf_dir):
    """Documents in batches of at most 8192 padded tokens, of like lengths."""
    from foliant.operators.embed import batched

    docs = table(spark, sf_dir, "documents").select("doc_id", T.estimated_tokens(F.col("text")).alias("tokens"))
    b = batched(docs, "doc_id", "tokens", 8192, 900).groupBy("batch")
    made = b.agg(F.count(F.lit(1)).alias("texts"), F.max("length").alias("longest"), F.sum("length").alias("tokens"))
    return made.withColumn("padded", F.col("longest") * F.col("texts"))
