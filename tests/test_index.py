import math
import re

import pytest
from pyspark.sql import functions as F

from foliant.operators.index import Index

TEXTS = {1: "red fish blue fish", 2: "blue sea", 3: "red red wine", 4: "", 5: None, 6: "green sea fish"}


def bm25(texts, terms):
    words = {i: (t or "").split() for i, t in texts.items()}
    n, average = len(words), sum(map(len, words.values())) / len(words)
    out = {}
    for t in set(terms):
        df = sum(t in w for w in words.values())
        for i, w in words.items():
            if t in w:
                out[i] = out.get(i, 0) + math.log(1 + (n - df + 0.5) / (df + 0.5)) * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / average))
    return {i: round(s, 9) for i, s in out.items()}


def scores(index, terms):
    return {r.id: round(r.score, 9) for r in index.bm25(terms).collect()}


@pytest.fixture
def index(spark, tmp_path):
    made = Index.create(spark, str(tmp_path / "index"), doc_type="long", payload="kind string", model="m", query_prefix="q: ")
    rows = [(i, i // 2, t, "odd" if i % 2 else "even", [1.0, i / 4] if i != 2 else None) for i, t in TEXTS.items()]
    made.add(spark.createDataFrame(rows, "id long, doc long, text string, kind string, vector array<double>"))
    return made


def test_only_asked_buckets_are_read(spark, index):
    assert scores(index, ["red", "fish", "none"]) == bm25(TEXTS, ["red", "fish", "none"])
    df = index.postings(["red"])
    df.collect()
    scan = df._jdf.queryExecution().executedPlan().toString()
    assert re.search(rf"PartitionFilters: \[[^\]]*bucket#\d+ = {index._bucket('red')}\b", scan), scan
    again = Index(spark, index.folder)
    assert (again.model, again.query_prefix) == ("m", "q: ")


def test_documents_are_replaced(spark, index):
    index.add(spark.createDataFrame([(7, 1, "fish and chips", "odd", None)], "id long, doc long, text string, kind string, vector array<double>"))
    now = {i: t for i, t in TEXTS.items() if i // 2 != 1} | {7: "fish and chips"}
    assert scores(index, ["red", "fish", "sea"]) == bm25(now, ["red", "fish", "sea"])
    index.add(spark.createDataFrame([(7, 1, "sea", "odd", None), (9, 9, "sea sea", "odd", None)], "id long, doc long, text string, kind string, vector array<double>"))
    now |= {7: "sea", 9: "sea sea"}
    assert scores(index, ["red", "fish", "sea"]) == bm25(now, ["red", "fish", "sea"])
    assert {r.id for r in index.chunks().collect()} == set(now)


def test_stages_of_a_search(spark, index):
    hits = index.search(["fish", "red"], [0.0, 1.0], 3)
    rows = hits.rows.orderBy("rank").collect()
    assert hits.notes == [] and [r["rank"] for r in rows] == [1, 2, 3]
    for r in rows:
        assert abs(r.fused - sum(1 / (60 + x) for x in (r.dense_rank, r.lexical_rank) if x)) < 1e-12 and r.score == r.fused
    only = index.search(["fish"], [0.0, 1.0], 3, where=F.col("kind") == "even").rows.collect()
    assert {r.id for r in only} <= {2, 4, 6} and next(r for r in only if r.id == 6).lexical_rank == 1
    again = index.search(["fish", "red"], None, 2, "lexical", rerank=lambda some: some.select("id", (-F.col("id").cast("double")).alias("rerank")))
    assert [(r.id, r.rerank) for r in again.rows.orderBy("rank").collect()] == [(1, -1.0), (3, -3.0)]
    bare = index.search(["fish"], None, 2)
    assert bare.notes == ["the index has no vectors for this search"] and bare.rows.count() == 2
    assert index.search(["nothing"], None, 2, "lexical").rows.count() == 0
    with pytest.raises(ValueError):
        index.search(["fish"], None, 2, "other")


def test_terms_are_counted_where_they_are(spark, tmp_path):
    from foliant.functions import text as T

    texts = ["a b a", "", "b", "z " * 300 + "a b a"]
    made = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.counted_terms(T.search_terms(F.col("t"))).alias("c"))
    for r in made.collect():
        assert [tuple(x) for x in r.c] == sorted((w, r.t.split().count(w)) for w in set(r.t.split()))
    many = Index.create(spark, str(tmp_path / "many"))
    many.add(spark.range(50).selectExpr("id", "cast(id as string) doc", "concat('a b a c', id) text"))
    terms = spark.read.parquet(f"{many.folder}/chunks/gen=0").schema["terms"].dataType.simpleString()
    assert terms == "array<struct<term:string,tf:bigint>>" and many.postings(["a"]).agg({"tf": "sum"}).first()[0] == 100
