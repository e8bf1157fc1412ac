import numpy as np

from foliant.llm import additive


def brute(ids, x, every, k):
    x = x.astype(float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = unit @ unit[i]
        rest = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out[ids[i]] = [(int(ids[j]), s[j]) for j in rest]
    return out


def test_recall_and_scores(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows])
    want = brute(ids, x, 50, 5)
    got = {}
    for r in additive.nearest(df).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert got.keys() == want.keys() and all(sorted(g) == [1, 2, 3, 4, 5] for g in got.values())
    where = {v: i for i, v in enumerate(ids)}
    hits = 0
    for q, g in got.items():
        hits += len({v for v, _ in g.values()} & {v for v, _ in want[q]})
        for v, s in g.values():
            a, b = x[where[q]].astype(float), x[where[v]].astype(float)
            assert abs(s - a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)) < 1e-12
        assert [s for _, s in (g[i] for i in range(1, 6))] == sorted((s for _, s in g.values()), reverse=True)
    assert hits / (5 * len(want)) >= 0.9


def test_odd_vectors_ties_and_few(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [3.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (None, [1.0, 1.0]), (50, []), (100, [0.0, 5.0]), (1, [2.0, 0.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int")
    got = [(r.query_id, r["rank"], r.vec_id) for r in additive.nearest(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 100), (100, 1, 0), (100, 2, 1), (100, 3, 2)]
    assert additive.nearest(df.limit(0)).count() == 0
    assert additive.nearest(df.where("vec_id = 1")).count() == 0


def test_more_copies_than_candidates(spark):
    """Of 900 equal vectors the least ids come first, for a query among them and for one near them."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1200, 8)).astype(np.float32)
    x[300:] = x[300]
    x[50] = x[300] + np.float32(0.01)
    order = rng.permutation(1200)
    df = spark.createDataFrame([(int(i), x[i].tolist()) for i in order], "vec_id long, embedding array<float>").coalesce(1)
    got = {}
    for r in additive.nearest(df, every=50).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.vec_id
    assert [got[300][i] for i in range(1, 6)] == [301, 302, 303, 304, 305]
    assert [got[1150][i] for i in range(1, 6)] == [got[50][i] for i in range(1, 6)] == [300, 301, 302, 303, 304]


def test_many_near_copies_and_one_ray(spark):
    """900 vectors of one direction with differing lengths, then 900 within quantisation error: the exact five come."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=(1200, 16))
    for near in (False, True):
        x = base.copy()
        x[300:] = x[300] + rng.normal(size=(900, 16)) * 1e-4 if near else x[300] * rng.uniform(0.5, 2, (900, 1))
        df = spark.createDataFrame([(int(i), x[i].tolist()) for i in rng.permutation(1200)], "vec_id long, embedding array<double>").coalesce(1)
        got = {}
        for r in additive.nearest(df, every=50).collect():
            got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
        for q in range(300, 1200, 50):
            s = additive._cosines(np.broadcast_to(x[q], x.shape), x)
            want = [int(i) for i in np.lexsort((np.arange(1200), -s)) if i != q][:5]
            assert [got[q][i] for i in range(1, 6)] == want
