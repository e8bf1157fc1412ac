import numpy as np

from foliant.llm import embedding_dedup


def brute(ids, x, cosine=0.95):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= cosine
    np.fill_diagonal(linked, False)
    label = np.array(ids)
    while True:
        new = np.minimum(label, np.where(linked, label, max(ids)).min(1))
        if (new == label).all():
            return {i: (int(n), int(b)) for i, n, b in zip(ids, linked.sum(1), label)}
        label = new


def found(spark, ids, x, **more):
    df = spark.createDataFrame([(int(i), v.tolist(), 1, "x") for i, v in zip(ids, x)], "vec_id long, embedding array<double>, id int, core string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df, **more).collect()}
    return got


def test_groups_of_copies_near_copies_and_chains(spark, monkeypatch):
    """A third of all rows is one group of near copies and a tenth one vector; small cells, blocks and turns."""
    monkeypatch.setattr(embedding_dedup, "CELL", 16)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 32)
    monkeypatch.setattr(embedding_dedup, "TURN", 2)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 16))
    x[:1000] = x[0] + rng.normal(size=(1000, 16)) * 0.07 * np.linalg.norm(x[0]) / 4
    x[1000:1300] = 3 * x[1000]
    x[1300:1400] = x[1300] * rng.uniform(0.1, 9, (100, 1))
    for i in range(1400, 1480):  # a chain: each links with the one before
        x[i] = x[i - 1] + rng.normal(size=16) * 0.2 * np.linalg.norm(x[i - 1]) / 4
    ids = rng.permutation(3000) - 500
    got, want = found(spark, ids, x), brute(ids, x)
    assert got.keys() == want.keys()
    n = sum(w for w, _ in want.values())
    assert sum(g for g, _ in got.values()) >= 0.99 * n and all(got[i][0] <= want[i][0] for i in want)
    assert np.mean([got[i] == want[i] for i in want]) > 0.98


def test_recall_at_the_least_cosine(spark):
    """Every pair has just over the least cosine in a drawn direction: what the margin is fitted for."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    u = rng.normal(size=x.shape)
    u -= (u * x).sum(1, keepdims=True) * x
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    both = np.concatenate([x, 0.951 * x + np.sqrt(1 - 0.951**2) * u])
    got = found(spark, np.arange(8000), both)
    assert np.mean([got[i + 4000] == (1, i) and got[i] == (1, i) for i in range(4000)]) > 0.98
    below = np.concatenate([x, 0.949 * x + np.sqrt(1 - 0.949**2) * u])
    assert all(n == 0 and i == label for i, (n, label) in found(spark, np.arange(8000), below).items())


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(5, [1.0, 0.0]), (3, [2.0, 0.0]), (9, [1e200, 1e-3]), (10, [1e-200]), (4, None), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (11, [None, 1.0]), (None, [1.0, 0.0]), (12, []), (3, [2.0, 0.0]), (13, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df).collect()}
    want = {i: (0, i, True) for i in (4, 6, 7, 8, 11, 12, 13)}
    assert got == {**want, 3: (3, 3, True), 5: (3, 3, False), 9: (3, 3, False), 10: (3, 3, False)}
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0
    assert [tuple(r) for r in embedding_dedup.near_duplicates(df.where("vec_id = 4")).collect()] == [(4, 0, 4, True)]
