import math

import numpy as np

from foliant.llm import hard_negatives
from foliant.llm.queries import ORACLES, QUERIES
from tests.compare import differences


def brute(rows, every=100, k=5):
    known = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        known[i] = max(known.get(i, (label, v)), (label, v))
    known = {i: ((label + 1) % 10 if i % 7 == 0 else label, [hard_negatives._whole(x) for x in v]) for i, (label, v) in known.items()}
    out = []
    for a, (label, v) in known.items():
        if a % every:
            continue
        score = {i: sum(p * q for p, q in zip(v, w)) for i, (_, w) in known.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if known[i][0] == label][:k]:
            fits = [i for i in order if known[i][0] != label and 80 * score[p] <= 100 * score[i] <= 100 * score[p]][:k]
            out += [(a, p, n + 1, i, score[p], score[i]) for n, i in enumerate(fits)]
    return sorted(out)


def mined(df, **more):
    got = hard_negatives.mine(df, **more)
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got.collect())


SCHEMA = "vec_id long, embedding array<double>, label int, rank string, tile int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def test_query_equals_sql(spark):
    assert differences(spark, "/root/testdata/sf0.1", QUERIES["op12_hard_negatives"], ORACLES["op12_hard_negatives"]) is None


def test_ties_labels_and_many_blocks(spark, monkeypatch):
    """Coarse components give many equal scores; a third of all rows are one vector; blocks are small."""
    monkeypatch.setattr(hard_negatives, "ROW_BLOCK", 64)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 2)
    monkeypatch.setattr(hard_negatives, "TILE", 3)
    rng = np.random.default_rng(1)
    x = rng.integers(-3, 4, (900, 4)) / 4
    x[300:600] = x[300]
    rows = [(int(i), x[i].tolist(), int(rng.integers(0, 4))) for i in rng.permutation(900)]
    got = mined(frame(spark, rows), every=50)
    assert got == brute(rows, 50) and len(got) > 100


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 3), (100, [1.0, 0.5], 4), (1, [1.0, 0.5], 4), (2, [1.0], 4), (3, [0.9, 0.5], 5), (4, [], 4), (5, None, 4), (6, [nan, 1.0], 4), (8, [inf, 1.0], 4), (9, [None, 1.0], 4), (10, [1.0, 0.4], None)]
    rows += [(None, [1.0, 0.5], 4), (11, [0.85, 0.5, 9.0], 6), (1, [1.0, 0.5], 4), (1, [0.7, 0.5], 2), (-7, [1.0, 0.45], 4), (200, [-1.0, 0.0], 9)]
    assert mined(frame(spark, rows)) == brute(rows)
    assert mined(frame(spark, [])) == []
    assert mined(frame(spark, [(100, [1.0], 1)])) == []
    assert mined(frame(spark, [(1, [1.0], 1), (2, [1.0], 1)])) == []


def test_negative_scores_and_large_numbers(spark):
    rows = [(100, [-1.0, 0.0], 1), (1, [0.5, 0.0], 1), (2, [0.55, 0.0], 2), (3, [0.5, 1.0], 2)]
    assert mined(frame(spark, rows)) == brute(rows)
    wide = [(100, [3e5, 1e5], 1), (1, [2.5e5, 7e4 + 0.3], 1), (2, [2.4e5, 7e4], 2), (3, [2.5e5, 7e4 + 0.299], 2), (4, [1e5, 0.0], 2)]
    assert mined(frame(spark, wide)) == brute(wide)
    assert hard_negatives.scores(np.array([[1e300]]), np.array([[1e10], [-1e300]])).tolist() == [[2**63 - 1, -(2**63)]]
