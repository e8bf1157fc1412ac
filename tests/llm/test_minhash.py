import collections
import math
import random
import re

import numpy as np

from foliant.llm import minhash
from foliant.llm.components import components


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def weighed(texts):
    """TF-IDF weights of five-word shingles in quarters, from their definition."""
    counts = []
    for text in texts:
        w = WORD.findall(text)
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []
        counts.append(collections.Counter(grams))
    df = collections.Counter(g for x in counts for g in x)
    idf = {g: round(4 * max(math.log((1 + len(texts)) / (1 + n)) + 1, 1)) for g, n in df.items()}
    return [{g: n * idf[g] for g, n in x.items()} for x in counts]


def brute(docs, threshold=0.8):
    """Classes by comparing all pairs that share a shingle, in plain Python."""
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    maps = weighed([t for _, t in rows])
    where = {}
    for i, m in enumerate(maps):
        for k in m:
            where.setdefault(k, []).append(i)
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    first = {}
    for i, (_, text) in enumerate(rows):
        parent[root(i)] = root(first.setdefault(text, i))
    for i, m in enumerate(maps):
        for j in {j for k in m for j in where[k] if j < i}:
            least = sum(min(v, maps[j].get(k, 0)) for k, v in m.items())
            if least >= threshold * (sum(m.values()) + sum(maps[j].values()) - least):
                parent[root(i)] = root(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(root(i), set()).add(d)
    return {frozenset(g) for g in groups.values()}


def test_classes_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source")
    odd = [(5000, None), (5001, ""), (5002, "a b"), (5003, "a  b"), (5004, "b a"), (5005, " \n")]
    docs = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string"), allowMissingColumns=True)
    found = minhash.near_duplicates(docs).collect()
    groups = {}
    for r in found:
        groups.setdefault(r.class_id, set()).add(r.doc_id)
    assert {frozenset(g) for g in groups.values()} == brute(docs)
    assert all(r.class_size == len(groups[r.class_id]) and r.class_id == min(groups[r.class_id]) for r in found)


def test_samples_estimate_weighted_jaccard():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 1 << 63, 900, np.uint64)
    a, b = np.arange(600), np.arange(200, 900)
    wa, wb = rng.integers(4, 60, 900), rng.integers(4, 60, 900)
    sampler = minhash.Sampler(4000)
    sa, sb = (sampler(h[i], w[i], np.array([0]))[0] for i, w in ((a, wa), (b, wb)))
    x, y = np.zeros(900), np.zeros(900)
    x[a], y[b] = wa[a], wb[b]
    assert abs((sa == sb).mean() - np.minimum(x, y).sum() / np.maximum(x, y).sum()) < 0.03


def test_repeated_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "x y"), (2, "x y")], "doc_id long, text string")
    got = sorted(r.class_size for r in minhash.near_duplicates(docs).collect())
    assert got == [2, 2, 2, 2]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_bridges_and_a_long_text(spark):
    """Drifting versions join into one class, a very long text is compared whole, and one word in many splits no class."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(10_000)}" for _ in range(400)]
    rows, now = [], list(base)
    for i in range(30):
        rows.append((i, " ".join(now)))
        for _ in range(3):
            now[rng.randrange(400)] = f"n{rng.randrange(10_000)}"
    long = [f"v{rng.randrange(50_000)}" for _ in range(200_000)]
    rows += [(100, " ".join(long)), (101, " ".join(long[:-9]) + " end"), (102, " ".join(long[:120_000]))]
    rows += [(200 + i, " ".join(f"x{rng.randrange(10_000)}" for _ in range(60))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    groups = {}
    for r in minhash.near_duplicates(docs).collect():
        groups.setdefault(r.class_id, set()).add(r.doc_id)
    assert {frozenset(g) for g in groups.values()} == brute(docs)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r.id: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}


def test_components_of_a_long_path_in_any_order(spark):
    ids = list(range(300))
    random.Random(3).shuffle(ids)
    edges = list(zip(ids, ids[1:])) + [(1000 + a, 1000 + b) for a, b in ((1, 9), (2, 9), (3, 8), (8, 2))]
    got = {r.id: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(300), 0), **{1000 + i: 1001 for i in (1, 2, 3, 8, 9)}}
