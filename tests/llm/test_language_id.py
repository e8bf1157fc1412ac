import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from foliant.llm import common as c
from foliant.llm import language_id as li


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = li.identify(docs, li.learn(docs)).collect()
    assert len(got) == len(truth)
    out = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in out]) > 0.97
    assert sum(r.rejected for r in got) <= 5 and all(0 <= r.score <= 1 for r in got)


def test_odd_texts(spark):
    docs = spark.createDataFrame([(i, t, "en" if i % 2 else "fr", 1) for i, t in enumerate(["the cat sat", "le chat est", "with the", "où est le chat"] * 8)] + [(90, None, "en", 1), (91, "123 !!", None, 1), (None, "the", "en", 1), (93, "", "de", 1)], "doc_id long, text string, lang string, score int")
    got = {(r.doc_id, r.lang_pred, r.score > 0) for r in li.identify(docs, li.learn(docs)).collect()}
    assert {(90, "und", False), (91, "und", False), (93, "und", False)} <= got
    none = docs.limit(0)
    assert {r.lang_pred for r in li.identify(docs, li.learn(none)).collect()} == {"und"}
    assert li.identify(none, li.learn(docs)).count() == 0


def test_many_copies_of_few_texts(spark):
    """A language is learned however many copies its texts have, also if their digests are the greatest of all."""
    some = spark.createDataFrame([(f"tämä on lause numero {'abcdefghij'[i % 10] * 3} {'klmnopqrst'[i // 10] * 3}",) for i in range(100)], "text string")
    few = [r.text for r in some.orderBy(F.xxhash64("text").desc()).limit(3).collect()]
    rows = [(i, few[i % 3], "fi") for i in range(5000)] + [(5000 + i, f"the cat number {i} sat on the mat", "en") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = li.learn(docs)
    assert model.langs == ["en", "fi"]
    assert all(r.lang_pred == "fi" for r in li.identify(docs.where("lang = 'fi'"), model).collect())


def test_probabilities_against_plain_kneser_ney():
    texts = ["abra cadabra", "a bar", "barb", "cab"]
    s, ranges, _ = li.symbols(*c.flat(pa.array(texts)))
    seqs = [s[a:b].tolist() for a, b in zip(ranges, ranges[1:])]
    rows = {}
    at, text, hashes = li.gram_hashes(s, ranges, li.ORDER)
    for k in range(1, li.ORDER + 1):
        for i in at:
            key = (0, k, *(int(h.view(np.int64)[j]) for h, j in ((hashes[k], i), (hashes[k - 1], i - 1), (hashes[k - 1], i))))
            rows[key] = rows.get(key, 0) + 1
    table = pa.table({n: [r[i] for r in ((*k, v) for k, v in rows.items())] for i, n in enumerate(("lang", "size", "gram", "context", "suffix", "n"))})
    model = li.build(["x"], table)
    D = li.DISCOUNT

    def runs(k):
        return [(tuple(q[max(0, i - k + 1) : i]), q[i]) for q in seqs for i in range(1, len(q))]

    def p(k, h, ch):
        if k == 0:
            return model.uniform
        h = h[-(k - 1) :] if k > 1 else ()
        if k == li.ORDER:
            n = {}
            for g in runs(k):
                n[g] = n.get(g, 0) + 1
        else:
            longer = set(runs(k + 1))
            n = {}
            for g, x in longer:
                n[(g[-(k - 1) :] if k > 1 else (), x)] = n.get((g[-(k - 1) :] if k > 1 else (), x), 0) + 1
        total = sum(v for (g, _), v in n.items() if g == h)
        if not total:
            return p(k - 1, h, ch)
        kinds = sum(1 for g, _ in n if g == h)
        return max(n.get((h, ch), 0) - D, 0) / total + D * kinds / total * p(k - 1, h, ch)

    test = "cabra bad"
    h, _ = model.entropies(*c.flat(pa.array([test])))
    q, _, _ = li.symbols(*c.flat(pa.array([test])))
    q = q.tolist()
    want = -np.mean([np.log(p(li.ORDER, tuple(q[max(0, i - 3) : i]), q[i])) for i in range(1, len(q))])
    assert abs(h[0, 0] - want) < 1e-4
