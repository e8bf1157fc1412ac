import hashlib
import re
from collections import Counter

import corpus_pipeline as p

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def stages(spark, docs, sf):
    out = [docs]
    for _, f in p.STAGES:
        out.append(f(spark, out[-1], sf))
        out[-1], _ = p.common.stored(out[-1], "test")
    return out


def test_each_stage(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = [(9000, None, "en", "s", 0), (9001, "123 456", "en", "s", 7), (9002, "", None, None, 0)]
    docs = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long")).selectExpr("*", "1 as row", "'x' as part")
    start, lang, near, cut, mixed, tokens = stages(spark, docs, sf)
    for df in (lang, near, cut, mixed):
        assert tuple(df.columns) == p.COLUMNS
    texts = {r.doc_id: r.text for r in start.collect()}
    kept = {r.doc_id for r in lang.collect()}
    assert not kept & {9000, 9001, 9002} and len(texts) - len(kept) <= 5
    reps = {r.doc_id: r.text for r in near.collect()}
    assert len(set(reps.values())) == len(reps) and reps.keys() <= kept
    assert {texts[d] for d in kept} >= set(reps.values())
    count = Counter()
    for t in reps.values():
        w = WORD.findall(t)
        count.update(tuple(w[i : i + p.WINDOW]) for i in range(len(w) - p.WINDOW + 1))
    for r in cut.collect():
        w = WORD.findall(reps[r.doc_id])
        gone = [False] * len(w)
        for i in range(len(w) - p.WINDOW + 1):
            if count[tuple(w[i : i + p.WINDOW])] > 1:
                gone[i : i + p.WINDOW] = [True] * p.WINDOW
        want = " ".join(x for x, g in zip(w, gone) if not g) if any(gone) else reps[r.doc_id]
        assert r.text == want and r.n_chars == len(want)
    rows = Counter(r.doc_id for r in mixed.collect())
    assert max(rows.values()) <= 3 and set(rows) <= {r.doc_id for r in cut.collect()}
    cuts = {r.doc_id: r.text for r in cut.collect()}
    got = tokens.collect()
    assert Counter(r.doc_id for r in got) == rows
    assert all(r.decoded_sha256 == hashlib.sha256(cuts[r.doc_id].encode()).hexdigest() and len(r.ids) == r.n_tokens for r in got)


def test_repeated_and_null_ids(spark, sf):
    words = " ".join(f"mot{i} word{i}" for i in range(60))
    rows = [(1, words, "en", "a", 1), (1, words, "en", "a", 1), (1, "the cat sat on the mat", "en", "a", 1), (None, "un chat noir et blanc", "fr", None, 1), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    near = p.near_duplicates(spark, docs, sf)
    assert sorted(map(repr, ((r.doc_id, r.text) for r in near.collect()))) == sorted(map(repr, [(1, words), rows[2][:2], rows[3][:2], (None, None)]))
    assert p.mixture(spark, docs, sf).count() >= 2
    assert {r.text for r in p.substrings(spark, docs, sf).collect()} == {rows[2][1], rows[3][1], ""}
    empty = docs.limit(0)
    for _, f in p.STAGES:
        assert f(spark, empty, sf).count() == 0
