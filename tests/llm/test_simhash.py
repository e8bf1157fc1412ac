import hashlib
import random

import numpy as np
import pyarrow as pa

from foliant.llm import simhash


def test_edited_texts_and_next(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(spark.createDataFrame([(5000, None), (5001, ""), (5002, "één wörd 日本")], "doc_id long, text string"), allowMissingColumns=True)
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    got = {r.doc_id: r for r in simhash.edited(docs).collect()}
    assert len(got) == len(rows)
    prints = simhash.fingerprints(pa.array([t for _, t in rows]))
    for i, (doc, text) in enumerate(rows):
        follow = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        new = text[: len(text) - half] + follow[:half]
        r = got[doc]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert r.fingerprint == prints[i].tobytes().hex()
        assert r.edited_fingerprint == simhash.fingerprints(pa.array([new]))[0].tobytes().hex()
        assert r.near_next == simhash.likeness(prints[i : i + 1], prints[(i + 1) % len(rows)][None])[0]
    long = [r for r in got.values() if r.n_chars > 800]
    assert np.mean([r.near_edited for r in long]) > np.mean([r.near_next for r in long]) + 0.1


def test_single_document_and_none(spark):
    one = spark.createDataFrame([(7, "a b c d e f")], "doc_id long, text string")
    assert simhash.edited(one).first().near_next == 1.0
    assert simhash.edited(one.limit(0)).count() == 0


def test_all_within_the_radius(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(128) for _ in range(60)]
    known = set(base)
    for b in base:
        for _ in range(3):
            x = b
            for bit in rng.sample(range(128), rng.randrange(1, 6)):
                x ^= 1 << bit
            known.add(x)
    want = {(a, b) for a in known for b in known if a < b and (a ^ b).bit_count() <= 3}
    df = spark.createDataFrame([(f"{x:032x}",) for x in known] + [(None,)], "fingerprint string")
    for blocks in (None, 6):
        assert {(int(r.a, 16), int(r.b, 16)) for r in simhash.near_fingerprints(df, 3, blocks).collect()} == want


def test_votes_one_by_one():
    """Each shingle, as often as it occurs, votes on every bit: for it where its hash has a one, else against it."""
    from collections import Counter

    from foliant.llm.words import find_words, hash_words, mix, shingles

    rng = random.Random(8)
    texts = ["", " ", "one", "a b c d", "a b c d e", "x y z x y z x y z x y z"] + [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(rng.randrange(1, 60))) for _ in range(20)]

    def hashes(text):
        data = np.frombuffer(text.encode(), np.uint8)
        starts, ends, ranges = find_words(data, np.array([0, len(data)]))
        h, _ = shingles(hash_words(data, starts, ends), ranges, 5)
        words = text.split()
        assert len(h) == (max(len(words) - 4, 1) if words else 0)
        return h

    known = {}  # equal runs of words have equal hashes, others don't
    for t in texts:
        words, h = t.split(), hashes(t)
        for i, x in enumerate(h):
            assert known.setdefault(tuple(words[i : i + 5]), int(x)) == int(x)
    assert len(set(known.values())) == len(known)
    for t, got in zip(texts, simhash.fingerprints(pa.array(texts))):
        votes = [0] * simhash.BITS
        for x, n in Counter(hashes(t).tolist()).items():
            x = np.uint64(x)
            both = int(x).to_bytes(8, "little") + int(mix(np.array([x ^ np.uint64(0xA5A5A5A5A5A5A5A5)]))[0]).to_bytes(8, "little")
            for bit in range(simhash.BITS):
                votes[bit] += n if both[bit // 8] >> (7 - bit % 8) & 1 else -n
        assert [int(b) for b in np.unpackbits(got)] == [int(v > 0) for v in votes]


def test_clashing_names_repeats_and_none(spark):
    rows = [(1, "a b", "x", 0), (1, "a b", "y", 1), (2, None, "x", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, part int")
    got = [(r.doc_id, r.fingerprint) for r in simhash.fingerprint(df).collect()]
    one = simhash.fingerprints(pa.array(["a b", ""]))
    assert sorted(got) == sorted([(1, one[0].tobytes().hex())] * 2 + [(2, one[1].tobytes().hex())])
    assert simhash.near_fingerprints(df.limit(0).select("fingerprint")).count() == 0
