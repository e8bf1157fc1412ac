"""Both substring operators against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa

from foliant.llm import substring_dedup, suffix_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus():
    rng = random.Random(5)
    words = ["alpha", "été", "the", "of", "x", "naïve", "b", "longerword", "日本", "end."]
    passage = " ".join(rng.choice(words) for _ in range(60))
    texts = []
    for i in range(60):
        body = [rng.choice(words) + str(rng.randrange(30)) for _ in range(rng.randrange(0, 150))]
        if i % 3 == 0:
            at = rng.randrange(len(body) + 1)
            body[at:at] = passage.split()[rng.randrange(10) : rng.randrange(40, 60)]
        texts.append(" ".join(body))
    texts += [texts[0], texts[3], "er " * 200, "er " * 90, "", None, "a" * 5000, "\t\n ", "short one"]
    near = texts[6].split()
    for k in range(6):
        copy = list(near)
        for _ in range(3):
            copy[rng.randrange(len(copy))] = f"edit{k}"
        texts.append(" ".join(copy))
    return [(i * 3 - 20, t, "extra") for i, t in enumerate(texts)]


def brute_bytes(rows, length):
    seen, out = set(), {}
    for doc, text, *_ in sorted(rows, key=lambda r: r[0]):
        b = (text or "").encode()
        cover = [False] * len(b)
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            if s in seen:
                cover[i : i + length] = [True] * length
            seen.add(s)
        spans = sum(c and (i == 0 or not cover[i - 1]) for i, c in enumerate(cover))
        out[doc] = (len(b), sum(cover), spans, hashlib.sha256(bytes(x for x, c in zip(b, cover) if not c)).hexdigest())
    return out


def brute_words(rows, window):
    count = {}
    for _, text, *_ in rows:
        w = WORD.findall(text or "")
        for i in range(len(w) - window + 1):
            count[tuple(w[i : i + window])] = count.get(tuple(w[i : i + window]), 0) + 1
    out = []
    for doc, text, *_ in rows:
        w = WORD.findall(text or "")
        cover = [False] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                cover[i : i + window] = [True] * window
        out.append((doc, len(w), sum(cover), hashlib.sha256(" ".join(x for x, c in zip(w, cover) if not c).encode()).hexdigest()))
    return sorted(out, key=str)


def test_bytes_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string")
    for length in (100, 37):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_earlier(docs, length).collect()}
        assert got == brute_bytes(rows, length)


def test_bytes_where_ranges_are_dealt_to_several_buckets(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "RANGES", 8)
    monkeypatch.setattr(suffix_dedup, "SPLIT_TEXTS", 20)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_earlier(docs, 100).collect()}
    assert got == brute_bytes(rows, 100)


def test_order_against_a_plain_suffix_sort():
    rng = np.random.default_rng(4)
    text = bytes(rng.integers(0, 3, 700, np.uint8)) + b"\x00\x01" * 90 + bytes(40)
    rows = np.stack([np.frombuffer((text[i:] + bytes(100))[:100], np.uint8) for i in range(len(text))])
    order, common = suffix_dedup.byte_order(rows)
    suffixes = [(text[i:] + bytes(100))[:100] for i in range(len(text))]
    assert order.tolist() == sorted(range(len(text)), key=lambda i: (suffixes[i], i))
    for depth in (1, 7, 70, 100):
        names = sorted({s[:depth] for s in suffixes})
        assert (suffix_dedup.ranks(order, common, depth) - 1).tolist() == [names.index(s[:depth]) for s in suffixes]


def test_words_against_brute_force(spark):
    rows = corpus() + [(None, "n u l l " * 12, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string")
    for window, anchor in ((35, 7), (12, 3)):
        got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeated(docs, window, anchor).collect()), key=str)
        assert got == brute_words(rows, window)


def test_equal_rows_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([(1, text), (1, text), (2, "other words"), (2, text[:300])], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.remove_repeated(docs).collect())
    assert got[:2] == [(1, 80, 80), (1, 80, 80)] and got[2] == (2, 2, 0) and got[3][2] > 35
    got = sorted(r.n_removed for r in suffix_dedup.remove_earlier(docs).collect())
    assert got == [0, 0, 300, len(text)]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.remove_earlier(docs).count() == 0
    assert substring_dedup.remove_repeated(docs).count() == 0


def test_sample_positions_take_little_memory():
    """Only sample positions are held, not numbers for each byte of the texts."""
    import tracemalloc

    rng = np.random.default_rng(3)
    for length in (10, 100, 300):
        period = suffix_dedup.period_for(length)
        texts = ["x" * int(n) for n in [0, 1, length - 1, length, length + 1, *rng.integers(0, 900, 60)]]
        s = suffix_dedup._Slice(pa.RecordBatch.from_arrays([pa.array(texts)], ["text"]), length, period)
        want = [(i, p) for i, t in enumerate(texts) for p in range(len(t) - (length - period)) if len(t) >= length and p % period in suffix_dedup.COVERS[period]]
        assert list(zip(s.text.tolist(), s.local.tolist())) == want and (s.at == s.offs[s.text] + s.local).all()
    batch = pa.RecordBatch.from_arrays([pa.array(["y" * 2000] * 500)], ["text"])
    tracemalloc.start()
    suffix_dedup._Slice(batch, 100, 31)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 16 * 1_000_000
