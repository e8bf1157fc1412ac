"""Boundaries and ids against the libraries, decoding by round trip."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from foliant.llm import byte_bpe
from foliant.llm.pretokens import LETTER, NUMBER, OTHER, pieces, tables

PATH = P.path("byte_bpe_50k.tiktoken")
ALPHABET = "aslrvetmdSé日 \t\n 　'’0٣.!-😀"


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def cut(texts):
    data = [t.encode() for t in texts]
    offs = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
    flat = b"".join(data)
    starts, ends, ranges = pieces(np.frombuffer(flat, np.uint8), offs)
    return [[flat[a:b].decode() for a, b in zip(starts[r:s], ends[r:s])] for r, s in zip(ranges, ranges[1:])]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(ALPHABET, max_size=24), min_size=1, max_size=6))
def test_pieces_match_the_pattern(texts):
    assert cut(texts) == [regex.findall(P.PATTERN, t) for t in texts]


def test_classes_match_the_library():
    kinds, _ = tables()
    codec = library()
    # a code point that the library joins to a letter is one; only assigned ones matter
    for cp in random.Random(1).sample(range(0x80, 0x3000), 1500):
        ch = chr(cp)
        text = f"x{ch}x0{ch}0!{ch}!"
        assert codec.encode_ordinary(text) == _ids(text), hex(cp)
    assert kinds[ord("a")] == LETTER and kinds[ord("7")] == NUMBER and kinds[ord("!")] == OTHER


def _ids(text):
    ranks = byte_bpe.Ranks.load(PATH)
    data = np.frombuffer(text.encode(), np.uint8)
    return byte_bpe.Encoder(ranks.merge)(data, np.array([0, len(data)]))[0].tolist()


def test_long_pieces():
    codec = library()
    for text in ("a" * 3000, "ab" * 400 + "'" * 90 + "'s", " " * 500 + "x", "=" * 100, "Überraschung" * 9):
        assert _ids(text) == codec.encode_ordinary(text)


def test_documents(spark, sf):
    codec = library()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(None, "it's"), (-1, None), (-2, ""), (-2, "")], "doc_id long, text string")
    docs = docs.select("doc_id", "text", "source").unionByName(extra, allowMissingColumns=True)
    want = sorted(((r.doc_id, *_row(codec, r.text or "")) for r in docs.collect()), key=str)
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.encode(docs, PATH).collect()), key=str)
    assert got == want


def _row(codec, text):
    ids = codec.encode_ordinary(text)
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def test_offsets_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "Où est l'été?")], "doc_id long, text string")
    r = byte_bpe.encode(docs, PATH, keep_ids=True).first()
    tokens = byte_bpe.Ranks.load(PATH).bytes
    raw = "Où est l'été?".encode()
    assert all(raw[o : o + len(tokens[i])] == tokens[i] for i, o in zip(r.ids, r.offsets))
    assert byte_bpe.encode(docs.limit(0), PATH).count() == 0
