import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from foliant.llm import alignment

A, B = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def brute(rows):
    """Whole texts through both libraries, links and counts one by one."""
    library = Tokenizer.from_file(A)
    library.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in printable}
    byte.update({chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in printable)})
    pieces = sentencepiece.SentencePieceProcessor(model_file=B)
    made, count = [], Counter()
    for doc, text in rows:
        if not text:
            made.append((doc, [], [], [], ""))
            continue
        a, b = library.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)
        of_a = [bytes(byte[x] for x in library.id_to_token(i)) for i in a]
        of_b = [bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if b"".join(of_a) != (" " + text).encode() or b"".join(of_b) != (" " + text).encode():
            made.append((doc, [], [], [], ""))
            continue
        links, groups, i, j, x, y, ga, gb = [], [], 0, 0, 0, 0, [], []
        while i < len(a) or j < len(b):
            if x <= y and i < len(a):
                x, ga, i = x + len(of_a[i]), [*ga, a[i]], i + 1
            else:
                y, gb, j = y + len(of_b[j]), [*gb, b[j]], j + 1
            if x == y:
                links.append((ga[-1], gb[-1]))
                groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
                ga, gb = [], []
        count.update(links)
        made.append((doc, a, b, links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    return sorted(((doc, len(a), len(b), len(links), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), digest) for doc, a, b, links, digest in made), key=repr)


def aligned(df):
    return sorted((tuple(r[x] for x in alignment._names(alignment.RESULT)) for r in alignment.align(df, A, B).collect()), key=repr)


ODD = [
    (1, None), (2, ""), (3, " "), (4, "  a  b "), (5, "▁x"), (6, "a ▁ b"), (7, "<|endoftext|> <s></s> <0x41>"), (8, "日本語 🙂🙂 é́"), (9, "a\n\n\tb\r\n c\x00d"), (None, "null id, don't we'll"),
    (10, "again and again"), (10, "again and again"), (11, "x" * 5000), (12, "word " * 20000), (13, " " * 300), (14, "　wide space"), (15, "’quotes’ — dashes"), (16, "ﷺ ½ Ⅷ"),
]


@pytest.mark.parametrize("small", [False, True])
def test_equals_whole_texts_one_by_one(spark, sf, monkeypatch, small):
    """small: slices of few texts, every bucket dealt to several streams, totals sent on early."""
    if small:
        monkeypatch.setattr(alignment, "SLICE_BYTES", 20000)
        monkeypatch.setattr(alignment, "STREAM", 50)
        monkeypatch.setattr(alignment, "GATHERED", 1000)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(None if i is None else i + 10**6, t) for i, t in ODD], "doc_id long, text string")
    df = docs.unionByName(odd).selectExpr("doc_id", "text", "1 bucket", "'x' slice").repartition(5)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert aligned(df) == brute(rows)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert aligned(none) == []
    assert aligned(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
