import io
import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from foliant.llm import common as c
from foliant.llm import token_shards as ts

PATH = P.path("byte_bpe_50k.json")


def test_round_trip_against_the_library(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source")
    docs = docs.unionByName(spark.createDataFrame([(-3, None), (900, ""), (901, "a<|endoftext|>b 'll"), (902, "  \n x")], "doc_id long, text string"), allowMissingColumns=True)
    library = Tokenizer.from_file(PATH)
    want, start = {}, 0
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        ids = np.array(library.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4")
        want[r.doc_id] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    folder = c.scratch_path(spark, "test")
    shards = ts.write(docs, PATH, folder, 2)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in ts.read(spark, shards, folder).collect()}
    assert got == want
    names = [r.shard for r in shards.collect()]
    found = {}
    for name in names:
        shard = ts.Shard(open(f"{folder.removeprefix('file://')}/{name}", "rb"))
        found |= {k: shard.get(k) for k in want if shard.get(k) is not None}
        assert shard.get(10**9) is None
    assert {k: zlib.crc32(v.tobytes()) for k, v in found.items()} == {k: v[2] for k, v in want.items()}


def test_pieces_are_known_from_task_to_task(monkeypatch):
    """A worker's next task loads no tokenizer and encodes new pieces only; forgetting changes no ids."""
    library = Tokenizer.from_file(PATH)
    texts = [["one fish two fish", "", "déjà 'll 12 !?"], ["two red fish", "  \n x"], ["one 'll blue"]]
    for most in (ts.PIECES, 2):
        monkeypatch.setattr(ts, "PIECES", most)
        ts._loaded.clear()
        encoder = ts._worker(PATH)[3]
        asked, merge = [], encoder.merge
        encoder.merge = lambda new, asked=asked, merge=merge: asked.extend(new) or merge(new)
        for task in texts:
            assert ts._worker(PATH)[3] is encoder
            raw = [t.encode() for t in task]
            ids, ranges, *_ = encoder(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
            assert [ids[a:b].tolist() for a, b in zip(ranges, ranges[1:])] == [library.encode(t, add_special_tokens=False).ids for t in task]
        assert (len(asked) == len(set(asked))) == (most > 2)
    ts._loaded.clear()


def test_repeated_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(4, "b"), (4, "a"), (None, "n"), (1, "x")], "doc_id long, text string")
    folder = c.scratch_path(spark, "test")
    rows = sorted((r.start, r.doc_id) for r in ts.read(spark, ts.write(docs, PATH, folder, 2), folder).collect())
    assert [d for _, d in rows] == [1, 4, 4, None] and [s for s, _ in rows] == [0, 2, 4, 6]
    folder = c.scratch_path(spark, "test")
    assert ts.read(spark, ts.write(docs.limit(0), PATH, folder, 2), folder).count() == 0


def test_damage_is_found():
    out = io.BytesIO()
    out.close = lambda: None
    w = ts.ShardWriter(out, 2)
    for k in range(-5, 3000):
        w.add(k, k, np.arange(k % 40))
    w.close()
    raw = out.getvalue()
    shard = ts.Shard(io.BytesIO(raw))
    assert len(shard.index) > 1 and shard.docs == 3005 and len(shard.get(-5)) == 35 and shard.get(3000) is None
    bad = ts.Shard(io.BytesIO(raw[:10] + bytes([raw[10] ^ 1]) + raw[11:]))
    try:
        list(bad.scan())
    except ValueError:
        return
    raise AssertionError
