"""Token-id output as sorted-string-table shards.

A shard holds documents in ascending key order:

    blocks   entries (varint shared, varint unshared, varint value length, rest of key, value), then CRC-32 of the block
    index    for each block: last key (8 bytes), offset, size (unsigned 64-bit each)
    bloom    bits, about ten a key
    footer   index offset and size, bloom offset and size, documents, ids (unsigned 64-bit each), bytes an id, version, magic

A key is the row number as 8 big-endian bytes with the sign bit flipped, so bytes order as numbers do. Keys share
prefixes with the one before in their block. A value is a flag (0: the document's id is the key, 1: it follows in 8
bytes, 2: it is null) and the ids, little-endian. Integers are little-endian where nothing is said.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.llm import common as c
from foliant.llm.byte_bpe import Encoder

MAGIC = b"FOLSST01"
FOOTER = struct.Struct("<6QHH8s")
INDEX = struct.Struct(">8sQQ")
BLOCK_BYTES = 1 << 16
SHARD_BYTES = 1 << 28
_HASHES = 7
#: Distinct pieces that a worker remembers from task to task.
PIECES = 1 << 20
META = "shard string, first long, docs long, ids long"
SCHEMA = "shard string, doc_id long, local_start long, n_tokens long, ids_crc32 long"


def key_of(row: int) -> bytes:
    return struct.pack(">Q", (row & (1 << 64) - 1) ^ (1 << 63))


def row_of(key: bytes) -> int:
    n = struct.unpack(">Q", key)[0] ^ (1 << 63)
    return n - (1 << 64) if n >> 63 else n


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[at]
        at += 1
        n |= (x & 127) << shift
        if x < 128:
            return n, at
        shift += 7


def _bits(key: bytes, size: int):
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (1 << 64) - 1, h >> 64 | 1
    return [(a + i * b & (1 << 64) - 1) % size for i in range(_HASHES)]


class ShardWriter:
    """Writes one shard to a stream; keys come in ascending order."""

    def __init__(self, stream, width: int):
        self.stream, self.width = stream, width
        self.block, self.last, self.at, self.index, self.keys = bytearray(), b"", 0, [], []
        self.docs = self.ids = 0

    def add(self, row: int, doc_id: int | None, ids: np.ndarray) -> None:
        key = key_of(row)
        if self.keys and key <= self.keys[-1]:
            raise ValueError("keys must ascend")
        flag = b"\0" if doc_id == row else b"\2" if doc_id is None else b"\1" + struct.pack("<q", doc_id)
        value = ids.astype("<u2" if self.width == 2 else "<u4").tobytes()
        shared = len(os.path.commonprefix([key, self.last])) if self.block else 0
        self.block += varint(shared) + varint(8 - shared) + varint(len(flag) + len(value)) + key[shared:] + flag + value
        self.last = key
        self.keys.append(key)
        self.docs += 1
        self.ids += len(ids)
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            data = bytes(self.block) + struct.pack("<I", zlib.crc32(self.block))
            self.index.append(INDEX.pack(self.last, self.at, len(data)))
            self._put(data)
            self.block = bytearray()

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def close(self) -> None:
        self._flush()
        bits = np.zeros(max(64, len(self.keys) * 10), np.uint8)
        for key in self.keys:
            bits[_bits(key, len(bits))] = 1
        index_at, index = self.at, b"".join(self.index)
        self._put(index)
        bloom_at, bloom = self.at, struct.pack("<Q", len(bits)) + np.packbits(bits).tobytes()
        self._put(bloom)
        self._put(FOOTER.pack(index_at, len(index), bloom_at, len(bloom), self.docs, self.ids, self.width, 1, MAGIC))
        self.stream.close()


class Shard:
    """A shard for lookups and scans; reads blocks as they are needed. ``stream`` has seek, read and size."""

    def __init__(self, stream):
        self.stream = stream
        end = stream.size() if callable(getattr(stream, "size", None)) else stream.seek(0, 2)
        index_at, index_size, bloom_at, bloom_size, self.docs, self.ids, self.width, version, magic = FOOTER.unpack(self._at(end - FOOTER.size, FOOTER.size))
        if magic != MAGIC or version != 1:
            raise ValueError("not a shard of this format")
        self.index = list(INDEX.iter_unpack(self._at(index_at, index_size)))
        self.lasts = [k for k, _, _ in self.index]
        bloom = self._at(bloom_at, bloom_size)
        self.bits, self.bloom = struct.unpack("<Q", bloom[:8])[0], bloom[8:]

    def _at(self, offset: int, size: int) -> bytes:
        self.stream.seek(offset)
        return self.stream.read(size)

    def _entries(self, i: int):
        _, offset, size = self.index[i]
        data = self._at(offset, size)
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError(f"block {i} is damaged")
        at, key = 0, b""
        while at < size - 4:
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            length, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            value, at = data[at : at + length], at + length
            skip = 9 if value[0] == 1 else 1
            doc_id = row_of(key) if value[0] == 0 else None if value[0] == 2 else struct.unpack("<q", value[1:9])[0]
            yield key, doc_id, np.frombuffer(value, "<u2" if self.width == 2 else "<u4", offset=skip).astype("<u4")

    def scan(self):
        for i in range(len(self.index)):
            yield from self._entries(i)

    def may_hold(self, row: int) -> bool:
        return all(self.bloom[x >> 3] >> (7 - (x & 7)) & 1 for x in _bits(key_of(row), self.bits))

    def get(self, row: int) -> np.ndarray | None:
        """A document's ids by its row key, or None: Bloom filter, binary search in the index, then one block."""
        if not self.may_hold(row):
            return None
        key = key_of(row)
        i = bisect_left(self.lasts, key)
        return next((ids for k, _, ids in (self._entries(i) if i < len(self.index) else ()) if k == key), None)


def _library(path: str):
    """(tokenizer, contents of its added tokens, whether it cuts texts as pretokens.pieces does)"""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    cut = made.get("pre_tokenizer") or {}
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not made.get("normalizer") and not made.get("truncation")
    return Tokenizer.from_file(path), [t["content"].encode() for t in made.get("added_tokens", [])], plain


_loaded: dict[tuple, tuple] = {}


def _worker(path: str):
    """_library() and an encoder by it, one for each file and worker: what a task has encoded, the worker's next ones know."""
    file = os.stat(path)
    key = path, file.st_size, file.st_mtime_ns
    if key not in _loaded:
        library, added, plain = _library(path)
        _loaded.clear()
        _loaded[key] = library, added, plain, Encoder(lambda texts: [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)], PIECES)
    return _loaded[key]


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes shards in ascending id order and returns their names, first keys, documents and ids.

    Texts are encoded with the tokenizers library by the file ``tokenizer``, without special tokens of its own;
    ``end_id`` ends each document. A worker encodes a distinct piece once, unless it has had over PIECES of them since. A null or empty text has the end id
    alone. Ids that are null or repeat: see common.keyed. An empty table writes no shard. Other columns are ignored.
    A task writes under a name of its own attempt and then renames, so a task that runs again leaves whole files.
    """
    spark = docs.sparkSession
    dealt = c.keyed(docs, id_col, text_col).repartitionByRange(c.partitions(spark), "row").sortWithinPartitions("row")

    def run(batches):
        library, added, plain, encoder = _worker(tokenizer)
        width = 2 if max(library.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        task = TaskContext.get()
        writer = name = first = temp = None
        n = 0

        def done():
            writer.close()
            fs.move(temp, f"{base}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([first], pa.int64()), pa.array([writer.docs], pa.int64()), pa.array([writer.ids], pa.int64())], ["shard", "first", "docs", "ids"])

        for whole in batches:
            for batch in c.slices(whole, "text"):
                data, offs = c.flat(batch.column("text"))
                ids, ranges, *_ = encoder(data, offs) if plain else (None, None)
                rows, doc_ids = batch.column("row").to_pylist(), batch.column("doc_id").to_pylist()
                for i, (row, doc_id) in enumerate(zip(rows, doc_ids)):
                    raw = data[offs[i] : offs[i + 1]].tobytes() if added or not plain else b""
                    if not plain or any(a in raw for a in added):
                        got = np.array(library.encode(raw.decode(), add_special_tokens=False).ids, "<u4")
                    else:
                        got = ids[ranges[i] : ranges[i + 1]]
                    if writer is None:
                        name, first, n = f"shard-{task.partitionId():06d}-{n:04d}.sst", row, n + 1
                        temp = f"{base}/_{name}.{task.taskAttemptId()}"
                        writer = ShardWriter(fs.open_output_stream(temp), width)
                    writer.add(row, doc_id, np.append(got, end_id))
                    if writer.at >= SHARD_BYTES:
                        yield done()
                        writer = None
        if writer is not None:
            yield done()

    return c.stored(dealt.mapInArrow(run, META), "shards")[0]


def read(spark: SparkSession, shards: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all documents, from the shard files."""

    def run(batches):
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("shard").to_pylist():
                rows, start = [], 0
                for _, doc_id, ids in Shard(fs.open_input_file(f"{base}/{name}")).scan():
                    rows.append((name, doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
                    start += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*rows), (pa.string(), *[pa.int64()] * 4))], ["shard", "doc_id", "local_start", "n_tokens", "ids_crc32"])

    # a row for each shard: few enough for one window, and for a broadcast
    base = shards.withColumn("base", F.coalesce(F.sum("ids").over(Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("shard", "base")
    names = shards.select("shard").repartition(c.partitions(spark), "shard")
    return names.mapInArrow(run, SCHEMA).join(F.broadcast(base), "shard").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
