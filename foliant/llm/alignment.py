"""Alignment of two tokenizers' tokens over a corpus: which of their tokens end together, and how usual each pairing is.

Tokenizer A is a byte-level BPE of the tokenizers library and reads a space and the text; tokenizer B is a sentencepiece
model, which adds that space itself. Where tokens of both end at one byte they are linked, and the text is cut there into
groups. A link's count is how many links of the whole corpus hold its pair of ids.

Per-document multiplicities of pairs, the postings, are written once and shuffled by B's id: ids go to a fixed number of
buckets, and a slice of texts sends a bucket one packet. Pairs' totals, added up on the map side first, are summed for
each bucket, and each id's highest is taken there. Totals and packets of a bucket then meet in one sorted, spillable
stream, totals first; each packet gives its documents' contributions, and these are summed by slice in another sorted
stream. A bucket of many postings is dealt to several streams, each with the bucket's totals. A stream holds one
bucket's totals, which vocabularies bound, and one packet.
"""

from __future__ import annotations

import hashlib
import os
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm import common as c
from foliant.llm.byte_bpe import CACHE, Encoder, gather
from foliant.llm.words import hash_words

BUCKETS = 64
#: Postings of a bucket that one stream meets.
STREAM = 1 << 24
#: Distinct pairs that a map task gathers before it sends them.
GATHERED = 1 << 21
SLICE_BYTES = 1 << 20
PACKET = "slice long, bucket int, n long, pairs binary, totals binary, sizes binary, docs binary, times binary"
TOTALS = "bucket int, n long, pairs binary, totals binary"
COUNTS = "bucket int, n long, pairs binary, totals binary, best binary"
GIVEN = "slice long, docs binary, best binary, sums binary"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_SEPARATORS = (b",", b"|", b";", b"")


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


class Table:
    """Bytes of numbered strings, one after another."""

    def __init__(self, strings: list[bytes]):
        self.length = np.array([len(s) for s in strings], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.length)])
        self.flat = np.frombuffer(b"".join(strings), np.uint8)

    def join(self, which: np.ndarray, ranges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return gather(self.flat, self.at, self.length, which, ranges)


class ByteLevel:
    """Tokenizer A: ids of whole batches, pieces cut by the scan and encoded once by the library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings are plain text
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]  # bytes that stand for themselves
        hidden = [b for b in range(256) if b not in set(shown)]  # the others follow code point 255
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        tokens = [b""] * (max(self.library.get_vocab().values()) + 1)
        for token, i in self.library.get_vocab().items():
            tokens[i] = bytes(byte[x] for x in token) if all(x in byte for x in token) else token.encode()
        self.table = Table(tokens)
        self.encoder = Encoder(lambda texts: [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)])

    def __call__(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, ranges, *_ = self.encoder(data, offs)
        return ids.astype(np.int64), ranges


class Pieces:
    """Tokenizer B: ids of whole batches of a space and a text.

    Where no piece holds a space after something else, and the model leaves texts as they are, nothing merges across
    the beginning of a run of spaces: texts are cut there, and distinct segments are encoded once. Other models get
    whole texts.
    """

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            model = sentencepiece_model_pb2.ModelProto.FromString(f.read())
        n = model.normalizer_spec
        plain = n.add_dummy_prefix and n.escape_whitespaces and not n.remove_extra_whitespaces and not n.precompiled_charsmap and not model.trainer_spec.treat_whitespace_as_suffix
        self.cut = plain and model.trainer_spec.model_type == 2 and not any(re.search("[^▁]▁", p.piece) for p in model.pieces)
        self.table = Table([bytes([int(p.piece[3:5], 16)]) if p.type == 6 else p.piece.replace("▁", " ").encode() for p in model.pieces])
        self.space = next((i for i, p in enumerate(model.pieces) if p.piece == "▁"), None)
        self.known: dict[int, bytes] = {}

    def _encode(self, segments: list[bytes]) -> list[bytes]:
        """Packed ids of each segment, a space and what follows it."""
        got = self.library.encode([s[1:].decode() for s in segments], num_threads=1)
        if self.cut and self.space is not None:
            got = [[self.space] if s == b" " else ids for s, ids in zip(segments, got)]  # the library drops a lone space
        return [np.array(ids, "<u4").tobytes() for ids in got]

    def __call__(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start = np.zeros(len(data), bool)
        start[offs[:-1]] = True
        if self.cut:
            space = data == 32
            start[1:] |= space[1:] & ~space[:-1]
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], len(data))
        distinct, first, which = np.unique(hash_words(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.known) > CACHE:
            self.known.clear()
        keys = distinct.tolist()
        new = [i for i, k in enumerate(keys) if k not in self.known]
        if new:
            text = data.tobytes()
            self.known.update(zip([keys[i] for i in new], self._encode([text[starts[j] : ends[j]] for j in first[new]])))
        ids, bounds = Table([self.known[k] for k in keys]).join(which, np.arange(len(which) + 1))
        return ids.view("<u4").astype(np.int64), bounds[np.searchsorted(starts, offs)] // 4


def _same(data: np.ndarray, offs: np.ndarray, table: Table, ids: np.ndarray, ranges: np.ndarray) -> np.ndarray:
    """Whether each text's tokens join to it."""
    made, bounds = table.join(ids, ranges)
    if np.array_equal(bounds, offs) and np.array_equal(made, data):
        return np.ones(len(offs) - 1, bool)
    pairs = zip(zip(offs, offs[1:]), zip(bounds, bounds[1:]))
    return np.array([np.array_equal(data[a:b], made[x:y]) for (a, b), (x, y) in pairs], bool)


class Aligner:
    """Links, groups and postings of whole batches."""

    _loaded: dict[tuple[str, str], "Aligner"] = {}

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteLevel(path_a), Pieces(path_b)
        self.n_a, self.n_b = len(self.a.table.length), len(self.b.table.length)
        self.rows = -(-self.n_b // BUCKETS)  # B ids of a bucket
        self.decimal = Table([b"%d%s" % (i, s) for i in range(max(self.n_a, self.n_b)) for s in _SEPARATORS])

    @classmethod
    def load(cls, path_a: str, path_b: str) -> "Aligner":
        if (path_a, path_b) not in cls._loaded:
            cls._loaded[path_a, path_b] = cls(path_a, path_b)
        return cls._loaded[path_a, path_b]

    def __call__(self, column: pa.Array):
        """(n_a, n_b, n_groups, digests) of each text, and (each link's text, A id, B id)."""
        text, at = c.flat(column)
        size = np.diff(at)
        some = np.flatnonzero(size)
        offs = np.concatenate([[0], np.cumsum(size[some] + 1)])
        data = np.full(offs[-1], 32, np.uint8)  # a space before each text
        first = np.zeros(len(data), bool)
        first[offs[:-1]] = True
        data[~first] = text
        n = len(size)
        (ids_a, range_a), (ids_b, range_b) = ((t(data, offs) if len(some) else (np.zeros(0, np.int64), np.zeros(1, np.int64))) for t in (self.a, self.b))
        fine = _same(data, offs, self.a.table, ids_a, range_a) & _same(data, offs, self.b.table, ids_b, range_b)
        counts = []
        for ids, ranges in ((ids_a, range_a), (ids_b, range_b)):
            each = np.diff(ranges)
            full = np.zeros(n, np.int64)
            full[some] = each * fine
            counts.append((ids[np.repeat(fine, each)], full))
        (ids_a, count_a), (ids_b, count_b) = counts
        end_a, end_b = np.cumsum(self.a.table.length[ids_a]), np.cumsum(self.b.table.length[ids_b])
        mark_a, mark_b = (np.zeros((int(e[-1]) if len(e) else 0) + 1, bool) for e in (end_a, end_b))
        mark_a[end_a] = True
        mark_b[end_b] = True
        link_a, link_b = mark_b[end_a], mark_a[end_b]
        doc = np.repeat(np.arange(n), count_a)[link_a]
        groups = np.bincount(doc, minlength=n)
        # tokens group by group, A's before B's
        group_a, group_b = np.cumsum(link_a) - link_a, np.cumsum(link_b) - link_b
        of_a, of_b = np.bincount(group_a, minlength=len(doc)), np.bincount(group_b, minlength=len(doc))
        last = np.ones(len(doc), bool)
        last[:-1] = doc[1:] != doc[:-1]
        closes = np.zeros(len(ids_b), np.int64)
        closes[link_b] = np.where(last, 3, 2)
        which = np.empty(len(ids_a) + len(ids_b), np.int64)
        which[np.arange(len(ids_a)) + (np.cumsum(of_b) - of_b)[group_a]] = ids_a * 4 + link_a
        which[np.arange(len(ids_b)) + np.cumsum(of_a)[group_b]] = ids_b * 4 + closes
        made, bounds = self.decimal.join(which, np.concatenate([[0], np.cumsum(count_a + count_b)]))
        made = memoryview(made.tobytes())
        digests = [hashlib.sha256(made[x:y]).hexdigest() if y > x else "" for x, y in zip(bounds, bounds[1:])]
        return (count_a, count_b, groups, digests), (doc, ids_a[link_a], ids_b[link_b])

    def packets(self, doc: np.ndarray, a: np.ndarray, b: np.ndarray, n: int):
        """A packet for each bucket: (bucket, postings, pairs, totals, postings of each pair, their texts and times).

        A pair is numbered by bucket, then B id, then A id.
        """
        pair = ((b % BUCKETS) * self.rows + b // BUCKETS) * self.n_a + a
        key, times = np.unique(pair * n + doc, return_counts=True)
        pair, doc = key // n, key % n
        starts = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.zeros(0, np.int64)
        size = np.diff(np.append(starts, len(pair)))
        total = np.add.reduceat(times, starts) if len(pair) else times
        bucket = pair[starts] // (self.rows * self.n_a)
        for k in np.unique(bucket):
            x, y = np.searchsorted(bucket, [k, k + 1])
            i, j = starts[x], starts[y] if y < len(starts) else len(pair)
            yield int(k), int(j - i), c.planes(pair[starts[x:y]], 8), c.planes(total[x:y], 8), c.planes(size[x:y], 4), c.planes(doc[i:j], 4), c.planes(times[i:j], 4)


def _encoded(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """PACKET rows, and for each slice a row of bucket -1 with its texts' ids and numbers, planes in other columns."""

    def run(batches):
        aligner, task, serial = Aligner.load(path_a, path_b), TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in c.slices(whole, "text", SLICE_BYTES):
                number = (task << 32) + serial
                serial += 1
                (n_a, n_b, groups, digests), links = aligner(batch.column("text"))
                ids = batch.column("doc_id")
                head = (
                    c.planes(np.asarray(ids.fill_null(0).to_numpy(), np.int64), 8) + np.asarray(ids.is_null().to_numpy(zero_copy_only=False), np.uint8).tobytes(),
                    c.planes(n_a, 8), c.planes(n_b, 8), c.planes(groups, 8), b"".join(bytes.fromhex(d) or bytes(32) for d in digests),
                )
                rows = [(number, -1, batch.num_rows, *head), *((number, *p) for p in aligner.packets(*links, batch.num_rows))]
                kinds = (pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 5)
                yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*rows), kinds)], _names(PACKET))

    return docs.mapInArrow(run, PACKET)


def _summed(pairs: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(pairs, kind="stable")
    pairs, totals = pairs[order], totals[order]
    starts = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])) if len(pairs) else np.zeros(0, np.int64)
    return pairs[starts], np.add.reduceat(totals, starts) if len(pairs) else totals


def _longs(value: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(value) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(value, np.uint8).reshape(width, -1).T
    return out.view(np.int64).ravel()


class _Sums:
    """Totals of pairs, added up as they come."""

    def __init__(self):
        self.n, self.size, self.parts = 0, 0, []

    def add(self, n: int, pairs: np.ndarray, totals: np.ndarray) -> None:
        self.n += n
        self.parts.append((pairs, totals))
        self.size += len(pairs)
        if len(self.parts) > 1 and self.size > 2 * len(self.parts[0][0]) + 4096:
            self.whole()

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        summed = _summed(*(np.concatenate(x) for x in zip(*self.parts)))
        self.parts, self.size = [summed], len(summed[0])
        return summed


def _counts(packets: DataFrame, n_a: int) -> DataFrame:
    """COUNTS: a row for each bucket, its pairs' counts in the corpus and whether each is its B id's highest."""
    spark = packets.sparkSession

    def rows(sums: dict[int, _Sums]):
        for k in sorted(sums):
            pairs, totals = sums[k].whole()
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([sums[k].n], pa.int64()), pa.array([c.planes(pairs, 8)], pa.binary()), pa.array([c.planes(totals, 8)], pa.binary())], _names(TOTALS))

    def gathered(batches):
        sums: dict[int, _Sums] = {}
        for batch in batches:
            for k, n, pairs, totals in zip(*(batch.column(x).to_pylist() for x in _names(TOTALS))):
                sums.setdefault(k, _Sums()).add(n, _longs(pairs, 8), _longs(totals, 8))
            if sum(s.size for s in sums.values()) > GATHERED:
                yield from rows(sums)
                sums = {}
        yield from rows(sums)

    def closed(sums: _Sums, k: int):
        pairs, totals = sums.whole()
        b = pairs // n_a
        starts = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
        best = np.repeat(np.maximum.reduceat(totals, starts), np.diff(np.append(starts, len(b)))) == totals
        arrays = [pa.array([k], pa.int32()), pa.array([sums.n], pa.int64()), *(pa.array([x], pa.binary()) for x in (c.planes(pairs, 8), c.planes(totals, 8), best.tobytes()))]
        return pa.RecordBatch.from_arrays(arrays, _names(COUNTS))

    def merged(batches):
        sums, of = _Sums(), None
        for batch in batches:
            for k, n, pairs, totals in zip(*(batch.column(x).to_pylist() for x in _names(TOTALS))):
                if of is not None and k != of:
                    yield closed(sums, of)
                    sums = _Sums()
                of = k
                sums.add(n, _longs(pairs, 8), _longs(totals, 8))
        if of is not None:
            yield closed(sums, of)

    partial = packets.where("bucket >= 0").select("bucket", "n", "pairs", "totals").mapInArrow(gathered, TOTALS)
    return partial.repartition(c.partitions(spark), "bucket").sortWithinPartitions("bucket").mapInArrow(merged, COUNTS)


def _given(packets: DataFrame, counts: DataFrame) -> DataFrame:
    """GIVEN: what each packet gives to its texts: links with their B id's highest count, and the sum of counts."""
    spark = packets.sparkSession
    streams = counts.select("bucket", F.ceil(F.col("n") / STREAM).cast("int").alias("streams"))  # at most BUCKETS rows
    first = counts.join(F.broadcast(streams), "bucket").withColumn("stream", F.explode(F.sequence(F.lit(0), F.col("streams") - 1)))
    first = first.select("bucket", "stream", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("slice"), "pairs", "totals", "best", F.lit(None).cast("binary").alias("times"))
    then = packets.where("bucket >= 0").join(F.broadcast(streams), "bucket").withColumn("stream", F.pmod(F.xxhash64("slice"), F.col("streams")).cast("int"))
    then = then.select("bucket", "stream", F.lit(1).alias("kind"), "slice", "pairs", F.col("sizes").alias("totals"), F.col("docs").alias("best"), "times")
    both = first.unionByName(then).repartition(c.partitions(spark), "bucket", "stream").sortWithinPartitions("bucket", "stream", "kind")

    def run(batches):
        pairs = totals = best = None
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                kind, number, x, y, z, times = (batch.column(n)[i].as_py() for n in ("kind", "slice", "pairs", "totals", "best", "times"))
                if kind == 0:
                    pairs, totals, best = _longs(x, 8), _longs(y, 8), np.frombuffer(z, bool)
                    continue
                at = np.repeat(np.searchsorted(pairs, _longs(x, 8)), _longs(y, 4))
                doc, times = _longs(z, 4), _longs(times, 4)
                sums, bests = np.zeros(int(doc.max()) + 1, np.int64), np.zeros(int(doc.max()) + 1, np.int64)
                np.add.at(sums, doc, times * totals[at])
                np.add.at(bests, doc, times * best[at])
                some = np.flatnonzero(sums)
                out.append((number, c.planes(some, 4), c.planes(bests[some], 4), c.planes(sums[some], 8)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*out), (pa.int64(), *[pa.binary()] * 3))], _names(GIVEN))
        c.give_back()

    return both.select("kind", "slice", "pairs", "totals", "best", "times").mapInArrow(run, GIVEN)


def _finished(packets: DataFrame, given: DataFrame) -> DataFrame:
    spark = packets.sparkSession
    none = [F.lit(None).cast("binary").alias(x) for x in ("sizes", "docs")]
    heads = packets.where("bucket = -1").select("slice", F.lit(0).alias("kind"), "pairs", "totals", "sizes", F.col("docs"), F.col("times"))
    sums = given.select("slice", F.lit(1).alias("kind"), F.col("docs").alias("pairs"), F.col("best").alias("totals"), F.col("sums").alias("times"), *none)
    both = heads.unionByName(sums).repartition(c.partitions(spark), "slice").sortWithinPartitions("slice", "kind")

    def made(head, best, sums):
        ids, n_a, n_b, groups, digests = head
        n = len(best)
        null = np.frombuffer(ids[8 * n :], bool)
        digest = [digests[32 * i : 32 * i + 32].hex() if g else "" for i, g in enumerate(_longs(groups, 8))]
        columns = [_longs(x, 8) for x in (n_a, n_b, groups, groups)]
        arrays = [pa.array(_longs(ids[: 8 * n], 8), pa.int64(), mask=null), *map(pa.array, columns), pa.array(best), pa.array(sums), pa.array(digest, pa.string())]
        return pa.RecordBatch.from_arrays(arrays, _names(RESULT))

    def run(batches):
        head = best = sums = None
        for batch in batches:
            for i in range(batch.num_rows):
                kind, *values = (batch.column(n)[i].as_py() for n in ("kind", "pairs", "totals", "sizes", "docs", "times"))
                if kind == 0:
                    if head:
                        yield made(head, best, sums)
                    head = values
                    best, sums = (np.zeros(len(values[1]) // 8, np.int64) for _ in range(2))
                else:
                    doc = _longs(values[0], 4)
                    best[doc] += _longs(values[1], 4)
                    sums[doc] += _longs(values[4], 8)
        if head:
            yield made(head, best, sums)

    return both.select("kind", "pairs", "totals", "sizes", "docs", "times").mapInArrow(run, RESULT)


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: its tokens by A and B, groups, links, and how usual the links' pairs are.

    n_best: links whose pair has the highest count of its B id in all docs, ties included; count_sum: the sum of the
    links' counts. groups_sha256: digest of all groups' ids as ``a1,a2|b1;a3|b2,b3``. Texts that are null or empty, or
    that either tokenizer's tokens don't join to, have no tokens: zeros and ''. Null ids stay null, and rows that
    repeat count as often as they occur. An empty table gives no rows. Other columns are ignored. Pieces compare by
    64-bit hashes. A worker's memory is bounded by a slice of texts (one text, if it is longer).
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    packets, packets_path = c.stored(_encoded(texts, path_a, path_b), "postings")
    counts, counts_path = c.stored(_counts(packets, ByteLevel(path_a).table.length.size), "counts")
    made, _ = c.stored(_finished(packets, _given(packets, counts)), "aligned")
    for path in (packets_path, counts_path):
        c.delete(spark, path)
    return made
