"""Suffix-array dedup: bytes of passages that also start earlier in the corpus.

Difference-cover blockwise construction. The cover sample are the positions of a text whose residue, modulo the cover's
period, is in a perfect difference cover: any two positions reach it at one common offset below the period.

1. Equal strings of ``length`` bytes have equal sample prefixes at their common offset. Prefixes that occur once in the
   sample are found by counting (see tallies), and need no sorting.
2. The other sample suffixes are sorted in byte order, block by block: a block is a range of prefixes between splitters, dealt
   into buckets, and only one block's suffixes are on the move at a time. Sorted neighbours' common prefixes give each
   suffix of a bucket its rank among all, at every depth up to ``length``.
3. Any two equal strings tie for as long as they are; the tie is resolved at their common offset into the sample, by what
   is before it (in the order of reversed texts, sorted likewise) and the sample suffix's rank at the depth that is left.

Bytes are compared, not hashes; hashes only say which prefixes can be left out. Memory is bounded by a bucket.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm import common as c
from foliant.llm.tallies import Tally, dealt_texts, tallied
from foliant.llm.words import Runs, mix

#: Residues whose differences are all residues modulo the first number (perfect difference covers).
#: Fixed values from the literature on cyclic difference sets.
COVERS = {
    7: (0, 1, 3),
    13: (0, 1, 3, 9),
    21: (0, 1, 4, 14, 16),
    31: (0, 1, 3, 8, 12, 18),
    57: (0, 1, 3, 13, 32, 36, 43, 52),
    73: (0, 1, 12, 20, 26, 30, 33, 35, 57),
    91: (0, 2, 6, 7, 18, 21, 31, 54, 63, 71),
}
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
PLACES = "part int, block int, n long, row binary, pos binary, before binary, after binary, bucket binary"
SUFFIXES = "bucket int, right binary, left binary, row binary, pos binary, before binary, after binary"
MARKS = "part int, row long, pos long, mask binary"
BLOCKS = 8
#: A bucket for so many bytes of text, and no fewer than LEAST_BUCKETS. A part of the texts sends a bucket one packet.
BUCKET_TEXT = 1 << 20
LEAST_BUCKETS = 8 * BLOCKS
#: About so many texts that splitters of the byte order are drawn from, a piece of each: they only balance the buckets.
SPLIT_TEXTS, SPLIT_CHARS = 4096, 96
#: Ranges of the byte order. Where more buckets are wanted, a range's prefixes are dealt to several by their hash.
RANGES = 4096


def period_for(length: int) -> int:
    """The largest known cover that leaves sample prefixes of two thirds of the length, else the smallest."""
    return max((p for p in COVERS if 3 * (length - p + 1) >= 2 * length), default=min(COVERS))


class _Slice:
    """A slice of texts: bytes, each text's range, sample positions."""

    def __init__(self, batch, length: int, period: int):
        self.data, self.offs = c.flat(batch.column("text"))
        self.length, self.prefix = length, length - period + 1
        residues, size = np.array(COVERS[period]), np.diff(self.offs)
        turns, rest = np.divmod(size - self.prefix + 1, period)
        count = np.where(size >= length, turns * len(residues) + np.searchsorted(residues, rest), 0)
        self.text = np.repeat(np.arange(len(size)), count)
        turns, rest = np.divmod(np.arange(len(self.text)) - (np.cumsum(count) - count)[self.text], len(residues))
        local = turns * period + residues[rest]
        self.at = self.offs[self.text] + local
        self.local = local.astype(np.uint32)

    def hashes(self) -> np.ndarray:
        return Runs(mix(np.arange(1, 257, dtype=np.uint64))[self.data])(self.at, self.at + self.prefix)


def _pieces(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """width bytes from each place on, zero beyond the data."""
    wide = np.concatenate([data, np.zeros(width, np.uint8)])
    return np.lib.stride_tricks.sliding_window_view(wide, width)[at]


def _row_hashes(x: np.ndarray) -> np.ndarray:
    """A hash of each row of bytes."""
    wide = np.zeros((len(x), -(-x.shape[1] // 8) * 8), np.uint8)
    wide[:, : x.shape[1]] = x
    words = wide.view(np.uint64)
    return mix(mix(words * (mix(np.arange(1, words.shape[1] + 1, dtype=np.uint64)) | np.uint64(1))).sum(axis=1, dtype=np.uint64))


def byte_order(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of bytes in their order, and how many bytes each has in common with the one before it (the first: -1)."""
    order = np.argsort(np.ascontiguousarray(x).view(f"S{x.shape[1]}").ravel(), kind="stable")
    moved = x[order]
    common = np.full(len(x), -1, np.int16)
    for a in range(1, len(x), 1 << 14):  # a piece at a time: the comparison is as large as the rows
        other = moved[a : a + (1 << 14)] != moved[a - 1 : a - 1 + len(moved[a : a + (1 << 14)])]
        common[a : a + len(other)] = np.where(other.any(axis=1), other.argmax(axis=1), x.shape[1])
    return order, common


def ranks(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """Each row's rank by its first ``depth`` bytes: equal where they are."""
    got = np.empty(len(order), np.int64)
    got[order] = np.cumsum(common < depth)
    return got


def _masks(right: np.ndarray, left: np.ndarray, before: np.ndarray, after: np.ndarray, length: int, period: int) -> np.ndarray:
    """For each suffix, in order of appearance, and each offset below the period: does the string that starts so much
    before it, of ``length`` bytes, start earlier too?

    right: bytes from the suffix on, left: bytes before it backwards, both zero beyond ``after`` and ``before``.
    """
    out = np.zeros((len(right), period), bool)
    if not len(right):
        return out
    order, common = byte_order(right)
    group = ranks(order, common, length - period + 1)
    size = np.bincount(group)[group]
    # two alike: what they have in common both ways tells all
    pairs = order[size[order] == 2].reshape(-1, 2)
    a, b = pairs.min(axis=1), pairs.max(axis=1)
    low = length - np.minimum(common[np.flatnonzero(size[order] == 2)[1::2]].astype(np.int64), np.minimum(after[a], after[b]))
    other = left[a] != left[b]
    alike = np.where(other.any(axis=1), other.argmax(axis=1), left.shape[1])
    high = np.minimum(alike, np.minimum(before[a], before[b]))
    back = np.arange(period)
    out[b] = (back >= low[:, None]) & (back <= high[:, None])
    # more of them: string by string
    many = np.flatnonzero(size > 2)
    if len(many):
        right, left, before, after = right[many], left[many], before[many], after[many]
        by_right, by_left, n = byte_order(right), byte_order(left), len(many)
        for back in range(period):
            some = np.flatnonzero((before >= back) & (after >= length - back))
            if len(some) < 2:
                continue
            key = (ranks(*by_left, back) * (n + 1) + ranks(*by_right, length - back))[some]
            _, first = np.unique(key, return_index=True)
            again = np.ones(len(some), bool)
            again[first] = False
            out[many[some[again]], back] = True
    return out


def remove_earlier(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", keep_bytes: bool = False) -> DataFrame:
    """Each text without the bytes covered by a string of ``length`` bytes that also starts earlier.

    Earlier is a smaller id, or the same text and an earlier start; strings don't cross texts and are judged on the
    input. Rows with a null id come last; rows of equal id follow each other by their text's digest, equal rows in any
    order (so all but one of them lose their bytes). A null or empty text has 0 bytes and the digest of nothing. Texts
    may have any length below 2^31 bytes, as Arrow's strings. An empty table gives an empty result. Other columns are
    ignored. ``kept`` (the remaining bytes) is null unless keep_bytes. ``length`` is 10 at least, as the smallest cover
    needs room.
    """
    if length < 10:
        raise ValueError("length must be 10 or more")
    spark = docs.sparkSession
    period = period_for(length)
    prefix, reach = length - period + 1, period - 1
    mask_bytes = -(-period // 8)
    parts = c.partitions(spark)
    texts = dealt_texts(c.keyed(docs, id_col, text_col), parts)
    rows = texts.select("part", "row", "text")
    scratch: list[str] = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        table, path = c.stored(df, name)
        scratch.append(path)
        return table

    def grams(batch):
        s = _Slice(batch, length, period)
        return s.hashes(), s.text

    total = texts.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    text_bytes = int(total[0] or 0)
    buckets = max(LEAST_BUCKETS, -(-text_bytes // BUCKET_TEXT))
    ranges = min(buckets, RANGES)
    shares = -(-buckets // ranges)
    cuts = _splitters(texts, total[1], prefix, ranges)

    def places(mine: pa.Table, told: pa.Table) -> pa.Table:
        """The sample suffixes whose prefix repeats: how far strings around each reach back and on, and its bucket."""
        tally, out = Tally(told), []
        for batch in c.slices(mine.sort_by("row"), "text"):
            s, rows_ = _Slice(batch, length, period), c.longs(batch.column("row").combine_chunks())
            hashes = s.hashes()
            used = np.flatnonzero(tally(hashes) > 1)
            at, text = s.at[used], s.text[used]
            low, high = np.maximum(at - reach, s.offs[text]), np.minimum(at, s.offs[text + 1] - length)
            span = np.searchsorted(cuts, _pieces(s.data, at, prefix).view(f"S{prefix}").ravel(), "right")
            bucket = (span * shares + (hashes[used] >> np.uint64(32)).astype(np.int64) % shares).astype(np.uint32)
            fields = (rows_[text], s.local[used], (at - low).astype(np.uint16), (length - at + high).astype(np.uint16), bucket)
            part = int(mine.column("part")[0].as_py())
            for block, (r, p, b, a, k) in c.dealt(span * BLOCKS // ranges, BLOCKS, *fields):
                out.append((part, block, len(r), c.planes(r, 8), c.planes(p, 4), c.planes(b, 2), c.planes(a, 2), c.planes(k, 4)))
        kinds = (pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 5)
        columns = list(zip(*out)) if out else [[]] * 8
        return pa.Table.from_arrays([pa.array(v, t) for v, t in zip(columns, kinds)], ["part", "block", "n", "row", "pos", "before", "after", "bucket"])

    def suffixes(mine: pa.Table, told: pa.Table) -> pa.Table:
        """The bytes around a block's sample suffixes, a packet for each bucket; those with an equal earlier in their slice
        come last in a packet, without bytes."""
        row, pos, before, after, bucket = (c.joined(told.column(k), d, w) for k, d, w in (("row", np.int64, 8), ("pos", np.uint32, 4), ("before", np.uint16, 2), ("after", np.uint16, 2), ("bucket", np.uint32, 4)))
        order = np.lexsort((pos, row))
        row, pos, before, after, bucket = (x[order] for x in (row, pos, before, after, bucket))
        out: list = []
        got: list = []
        for batch in c.slices(mine.sort_by("row"), "text") if len(row) else ():
            keys = c.longs(batch.column("row").combine_chunks())
            data, offs = c.flat(batch.column("text"))
            a, b = np.searchsorted(row, keys[0]), np.searchsorted(row, keys[-1], "right")
            if a == b:
                continue
            r, p, bef, aft, buc = (x[a:b] for x in (row, pos, before, after, bucket))
            at = offs[np.searchsorted(keys, r)] + p
            right = _pieces(data, at, length)
            right[np.arange(length) >= aft[:, None]] = 0
            left = _pieces(np.concatenate([np.zeros(reach, np.uint8), data]), at, reach)[:, ::-1].copy()
            left[np.arange(reach) >= bef[:, None]] = 0
            whole = _row_hashes(np.concatenate([right, left], axis=1)) ^ mix((bef.astype(np.uint64) << np.uint64(32)) + aft)
            _, first, same = np.unique(whole, return_index=True, return_inverse=True)
            first = first[same]
            again = (first != np.arange(len(at))) & (bef == bef[first]) & (aft == aft[first])
            some = np.flatnonzero(again)
            again[some] = (right[some] == right[first[some]]).all(axis=1) & (left[some] == left[first[some]]).all(axis=1)
            got.append((buc, again, r, p, bef, aft, right[~again], left[~again]))
        if got:
            buc, again, r, p, bef, aft, right, left = (np.concatenate(x) for x in zip(*got))
            got.clear()
            order = np.argsort(buc[~again], kind="stable")
            right, left = right[order], left[order]
            order = np.lexsort((again, buc))
            buc, again, r, p, bef, aft = (x[order] for x in (buc, again, r, p, bef, aft))
            starts = np.flatnonzero(np.append(True, buc[1:] != buc[:-1]))
            whole = np.append(0, np.cumsum(~again))
            for i, j in zip(starts, np.append(starts[1:], len(buc))):
                k = slice(whole[i], whole[j])
                out.append((int(buc[i]), right[k].tobytes(), left[k].tobytes(), c.planes(r[i:j], 8), c.planes(p[i:j], 4), c.planes(bef[i:j], 2), c.planes(aft[i:j], 2)))
        kinds = (pa.int32(), *[pa.binary()] * 6)
        columns = list(zip(*out)) if out else [[]] * 7
        return pa.Table.from_arrays([pa.array(v, t) for v, t in zip(columns, kinds)], ["bucket", "right", "left", "row", "pos", "before", "after"])

    def settle(table: pa.Table) -> pa.Table:
        """A bucket's suffixes sorted, and the marks of the strings around them that start earlier too."""
        every = [c.joined(table.column(k), d, w) for k, d, w in (("row", np.int64, 8), ("pos", np.uint32, 4), ("before", np.uint16, 2), ("after", np.uint16, 2))]
        whole, n = (np.diff(c.flat(table.column(k))[1]) // w for k, w in (("right", length), ("row", 8)))
        again = np.repeat(np.tile([False, True], len(n)), np.stack([whole, n - whole], axis=1).ravel())
        rows_, places_, bits = [], [], []
        for known in (True, False):
            row, pos, before, after = (x[again == known] for x in every)
            if not len(row):
                continue
            if known:
                back = np.arange(period)
                marks = (back <= before[:, None]) & (back >= length - after[:, None].astype(np.int64))
            else:
                right, left = (c.flat(table.column(k))[0].reshape(len(row), w) for k, w in (("right", length), ("left", reach)))
                order = np.lexsort((pos, row))
                row, pos, before, after, right, left = (x[order] for x in (row, pos, before, after, right, left))
                marks = _masks(right, left, before, after, length, period)
                del right, left
            hit = np.flatnonzero(marks.any(axis=1))
            rows_.append(row[hit])
            places_.append(pos[hit])
            bits.append(np.packbits(marks[hit], axis=1))
        c.give_back()
        row = np.concatenate(rows_) if rows_ else np.zeros(0, np.int64)
        pos = np.concatenate(places_).astype(np.int64) if rows_ else row
        data = np.concatenate(bits).tobytes() if rows_ else b""
        ends = pa.py_buffer((np.arange(len(row) + 1, dtype=np.int32) * mask_bytes).tobytes())
        mask = pa.Array.from_buffers(pa.binary(), len(row), [None, ends, pa.py_buffer(data)])
        return pa.Table.from_arrays([pa.array(c.part_of_array(row, parts), pa.int32()), pa.array(row), pa.array(pos), mask], ["part", "row", "pos", "mask"])

    def close(mine: pa.Table, told: pa.Table) -> pa.Table:
        row, pos = c.longs(told.column("row").combine_chunks()), c.longs(told.column("pos").combine_chunks())
        mask = c.flat(told.column("mask"))[0].reshape(-1, mask_bytes)
        order = np.lexsort((pos, row))
        row, pos, mask = row[order], pos[order], mask[order]
        got = []
        for batch in c.slices(mine.sort_by("row"), "text"):
            keys = c.longs(batch.column("row").combine_chunks())
            data, offs = c.flat(batch.column("text"))
            a, b = np.searchsorted(row, keys[0]), np.searchsorted(row, keys[-1], "right")
            at = offs[np.searchsorted(keys, row[a:b])] + pos[a:b]
            change = np.zeros(len(data) + 1, np.int32)
            starts = np.zeros(len(data), bool)
            for back in range(period):
                bit = (mask[a:b, back // 8] >> (7 - back % 8)) & 1
                starts[at[bit > 0] - back] = True
            starts = np.flatnonzero(starts)
            change[starts] += 1
            np.add.at(change, starts + length, -1)
            got.append(_finished(batch, data, offs, np.cumsum(change)[: len(data)] > 0, keep_bytes))
        return pa.concat_tables(got) if got else _finished(mine, np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, bool), keep_bytes)

    answers = kept(tallied(rows, parts, grams), "prefixes")
    placed = kept(rows.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(places, PLACES), "places")
    c.delete(spark, scratch.pop(0))
    size = {r.block: r.n for r in placed.groupBy("block").agg(F.sum("n").alias("n")).collect()}  # BLOCKS rows at most
    marks = None
    for blocks in _passes(size, text_bytes * 3 // (2 * (length + period))):
        mine = placed.where(F.col("block").isin(blocks)).drop("block", "n")
        sent = rows.groupBy("part").cogroup(mine.groupBy("part")).applyInArrow(suffixes, SUFFIXES)
        found = kept(sent.groupBy("bucket").applyInArrow(settle, MARKS), "marks")
        marks = found if marks is None else marks.unionByName(found)
    marks = spark.createDataFrame([], MARKS) if marks is None else marks
    return texts.select("part", "row", "doc_id", "text").groupBy("part").cogroup(marks.groupBy("part")).applyInArrow(close, SCHEMA)


def _splitters(texts: DataFrame, count: int, prefix: int, n: int) -> np.ndarray:
    """n - 1 strings at even distances in the byte order of a sample of suffixes, from about SPLIT_TEXTS of count texts."""
    turn = F.xxhash64("row")
    drawn = F.pmod(turn, F.lit(1 << 40)) < int((1 << 40) * min(1.0, SPLIT_TEXTS / max(count, 1)))
    piece = F.substring("text", 1 + F.pmod(turn, F.greatest(F.length("text") - SPLIT_CHARS, F.lit(1))).cast("int"), F.lit(SPLIT_CHARS))
    found = texts.where(drawn).select(piece.alias("piece")).collect()
    keys = sorted(b[i : i + prefix] for b in (r.piece.encode() for r in found) for i in range(0, len(b) - prefix, 7))
    if not keys:
        return np.zeros(0, f"S{prefix}")
    return np.unique(np.array([keys[len(keys) * i // n] for i in range(1, n)], f"S{prefix}"))


def _passes(size: dict[int, int], most: int) -> list[list[int]]:
    """Blocks in turn, together as long as they have no more than so many suffixes."""
    out: list[list[int]] = []
    left = 0
    for block in sorted(size):
        if not out or size[block] > left:
            out.append([])
            left = most
        out[-1].append(block)
        left -= size[block]
    return out


def _finished(batch, data: np.ndarray, offs: np.ndarray, covered: np.ndarray, keep_bytes: bool) -> pa.Table:
    n = np.diff(offs)
    before = np.concatenate([[0], np.cumsum(covered)])
    removed = before[offs[1:]] - before[offs[:-1]]
    starts = covered.copy()
    if len(starts):
        starts[1:] &= ~covered[:-1]
        first = offs[:-1][n > 0]
        starts[first] = covered[first]
    spans = np.concatenate([[0], np.cumsum(starts)])
    kept = [data[a:b][~covered[a:b]].tobytes() for a, b in zip(offs[:-1], offs[1:])]
    digests = [hashlib.sha256(k).hexdigest() for k in kept]
    columns = [pa.array(batch.column("doc_id").to_pylist(), pa.int64()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans[offs[1:]] - spans[offs[:-1]], pa.int64()), pa.array(digests, pa.string()), pa.array(kept if keep_bytes else [None] * len(kept), pa.binary())]
    return pa.Table.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


#: Starts that repeat become runs; texts are cut into blocks first, as a cut far into a string takes long.
ORACLE = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
x as (select doc_id, j, substr(h, 512 * j + 1, 710) as x from (select doc_id, h, unnest(range(0, (length(h) + 511) // 512)) as j from d where length(h) >= 200)),
w as (select doc_id, 256 * j + o as i, md5_number(substr(x, 2 * o + 1, 200)) as s from (select doc_id, j, x, unnest(range(0, least(256, (length(x) - 200) // 2 + 1))) as o from x where length(x) >= 200)),
f as (select s, min(doc_id * 1000000000 + i) as first from w group by s having count(*) > 1),
r as (select doc_id, i, lag(i) over (partition by doc_id order by i) as before from w join f using (s) where doc_id * 1000000000 + i <> first),
n as (select doc_id, i, sum(case when before is null or i > before + 100 then 1 else 0 end) over (partition by doc_id order by i) as run from r),
g as (select doc_id, run, min(i) as a, max(i) + 100 as z from n group by doc_id, run),
k as (select doc_id, h, a, z, coalesce(lag(z) over (partition by doc_id order by a), 0) as last, row_number() over (partition by doc_id order by a desc) as turn from g join d using (doc_id)),
t as (select doc_id, sum(z - a) as removed, count(*) as spans, string_agg(substr(h, 2 * last + 1, 2 * (a - last)) || case when turn = 1 then substr(h, 2 * z + 1) else '' end, '' order by a) as kept from k group by doc_id)
select doc_id, (length(h) // 2)::bigint as n_bytes, coalesce(removed, 0)::bigint as n_removed, coalesce(spans, 0)::bigint as n_spans, sha256(unhex(coalesce(kept, h))) as kept_sha256
from d left join t using (doc_id)
"""
