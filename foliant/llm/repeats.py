"""Which runs of W tokens occur more than once in a corpus: the engine of both substring operators.

A seed is a run of L < W tokens. Two ways to choose seeds guarantee that equal W-runs hold an equal seed at an equal
offset (`cover_seeds`, `winnowed_seeds`). Then

1. seeds are dealt out by their hash and classed, one bucket at a time; a seed whose class has one member ends here;
2. a seed's context is all that the W-runs around it can reach, both ways. Members of a class with equal contexts
   share all their runs, so one stands for them. Classes with one context are settled;
3. for the rest, the runs themselves are hashed, dealt out and compared.

Seeds and runs travel as packed arrays, a row for each batch of texts and bucket. Equal contexts are merged in each
batch before anything is shuffled, so a passage that a third of all documents share reaches its bucket once a batch.
Seeds compare by 32 bits within a bucket, where a false match only costs work; contexts by 48 bits within a seed's class,
and runs by 56 bits within a bucket.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm import common as c
from foliant.llm.words import Runs, find_words, hash_words, mix

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
PACK = "bucket int, kind int, a binary, b binary, row binary, pos binary"


def byte_tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return mix(np.arange(1, 257, dtype=np.uint64))[data], offs


def word_tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, ranges = find_words(data, offs)
    return hash_words(data, starts, ends), ranges


def cover_seeds(window: int, period: int):
    """Seeds at positions whose residue is in a difference cover: any two positions reach it at one offset < period."""
    inside = np.zeros(period, bool)
    inside[list(COVERS[period])] = True
    length = window - period + 1

    def seeds(runs: Runs, ranges: np.ndarray, text: np.ndarray, local: np.ndarray) -> np.ndarray:
        left = (ranges[1:] - ranges[:-1])[text] - local
        return np.flatnonzero(inside[local % period] & (left >= length) & (left + local >= window))

    return seeds, length


def winnowed_seeds(window: int, length: int):
    """Seeds that have the least hash (all of them, if several) among those in some window."""
    reach = window - length + 1

    def over(x: np.ndarray, n: int, best) -> np.ndarray:
        """best of x[i : i + n], for i up to len(x) - n."""
        size, got = 1, x
        while size * 2 <= n:
            got = best(got[:-size], got[size:])
            size *= 2
        return got if size == n else best(got[: len(x) - n + 1], got[n - size :])

    def seeds(runs: Runs, ranges: np.ndarray, text: np.ndarray, local: np.ndarray) -> np.ndarray:
        n = len(text)
        if n < window:
            return np.zeros(0, np.int64)
        at = np.arange(n - length + 1)
        gram = runs(at, at + length) | np.uint64(1)
        least = over(gram, reach, np.minimum)  # of the window that begins here
        fits = (ranges[1:][text] - np.arange(n) >= window)[: len(least)]
        least = np.where(fits, least, 0)
        wide = np.concatenate([np.zeros(reach - 1, np.uint64), least, np.zeros(reach - 1, np.uint64)])
        return np.flatnonzero(over(wide, reach, np.maximum) == gram)

    return seeds, length


def _texts(batch, tokens):
    """(row keys, token hashes, ranges, each token's text, its place in that text) of a batch in the order of row."""
    rows = c.longs(batch.column("row"))
    order = np.argsort(rows, kind="stable")
    if (np.diff(order) < 0).any():
        batch, rows = batch.take(pa.array(order)), rows[order]
    hashes, ranges = tokens(*c.flat(batch.column("text")))
    text = np.repeat(np.arange(len(rows)), np.diff(ranges))
    return rows, hashes, ranges, text, np.arange(len(hashes)) - ranges[text]


def _equal_runs(keys: list[np.ndarray]) -> np.ndarray:
    """True where a row of sorted keys differs from the one before."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = False
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return new


def _classes(a: np.ndarray, b: np.ndarray, row: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, ...]:
    """Order by (a, b, row, pos) of those whose a occurs twice or more; marks where a and where (a, b) begin anew."""
    by_a = np.argsort(a, kind="stable")
    new = _equal_runs([a[by_a]])
    alone = new & np.append(new[1:], True)
    some = by_a[~alone]
    order = some[np.lexsort((pos[some], row[some], b[some], a[some]))]
    return order, _equal_runs([a[order]]), _equal_runs([a[order], b[order]])


def _pack_rows(out: list, kind: int, bucket: np.ndarray, n: int, row, pos, a=None, b=None, width: int = 4) -> None:
    """A row for each bucket: row keys and positions and, where they are to be compared, keys a of width bytes and b."""
    more = [x for x in (a, b) if x is not None]
    for g, (r, p, *keys) in c.dealt(bucket, n, row, pos, *more):
        k = [c.planes(x, w) for x, w in zip(keys, (width, CONTEXT))] + [b"", b""]
        out.append((g, kind, k[0], k[1], c.planes(r, ROW), c.planes(p, POS)))


def _batch(out: list) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    columns = list(zip(*out)) if out else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, kinds)], ["bucket", "kind", "a", "b", "row", "pos"])


#: kinds of packed rows: seeds or runs to compare; marks: all runs around a seed repeat; seeds whose runs to compare; single runs that repeat.
COMPARE, SETTLED, REFINE, RUN = 0, 1, 2, 3
#: Bytes kept of each packed value: seeds in their bucket, contexts, runs in their bucket, row keys, positions.
SEED, CONTEXT, WHOLE, ROW, POS = 4, 6, 7, 8, 4


def repeated_runs(keyed: DataFrame, tokens, window: int, seeds, length: int, first_stays: bool, finish: Callable, schema: str) -> DataFrame:
    """finish(table of row and text, mask list) for all texts, as a DataFrame of ``schema``.

    keyed has row, doc_id and text. For each text, the mask tells which of its runs of ``window`` tokens repeat: occur
    anywhere else or, with first_stays, at a smaller (row, position) too.
    """
    spark = keyed.sparkSession
    parts = c.partitions(spark)
    buckets = parts
    reach = window - length

    def extract(batches):
        for whole in batches:
            for batch in c.slices(whole, "text"):
                rows, hashes, ranges, text, local = _texts(batch, tokens)
                runs = Runs(hashes)
                at = seeds(runs, ranges, text, local)
                if not len(at):
                    continue
                gram = runs(at, at + length)
                t = text[at]
                a, b = np.maximum(at - reach, ranges[t]), np.minimum(at + window, ranges[t + 1])
                context = runs(a, b) ^ mix((at - a).astype(np.uint64) * np.uint64(1 << 32) + (b - a).astype(np.uint64))
                row, pos = rows[t], local[at].astype(np.uint32)
                out: list = []
                # equal contexts within the batch: one stays, others are settled here
                key = mix(gram ^ (context * np.uint64(3)))
                order = np.argsort(key, kind="stable")
                new = _equal_runs([key[order]])
                again = order[~new]
                if len(again):
                    twice = again if first_stays else order[~new | ~np.append(new[1:], True)]
                    _pack_rows(out, SETTLED, c.part_of_array(row[twice], parts), parts, row[twice], pos[twice])
                    keep = np.ones(len(at), bool)
                    keep[again] = False
                    gram, context, row, pos = gram[keep], context[keep], row[keep], pos[keep]
                _pack_rows(out, COMPARE, ((gram >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), buckets, row, pos, gram.astype(np.uint32), context)
                yield _batch(out)

    def settle(table: pa.Table) -> pa.Table:
        kinds = table.column("kind").to_numpy()
        mine = table.filter(pa.array(kinds == COMPARE))
        out = [(r["bucket"], SETTLED, b"", b"", r["row"], r["pos"]) for r in table.filter(pa.array(kinds == SETTLED)).to_pylist()]
        gram, context, row, pos = (c.joined(mine.column(k), d, w) for k, d, w in (("a", np.uint32, SEED), ("b", np.uint64, CONTEXT), ("row", np.int64, ROW), ("pos", np.uint32, POS)))
        order, new_a, new_b = _classes(gram, context, row, pos)
        if len(order):
            group = np.cumsum(new_a) - 1
            contexts = np.bincount(group, weights=new_b)[group]
            size = np.diff(np.append(np.flatnonzero(new_b), len(order)))[np.cumsum(new_b) - 1]
            settled = order[~new_b if first_stays else size > 1]
            refine = order[new_b & (contexts > 1)]
            for kind, some in ((SETTLED, settled), (REFINE, refine)):
                _pack_rows(out, kind, c.part_of_array(row[some], parts), parts, row[some], pos[some])
        return pa.Table.from_batches([_batch(out)])

    def spread(marks: pa.Table, kind: int, rows: np.ndarray, ranges: np.ndarray, n: int) -> np.ndarray:
        """Positions in the batch that the marks of a kind stand for: the starts of runs around seeds, or of runs."""
        some = marks.filter(pa.array(marks.column("kind").to_numpy() == kind))
        row, pos = c.joined(some.column("row"), np.int64, ROW), c.joined(some.column("pos"), np.uint32, POS).astype(np.int64)
        t = np.searchsorted(rows, row)
        ok = (t < len(rows)) & (rows[np.minimum(t, len(rows) - 1)] == row)
        t, pos = t[ok], pos[ok]
        at = ranges[t] + pos
        change = np.zeros(n + 1, np.int32)
        np.add.at(change, np.maximum(at - (reach if kind != RUN else 0), ranges[t]), 1)
        np.add.at(change, at + 1, -1)
        return np.cumsum(change)[:n] > 0

    def pieces(texts: pa.Table):
        table = texts.sort_by("row")
        yield from c.slices(table, "text")

    def compare(texts: pa.Table, marks: pa.Table) -> pa.Table:
        out: list = []
        for batch in pieces(texts):
            rows, hashes, ranges, text, local = _texts(batch, tokens)
            n = len(hashes)
            want = spread(marks, REFINE, rows, ranges, n)
            if first_stays:  # what is known to have an earlier equal isn't the first of any
                want &= ~spread(marks, SETTLED, rows, ranges, n)
            at = np.flatnonzero(want & (ranges[1:][text] - np.arange(n) >= window)) if n else np.zeros(0, np.int64)
            if not len(at):
                continue
            key, bucket = Runs(hashes)(at, at + window), Runs(hashes, 1)(at, at + window)
            row, pos = rows[text[at]], local[at].astype(np.uint32)
            order = np.argsort(key, kind="stable")
            new = _equal_runs([key[order]])
            again = order[~new]
            if len(again):  # equal runs within the batch
                twice = again if first_stays else order[~new | ~np.append(new[1:], True)]
                _pack_rows(out, RUN, c.part_of_array(row[twice], parts), parts, row[twice], pos[twice])
                keep = np.ones(len(at), bool)
                keep[again] = False
                key, bucket, row, pos = key[keep], bucket[keep], row[keep], pos[keep]
            _pack_rows(out, COMPARE, (bucket % np.uint64(buckets)).astype(np.int64), buckets, row, pos, key, width=WHOLE)
        return pa.Table.from_batches([_batch(out)])

    def decide(table: pa.Table) -> pa.Table:
        kinds = table.column("kind").to_numpy()
        mine = table.filter(pa.array(kinds == COMPARE))
        out = [(r["bucket"], RUN, b"", b"", r["row"], r["pos"]) for r in table.filter(pa.array(kinds == RUN)).to_pylist()]
        key, row, pos = (c.joined(mine.column(k), d, w) for k, d, w in (("a", np.uint64, WHOLE), ("row", np.int64, ROW), ("pos", np.uint32, POS)))
        order, new, _ = _classes(key, np.zeros(len(key), np.uint8), row, pos)
        some = order[~new] if first_stays else order
        _pack_rows(out, RUN, c.part_of_array(row[some], parts), parts, row[some], pos[some])
        return pa.Table.from_batches([_batch(out)])

    def close(texts: pa.Table, marks: pa.Table) -> pa.Table:
        got = []
        for batch in pieces(texts):
            rows, hashes, ranges, text, local = _texts(batch, tokens)
            n = len(hashes)
            hit = spread(marks, SETTLED, rows, ranges, n) | spread(marks, RUN, rows, ranges, n)
            if n:
                hit &= ranges[1:][text] - np.arange(n) >= window
            change = np.zeros(n + 1, np.int32)
            at = np.flatnonzero(hit)
            change[at] += 1
            np.add.at(change, at + window, -1)
            got.append(finish(batch, np.cumsum(change)[:n] > 0, ranges))
        return pa.concat_tables(got) if got else finish(texts, np.zeros(0, bool), np.zeros(1, np.int64))

    texts = keyed.withColumn("part", c.part_of(F.col("row"), parts))
    seeds_table = keyed.select("row", "text").mapInArrow(extract, PACK)
    first, first_path = c.stored(_by_bucket(seeds_table).applyInArrow(settle, PACK), "seeds")
    refine = first if first_stays else first.where(F.col("kind") == REFINE)
    again = texts.select("part", "row", "text").groupBy("part").cogroup(refine.groupBy("bucket")).applyInArrow(compare, PACK)
    second, second_path = c.stored(_by_bucket(again).applyInArrow(decide, PACK), "runs")
    marks = first.where(F.col("kind") == SETTLED).unionByName(second)
    done = texts.groupBy("part").cogroup(marks.groupBy("bucket")).applyInArrow(close, schema)
    return done


def _by_bucket(df: DataFrame):
    """Groups by bucket; what is only passed on is spread over as many groups."""
    return df.groupBy("bucket")
