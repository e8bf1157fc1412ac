"""In how many texts of a corpus each hash occurs: exact counts, by one exchange of packed hashes.

Texts are dealt to parts by their row. A part asks the bucket of each of its hashes: each slice of texts sends a hash
once, with the number of its texts that have it, so what all texts share arrives once a slice. A bucket adds up and
answers the parts that asked with the hashes that occur more than once; of a hash without an answer there is one.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm import common as c

ASK = "bucket int, part int, hashes binary, counts binary"
ANSWER = "part int, hashes binary, counts binary"
_COUNT = 4
#: Buckets of hashes, where there are not more parts: a bucket is sorted in a worker's memory.
LEAST_BUCKETS = 64


def dealt_texts(keyed: DataFrame, parts: int) -> DataFrame:
    """keyed (row and others) with ``part``, which tallied() answers."""
    return keyed.withColumn("part", c.part_of(F.col("row"), parts))


def tallied(texts: DataFrame, parts: int, hashes: Callable) -> DataFrame:
    """ANSWER rows for the texts of dealt_texts(): hashes(batch) gives (hash, text number) of each text's distinct hashes."""

    buckets = max(parts, LEAST_BUCKETS)

    def ask(batches):
        for whole in batches:
            for batch in c.slices(whole, "text"):
                h, text = hashes(batch)
                if not len(h):
                    continue
                part, of = np.unique(c.longs(batch.column("part")), return_inverse=True)
                group = of[text]
                order = np.lexsort((h, group))
                h, group = h[order], group[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (group[1:] != group[:-1])
                first = np.flatnonzero(new)
                n = np.diff(np.append(first, len(h))).astype(np.uint32)
                h, group = h[first], group[first]
                bucket = (((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
                place = group * buckets + bucket  # ascends: hashes do in each group, and buckets are their ranges
                ends = np.flatnonzero(np.append(place[1:] != place[:-1], True)) + 1
                starts = np.append(0, ends[:-1])
                columns = [
                    pa.array(bucket[starts], pa.int32()),
                    pa.array(part[group[starts]], pa.int32()),
                    pa.array([c.planes(h[a:b], 8) for a, b in zip(starts, ends)], pa.binary()),
                    pa.array([c.planes(n[a:b], _COUNT) for a, b in zip(starts, ends)], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "part", "hashes", "counts"])

    def answer(table: pa.Table) -> pa.Table:
        h, n = c.joined(table.column("hashes"), np.uint64, 8), c.joined(table.column("counts"), np.uint32, _COUNT).astype(np.int64)
        size = np.diff(c.flat(table.column("hashes"))[1]) // 8
        part = np.repeat(c.longs(table.column("part").combine_chunks()).astype(np.int32), size)
        order = np.lexsort((part, h))
        h, n, part = h[order], n[order], part[order]
        starts = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
        total = np.add.reduceat(n, starts) if len(h) else n
        each = np.repeat(total, np.diff(np.append(starts, len(h))))
        keep = each > 1
        keep[1:] &= (h[1:] != h[:-1]) | (part[1:] != part[:-1])
        h, each, part = h[keep], np.minimum(each[keep], 0xFFFFFFFF).astype(np.uint32), part[keep]
        parts_, of = np.unique(part, return_inverse=True)
        out = [(int(parts_[g]), c.planes(a, 8), c.planes(b, _COUNT)) for g, (a, b) in c.dealt(of, len(parts_), h, each)] if len(h) else []
        columns = list(zip(*out)) if out else [[]] * 3
        c.give_back()
        return pa.Table.from_arrays([pa.array(v, t) for v, t in zip(columns, (pa.int32(), pa.binary(), pa.binary()))], ["part", "hashes", "counts"])

    asked = texts.select("part", "text").repartition(parts, "part").mapInArrow(ask, ASK)
    return asked.groupBy("bucket").applyInArrow(answer, ANSWER)


class Tally:
    """The counts that a part's answers hold, 1 where they have none."""

    def __init__(self, answers: pa.Table):
        h, n = c.joined(answers.column("hashes"), np.uint64, 8), c.joined(answers.column("counts"), np.uint32, _COUNT)
        order = np.argsort(h, kind="stable")
        self.h, self.n = h[order], n[order].astype(np.int64)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        if not len(self.h):
            return np.ones(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return np.where(self.h[at] == h, self.n[at], 1)
