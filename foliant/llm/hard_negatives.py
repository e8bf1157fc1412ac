"""Hard negatives: for each anchor and each of its positives, the best-scoring rows of other labels just below it.

Scores are integer inner products. An anchor's scores are sorted in full, by score and then id; a positive's score is
an upper limit that binary search finds in the sorted list, and the next rows of another label down to the lower limit
are its negatives. A list is as long as the table, so it is sorted in pieces: rows travel in blocks, anchors too, and
every block of anchors meets every block of rows (a stated set of queries against all rows) in tiles of both, dealt
by the tile's two numbers. From each sorted piece go only what could still be among the first k; tasks merge what
their pieces give, and a window over what the tasks give has the last word.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm import common as c

ROW_BLOCK, ANCHOR_BLOCK = 2048, 256
#: Blocks on each side of a tile, where the table is large enough.
TILE = 64
#: Found rows that a task gathers before it drops those beyond the first k.
GATHERED = 1 << 18
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
BLOCK = "tile int, ids binary, labels binary, sizes binary, data binary, n_pos binary, pos_ids binary, pos_scores binary"
POSITIVES = "anchor_id long, positive_id long, positive_score long"
NEGATIVES = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", relabel_every: int = 7, labels: int = 10) -> DataFrame:
    """(vec_id, label, v array<double>) of the rows that take part.

    Left out: null ids, labels or vectors, and vectors with null or non-finite components. Of rows that share an id
    the one with the greatest label and then vector counts. Where the id is divisible by ``relabel_every`` the label
    becomes (label + 1) % labels.
    """
    v, vec, label = F.col(vector_col).cast("array<double>"), F.col(id_col).cast("long"), F.col(label_col).cast("long")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = vectors.select(vec.alias("vec_id"), label.alias("label"), v.alias("v")).where("vec_id is not null and label is not null and v is not null").where(whole)
    one = some.groupBy("vec_id").agg(F.max(F.struct("label", "v")).alias("x")).select("vec_id", "x.label", "x.v")
    return one.withColumn("label", F.when(F.pmod("vec_id", F.lit(relabel_every)) == 0, (F.col("label") + 1) % labels).otherwise(F.col("label")))


def _packed(df: DataFrame, tiles: int, size: int) -> DataFrame:
    """BLOCK rows: blocks of up to ``size`` rows each, dealt by the id's hash to ``tiles`` tiles; ids ascend in a block."""
    spark = df.sparkSession
    if "positives" not in df.columns:
        df = df.withColumn("positives", F.lit(None).cast("array<struct<id:long,score:long>>"))
    dealt = df.withColumn("tile", F.pmod(F.xxhash64("vec_id"), F.lit(tiles)).cast("int")).repartition(c.partitions(spark), "tile").sortWithinPartitions("tile")

    def block(rows):
        rows.sort(key=lambda r: r[1])
        pos = [r[4] or [] for r in rows]
        flat = [p for some in pos for p in some]
        arrays = (
            np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64), np.array([len(r[3]) for r in rows], np.int64),
            np.concatenate([np.asarray(r[3], float) for r in rows]), np.array([len(p) for p in pos], np.int64), np.array([p["id"] for p in flat], np.int64), np.array([p["score"] for p in flat], np.int64),
        )
        return pa.RecordBatch.from_arrays([pa.array([rows[0][0]], pa.int32()), *(pa.array([a.tobytes()], pa.binary()) for a in arrays)], [x.split()[0] for x in BLOCK.split(", ")])

    def run(batches):
        held = []
        for batch in batches:
            columns = [batch.column(x) for x in ("tile", "vec_id", "label", "v", "positives")]
            vectors = columns[3].flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum([0, *(len(x) for x in columns[3])])
            plain = [columns[i].to_pylist() for i in (0, 1, 2, 4)]
            for i in range(batch.num_rows):
                if held and (held[0][0] != plain[0][i] or len(held) >= size):
                    yield block(held)
                    held = []
                held.append((plain[0][i], plain[1][i], plain[2][i], vectors[ends[i] : ends[i + 1]], plain[3][i]))
        if held:
            yield block(held)

    return dealt.select("tile", "vec_id", "label", "v", "positives").mapInArrow(run, BLOCK)


class _Block:
    """A block's arrays; vectors shorter than others count as if zeros followed."""

    def __init__(self, batch, i: int, prefix: str):
        get = lambda x, kind: np.frombuffer(batch.column(prefix + x)[i].as_py(), kind)
        self.ids, self.labels, self.sizes = (get(x, np.int64) for x in ("ids", "labels", "sizes"))
        self.n_pos, self.pos_ids, self.pos_scores = (get(x, np.int64) for x in ("n_pos", "pos_ids", "pos_scores"))
        self.data = get("data", float)

    def matrix(self, width: int) -> np.ndarray:
        out = np.zeros((len(self.ids), width))
        out[np.arange(width) < self.sizes[:, None]] = self.data
        return out


def _whole(x: float) -> int:
    return int(x) * 256 if abs(x) >= 1 << 53 else math.floor(256 * x)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of a with all rows of b, components being floor(256 * x).

    Doubles are exact up to 2^53; where sums could pass that, Python's integers take over, and what a long can't hold
    becomes the nearest that it can.
    """
    x, y = np.floor(256 * a), np.floor(256 * b)
    most = float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * a.shape[1]
    if most < 1 << 53:
        return (x @ y.T).astype(np.int64)
    large = [[[_whole(v) for v in row] for row in m.tolist()] for m in (a, b)]
    return np.array([[min(max(sum(p * q for p, q in zip(r, s)), _LEAST), _MOST) for s in large[1]] for r in large[0]], np.int64).reshape(len(a), len(b))


def _sorted(anchors: _Block, rows: _Block):
    """Per anchor: scores from the highest (ties: ascending ids), which row each is, and those rows' ids and labels."""
    width = int(max(anchors.sizes.max(initial=0), rows.sizes.max(initial=0)))
    s = scores(anchors.matrix(width), rows.matrix(width))
    order = np.lexsort((np.broadcast_to(rows.ids, s.shape), ~s), axis=1)  # ~s falls as s rises, and never overflows
    return np.take_along_axis(s, order, 1), rows.ids[order], rows.labels[order]


def _positives(anchors: _Block, rows: _Block, k: int):
    s, ids, labels = _sorted(anchors, rows)
    fits = (labels == anchors.labels[:, None]) & (ids != anchors.ids[:, None])
    q, at = np.nonzero(fits & (np.cumsum(fits, axis=1) <= k))
    return anchors.ids[q], ids[q, at], s[q, at]


def _negatives(anchors: _Block, rows: _Block, k: int, low: int, high: int):
    s, ids, labels = _sorted(anchors, rows)
    first = np.cumsum(anchors.n_pos) - anchors.n_pos
    out = []
    for q in np.flatnonzero(anchors.n_pos):
        falling = ~s[q]
        other = np.flatnonzero(labels[q] != anchors.labels[q])
        for p in range(first[q], first[q] + anchors.n_pos[q]):
            upper = int(anchors.pos_scores[p])
            lower = -(-low * upper // high)  # the least integer n with low * upper <= high * n
            if lower > upper:
                continue
            a = np.searchsorted(falling, ~upper)  # the first score at most the limit
            b = np.searchsorted(falling, ~lower, "right")
            i = np.searchsorted(other, a)
            at = other[i : i + k]
            at = at[at < b]
            if len(at):
                out.append((np.full(len(at), anchors.ids[q]), np.full(len(at), anchors.pos_ids[p]), np.full(len(at), upper), ids[q, at], s[q, at]))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 5


def _first(columns: list[np.ndarray], keys: int, k: int) -> list[np.ndarray]:
    """The first k of each group (the first ``keys`` columns), by the last column from the highest, then the one before."""
    order = np.lexsort((columns[-2], ~columns[-1], *columns[:keys][::-1]))
    columns = [x[order] for x in columns]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([x[1:] != x[:-1] for x in columns[:keys]], axis=0)
    starts = np.flatnonzero(new)
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return [x[rank < k] for x in columns]


def _met(anchors: DataFrame, rows: DataFrame, anchor_tiles: int, row_tiles: int, find, keys: int, k: int, schema: str) -> DataFrame:
    """What find(anchors' block, rows' block) gives for each two blocks, cut to the first k of a group in each task."""
    n = c.partitions(anchors.sparkSession)
    sides = []
    for df, own, other, others, prefix in ((rows, "rt", "at", anchor_tiles, "r_"), (anchors, "at", "rt", row_tiles, "a_")):
        named = df.select(F.col("tile").alias(own), *(F.col(x).alias(prefix + x) for x in df.columns if x != "tile"))
        sides.append(named.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1)))).repartition(n, "rt", "at"))
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        held, size = [], 0

        def cut():
            return _first([np.concatenate(x) for x in zip(*held)], keys, k)

        for batch in batches:
            for i in range(batch.num_rows):
                got = find(_Block(batch, i, "a_"), _Block(batch, i, "r_"))
                if len(got[0]):
                    held.append(got)
                    size += len(got[0])
                if size > GATHERED:
                    kept = cut()
                    held, size = [kept], len(kept[0])
                    if size > GATHERED // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in kept], names)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cut()], names)
        c.give_back()

    used = [f"{p}{x.split()[0]}" for p in ("a_", "r_") for x in BLOCK.split(", ")[1:]]
    return sides[0].hint("merge").join(sides[1].hint("merge"), ["rt", "at"]).select(*used).mapInArrow(run, schema)


def mine(vectors: DataFrame, every: int = 100, k_positives: int = 5, k_negatives: int = 5, low: int = 80, high: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each anchor, a row whose id is
    divisible by ``every``.

    Positives: the anchor's k_positives best other rows of its label. Negatives: for each positive the first
    k_negatives rows of other labels with low * positive_score <= high * negative_score <= high * positive_score.
    Higher scores come first, ties by smaller id. usable() says which rows take part. Components missing in a shorter
    vector count as zero; scores beyond a long's range become its ends. An anchor without positives, a positive
    without negatives and an empty table give no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    known, known_path = c.stored(usable(vectors, id_col, vector_col, label_col), "labelled", large=False)
    asked = known.where(F.pmod("vec_id", F.lit(every)) == 0)
    n_rows, n_asked = known.count(), asked.count()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n_asked:
        c.delete(spark, known_path)
        return spark.createDataFrame([], schema)
    wanted = c.partitions(spark)
    row_tiles = min(-(-n_rows // ROW_BLOCK), max(wanted, -(-n_rows // (ROW_BLOCK * TILE))))
    anchor_tiles = -(-n_asked // (ANCHOR_BLOCK * TILE))
    rows, rows_path = c.stored(_packed(known, row_tiles, ROW_BLOCK), "rows")
    found = _met(_packed(asked, anchor_tiles, ANCHOR_BLOCK), rows, anchor_tiles, row_tiles, lambda a, r: _positives(a, r, k_positives), 1, k_positives, POSITIVES)
    turn = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    positives = found.withColumn("n", turn).where(F.col("n") <= k_positives).groupBy("anchor_id").agg(F.collect_list(F.struct(F.col("positive_id").alias("id"), F.col("positive_score").alias("score"))).alias("positives"))
    anchors, anchors_path = c.stored(asked.join(positives, asked.vec_id == positives.anchor_id).drop("anchor_id"), "anchors")
    met = _met(_packed(anchors, anchor_tiles, ANCHOR_BLOCK), rows, anchor_tiles, row_tiles, lambda a, r: _negatives(a, r, k_negatives, low, high), 2, k_negatives, NEGATIVES)
    turn = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    made, _ = c.stored(met.withColumn("rank", turn).where(F.col("rank") <= k_negatives).select(*(x.split()[0] for x in schema.split(", "))), "negatives")
    for path in (known_path, rows_path, anchors_path):
        c.delete(spark, path)
    return made


#: The same by all scores of each anchor.
ORACLE = """
with w as (select vec_id, label::bigint as label, embedding::double[] as v from embeddings where vec_id is not null and label is not null and embedding is not null
             and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
u as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(v, lambda x: floor(256 * x)::hugeint) as v
      from (select *, row_number() over (partition by vec_id order by label desc, v desc) as n from w) where n = 1),
s as (select a.vec_id as anchor_id, r.vec_id, r.label = a.label as same,
             coalesce(list_sum(list_transform(list_zip(a.v, r.v), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))), 0)::bigint as score
      from u a join u r on a.vec_id <> r.vec_id where a.vec_id % 100 = 0),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same
      qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select p.anchor_id, positive_id, row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id)::int as rank, vec_id as negative_id, positive_score, score as negative_score
from p join s on s.anchor_id = p.anchor_id and not same and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score
qualify row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id) <= 5
"""
