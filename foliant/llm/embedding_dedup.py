"""Near duplicates among embeddings by an inverted multi-index.

The index has two codebooks, one for each half of a unit vector; a pair of codewords is a cell, and each vector is kept
in the cell of its nearest codewords. A vector visits cells in ascending distance (the sum of both halves' distances:
the order of a multi-sequence) until that distance passes its nearest cell's by a margin. The margin is fitted: of
drawn neighbours at just the least cosine, the target share must be found by a visit of either of the two. What meets
in a cell is verified in double precision.

Equal vectors are one class. Where a group of near copies holds a good share of a drawn sample, its centre becomes a
core: vectors within half of the linking angle of it are linked with each other without comparison, so a group of any
size costs no pairs. Other vectors meet in blocks, and a pair of blocks gives sums of links and a forest of edges.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm import additive
from foliant.llm import common as c
from foliant.llm.components import components

COSINE, RECALL = 0.95, 0.999
#: Vectors that codebooks, margin and cores are fitted on, at most: those with the least digests of their ids.
SAMPLE = 16384
#: Vectors that a cell should have, and the most codewords of a half.
CELL, MOST_WORDS = 128, 1024
#: A core has at least this share of the sample, found among so many candidates.
CORE_SHARE, CORE_CANDIDATES = 1 / 512, 4096
BLOCK = 1024
#: Blocks of a cell on either side that one task meets.
TURN = 16
CODED = "id long, mass long, unit binary, home int, core int, visits array<int>"
PACKED = "cell int, core int, block long, ids binary, masses binary, units binary, homes binary, n_visits binary, visits binary"
MET = "id long, links long, other long"


def units(column, width: int) -> np.ndarray:
    """The vectors of a list column divided by their lengths; shorter ones count as if zeros followed."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.diff(column.offsets.to_numpy())
    x = np.zeros((len(column), width))
    x[np.arange(width) < size[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] + (book * book).sum(1) - 2 * x @ book.T


class Index:
    """Codebooks of both halves, the margin of a visit, and the cores' centres."""

    def __init__(self, sample: np.ndarray, n: int, cosine: float, recall: float, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.half, self.angle = -(-sample.shape[1] // 2), math.acos(cosine)
        words = int(min(MOST_WORDS, len(sample), max(1, math.ceil(math.sqrt(n / CELL)))))
        self.books = [additive._kmeans(x, words, rng) for x in (sample[:, : self.half], sample[:, self.half :])]
        x = sample[:CORE_CANDIDATES]
        u = rng.normal(size=x.shape)
        u -= (u * x).sum(1, keepdims=True) * x
        u /= np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-12)
        near = cosine * x + math.sin(self.angle) * u
        dx, dn = self.distances(x), self.distances(near)
        over = [self._excess(a, b) for a, b in ((dx, dn), (dn, dx))]
        self.margin = float(np.quantile(np.minimum(*over), recall)) + 1e-9
        self.cores = self._centres(sample)

    def distances(self, x: np.ndarray) -> list[np.ndarray]:
        return [_distances(part, book) for part, book in zip((x[:, : self.half], x[:, self.half :]), self.books)]

    @staticmethod
    def _excess(own: list[np.ndarray], other: list[np.ndarray]) -> np.ndarray:
        """How much farther than its own cell a vector finds the cell of the other one."""
        row = np.arange(len(own[0]))
        return sum(d[row, o.argmin(1)] - d.min(1) for d, o in zip(own, other))

    def _centres(self, sample: np.ndarray) -> np.ndarray:
        least = max(16, int(len(sample) * CORE_SHARE))
        few = range(0, min(len(sample), CORE_CANDIDATES), 256)  # a slice at a time: of the products only a bit each is kept
        inside = np.concatenate([sample[i : min(i + 256, CORE_CANDIDATES)] @ sample.T >= math.cos(self.reach) for i in few])
        count, out = inside.sum(1), []
        while len(count) and count.max() >= least:
            i = int(count.argmax())
            centre = sample[inside[i]].mean(0)
            centre /= np.linalg.norm(centre)
            gone = sample @ centre >= math.cos(self.reach)
            if gone.sum() >= least:
                out.append(centre)
            gone |= inside[i]
            inside[:, gone] = False
            count = inside.sum(1)
        return np.array(out).reshape(-1, sample.shape[1])

    @property
    def reach(self) -> float:
        """Two vectors within it of one centre have the least cosine or more, rounding included."""
        return self.angle / 2 - 1e-6

    def core(self, x: np.ndarray) -> np.ndarray:
        """Number of the nearest core that reaches each vector, from 1; 0: none does."""
        if not len(self.cores):
            return np.zeros(len(x), np.int32)
        s = x @ self.cores.T
        return np.where(s.max(1) >= math.cos(self.reach), s.argmax(1) + 1, 0).astype(np.int32)

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(own cell of each vector, vector and cell of each visit), nearest cells of a vector first along each codeword."""
        d = self.distances(x)
        orders = [np.argsort(y, axis=1, kind="stable") for y in d]
        near = [np.take_along_axis(y, o, 1) for y, o in zip(d, orders)]
        limit = near[0][:, 0] + near[1][:, 0] + self.margin
        words = len(self.books[1])
        rows, cells = [], []
        for i in range(near[0].shape[1]):
            some = np.flatnonzero(near[0][:, i] + near[1][:, 0] <= limit)
            if not len(some):
                break
            for j in range(words):
                some = some[near[0][some, i] + near[1][some, j] <= limit[some]]
                if not len(some):
                    break
                rows.append(some)
                cells.append(orders[0][some, i] * words + orders[1][some, j])
        return orders[0][:, 0] * words + orders[1][:, 0], np.concatenate(rows), np.concatenate(cells)


def _coded(classes: DataFrame, index: Index, width: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 4 * BLOCK):
                part = batch.slice(a, 4 * BLOCK)
                x = units(part.column("v"), width)
                home, rows, cells = index.visits(x)
                order = np.argsort(rows, kind="stable")
                ends = np.append(0, np.cumsum(np.bincount(rows, minlength=len(x)))).astype(np.int32)
                visits = pa.ListArray.from_arrays(pa.array(ends), pa.array(cells[order].astype(np.int32)))
                packed = pa.array([row.tobytes() for row in x], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("mass"), packed, pa.array(home.astype(np.int32)), pa.array(index.core(x)), visits], [f.split()[0] for f in CODED.split(", ")])

    return classes.select("id", "mass", "v").mapInArrow(run, CODED)


def _packed(rows: DataFrame) -> DataFrame:
    """PACKED: blocks of up to BLOCK rows of one cell and core. Ranges split large cells, so none goes to one task."""
    spark = rows.sparkSession
    keys = ["cell", "core", "turn"]
    dealt = rows.withColumn("turn", F.xxhash64("id")).repartitionByRange(c.partitions(spark), *keys).sortWithinPartitions(*keys)
    names = [f.split()[0] for f in PACKED.split(", ")]

    def block(parts):
        table = pa.Table.from_batches(parts).combine_chunks()
        get = lambda x: table.column(x).to_numpy()
        visits = table.column("visits").combine_chunks()
        n_visits = np.array([len(v) for v in visits], np.int32)
        data = [get("id").tobytes(), get("mass").tobytes(), b"".join(table.column("unit").to_pylist()), get("home").tobytes(), n_visits.tobytes(), np.sort(_tagged(visits, n_visits)).tobytes()]
        head = [pa.array([get("cell")[0]], pa.int32()), pa.array([get("core")[0]], pa.int32()), pa.array([get("id")[0]], pa.int64())]
        return pa.RecordBatch.from_arrays([*head, *(pa.array([d], pa.binary()) for d in data)], names)

    def run(batches):
        held, size, key = [], 0, None
        for batch in batches:
            cell, core = (batch.column(x).to_numpy() for x in ("cell", "core"))
            cuts = np.flatnonzero((cell[1:] != cell[:-1]) | (core[1:] != core[:-1])) + 1
            for a, b in zip(np.append(0, cuts), np.append(cuts, batch.num_rows)):
                if a == b:
                    continue
                if held and key != (cell[a], core[a]):
                    yield block(held)
                    held, size = [], 0
                key = cell[a], core[a]
                while a < b:
                    n = min(b - a, BLOCK - size)
                    held.append(batch.slice(a, n))
                    size, a = size + n, a + n
                    if size == BLOCK:
                        yield block(held)
                        held, size = [], 0
        if held:
            yield block(held)

    return dealt.select("cell", "core", "id", "mass", "unit", "home", "visits").mapInArrow(run, PACKED)


def _tagged(visits, counts: np.ndarray) -> np.ndarray:
    """Each visit as row << 32 | cell; sorted, they show by binary search whether a row visits a cell."""
    return np.repeat(np.arange(len(counts), dtype=np.int64) << 32, counts) | visits.flatten().to_numpy().astype(np.int64)


def _forest(a: np.ndarray, b: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what the links join: the links themselves, or where they are many, each id's least in reach."""
    if linked.sum() <= len(a) + len(b):
        i, j = np.nonzero(linked)
        return a[i], b[j]
    most = np.iinfo(np.int64).max
    la, lb = a.copy(), b.copy()
    while True:
        new_b = np.minimum(lb, np.where(linked, la[:, None], most).min(0))
        new_a = np.minimum(la, np.where(linked, new_b, most).min(1))
        if (new_a == la).all() and (new_b == lb).all():
            ids, labels = np.append(a, b), np.append(la, lb)
            return ids[ids != labels], labels[ids != labels]
        la, lb = new_a, new_b


def _meet(probes, kept, width: int, cosine: float):
    """Links between a block of visitors and a block of a cell: (ids, their linked mass), (edges).

    Two that visit each other's cells meet twice; that counts where the visitor has the lesser id.
    """
    ids, mass, x, home = probes
    own, own_mass, y, tags = kept
    linked = x.reshape(-1, width) @ y.reshape(-1, width).T >= cosine
    linked &= ids[:, None] != own
    if linked.any():
        homes, which = np.unique(home, return_inverse=True)
        asked = (np.arange(len(own), dtype=np.int64) << 32)[:, None] | homes.astype(np.int64)
        at = np.minimum(np.searchsorted(tags, asked), len(tags) - 1)
        linked &= ~(tags[at] == asked)[:, which].T | (ids[:, None] < own)
    links = np.append(linked @ own_mass, mass @ linked)
    all_ids = np.append(ids, own)
    return all_ids[links > 0], links[links > 0], *_forest(ids, own, linked)


def _met(coded: DataFrame, width: int, cosine: float) -> DataFrame:
    """(id, links, other): sums of links of each two blocks that meet, and edges (links 0)."""
    spark = coded.sparkSession
    none = F.array().cast("array<int>").alias("visits")
    kept, kept_path = c.stored(_packed(coded.select(F.col("home").alias("cell"), "core", "id", "mass", "unit", "home", "visits")), "cells")
    probes, probes_path = c.stored(_packed(coded.select(F.explode("visits").alias("cell"), "core", "id", "mass", "unit", "home", none)), "visits")
    counts = [df.groupBy("cell").agg(F.count(F.lit(1)).alias(n)) for df, n in ((kept, "k"), (probes, "p"))]
    # cells of very many blocks; a row for each, fewer than cells, of which there are MOST_WORDS ** 2 at most
    turns = counts[0].join(counts[1], "cell").where(F.greatest("k", "p") > TURN).selectExpr("cell", f"cast(ceil(k / {TURN}) as int) k", f"cast(ceil(p / {TURN}) as int) p")
    sides = []
    for df, own, other in ((kept, "k", "p"), (probes, "p", "k")):
        told = df.join(F.broadcast(turns), "cell", "left").withColumns({x: F.coalesce(x, F.lit(1)) for x in "kp"})
        told = told.withColumn(f"turn_{own}", F.pmod(F.xxhash64("block"), F.col(own)).cast("int")).withColumn(f"turn_{other}", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        sides.append(told.select("cell", "turn_k", "turn_p", *(F.col(x).alias(f"{own}_{x}") for x in ("core", "ids", "masses", "units", "homes", "visits"))).repartition(c.partitions(spark), "cell", "turn_k", "turn_p"))
    pairs = sides[0].hint("merge").join(sides[1].hint("merge"), ["cell", "turn_k", "turn_p"]).where("p_core <> k_core or p_core = 0")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda x, kind: np.frombuffer(batch.column(x)[i].as_py(), kind)
                probe = get("p_ids", np.int64), get("p_masses", np.int64), get("p_units", float), get("p_homes", np.int32)
                mine = get("k_ids", np.int64), get("k_masses", np.int64), get("k_units", float), get("k_visits", np.int64)
                ids, links, a, b = _meet(probe, mine, width, cosine)
                if len(ids):
                    other = pa.concat_arrays([pa.nulls(len(ids), pa.int64()), pa.array(b, pa.int64())])
                    yield pa.RecordBatch.from_arrays([pa.array(np.append(ids, a)), pa.array(np.append(links, np.zeros(len(a), np.int64))), other], ["id", "links", "other"])

    made, _ = c.stored(pairs.select("p_ids", "p_masses", "p_units", "p_homes", "k_ids", "k_masses", "k_units", "k_visits").mapInArrow(run, MET), "met")
    c.delete(spark, kept_path)
    c.delete(spark, probes_path)
    return made


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each id of the table.

    n_links: how many other vectors have a cosine of at least ``cosine`` (0 < cosine < 1) with it, as far as the index
    finds them; none is counted below it. component_id: the least id that links reach. kept: whether that is its own.
    Vectors that are null, zero or hold null or non-finite components link with nothing. Null ids have no row; of rows
    that share an id the one with the greatest vector counts. Components missing in a shorter vector count as zero.
    An empty table gives no rows. Other columns are ignored.
    """
    if not 0 < cosine < 1:
        raise ValueError("cosine must be between 0 and 1")
    spark = vectors.sparkSession
    named = vectors.select(F.col(id_col).cast("long").alias("vec_id")).where("vec_id is not null").distinct()
    known, known_path = c.stored(additive.usable(vectors, id_col, vector_col).groupBy("vec_id").agg(F.max("v").alias("v")), "vectors")
    n_known, width = known.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not n_known:
        return named.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    classes, classes_path = c.stored(known.groupBy("v").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("mass")), "classes")
    sample = classes.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow()
    index = Index(units(sample.column("v"), width), classes.count(), cosine, recall)
    coded, coded_path = c.stored(_coded(classes, index, width), "coded")
    met = _met(coded, width, cosine)
    # a row for each core, which are fewer than 1 / CORE_SHARE
    cores = F.broadcast(coded.where("core > 0").groupBy("core").agg(F.sum("mass").alias("core_mass"), F.min("id").alias("first")))
    within = coded.select("id", "mass", "core").join(cores, "core", "left")
    edges = met.where("other is not null").selectExpr("id a", "other b").unionByName(within.where("first < id").selectExpr("id a", "first b"))
    sums = met.where("other is null").groupBy("id").agg(F.sum("links").alias("links"))
    linked = within.join(sums, "id", "left").join(components(edges), "id", "left")
    facts = linked.select("id", (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("core_mass") - F.col("mass"), F.lit(0)) + F.col("mass") - 1).alias("n_links"), F.coalesce("label", "id").alias("component_id"))
    facts = classes.join(facts, "id").select("v", "mass", "n_links", "component_id")
    each = c.looked_up(known, facts, ["v"], "mass", n_known).select("vec_id", "n_links", "component_id")
    whole = named.join(each, "vec_id", "left")
    whole = whole.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    made, _ = c.stored(whole.withColumn("kept", F.col("vec_id") == F.col("component_id")), "linked")
    for path in (known_path, classes_path, coded_path):
        c.delete(spark, path)
    return made


#: All pairs, and what links reach.
ORACLE = """
with recursive ids as (select distinct vec_id from embeddings where vec_id is not null),
v as (select vec_id, max(embedding::double[]) as v from embeddings
      where embedding is not null and vec_id is not null and len(embedding) > 0
        and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0 group by vec_id),
n as (select vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) as n from v),
l as (select x.vec_id as a, y.vec_id as b from n x join n y on x.vec_id <> y.vec_id
      where list_sum(list_transform(list_zip(x.v, y.v), lambda p: p[1] * p[2])) / (x.n * y.n) >= 0.95),
r(a, b) as (select vec_id, vec_id from ids union select r.a, l.b from r join l on r.b = l.a),
k as (select a, count(*) as n_links from l group by a)
select a as vec_id, coalesce(any_value(n_links), 0)::bigint as n_links, min(b) as component_id, min(b) = a as kept from r left join k using (a) group by a
"""
