"""Near-duplicates by improved consistent weighted sampling (ICWS) over TF-IDF word shingles.

Weights: a shingle's weight in a text is how often it occurs there times its idf, ln((1 + N) / (1 + df)) + 1, not below
1, rounded to quarters. df counts all texts exactly, see tallies. Samples are banded; texts that share a band are
candidates, and a pair is linked if its weighted Jaccard similarity, on whole texts, reaches the threshold.

Each bucket's text of the most common shingles leads it. A text is first compared with one leader, that of most of its
buckets; features of a text travel once for that, and a leader's once for each few thousand of its members. Components
of what passed follow. Then all pairs of open buckets, those whose texts are still in different components, are searched by
prefix filtering, which is exact: two texts of that similarity share a shingle among each one's rarest, up to the first
that make over 1 - threshold of its weight, and what comes before the first that they share can't be in both, so it must
leave enough of either text. Texts of one component don't meet, so a group of near copies costs a pair for each member
and few more, and no link between components is lost.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm import common as c
from foliant.llm.components import components
from foliant.llm.tallies import Tally, dealt_texts, tallied
from foliant.llm.words import find_words, hash_words, mix, shingles

BANDS, ROWS = 16, 5
_CELLS = 1 << 16
#: Weights that a batch looks up in tables, the most common ones; others are worked out one by one.
_KINDS = 64
#: Shingles of a leader's members that stay together, about, and of all members that a task holds.
_SHARE, _BUNDLE = 1 << 16, 1 << 20
SIGNATURE = "row long, doc_id long, k1 long, k2 long, size int, common int, bands array<long>"
FEATURES = "row long, leader long, salt int, salts int, features binary, total long, prefix array<struct<token: int, before: long>>"


def _distinct(batch, words: int):
    """(hash, how often, text number) of each text's distinct shingles, in the order of text and hash."""
    data, offs = c.flat(batch.column("text"))
    starts, ends, ranges = find_words(data, offs)
    hashes, bounds = shingles(hash_words(data, starts, ends), ranges, words)
    n = len(bounds) - 1
    text = np.repeat(np.arange(n), np.diff(bounds))
    order = np.argsort(hashes, kind="stable")
    order = order[np.argsort(text[order].astype(np.uint16) if n < 1 << 16 else text[order], kind="stable")]
    h, t = hashes[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    first = np.flatnonzero(new)
    return h[first], np.diff(np.append(first, len(h))), t[first]


def idf_quarters(df: np.ndarray, n: int) -> np.ndarray:
    """The idf in quarters of shingles that df of n texts have."""
    return np.rint(4 * np.maximum(np.log((1 + n) / (1 + df)) + 1, 1)).astype(np.int64)


class Sampler:
    """ICWS samples of 64 bits: the least value a, as a 32-bit float, and 32 bits of the shingle that has it.

    A shingle's random numbers come from its hash times an odd number for each sample: 16 bits pick (r, beta), the next
    16 pick c, so two shingles that aren't equal share all of them about once in 2^32.
    """

    def __init__(self, samples: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.r = rng.gamma(2, 1, _CELLS)
        self.beta = rng.random(_CELLS)
        self.c = rng.gamma(2, 1, _CELLS).astype(np.float32)
        self.odd = rng.integers(0, 1 << 63, samples, np.uint64) * np.uint64(2) + np.uint64(1)
        self.known: dict[int, np.ndarray] = {}

    def _share(self, log_weight, cells) -> np.ndarray:
        """a / c of cells at a weight: exp(-r (t - beta) - r), t whole; equal for equal t."""
        t = np.floor(log_weight / self.r[cells] + self.beta[cells])
        return np.exp(-self.r[cells] * (t - self.beta[cells]) - self.r[cells]).astype(np.float32)

    def _cells(self, weight: int) -> np.ndarray:
        if weight not in self.known:
            if len(self.known) >= 2 * _KINDS:
                self.known.clear()
            self.known[weight] = self._share(math.log(weight / 4), slice(None))
        return self.known[weight]

    def __call__(self, h: np.ndarray, weight: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """A row of samples for each text; starts are the texts' first shingles, each has one at least."""
        kinds, which, often = np.unique(weight, return_inverse=True, return_counts=True)
        top = np.argsort(-often, kind="stable")[:_KINDS]
        table = np.concatenate([self._cells(int(kinds[i])) for i in top])
        place = np.full(len(kinds), -1)
        place[top] = np.arange(len(top))
        place = place[which]
        rare = np.flatnonzero(place < 0)
        logs = np.array([math.log(k / 4) for k in kinds])[which[rare]]
        base = np.maximum(place, 0).astype(np.int32) << 16
        out = np.empty((len(starts), len(self.odd)), np.uint64)
        for k, odd in enumerate(self.odd):
            drawn = h * odd
            parts = drawn.view(np.uint16).reshape(-1, 4)  # little-endian: 0 and 1 tell the shingle, 2 picks c, 3 picks r and beta
            values = table[base | parts[:, 3]]
            if len(rare):
                values[rare] = self._share(logs, parts[rare, 3])
            values *= self.c[parts[:, 2]]
            drawn.view(np.uint32)[1::2] = values.view(np.uint32)  # positive floats order as their bits do
            out[:, k] = np.minimum.reduceat(drawn, starts)
        return out


def _weights(h: np.ndarray, often: np.ndarray, tally: Tally, n: int) -> np.ndarray:
    return np.minimum(often * idf_quarters(tally(h), n), 0xFFFFFF)


def _signed(texts: pa.Table, answers: pa.Table, words: int, n_texts: int) -> pa.Table:
    tally, sampler, got = Tally(answers), Sampler(BANDS * ROWS), []
    for batch in c.slices(texts, "text", c.FINE_BYTES):
        h, often, text = _distinct(batch, words)
        n = batch.num_rows
        has, starts = np.unique(text, return_index=True)
        bands: list = [[] for _ in range(n)]
        size, common = np.zeros(n, np.int32), np.zeros(n, np.int32)  # common: the mean weight of a shingle, small where others have them too
        if len(has):
            weight = _weights(h, often, tally, n_texts)
            size[has] = np.diff(np.append(starts, len(h)))
            common[has] = np.minimum(np.add.reduceat(weight, starts) * 1000 // size[has], 0x7FFFFFFF)
            samples = sampler(h, weight, starts)
            keys = np.zeros((len(has), BANDS), np.uint64)
            for b in range(BANDS):
                key = np.full(len(has), b + 1, np.uint64)
                for k in range(b * ROWS, b * ROWS + ROWS):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) ^ mix(samples[:, k].copy()))
                keys[:, b] = key
            for i, row in zip(has, keys.view(np.int64).tolist()):
                bands[i] = row
        data, offs = c.flat(batch.column("text"))
        digests = b"".join(xxhash.xxh3_128_digest(data[a:b]) for a, b in zip(offs[:-1], offs[1:]))
        digest = np.frombuffer(digests, "<i8").reshape(n, 2)
        columns = [pa.array(c.longs(batch.column("row"))), pa.array(batch.column("doc_id").to_pylist(), pa.int64()), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(size), pa.array(common), pa.array(bands, pa.list_(pa.int64()))]
        got.append(pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "k1", "k2", "size", "common", "bands"]))
    names = [("row", pa.int64()), ("doc_id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("size", pa.int32()), ("common", pa.int32()), ("bands", pa.list_(pa.int64()))]
    return pa.Table.from_batches(got, pa.schema(names))


def _featured(texts: pa.Table, told: pa.Table, words: int, n_texts: int, threshold: float) -> pa.Table:
    """Features of the texts that are asked for: their shingles, as 32-bit hashes in order, and weights; the sum of these;
    the rarest shingles, up to the first that make more than 1 - threshold of the weight, and the weight before each."""
    wanted = told.filter(told.column("row").is_valid()).sort_by("row").combine_chunks()
    rows = c.longs(wanted.column("row").combine_chunks()) if wanted.num_rows else np.zeros(0, np.int64)
    kept = texts.filter(pa.array(np.isin(c.longs(texts.column("row").combine_chunks()), rows))) if texts.num_rows else texts
    tally, got = Tally(told.filter(told.column("hashes").is_valid())), []
    token = pa.list_(pa.struct([("token", pa.int32()), ("before", pa.int64())]))
    names = pa.schema([("row", pa.int64()), ("leader", pa.int64()), ("salt", pa.int32()), ("salts", pa.int32()), ("features", pa.binary()), ("total", pa.int64()), ("prefix", token)])
    for batch in c.slices(kept, "text", c.FINE_BYTES):
        h, often, text = _distinct(batch, words)
        df = tally(h)
        weight = np.minimum(often * idf_quarters(df, n_texts), 0xFFFFFF)
        bounds = np.searchsorted(text, np.arange(batch.num_rows + 1))
        short = (h >> np.uint64(32)).astype("<u4")  # texts' hashes ascend, and so do their upper halves
        out = [c.planes(short[a:b], 4) + c.planes(weight[a:b].astype("<u4"), 3) for a, b in zip(bounds[:-1], bounds[1:])]
        rare = np.lexsort((h, df, text))
        prefix, totals = [], []
        for a, b in zip(bounds[:-1], bounds[1:]):
            sums = np.cumsum(weight[rare[a:b]])
            n = int(np.searchsorted(sums, (1 - threshold) * sums[-1] * (1 + 1e-9), "right")) + 1 if b > a else 0
            before = np.concatenate([[0], sums])[:n]
            prefix.append([{"token": x, "before": y} for x, y in zip(short[rare[a:b][:n]].view(np.int32).tolist(), before.tolist())])
            totals.append(int(sums[-1]) if b > a else 0)
        mine = c.longs(batch.column("row").combine_chunks() if isinstance(batch.column("row"), pa.ChunkedArray) else batch.column("row"))
        facts = wanted.take(pa.array(np.searchsorted(rows, mine))).combine_chunks()
        columns = [pa.array(mine), *(facts.column(k).combine_chunks() for k in ("leader", "salt", "salts")), pa.array(out, pa.binary()), pa.array(totals, pa.int64()), pa.array(prefix, token)]
        got.append(pa.Table.from_arrays(columns, schema=names))
    return pa.concat_tables(got) if got else names.empty_table()


def unpack(features: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(features, np.uint8).reshape(7, -1)
    both = np.zeros((2, raw.shape[1], 4), np.uint8)
    both[0], both[1, :, :3] = raw[:4].T, raw[4:].T
    return both[0].view("<u4").ravel(), both[1].view("<u4").ravel()


def similarities(one: bytes, others: list[bytes]) -> np.ndarray:
    """Weighted Jaccard similarity of one text's features to those of others."""
    h, w = unpack(one)
    parts = [unpack(x) for x in others]
    sizes = np.array([len(x) for x, _ in parts])
    hashes, weights = np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts]).astype(np.int64)
    at = np.minimum(np.searchsorted(h, hashes), max(len(h) - 1, 0))
    both = np.where(h[at] == hashes, np.minimum(w[at], weights), 0) if len(h) else np.zeros(len(hashes), np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    least, total = (np.diff(np.concatenate([[0], np.cumsum(x)])[ends]) for x in (both, weights))
    rest = total + int(w.sum(dtype=np.int64)) - least
    return np.divide(least, rest, out=np.zeros(len(others)), where=rest > 0)


def _linked(members: DataFrame, leaders: DataFrame, threshold: float, bundles: int) -> DataFrame:
    """Edges (a, b) of the members (leader, salt, row, features) that are alike enough to their leader (leader, salt, features).

    Leaders' shares of members go to tasks in bundles; a task holds one bundle, about _BUNDLE shingles of members.
    """

    def compare(mine: pa.Table, heads: pa.Table) -> pa.Table:
        lead, salt = c.longs(heads.column("head_leader").combine_chunks()), c.longs(heads.column("head_salt").combine_chunks())
        place = {k: i for i, k in enumerate(zip(lead.tolist(), salt.tolist()))}
        a, b = [], []
        if mine.num_rows:
            leader, salt, row = (c.longs(mine.column(k).combine_chunks()) for k in ("leader", "salt", "row"))
            order = np.lexsort((salt, leader))
            new = np.flatnonzero(np.append(True, (np.diff(leader[order]) != 0) | (np.diff(salt[order]) != 0)))
            for at in np.split(order, new[1:]):
                head = heads.column("head_features")[place[int(leader[at[0]]), int(salt[at[0]])]].as_py()
                for some in np.array_split(at, -(-len(at) // 256)):
                    alike = similarities(head, [mine.column("features")[int(i)].as_py() for i in some]) >= threshold
                    a += [int(leader[at[0]])] * int(alike.sum())
                    b += row[some[alike]].tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    bundle = F.pmod(F.xxhash64("leader", "salt"), F.lit(bundles)).cast("int").alias("bundle")
    left = members.select(bundle, "leader", "salt", "row", "features").groupBy("bundle")
    right = leaders.select(bundle, *(F.col(k).alias(f"head_{k}") for k in ("leader", "salt", "features"))).groupBy("bundle")
    return left.cogroup(right).applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, class_id, class_size): one row for each input row.

    class_id is the least row of the class: of all rows that links and equal texts join. row is doc_id, where that is
    unique and never null (else see common.keyed). A text of fewer words than a shingle is one shingle; one without
    words, or null, is in a class with equal texts only (null equals empty). A text of any length counts whole. An
    empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    parts = c.partitions(spark)
    texts = dealt_texts(c.keyed(docs, id_col, text_col), parts)
    n_texts = texts.count()
    scratch: list[str] = []

    def kept(df: DataFrame, name: str, large: bool = True) -> DataFrame:
        table, path = c.stored(df, name, large)
        scratch.append(path)
        return table

    def shingled(batch):
        h, _, text = _distinct(batch, words)
        return h, text

    answers = kept(tallied(texts, parts, shingled), "answers")
    sign = lambda t, told: _signed(t, told, words, n_texts)
    signed = kept(texts.select("part", "row", "doc_id", "text").groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(sign, SIGNATURE), "signatures")
    reps = kept(signed.groupBy("k1", "k2").agg(F.min("row").alias("rep"), F.count(F.lit(1)).alias("n")), "texts", large=False)
    n_reps = reps.count()
    each = signed.join(reps.select(F.col("rep").alias("row")), "row", "left_semi").select(F.col("row").alias("rep"), "size", "common", "bands")
    banded = kept(each.select("rep", "size", "common", F.explode("bands").alias("key")), "bands")
    buckets = banded.groupBy("key").agg(F.min(F.struct("common", "rep")).alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = kept(c.looked_up(banded, buckets, ["key"], "n", n_reps), "members")
    # the leader of most of a text's buckets; salts deal a leader's members into shares
    votes = members.groupBy("rep", "size", "lead").agg(F.count(F.lit(1)).alias("votes"))
    best = votes.groupBy("rep", "size").agg(F.max(F.struct("votes", F.struct(-F.col("lead.common"), -F.col("lead.rep")).alias("first"), F.col("lead.rep").alias("leader"))).alias("v"))
    chosen = kept(best.select("rep", "size", F.col("v.leader").alias("leader")), "leaders", large=False)
    led = chosen.where("rep <> leader")
    shares = led.groupBy("leader").agg(F.ceil(F.sum("size") / _SHARE).cast("int").alias("salts"), F.count(F.lit(1)).alias("n"))
    salted = c.looked_up(led, shares, ["leader"], "n", n_reps).select("rep", "leader", F.pmod(F.xxhash64("rep"), F.col("salts")).cast("int").alias("salt"))
    heads = shares.select(F.col("leader").alias("rep"), F.col("salts").alias("own"))
    asked = chosen.select("rep").join(salted, "rep", "left").join(heads, "rep", "left")
    asked = asked.select(c.part_of(F.col("rep"), parts).alias("part"), F.lit(None).cast("binary").alias("hashes"), F.lit(None).cast("binary").alias("counts"), F.col("rep").alias("row"), "leader", "salt", F.coalesce("own", F.lit(0)).alias("salts"))
    none = [F.lit(None).cast(t).alias(n) for n, t in (("row", "long"), ("leader", "long"), ("salt", "int"), ("salts", "int"))]
    told = asked.unionByName(answers.select("part", "hashes", "counts", *none))
    feature = lambda t, x: _featured(t, x, words, n_texts, threshold)
    features = kept(texts.select("part", "row", "text").groupBy("part").cogroup(told.groupBy("part")).applyInArrow(feature, FEATURES), "features")
    bundles = max(parts, 1 + int((chosen.agg(F.sum("size")).first()[0] or 0) // _BUNDLE))
    leaders = features.where("salts > 0").select(F.col("row").alias("leader"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "features")
    edges = kept(_linked(features.where("leader is not null"), leaders, threshold, bundles), "links")
    labels = components(edges)
    more = kept(_bridges(members, labels, features, threshold, bundles, kept), "links")
    if more.limit(1).count():
        labels = components(edges.unionByName(more))
    classes = reps.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("k1", "k2", "n", F.coalesce("label", "rep").alias("class_id"))
    sizes = classes.groupBy("class_id").agg(F.sum("n").alias("class_size"), F.count(F.lit(1)).alias("texts"))
    classes = kept(c.looked_up(classes, sizes, ["class_id"], "texts", n_reps), "classes", large=False)
    found, _ = c.stored(c.looked_up(signed.select("row", "doc_id", "k1", "k2"), classes, ["k1", "k2"], "n", n_texts).select("row", "doc_id", "class_id", "class_size"), "found")
    for path in scratch:
        c.delete(spark, path)
    return found


def _bridges(members: DataFrame, labels: DataFrame, features: DataFrame, threshold: float, bundles: int, kept) -> DataFrame:
    """Links (a, b) between texts of different components that share a bucket; see above."""
    placed = members.select("rep", "key").join(labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    spans = lambda by: (F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n"))
    open_keys = placed.groupBy("key").agg(*spans("key")).where("low < high").select("key")
    placed = kept(placed.join(open_keys, "key", "left_semi").select("rep", "label").distinct(), "open", large=False)
    rare = features.select(F.col("row").alias("rep"), "total", F.explode("prefix").alias("p")).join(placed, "rep").select("rep", "label", "total", "p.token", "p.before")
    rare = kept(rare, "tokens")
    counted = rare.groupBy("token", "label").agg(F.count(F.lit(1)).alias("n"))
    # a token's most common component meets the others, and these each other: never one component itself
    tokens = counted.groupBy("token").agg(F.max_by("label", "n").alias("main"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("labels")).where("labels > 1").select("token", "main", "n")
    rare = kept(c.looked_up(rare, tokens, ["token"], "n", placed.count()), "bridges")
    share = threshold / (1 + threshold)  # of both texts' weight, that two linked ones have in common at least
    x, y = (rare.select("token", "main", *(F.col(k).alias(f"{k}_{n}") for k in ("rep", "label", "total", "before"))) for n in "xy")
    y = y.where("label_y <> main").drop("main")
    once = (F.col("label_x") == F.col("main")) | (F.col("rep_x") < F.col("rep_y"))
    room = lambda n: F.col(f"before_{n}") <= (1 - 2 * share) * F.col(f"total_{n}") * (1 + 1e-9)  # noqa: E731  the lighter text must leave more
    lighter = F.when(F.struct("total_x", "rep_x") < F.struct("total_y", "rep_y"), room("x")).otherwise(room("y"))
    enough = F.least(F.col("total_x") - F.col("before_x"), F.col("total_y") - F.col("before_y")) >= share * (F.col("total_x") + F.col("total_y")) * (1 - 1e-9)
    pairs = x.join(y, "token").where((F.col("label_x") != F.col("label_y")) & once & lighter & enough).select(F.least("rep_x", "rep_y").alias("leader"), F.greatest("rep_x", "rep_y").alias("row")).distinct()
    pairs = kept(pairs, "pairs")
    shares = pairs.groupBy("leader").agg(F.count(F.lit(1)).alias("n")).withColumn("salts", F.ceil(F.col("n") / 1000).cast("int"))
    salted = c.looked_up(pairs, shares, ["leader"], "n", pairs.count()).select("leader", "row", F.pmod(F.xxhash64("row"), F.col("salts")).cast("int").alias("salt"))
    own = features.select("row", "features")
    heads = own.join(shares.select(F.col("leader").alias("row"), "salts"), "row").select(F.col("row").alias("leader"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "features")
    return _linked(own.join(salted, "row"), heads, threshold, bundles)
