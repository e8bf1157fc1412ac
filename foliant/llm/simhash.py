"""SimHash fingerprints of 128 bits, and all fingerprints within a Hamming radius by permuted block tables."""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm import common as c
from foliant.llm.words import find_words, hash_words, mix, shingles

BITS = 128
#: The value of each of a byte's eight bits, as a vote.
_VOTES = (np.arange(256)[:, None] >> np.arange(7, -1, -1) & 1) * 2 - 1
EDITED = "kind int, part int, row long, doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, next_fingerprint binary, text string"


def fingerprints(texts: pa.Array, words: int = 5) -> np.ndarray:
    """A row of 16 bytes for each text: the sign, bit by bit, of its shingles' votes, each as often as it occurs.

    A text of fewer words has one shingle, all its words; one without words has no votes, and no bit set. A tie of
    votes leaves the bit unset.
    """
    data, offs = c.flat(texts)
    starts, ends, ranges = find_words(data, offs)
    hashes, bounds = shingles(hash_words(data, starts, ends), ranges, words)
    n = len(bounds) - 1
    text = np.repeat(np.arange(n, dtype=np.int64) * 256, np.diff(bounds))
    both = np.stack([hashes, mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5))], axis=1).view(np.uint8)
    out = np.zeros((n, BITS // 8), np.uint8)
    for i in range(BITS // 8):
        counts = np.bincount(text + both[:, i], minlength=n * 256).reshape(n, 256)
        out[:, i] = np.packbits(counts @ _VOTES > 0, axis=1)[:, 0]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bits, 0 to 1, of fingerprints in rows."""
    return 1 - np.unpackbits(a ^ b, axis=1).sum(axis=1) / BITS


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint): 32 lower-case hex digits for each row; null text as empty; other columns ignored."""

    def run(batches):
        for whole in batches:
            for batch in c.slices(whole, "text"):
                prints = [x.tobytes().hex() for x in fingerprints(batch.column("text"))]
                yield pa.RecordBatch.from_arrays([pa.array(batch.column("doc_id").to_pylist(), pa.int64()), pa.array(prints, pa.string())], ["doc_id", "fingerprint"])

    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"coalesce(cast(`{text_col}` as string), '') text").mapInArrow(run, "doc_id long, fingerprint string")


def near_fingerprints(prints: DataFrame, radius: int = 3, blocks: int | None = None) -> DataFrame:
    """All pairs (a, b, distance), a < b, of distinct fingerprints (hex) within the Hamming radius.

    The bits are cut into ``blocks`` (radius + 1 by default). Two fingerprints within the radius agree in at least
    blocks - radius of them, so there is one table for each choice of so many blocks, keyed by the chosen blocks'
    bits: candidates meet in a table by equality, and the distance decides. Nulls are left out.
    """
    blocks = blocks or radius + 1
    if not radius < blocks <= BITS // 4:
        raise ValueError("blocks must be over radius, and have 4 bits at least")
    known = prints.select("fingerprint").where("fingerprint is not null").distinct()
    words = [F.conv(F.substring("fingerprint", 1 + 8 * i, 8), 16, 10).cast("long") for i in range(BITS // 32)]
    edges = [BITS * i // blocks // 4 for i in range(blocks + 1)]  # in hex digits
    cut = [F.substring("fingerprint", 1 + a, b - a) for a, b in zip(edges, edges[1:])]
    tables = [F.concat_ws("-", F.lit(str(t)), *(cut[i] for i in chosen)) for t, chosen in enumerate(combinations(range(blocks), blocks - radius))]
    keyed = known.select("fingerprint", F.array(*words).alias("w"), F.explode(F.array(*tables)).alias("key"))
    a, b = (keyed.select("key", F.col("fingerprint").alias(n), F.col("w").alias(f"w{n}")) for n in "ab")
    distance = sum((F.bit_count(F.col("wa")[i].bitwiseXOR(F.col("wb")[i])) for i in range(1, BITS // 32)), F.bit_count(F.col("wa")[0].bitwiseXOR(F.col("wb")[0])))
    near = a.join(b, (a.key == b.key) & (F.col("a") < F.col("b")) & (distance <= radius))
    return near.select("a", "b", distance.cast("int").alias("distance")).distinct()


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's fingerprint, its edited text's, and the next document's, with their likeness.

    Edited: the last half of the code points (rounded down) replaced by the first as many of the next document in
    ascending id order, or by all of it; after the last comes the first, and a single document follows itself. Ids
    that are null or repeat: see common.keyed. Texts are dealt out by range of id once; each range's last document
    meets the next range's first in a small join.
    """
    spark = docs.sparkSession
    dealt = c.keyed(docs, id_col, text_col).repartitionByRange(c.partitions(spark), "row").sortWithinPartitions("row").withColumn("part", F.spark_partition_id())
    names = ["kind", "part", "row", "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint", "text"]
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.string())

    def pairs(part, rows, ids, texts, prints, following, following_prints):
        made = []
        for t, f in zip(texts, following):
            half = len(t) // 2
            made.append(t[: len(t) - half] + f[:half])
        new = fingerprints(pa.array(made, pa.string()))
        for i, t in enumerate(texts):
            yield 0, part, rows[i], ids[i], len(t), hashlib.sha256(made[i].encode()).hexdigest(), prints[i].tobytes(), new[i].tobytes(), following_prints[i].tobytes(), None

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip(zip(*rows), kinds)], names)

    def run(batches):
        last = part = None
        for whole in batches:
            for batch in c.slices(whole, "text"):
                texts, rows, ids = (batch.column(x).to_pylist() for x in ("text", "row", "doc_id"))
                prints = fingerprints(batch.column("text"))
                out = []
                if last is None:
                    part = batch.column("part")[0].as_py()
                    out.append((1, part, rows[0], None, None, None, None, None, prints[0].tobytes(), texts[0]))
                else:
                    rows, ids, texts, prints = [last[0], *rows], [last[1], *ids], [last[2], *texts], np.concatenate([last[3][None], prints])
                out.extend(pairs(part, rows[:-1], ids, texts[:-1], prints, texts[1:], prints[1:]))
                last = rows[-1], ids[-1], texts[-1], prints[-1]
                if out:
                    yield batch_of(out)
        if last is not None:
            yield batch_of([(2, part, last[0], last[1], None, None, last[3].tobytes(), None, None, last[2])])

    done, _ = c.stored(dealt.mapInArrow(run, EDITED), "edited")
    parts = [r.part for r in done.where("kind = 1").select("part").orderBy("part").collect()]  # one for each range
    follows = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])) or [(0, 0)], "part int, follows int")
    heads = done.where("kind = 1").select(F.col("part").alias("follows"), F.col("text").alias("next_text"), F.col("next_fingerprint").alias("next_print"))
    lasts = done.where("kind = 2").select("part", "row", "doc_id", "text", "fingerprint").join(F.broadcast(follows), "part").join(heads, "follows")

    def close(batches):
        for batch in batches:
            rows, ids, texts, following = (batch.column(x).to_pylist() for x in ("row", "doc_id", "text", "next_text"))
            prints, after = (np.frombuffer(b"".join(batch.column(x).to_pylist()), np.uint8).reshape(-1, BITS // 8) for x in ("fingerprint", "next_print"))
            if rows:
                yield batch_of(list(pairs(0, rows, ids, texts, prints, following, after)))

    whole = done.where("kind = 0").unionByName(lasts.mapInArrow(close, EDITED))
    word = lambda name, i: F.conv(F.substring(F.hex(name), 1 + 8 * i, 8), 16, 10).cast("long")

    def alike(a, b):
        off = [F.bit_count(word(a, i).bitwiseXOR(word(b, i))) for i in range(BITS // 32)]
        return 1 - sum(off[1:], off[0]) / F.lit(float(BITS))

    return whole.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.lower(F.hex("fingerprint")).alias("fingerprint"),
        F.lower(F.hex("edited_fingerprint")).alias("edited_fingerprint"),
        alike("fingerprint", "edited_fingerprint").alias("near_edited"),
        alike("fingerprint", "next_fingerprint").alias("near_next"),
    )
