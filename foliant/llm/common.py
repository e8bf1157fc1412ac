"""Helpers shared by the operators: scratch tables, row keys, ordered sums, text batches."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task handles at once; one longer text stands alone.
SLICE_BYTES = 1 << 21
#: The same where a byte of text needs a hundred or more.
FINE_BYTES = 1 << 19


def shared_folder(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: spark.checkpoint.dir, or a temporary one where that is unset and all run on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (root or f"file://{tempfile.gettempdir()}/foliant").rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/foliant-{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that are no longer referenced; they'd otherwise wait for a collection."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.1)  # the cleaner works in a thread of its own


def stored(df: DataFrame, name: str, large: bool = True) -> tuple[DataFrame, str]:
    """df written to the shared folder and read back: lineage ends there, and lost executors lose nothing.

    large: whether its plan left shuffle files that are worth waiting for.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    if large:
        release(spark)
    return spark.read.schema(df.schema).parquet(path), path


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def part_of(row, n: int):
    """Partition number of a row key, as a Column; part_of_array is the same for numpy."""
    mixed = row.bitwiseXOR(F.shiftright(row, 9)).bitwiseXOR(F.shiftright(row, 21))
    return F.pmod(mixed, F.lit(n)).cast("int")


def part_of_array(row: np.ndarray, n: int) -> np.ndarray:
    return np.mod(row ^ (row >> 9) ^ (row >> 21), n).astype(np.int32)


def ordered_sums(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """df with ``out``: the sum of ``value`` over all rows before, in ascending ``order``.

    Rows are dealt by range, summed in each range, and the ranges' totals (one row each) are added up. df should
    have small columns only. Rows equal in all of ``order`` come in any order.
    """
    spark = df.sparkSession
    dealt = df.repartitionByRange(partitions(spark), *order).withColumn("_range", F.spark_partition_id())
    kept, _ = stored(dealt, "ranges")
    totals = kept.groupBy("_range").agg(F.sum(value).alias("_total")).collect()  # a row for each partition
    before, run = {}, 0
    for r in sorted(totals, key=lambda r: r["_range"]):
        before[r["_range"]] = run
        run += r["_total"]
    base = spark.createDataFrame(list(before.items()), "_range int, _base long")
    cols = ", ".join(order)
    local = F.expr(f"coalesce(sum({value}) over (partition by _range order by {cols} rows between unbounded preceding and 1 preceding), 0)")
    return kept.withColumn("_local", local).join(F.broadcast(base), "_range").withColumn(out, F.col("_local") + F.col("_base")).drop("_local", "_base", "_range")


def numbered(df: DataFrame, id_col: str) -> DataFrame:
    """df with ``row``: a long unique to each row, ascending in the id. Columns must be ones that Spark can group by.

    Where the id is unique and never null, row is the id. Otherwise rows are numbered in the order of the id (null
    last) and a digest of all columns; equal rows get numbers one after another.
    """
    key = F.col(id_col).cast("long")
    if not df.groupBy(key.alias("_id")).count().where("count > 1 or _id is null").limit(1).count():
        return df.select(key.alias("row"), *df.columns)
    same = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))
    order = {"_null": key.isNull(), "_id": F.coalesce(key, F.lit(0)), "_digest": F.sha2(F.to_json(F.struct(*df.columns)).cast("binary"), 256)}
    same = same.withColumns(order)
    ranks = ordered_sums(same.select(*order, "_copies"), list(order), "_copies", "_first").drop("_copies")
    spread = same.join(ranks, list(order)).withColumn("_n", F.explode(F.sequence(F.lit(0), (F.col("_copies") - 1).cast("int"))))
    return spread.select((F.col("_first") + F.col("_n")).cast("long").alias("row"), *df.columns)


#: Keys with more than a HOT-th of all rows (so fewer than HOT keys) are joined by broadcast.
HOT = 1000


def looked_up(df: DataFrame, facts: DataFrame, keys: list[str], rows: str, total: int) -> DataFrame:
    """df joined with facts: a row for each key (null is one), and in ``rows`` how many of df's ``total`` rows have it.

    What belongs to hot keys is broadcast, fewer than HOT rows at any size; other keys meet by shuffle, where none has
    more than a HOT-th of the rows. Columns of facts other than keys and ``rows`` are added.
    """
    other = facts.select(*(F.col(k).alias(f"_{k}") for k in keys), *(x for x in facts.columns if x not in keys and x != rows), F.col(rows).alias("_rows"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    gone = [f"_{k}" for k in keys] + ["_rows"]
    hot = F.col("_rows") * HOT > total
    heavy = F.broadcast(other.where(hot))
    return df.join(heavy, same).drop(*gone).unionByName(df.join(heavy, same, "left_anti").join(other.where(~hot), same).drop(*gone))


def keyed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(row, doc_id, text) and the carried columns: row as by numbered(); a null text becomes empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return numbered(df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), *carry), "doc_id")


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary column's bytes and the offsets of its rows (one more than rows)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def give_back() -> None:
    """Free memory goes back to the machine: a worker stays, and would keep what its largest batch took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        pass


def slices(batch, text: str, limit: int = SLICE_BYTES):
    """Runs of the batch's rows with about ``limit`` bytes of text each, never parts of a text."""
    column = batch.column(text) if hasattr(batch, "column") else batch[text]
    _, offs = flat(column)
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end
    give_back()


def longs(column) -> np.ndarray:
    return np.asarray(column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy(), np.int64)


def planes(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each value, byte by byte: all lowest bytes first. Codecs like that better."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1)[:, :width].T).tobytes()


def joined(column, dtype, width: int) -> np.ndarray:
    """The values packed by planes() in all rows of a binary column, one after another."""
    data, offs = flat(column)
    out = np.zeros((len(data) // width, np.dtype(dtype).itemsize), np.uint8)
    for a, b in zip(offs[:-1], offs[1:]):
        out[a // width : b // width, :width] = data[a:b].reshape(width, -1).T
    return out.view(dtype).ravel()


def dealt(groups: np.ndarray, n: int, *arrays: np.ndarray):
    """For each group below n that occurs: (group, each array's values in it), values in their order."""
    order = np.argsort(groups.astype(np.uint16) if n < 1 << 16 else groups, kind="stable")
    moved = [a[order] for a in arrays]
    ends = np.cumsum(np.bincount(groups, minlength=n))
    start = 0
    for g in np.flatnonzero(np.diff(ends, prepend=0)):
        yield int(g), [a[start : ends[g]] for a in moved]
        start = ends[g]
