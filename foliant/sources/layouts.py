"""A first look at unknown binary files: entropy, record length, header, what stands at each offset, printable runs.

Small numpy helpers count within a piece of one file (a block, a range of shifts, a range of offsets); Spark deals the
pieces, and what follows from the counts (medians, ranks, the choice among findings) is said in columns.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.sources import records as R

#: Fixed values of a look: the sample of a file that shifts are tried on, the longest shift, by how much the best shift
#: must beat the usual, the share of that within which the shortest wins, how many candidates are told.
SAMPLE, LONGEST, LEAD, NEAR, CANDIDATES = 1 << 16, 4096, 0.1, 0.9, 5
#: Fixed values of the search for fields: records looked at, the longest record whose offsets are tried, findings told.
RECORDS, OFFSETS, FINDINGS = 50_000, 1024, 40
#: Shifts, and offsets in a record, that one piece of work tries.
SHIFT_STEP, OFFSET_STEP = 256, 16
#: The types tried at each offset.
KINDS = (("u16", 2, "u2"), ("u32", 4, "u4"), ("f32", 4, "f4"), ("u64", 8, "u8"), ("f64", 8, "f8"))


def _bytes_of(path: str, start: int, length: int) -> np.ndarray:
    fs, base = R.opened(path)
    with fs.open_input_file(base) as stream:
        return np.frombuffer(stream.read_at(length, start), np.uint8)


def _each(df: DataFrame, columns: list[str], helper, schema: str) -> DataFrame:
    """Rows (tuples) that helper(*columns) gives for each row of df."""
    fields = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in columns)):
                out = [dict(zip(fields, x)) for x in helper(*row)]
                if out:
                    yield pa.RecordBatch.from_pylist(out, kinds)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kinds = to_arrow_schema(_parse_datatype_string(schema))
    return df.select(*columns).mapInArrow(run, schema)


def _tasks(df: DataFrame) -> int:
    """Tasks for few rows of much work each: a number that is given stays, else Spark joins small partitions into one."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, size): a row for each file."""
    return R.blocks(spark, path).where("offset = 0").select("path", "size")


# ---- entropy ----


def entropies(blocks: DataFrame) -> DataFrame:
    """(path, size, blocks, entropy, block_min, block_max): bits a byte of whole files and of their blocks."""
    counted = _each(blocks, ["path", "size", "offset", "content"], lambda p, s, o, b: [(p, s, o, np.bincount(np.frombuffer(b, np.uint8), minlength=256).tolist())], "path string, size long, offset long, counts array<long>")

    def bits(counts: Column) -> Column:
        n = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
        return -F.aggregate(counts, F.lit(0.0), lambda a, x: a + F.when(x > 0, x / n * F.log2(x / n)).otherwise(0.0))

    of_blocks = counted.groupBy("path", "size").agg(F.count(F.lit(1)).alias("blocks"), F.round(F.min(bits(F.col("counts"))), 2).alias("block_min"), F.round(F.max(bits(F.col("counts"))), 2).alias("block_max"))
    of_bytes = counted.select("path", F.posexplode("counts").alias("byte", "n")).groupBy("path", "byte").agg(F.sum("n").alias("n"))
    whole = of_bytes.groupBy("path").agg(F.round(bits(F.collect_list("n")), 2).alias("entropy"))
    return of_blocks.join(whole, "path").select("path", "size", "blocks", (F.col("entropy") + 0.0).alias("entropy"), (F.col("block_min") + 0.0).alias("block_min"), (F.col("block_max") + 0.0).alias("block_max"))


# ---- record length ----


def _rates(path: str, size: int, first: int):
    """How often a byte equals the one so many bytes on, for shifts from ``first``, in the file's sample."""
    start = size // 4 if size > 4 * SAMPLE else 0
    a = _bytes_of(path, start, SAMPLE)
    for shift in range(first, min(first + SHIFT_STEP, min(LONGEST, len(a) // 4) + 1)):
        yield path, shift, np.count_nonzero(a[:-shift] == a[shift:]) / (len(a) - shift)


def record_lengths(found: DataFrame) -> DataFrame:
    """(path, record_size, match_rate, baseline, confidence, candidates) of files (path, size).

    The rate at which bytes repeat is worked out for each shift of a sample, a quarter into large files. Where the best
    is LEAD over the median, the shortest shift near the best is the record's length; else it is null. Candidates are
    the five best shifts of two bytes or more.
    """
    shifts = found.where("size >= 64").withColumn("first", F.explode(F.sequence(F.lit(1), F.lit(LONGEST), F.lit(SHIFT_STEP)))).repartition(_tasks(found), "path", "first")
    rates = _each(shifts, ["path", "size", "first"], _rates, "path string, shift int, rate double")
    judged = rates.groupBy("path").agg(F.median("rate").alias("base"), F.max("rate").alias("best"), F.max_by("shift", F.struct("rate", -F.col("shift"))).alias("best_shift"))
    bar = F.col("base") + NEAR * (F.col("best") - F.col("base"))
    place = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("rate"), "shift"))
    ranked = rates.where("shift >= 2").withColumn("place", place).join(judged, "path")
    made = ranked.groupBy("path", "base", "best", "best_shift").agg(
        F.min(F.when(F.col("rate") >= bar, F.col("shift"))).alias("near"), F.collect_list(F.struct("shift", "rate")).alias("all"),
        F.array_sort(F.collect_list(F.when(F.col("place") <= CANDIDATES, F.struct("place", F.col("shift").alias("size"), F.round("rate", 3).alias("match_rate"))))).alias("c"),
    )
    size = F.when(F.col("best") - F.col("base") >= LEAD, F.coalesce("near", "best_shift"))
    made = made.withColumn("record_size", size).withColumn("hit", F.get(F.filter("all", lambda x: x["shift"] == F.col("record_size")), F.lit(0))["rate"])
    sure = F.col("record_size").isNotNull()
    told = made.select(
        "path", "record_size", F.round("hit", 3).alias("match_rate"), F.round("base", 3).alias("baseline"),
        F.when(sure, F.round((F.col("hit") - F.col("base")) / F.greatest(1 - F.col("base"), F.lit(1e-9)), 2)).otherwise(0.0).alias("confidence"),
        F.when(sure, F.transform("c", lambda x: F.struct(x["size"].alias("size"), x["match_rate"].alias("match_rate")))).otherwise(F.array().cast("array<struct<size:int,match_rate:double>>")).alias("candidates"),
    )
    return found.select("path", "size").join(told, "path", "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))


# ---- header ----


def _repeats_from(a: np.ndarray, record: int) -> int:
    """Where the share of bytes that repeat one record on, over a few records, first is halfway between usual and best."""
    n = min(len(a) - record, 1 << 18)
    wide = max(4 * record, 64)
    if n <= wide:
        return 0
    total = np.concatenate([[0], np.cumsum(a[:n] == a[record : record + n])])
    share = (total[wide:] - total[:-wide]) / wide
    return int(np.argmax(share >= (share.max() + np.median(share)) / 2))


def _not_slow(a: np.ndarray, starts: np.ndarray, record: int, row: np.ndarray, fixed: np.ndarray) -> np.ndarray:
    """The constant bytes (offsets) without those of slow values: before it became constant, such a byte held another
    value in four records, each unlike the next elsewhere, as a time's high byte does. If all are slow, all stay."""
    first = a[starts[:, None] + np.arange(record)]
    off = first[:, fixed] != row[fixed]
    kept = []
    for i, j in enumerate(fixed.tolist()):
        last = np.flatnonzero(off[:, i])[-1:].sum()
        before = first[last - 3 : last + 1]
        slow = last >= 3 and (before[:, j] == before[0, j]).all() and (before[1:] != before[:-1]).any(axis=1).all()
        if not slow:
            kept.append(j)
    return np.array(kept) if kept else fixed


def _header(path: str, size: int, record: int):
    """Records end with the file. The first is where the bytes that are constant in later records hold nearly best."""
    first, a = size % record, _bytes_of(path, 0, min(size, (1 << 18) + 4 * record + record))
    turn = _repeats_from(a, record)
    low, high = (size // 10 - first) // record + 1, (size - first) // record - 1
    some = np.unique(np.linspace(low, high, min(2000, max(0, high - low + 1))).astype(np.int64))
    if len(some) >= 8:
        fs, base = R.opened(path)
        with fs.open_input_file(base) as stream:
            rows = np.stack([np.frombuffer(stream.read_at(record, first + k * record), np.uint8) for k in some.tolist()])
        fixed = np.flatnonzero((rows == rows[0]).all(axis=0))
        starts = np.arange(first, min(size - 4 * record, 1 << 16) + 1, record)
        if len(fixed) and len(starts):
            fixed = _not_slow(a, starts, record, rows[0], fixed)
            at = starts[:, None, None] + np.arange(4)[:, None] * record + fixed
            held = (a[at] == rows[0, fixed]).mean(axis=(1, 2))
            if held.max() >= 0.8:
                return [(path, int(starts[np.argmax(held >= held.max() - 0.03)]), turn, "constant bytes")]
    return [(path, first + record * max(0, round((turn - first) / record)), turn, "repeat start")]


def header_sizes(found: DataFrame) -> DataFrame:
    """(path, header_size, periodic_from, method) of files (path, size, record_size) with a record size."""
    sized = found.where("record_size is not null").repartition(_tasks(found), "path")
    return _each(sized, ["path", "size", "record_size"], _header, "path string, header_size long, periodic_from long, method string")


# ---- fields ----


def _offsets(path: str, size: int, header: int, record: int, first: int):
    """What a range of offsets holds in all records: constant bytes, and numbers of each type."""
    n = min((size - header) // record, RECORDS)
    rows = _bytes_of(path, header, n * record).reshape(n, record)
    for j in range(first, min(first + OFFSET_STEP, record)):
        if (rows[:, j] == rows[0, j]).all():
            yield path, j, "byte", 1, False, int(n), None, None, None, None, None, None, int(rows[0, j]), None
        for kind, width, code in KINDS if record <= OFFSETS else ():
            part = rows[:, j : j + width]
            if part.shape[1] < width or (part == part[0]).all():
                continue
            part = np.ascontiguousarray(part)
            for big in (False, True):
                v = part.view((">" if big else "<") + code).ravel()
                v = v.astype(v.dtype.newbyteorder("="))
                if code[0] == "f":
                    with np.errstate(all="ignore"):
                        if np.isfinite(v).all():
                            x = v.astype(float)
                            yield path, j, kind, width, big, int(n), float(x.min()), float(x.max()), float(x.mean()), None, None, bool(np.allclose(v, np.round(v))), None, None
                else:
                    rising = float((v[1:] >= v[:-1]).mean())
                    if rising >= 0.99:
                        step = np.median(np.diff(v.astype(np.int64)))
                        yield path, j, kind, width, big, int(n), float(v.min()), float(v.max()), None, rising, float(step), None, None, None


_FOUND = "path string, offset int, kind string, width int, big boolean, n long, low double, high double, mean double, rising double, step double, whole boolean, byte int, spare string"


def _judged(found: DataFrame) -> DataFrame:
    """Findings with ``what`` they are: times, counters, plausible floats; the rest goes."""
    low, high, most = F.col("low"), F.col("high"), F.greatest(F.abs("low"), F.abs("high"))
    a, b = R.EPOCH
    time = F.when((F.col("kind") == "u32") & (low >= a) & (high <= b), "unix seconds").when((F.col("kind") == "u64") & (low >= a * 1000) & (high <= b * 1000), "unix milliseconds")
    real = F.col("kind").startswith("f")
    odd = (most > 1e7) | ((most > 0) & (most < 1e-6)) | (low == high) | (F.col("whole") & (most > 1e4))
    what = F.when(real, F.when(~odd, "float")).when(high > low, F.when(time.isNotNull(), "timestamp").when((F.floor("step") > 0) & (F.floor("step") <= 1_000_000), "counter"))
    return found.where("kind <> 'byte'").withColumns({"what": what, "unit": F.when(~real, time)}).where("what is not null")


def _apart(found: DataFrame) -> DataFrame:
    """The findings that remain when, best first, each that overlaps a better one is dropped.

    Best: aligned, little-endian, times before counters before floats, narrow floats and wide integers, rising most.
    """
    rank = F.when(F.col("what") == "timestamp", 0).when(F.col("what") == "counter", 1).otherwise(2)
    keys = [F.col("offset") % F.col("width") != 0, F.col("big"), rank, F.when(F.col("what") == "float", F.col("width")).otherwise(-F.col("width")), -F.coalesce("rising", F.lit(0.0)), F.col("offset"), F.col("kind")]
    one = F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keys)), "offset", "width", F.col("kind").alias("type"), F.when(F.col("big"), "big").otherwise("little").alias("endian"), "what", "unit", "low", "high", "mean", "rising", "step")
    bare = "struct<offset:int,width:int,type:string,endian:string,what:string,unit:string,low:double,high:double,mean:double,rising:double,step:double>"
    few = F.transform(F.array_sort(F.collect_list(one)), lambda x: F.struct(*(x[f] for f in ("offset", "width", "type", "endian", "what", "unit", "low", "high", "mean", "rising", "step"))).cast(bare))
    free = lambda kept, x: ~F.exists(kept, lambda t: (x["offset"] < t["offset"] + t["width"]) & (t["offset"] < x["offset"] + x["width"]))
    chosen = F.aggregate("few", F.array().cast(f"array<{bare}>"), lambda kept, x: F.when(free(kept, x), F.array_append(kept, x)).otherwise(kept))
    # a record has fewer findings than offsets times types
    return found.groupBy("path").agg(few.alias("few")).select("path", F.slice(F.array_sort(chosen), 1, FINDINGS).alias("findings"))


def fields(found: DataFrame) -> DataFrame:
    """(path, records, constant, findings) of files (path, size, record_size, header_size).

    constant: runs of offsets with the same byte in every record. findings: numbers that look like times, counters or
    measurements, none overlapping another. Up to RECORDS records are looked at; of records longer than OFFSETS only
    the constant bytes are told, and fewer than four records tell nothing.
    """
    found = found.where("record_size is not null").withColumn("records", F.least(F.floor((F.col("size") - F.col("header_size")) / F.col("record_size")), F.lit(RECORDS)))
    pieces = found.where("records >= 4").withColumn("first", F.explode(F.sequence(F.lit(0), F.col("record_size") - 1, F.lit(OFFSET_STEP)))).repartition(_tasks(found), "path", "first")
    seen = _each(pieces, ["path", "size", "header_size", "record_size", "first"], _offsets, _FOUND).drop("spare")
    byte = seen.where("kind = 'byte'")
    island = F.col("offset") - F.row_number().over(Window.partitionBy("path").orderBy("offset"))
    runs = byte.withColumn("island", island).groupBy("path", "island").agg(F.min("offset").alias("start"), F.max("offset").alias("end"), F.array_sort(F.collect_list(F.struct("offset", F.lower(F.lpad(F.hex("byte"), 2, "0")).alias("h")))).alias("b"))
    told = runs.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start", "end", F.array_join(F.transform("b", lambda x: x["h"]), " ").alias("bytes")))).alias("constant"))
    whole = found.select("path", "records").join(told, "path", "left").join(_apart(_judged(seen)), "path", "left")
    none = lambda name, kind: F.coalesce(name, F.array().cast(f"array<struct<{kind}>>")).alias(name)
    return whole.select("path", "records", none("constant", "start:int,end:int,bytes:string"), none("findings", "offset:int,width:int,type:string,endian:string,what:string,unit:string,low:double,high:double,mean:double,rising:double,step:double"))


# ---- text ----

#: Printable characters that make a run, and their bytes in each encoding.
LEAST_RUN = 6
_WIDTH = {"ascii": 1, "utf-16-le": 2}
#: Runs that are long enough, or that touch an end of the block and may go on beyond it.
_RUNS = {
    "ascii": re.compile(rb"[ -~]{6,}|(?<![\s\S])[ -~]+|[ -~]+(?![\s\S])"),
    "utf-16-le": re.compile(rb"(?:[ -~]\x00){6,}|(?<![\s\S]{2})(?:[ -~]\x00)+|(?:[ -~]\x00)+(?![\s\S]{2})"),
}


def _strings(path: str, size: int, offset: int, content: bytes):
    """Printable runs of a block; a character of two bytes may end in the next."""
    n = len(content)
    after = bytes(_bytes_of(path, offset + n, 1)) if offset + n < size else b""
    for code, form in _RUNS.items():
        width = _WIDTH[code]
        for m in form.finditer(content + after * (width - 1)):
            if m.start() < n:
                yield path, code, offset + m.start(), offset + m.end(), m.group().decode(code), m.start() < width or m.end() > n - width


def printable_runs(blocks: DataFrame) -> DataFrame:
    """(path, offset, text, encoding): runs of six or more printable ASCII or UTF-16 characters.

    Blocks are searched apart; runs that touch a block's end are joined where one ends and the next begins.
    """
    runs = _each(blocks, ["path", "size", "offset", "content"], _strings, "path string, encoding string, a long, b long, text string, edge boolean")
    w = Window.partitionBy("path", "encoding").orderBy("a")
    edges = runs.where("edge").withColumn("new", F.when(F.lag("b").over(w) == F.col("a"), 0).otherwise(1))
    joined = edges.withColumn("island", F.sum("new").over(w)).groupBy("path", "encoding", "island").agg(F.min("a").alias("a"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", "text"))), lambda x: x["text"]), "").alias("text"))
    both = runs.where("not edge").select("path", "a", "text", "encoding").unionByName(joined.select("path", "a", "text", "encoding"))
    return both.where(F.length("text") >= LEAST_RUN).select("path", F.col("a").alias("offset"), "text", "encoding")


# ---- overview ----


def overview(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, entropy, block_min, block_max, record_size, header_size, records, text): what a first look tells of
    each file, and the same as plain text of up to 60 strings."""
    blocks = R.blocks(spark, path)
    lengths = record_lengths(files(spark, path)).persist()  # a row for each file
    heads = header_sizes(lengths)
    facts = entropies(blocks).join(lengths.drop("size"), "path").join(heads, "path", "left").persist()
    seen = fields(facts.select("path", "size", "record_size", "header_size")).withColumnRenamed("records", "analysed")
    place = F.row_number().over(Window.partitionBy("path").orderBy("offset", "encoding"))
    strings = printable_runs(blocks).withColumn("n", place).groupBy("path").agg(F.count(F.lit(1)).alias("strings"), F.array_sort(F.collect_list(F.when(F.col("n") <= 60, F.struct("n", F.format_string("  %08x %s", "offset", F.substring("text", 1, 100)).alias("line"))))).alias("shown"))
    whole = facts.join(seen, "path", "left").join(strings, "path", "left").withColumn("records", F.floor((F.col("size") - F.col("header_size")) / F.col("record_size")))
    number = lambda c: F.format_string("%s", F.col(c).cast("string"))
    constant = F.transform("constant", lambda x: F.concat(F.lit("  offset "), F.when(x["start"] == x["end"], x["start"].cast("string")).otherwise(F.concat(x["start"].cast("string"), F.lit("-"), x["end"].cast("string"))), F.lit(": constant "), F.substring(x["bytes"], 1, 60)))
    named = F.transform("findings", lambda x: F.concat(F.lit("  offset "), x["offset"].cast("string"), F.lit(": "), x["type"], F.lit(" "), x["endian"], F.lit(" "), x["what"], F.lit(" "), x["low"].cast("string"), F.lit(".."), x["high"].cast("string")))
    structure = F.when(F.col("record_size").isNull(), F.array(F.lit("no fixed record size"))).otherwise(F.concat(F.array(F.concat(F.lit("record size "), number("record_size"), F.lit(", header "), number("header_size"), F.lit(", records "), number("records"))), constant, named))
    head = F.array(F.concat(F.lit("size "), number("size"), F.lit(", entropy "), number("entropy")))
    lines = F.concat(head, structure, F.array(F.concat(F.lit("strings "), F.coalesce(number("strings"), F.lit("0")))), F.coalesce(F.transform("shown", lambda x: x["line"]), F.array().cast("array<string>")))
    return whole.select("path", "size", "entropy", "block_min", "block_max", "record_size", "header_size", "records", F.array_join(lines, "\n").alias("text"))
