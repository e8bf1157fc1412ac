"""Fixed-size binary records by a declared layout: a data source that reads and writes them, and a decoding report.

``spark.read.format("records")`` gives rows of three kinds by the option ``rows``: decoded records, a row for each
file's header, or blocks of bytes. Files are opened through Arrow's file systems by ranges of whole records, so a
file of any size is read by many tasks, on local disks, HDFS and object stores alike. Filters on ``index``, and on a
field that the files are sorted by, leave out ranges that can't match: the first by arithmetic, the second by binary
search in each file.
"""

from __future__ import annotations

import datetime
import hashlib
import json
import os
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

#: Numeric types with numpy's code and Spark's type; time units a second; keys that a spec may have; the years that times should fall into.
NUMERIC = {"u8": ("u1", "short"), "i8": ("i1", "short"), "u16": ("u2", "int"), "i16": ("i2", "int"), "u32": ("u4", "long"), "i32": ("i4", "int"), "u64": ("u8", "decimal(20,0)"), "i64": ("i8", "long"), "f32": ("f4", "float"), "f64": ("f8", "double")}
TIMES = {"unix_s": 1, "unix_ms": 1000}
SPEC_KEYS = {"endian", "header", "record_size", "count", "header_fields", "fields", "name", "description"}
FIELD_KEYS = {"name", "offset", "type", "size", "endian", "scale", "add", "unit", "time", "bits", "encoding", "description"}
EPOCH = (946684800, 4102444800)
_ARROW = {"short": pa.int16(), "int": pa.int32(), "long": pa.int64(), "float": pa.float32(), "double": pa.float64(), "decimal(20,0)": pa.decimal128(20, 0), "string": pa.string()}
#: Ranges that one task reads at most, and records in them where there are several; tasks that get one range each before any gets more.
RANGES_A_TASK, RECORDS_A_TASK, TASKS = 32, 1 << 16, 48
BYTES_READ = 4096
RECORDS_READ = 200


class SpecError(ValueError):
    """A spec that can't be used; the message says why."""


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    offset: int
    size: int
    big: bool = False
    scale: float | None = None
    add: float | None = None
    time: str | None = None
    bits: tuple[tuple[str, int], ...] = ()
    encoding: str = "ascii"

    @property
    def text(self) -> bool:
        return self.kind in ("str", "bytes")

    @property
    def dtype(self) -> str:
        return (">" if self.big else "<") + NUMERIC[self.kind][0]


@dataclass(frozen=True)
class Layout:
    record: int
    header: int
    fields: tuple[Field, ...]
    head: tuple[Field, ...] = ()
    declared: int | None = None

    def counts(self, size: int) -> dict:
        """How many whole records there is room for, how many count, and bytes left over."""
        room = max(0, size - self.header) // self.record if self.record else 0
        count = room if self.declared is None else min(room, self.declared)
        return {"available": room, "count": count, "trailing": size - self.header - count * self.record}


def _whole(x) -> bool:
    return isinstance(x, int) and not isinstance(x, bool)


def _field(x, where: str, endian: str, room: int | None) -> Field:
    def need(fine: bool, what: str) -> None:
        if not fine:
            raise SpecError(f"{where}: {what}")

    need(isinstance(x, dict), "a field is a mapping")
    need(not (odd := sorted(set(x) - FIELD_KEYS)), f"unknown keys {odd}")
    name, kind, offset = x.get("name"), x.get("type"), x.get("offset")
    need(isinstance(name, str) and bool(name), "the name is missing")
    where = f"{where} ({name})"
    need(kind in NUMERIC or kind in ("str", "bytes"), f"unknown type {kind!r}")
    need(_whole(offset) and offset >= 0, "the offset must be an integer from 0")
    order = x.get("endian", endian)
    need(order in ("little", "big"), "endian must be little or big")
    own = int(NUMERIC[kind][0][1]) if kind in NUMERIC else None
    size = x.get("size", own)
    need(_whole(size) and size > 0, f"{kind} needs a size")
    need(own is None or size == own, f"{kind} has {own} bytes")
    need(room is None or offset + size <= room, f"it ends at {offset + size}, past {room} bytes")
    whole = kind in NUMERIC and kind[0] != "f"
    need(x.get("time") is None or (x["time"] in TIMES and whole), f"time is one of {sorted(TIMES)}, of an integer")
    bits = x.get("bits")
    need(bits is None or (whole and isinstance(bits, dict)), "bits map names to bit numbers of an integer")
    need(all(_whole(b) and 0 <= b < 8 * size for b in (bits or {}).values()), f"bits are numbered 0 to {8 * size - 1}")
    for k in ("scale", "add"):
        need(x.get(k) is None or isinstance(x[k], (int, float)), f"{k} must be a number")
    return Field(name, kind, offset, size, order == "big", x.get("scale"), x.get("add"), x.get("time"), tuple((bits or {}).items()), x.get("encoding", "ascii"))


def parse(spec: dict | str) -> Layout:
    """A layout from a spec, a mapping or YAML text. SpecError (a ValueError) says what is wrong with it."""
    if isinstance(spec, str):
        import yaml

        try:
            spec = yaml.safe_load(spec)
        except yaml.YAMLError as error:
            raise SpecError(f"not YAML: {error}") from None
    if not isinstance(spec, dict):
        raise SpecError("a spec is a mapping")
    if odd := sorted(set(spec) - SPEC_KEYS):
        raise SpecError(f"unknown keys {odd}")
    header, record, declared, endian = spec.get("header", 0), spec.get("record_size"), spec.get("count"), spec.get("endian", "little")
    if endian not in ("little", "big"):
        raise SpecError("endian must be little or big")
    if not _whole(header) or header < 0:
        raise SpecError("header must be a number of bytes")
    if (spec.get("fields") and not _whole(record)) or (record is not None and (not _whole(record) or record < 1)):
        raise SpecError("record_size must be a positive number of bytes")
    if declared is not None and (not _whole(declared) or declared < 0):
        raise SpecError("count must be an integer from 0")
    fields = tuple(_field(x, f"fields[{i}]", endian, record) for i, x in enumerate(spec.get("fields") or []))
    head = tuple(_field(x, f"header_fields[{i}]", endian, None) for i, x in enumerate(spec.get("header_fields") or []))
    if len({f.name for f in fields}) < len(fields):
        raise SpecError("field names must be unique")
    if not fields and not head:
        raise SpecError("there are no fields")
    return Layout(record or 0, header, fields, head, declared)


def spark_type(f: Field, times: str = "string") -> str:
    if f.time:
        return times
    if f.text:
        return "string"
    if f.bits:
        return f"struct<value:{NUMERIC[f.kind][1]}," + ",".join(f"`{n}`:boolean" for n, _ in f.bits) + ">"
    return "double" if f.scale is not None or f.add is not None else NUMERIC[f.kind][1]


def _micros(v: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """Microseconds since 1970, and which are of the years 1 to 9999 (others count as 0)."""
    a_second = TIMES[unit]
    x = v.astype(np.int64) if v.dtype.kind == "i" else np.minimum(v, np.array(np.iinfo(np.int64).max, v.dtype) if v.dtype.itemsize == 8 else v).astype(np.int64)
    fine = (x >= -62135596800 * a_second) & (x < 253402300800 * a_second)
    return np.where(fine, x, 0) * (1_000_000 // a_second), fine


def iso_times(v: np.ndarray, unit: str) -> list[str]:
    """ISO times, with microseconds where there are any."""
    micros, fine = _micros(v, unit)
    shown = np.datetime_as_string(micros.astype("datetime64[us]"))
    return [f"{t.removesuffix('.000000')}Z" if ok else f"invalid time {x}" for t, ok, x in zip(shown, fine, v.tolist())]


def column(f: Field, raw: np.ndarray, times: str = "string") -> pa.Array:
    """A field's values of records given as rows of bytes.

    Text ends at a NUL byte; bytes are hex. Times are ISO strings, with microseconds where there are any, or (times =
    timestamp) timestamps, null outside the years 1 to 9999. A 32-bit float is scaled as its shortest decimal form.
    """
    part = np.ascontiguousarray(raw[:, f.offset : f.offset + f.size])
    if f.kind == "bytes":
        return pa.array([x.tobytes().hex(" ") for x in part], pa.string())
    if f.kind == "str":
        return pa.array([x.tobytes().split(b"\0", 1)[0].decode(f.encoding, "replace") for x in part], pa.string())
    v = part.view(f.dtype).ravel()
    if f.time:
        if times == "timestamp":
            micros, fine = _micros(v, f.time)
            return pa.array(micros, pa.int64(), mask=~fine).cast(pa.timestamp("us", "UTC"))
        return pa.array(iso_times(v, f.time), pa.string())
    plain = pa.array(v.tolist(), _ARROW[NUMERIC[f.kind][1]]) if f.kind == "u64" else pa.array(v.astype(v.dtype.newbyteorder("=")).astype(_ARROW[NUMERIC[f.kind][1]].to_pandas_dtype()))
    if f.bits:
        return pa.StructArray.from_arrays([plain, *(pa.array((v >> np.array(b, v.dtype.newbyteorder("="))) & 1 == 1) for _, b in f.bits)], ["value", *(n for n, _ in f.bits)])
    if f.scale is not None or f.add is not None:
        exact = v.astype("U").astype(float) if f.kind == "f32" else v.astype(float)
        return pa.array(exact * (1 if f.scale is None else f.scale) + (f.add or 0))
    return plain


def packed(batch: pa.RecordBatch, layout: Layout) -> np.ndarray:
    """Records (rows of bytes) of a batch with a column for each field; what no field covers is zero.

    A null, text that is too long and a number that the field can't hold are errors: records have no room for them.
    """
    out = np.zeros((batch.num_rows, layout.record), np.uint8)
    for f in layout.fields:
        values = batch.column(batch.schema.get_field_index(f.name))
        if values.null_count:
            raise ValueError(f"{f.name}: null can't be written")
        if f.text:
            coded = [v.encode(f.encoding) if isinstance(v, str) and f.kind == "str" else bytes.fromhex(v) if isinstance(v, str) else bytes(v) for v in values.to_pylist()]
            if any(len(x) > f.size for x in coded):
                raise ValueError(f"{f.name}: longer than {f.size} bytes")
            data = np.frombuffer(b"".join(x.ljust(f.size, b"\0") for x in coded), np.uint8)
        else:
            data = np.frombuffer(_numbers(f, values).tobytes(), np.uint8)
        out[:, f.offset : f.offset + f.size] = data.reshape(-1, f.size)
    return out


def _numbers(f: Field, values: pa.Array) -> np.ndarray:
    if pa.types.is_struct(values.type):
        values = values.field("value")
    if pa.types.is_timestamp(values.type):
        values = pa.array(values.cast(pa.timestamp("us", values.type.tz)).cast(pa.int64()).to_numpy() // (1_000_000 // TIMES[f.time or "unix_s"]))
    v = np.array(values.to_pylist(), object) if pa.types.is_decimal(values.type) else values.to_numpy(zero_copy_only=False)
    if f.scale is not None or f.add is not None:
        v = (v.astype(float) - (f.add or 0)) / (1 if f.scale is None else f.scale)
    if f.kind[0] == "f":
        return v.astype(f.dtype)
    if v.dtype.kind == "f":
        v = np.rint(v)
    range_ = np.iinfo(f.dtype[1:])
    if len(v) and not (v.min() >= range_.min and v.max() <= range_.max):
        raise ValueError(f"{f.name}: a value doesn't fit into {f.kind}")
    return v.astype(f.dtype)


# ---- files ----


def opened(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri else "file://" + os.path.abspath(uri.removeprefix("file:")))


def listed(paths: str) -> list[tuple[str, int]]:
    """(URI, bytes) of the files that paths (parted by commas) name: files, and those in folders but hidden ones."""
    out = []
    for path in (p.strip() for p in paths.split(",") if p.strip()):
        fs, base = opened(path)
        info = fs.get_file_info(base)
        if info.type == pyarrow.fs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = [info] if info.is_file else [x for x in fs.get_file_info(pyarrow.fs.FileSelector(base)) if x.is_file and x.base_name[0] not in "._"]
        scheme = path.split("://")[0] + "://" + path.split("://")[1].split("/")[0] if "://" in path and not path.startswith("file://") else "file://"
        out += sorted((scheme + x.path if scheme == "file://" or not x.path.startswith(scheme) else x.path, x.size) for x in found)
    return out


@dataclass
class Range:
    path: str
    size: int
    first: int
    count: int


@dataclass
class Ranges(InputPartition):
    """What one task reads."""

    ranges: list[Range]


def packed_ranges(ranges: list[Range], room: int) -> list[Ranges]:
    """Ranges in their order, several to a task where they have ``room`` together; few stay apart, so that all cores read."""
    most = max(1, min(RANGES_A_TASK, len(ranges) // TASKS))
    out, full = [], 0
    for r in ranges:
        if not out or full + r.count > room or len(out[-1].ranges) == most:
            out.append(Ranges([]))
            full = 0
        out[-1].ranges.append(r)
        full += r.count
    return out


class RecordReader(DataSourceReader):
    """Ranges of each file; those that pushed filters rule out are not planned. A task reads a large range, or many small ones."""

    def __init__(self, options):
        self.layout = parse(json.loads(options["spec"])) if "spec" in options else None
        self.paths, self.rows, self.times = options["path"], options.get("rows", "records"), options.get("times", "string")
        self.per_range = int(options.get("recordsPerPartition", 1 << 20))
        self.block = int(options.get("blockBytes", 1 << 16))
        self.sorted_by = next((f for f in self.layout.fields if f.name == options.get("sortedBy")), None) if self.layout else None
        self.low, self.high = 0, None
        self.least = self.most = None

    def pushFilters(self, filters):
        lower, upper = (EqualTo, GreaterThanOrEqual, GreaterThan), (EqualTo, LessThanOrEqual, LessThan)
        for f in filters:
            name, v = getattr(f, "attribute", None), getattr(f, "value", None)
            if self.rows == "records" and name == ("index",) and isinstance(v, int):
                if isinstance(f, lower):
                    self.low = max(self.low, v + isinstance(f, GreaterThan))
                if isinstance(f, upper):
                    top = v + (not isinstance(f, LessThan))
                    self.high = top if self.high is None else min(self.high, top)
            elif self.rows == "records" and self.sorted_by and name == (self.sorted_by.name,) and (n := self._number(v)) is not None:
                if isinstance(f, lower):
                    self.least = n if self.least is None else max(self.least, n)
                if isinstance(f, upper):
                    self.most = n if self.most is None else min(self.most, n)
            yield f  # Spark still checks each row

    def _number(self, v):
        """A filter's value on the scale of the stored field; None where it can't be told."""
        f = self.sorted_by
        if f.time:
            if self.times != "timestamp" or not isinstance(v, datetime.datetime):
                return None
            v = v if v.tzinfo else v.astimezone()
            return (v - datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc)) / datetime.timedelta(seconds=1) * TIMES[f.time]
        return v if isinstance(v, (int, float)) and not f.text and not f.bits and f.scale is None and f.add is None else None

    def _span(self, path: str, count: int) -> tuple[int, int]:
        """First record that may match the filters on the sorted field, and the first after all that may."""
        fs, base = opened(path)
        with fs.open_input_file(base) as stream:

            def value(i: int):
                raw = stream.read_at(self.sorted_by.size, self.layout.header + i * self.layout.record + self.sorted_by.offset)
                return np.frombuffer(raw, self.sorted_by.dtype)[0].item()

            def first(fits) -> int:
                low, high = 0, count
                while low < high:
                    mid = (low + high) // 2
                    low, high = (low, mid) if fits(value(mid)) else (mid + 1, high)
                return low

            # one unit of the field more on either side: filters compare rounded times
            a = 0 if self.least is None else first(lambda v: v >= self.least - 1)
            return a, count if self.most is None else first(lambda v: v > self.most + 1)

    def partitions(self):
        out = []
        step = self.per_range if self.rows == "records" else max(1, (64 << 20) // self.block)
        for path, size in listed(self.paths):
            if self.rows == "header":
                out.append(Range(path, size, 0, 1))
                continue
            unit = self.layout.counts(size)["count"] if self.rows == "records" else -(-size // self.block)
            a, b = self.low, unit if self.high is None else min(unit, self.high)
            if self.rows == "records" and (self.least, self.most) != (None, None) and a < b:
                x, y = self._span(path, unit)
                a, b = max(a, x), min(b, y)
            out += [Range(path, size, i, min(step, b - i)) for i in range(a, b, step)]
        return packed_ranges(out, max(step, RECORDS_A_TASK) if self.rows == "records" else step)

    def read(self, partition):
        if partition is None:  # nothing was planned
            return
        for part in partition.ranges:
            fs, base = opened(part.path)
            with fs.open_input_file(base) as stream:
                yield from {"records": self._records, "header": self._header, "blocks": self._blocks}[self.rows](part, stream)

    def _records(self, p, stream):
        layout, done = self.layout, 0
        while done < p.count:
            n = min(1 << 14, p.count - done)
            at = layout.header + (p.first + done) * layout.record
            raw = np.frombuffer(stream.read_at(n * layout.record, at), np.uint8).reshape(n, -1)
            index = np.arange(p.first + done, p.first + done + n)
            columns = [pa.array([p.path] * n), pa.array(index), *(column(x, raw, self.times) for x in layout.fields)]
            yield pa.RecordBatch.from_arrays(columns, ["path", "index", *(x.name for x in layout.fields)])
            done += n

    def _header(self, p, stream):
        layout, counts = self.layout, self.layout.counts(p.size)
        end = max([f.offset + f.size for f in layout.head], default=0)
        raw = np.frombuffer(stream.read_at(min(end, p.size), 0), np.uint8)[None]
        values = [column(f, raw, self.times) if f.offset + f.size <= p.size else pa.nulls(1, column(f, np.zeros((1, end), np.uint8), self.times).type) for f in layout.head]
        past = [f.name for f in layout.head if f.offset + f.size > p.size]
        facts = [pa.array([p.path]), pa.array([p.size]), *(pa.array([counts[k]]) for k in ("available", "count", "trailing")), pa.array([past], pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays([*facts, *values], [*HEAD, *(f.name for f in layout.head)])

    def _blocks(self, p, stream):
        for i in range(p.first, p.first + p.count):
            at = i * self.block
            yield pa.RecordBatch.from_arrays([pa.array([p.path]), pa.array([p.size]), pa.array([at]), pa.array([stream.read_at(min(self.block, p.size - at), at)], pa.binary())], ["path", "size", "offset", "content"])


HEAD = ("path", "size", "available", "count", "trailing", "past_end")


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class RecordWriter(DataSourceArrowWriter):
    """A file for each task, or for each value of the column ``fileBy`` in it, under a hidden name until the commit."""

    def __init__(self, options, schema, overwrite: bool):
        self.layout, self.folder, self.by, self.overwrite = parse(json.loads(options["spec"])), options["path"], options.get("fileBy"), overwrite
        names, wanted = {f.name for f in schema}, {f.name for f in self.layout.fields}
        if missing := sorted((wanted | ({self.by} if self.by else set())) - names):
            raise SpecError(f"there are no columns {missing}")
        self.header = np.zeros((1, self.layout.header), np.uint8)
        given = json.loads(options.get("headerValues", "{}"))
        head = Layout(self.layout.header, 0, tuple(f for f in self.layout.head if f.name in given))
        if given:
            batch = pa.RecordBatch.from_pylist([given])
            self.header = packed(batch, head)

    def write(self, iterator) -> Written:
        from pyspark import TaskContext

        fs, base = opened(self.folder)
        fs.create_dir(base, recursive=True)
        task, files, stream, key = TaskContext.get(), [], None, None
        mark = f"{task.partitionId():05d}-{uuid.uuid4().hex[:8]}"
        for batch in iterator:
            keys = batch.column(batch.schema.get_field_index(self.by)).to_pylist() if self.by else [""] * batch.num_rows
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if stream is None or keys[a] != key:
                    if stream:
                        stream.close()
                    key = keys[a]
                    named = f"{key}-" if self.by else "part-"
                    files.append((f"{base}/.{named}{mark}-{len(files)}", f"{base}/{named}{mark}-{len(files)}.bin"))
                    stream = fs.open_output_stream(files[-1][0])
                    stream.write(self.header.tobytes())
                stream.write(packed(batch.slice(a, b - a), self.layout).tobytes())
        if stream:
            stream.close()
        return Written(files)

    def commit(self, messages) -> None:
        fs, base = opened(self.folder)
        done = [f for m in messages if m for f in m.files]
        if self.overwrite:
            for x in fs.get_file_info(pyarrow.fs.FileSelector(base, allow_not_found=True)):
                if x.is_file and x.path not in {a for a, _ in done}:
                    fs.delete_file(x.path)
        for a, b in done:
            fs.move(a, b)

    def abort(self, messages) -> None:
        fs, _ = opened(self.folder)
        for a, _ in (f for m in messages if m for f in m.files):
            fs.delete_file(a)


class Records(DataSource):
    """spark.read.format("records").option("spec", json).load(path), and df.write.format("records") of the same.

    Options to read: rows (records, header, blocks), times (string, timestamp), sortedBy, recordsPerPartition (where
    files are cut), blockBytes. To write: headerValues (json), fileBy (rows come sorted by it).
    """

    @classmethod
    def name(cls):
        return "records"

    def schema(self):
        rows, times = self.options.get("rows", "records"), self.options.get("times", "string")
        if rows == "blocks":
            return "path string, size long, offset long, content binary"
        layout = parse(json.loads(self.options["spec"]))
        if rows == "header":
            return ", ".join(["path string, size long, available long, count long, trailing long, past_end array<string>", *(f"`{f.name}` {spark_type(f, times)}" for f in layout.head)])
        return ", ".join(["path string, index long", *(f"`{f.name}` {spark_type(f, times)}" for f in layout.fields)])

    def reader(self, schema):
        return RecordReader(self.options)

    def writer(self, schema, overwrite):
        return RecordWriter(self.options, schema, overwrite)


def _source(spark: SparkSession):
    spark.dataSource.register(Records)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("records")


def _text(spec: dict | str) -> str:
    """A spec as JSON, once it has been found fit."""
    parse(spec)
    if isinstance(spec, str):
        import yaml

        spec = yaml.safe_load(spec)
    return json.dumps(spec)


def read(spark: SparkSession, path: str, spec: dict | str, per_partition: int = 1 << 20, times: str = "string", sorted_by: str = "") -> DataFrame:
    """(path, index, fields): a row for each record. Files sorted by a field are searched for filters on it."""
    return _source(spark).option("spec", _text(spec)).option("times", times).option("sortedBy", sorted_by).option("recordsPerPartition", per_partition).load(path)


def headers(spark: SparkSession, path: str, spec: dict | str) -> DataFrame:
    """A row for each file: its size, records available and counted, bytes left over, header fields; those past its end are null and named."""
    return _source(spark).option("spec", _text(spec)).option("rows", "header").load(path)


def blocks(spark: SparkSession, path: str, size: int = 1 << 16) -> DataFrame:
    """(path, size, offset, content): each file's bytes, block by block."""
    return _source(spark).option("rows", "blocks").option("blockBytes", size).load(path)


def write(df: DataFrame, path: str, spec: dict | str, header: dict | None = None, file_by: str = "", mode: str = "append") -> None:
    """df's rows as records: a file for each partition, or for each value of a column where the rows come sorted by it."""
    _source(df.sparkSession)
    to = df.write.format("records").mode(mode).option("spec", _text(spec)).option("headerValues", json.dumps(header or {}))
    (to.option("fileBy", file_by) if file_by else to).save(path)


def page(records: DataFrame, start: int, count: int, fields: list[str] | None = None) -> DataFrame:
    """Up to 200 records of each file from an index on, of some fields; unknown fields are an error."""
    if unknown := set(fields or []) - set(records.columns):
        raise SpecError(f"unknown fields {sorted(unknown)}")
    start, count = max(0, start), max(1, min(count, RECORDS_READ))
    some = records.where(F.col("index").between(start, start + count - 1))
    return some.select("path", "index", *(fields or [x for x in records.columns if x not in ("path", "index")]))


def byte_range(spark: SparkSession, path: str, offset: int, length: int = 256) -> DataFrame:
    """(path, offset, length, hex) of each file's bytes from an offset on, at most 4096; length is 0 past the end."""
    length = max(1, min(length, BYTES_READ))
    parts = blocks(spark, path, BYTES_READ).where(F.col("offset").between(offset - BYTES_READ + 1, offset + length - 1) | (F.col("offset") == 0))
    cut = F.substring("content", F.greatest(F.lit(offset) - F.col("offset"), F.lit(0)).cast("int") + 1, F.greatest(F.least(F.lit(offset + length) - F.col("offset"), F.lit(BYTES_READ)) - F.greatest(F.lit(offset) - F.col("offset"), F.lit(0)), F.lit(0)).cast("int"))
    pieces = parts.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("offset", F.hex(cut).alias("h")))).alias("p"))
    shown = F.lower(F.array_join(F.transform("p", lambda x: x["h"]), ""))
    return pieces.select("path", F.lit(offset).cast("long").alias("offset"), (F.length(shown) / 2).cast("long").alias("length"), F.trim(F.regexp_replace(shown, "(..)", "$1 ")).alias("hex"))


# ---- report ----


def before(df: DataFrame, value: Column, by: str = "path", order: str = "index", span: int = 1 << 20) -> DataFrame:
    """df with ``_before``: value of the row before in its file. Files are cut into spans; the ends of spans meet apart."""
    df = df.withColumn("_v", value).withColumn("_span", F.floor(F.col(order) / span))
    inner = df.withColumn("_before", F.lag("_v").over(Window.partitionBy(by, "_span").orderBy(order)))
    ends = df.where(F.col(order) % span == span - 1).select(by, (F.col("_span") + 1).alias("_span"), F.col("_v").alias("_last"))
    joined = inner.join(ends, [by, "_span"], "left")
    return joined.withColumn("_before", F.when(F.col(order) % span == 0, F.col("_last")).otherwise(F.col("_before"))).drop("_v", "_span", "_last")


def field_stats(spark: SparkSession, path: str, spec: dict | str) -> DataFrame:
    """A row for each file and field: what tells a wrong guess.

    Numbers: values that are not finite, least, greatest and mean (of finite ones), how many differ among the first
    200,000, how often the next is not less, and the range in the other byte order. Text: the printable share of the
    first 2000, and how many of them differ. Times count as stored.
    """
    spec = json.loads(_text(spec))
    layout = parse(spec)
    bare = [{k: f[k] for k in ("name", "offset", "type", "size", "endian", "encoding") if k in f} for f in spec["fields"]]
    turn = {"little": "big", "big": "little"}
    other = [{**b, "name": f"{b['name']}|other", "endian": turn[b.get("endian", spec.get("endian", "little"))]} for b, f in zip(bare, layout.fields) if not f.text]
    rows = read(spark, path, {**spec, "fields": bare + other})
    number = lambda n: F.col(f"`{n}`").cast("double")
    each = [F.struct(F.lit(f.name).alias("field"), F.lit(f.text).alias("is_text"), F.lit(f.size).alias("bytes"), *(F.lit(None).cast("double").alias(x) if f.text else number(f.name + y).alias(x) for x, y in (("v", ""), ("o", "|other"))), (F.col(f"`{f.name}`") if f.text else F.lit(None).cast("string")).alias("t")) for f in layout.fields]
    long = rows.select("path", "index", F.explode(F.array(*each)).alias("x")).select(F.struct("path", "x.field").alias("key"), "index", "x.*")
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
    v, o = finite(F.col("v")), finite(F.col("o"))
    stepped = before(long, v, by="key")
    step = F.col("_before").isNotNull() & v.isNotNull()
    few = F.col("index") < 2000
    made = stepped.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("is_text") & v.isNull()).alias("nan_or_inf"), F.min(v).alias("min"), F.max(v).alias("max"), F.round(F.avg(v), 6).alias("mean"),
        F.count_distinct(F.when(F.col("is_text"), F.when(few, F.col("t"))).otherwise(F.when(F.col("index") < 200_000, v).cast("string"))).alias("distinct"),
        F.round(F.count_if(step & (v >= F.col("_before"))) / F.nullif(F.count_if(step), F.lit(0)), 3).alias("increasing_share"),
        F.min(F.when(F.col("bytes") > 1, o)).alias("other_min"), F.max(F.when(F.col("bytes") > 1, o)).alias("other_max"),
        F.round(F.avg(F.when(F.col("is_text") & few, F.rlike("t", F.lit("^[ -~]*$")).cast("int"))), 3).alias("printable_share"),
    )
    return made.select("key.path", "key.field", *(x for x in made.columns if x != "key"))


def warnings(spark: SparkSession, path: str, spec: dict | str) -> DataFrame:
    """(path, field, warning): what speaks against a spec, file by file; none for a file that it fits."""
    layout = parse(spec)
    kinds = {f.name: f for f in layout.fields}
    w = lambda cond, text: F.when(cond, text)
    by_kind = lambda fits: F.col("field").isin(*[n for n, f in kinds.items() if fits(f)] or [""])
    scale = F.when(by_kind(lambda f: f.time == "unix_ms"), 1000).otherwise(1)
    low, high, share = F.col("min") / scale, F.col("max") / scale, F.col("increasing_share")
    found = F.array_compact(F.array(
        w(F.col("nan_or_inf") > 0, F.format_string("%d values are not finite", "nan_or_inf")),
        w(by_kind(lambda f: f.time) & ((low < EPOCH[0]) | (high > EPOCH[1])), F.lit("times outside 2000 to 2100")),
        w(by_kind(lambda f: f.time) & (share < 0.95), F.lit("time goes backwards")),
        w(by_kind(lambda f: f.kind[0] == "f") & (F.greatest(F.abs("min"), F.abs("max")) > 1e9), F.lit("very large floats")),
        w(by_kind(lambda f: f.kind == "str") & (F.col("printable_share") < 0.9), F.lit("text is not printable")),
    ))
    of_fields = field_stats(spark, path, spec).select("path", "field", F.explode(found).alias("warning"))
    rest = F.array_compact(F.array(
        w((F.col("trailing") != 0) & F.lit(layout.declared is None), F.format_string("%d bytes are left after the last record", "trailing")),
        w(F.lit(layout.declared or 0) > F.col("available"), F.format_string("%d records are declared, %d fit", F.lit(layout.declared or 0).cast("long"), "available")),
    ))
    of_files = headers(spark, path, spec).select("path", F.lit(None).cast("string").alias("field"), F.explode(rest).alias("warning"))
    ends = sorted((f.offset, f.offset + f.size, f.name) for f in layout.fields)
    crossed = [f"{a[2]} and {b[2]} overlap" for a, b in zip(ends, ends[1:]) if b[0] < a[1]]
    same = headers(spark, path, spec).select("path", F.lit(None).cast("string").alias("field"), F.explode(F.array(*map(F.lit, crossed)).cast("array<string>")).alias("warning"))
    return of_fields.unionByName(of_files).unionByName(same)


def header_values(content: bytes, layout: Layout) -> dict:
    raw = np.frombuffer(content, np.uint8)[None]
    return {f.name: column(f, raw)[0].as_py() if f.offset + f.size <= len(content) else "past end of file" for f in layout.head}


def export(records: DataFrame, folder: str, spec: dict) -> str:
    """Writes the records as JSON lines under a name that follows from the spec; a second export reuses it."""
    path = f"{folder.rstrip('/')}/{hashlib.sha256(json.dumps(spec, sort_keys=True).encode()).hexdigest()[:16]}"
    records.write.mode("ignore").json(path)
    return path
