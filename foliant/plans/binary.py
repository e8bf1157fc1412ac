"""Binary records: the event log written as device logs, read back, checked, and looked at as if it were unknown."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.plans.registry import query, scratch, table
from foliant.sources import layouts as L
from foliant.sources import records as R

#: Events of a device's file: as many ids in a row.
IDS = 2500
SPEC = """
name: device log
endian: little
header: 64
record_size: 48
header_fields:
  - {name: magic, type: str, offset: 0, size: 4}
  - {name: version, type: u16, offset: 4, endian: big}
  - {name: record, type: u16, offset: 6}
fields:
  - {name: sync, type: bytes, offset: 0, size: 4}
  - {name: event_id, type: u32, offset: 4}
  - {name: at, type: u64, offset: 8, time: unix_ms}
  - {name: second, type: u32, offset: 16}
  - {name: value, type: f64, offset: 20}
  - {name: half, type: i16, offset: 30, scale: 0.5, add: 10, endian: big}
  - {name: flags, type: u8, offset: 32, bits: {large: 0, sale: 1}}
  - {name: kind, type: str, offset: 34, size: 10, encoding: utf-8}
  - {name: user_id, type: u32, offset: 44}
"""
HEADER = {"magic": "DLOG", "version": 3, "record": 48}


def _logs(spark, sf_dir):
    """The folder of the event log's device files, each in the order of its events."""
    e = table(spark, sf_dir, "events")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    bits = (F.col("value") > 50).cast("int") + 2 * (F.col("event_type") == "purchase").cast("int")
    rows = e.select(
        F.floor(F.col("event_id") / IDS).alias("device"), F.lit("aa 55 aa 55").alias("sync"), "event_id", ms.alias("at"), F.floor(ms / 1000).alias("second"), F.coalesce("value", F.lit(0.0)).alias("value"),
        "user_id", (F.col("user_id") % 100 / 2 + 10).alias("half"), bits.alias("flags"), F.col("event_type").alias("kind"),
    )
    folder = scratch(spark, "records")
    R.write(rows.repartition("device").sortWithinPartitions("device", "event_id"), folder, SPEC, HEADER, "device")
    return folder


def _device(path="path"):
    return F.regexp_extract(path, r"/(\d+)-[^/]*$", 1).cast("long").alias("device")


@query(
    f"""select event_id // {IDS} as device, event_id % {IDS} as idx, event_id,
      strftime(ts, '%Y-%m-%dT%H:%M:%S') || case when epoch_us(ts) // 1000 % 1000 = 0 then '' else printf('.%03d000', epoch_us(ts) // 1000 % 1000) end || 'Z' as "at", coalesce(value, 0) as value, user_id,
      user_id % 100 / 2.0 + 10 as half, value > 50 as large, event_type = 'purchase' as sale, event_type as kind from events"""
)
def binary_records(spark, sf_dir):
    """Every event written as a record and read back by the data source."""
    r = R.read(spark, _logs(spark, sf_dir), SPEC, 1 << 16)
    return r.select(_device(), F.col("index").alias("idx"), F.col("event_id").cast("long").alias("event_id"), "at", "value", F.col("user_id").cast("long").alias("user_id"), "half", "flags.large", "flags.sale", "kind")


@query(f"select event_id, value, event_id % {IDS} as idx from events where ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-09' and event_id % {IDS} >= 100")
def binary_time_range(spark, sf_dir):
    """Records of four days from each file's hundredth on: both filters are answered before anything is decoded."""
    r = R.read(spark, _logs(spark, sf_dir), SPEC, 1 << 10, times="timestamp", sorted_by="at")
    some = r.where("at >= timestamp'2024-01-05' and at < timestamp'2024-01-09' and index >= 100")
    return some.select(F.col("event_id").cast("long").alias("event_id"), "value", F.col("index").alias("idx"))


@query(f"select event_id // {IDS} as device, 64 + 48 * count(*) as size, count(*) as available, count(*) as count, 0::bigint as trailing, 'DLOG' as magic, 3 as version, 48 as record from events group by 1")
def binary_headers(spark, sf_dir):
    return R.headers(spark, _logs(spark, sf_dir), SPEC).select(_device(), "size", "available", "count", "trailing", "magic", "version", "record")


@query(f"select event_id // {IDS} as device, event_id % {IDS} as idx, event_id, event_type as kind from events where event_id % {IDS} between 1500 and 1699")
def binary_page(spark, sf_dir):
    """Two hundred records of each file from the 1500th on, of two fields."""
    got = R.page(R.read(spark, _logs(spark, sf_dir), SPEC), 1500, 500, ["event_id", "kind"])
    return got.select(_device(), F.col("index").alias("idx"), F.col("event_id").cast("long").alias("event_id"), "kind")


def _little(x: str, n: int) -> str:
    """SQL: the n bytes of an integer as hex, least first."""
    return " || ".join(f"printf('%02x ', ({x} >> {8 * i}) & 255)" for i in range(n))


@query(f"select event_id // {IDS} as device, 20::bigint as length, 'aa 55 aa 55 ' || {_little('event_id', 4)} || {_little('(epoch_us(ts) // 1000)', 8)} || trim({_little('(epoch_us(ts) // 1000000)', 4)}) as hex from events where event_id % {IDS} = 1000")
def binary_bytes(spark, sf_dir):
    """Twenty bytes of each file: the 1000th record's beginning."""
    got = R.byte_range(spark, _logs(spark, sf_dir), 64 + 48 * 1000, 20)
    return got.where("length > 0").select(_device(), "length", "hex")


_STEPS = f"e as (select event_id // {IDS} as device, event_id, epoch_us(ts) // 1000 as ms, epoch_us(ts) // 1000000 as s, coalesce(value, 0) as value, user_id from events)"
_STAT = """select device, '{f}' as field, count(*) as n, 0::bigint as nan_or_inf, min({f})::double as min, max({f})::double as max, round(avg({f}), 6) as mean, count(distinct {f}) as "distinct",
  round(count(*) filter ({f} >= p) / nullif(count(p), 0), 3) as increasing_share from (select *, lag({f}) over (partition by device order by event_id) as p from e) group by device"""


@query(f"with {_STEPS} {' union all '.join(_STAT.format(f=f) for f in ('event_id', 'value', 'user_id'))} union all {_STAT.format(f='ms').replace(chr(39) + 'ms' + chr(39), chr(39) + 'at' + chr(39))}")
def binary_field_stats(spark, sf_dir):
    """What the report tells of each file's fields, with the share of records that don't fall behind the one before."""
    stats = R.field_stats(spark, _logs(spark, sf_dir), SPEC).where("field in ('event_id', 'value', 'user_id', 'at')")
    return stats.select(_device(), "field", "n", "nan_or_inf", "min", "max", "mean", "distinct", "increasing_share")


@query(
    f"""with g as (select event_id // {IDS} as device, count(*) as n from events group by 1)
    select device, (64 + 48 * n - 100) - (64 + 48 * n - 100) // 48 * 48 || ' bytes are left after the last record' as warning from g
    union all select device, 'time goes backwards' from g"""
)
def binary_warnings(spark, sf_dir):
    """A layout that is wrong by 36 bytes: bytes are left over, and the log's low half of a time is read as a time."""
    fields = [{"name": "t", "type": "u32", "offset": 4, "time": "unix_s"}]
    found = R.warnings(spark, _logs(spark, sf_dir), {"record_size": 48, "header": 100, "fields": fields})
    return found.where("warning <> 'times outside 2000 to 2100'").select(_device(), "warning")


@query(f"select event_id // {IDS} as device, 48 as record_size, 64::bigint as header_size, 'constant bytes' as method, count(*) as records from events group by 1 having count(*) > 1000")
def binary_layout(spark, sf_dir):
    """Record length and header of each file as found from its bytes alone; files of over a thousand records."""
    lengths = L.record_lengths(L.files(spark, _logs(spark, sf_dir))).persist()  # a row for each file
    found = lengths.join(L.header_sizes(lengths), "path").where(f"size > {64 + 48 * 1000}")
    return found.select(_device(), "record_size", "header_size", "method", F.floor((F.col("size") - F.col("header_size")) / F.col("record_size")).alias("records"))


@query(
    f"""with {_STEPS}, s as (select *, event_id - lag(event_id) over w as d from e window w as (partition by device order by event_id)), g as (select device, count(*) as n from e group by 1 having count(*) > 1000)
    select device, 4 as "offset", 'u32' as type, 'counter' as what, min(event_id)::double as low, max(event_id)::double as high, median(d)::double as step from s join g using (device) group by device
    union all select device, 8, 'u64', 'timestamp', min(ms), max(ms), null from s join g using (device) group by device
    union all select device, 16, 'u32', 'timestamp', min(s), max(s), null from s join g using (device) group by device"""
)
def binary_fields(spark, sf_dir):
    """The counter and the two times that the bytes of each file show, with their ranges; files of over a thousand records."""
    lengths = L.record_lengths(L.files(spark, _logs(spark, sf_dir))).persist()  # a row for each file
    seen = L.fields(lengths.join(L.header_sizes(lengths), "path").persist()).where("records > 1000")
    each = seen.select(_device(), F.explode("findings").alias("f")).where("f.what <> 'float' and f.endian = 'little' and f.offset % f.width = 0")
    return each.select("device", "f.offset", "f.type", "f.what", "f.low", "f.high", F.when(F.col("f.what") == "counter", F.col("f.step")).alias("step"))


@query(
    f"""with b as (select event_id // {IDS} as device, unnest([170, 85, 170, 85] || list_transform(range(4), lambda i: (event_id >> (8 * i)) & 255) || list_transform(range(8), lambda i: (epoch_us(ts) // 1000 >> (8 * i)) & 255)) as byte from events),
    h as (select device, byte, count(*) as n from b group by all), t as (select device, sum(n) as total from h group by 1)
    select device, total::bigint as bytes, round(-sum(n / total * log2(n / total)), 2) as entropy from h join t using (device) group by device, total"""
)
def binary_entropy(spark, sf_dir):
    """Entropy of files of three fields, over all of a file's blocks."""
    spec = {"record_size": 16, "fields": [{"name": "sync", "type": "bytes", "offset": 0, "size": 4}, {"name": "event_id", "type": "u32", "offset": 4}, {"name": "at", "type": "u64", "offset": 8}]}
    e = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / IDS).alias("device"), F.lit("aa 55 aa 55").alias("sync"), "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"))
    folder = scratch(spark, "records")
    R.write(e.repartition("device").sortWithinPartitions("device", "event_id"), folder, spec, file_by="device")
    got = L.entropies(R.blocks(spark, folder, 4096))
    return got.select(_device(), F.col("size").alias("bytes"), "entropy")


@query(f"select event_id // {IDS} as device, 64 + 48 * (event_id % {IDS}) + 34 as \"offset\", event_type as text from events where length(event_type) >= 6")
def binary_strings(spark, sf_dir):
    """Kinds of events of six letters or more, where they stand in the files."""
    runs = L.printable_runs(R.blocks(spark, _logs(spark, sf_dir), 1 << 13)).where("encoding = 'ascii' and text in ('signup', 'purchase')")
    return runs.select(_device(), "offset", "text")


@query(f"select event_id // {IDS} as device, 'record size 48, header 64, records ' || count(*) as line from events group by 1 having count(*) > 1000")
def binary_overview(spark, sf_dir):
    """The line of each file's overview that tells its structure."""
    found = L.overview(spark, _logs(spark, sf_dir)).where("records > 1000")
    return found.select(_device(), F.split("text", "\n")[1].alias("line"))
