import json
import struct
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.operators import rules as R
from foliant.sources import files as S
from foliant.sources import layouts as L
from foliant.sources import records as B

SPEC = {"record_size": 32, "header": 64, "endian": "little", "header_fields": [{"name": "magic", "type": "str", "offset": 0, "size": 4}, {"name": "declared", "type": "u32", "offset": 8}], "fields": [{"name": "time", "type": "u32", "offset": 0, "time": "unix_s"}, {"name": "temperature", "type": "f32", "offset": 4}, {"name": "humidity", "type": "f32", "offset": 8}, {"name": "sequence", "type": "u16", "offset": 12}, {"name": "flags", "type": "u8", "offset": 14, "bits": {"a": 0, "b": 1}}, {"name": "sync", "type": "bytes", "offset": 16, "size": 4}, {"name": "pressure", "type": "i16", "offset": 20, "scale": 0.1}]}


def log(n):
    rng = np.random.default_rng(1)
    head = struct.pack("<4sHHI24s", b"DLOG", 1, 32, n, b"sensor number one").ljust(64, b"\0")
    rows = [struct.pack("<IffHBB4shxx", 1700000000 + 10 * i, 20 + float(rng.normal()), 50 + float(rng.normal()), i & 0xFFFF, 3 if i % 2 == 0 else 0, 7, b"\xaa\x55\xaa\x55", 1000 + i % 50).ljust(32, b"\0") for i in range(n)]
    return head + b"".join(rows)


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    p = tmp_path_factory.mktemp("logs") / "device.bin"
    p.write_bytes(log(3000))
    return str(p)


def test_records(spark, path):
    df = B.read(spark, path, SPEC, 700)
    assert df.count() == 3000 and df.rdd.getNumPartitions() == 5
    r = df.where("index = 1532").first()
    assert r.sequence == 1532 and r.time == "2023-11-15T02:28:40Z" and r.sync == "aa 55 aa 55" and abs(r.pressure - (1000 + 1532 % 50) / 10) < 1e-9
    assert tuple(df.where("index = 0").first().flags) == (3, True, True)
    assert df.where("index >= 2990").count() == 10
    got = B.page(df, 10, 500, ["sequence"]).collect()
    assert len(got) == 200 and got[0].sequence == 10
    with pytest.raises(ValueError):
        B.page(df, 0, 1, ["nothing"])
    assert B.warnings(spark, path, SPEC).collect() == []
    assert B.headers(spark, path, SPEC).first()[1:] == (64 + 32 * 3000, 3000, 3000, 0, [], "DLOG", 3000)
    moved = {r.warning for r in B.warnings(spark, path, {**SPEC, "header": 68, "header_fields": []}).collect()}
    assert "28 bytes are left after the last record" in moved and "time goes backwards" in moved
    more = {r.warning for r in B.warnings(spark, path, {**SPEC, "count": 4000, "fields": [*SPEC["fields"], {"name": "x", "type": "u16", "offset": 21}]}).collect()}
    assert {"4000 records are declared, 3000 fit", "pressure and x overlap"} <= more
    assert B.header_values(log(3), B.parse(SPEC)) == {"magic": "DLOG", "declared": 3} and B.header_values(b"DLO", B.parse(SPEC))["declared"] == "past end of file"
    hexes = B.byte_range(spark, path, 4090, 20).first()
    assert hexes.hex == log(3000)[4090:4110].hex(" ") and hexes.length == 20
    assert B.byte_range(spark, path, 10**6).first().length == 0


def test_pruned_by_index_and_time(spark, path):
    df = B.read(spark, path, SPEC, 100, times="timestamp", sorted_by="time")
    assert df.rdd.getNumPartitions() == 30
    some = df.where("index >= 250 and index < 420")
    assert some.rdd.getNumPartitions() == 2 and some.count() == 170  # 250 to 349, 350 to 419
    late = df.where("time >= timestamp'2023-11-15 06:00:00' and time <= timestamp'2023-11-15 06:10:00'")
    assert late.rdd.getNumPartitions() == 1 and late.count() == 61
    assert df.where("time > timestamp'2030-01-01'").count() == 0


def test_written_and_read_back(spark, tmp_path):
    spec = """
    endian: big
    record_size: 40
    header: 16
    header_fields: [{name: mark, type: str, offset: 0, size: 4}, {name: version, type: u16, offset: 6}]
    fields:
      - {name: id, type: u64, offset: 0}
      - {name: at, type: i64, offset: 8, time: unix_ms}
      - {name: v, type: i16, offset: 16, scale: 0.5, add: 3}
      - {name: w, type: f32, offset: 18, scale: 2}
      - {name: name, type: str, offset: 22, size: 10, encoding: utf-8}
      - {name: raw, type: bytes, offset: 32, size: 3}
      - {name: flags, type: u8, offset: 35, bits: {low: 0, high: 7}}
    """
    rows = [(Decimal(2**63 + i), 1_700_000_000_000 + i, i / 2 - 10, 0.1 * i, "é" * (i % 5), b"\x01\x02\xff", i, i // 30) for i in range(90)]
    df = spark.createDataFrame(rows, "id decimal(20,0), ms long, v double, w double, name string, raw binary, flags int, device int").selectExpr("*", "timestamp_millis(ms) at")
    folder = str(tmp_path / "out")
    B.write(df.repartition(1).sortWithinPartitions("device", "id"), folder, spec, {"mark": "ABCD", "version": 7}, "device")
    back = B.read(spark, folder, spec, times="timestamp")
    got = {int(r.id) - 2**63: r for r in back.collect()}
    assert len(got) == 90 and {r.path.rsplit("/", 1)[1].split("-")[0] for r in got.values()} == {"0", "1", "2"}
    r = got[77]
    assert (r.v, round(r.w, 5), r.name, r.raw, tuple(r.flags)) == (28.5, 7.7, "éé", "01 02 ff", (77, True, False)) and r["index"] == 17
    assert back.selectExpr("unix_millis(at) m").agg({"m": "max"}).first()[0] == 1_700_000_000_089
    assert [tuple(r)[2:5] + tuple(r)[6:] for r in B.headers(spark, folder, spec).collect()] == [(30, 30, 0, "ABCD", 7)] * 3
    B.write(df.limit(5), folder, spec, mode="overwrite")
    assert B.read(spark, folder, spec).count() == 5
    for bad in (df.withColumn("v", F.lit(1e6)), df.withColumn("name", F.lit("x" * 11)), df.withColumn("flags", F.lit(None).cast("int")), df.drop("raw")):
        with pytest.raises(Exception, match="v: a value|name: longer|flags: null|no columns"):
            B.write(bad, str(tmp_path / "bad"), spec)


def test_export(spark, path, tmp_path):
    out = B.export(B.read(spark, path, SPEC), str(tmp_path), SPEC)
    assert B.export(B.read(spark, path, SPEC), str(tmp_path), SPEC) == out
    rows = spark.read.json(out)
    assert rows.count() == 3000 and rows.where("index = 0").first().flags.value == 3


@pytest.mark.parametrize("change", [{"record_size": 0}, {"fields": [], "header_fields": []}, {"fields": [{"name": "x", "type": "u32", "offset": 30}]}, {"fields": [{"name": "x", "type": "u3", "offset": 0}]}, {"fields": [{"name": "x", "type": "u8", "offset": 0}, {"name": "x", "type": "u8", "offset": 1}]}, {"fields": [{"name": "x", "type": "f32", "offset": 0, "bits": {"a": 0}}]}, {"header_size": 3}, {"fields": [{"name": "x", "type": "u8", "offset": 0, "colour": 1}]}, {"count": -1}, {"endian": "middle"}, {"fields": [{"name": "x", "type": "f32", "offset": 0, "time": "unix_s"}]}, {"fields": [{"name": "x", "type": "u8", "offset": 0, "size": 2}]}, {"record_size": None}])
def test_bad_specs(change):
    with pytest.raises(ValueError):
        B.parse({**SPEC, **change})


def test_unknown_files(spark, path, tmp_path):
    noise = np.random.default_rng(0).integers(0, 256, 300_000, np.uint8).tobytes()
    long = b"x" * 70_000 + b"\0\0" + "wide enough".encode("utf-16-le")
    odd = b"\1" * 65535 + "across blocks".encode("utf-16-le") + b"\1short\1" + b"123456"
    for name, data in {"log": log(3000), "noise": noise, "big": bytes(5000) + log(20_000), "tiny": b"abc", "long": long, "odd": odd}.items():
        (tmp_path / name).write_bytes(data)
    name = F.element_at(F.split("path", "/"), -1).alias("name")
    lengths = L.record_lengths(L.files(spark, str(tmp_path)))
    got = {r.name: r for r in lengths.select(name, "*").collect()}
    assert got["log"].record_size == 32 == got["big"].record_size and got["noise"].record_size is None and got["tiny"].record_size is None
    assert got["log"].candidates[0].size % 32 == 0 and len(got["log"].candidates) == 5
    for r in ("log", "noise"):
        a = np.frombuffer(log(3000) if r == "log" else noise, np.uint8)
        start = len(a) // 4 if len(a) > 4 * 65536 else 0
        s = a[start : start + 65536]
        rate = np.array([np.mean(s[:-p] == s[p:]) for p in range(1, 4097)])
        assert got[r].baseline == round(float(np.median(rate)), 3)
    heads = L.header_sizes(lengths)
    assert {r.name: r.header_size for r in heads.select(name, "header_size").collect() if r.name in ("log", "big")} == {"log": 64, "big": 5064}
    fields = {r.name: r for r in L.fields(lengths.join(heads, "path")).select(name, "*").collect()}
    found = {(f.offset, f.type, f.endian, f.what) for f in fields["log"].findings}
    assert {(0, "u32", "little", "timestamp"), (4, "f32", "little", "float"), (8, "f32", "little", "float"), (12, "u16", "little", "counter")} <= found
    assert (15, 19, "07 aa 55 aa 55") in {(c.start, c.end, c.bytes) for c in fields["log"].constant}
    noisy = {r.name: r for r in L.entropies(B.blocks(spark, str(tmp_path))).select(name, "*").collect()}
    assert noisy["noise"].entropy > 7.9 and noisy["noise"].blocks == 5 and noisy["tiny"].entropy == round(float(np.log2(3)), 2)
    runs = {(r.name, r.offset, len(r.text), r.encoding) for r in L.printable_runs(B.blocks(spark, str(tmp_path))).select(name, "*").collect()}
    assert ("log", 12, 17, "ascii") in runs and ("long", 0, 70_000, "ascii") in runs and ("long", 70_002, 11, "utf-16-le") in runs
    assert ("odd", 65535, 13, "utf-16-le") in runs and ("odd", len(odd) - 6, 6, "ascii") in runs and not any(n == "odd" and t == 5 for n, _, t, _ in runs)
    looks = {r.name: r for r in L.overview(spark, str(tmp_path)).select(name, "*").collect()}
    assert looks.keys() == {"log", "noise", "big", "tiny", "long", "odd"} and "record size 32, header 64, records 3000" in looks["log"].text and "no fixed record size" in looks["noise"].text


def test_header_before_a_time_whose_high_byte_changes_early(tmp_path):
    """The records begin where they begin, also if a byte that is constant later changes among the first of them."""
    for turn, head in ((0, 64), (5, 64), (50, 64), (155, 64), (155, 5064)):
        rows = [b"\xaa\x55\xaa\x55" + struct.pack("<IQI", i, 1_704_700_000_000 + i, (5 << 16) - turn + i) + np.random.default_rng(i).bytes(13) + bytes(15) for i in range(2500)]
        data = bytes(head - 64) + b"DLOG".ljust(64, b"\0") + b"".join(rows)
        (tmp_path / "f").write_bytes(data)
        ((_, header, _, method),) = L._header(str(tmp_path / "f"), len(data), 48)
        assert (header, method) == (head, "constant bytes"), turn


def test_users_beyond_two_bytes(spark, tmp_path):
    from foliant.catalogue import QUERIES

    rows = [(i, 65_000 + 400 * i, "signup", float(i)) for i in range(20)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").selectExpr("*", "timestamp_ntz'2024-01-05 00:00:00' as ts")
    events.write.parquet(str(tmp_path / "events.parquet"))
    got = QUERIES["binary_records"](spark, str(tmp_path)).collect()
    assert {(r.event_id, r.user_id, r.half) for r in got} == {(i, u, u % 100 / 2 + 10) for i, u, *_ in rows}


def test_many_small_files_share_tasks(spark, tmp_path):
    """Tasks don't grow with the number of small files; each file is still read whole and once, in each kind of rows."""
    for i in range(200):
        (tmp_path / f"{i:03d}.bin").write_bytes(log(20 + i % 3))
    df, heads, blocks = B.read(spark, str(tmp_path), SPEC, 15), B.headers(spark, str(tmp_path), SPEC), B.blocks(spark, str(tmp_path), 256)
    assert all(x.rdd.getNumPartitions() <= 60 for x in (df, heads, blocks))
    got = {r.path[-7:-4]: (r.n, r.s) for r in df.groupBy("path").agg(F.count("*").alias("n"), F.sum("index").alias("s")).collect()}
    assert got == {f"{i:03d}": (n := 20 + i % 3, n * (n - 1) // 2) for i in range(200)}
    assert sorted(r.available for r in heads.collect()) == sorted(20 + i % 3 for i in range(200))
    assert blocks.agg(F.sum(F.length("content")), F.count_distinct("path")).first()[:] == (sum(64 + 32 * (20 + i % 3) for i in range(200)), 200)
    assert B.packed_ranges([B.Range("a", 1, 0, 100)] * 96, 150) == [B.Ranges([B.Range("a", 1, 0, 100)])] * 96  # large ranges stay apart
    assert B.packed_ranges([], 1) == []


def test_formats_and_encodings(spark, tmp_path):
    files = {"a.txt": "plain text é".encode(), "b.log": "한글 로그".encode("cp949"), "noext": "utf eight 日本".encode(), "c.txt": "sixteen".encode("utf-16"), "d.bin": bytes(range(256)) * 4, "e.pdf": b"%PDF-1.7 x", "f.pdf": b"not one", "g.png": b"\x89PNG....", "h.docx": b"PK\x03\x04", "copy.txt": "plain text é".encode(), "empty.txt": b""}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {r.name: r for r in S.read_files(spark, str(tmp_path)).collect()}
    assert {n: r.format for n, r in got.items()} == {"a.txt": "text", "b.log": "text", "noext": "text", "c.txt": "text", "d.bin": "binary", "e.pdf": "pdf", "f.pdf": "pdf", "g.png": "image", "h.docx": "word", "copy.txt": "text"}
    assert (got["b.log"].encoding, got["c.txt"].encoding, got["noext"].encoding) == ("cp949", "utf-16", "utf-8")
    assert got["f.pdf"].mismatch and not got["e.pdf"].mismatch and {got["a.txt"].duplicate_of, got["copy.txt"].duplicate_of} >= {None}
    df = spark.createDataFrame([(bytearray(files["b.log"]), "cp949")], "c binary, e string")
    assert df.select(S.decoded(F.col("c"), F.col("e")).alias("t")).first().t == "한글 로그"


def test_delimited(spark):
    rows = "\n".join(["a;b;c;d"] + [f"{i};x;0{i};z" for i in range(60)])
    assert S.delimiter_of(rows) == ";" and S.delimiter_of("a,b", "x.tsv") == "\t"
    got, more = S.delimited(rows)
    assert len(got) == 61 and not more and got[1][2] == "00" and S.delimited(rows, most=10) == (got[:10], True)
    df = spark.createDataFrame([(1, rows), (2, "a,b\nc\nd,e,f"), (3, "one"), (4, "\n".join([",".join("x" * 30)] * 3))], "k int, t string")
    got = {r.k: (r.columns, r.is_table, r.reason) for r in S.judged(S.cells_of(df, "k", "t"), "k").collect()}
    assert got == {1: (4, True, "table"), 2: (1, False, "one column"), 3: (1, False, "too few rows"), 4: (30, False, "too many columns")}


def test_rules(spark):
    row = dict(text_chars=10, image_area_ratio=0.9, tables=0, table_area_ratio=0.0, table_text_share=0.0, drawings=0)
    df = spark.createDataFrame([row])
    r = R.classified(df, half_even=True).first()
    assert (r.rule_id, r.label) == ("scanned", "scanned")
    e = df.select(R.evidence().alias("e")).first().e
    assert len(e) == 1 and e[0].matched and any(c.name == "max_text_chars" and c.threshold == 50 and c.actual == 10 for c in e[0].conditions)
    small = spark.createDataFrame([{**row, "text_chars": 300, "image_area_ratio": 0.0, "tables": 1, "table_area_ratio": 0.1, "table_text_share": 0.6}])
    assert R.classified(small).first().rule_id == "table_text_share"
    with pytest.raises(ValueError):
        R.classified(df.drop("tables"))
    assert R.validate(R.PAGE_RULES) == [] and len(R.validate([{"id": "x"}, {"id": "a", "label": "b", "when": {"x": 1, "min_a_ratio": 2}}])) == 3
    base = {"a": {"b": 1, "c": 2}, "d": [1]}
    change = {"a": {"b": 5}, "e": 1}
    wanted = R.merged(base, change)
    assert wanted == {"a": {"b": 5, "c": 2}, "d": [1], "e": 1} and R.difference(base, wanted) == change and R.changed_paths(change) == ["a.b", "e"]
    assert R.version(base) == R.version(json.loads(json.dumps(base))) != R.version(wanted)
    pages = spark.createDataFrame([(0.2, "table"), (0.1, "mixed"), (0.25, "table"), (0.05, "mixed")], "table_area_ratio double, truth string")
    rules, best = R.sweep(pages, [{"id": "t", "label": "table", "when": {"min_table_area_ratio": 0.3}}], "truth")
    assert best == 1.0 and 0.1 < rules[0]["when"]["min_table_area_ratio"] <= 0.2
