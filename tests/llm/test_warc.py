import base64
import hashlib

from foliant.llm import common as c
from foliant.llm import warc


def brute(rows, least):
    first = {}
    for page, _, html in rows:
        b = (html or "").encode()
        if page is not None:
            first[b] = min(first.get(b, page), page)
    out = []
    for page, _, html in rows:
        b = (html or "").encode()
        again = len(b) >= least and b in first and page != first[b]
        out.append((page, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", first[b] if again else None))
    return sorted(out, key=repr)


ROWS = [(5, "http://a/\r\nWARC-Type: fake", "<p>é\r\n\r\n</p>"), (3, None, "<p>é\r\n\r\n</p>"), (9, "u", None), (8, "v", ""), (-1, "w", "x"), (2, "w", "x"), (None, "n", "x"), (4, "q", "alone"), (None, "q", "only"), (7, "t", "twice"), (7, "t", "twice")]


def parse(record):
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    assert lines[0] == "WARC/1.1" and record.endswith(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[:-4]
    assert int(fields["Content-Length"]) == len(block)
    return fields, block.partition(b"\r\n\r\n")[2]


def test_records_and_reading(spark):
    pages = spark.createDataFrame([(*r, "x", 1) for r in ROWS], "page_id long, url string, html string, address string, payload int")
    for least in (0, 1, 5):
        folder = c.scratch_path(spark, "warc")
        warc.write(pages, folder, least)
        got = warc.read(spark, folder).collect()
        assert all(r.verified for r in got)
        assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == brute(ROWS, least)
        stored = spark.read.parquet(f"{folder}/payloads")
        assert stored.count() == len({(r[2] or "") for r in ROWS})
        for r in warc.originals(spark, folder).collect():
            fields, payload = parse(bytes(r.record))
            digest = "sha1:" + base64.b32encode(hashlib.sha1(r.payload).digest()).decode()
            assert fields["WARC-Payload-Digest"] == digest
            assert payload == (bytes(r.payload) if fields["WARC-Type"] == "response" else b"")


def test_damage_and_empty_table(spark):
    pages = spark.createDataFrame([(1, "u", "good"), (2, "u", "bad")], "page_id long, url string, html string")
    folder = c.scratch_path(spark, "warc")
    warc.write(pages, folder)
    stored = spark.read.parquet(f"{folder}/payloads").selectExpr("address", "case when payload = cast('bad' as binary) then cast('BAD' as binary) else payload end payload").collect()
    spark.createDataFrame(stored, "address string, payload binary").write.mode("overwrite").parquet(f"{folder}/payloads")
    assert {r.page_id: r.verified for r in warc.read(spark, folder).collect()} == {1: True, 2: False}
    folder = c.scratch_path(spark, "warc")
    warc.write(pages.limit(0), folder)
    assert warc.read(spark, folder).count() == 0
