"""Content-addressed web archive.

An archive is a folder of two tables. ``records`` keeps each record's exact header block (WARC and HTTP headers) and
the SHA-256 of its payload; ``payloads`` keeps each payload's bytes once, under that digest. Joining them gives back
the original records, byte by byte; digests are checked on the way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import common as c

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: four letters for each five hex digits."""
    digits = F.sha1(payload)
    letters = []
    for g in range(8):
        v = F.conv(F.substring(digits, 1 + 5 * g, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(_BASE32), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def write(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Writes a record for each row.

    Of records with equal payloads of at least min_bytes bytes, that with the smallest id is a response, others
    revisit it; smaller ones are all responses. A null payload is empty. A null id comes after all others, and is
    written as none; several rows that share the smallest id (or have none) are responses all. A null URL leaves out
    the target; line breaks in one are escaped. Every payload is stored once. Other columns are ignored.
    """
    spark = pages.sparkSession
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string").cast("binary"), F.lit(b"")).alias("payload"))
    base = base.withColumn("address", F.sha2("payload", 256))
    small, scratch = c.stored(base.select("page_id", "url", "address", F.length("payload").cast("long").alias("size"), base32_sha1(F.col("payload")).alias("sha1")), "records")
    firsts = small.groupBy("address").agg(F.min("page_id").alias("first"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    name = lambda i: F.concat(F.lit("<urn:page:"), F.coalesce(i.cast("string"), F.lit("none")), F.lit(">"))
    joined = small.join(firsts, "address")
    revisit = (F.col("size") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", name(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", name(F.col("first"))))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (F.length(http) + F.when(revisit, 0).otherwise(F.col("size"))).cast("string")),
        F.lit("\r\n"),
        http,
    )
    joined.select(head.alias("head"), "address").write.parquet(f"{folder}/records")
    # Payloads move once: by address and id, so no key is hot, and rows that repeat come together.
    place = lambda i: F.concat_ws("/", "address", F.coalesce(F.col(i).cast("string"), F.lit("none"))).alias("place")
    kept = base.select(place("page_id"), "address", "payload").join(firsts.select(place("first")), "place", "left_semi")
    kept.dropDuplicates(["place"]).select("address", "payload").write.parquet(f"{folder}/payloads")
    c.delete(spark, scratch)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Each record's headers, parsed, and what its payload proves to be.

    page_id, record_type, refers_to, url, payload_bytes, payload_digest, verified (whether the stored payload has the
    address, length and digest that it should), head, address.
    """
    records = spark.read.schema("head string, address string").parquet(f"{folder}/records")
    payloads = spark.read.schema("address string, payload binary").parquet(f"{folder}/payloads")
    field = lambda name: F.regexp_extract("head", rf"\n{name}: ([^\r\n]*)\r\n", 1)
    number = lambda name: F.expr(f"try_cast(regexp_extract({name}, '([0-9-]+)>$', 1) as long)")
    parsed = records.select(
        "head",
        "address",
        field("WARC-Type").alias("record_type"),
        field("WARC-Record-ID").alias("record_id"),
        field("WARC-Refers-To").alias("refers"),
        F.nullif(field("WARC-Target-URI"), F.lit("")).alias("url"),
        F.regexp_extract("head", r"\nWARC-Payload-Digest: sha1:([^\r\n]*)\r\n", 1).alias("payload_digest"),
        F.regexp_extract("head", r"Content-Length: (\d+)\r\n\r\n$", 1).cast("long").alias("payload_bytes"),
    )
    proofs = payloads.select("address", (F.sha2("payload", 256) == F.col("address")).alias("sound"), base32_sha1(F.col("payload")).alias("sha1"), F.length("payload").cast("long").alias("size"))
    checked = parsed.join(proofs, "address", "left")
    verified = F.coalesce(F.col("sound") & (F.col("sha1") == F.col("payload_digest")) & (F.col("size") == F.col("payload_bytes")), F.lit(False))
    return checked.select(number("record_id").alias("page_id"), "record_type", number("refers").alias("refers_to"), "url", "payload_bytes", "payload_digest", verified.alias("verified"), "head", "address")


def originals(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, record, payload): the exact bytes of each record, and its full payload even where it revisits."""
    records = read(spark, folder)
    payloads = spark.read.schema("address string, payload binary").parquet(f"{folder}/payloads")
    head = F.col("head").cast("binary")
    end = F.lit(b"\r\n\r\n")
    return records.join(payloads, "address").select("page_id", F.when(F.col("record_type") == "response", F.concat(head, F.col("payload"), end)).otherwise(F.concat(head, end)).alias("record"), "payload")


ORACLE = """
with base as (select page_id, coalesce(html, '') as html from pages),
firsts as (select html, min(page_id) as first from base group by html),
joined as (select b.page_id, b.html, f.first from base b join firsts f using (html))
select page_id, strlen(html)::bigint as payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((('0x' || substr(sha1(html), (5 * (i // 4) + 1)::int, 5))::int >> (15 - 5 * (i % 4))::int) & 31), 1)), '') as payload_digest,
       case when page_id = first then 'response' else 'revisit' end as record_type,
       case when page_id <> first then first end as refers_to,
       true as verified
from joined
"""
