"""Files as rows: format detection, text decoding, delimited tables, spreadsheet blocks."""

from __future__ import annotations

import csv
import io
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Formats by the first bytes, by extension and by media type.
MAGIC = (("25504446", "pdf"), ("89504E47", "image"), ("FFD8FF", "image"), ("47494638", "image"), ("49492A00", "image"), ("4D4D002A", "image"), ("424D", "image"))
EXTENSIONS = {"pdf": "pdf", "png": "image", "jpg": "image", "jpeg": "image", "gif": "image", "tif": "image", "tiff": "image", "bmp": "image", "webp": "image", "docx": "word", "doc": "word", "pptx": "slides", "ppt": "slides", "xlsx": "sheet", "xls": "sheet"}
MEDIA = {"application/pdf": "pdf", "image/png": "png", "image/jpeg": "jpg", "text/plain": "txt", "text/csv": "csv", "application/json": "json"}
MARKS = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))
SNIFF_BYTES = 1 << 16


def encoding_of(data: bytes) -> str | None:
    """utf-8, utf-16 by its mark, or cp949; None for what is no text: zero bytes, or under 95 % printable."""
    head = data[:SNIFF_BYTES]
    for mark, name in MARKS:
        if head.startswith(mark):
            return name
    if b"\0" in head or not head:
        return None if head else "utf-8"
    for name in ("utf-8", "cp949"):
        for back in range(4):  # a character may be cut at the end
            try:
                text = head[: len(head) - back].decode(name)
            except UnicodeDecodeError:
                if len(data) <= SNIFF_BYTES:
                    break
                continue
            fine = sum(c in "\t\n\r\f" or unicodedata.category(c)[0] != "C" for c in text)
            return name if fine >= 0.95 * len(text) else None
    return None


def sniffed(content: Column) -> Column:
    """encoding_of as a Column, a batch of files at a time."""

    @F.pandas_udf("string")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda b: None if b is None else encoding_of(bytes(b)))

    return run(content)


def decoded(content: Column, encoding: Column) -> Column:
    """Bytes as text, what can't be decoded replaced; null where either is."""

    @F.pandas_udf("string")
    def run(batch: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([None if b is None or e is None else bytes(b).decode(e, "replace") for b, e in zip(batch, names)])

    return run(content, encoding)


def read_files(spark: SparkSession, path: str, most_bytes: int = 1 << 28) -> DataFrame:
    """(name, size, sha256, content, format, encoding, mismatch, duplicate_of) of files; empty and too large ones go.

    duplicate_of: the first file, by time and name, with the same content.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(f"length between 1 and {most_bytes}")
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), "content", "modificationTime")
    files = with_format(files)
    first = F.first("name").over(Window.partitionBy("sha256").orderBy("modificationTime", "name"))
    return files.withColumn("duplicate_of", F.when(first != F.col("name"), first)).drop("modificationTime")


def with_format(files: DataFrame) -> DataFrame:
    """Files (name, content) with format, encoding and whether extension and content disagree.

    First bytes and extension decide, in the order pdf, image, office, then text by sniffing, else binary.
    """
    extension = F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))
    head = F.hex(F.substring("content", 1, 4))
    by_magic = F.coalesce(*(F.when(F.startswith(head, F.lit(m)), k) for m, k in MAGIC))
    by_name = F.element_at(F.create_map(*(F.lit(x) for kv in EXTENSIONS.items() for x in kv)), extension)
    files = files.withColumn("_named", by_name).withColumn("_magic", by_magic).withColumn("encoding", sniffed(F.col("content")))
    kind = F.coalesce(F.when((F.col("_magic") == "pdf") | (F.col("_named") == "pdf"), "pdf"), F.col("_magic"), F.col("_named"), F.when(F.col("encoding").isNotNull(), "text"), F.lit("binary"))
    mismatch = F.coalesce(F.col("_named") != F.coalesce("_magic", "_named"), F.lit(False)) | ((F.col("_named") == "pdf") & F.col("_magic").isNull())
    return files.withColumn("format", kind).withColumn("mismatch", F.coalesce(mismatch, F.lit(False))).drop("_named", "_magic")


def name_for(header: Column, media: Column) -> Column:
    """A file's name from a request: the header's (URL-encoded), else ``upload`` with the media type's extension."""
    plain = F.trim(F.split(F.lower(F.coalesce(media, F.lit(""))), ";")[0])
    known = F.element_at(F.create_map(*(F.lit(x) for kv in MEDIA.items() for x in kv)), plain)
    return F.coalesce(F.nullif(F.url_decode(header), F.lit("")), F.concat(F.lit("upload."), F.coalesce(known, F.lit("bin"))))


def delimiter_of(sample: str, name: str = "") -> str:
    """Tab for .tsv; else the one of comma, semicolon, tab and bar that splits the lines most alike; comma if none."""
    if name.lower().endswith(".tsv"):
        return "\t"
    lines = [x for x in sample[:20000].split("\n") if x.strip()][:50]
    counts = {d: [x.count(d) for x in lines] for d in ",;\t|"}
    even = {d: sum(n == max(set(c), key=c.count) for n in c) / len(c) for d, c in counts.items() if lines and max(set(c), key=c.count) > 0}
    return max(even, key=lambda d: (even[d], counts[d][0])) if even else ","


def delimited(text: str, name: str = "", most: int = 100_000) -> tuple[list[list[str]], bool]:
    """(rows of cells, whether there were more) of a delimited text; cells stay text, blank rows go."""
    rows = []
    for row in csv.reader(io.StringIO(text), delimiter=delimiter_of(text, name)):
        if any(x.strip() for x in row):
            rows.append(row)
            if len(rows) > most:
                return rows[:-1], True
    return rows, False


def cells_of(texts: DataFrame, key: str, text: str, most: int = 100_000) -> DataFrame:
    """(key, r, cells, truncated) of delimited texts, one row for each of theirs."""

    @F.pandas_udf("struct<rows:array<array<string>>,truncated:boolean>")
    def run(batch: pd.Series, names: pd.Series) -> pd.DataFrame:
        got = [delimited(t or "", n or "", most) for t, n in zip(batch, names)]
        return pd.DataFrame({"rows": [r for r, _ in got], "truncated": [t for _, t in got]})

    name = F.col("name") if "name" in texts.columns else F.lit("")
    made = texts.select(key, run(F.col(text), name).alias("g"))
    return made.select(key, F.posexplode("g.rows").alias("r", "cells"), "g.truncated")


def judged(rows: DataFrame, key: str, most_columns: int = 20) -> DataFrame:
    """(key, columns, share, is_table, reason): whether rows of cells are a table.

    The most common number of cells (the smaller of equals) must hold for 90 % of two rows or more, within 2..most.
    """
    counts = rows.groupBy(key, F.size("cells").alias("width")).agg(F.count(F.lit(1)).alias("n"))
    each = counts.groupBy(key).agg(F.sum("n").alias("rows"), F.max(F.struct("n", (-F.col("width")).alias("w"))).alias("top"))
    each = each.select(key, "rows", (-F.col("top.w")).alias("columns"), (F.col("top.n") / F.col("rows")).alias("share"))
    reason = F.when(F.col("rows") < 2, "too few rows").when(F.col("columns") < 2, "one column").when(F.col("columns") > most_columns, "too many columns").when(F.col("share") < 0.9, "ragged rows").otherwise("table")
    return each.select(key, "columns", F.round("share", 3).alias("share"), (reason == "table").alias("is_table"), reason.alias("reason"))


def padded(cells: Column, width: Column) -> Column:
    return F.concat(cells, F.array_repeat(F.lit(""), F.greatest(width - F.size(cells), F.lit(0))))


def sheet_name(name: Column) -> Column:
    """A name for a sheet: none of the characters that are not allowed, 31 at most."""
    return F.left(F.coalesce(F.nullif(F.trim(F.regexp_replace(name, r"[\[\]:*?/\\]", " ")), F.lit("")), F.lit("Sheet1")), F.lit(31))


def blocks(rows: DataFrame, sheet: str, order: str, per_block: int = 24) -> DataFrame:
    """Rows of sheets with their block, and the header again as row 0 of each block; the first row is the header."""
    w = Window.partitionBy(sheet).orderBy(order)
    numbered = rows.withColumn("_n", F.row_number().over(w) - 2)
    header = numbered.where("_n = -1").drop("_n", order)
    body = numbered.where("_n >= 0").withColumn("block", F.floor(F.col("_n") / per_block).cast("int")).withColumn("line", (F.col("_n") % per_block + 1).cast("int"))
    heads = body.select(sheet, "block").distinct().join(header, sheet).withColumn("line", F.lit(0))
    columns = [sheet, "block", "line", *(x for x in rows.columns if x not in (sheet, order))]
    return body.select(*columns).unionByName(heads.select(*columns))


#: Shares of the pages whose lengths are added up apart.
SHARES = 256


def sample_text(pages: DataFrame, by: str, limit: int) -> DataFrame:
    """(by, sample): the texts of the first pages, joined, up to a number of characters.

    Lengths alone are added up: in shares of the pages first, where a page that begins past the limit among some of the
    pages does so among all. Texts are only those of the pages that are used.
    """
    lengths = pages.select(by, "page", F.coalesce(F.length("text"), F.lit(0)).alias("_n"), F.pmod(F.xxhash64("page"), F.lit(SHARES)).alias("_share"))

    def early(df: DataFrame, *keys: str) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).where(F.col("_before") < limit).drop("_before")

    used = early(early(lengths.where("_n > 0"), by, "_share"), by).select(F.col(by).alias("_by"), F.col("page").alias("_page")).distinct()
    here = F.col(by).eqNullSafe(F.col("_by")) & (F.col("page") == F.col("_page"))
    texts = pages.where(F.length("text") > 0).join(F.broadcast(used), here, "left_semi")  # at most limit pages of each
    parts = texts.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("page", F.left("text", F.lit(limit)).alias("text")))).alias("p"))
    sample = F.left(F.array_join(F.transform("p", lambda x: x["text"]), ""), F.lit(limit))
    each = pages.select(F.col(by).alias("_by")).distinct()
    return each.join(parts, F.col("_by").eqNullSafe(F.col(by)), "left").select(F.col("_by").alias(by), F.coalesce(sample, F.lit("")).alias("sample"))
