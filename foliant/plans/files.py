"""Tables as sheets and delimited texts; binary logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import elements as E
from foliant.plans.registry import query, table
from foliant.sources import files as S


@query(
    """with n as (select *, row_number() over (partition by p_brand order by p_partkey) - 2 as k from part),
    b as (select p_brand, (k // 24)::int as block, (k % 24 + 1)::int as line, p_name from n where k >= 0)
    select p_brand, block, line, p_name from b union all
    select distinct b.p_brand, b.block, 0, n.p_name from b join n on n.p_brand = b.p_brand and n.k = -1"""
)
def spreadsheet_blocks(spark, sf_dir):
    return S.blocks(table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_name"), "p_brand", "p_partkey")


@query(
    r"""with l as (select doc_id, len(string_split(unnest(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')), ' | ')) as w from documents),
    c as (select doc_id, w, count(*) as n from l group by 1, 2), m as (select doc_id, sum(n) as rows, arg_max(w, (n, -w)) as columns, max(n) as top from c group by 1)
    select doc_id, columns::int as columns, round(top / rows, 3) as share, (rows >= 2 and columns between 2 and 20 and top / rows >= 0.9) as is_table from m"""
)
def csv_judge(spark, sf_dir):
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(lines).alias("line")).select("doc_id", F.split("line", r" \| ").alias("cells"))
    return S.judged(rows, "doc_id").drop("reason")


@query(
    """with t as (select lang, doc_id as page, text, coalesce(sum(length(text)) over (partition by lang order by doc_id rows between unbounded preceding and 1 preceding), 0) as before from documents)
    select lang, md5(left(string_agg(text, '' order by page), 3000)) as digest from t where before < 3000 group by 1"""
)
def sample_text(spark, sf_dir):
    pages = table(spark, sf_dir, "documents").select("lang", F.col("doc_id").alias("page"), "text")
    return S.sample_text(pages, "lang", 3000).select("lang", F.md5(F.col("sample").cast("binary")).alias("digest"))


@query(
    """with c as (select s_suppkey // 10 as grid, s_suppkey % 10 as r, i as c, case when (s_suppkey + i) % 3 = 0 then '' else s_name || i end as v from supplier, range(0, 4) t(i)),
    f as (select grid, r, c, coalesce(nullif(v, ''), last_value(nullif(v, '') ignore nulls) over (partition by grid, r order by c), last_value(nullif(v, '') ignore nulls) over (partition by grid, c order by r), '') as v from c)
    select grid::bigint as grid, md5(string_agg(v, '|' order by r, c)) as digest, count(*) as cells from f group by 1"""
)
def table_markdown_fill(spark, sf_dir):
    cells = table(spark, sf_dir, "supplier").select(F.floor(F.col("s_suppkey") / 10).alias("grid"), (F.col("s_suppkey") % 10).alias("r"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("c"), "s_suppkey", "s_name")
    cells = cells.withColumn("v", F.when((F.col("s_suppkey") + F.col("c")) % 3 == 0, "").otherwise(F.concat("s_name", F.col("c").cast("string"))))
    filled = E.filled_cells(cells.select("grid", "r", "c", "v"))
    parts = filled.groupBy("grid").agg(F.array_sort(F.collect_list(F.struct("r", "c", "v"))).alias("x"))
    return parts.select("grid", F.md5(F.array_join(F.transform("x", lambda x: x["v"]), "|").cast("binary")).alias("digest"), F.size("x").cast("long").alias("cells"))


@query("select page_id, case when starts_with(html, '%PDF') then 'pdf' else 'text' end as format from pages where length(html) > 0 and html not like '%' || chr(0) || '%'")
def detect_formats(spark, sf_dir):
    files = table(spark, sf_dir, "pages").where("length(html) > 0").select("page_id", F.lit("page").alias("name"), F.col("html").cast("binary").alias("content"))
    return S.with_format(files).select("page_id", "format")


@query()
def delimited_cells(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where(F.contains("text", F.lit("|")))
    return S.cells_of(docs.select("doc_id", "text"), "doc_id", "text", 1 << 31)  # no limit: a text is in memory as it is


@query()
def attach_captions(spark, sf_dir):
    """Captions on pages made of conversation turns."""
    c = table(spark, sf_dir, "conversations")
    y = F.col("turn") * 30.0
    text = F.when(F.col("turn") % 3 == 1, F.concat(F.lit("Figure "), F.col("turn").cast("string"), F.lit(" shows"))).otherwise(F.left("text", F.lit(60)))
    rows = c.select(F.col("conv_id").cast("string").alias("run_id"), F.lit(0).alias("page"), F.col("turn").cast("int").alias("seq"), F.when(F.col("turn") % 3 == 0, "figure").otherwise("text").alias("type"), text.alias("content"), F.array(F.lit(0.0), y, F.lit(100.0), y + 20).alias("bbox"))
    return E.attach_captions(rows)
