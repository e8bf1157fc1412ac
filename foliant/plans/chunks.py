"""Chunking over documents; conversations as runs of elements."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import chunks as C
from foliant.plans.registry import query, table


def _tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.estimated_tokens(F.col("text")).alias("tokens"))


@query(
    "select bin::int as bin, count(*) as n from (select "
    + " + ".join(f"(t >= {e})::int" for e in C.EDGES)
    + " as bin from (select greatest(1, ceil(length(text) / 2.5::double)) as t from documents)) group by bin"
)
def token_histogram(spark, sf_dir):
    return _tokens(spark, sf_dir).groupBy(C.histogram_bin(F.col("tokens")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """select count(*) as n, min(t)::bigint as shortest, round(avg(t), 1) as mean, max(t)::bigint as longest, count(*) filter (t < 0.2 * 512) as short, count(*) filter (t > 1.5 * 512) as long,
    (count(*) filter (t < 0.2 * 512) + count(*) filter (t > 1.5 * 512)) / count(*) > 0.2 as warn from (select greatest(1, ceil(length(text) / 2.5::double)) as t from documents)"""
)
def chunk_stats(spark, sf_dir):
    return C.chunk_stats(_tokens(spark, sf_dir))


@query("select doc_id, text, total from (select doc_id, left(text, 50) as text, count(*) over () as total from documents where lang = 'en' and contains(lower(text), 'the ') and source = 'src1') order by doc_id limit 20 offset 2")
def chunk_browse_page(spark, sf_dir):
    from foliant.operators.reads import page_of

    chunks = table(spark, sf_dir, "documents").select("doc_id", "text", F.array("lang").alias("types"), F.array(F.lit(1)).alias("pages"), F.col("source").alias("section"))
    found = C.browse(chunks, page=1, kind="en", q="the ").where("section = 'src1'").select("doc_id", F.left("text", F.lit(50)).alias("text"))
    return page_of(found, [F.col("doc_id")], 2, 20)


def _elements(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "system", "title").otherwise("text")
    return c.select(F.concat(F.lit("conv"), F.col("conv_id").cast("string")).alias("run_id"), F.floor(F.col("turn") / 3).cast("int").alias("page"), F.col("turn").cast("int").alias("seq"), kind.alias("type"), F.col("text").alias("content"), F.lit(None).cast("array<double>").alias("bbox"))


@query(
    """with e as (select 'conv' || conv_id as run_id, (turn // 3)::int as page, turn, case when role = 'system' then '## ' || text else text end as line from conversations),
    l as (select *, lag(page) over (partition by run_id order by page, turn) as prev from e)
    select run_id, md5(string_agg(case when page is not distinct from prev then '' else '<!-- page ' || (page + 1) || ' -->' || chr(10) || chr(10) end || line, chr(10) || chr(10) order by page, turn)) as digest
    from l group by run_id"""
)
def parsed_markdown(spark, sf_dir):
    return C.as_markdown(_elements(spark, sf_dir)).select("run_id", F.md5(F.col("markdown").cast("binary")).alias("digest"))


@query()
def chunk_elements_recursive(spark, sf_dir):
    return C.chunk_elements(_elements(spark, sf_dir), "recursive", 100, 20, 40)


@query()
def chunk_elements_page(spark, sf_dir):
    return C.chunk_elements(_elements(spark, sf_dir), "page", 200, 0, 60)


@query()
def chunk_elements_section(spark, sf_dir):
    return C.chunk_elements(_elements(spark, sf_dir), "section", 200, 0, 0)


_MODES = ("recursive", "page", "section")


@query(
    """with recursive e as (select mode, user_id as u, event_id // 500 as page, event_id as seq, event_type = 'signup' as title, event_type || ' ' || event_id as text from events, (select unnest(['recursive', 'page', 'section']) as mode)),
    l as (select *, lag(page) over w as lp, max(case when title then seq end) over w as ts, lead(title) over w as nt, lead(seq) over w as ns from e window w as (partition by mode, u order by seq)),
    s as (select l.*, 'signup ' || ts as section, sum(case when lp is null or (mode = 'page' and lp <> page) or (mode = 'section' and title) then 1 else 0 end) over (partition by mode, u order by seq) as block from l),
    c as (select *, case when ns is null or (mode = 'section' and nt) then section else lead(section) over (partition by mode, u order by seq) end as closing, sum(length(text)) over (partition by mode, u, block order by seq) as total from s),
    b as (select mode, u, block, [0] || list(total::int order by seq) as p, list(text order by seq) as texts, list(closing order by seq) as closings, list(page order by seq) as pages from c group by mode, u, block),
    k as (select *, 0 as n, 0 as a, (len(list_filter(p, lambda x: x <= 80)) - 1)::int as z from b
      union all select * exclude (again), n + 1, again, (len(list_filter(p, lambda x: x <= p[again + 1] + 80)) - 1)::int
      from (select mode, u, block, p, texts, closings, pages, n, case when r = a or p[z + 1] - p[r + 1] + p[z + 2] - p[z + 1] > 80 then z else r end as again
            from (select *, greatest(a, len(list_filter(p, lambda x: x < p[z + 1] - 30)))::int as r from k where z < len(texts)))),
    t as (select mode, u, block, n, closings[z] as section, array_to_string(texts[a + 1:z], chr(10)) as body, list_sort(list_distinct(pages[a + 1:z])) as pages from k),
    d as (select *, case when section is null or starts_with(replace(body, chr(10), ' '), section) then body else section || chr(10) || body end as text from t)
    select mode, u, row_number() over (partition by mode, u order by block, n) - 1 as seq, md5(text) as digest, length(text) as tokens, array_to_string(pages, ',') as pages, section from d""".replace("select * exclude (again), n + 1, again,", "select mode, u, block, p, texts, closings, pages, n + 1, again,")
)
def chunk_packs(spark, sf_dir):
    """Users' events as lines and titles, chunked in each mode: 80 characters, of which up to 30 are repeated."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "signup", "title").otherwise("text")
    each = e.select(F.explode(F.array(*map(F.lit, _MODES))).alias("mode"), F.col("user_id").cast("string").alias("u"), F.floor(F.col("event_id") / 500).cast("int").alias("page"), F.col("event_id").alias("seq"), kind.alias("type"), F.concat_ws(" ", "event_type", "event_id").alias("content"), F.lit(None).cast("array<double>").alias("bbox"))
    made = C.chunk_elements(each.withColumn("run_id", F.concat_ws(" ", "mode", "u")), None, 80, 30, 0, 1.0)
    run = F.split("run_id", " ")
    return made.select(run[0].alias("mode"), run[1].cast("long").alias("u"), F.col("seq").cast("long").alias("seq"), F.md5(F.col("text").cast("binary")).alias("digest"), "tokens", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"), "section")


@query()
def document_chunks(spark, sf_dir):
    """Each document cut at its coarsest separators."""
    pieces = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(C.as_array(C.cut, F.col("text"), 1000)).alias("seq", "text"))
    return pieces


@query("select conv_id, turn, (row_number() over (partition by conv_id order by turn) - 1)::int as seq, case when role = 'system' then 'title' when role = 'user' then 'figure' else 'text' end as kind from conversations")
def chunk_kinds(spark, sf_dir):
    types = F.when(F.col("role") == "system", F.array(F.lit("title"))).when(F.col("role") == "user", F.array(F.lit("text"), F.lit("figure"), F.lit("table"))).otherwise(F.array(F.lit("title"), F.lit("text")))
    seq = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", seq.alias("seq"), C.chunk_kind(types).alias("kind"))


@query("select conv_id, turn, (turn % 4)::int as page, (turn % 4 + 1)::varchar as label, (turn % 4 + 1) || ',' || (turn % 4 + 3) as pages, length(text)::int as size from conversations")
def loader_rows(spark, sf_dir):
    p = (F.col("turn") % 4).cast("int")
    chunks = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("chunk_id"), F.lit(0).alias("seq"), F.lit("s").alias("section"), "text", F.array(p, p + 2).alias("pages"), F.array(F.lit("text")).alias("types"))
    m = C.loader_rows(chunks)
    ids = F.split("metadata.chunk_id", "-")
    return m.select(ids[0].cast("long").alias("conv_id"), ids[1].cast("long").alias("turn"), "metadata.page", F.col("metadata.page_label").alias("label"), "metadata.pages", F.length("page_content").alias("size"))
