"""Boxes, blocks and elements of pages: line items as boxes of the page that their order is."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.functions import geometry as G
from foliant.functions import text as T
from foliant.operators import elements as E
from foliant.plans.registry import query, table

WIDTH, HEIGHT = 80.0, 100.0
_BOXES = """b as (select l_orderkey as page, (l_linenumber * 10000000 + l_partkey) * 1000000 + l_suppkey as seq,
  case l_returnflag when 'R' then 'table' when 'A' then 'figure' else 'text' end as type, l_quantity::bigint as n,
  (l_suppkey % 50)::double as x0, (l_partkey % 70)::double as y0, l_suppkey % 50 + l_quantity + 0.25::double as x1, (l_partkey % 70 + 8 * l_linenumber)::double as y1 from lineitem)"""
_INSIDE = "t.page = b.page and t.type = 'table' and b.x0 >= t.x0 - 2 and b.y0 >= t.y0 - 2 and b.x1 <= t.x1 + 2 and b.y1 <= t.y1 + 2"
_SHARE = "greatest(0, least(b.x1, t.x1) - greatest(b.x0, t.x0)) * greatest(0, least(b.y1, t.y1) - greatest(b.y0, t.y0)) / ((b.x1 - b.x0) * (b.y1 - b.y0))"


def _boxes(spark, sf_dir):
    x, y = F.col("l_suppkey") % 50, F.col("l_partkey") % 70
    corners = (x, y, x + F.col("l_quantity") + 0.25, y + 8 * F.col("l_linenumber"))
    kind = F.when(F.col("l_returnflag") == "R", "table").when(F.col("l_returnflag") == "A", "figure").otherwise("text")
    seq = (F.col("l_linenumber") * F.lit(10_000_000).cast("long") + F.col("l_partkey")) * 1_000_000 + F.col("l_suppkey")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), seq.alias("seq"), kind.alias("type"), F.col("l_quantity").cast("long").alias("n"), F.array(*(v.cast("double") for v in corners)).alias("bbox"))


@query(
    f"""with {_BOXES}, p as (select *, lag(x0) over w as a0, lag(y0) over w as b0, lag(x1) over w as a1, lag(y1) over w as b1 from b window w as (partition by page order by seq))
    select page, seq, (x1 - x0) * (y1 - y0) as area, (least(x1, {WIDTH}) - least(x0, {WIDTH})) * (least(y1, {HEIGHT}) - least(y0, {HEIGHT})) as clipped, round_even(x1, 1) as rounded,
      x0 >= a0 - 2 and y0 >= b0 - 2 and x1 <= a1 + 2 and y1 <= b1 + 2 as inside,
      round(greatest(0, least(x1, a1) - greatest(x0, a0)) * greatest(0, least(y1, b1) - greatest(y0, b0)) / ((x1 - x0) * (y1 - y0)), 6) as covered,
      (greatest(x1, a1) - least(x0, a0)) * (greatest(y1, b1) - least(y0, b0)) as both_area
    from p where a0 is not null"""
)
def box_geometry(spark, sf_dir):
    """Each box of a page beside the one before it."""
    pairs = _boxes(spark, sf_dir).withColumn("o", F.lag("bbox").over(Window.partitionBy("page").orderBy("seq"))).where("o is not null")
    b, o = F.col("bbox"), F.col("o")
    clipped = G.area(G.clipped(b, F.lit(WIDTH), F.lit(HEIGHT)))
    return pairs.select("page", "seq", G.area(b).alias("area"), clipped.alias("clipped"), G.rounded(b)[2].alias("rounded"), G.contains(o, b).alias("inside"), F.round(G.covered_share(b, o), 6).alias("covered"), G.area(G.union(b, o)).alias("both_area"))


@query(f"with {_BOXES} select page, seq, row_number() over (partition by page order by y0, x0, seq) - 1 as place from b")
def reading_order(spark, sf_dir):
    return E.reading_order(_boxes(spark, sf_dir)).select("page", "seq", F.col("place").cast("long").alias("place"))


@query(f"with {_BOXES} select page, seq, row_number() over (partition by page order by type = 'figure' and (x1 - x0) * (y1 - y0) >= 0.9 * 2000, y0, x0, seq) - 1 as place from b")
def element_order(spark, sf_dir):
    return E.element_order(_boxes(spark, sf_dir), F.lit(2000.0)).select("page", "seq", F.col("place").cast("long").alias("place"))


@query(f"with {_BOXES} select page, seq from b where type = 'text' and not exists (select 1 from b as t where {_INSIDE})")
def texts_outside_tables(spark, sf_dir):
    b = _boxes(spark, sf_dir)
    return E.outside_tables(b.where("type = 'text'"), b.where("type = 'table'")).select("page", "seq")


@query(f"with {_BOXES} select page, round(sum(case when exists (select 1 from b as t where {_INSIDE}) then n else 0 end)::double / sum(n), 3) as share from b where type = 'text' group by page")
def share_in_tables(spark, sf_dir):
    b = _boxes(spark, sf_dir)
    return E.share_in_tables(b.where("type = 'text'"), b.where("type = 'table'"))


@query(f"with {_BOXES} select page, seq from b where type = 'figure' and not exists (select 1 from b as t where t.page = b.page and t.type = 'table' and {_SHARE} > 0.5)")
def drawings_beside_tables(spark, sf_dir):
    b = _boxes(spark, sf_dir)
    return E.without_covered(b.where("type = 'figure'"), b.where("type = 'table'")).select("page", "seq")


@query(
    f"""with {_BOXES}, c as (select *, (least(x1, {WIDTH}) - least(x0, {WIDTH})) * (least(y1, {HEIGHT}) - least(y0, {HEIGHT})) / ({WIDTH} * {HEIGHT})::double as a from b),
    f as (select page, sum(n) filter (type = 'text') as chars, sum(a) filter (type = 'text') as t, count(*) filter (type = 'figure') as images, sum(a) filter (type = 'figure') as i, count(*) filter (type = 'table') as tables, sum(a) filter (type = 'table') as ta from c group by page)
    select o_orderkey as page, coalesce(chars, 0)::bigint as text_chars, round(least(coalesce(t, 0), 1)::decimal(30, 12), 3)::double as text_area_ratio, coalesce(images, 0) as images, round(least(coalesce(i, 0), 1)::decimal(30, 12), 3)::double as image_area_ratio,
      0::bigint as drawings, coalesce(tables, 0) as tables, round(least(coalesce(ta, 0), 1)::decimal(30, 12), 3)::double as table_area_ratio from orders left join f on o_orderkey = page"""
)
def page_features(spark, sf_dir):
    """Every order is a page, those without line items too."""
    pages = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"), F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"))
    kind = F.when(F.col("type") == "figure", "image").otherwise(F.col("type"))
    return E.page_features(pages, _boxes(spark, sf_dir).select("page", kind.alias("kind"), "bbox", F.col("n").alias("chars")))


_SIZES = """h as (select l_orderkey as page, l_suppkey % 10 as doc, 8 + l_linenumber as size, sum(l_quantity::bigint)::bigint as n from lineitem group by all),
m as (select doc, size, sum(n)::bigint as n from h group by doc, size), s as (select doc, arg_max(size, (n, -size)) as body from m group by doc)"""


def _histograms(spark, sf_dir):
    """A page of a document (supplier) has the characters of each font size (line number)."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), (F.col("l_suppkey") % 10).alias("doc"), (8 + F.col("l_linenumber")).cast("string").alias("size"), F.col("l_quantity").cast("long").alias("n"))
    sizes = lines.groupBy("page", "doc", "size").agg(F.sum("n").alias("n"))
    return sizes.groupBy("page", "doc").agg(F.map_from_entries(F.collect_list(F.struct("size", "n"))).alias("sizes"))


@query(f"with {_SIZES} select doc, size::varchar as size, n, body::double as body from m join s using (doc)")
def font_sizes(spark, sf_dir):
    """Font sizes of a document's pages together, and its body size."""
    merged = E.merged_histogram(_histograms(spark, sf_dir), "doc", "sizes")
    body = merged.groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("size", "n"))).alias("all")).select("doc", E.body_size(F.col("all")).alias("body"))
    return merged.join(body, "doc").select("doc", "size", "n", "body")


@query(f"with {_SIZES}, p as (select doc, page, bool_or(size >= round(body * 1.15, 1)) as head from h join s using (doc) group by doc, page) select doc, count(*) as pages, count(*) filter (head) as heading_pages, round(count(*) filter (head) / count(*), 3) as ratio from p group by doc")
def heading_pages(spark, sf_dir):
    pages = _histograms(spark, sf_dir)
    body = font_sizes(spark, sf_dir).select("doc", "body").distinct()
    head = E.has_heading(F.col("sizes"), F.col("body"))
    made = pages.join(body, "doc").groupBy("doc").agg(F.count(F.lit(1)).alias("pages"), F.count_if(head).alias("heading_pages"))
    return made.withColumn("ratio", F.round(F.col("heading_pages") / F.col("pages"), 3))


@query("select conv_id as page, turn as seq, case when role <> 'system' and lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) in (select lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) from conversations where turn % 2 = 0) then 'title' when role = 'system' then 'table' else 'text' end as type from conversations")
def retyped_elements(spark, sf_dir):
    """Texts that are headings elsewhere, white space and case aside, become titles; tables stay."""
    c = table(spark, sf_dir, "conversations")
    elements = c.select(F.col("conv_id").alias("page"), F.col("turn").alias("seq"), F.when(F.col("role") == "system", "table").otherwise("text").alias("type"), F.concat(F.lit("  "), F.lower("text")).alias("content"))
    return E.retyped(elements, c.where("turn % 2 = 0").select(F.col("text").alias("title"))).select("page", "seq", "type")


@query(
    """with e as (select conv_id as page, turn as seq, text from conversations where role = 'user'), l as (select page, max(seq) as last from e group by page),
    n as (select conv_id as page, text, row_number() over (partition by conv_id order by encode(text)) as k from conversations where role = 'assistant')
    select page, seq::bigint as seq, 'text' as type, md5(text) as digest from e union all select page, coalesce(last, -1) + k, 'note', md5(text) from n left join l using (page)"""
)
def notes_appended(spark, sf_dir):
    """What users say are a page's elements, the answers its notes."""
    part = lambda role, kind: table(spark, sf_dir, "conversations").where(F.col("role") == role).select(F.col("conv_id").alias("page"), F.col("turn").cast("long").alias("seq"), F.lit(kind).alias("type"), F.col("text").alias("content"))
    return E.with_notes(part("user", "text"), part("assistant", "note")).select("page", "seq", "type", F.md5(F.col("content").cast("binary")).alias("digest"))


@query(
    """with a as (select vec_id as job, case when vec_id % 5 = 0 then '  ' else 'label ' || label end as c, vec_id % 7 = 0 as failed from embeddings where vec_id % 3 <> 0)
    select doc_id as job, case when c is null or failed or trim(c) = '' then source else c end as content, c is null or failed or trim(c) = '' as fell_back from documents left join a on doc_id = job"""
)
def model_answers(spark, sf_dir):
    """Jobs of which some have no answer, a failed one or an empty one."""
    jobs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("job"), F.lit(0).alias("page"), F.col("source").alias("fallback"))
    v = F.col("vec_id")
    answers = table(spark, sf_dir, "embeddings").where(v % 3 != 0).select(v.alias("job"), F.when(v % 5 == 0, "  ").otherwise(F.concat(F.lit("label "), F.col("label").cast("string"))).alias("content"), F.when(v % 7 == 0, "failed").alias("error"))
    return E.answered(jobs, answers).select("job", "content", "fell_back")


@query(
    r"""select conv_id, turn, case role when 'user' then 'chart' else 'diagram' end as kind, md5(regexp_replace(text, '^ +| +$', '', 'g')) as body, turn::bigint as a, role as b, role || '_' || turn as name,
    round(1 - (1 + len(regexp_extract_all(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]'))) / (length(text) + 2)::double, 6) as printable, (turn % 4 + 1)::int as columns from conversations where regexp_matches(text, '\S') and text = regexp_replace(text, '^\s+|\s+$', '', 'g')"""
)
def answer_texts(spark, sf_dir):
    """What is read from a model's answers: a figure's kind and description, an object, a file name, a table's width."""
    c = table(spark, sf_dir, "conversations").where(F.rlike("text", F.lit(r"\S")) & (F.col("text") == F.regexp_replace("text", r"^\s+|\s+$", "")))
    kind = F.when(F.col("role") == "user", "Chart").otherwise(F.col("role"))
    figure = T.figure_answer(F.concat(F.lit("```\nType: "), kind, F.lit(" of it\n"), F.col("text"), F.lit("\n```")))
    found = T.first_object(F.concat(F.lit('Well: {"a": '), F.col("turn"), F.lit(', "b": "'), F.col("role"), F.lit('"} so')), "a long, b string")
    upload = F.concat(F.regexp_replace(F.md5(F.col("text").cast("binary")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5_"), F.col("role"), F.lit("_"), F.col("turn"))
    rows = F.concat(F.repeat(F.lit("| x "), F.col("turn").cast("int") % 4 + 1), F.lit("|\n"), F.repeat(F.lit("| --- "), F.lit(9)), F.lit("|\na | b | c | d | e | f"))
    share = F.round(T.printable_share(F.concat("text", F.char(F.lit(1)), F.char(F.lit(9)))), 6)
    return c.select("conv_id", "turn", figure["kind"].alias("kind"), F.md5(figure["body"].cast("binary")).alias("body"), found["a"].alias("a"), found["b"].alias("b"), T.without_prefix(upload).alias("name"), share.alias("printable"), T.table_columns(rows).alias("columns"))


_EDGES = """e as (select l_orderkey // 256 as page, case when l_returnflag = 'R' then 'v' else 'h' end as orientation,
  case when l_returnflag = 'R' then (l_partkey % 150)::double else l_suppkey % 4 * 40 + l_linenumber % 2 * 0.5::double end as x0,
  case when l_returnflag = 'R' then (l_partkey % 150)::double else l_suppkey % 4 * 40 + l_linenumber % 2 * 0.5::double + case l_partkey % 7 when 0 then 12 when 1 then 90 else 70 end end as x1,
  (l_partkey * 13 % 8000 / 2)::double as top, l_partkey * 13 % 8000 / 2 + case when l_returnflag = 'R' then l_quantity::double else 0 end as bottom from lineitem)"""


@query(
    f"""with {_EDGES}, r as (select *, round_even(x0 / 2, 0) as k0, round_even(x1 / 2, 0) as k1 from e where orientation = 'h' and x1 - x0 >= 20),
    p as (select page, min(x0) over (partition by page, k0, k1) as x0, max(x1) over (partition by page, k0, k1) as x1, lag(top) over (partition by page, k0, k1 order by top) as top, top as bottom from r),
    k as (select * from p where bottom - top > 2 and bottom - top <= 400 and exists (select 1 from e v where v.orientation = 'v' and v.page = p.page and v.x0 > p.x0 + 2 and v.x0 < p.x1 - 2 and v.top < p.bottom - 1 and v.bottom > p.top + 1))
    select page, unnest([x0, x1]) as x, top, bottom from k"""
)
def table_side_edges(spark, sf_dir):
    """Line items as rules of a page: returned ones are vertical, the others horizontal with a few different ends."""
    part, upright = F.col("l_partkey"), F.col("l_returnflag") == "R"
    left = F.when(upright, part % 150).otherwise(F.col("l_suppkey") % 4 * 40 + F.col("l_linenumber") % 2 * 0.5)
    wide = F.when(part % 7 == 0, 12).when(part % 7 == 1, 90).otherwise(70)
    top = part * 13 % 8000 / 2
    edges = table(spark, sf_dir, "lineitem").select(
        F.floor(F.col("l_orderkey") / 256).alias("page"), F.when(upright, "v").otherwise("h").alias("orientation"), left.cast("double").alias("x0"), F.when(upright, left).otherwise(left + wide).cast("double").alias("x1"),
        top.cast("double").alias("top"), (top + F.when(upright, F.col("l_quantity").cast("double")).otherwise(0.0)).alias("bottom"),
    )
    return E.side_edges(edges)


@query(
    """with c as (select l_orderkey as grid, l_suppkey % 3 as r, l_linenumber as c, case when l_partkey % 3 = 0 then null when l_partkey % 3 = 1 then '  ' else l_returnflag end as v from lineitem),
    g as (select grid, count(distinct r) as rows, max(n) as columns, bool_or(t) as t from (select grid, r, count(*) as n, bool_or(trim(coalesce(v, '')) <> '') as t from c group by grid, r) group by grid)
    select grid, count(*) as cells, count(nullif(trim(v), '')) as filled from c join g using (grid) where rows >= 2 and columns >= 2 and t group by grid"""
)
def table_grids(spark, sf_dir):
    """Orders as grids: those with one row, one column or no text aren't tables."""
    part = F.col("l_partkey") % 3
    cells = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("grid"), (F.col("l_suppkey") % 3).alias("r"), F.col("l_linenumber").alias("c"), F.when(part == 1, "  ").when(part == 2, F.col("l_returnflag")).alias("v"))
    return E.real_grids(cells).groupBy("grid").agg(F.count(F.lit(1)).alias("cells"), F.count(F.nullif(F.trim("v"), F.lit(""))).alias("filled"))


#: A page of drawings: its size, and how many orders' line items it holds.
_SHEET, _ORDERS = (200.0, 280.0), 48
_PATHS = f"""d as (select row_number() over () as id, l_orderkey // {_ORDERS} as page, l_partkey * 7 % 203 + 0.25 as x0, l_suppkey * 31 % 283 + 0.5 as y0, l_partkey * 7 % 203 + 0.25 + l_quantity::double % 13 as x1,
  l_suppkey * 31 % 283 + 0.5 + l_linenumber * 2 as y1, l_partkey % 7 as mode from lineitem)"""
_CLUSTERS = f"""t as (select id, page, x0, y0, x1, y1, 0 as step, true as moved from d where x1 <= {_SHEET[0]} and y1 <= {_SHEET[1]}
  union all select a.id, a.page, min(b.x0), min(b.y0), max(b.x1), max(b.y1), any_value(a.step) + 1, min(b.x0) < any_value(a.x0) or min(b.y0) < any_value(a.y0) or max(b.x1) > any_value(a.x1) or max(b.y1) > any_value(a.y1)
    from t a join t b on a.page = b.page and b.x0 <= a.x1 + 3 and a.x0 <= b.x1 + 3 and b.y0 <= a.y1 + 3 and a.y0 <= b.y1 + 3 where (select bool_or(moved) from t) group by a.id, a.page),
c as (select page, x0, y0, x1, y1, count(*) as n from t where step = (select max(step) from t) group by page, x0, y0, x1, y1)"""


def _paths(spark, sf_dir):
    x, y = F.col("l_partkey") * 7 % 203 + 0.25, F.col("l_suppkey") * 31 % 283 + 0.5
    corners = (x, y, x + F.col("l_quantity").cast("double") % 13, y + F.col("l_linenumber") * 2)
    return table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / _ORDERS).alias("page"), (F.col("l_partkey") % 7).alias("mode"), F.array(*(c.cast("double") for c in corners)).alias("bbox"))


def _sheets(paths):
    return paths.select("page").distinct().select("page", F.lit(_SHEET[0]).alias("width"), F.lit(_SHEET[1]).alias("height"))


@query(f"with recursive {_PATHS}, {_CLUSTERS} select page, x0, y0, x1, y1, n from c where x1 - x0 > 3 and y1 - y0 > 3")
def drawing_clusters(spark, sf_dir):
    """Line items as paths of pages: what lies within 3 points becomes one box, again and again."""
    d = _paths(spark, sf_dir)
    return E.clusters(d, _sheets(d)).select("page", *(F.col("bbox")[i].alias(x) for i, x in enumerate(("x0", "y0", "x1", "y1"))), "n")


@query(f"with {_PATHS} select page, count(*) as paths, min(x0) as x0, max(y1) as y1 from d where x1 <= {_SHEET[0]} and y1 <= {_SHEET[1]} group by page")
def drawing_totals(spark, sf_dir):
    """Clusters lose no path: their sums by page, thin ones included."""
    d = _paths(spark, sf_dir)
    made = E.clusters(d, _sheets(d), thin=True)
    return made.groupBy("page").agg(F.sum("n").alias("paths"), F.min(F.col("bbox")[0]).alias("x0"), F.max(F.col("bbox")[3]).alias("y1"))


_AREA = "greatest(0, {b}[3] - {b}[1]) * greatest(0, {b}[4] - {b}[2])"
_CUT = f"[greatest(0.0, least(x0, {_SHEET[0]})), greatest(0.0, least(y0, {_SHEET[1]})), greatest(0.0, least(x1, {_SHEET[0]})), greatest(0.0, least(y1, {_SHEET[1]}))]"
_MET = "least(m.b[3], x.b[3]) > greatest(m.b[1], x.b[1]) and least(m.b[4], x.b[4]) > greatest(m.b[2], x.b[2])"
_JOINED = "{'b': [least(m.b[1], x.b[1]), least(m.b[2], x.b[2]), greatest(m.b[3], x.b[3]), greatest(m.b[4], x.b[4])], 's': case when contains(m.s, x.s) then m.s else m.s || '+' || x.s end}"


@query(
    f"""with recursive {_PATHS}, {_CLUSTERS},
    i as (select page, {_CUT} as b, 'image' as s from (select page, x0 - 4 as x0, y0 - 4 as y0, x1 + 9 as x1, y1 + 9 as y1 from d where mode = 0)),
    g as (select page, {_CUT} as b, 'drawing' as s from c where x1 - x0 > 3 and y1 - y0 > 3),
    w as (select page, [x0 - 2, y0 - 2, x1 + 30, y1 + 5] as w from d where mode = 1),
    f as (select * from i union all select * from g where not exists (select 1 from w where w.page = g.page and {_AREA.format(b='[greatest(b[1], w[1]), greatest(b[2], w[2]), least(b[3], w[3]), least(b[4], w[4])]')} > 0.5 * {_AREA.format(b='b')})),
    o as (select page, list({{'b': b, 's': s}} order by -({_AREA.format(b='b')}), s <> 'image', b) as x from f where {_AREA.format(b='b')} / {_SHEET[0] * _SHEET[1]} >= 0.004 group by page),
    r as (select page, x, 2 as k, [x[1]] as regions from o
      union all select page, list_of, k + 1, case when pos is null or pos = 0 then list_append(regions, x) else list_transform(regions, lambda m, i: case when i = pos then {_JOINED} else m end) end
      from (select page, r.x as list_of, r.x[k] as x, k, regions, list_position(list_transform(regions, lambda m: (least(m.b[3], r.x[k].b[3]) > greatest(m.b[1], r.x[k].b[1]) and least(m.b[4], r.x[k].b[4]) > greatest(m.b[2], r.x[k].b[2]))), true) as pos from r where k <= len(r.x))),
    z as (select page, unnest(regions[1:4]) as m from r where k = len(x) + 1)
    select page, round_even(m.b[1], 1) as x0, round_even(m.b[2], 1) as y0, round_even(m.b[3], 1) as x1, round_even(m.b[4], 1) as y1, m.s as source,
      round((round_even(m.b[3], 1) - round_even(m.b[1], 1)) * (round_even(m.b[4], 1) - round_even(m.b[2], 1)) / {_SHEET[0] * _SHEET[1]}, 3) as area_ratio from z"""
)
def figure_regions(spark, sf_dir):
    """Images and clusters of drawings that are figures; those under tables are rules, overlapping ones grow together."""
    d = _paths(spark, sf_dir)
    wider = lambda mode, *by: d.where(F.col("mode") == mode).select("page", F.array(*(F.col("bbox")[i] + by[i] for i in range(4))).alias("bbox"))
    made = E.figure_regions(wider(0, -4, -4, 9, 9), E.clusters(d, _sheets(d)), wider(1, -2, -2, 30, 5), _sheets(d), 0.004, 4)
    return made.select("page", *(F.col("bbox")[i].alias(x) for i, x in enumerate(("x0", "y0", "x1", "y1"))), "source", "area_ratio")


@query(
    """with l as (select l_orderkey as page, l_suppkey % 3 as block, (l_linenumber * 10000000 + l_partkey) * 1000000 + l_suppkey as n, 8 + l_partkey % 3 * 4 as size, l_linenumber * 20 + l_partkey % 9 as top, l_linenumber * 20 + l_partkey % 9 + 12 as bottom, (l_suppkey % 40)::double as x0, 'p' || l_partkey as text from lineitem),
    p as (select *, size >= 12 as head, lag(bottom) over w as pb, lag(size) over w as ps, lag(n) over w as pn from l window w as (partition by page, block order by n)),
    s as (select *, sum(case when pn is null or head <> (ps >= 12) or (head and abs(size - ps) > 0.5) or top - pb > 0.5 * size then 1 else 0 end) over (partition by page, block order by n) as part from p),
    g as (select page, block, part, any_value(head) as head, string_agg(text, chr(10) order by n) as content, min(x0) as x0, min(top)::double as y0, max(bottom)::double as y1 from s group by page, block, part)
    select page, row_number() over (partition by page order by block, part) - 1 as seq, case when head and length(content) <= 200 then 'title' else 'text' end as type, content, x0, y0, y1 from g"""
)
def text_elements(spark, sf_dir):
    """Line items as lines of text in blocks: runs of one kind without a gap become titles and texts."""
    top = F.col("l_linenumber") * 20 + F.col("l_partkey") % 9
    box = F.array(*(v.cast("double") for v in (F.col("l_suppkey") % 40, top, F.col("l_suppkey") % 40 + 30, top + 12)))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), (F.col("l_suppkey") % 3).alias("block"), ((F.col("l_linenumber") * F.lit(10_000_000).cast("long") + F.col("l_partkey")) * 1_000_000 + F.col("l_suppkey")).alias("n"), F.concat(F.lit("p"), F.col("l_partkey")).alias("text"), (8 + F.col("l_partkey") % 3 * 4).cast("double").alias("size"), box.alias("bbox"))
    made = E.from_lines(lines, 12.0)
    return made.select("page", F.col("seq").cast("long").alias("seq"), "type", "content", F.col("bbox")[0].alias("x0"), F.col("bbox")[1].alias("y0"), F.col("bbox")[3].alias("y1"))


@query(
    """with c as (select l_orderkey as chunk, list({'page': l_linenumber, 'x': (l_suppkey % 50)::double} order by l_linenumber, l_suppkey, l_partkey) filter (l_returnflag <> 'N') as boxes, min(l_linenumber) as first_page, l_orderkey % 4 as asked from lineitem group by l_orderkey),
    p as (select *, coalesce(case when asked > 0 then asked end, list_min(list_transform(boxes, lambda b: b.page)), first_page) as page from c)
    select chunk, page::int as page, len(list_filter(coalesce(boxes, []), lambda b: b.page = p.page))::int as boxes, page in (select l_linenumber from lineitem where l_orderkey = chunk) as found from p"""
)
def preview_regions(spark, sf_dir):
    """Which boxes of a chunk (an order) show on the page asked for; without one on its first page with a box."""
    from foliant.operators.chunks import preview_boxes

    box = F.when(F.col("l_returnflag") != "N", F.struct(F.col("l_linenumber").alias("page"), F.array((F.col("l_suppkey") % 50).cast("double")).alias("box")))
    chunks = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("chunk")).agg(F.collect_list(box).alias("boxes"), F.collect_set("l_linenumber").alias("pages"))
    asked = F.nullif((F.col("chunk") % 4).cast("int"), F.lit(0))
    r = chunks.select("chunk", preview_boxes(F.col("boxes"), F.col("pages"), asked).alias("r"))
    return r.select("chunk", "r.page", F.size("r.boxes").alias("boxes"), "r.found")
