"""Typed elements of pages: from Markdown, from lines and boxes; captions, hints and merges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions import geometry as G
from foliant.functions import text as T

#: Fixed value: how captions of figures and tables begin, in English and Korean.
CAPTION = r"(?i)^\s*[\[\(<【]?\s*(fig(ure)?\.?|table|tab\.|그림|표|도)\s*[\dIVX]+"


def from_markdown(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, seq, type, content): titles, tables and paragraphs of Markdown texts.

    Lines are classed; a paragraph or table is a run of lines of its class without a blank between (gaps and islands).
    """
    lines = texts.select(key, F.posexplode(F.split(T.unfenced(F.col(text)), "\n")).alias("n", "line"))
    kind = F.when(F.trim("line") == "", None).when(F.rlike("line", F.lit(r"^#{1,6}\s")), "title").when(F.startswith(F.ltrim("line"), F.lit("|")), "table").otherwise("text")
    w = Window.partitionBy(key).orderBy("n")
    lines = lines.withColumn("type", kind)
    new = F.when(F.col("type").eqNullSafe(F.lag("type").over(w)) & (F.col("type") != "title"), 0).otherwise(1)
    lines = lines.withColumn("island", F.sum(new).over(w)).where("type is not null")
    grouped = lines.groupBy(key, "island").agg(F.first("type").alias("type"), F.array_sort(F.collect_list(F.struct("n", "line"))).alias("lines"))
    content = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    content = F.when(F.col("type") == "title", F.regexp_replace(content, r"^#{1,6}\s+|\s+$", "")).otherwise(F.trim(content))
    return grouped.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("island")) - 1).alias("seq"), "type", content.alias("content"))


def from_lines(lines: DataFrame, heading: float) -> DataFrame:
    """(page, seq, type, content, bbox) of text lines (page, block, n, text, size, bbox).

    Within a block, a new element begins where the heading flag flips, a heading's size changes by over half a point,
    or the gap to the line before is over half the size. A title is 200 characters at most.
    """
    w = Window.partitionBy("page", "block").orderBy("n")
    lines = lines.withColumn("head", F.col("size") >= heading)
    gap = F.col("bbox")[1] - F.lag(F.col("bbox")[3]).over(w)
    new = F.lag("n").over(w).isNull() | (F.col("head") != F.lag("head").over(w)) | (F.col("head") & (F.abs(F.col("size") - F.lag("size").over(w)) > 0.5)) | (gap > 0.5 * F.col("size"))
    lines = lines.withColumn("part", F.sum(F.when(new, 1).otherwise(0)).over(w))
    corner = lambda f, i: f(F.col("bbox")[i])
    made = lines.groupBy("page", "block", "part").agg(F.first("head").alias("head"), F.array_sort(F.collect_list(F.struct("n", "text"))).alias("t"), F.array(corner(F.min, 0), corner(F.min, 1), corner(F.max, 2), corner(F.max, 3)).alias("bbox"))
    content = F.array_join(F.transform("t", lambda x: x["text"]), "\n")
    kind = F.when(F.col("head") & (F.length(content) <= 200), "title").otherwise("text")
    seq = F.row_number().over(Window.partitionBy("page").orderBy("block", "part")) - 1
    return made.select("page", seq.alias("seq"), kind.alias("type"), content.alias("content"), "bbox")


def reading_order(blocks: DataFrame) -> DataFrame:
    """Numbers blocks of a page from the top, those of one height from the left."""
    w = Window.partitionBy("page").orderBy(F.bround(F.col("bbox")[1], 0), F.col("bbox")[0], "seq")
    return blocks.withColumn("place", F.row_number().over(w) - 1)


def element_order(elements: DataFrame, page_area: Column) -> DataFrame:
    """Numbers elements by height and side, but a figure of the whole page comes last."""
    whole = (F.col("type") == "figure") & (G.area(F.col("bbox")) >= 0.9 * page_area)
    w = Window.partitionBy("page").orderBy(whole, F.col("bbox")[1], F.col("bbox")[0], "seq")
    return elements.withColumn("place", F.row_number().over(w) - 1)


def outside_tables(texts: DataFrame, tables: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """Texts (page, bbox) that lie in no table of their page."""
    t = tables.select(F.col("page").alias("_page"), F.col("bbox").alias("_box"))
    return texts.join(t, (F.col("page") == F.col("_page")) & G.contains(F.col("_box"), F.col("bbox"), tolerance), "left_anti")


def without_covered(drawings: DataFrame, tables: DataFrame, share: float = 0.5) -> DataFrame:
    """Drawings of which no table of the page covers over a share."""
    t = tables.select(F.col("page").alias("_page"), F.col("bbox").alias("_box"))
    return drawings.join(t, (F.col("page") == F.col("_page")) & (G.covered_share(F.col("bbox"), F.col("_box")) > share), "left_anti")


def share_in_tables(characters: DataFrame, tables: DataFrame) -> DataFrame:
    """(page, share) of characters (page, bbox, n) that lie in any table."""
    t = tables.select(F.col("page").alias("_page"), F.col("bbox").alias("_box"))
    inside = characters.join(t, (F.col("page") == F.col("_page")) & G.contains(F.col("_box"), F.col("bbox")), "left_semi").groupBy("page").agg(F.sum("n").alias("inside"))
    return characters.groupBy("page").agg(F.sum("n").alias("n")).join(inside, "page", "left").select("page", F.round(F.coalesce(F.try_divide("inside", "n"), F.lit(0.0)), 3).alias("share"))


def page_features(pages: DataFrame, boxes: DataFrame) -> DataFrame:
    """Features of pages (page, width, height) from boxes (page, kind, bbox, chars): text, image, table and drawing.

    Areas are clipped to the page; their share of it is at most 1, to three digits.
    """
    area = F.col("width") * F.col("height")
    placed = boxes.join(pages, "page").withColumn("a", G.area(G.clipped(F.col("bbox"), F.col("width"), F.col("height"))))
    ratio = lambda kind: F.round(F.least(F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("a"))), F.lit(0.0)) / F.first(area), F.lit(1.0)), 3)
    count = lambda kind: F.count_if(F.col("kind") == kind)
    made = placed.groupBy("page").agg(
        F.coalesce(F.sum(F.when(F.col("kind") == "text", F.col("chars"))), F.lit(0)).alias("text_chars"),
        ratio("text").alias("text_area_ratio"), count("image").alias("images"), ratio("image").alias("image_area_ratio"),
        count("drawing").alias("drawings"), count("table").alias("tables"), ratio("table").alias("table_area_ratio"),
    )
    return pages.select("page").join(made, "page", "left").na.fill(0)


def body_size(histogram: Column) -> Column:
    """The font size with the most characters; the smaller of equals."""
    entries = F.map_entries(histogram)
    best = F.array_max(F.transform(entries, lambda e: F.struct(e["value"].alias("n"), (-e["key"].cast("double")).alias("size"))))
    return -best["size"]


def has_heading(histogram: Column, body: Column, ratio: float = 1.15) -> Column:
    return F.exists(F.map_keys(histogram), lambda k: k.cast("double") >= F.round(body * ratio, 1))


def merged_histogram(pages: DataFrame, by: str, column: str) -> DataFrame:
    return pages.select(by, F.explode(column).alias("size", "n")).groupBy(by, "size").agg(F.sum("n").alias("n"))


def retyped(elements: DataFrame, hints: DataFrame) -> DataFrame:
    """Elements whose text is a known heading become titles."""
    h = hints.select(T.collapsed(F.col("title")).alias("_t")).distinct()
    found = elements.withColumn("_t", T.collapsed(F.col("content"))).join(h.withColumn("_hit", F.lit(True)), "_t", "left")
    return found.withColumn("type", F.when(F.coalesce("_hit", F.lit(False)) & (F.col("type") == "text"), "title").otherwise(F.col("type"))).drop("_t", "_hit")


def with_notes(elements: DataFrame, notes: DataFrame) -> DataFrame:
    """Elements (page, seq, type, content) and, after them, what is noted for their page (page, type, content)."""
    last = elements.groupBy("page").agg(F.max("seq").alias("last"))
    w = Window.partitionBy("page").orderBy("content")
    more = notes.join(last, "page", "left").withColumn("seq", F.coalesce(F.col("last"), F.lit(-1)) + F.row_number().over(w))
    return elements.select("page", "seq", "type", "content").unionByName(more.select("page", "seq", "type", "content"))


def answered(jobs: DataFrame, answers: DataFrame) -> DataFrame:
    """Jobs (job, page, fallback) with a model's answer, the fallback where it failed or said nothing."""
    a = answers.select("job", F.col("content").alias("_c"), "error")
    fine = F.col("error").isNull() & (F.length(F.trim("_c")) > 0)
    return jobs.join(a, "job", "left").select("job", "page", F.when(fine, F.col("_c")).otherwise(F.col("fallback")).alias("content"), F.coalesce(~fine, F.lit(True)).alias("fell_back"))


def attach_captions(elements: DataFrame, pattern: str = CAPTION, most: float = 40.0) -> DataFrame:
    """Elements (run_id, page, seq, type, content, bbox) with ``caption``; texts that became captions go.

    Figures and tables take, in their order, the nearest caption-like text of the page that shares some width and is
    at most ``most`` away (2 of overlap allowed); a text is used once. Pages are folded one at a time.
    """
    import re

    form = re.compile(pattern.replace("(?i)", ""), re.IGNORECASE)
    schema = pa.schema([("run_id", pa.string()), ("page", pa.int32()), ("seq", pa.int32()), ("type", pa.string()), ("content", pa.string()), ("bbox", pa.list_(pa.float64())), ("caption", pa.string())])

    def gap(a, b):
        """Vertical distance if the boxes share some width, else None."""
        return None if min(a[2], b[2]) <= max(a[0], b[0]) else max(a[1] - b[3], b[1] - a[3])

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["seq"])
        free = [r for r in rows if r["type"] in ("text", "title") and form.match(r["content"] or "")]
        for r in rows:
            r["caption"] = None
            if r["type"] in ("figure", "table"):
                near = [(g, i) for i, t in enumerate(free) if (g := gap(r["bbox"], t["bbox"])) is not None and -2 <= g <= most]
                if near:
                    taken = free.pop(min(near)[1])
                    r["caption"] = taken["content"]
                    rows = [x for x in rows if x is not taken]
        return pa.Table.from_pylist(rows, schema)

    columns = ["run_id", "page", "seq", "type", "content", "bbox"]
    return elements.select(*columns).groupBy("run_id", "page").applyInArrow(run, "run_id string, page int, seq int, type string, content string, bbox array<double>, caption string")


def side_edges(edges: DataFrame, least: float = 20.0, most: float = 400.0) -> DataFrame:
    """(page, x, top, bottom): virtual borders for tables whose rules span the width but whose sides aren't drawn.

    edges: (page, orientation h or v, x0, x1, top, bottom). Horizontal rules of the same ends (halves of them, rounded)
    are taken from the top; two that follow each other 2 to ``most`` apart get a border at either end of their group if
    a vertical rule lies between them, away from the ends. Rules shorter than ``least`` don't count.
    """
    ends = [F.bround(F.col(x) / 2, 0) for x in ("x0", "x1")]
    rules = edges.where((F.col("orientation") == "h") & (F.col("x1") - F.col("x0") >= least)).select("page", "x0", "x1", "top", ends[0].alias("k0"), ends[1].alias("k1"))
    same = Window.partitionBy("page", "k0", "k1")
    pairs = rules.select("page", F.min("x0").over(same).alias("x0"), F.max("x1").over(same).alias("x1"), F.lag("top").over(same.orderBy("top")).alias("top"), F.col("top").alias("bottom"))
    gap = F.col("bottom") - F.col("top")
    v = edges.where("orientation = 'v'").select(F.col("page").alias("_page"), F.col("x0").alias("_x"), F.col("top").alias("_top"), F.col("bottom").alias("_bottom"))
    between = (F.col("_x") > F.col("x0") + 2) & (F.col("_x") < F.col("x1") - 2) & (F.col("_top") < F.col("bottom") - 1) & (F.col("_bottom") > F.col("top") + 1)
    held = pairs.where((gap > 2) & (gap <= most)).join(v, (F.col("page") == F.col("_page")) & between, "left_semi")
    return held.select("page", F.explode(F.array("x0", "x1")).alias("x"), "top", "bottom")


def real_grids(cells: DataFrame) -> DataFrame:
    """Cells (grid, r, c, v) of grids that are tables: two rows and columns at least, and some text."""
    of_rows = cells.groupBy("grid", "r").agg(F.count(F.lit(1)).alias("n"), F.max(F.length(F.trim(F.coalesce("v", F.lit(""))))).alias("most"))
    fine = of_rows.groupBy("grid").agg(F.count(F.lit(1)).alias("rows"), F.max("n").alias("columns"), F.max("most").alias("most")).where("rows >= 2 and columns >= 2 and most > 0")
    return cells.join(fine.select("grid"), "grid", "left_semi")


def _closed(boxes: list[tuple]) -> list[tuple]:
    """Boxes (x0, y0, x1, y1, n) joined, and what they join to, until none is within reach of another."""
    at, n, used = np.zeros((len(boxes), 4)), np.zeros(len(boxes), np.int64), 0
    for *box, count in boxes:
        box = np.array(box)
        while True:
            known = at[:used]
            near = (known[:, 0] <= box[2]) & (box[0] <= known[:, 2]) & (known[:, 1] <= box[3]) & (box[1] <= known[:, 3])
            if not near.any():
                break
            box = np.concatenate([np.minimum(known[near, :2].min(0), box[:2]), np.maximum(known[near, 2:].max(0), box[2:])])
            count += int(n[:used][near].sum())
            left = used - int(near.sum())
            at[:left], n[:left], used = known[~near], n[:used][~near], left
        at[used], n[used], used = box, count, used + 1
    return [(*map(float, b), int(c)) for b, c in zip(at[:used], n[:used])]


#: Boxes that are compared all with all; more are joined one by one.
TOGETHER = 512


def _joined(boxes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same of few boxes (rows x0, y0, x1, y1) and their counts: all that hang together are joined at once, in rounds."""
    while len(boxes) > 1:
        x0, y0, x1, y1 = boxes.T
        near = (x0[:, None] <= x1) & (x0 <= x1[:, None]) & (y0[:, None] <= y1) & (y0 <= y1[:, None])
        np.fill_diagonal(near, True)
        label = near.argmax(axis=1)
        while True:
            least = np.where(near, label, len(boxes)).min(axis=1)
            least = least[least]
            if (least == label).all():
                break
            label = least
        order = np.argsort(label, kind="stable")
        first = np.flatnonzero(np.diff(label[order], prepend=-1))
        if len(first) == len(boxes):
            break
        moved = boxes[order]
        boxes = np.concatenate([np.minimum.reduceat(moved[:, :2], first), np.maximum.reduceat(moved[:, 2:], first)], axis=1)
        n = np.add.reduceat(n[order], first)
    return boxes, n


def _runs(batches, key: str):
    """Tables of whole runs of equal keys, from batches that come sorted by the key; the last run waits for its end."""
    rest, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy()
        if rest and keys[0] != last:
            yield pa.Table.from_batches(rest)
            rest = []
        last, cut = keys[-1], int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield pa.Table.from_batches([*rest, batch.slice(0, cut)])
            rest = []
        rest.append(batch.slice(cut))
    if rest:
        yield pa.Table.from_batches(rest)


#: Rows that come to a task, about, where the settings' number of partitions would give it more.
SHARE = 1 << 18


def _parts(spark: SparkSession, rows: int) -> int | None:
    """How many partitions so many rows need beyond the settings' number; None where that will do."""
    n = -(-rows // SHARE)
    return n if n > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def _dealt(df: DataFrame, by: str, n: int | None) -> DataFrame:
    return df.repartition(n, by) if n else df


#: Height of the strips that pages of more than BUSY drawings are cut into, to be joined apart first.
STRIP, BUSY = 64.0, 4096


def clusters(drawings: DataFrame, pages: DataFrame, tolerance: float = 3.0, thin: bool = False) -> DataFrame:
    """(page, bbox, n): drawings (page, bbox) within ``tolerance`` of each other, or of what others have become together.

    Two boxes that are near become the box around both, which may reach more; what remains doesn't depend on the order.
    Only drawings inside their page (page, width, height) count, and clusters no wider or no taller than the tolerance
    (rules, underlines) go unless ``thin``. Strips of a page of very many paths are joined first, so its last step has
    clusters only. The drawings are counted first, as the number of partitions follows from it.
    """
    names = ("x0", "y0", "x1", "y1")
    parts = _parts(drawings.sparkSession, drawings.count())
    boxes = _dealt(drawings, "page", parts).join(_dealt(pages, "page", parts), "page").select("page", "width", "height", *(F.col("bbox")[i].alias(x) for i, x in enumerate(names)))
    inside = boxes.where("x0 >= 0 and y0 >= 0 and x1 <= width and y1 <= height")
    reach = tolerance / 2  # on either side of each box
    grown = inside.select(F.col("page").cast("long").alias("page"), *((F.col(x) + (reach if x[1] == "1" else -reach)).alias(x) for x in names), F.lit(1).cast("long").alias("n"))
    out = "page long, x0 double, y0 double, x1 double, y1 double, n long"

    def joined(boxes: np.ndarray, n: np.ndarray):
        if len(boxes) <= TOGETHER:
            return _joined(boxes, n)
        order = np.lexsort((boxes[:, 0], boxes[:, 3]))
        done = _closed([(*b, c) for b, c in zip(boxes[order].tolist(), n[order].tolist())])
        return np.array([d[:4] for d in done]), np.array([d[4] for d in done], np.int64)

    def run(table: pa.Table) -> pa.Table:
        page, boxes, n = table.column("page").to_numpy(), np.stack([table.column(x).to_numpy() for x in names], axis=1), table.column("n").to_numpy()
        starts = np.flatnonzero(np.diff(page, prepend=page[0] - 1))
        made = [(page[a], *joined(boxes[a:b], n[a:b])) for a, b in zip(starts, [*starts[1:], len(page)])]
        boxes, n = np.concatenate([b for _, b, _ in made]), np.concatenate([c for *_, c in made])
        pages = np.repeat([p for p, *_ in made], [len(c) for *_, c in made])
        return pa.Table.from_arrays([pa.array(pages, pa.int64()), *(pa.array(boxes[:, i]) for i in range(4)), pa.array(n, pa.int64())], ["page", *names, "n"])

    def pages_run(batches):
        for table in _runs(batches, "page"):
            yield from run(table).to_batches()

    busy = F.broadcast(grown.groupBy("page").agg(F.count(F.lit(1)).alias("_paths")).where(F.col("_paths") > BUSY).select("page"))  # a BUSY-th of the paths at most
    some = grown.join(busy, "page", "left_semi").withColumn("strip", F.floor(F.col("y0") / STRIP))
    part = some.groupBy("page", "strip").applyInArrow(run, out).unionByName(grown.join(busy, "page", "left_anti"))
    dealt = part.repartition(parts, "page") if parts else part.repartition("page")
    whole = dealt.sortWithinPartitions("page").mapInArrow(pages_run, out)
    made = whole.select("page", *(F.round(F.col(x) - (reach if x[1] == "1" else -reach), 9).alias(x) for x in names), "n")
    kept = made if thin else made.where((F.col("x1") - F.col("x0") > tolerance) & (F.col("y1") - F.col("y0") > tolerance))
    return kept.select("page", F.array(*names).alias("bbox"), "n")


def figure_regions(images: DataFrame, drawn: DataFrame, tables: DataFrame, pages: DataFrame, least: float, most: int) -> DataFrame:
    """(page, bbox, source, area_ratio) of figures: images and clusters of drawings (page, bbox), large enough ones.

    Boxes are clipped to their page (page, width, height) and take ``least`` of its area; clusters that a table (page,
    bbox) covers by over half are its rules. From the largest on, a box joins the first region that it overlaps at all,
    which grows to hold it; otherwise it begins one. The first ``most`` regions stay, boxes rounded to 0.1. Equal areas:
    images first, then by their corners.
    """
    parts = _parts(images.sparkSession, images.count() + tables.count())

    def clipped(boxes: DataFrame, source: str) -> DataFrame:
        placed = _dealt(boxes.select("page", "bbox"), "page", parts).join(_dealt(pages, "page", parts), "page")
        cut = G.clipped(F.col("bbox"), F.col("width"), F.col("height"))
        whole = F.col("width") * F.col("height")
        return placed.select("page", cut.alias("bbox"), F.lit(source).alias("source"), F.when(whole > 0, whole).otherwise(1.0).alias("whole")).where(G.area(F.col("bbox")) / F.col("whole") >= least)

    both = clipped(images, "image").unionByName(without_covered(clipped(drawn, "drawing"), _dealt(tables, "page", parts)))
    order = F.struct((-G.area(F.col("bbox"))).alias("a"), (F.col("source") != "image").alias("s"), "bbox", "source")
    each = _dealt(both, "page", parts).groupBy("page").agg(F.first("whole").alias("whole"), F.array_sort(F.collect_list(order)).alias("found"))
    none = F.array().cast("array<struct<bbox:array<double>,source:string>>")

    def taken(regions: Column, x: Column) -> Column:
        at = F.array_position(F.transform(regions, lambda m: (F.least(m["bbox"][2], x["bbox"][2]) > F.greatest(m["bbox"][0], x["bbox"][0])) & (F.least(m["bbox"][3], x["bbox"][3]) > F.greatest(m["bbox"][1], x["bbox"][1]))), True)
        source = lambda m: F.when(F.contains(m["source"], x["source"]), m["source"]).otherwise(F.concat(m["source"], F.lit("+"), x["source"]))
        grown = F.transform(regions, lambda m, i: F.when(i + 1 == at, F.struct(G.union(m["bbox"], x["bbox"]).alias("bbox"), source(m).alias("source"))).otherwise(m))
        return F.when(at > 0, grown).otherwise(F.array_append(regions, F.struct(x["bbox"].alias("bbox"), x["source"].alias("source"))))

    regions = each.select("page", "whole", F.explode(F.slice(F.aggregate("found", none, taken), 1, most)).alias("r"))
    box = G.rounded(F.col("r.bbox"))
    return regions.select("page", box.alias("bbox"), "r.source", F.round(G.area(box) / F.col("whole"), 3).alias("area_ratio"))


def filled_cells(cells: DataFrame) -> DataFrame:
    """Cells (grid, r, c, v) with merged ones filled: from the left, else from above; line breaks and bars escaped."""
    left = Window.partitionBy("grid", "r").orderBy("c")
    above = Window.partitionBy("grid", "c").orderBy("r")
    v = F.nullif(F.trim("v"), F.lit(""))
    filled = F.coalesce(v, F.last(v, ignorenulls=True).over(left), F.last(v, ignorenulls=True).over(above), F.lit(""))
    return cells.withColumn("v", F.replace(F.replace(filled, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>")))


def grid_markdown(cells: DataFrame) -> DataFrame:
    """(grid, markdown, empty): each grid as a Markdown table, and its share of empty cells."""
    empty = cells.groupBy("grid").agg(F.avg(F.coalesce(F.trim("v") == "", F.lit(True)).cast("int")).alias("empty"))
    rows = filled_cells(cells).groupBy("grid", "r").agg(F.array_sort(F.collect_list(F.struct("c", "v"))).alias("cells"))
    rows = rows.select("grid", "r", F.transform("cells", lambda x: x["v"]).alias("cells"))
    grids = rows.groupBy("grid").agg(F.array_sort(F.collect_list(F.struct("r", "cells"))).alias("rows"))
    return grids.select("grid", T.markdown_table(F.transform("rows", lambda x: x["cells"])).alias("markdown")).join(empty, "grid")
