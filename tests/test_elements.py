from datetime import datetime, timezone

import numpy as np
from pyspark.sql import functions as F

from foliant.functions import geometry as G
from foliant.functions import text as T
from foliant.operators import elements as E
from foliant.operators import evaluation as X
from foliant.sources.records import iso_times


def one(spark, *columns):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()


def box(*v):
    return F.array(*(F.lit(float(x)) for x in v))


def test_geometry(spark):
    r = one(spark, G.area(box(0, 0, 2, 3)), G.area(box(2, 0, 0, 3)), G.clipped(box(-1, -1, 50, 5), F.lit(10.0), F.lit(10.0)), G.rounded(box(0.25, 0.35, 1, 1)), G.contains(box(0, 0, 10, 10), box(-1, 0, 11, 10)), G.contains(box(0, 0, 10, 10), box(-3, 0, 10, 10)), G.covered_share(box(0, 0, 10, 10), box(5, 0, 15, 10)), G.covered_share(box(0, 0, 0, 10), box(5, 0, 15, 10)))
    assert list(r)[:2] == [6.0, 0.0] and r.c2 == [0.0, 0.0, 10.0, 5.0] and r.c4 and not r.c5 and r.c6 == 0.5 and r.c7 == 0.0


def test_captions(spark):
    rows = [("r", 0, 0, "text", "before", [0, 0, 100, 20]), ("r", 0, 1, "figure", "", [0, 30, 100, 90]), ("r", 0, 2, "text", "Figure 1: near", [0, 95, 100, 105]), ("r", 0, 3, "text", "Figure 2: far", [0, 300, 100, 320]), ("r", 1, 0, "text", "[Fig. 3] over", [0, 0, 50, 10]), ("r", 1, 1, "figure", "", [0, 12, 50, 60]), ("r", 1, 2, "text", "[note] no caption", [0, 61, 50, 70])]
    df = spark.createDataFrame([(*r[:5], [float(x) for x in r[5]]) for r in rows], "run_id string, page int, seq int, type string, content string, bbox array<double>")
    got = {(r.page, r.seq): r.caption for r in E.attach_captions(df).collect()}
    assert got == {(0, 0): None, (0, 1): "Figure 1: near", (0, 3): None, (1, 1): "[Fig. 3] over", (1, 2): None}


def test_markdown_elements(spark):
    text = "# Title\n\nfirst line\nsecond line\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n## Other\nmore"
    got = E.from_markdown(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t").orderBy("seq").collect()
    assert [(r.type, r.content) for r in got] == [("title", "Title"), ("text", "first line\nsecond line"), ("table", "| a | b |\n| --- | --- |\n| 1 | 2 |"), ("title", "Other"), ("text", "more")]


def test_lines_to_elements(spark):
    rows = [(0, 0, 0, "Head", 20.0, [0, 0, 9, 20]), (0, 0, 1, "body a", 10.0, [0, 21, 9, 31]), (0, 0, 2, "body b", 10.0, [0, 32, 9, 42]), (0, 0, 3, "apart", 10.0, [0, 60, 9, 70])]
    df = spark.createDataFrame([(*r[:5], [float(x) for x in r[5]]) for r in rows], "page int, block int, n int, text string, size double, bbox array<double>")
    got = E.from_lines(df, 15.0).orderBy("seq").collect()
    assert [(r.type, r.content) for r in got] == [("title", "Head"), ("text", "body a\nbody b"), ("text", "apart")] and got[1].bbox == [0.0, 21.0, 9.0, 42.0]


def test_spatial_joins_and_features(spark):
    t = spark.createDataFrame([(0, [0.0, 0.0, 50.0, 50.0])], "page int, bbox array<double>")
    x = spark.createDataFrame([(0, [1.0, 1.0, 51.0, 9.0], 30), (0, [60.0, 0.0, 90.0, 9.0], 10), (1, [1.0, 1.0, 2.0, 2.0], 5)], "page int, bbox array<double>, n int")
    assert E.outside_tables(x, t).count() == 2 and E.without_covered(x, t).count() == 2
    assert {r.page: r.share for r in E.share_in_tables(x, t).collect()} == {0: 0.75, 1: 0.0}
    pages = spark.createDataFrame([(0, 100.0, 100.0), (1, 100.0, 100.0)], "page int, width double, height double")
    boxes = spark.createDataFrame([(0, "text", [0.0, 0.0, 100.0, 50.0], 40), (0, "image", [-50.0, 0.0, 50.0, 200.0], None)], "page int, kind string, bbox array<double>, chars int")
    r = {r.page: r for r in E.page_features(pages, boxes).collect()}
    assert (r[0].text_chars, r[0].text_area_ratio, r[0].images, r[0].image_area_ratio, r[1].text_chars, r[1].images) == (40, 0.5, 1, 0.5, 0, 0)


def closure(boxes, tolerance=3.0):
    """Any two boxes in reach become one, until none is."""
    boxes = [(*b, 1) for b in boxes]
    while True:
        pair = next(((i, j) for i in range(len(boxes)) for j in range(i) if all(boxes[i][k] <= boxes[j][k + 2] + tolerance and boxes[j][k] <= boxes[i][k + 2] + tolerance for k in (0, 1))), None)
        if pair is None:
            return boxes
        a, b = boxes[pair[0]], boxes[pair[1]]
        boxes = [x for n, x in enumerate(boxes) if n not in pair] + [(min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]), a[4] + b[4])]


def test_clusters_grow(spark):
    import random

    rng = random.Random(2)
    pages = spark.createDataFrame([(p, 300.0, 300.0) for p in range(8)], "page int, width double, height double")
    drawn = []
    for p in range(8):
        for _ in range(rng.randrange(1, 90)):
            x, y = rng.randrange(-2, 300), rng.randrange(-2, 300)
            drawn.append((p, [float(x), float(y), x + float(rng.randrange(0, 25)), y + float(rng.randrange(0, 25))]))
    inside = lambda b: b[0] >= 0 and b[1] >= 0 and b[2] <= 300 and b[3] <= 300
    want = sorted((p, *c) for p in range(8) for c in closure([tuple(b) for q, b in drawn if q == p and inside(b)]) if c[2] - c[0] > 3 and c[3] - c[1] > 3)
    got = sorted((r.page, *r.bbox, r.n) for r in E.clusters(spark.createDataFrame(drawn, "page int, bbox array<double>"), pages).collect())
    assert got == want
    chain = spark.createDataFrame([(0, [0.0, 0.0, 5.0, 5.0]), (0, [20.0, 20.0, 25.0, 25.0]), (0, [4.0, 4.0, 18.0, 18.0]), (0, [0.0, 40.0, 60.0, 41.0])], "page int, bbox array<double>")
    assert [(r.bbox, r.n) for r in E.clusters(chain, pages).collect()] == [([0.0, 0.0, 25.0, 25.0], 3)]


def test_regions_and_edges(spark):
    def boxes(*some):
        return spark.createDataFrame([(0, [float(x) for x in b]) for b in some], "page int, bbox array<double>")

    pages = spark.createDataFrame([(0, 100.0, 100.0)], "page int, width double, height double")
    images, drawn, tables = boxes([-10, 0, 50, 50], [90, 90, 99, 99], [60, 0, 61, 1]), boxes([49, 49, 70, 70], [10, 80, 40, 99], [69, 69, 72, 72]), boxes([0, 75, 45, 100])
    got = [(r.bbox, r.source, r.area_ratio) for r in E.figure_regions(images, drawn, tables, pages, 0.0008, 9).collect()]
    assert got == [([0.0, 0.0, 72.0, 72.0], "image+drawing", 0.518), ([90.0, 90.0, 99.0, 99.0], "image", 0.008)]
    assert E.figure_regions(images, drawn, tables, pages, 0.0008, 1).count() == 1
    rules = [("h", 10.0, 110.0, 0.0, 0.0), ("h", 10.6, 110.4, 50.0, 50.0), ("h", 10.0, 110.0, 500.0, 500.0), ("h", 10.0, 110.0, 501.0, 501.0), ("h", 10.0, 20.0, 30.0, 30.0), ("v", 60.0, 60.0, 10.0, 40.0), ("v", 60.0, 60.0, 450.0, 900.0), ("h", 200.0, 300.0, 0.0, 0.0), ("h", 200.0, 300.0, 40.0, 40.0)]
    edges = spark.createDataFrame([(0, *r) for r in rules], "page int, orientation string, x0 double, x1 double, top double, bottom double")
    assert sorted(tuple(r) for r in E.side_edges(edges).collect()) == [(0, 10.0, 0.0, 50.0), (0, 110.4, 0.0, 50.0)]
    cells = spark.createDataFrame([("a", 0, 0, "x"), ("a", 0, 1, None), ("a", 1, 0, None), ("b", 0, 0, "x"), ("b", 0, 1, "y"), ("c", 0, 0, " "), ("c", 0, 1, None), ("c", 1, 1, "")], "grid string, r int, c int, v string")
    assert {r.grid for r in E.real_grids(cells).collect()} == {"a"}


def test_hints_notes_answers_grids(spark):
    e = spark.createDataFrame([(0, 0, "text", "  My\nHeading "), (0, 1, "text", "other")], "page int, seq int, type string, content string")
    assert [r.type for r in E.retyped(e, spark.createDataFrame([("my heading",)], "title string")).orderBy("seq").collect()] == ["title", "text"]
    notes = spark.createDataFrame([(0, "text", "note"), (3, "text", "lone")], "page int, type string, content string")
    assert {(r.page, r.seq, r.content) for r in E.with_notes(e, notes).collect()} >= {(0, 2, "note"), (3, 0, "lone")}
    jobs = spark.createDataFrame([(1, 0, "fb"), (2, 0, "fb"), (3, 0, "fb")], "job int, page int, fallback string")
    answers = spark.createDataFrame([(1, "good", None), (2, "bad", "timeout")], "job int, content string, error string")
    assert {r.job: (r.content, r.fell_back) for r in E.answered(jobs, answers).collect()} == {1: ("good", False), 2: ("fb", True), 3: ("fb", True)}
    cells = spark.createDataFrame([("g", 0, 0, "a"), ("g", 0, 1, ""), ("g", 1, 0, None), ("g", 1, 1, "x|y\nz")], "grid string, r int, c int, v string")
    r = E.grid_markdown(cells).first()
    assert r.markdown == "| a | a |\n| --- | --- |\n| a | x\\|y<br>z |" and r.empty == 0.5


def test_text_functions(spark):
    ko = "가나다라 abc 한"
    r = one(spark, T.search_terms(F.lit(ko)), T.hangul_share(F.lit("한글 ab\n| abc |")), T.table_columns(F.lit("| a | b | c |\n| --- | --- | --- |\n| 1 | 2 |")), T.unfenced(F.lit("```md\nbody\n```")), T.figure_answer(F.lit("TYPE: chart\nRises")), T.figure_answer(F.lit("no type")), T.section_name(F.lit("2.1\nMotor\nmore")), T.error_rate(F.lit("kitten"), F.lit("sitting")), T.iso_time(F.lit(0)), T.iso_time(F.lit(-5)), T.iso_time(F.lit(1500), True), T.evidence_terms(F.lit("The 1,234 motors were rotating 전동기")), T.first_object(F.lit('say {"a": 1} ok'), "a int"), T.printable_share(F.lit("ab\x01c")), T.hex_lines(F.lit(b"AB\x00")))
    assert r.c0 == ["가나", "나다", "다라", "abc", "한"] and r.c1 == 0.5 and r.c2 == 3 and r.c3 == "body"
    assert tuple(r.c4) == ("chart", "Rises") and tuple(r.c5) == ("diagram", "no type") and r.c6 == "2.1 Motor" and abs(r.c7 - 3 / 7) < 1e-12
    assert r.c8 == "1970-01-01T00:00:00Z" and r.c9 == "1969-12-31T23:59:55Z" and r.c10 == "1970-01-01T00:00:01.500000Z"
    assert {"1234", "motors", "rotati", "전동", "동기"} <= set(r.c11) and "the" not in r.c11
    assert r.c12.a == 1 and r.c13 == 0.75 and r.c14[0].startswith("00000000  41 42 00") and r.c14[0].endswith("AB.")


def test_times_like_datetime(spark):
    """Any time of the years 1 to 9999 reads as Python's datetime writes it; others are named invalid."""
    seconds, far = [0, -5, 86400, -62135596800, 253402300799], [-62135596801, 253402300800]
    python = lambda v: datetime.fromtimestamp(v, tz=timezone.utc).isoformat().replace("+00:00", "Z")
    got = spark.createDataFrame([(v,) for v in seconds + far], "v long").select("v", T.iso_time(F.col("v")).alias("t"), T.iso_time(F.col("v") * 1000 + 7, True).alias("m")).collect()
    assert {r.v: r.t for r in got} == {v: python(v) for v in seconds} | {v: f"invalid time {v}" for v in far}
    assert {r.m for r in got if r.v in (0, -5)} == {"1970-01-01T00:00:00.007000Z", "1969-12-31T23:59:55.007000Z"}
    assert iso_times(np.array(seconds + far), "unix_s") == [python(v) for v in seconds] + [f"invalid time {v}" for v in far]
    assert iso_times(np.array([1500, -1]), "unix_ms") == ["1970-01-01T00:00:01.500000Z", "1969-12-31T23:59:59.999000Z"]


def test_page_checks(spark):
    df = spark.range(1).select(F.lit("table").alias("label"), F.lit("table").alias("want_label"), F.lit("abc").alias("text"), F.lit("abd").alias("want_text"), F.array(F.lit("B"), F.lit("zz")).alias("want_facts"), F.array(F.lit("The Title")).alias("titles"), F.lit("title").alias("want_title"), F.array(F.lit("| a |\n| - |")).alias("tables"), F.lit(True).alias("want_no_single_column"), F.array(F.lit("a")).alias("want_cells"), F.lit(1).alias("want_columns"), F.array(F.lit("chart")).alias("figure_kinds"), F.lit("chart").alias("want_figure"), F.lit("한글").alias("figure_text"), F.array(F.lit("한글")).alias("want_figure_facts"), F.lit("ko").alias("want_language"), F.array(F.lit("Figure 1: x")).alias("captions"), F.lit("figure 1").alias("want_caption"))
    got = {c.id: (c.score, c.passed) for c in X.page_checks(df).first().checks}
    assert got == {"label": (1.0, True), "text": (0.667, False), "facts": (0.5, False), "title": (1.0, True), "no_single_column": (0.0, False), "cells": (1.0, True), "columns": (1.0, True), "figure": (1.0, True), "figure_facts": (1.0, True), "language": (1.0, True), "caption": (1.0, True)}


def test_boxes_joined_together_as_one_by_one():
    rng = np.random.default_rng(3)
    for size, wide in ((1, 5), (2, 300), (60, 20), (300, 8), (500, 30)):
        at = rng.integers(0, 300, (size, 2)) + 0.25
        boxes = np.concatenate([at, at + rng.integers(0, wide, (size, 2))], axis=1)
        boxes[size // 2, 0] = np.nan if size > 50 else boxes[size // 2, 0]
        got, n = E._joined(boxes, np.ones(size, np.int64))
        assert sorted(map(repr, zip(got.tolist(), n.tolist()))) == sorted(map(repr, (([*b[:4]], b[4]) for b in E._closed([(*b, 1) for b in boxes.tolist()]))))


def test_pages_of_very_many_paths_and_of_few(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(p, [float(x), float(y), float(x + 6), float(y + 9)]) for p, k in ((1, 300), (2, 30), (3, 1), (4, 200)) for x, y in rng.integers(0, 580, (k, 2))]
    drawn = spark.createDataFrame(rows, "page long, bbox array<double>")
    pages = spark.createDataFrame([(p, 600.0, 600.0) for p in range(6)], "page long, width double, height double")
    seen = []
    for busy, together in ((4096, 512), (100, 512), (100, 20)):
        monkeypatch.setattr(E, "BUSY", busy)
        monkeypatch.setattr(E, "TOGETHER", together)
        seen.append(sorted((r.page, *r.bbox, r.n) for r in E.clusters(drawn, pages, thin=True).collect()))
    assert seen[0] == seen[1] == seen[2] and sum(r[-1] for r in seen[0]) == len([r for r in rows if r[1][2] <= 600 and r[1][3] <= 600])
    tasks = E.clusters(drawn, pages)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in tasks


def test_partitions_follow_the_rows(spark, monkeypatch):
    """More rows are dealt to more tasks than the settings name, and the regions stay as they are."""
    rng = np.random.default_rng(6)
    pages = spark.createDataFrame([(p, 600.0, 600.0) for p in range(40)], "page long, width double, height double")
    drawn, images, tables = (spark.createDataFrame([(p % 40, [float(x), float(y), float(x + w), float(y + w)]) for p, (x, y) in enumerate(rng.integers(0, 580, (n, 2)))], "page long, bbox array<double>") for n, w in ((400, 30), (100, 80), (50, 40)))
    found = lambda: E.figure_regions(images, E.clusters(drawn, pages), tables, pages, 0.004, 4)
    want = sorted(map(tuple, found().collect()), key=repr)
    monkeypatch.setattr(E, "SHARE", 10, raising=False)
    plan = found()._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [page#" in plan and any(line.rstrip().endswith(", 40") for line in plan.split("\n")) and any(line.rstrip().endswith(", 15") for line in plan.split("\n"))
    assert sorted(map(tuple, found().collect()), key=repr) == want
