"""Metrics of retrieval, classification and extraction, as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as T


def first_relevant(hits: DataFrame, relevant: Column, by: list[str]) -> DataFrame:
    """The first relevant rank of each query, null if no hit is."""
    return hits.groupBy(*by).agg(F.min(F.when(relevant, F.col("rank"))).alias("rank"))


def relevance(hit_pages: Column, wanted_pages: Column, hit_text: Column, wanted_text: Column) -> Column:
    """A hit counts if it shares a page with what is wanted, or has the wanted text, white space and case aside."""
    pages = F.coalesce(F.arrays_overlap(hit_pages, wanted_pages), F.lit(False))
    words = F.coalesce(F.contains(T.collapsed(hit_text), T.collapsed(wanted_text)) & (F.length(wanted_text) > 0), F.lit(False))
    return pages | words


def retrieval_metrics(ranks: DataFrame, k: int = 5) -> DataFrame:
    """hit@1, hit@k and mean reciprocal rank by mode and kind, and by mode; ``rank`` is null where nothing was found."""
    hit = lambda test: F.avg(F.when(test, 1.0).otherwise(0.0))
    sets = ranks.groupingSets([[F.col("mode")], [F.col("mode"), F.col("kind")]], "mode", "kind")
    mrr = F.avg(F.coalesce(F.lit(1.0) / F.col("rank"), F.lit(0.0)))
    return sets.agg(F.grouping_id("mode", "kind").alias("level"), F.count(F.lit(1)).alias("n"), hit(F.col("rank") == 1).alias("hit1"), hit(F.col("rank") <= k).alias("hitk"), mrr.alias("mrr"))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))


def accuracy(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.agg(F.avg((F.col(truth) == F.col(predicted)).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def check(id_: str, score: Column, passes: float) -> Column:
    """A check's result: score within 0 and 1 to three digits, and whether it passes."""
    held = F.round(F.least(F.greatest(score.cast("double"), F.lit(0.0)), F.lit(1.0)), 3)
    return F.struct(F.lit(id_).alias("id"), held.alias("score"), (held >= passes).alias("passed"))


def coverage(facts: Column, text: Column) -> Column:
    """struct(share, missing) of the facts that a text has, white space and case aside."""
    plain = T.collapsed(text)
    missing = F.filter(facts, lambda f: ~F.contains(plain, T.collapsed(f)))
    return F.struct((1 - F.coalesce(F.try_divide(F.size(missing), F.size(facts)), F.lit(0.0))).alias("share"), missing.alias("missing"))


#: Distinct anchors of facts that are looked for in each text; with more, texts and facts meet by a join alone.
ANCHORS = 4096


def facts_found(docs: DataFrame, id_col: str, text_col: str, facts: DataFrame, fact_id: str, fact_col: str) -> DataFrame:
    """(id, fact): which facts each text has, white space and case aside.

    Texts and facts meet on a run of words that every text with the fact must have: words 2 to 5 of a fact of six or
    more, word 2 of one of three to five; what meets is then searched for the whole fact. Facts of one or two words
    have no whole word inside, and are searched in all texts.
    """
    runs = lambda words, n: F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.xxhash64(F.lit(n), F.array_join(F.slice(words, i, n), " ")))
    text = docs.select(F.col(id_col).alias("id"), T.collapsed(F.col(text_col)).alias("text"))
    fact = facts.select(F.col(fact_id).alias("fact"), T.collapsed(F.col(fact_col)).alias("wanted")).where("wanted is not null")
    words = F.split("text", " ")
    inside = F.split("wanted", " ")
    n = F.size(inside)
    anchor = F.when(n >= 6, F.xxhash64(F.lit(4), F.array_join(F.slice(inside, 2, 4), " "))).when(n >= 3, F.xxhash64(F.lit(1), F.element_at(inside, 2)))
    anchored = fact.withColumn("anchor", anchor)
    kinds = anchored.where("anchor is not null").select(F.when(n >= 6, 4).otherwise(1).alias("k")).distinct()
    sizes = sorted(r.k for r in kinds.collect())  # 1 and 4 at most
    every = lambda w: F.array_distinct(F.flatten(F.array(*(F.when(F.size(w) >= k, runs(w, k)).otherwise(F.array().cast("array<bigint>")) for k in sizes))))
    each = F.transform(F.array(words), every)[0]  # bound once: else the text would be split again for each of its words
    few = [r.anchor for r in anchored.select("anchor").where("anchor is not null").distinct().limit(ANCHORS + 1).collect()]
    if len(few) <= ANCHORS:  # a text's runs that no fact asks for go before anything moves
        each = F.array_intersect(each, F.array(*map(F.lit, few)).cast("array<bigint>"))
    met = text.select("id", F.explode(each).alias("anchor")).join(anchored.select("fact", "anchor"), "anchor").select("id", "fact").distinct()
    long = met.join(text, "id").join(fact, "fact")
    short = text.join(anchored.where("anchor is null").drop("anchor"), F.contains("text", F.col("wanted")))
    return long.where(F.contains("text", F.col("wanted"))).select("id", "fact").unionByName(short.select("id", "fact"))


def page_checks(page: DataFrame) -> DataFrame:
    """page with ``checks``: the results of those checks whose expectation is set, and their mean as ``score``.

    Columns: label, text, titles, tables (Markdown), figure_kinds, figure_text, captions (arrays but for label and
    texts); want_label, want_text, want_facts, want_title, want_cells, want_columns, want_figure, want_figure_facts,
    want_language, want_caption, want_no_single_column.
    """
    has = lambda items, wanted: F.exists(items, lambda x: F.contains(T.collapsed(x), T.collapsed(wanted)))
    tables = F.array_join("tables", "\n")
    figures = F.coalesce(F.nullif(F.col("figure_text"), F.lit("")), F.col("text"))
    widest = F.coalesce(F.array_max(F.transform("tables", lambda t: T.table_columns(t))), F.lit(0))
    every = {
        "want_label": check("label", (F.col("label") == F.col("want_label")).cast("int"), 1),
        "want_text": check("text", 1 - T.error_rate(T.bare(F.col("text")), T.bare(F.col("want_text"))), 0.95),
        "want_facts": check("facts", coverage(F.col("want_facts"), F.col("text"))["share"], 1),
        "want_title": check("title", has(F.col("titles"), F.col("want_title")).cast("int"), 1),
        "want_no_single_column": check("no_single_column", (~F.exists("tables", lambda t: T.table_columns(t) == 1)).cast("int"), 1),
        "want_cells": check("cells", coverage(F.col("want_cells"), tables)["share"], 1),
        "want_columns": check("columns", (widest == F.col("want_columns")).cast("int"), 1),
        "want_figure": check("figure", F.array_contains("figure_kinds", F.col("want_figure")).cast("int"), 1),
        "want_figure_facts": check("figure_facts", coverage(F.col("want_figure_facts"), F.col("figure_text"))["share"], 1),
        "want_language": check("language", T.hangul_share(figures) / 0.5, 1),
        "want_caption": check("caption", has(F.col("captions"), F.col("want_caption")).cast("int"), 1),
    }
    checks = F.filter(F.array(*(F.when(F.col(k).isNotNull(), v) for k, v in every.items() if k in page.columns)), lambda x: x.isNotNull())
    mean = F.try_divide(F.aggregate("checks", F.lit(0.0), lambda s, x: s + x["score"]), F.size("checks"))
    return page.withColumn("checks", checks).withColumn("score", mean)


def check_summary(results: DataFrame) -> DataFrame:
    """Mean score, passes and number of each check, from page_checks()."""
    each = results.select(F.explode("checks").alias("c")).select("c.*")
    return each.groupBy("id").agg(F.avg("score").alias("score"), F.count_if("passed").alias("passed"), F.count(F.lit(1)).alias("n"))


def dataset_version(cases: DataFrame, *columns: str) -> DataFrame:
    """A digest of all cases, whatever their order: of the digests of 16^4 buckets, each of its sorted cases' counts."""
    each = cases.select(F.sha2(F.to_json(F.struct(*columns)), 256).alias("d")).groupBy("d").agg(F.count(F.lit(1)).alias("n"))
    lines = F.array_sort(F.collect_list(F.concat_ws(" ", "d", "n")))
    buckets = each.groupBy(F.left("d", F.lit(4)).alias("b")).agg(F.sha2(F.array_join(lines, ","), 256).alias("h"))
    return buckets.agg(F.left(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "b", "h"))), ","), 256), F.lit(12)).alias("version"))


def best_values(df: DataFrame, metric: str, value: str, lower_is_better: Column) -> DataFrame:
    """df with whether a value is its metric's best; none is where all are equal."""
    from pyspark.sql import Window

    w = Window.partitionBy(metric)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return df.withColumn("best", (low != high) & (F.col(value) == F.when(lower_is_better, low).otherwise(high)))


def results_listed(files: DataFrame, schema: str) -> DataFrame:
    """Files (path, name, modified, content) of results as rows, newest first, with what can't be read said.

    content is a JSON object of ``schema`` (name type, ...); ``problem`` is null where it is one.
    """
    got = F.from_json("content", f"struct<{schema}, _bad string>".replace(" string", ":string").replace(" double", ":double").replace(" long", ":long"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    read = files.withColumn("r", got)
    problem = F.when(F.trim("content") == "", "empty").when(F.col("r").isNull() | F.col("r._bad").isNotNull(), "not JSON")
    names = [x.split()[0] for x in schema.split(", ")]
    return read.select("name", "modified", *(F.when(problem.isNull(), F.col(f"r.{n}")).alias(n) for n in names), problem.alias("problem")).orderBy(F.desc("modified"), "name")


def matrix_markdown(counts: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: the counts of confusion() as a Markdown table, labels in order, rows what is true."""
    labels = counts.select(F.col(truth).cast("string").alias("l")).unionByName(counts.select(F.col(predicted).cast("string").alias("l"))).distinct()
    full = labels.select(F.col("l").alias("t")).crossJoin(F.broadcast(labels.select(F.col("l").alias("p"))))  # labels are few: a table's rows and columns
    cells = full.join(counts.select(F.col(truth).cast("string").alias("t"), F.col(predicted).cast("string").alias("p"), "n"), ["t", "p"], "left")
    rows = cells.groupBy("t").agg(F.array_sort(F.collect_list(F.struct("p", F.coalesce("n", F.lit(0)).cast("string").alias("n")))).alias("c"))
    line = F.concat(F.lit("| "), F.col("t"), F.lit(" | "), F.array_join(F.transform("c", lambda x: x["n"]), " | "), F.lit(" |"))
    whole = rows.agg(F.array_sort(F.collect_list(F.struct("t", line.alias("line"), F.transform("c", lambda x: x["p"]).alias("p")))).alias("r"))
    head = F.col("r")[0]["p"]
    top = F.concat(F.lit("| label \\ pred | "), F.array_join(head, " | "), F.lit(" |\n|---|"), F.repeat(F.lit("---|"), F.size(head)))
    return whole.select(F.when(F.size("r") > 0, F.concat(top, F.lit("\n"), F.array_join(F.transform("r", lambda x: x["line"]), "\n"))).otherwise("").alias("markdown"))
