"""Relational reads over documents, runs, events, elements and chunks, for tables of any names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The one last row of each key, by the order columns descending; the last of them should break ties."""
    w = Window.partitionBy(key).orderBy(*(F.desc(o) for o in order))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def latest_with_ties(df: DataFrame, key: str, order: str) -> DataFrame:
    """All rows of each key whose order column is the key's greatest: an aggregate joined back, so ties stay."""
    top = df.groupBy(F.col(key).alias("_key")).agg(F.max(order).alias("_top"))
    return df.join(top, (F.col(key) == F.col("_key")) & (F.col(order) == F.col("_top"))).drop("_key", "_top")


def without_secrets(df: DataFrame, *secret: str) -> DataFrame:
    """df with each secret column replaced by whether it is set: has_<name>."""
    return df.select(*(F.col(x) for x in df.columns if x not in secret), *((F.col(x).isNotNull() & (F.col(x) != "")).alias(f"has_{x}") for x in secret))


def page_of(df: DataFrame, order: list[Column], offset: int, limit: int, most: int = 1000) -> DataFrame:
    """A page of rows in order, each with the total number of rows; the limit is held to 1..most."""
    total = F.broadcast(df.agg(F.count(F.lit(1)).alias("total")))
    return df.crossJoin(total).orderBy(*order).offset(max(0, offset)).limit(max(1, min(limit, most)))


def by_predicates(df: DataFrame, **wanted) -> DataFrame:
    """Rows that equal all given values; None asks nothing."""
    for name, value in wanted.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def resolve(df: DataFrame, ref: str, id_col: str, name_col: str, newest: str) -> DataFrame:
    """The newest row whose id or name is ref, or whose name and ref end alike after an underscore."""
    id_, name = F.col(id_col).cast("string"), F.col(name_col)
    same = (id_ == ref) | (name == ref) | name.endswith(f"_{ref}") | F.lit(ref).endswith(F.concat(F.lit("_"), name))
    return df.where(same).orderBy(F.desc(newest), F.desc(id_col)).limit(1)


def first_by_content(df: DataFrame, content: str, order: str) -> DataFrame:
    """Rows with content's digest and the first row (least order) that has the same content."""
    digest = F.sha2(F.col(content), 256)
    return df.withColumn("sha256", digest).withColumn("first", F.min(order).over(Window.partitionBy("sha256")))


def ordered_distinct(ids: list, known: DataFrame, key: str) -> tuple[list, DataFrame]:
    """The ids in the order of their first mention, and those of them that the table lacks."""
    unique = list(dict.fromkeys(ids))
    asked = known.sparkSession.createDataFrame([(i,) for i in unique], f"{key} {known.schema[key].dataType.simpleString()}")
    return unique, asked.join(known, key, "left_anti")


def element_counts(elements: DataFrame) -> DataFrame:
    """Counts and characters by page and type, page and tool, page, type, and in all: one pass of grouping sets."""
    page, kind, tool = F.col("page"), F.col("type"), F.col("tool")
    sets = elements.groupingSets([[page, kind], [page, tool], [page], [kind], []], page, kind, tool)
    made = sets.agg(F.grouping_id("page", "type", "tool").alias("level"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("content")), F.lit(0)).alias("chars"))
    return made.select("page", "type", "tool", "level", "n", "chars")


def pages_with_elements(profiles: DataFrame, elements: DataFrame) -> DataFrame:
    """Profiled pages and element pages, whichever side has them: label null or counts 0 where one is missing."""
    counted = elements.groupBy("page").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("chars"))
    return profiles.join(counted, "page", "full_outer").select("page", "label", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("chars", F.lit(0)).alias("chars"))


def purge_counts(documents: DataFrame, children: dict[str, tuple[DataFrame, str]], ids: DataFrame, key: str) -> DataFrame:
    """How many rows of each table belong to the ids that go."""
    out = documents.join(ids, key, "left_semi").agg(F.count(F.lit(1)).alias("rows")).select(F.lit("documents").alias("name"), "rows")
    for name, (df, column) in children.items():
        gone = df.join(ids.withColumnRenamed(key, column), column, "left_semi")
        out = out.unionByName(gone.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows"))
    return out


def survivors(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids, key, "left_anti")


def step_states(events: DataFrame, by: list[str], kind: Column, order: Column) -> DataFrame:
    """State of each step, folded from its events: started is running, finished done, error failed.

    Once the run has finished, a step still running is stopped. ``kind`` is one of these words, or null.
    """
    run = by[0]
    marked = events.withColumn("_kind", kind).withColumn("_order", order)
    over = marked.where("_kind = 'run_finished'").select(run).distinct().withColumn("_over", F.lit(True))
    last = marked.where("_kind in ('started', 'finished', 'error')").groupBy(*by).agg(F.max_by("_kind", "_order").alias("_last"))
    state = F.when(F.col("_last") == "finished", "done").when(F.col("_last") == "error", "failed").when(F.coalesce("_over", F.lit(False)), "stopped").otherwise("running")
    return last.join(over, run, "left").select(*by, state.alias("state"))
