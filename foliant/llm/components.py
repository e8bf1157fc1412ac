"""Connected components of a graph kept as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm import common as c


def _rooted(up: DataFrame, path: str) -> tuple[DataFrame, str]:
    """up (id, label) with each label followed to its end; every label is an id too, and at most its id."""
    spark = up.sparkSession
    while True:
        far = up.select(F.col("id").alias("label"), F.col("label").alias("far"))
        new, new_path = c.stored(up.join(far, "label").select("id", F.col("label").alias("old"), F.col("far").alias("label")), "labels", large=False)
        changed = new.where("label <> old").limit(1).count()
        c.delete(spark, path)
        up, path = new.select("id", "label"), new_path
        if not changed:
            return up, path


def components(edges: DataFrame) -> DataFrame:
    """(id, label) for every end of an edge (a, b): the least id of its component.

    Each round hooks every node to the least of its neighbours, if that is less, follows the hooks to their roots and
    keeps the edges between different roots, until none is left. A node that stays a root has taken a neighbour in, or
    has a lesser neighbour in the next round, so two rounds at least halve the roots that have edges: rounds grow with
    the logarithm of a component's nodes, and so do the jumps of a round. Every step is written to the shared folder;
    only counts reach the driver. No edges give no rows.
    """
    spark = edges.sparkSession
    links, links_path = c.stored(edges.selectExpr("cast(a as long) a", "cast(b as long) b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges", large=False)
    labels, path = None, None
    while True:
        both = links.selectExpr("explode(array(struct(a, b), struct(b as a, a as b))) e").selectExpr("e.a", "e.b")
        up, up_path = _rooted(*c.stored(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("b")).selectExpr("id", "least(id, b) label"), "labels", large=False))
        if labels is None:
            labels, path = up, up_path
        else:
            higher = up.select(F.col("id").alias("label"), F.col("label").alias("root"))
            joined, joined_path = c.stored(labels.join(higher, "label", "left").select("id", F.coalesce("root", "label").alias("label")), "labels", large=False)
            c.delete(spark, path)
            labels, path = joined, joined_path
        ends = [up.select(F.col("id").alias(x), F.col("label").alias(f"{x}_root")) for x in "ab"]
        left = links.join(ends[0], "a").join(ends[1], "b").where("a_root <> b_root")
        left, left_path = c.stored(left.select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct(), "edges", large=False)
        c.delete(spark, links_path)
        if up_path != path:
            c.delete(spark, up_path)
        links, links_path = left, left_path
        if not links.limit(1).count():
            c.delete(spark, links_path)
            return labels
