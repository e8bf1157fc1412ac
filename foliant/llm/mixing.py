"""Mixing sources to target weights by entropy balancing, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm import common as c

WORD = r"[^\x20\x09-\x0D]+"
#: A document's place in its source's order is 52 bits of a digest of its id; the first 16 make its bin.
_BIN = 1 << 36
#: Newton's steps between two tests of convergence, the greatest step, and how near to targets sums of words must come.
STEPS, STRIDE, NEAR = 4, 1.0, 1e-11
_ROUNDS = 500  # of STEPS; a multiplier of 2000 is over all numbers that doubles have

def _targets(sources: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """sources with target: shares of all sizes by weight, each at most cap times its source's size.

    The excess of capped sources is shared anew by weight until none is above, which is to find the level L with
    sum(min(cap * size, L * weight)) = total. In the order of cap * size / weight, the first k are capped; L follows
    from the rest.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")  # a row for each source
    each = sources.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    each = each.withColumn("limit", F.lit(float(cap)) * F.col("source_size")).withColumn("total", F.sum("source_size").over(Window.partitionBy()))
    by_level = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source")
    earlier = by_level.rowsBetween(Window.unboundedPreceding, -1)
    later = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    each = each.withColumn("level", (F.col("total") - F.coalesce(F.sum("limit").over(earlier), F.lit(0.0))) / F.sum("weight").over(later))
    # the first source that the level reached so far doesn't cap gives it
    level = F.min_by(F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.col("level")), F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.col("limit") / F.col("weight"))).over(Window.partitionBy())
    return each.withColumn("target", F.least("limit", F.coalesce(level, F.lit(float("inf"))) * F.col("weight"))).select("source", "source_size", "docs", "target")


def _multipliers(bins: DataFrame, plan: DataFrame) -> DataFrame:
    """plan with ``x``: each source's multiplier in the tilt exp(x), null where it has no words or no target.

    Minimises the convex dual, the sum over sources of (words * exp(x) - target * x), by Newton's steps from 0. A step's
    gradient and Hessian are sums of tilted words over bins of documents, 256 of each source, spread over the cluster.
    Far from the solution a full step overshoots, so steps are held to STRIDE. Every STEPS steps the greatest distance from a target is
    tested, one number on the driver; without convergence it raises.
    """
    spark = bins.sparkSession
    coarse = bins.groupBy("source", F.shiftright("bin", 8).alias("bin")).agg(F.sum("words").cast("double").alias("words"))  # 256 at most of a source
    words, words_path = c.stored(coarse.where("words > 0"), "words", large=False)
    duals, path = c.stored(plan.select("source", F.col("target").alias("goal"), F.lit(0.0).alias("x")).where("goal > 0 and source_size > 0"), "duals", large=False)
    for _ in range(_ROUNDS):
        tilted = words.join(duals.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
        of = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # in one order: reruns agree
        for _ in range(STEPS):
            step = F.col("goal") / F.sum(F.col("words") * F.exp("x")).over(of) - 1
            tilted = tilted.withColumn("x", F.col("x") + F.least(F.greatest(step, F.lit(-STRIDE)), F.lit(STRIDE)))
        got = F.sum(F.col("words") * F.exp("x")).over(of)
        new = tilted.withColumn("got", got).groupBy("source").agg(F.first("goal").alias("goal"), F.first("x").alias("x"), F.first("got").alias("got"))
        new, new_path = c.stored(new, "duals", large=False)
        c.delete(spark, path)
        duals, path = new.drop("got"), new_path
        far = new.agg(F.max(F.abs(F.col("got") / F.col("goal") - 1))).first()[0]
        if far is None or far <= NEAR:
            c.delete(spark, words_path)
            return plan.join(duals.select(F.col("source").alias("of"), "x"), F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    raise RuntimeError(f"Newton's steps end {far:g} away from a target")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies, taken) for each row.

    Maximum entropy against equal rates, under a token constraint for each source, makes a document's rate the
    exponential of its source's multiplier, which Newton's steps on the dual find. Rates become copies: the whole part
    for all documents, and one more for those that come first in their source's order (a digest of the id) as
    long as words are missing. A histogram of the order finds the bin where they run out; only that bin's documents
    are ordered one by one. So each source comes within half a document of its target, and reruns agree.

    size: words of the text (null: 0). Sources are ordered by code point, null last, and weigh ``weights`` in turn. A
    null id has an order of its own; equal rows have one place, and any of them may come first. An empty table gives
    an empty result. Other columns are ignored. Targets are worked out in one table with a row for each source, sorted by
    one task: sources are names of corpora, thousands at most. Words of a source of any size are spread over its bins.
    """
    order = F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("none"))), 1, 13), 16, 10).cast("long")
    sized, _ = c.stored(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), order.alias("place")), "sizes", large=False)
    sized = sized.withColumn("bin", F.floor(F.col("place") / _BIN).cast("int"))
    total = sized.count()
    if not total:
        return sized.select("doc_id", "source", "size", *(F.lit(None).cast(t).alias(n) for n, t in (("source_size", "long"), ("target", "double"), ("rate", "double"), ("copies", "int"), ("taken", "long"))))
    bins, _ = c.stored(sized.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("docs")), "bins", large=False)
    sums = bins.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("docs").alias("docs"))
    plan, _ = c.stored(_targets(sums, weights, cap), "targets", large=False)
    plan = _multipliers(bins, plan).withColumn("rate", F.coalesce(F.exp("x"), F.lit(0.0))).drop("x")
    near = F.round("rate")  # a rate that is whole but for the last digits
    plan = plan.withColumn("whole", F.when(F.abs(F.col("rate") - near) <= 1e-9 * near, near).otherwise(F.floor("rate"))).withColumn("missing", F.col("target") - F.col("whole") * F.col("source_size"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = bins.select("source", "bin", "words").withColumn("before", before)
    last = marked.join(plan.select(F.col("source").alias("of"), "missing"), F.col("source").eqNullSafe(F.col("of"))).where(F.col("before") < F.col("missing"))
    last = last.groupBy("of").agg(F.max("bin").alias("last"), F.max("before").alias("last_before"))
    plan = plan.join(last, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    placed = c.looked_up(sized, plan, ["source"], "docs", total)
    sure = placed.where("last is null or bin <> last").withColumn("more", F.when(F.col("bin") < F.col("last"), 1).otherwise(0))
    in_turn = Window.partitionBy("source").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    edge = placed.where("bin = last").withColumn("sofar", F.col("last_before") + F.coalesce(F.sum("size").over(in_turn), F.lit(0)))
    edge = edge.withColumn("more", F.when(F.col("sofar") + F.col("size") / 2 <= F.col("missing"), 1).otherwise(0)).drop("sofar")
    copies = (F.col("whole") + F.col("more")).cast("int")
    return sure.unionByName(edge).select("doc_id", "source", "size", "source_size", "target", "rate", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


ORACLE = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         ('0x' || substr(md5(coalesce(doc_id::varchar, 'none')), 1, 13))::bigint as place from documents),
sources as (select source, sum(size)::bigint as source_size from sized group by source),
weighed as (
  select *, (case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end)::double as weight,
         3.0::double * source_size as cap, sum(source_size) over ()::double as total from sources),
levels as (
  select *, (total - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
         / sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as level from weighed),
level as (select coalesce(min_by(level, cap / weight), 'inf'::double) as level from levels where level * weight <= cap),
targets as (select source, source_size, least(cap, level.level * weight) as target from levels, level),
plan as (select *, case when source_size > 0 then floor(target / source_size) else 0 end as whole from targets),
turns as (
  select s.*, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size as missing,
         coalesce(sum(size) over (partition by s.source order by place, doc_id, size rows between unbounded preceding and 1 preceding), 0) as sofar
  from sized s join plan p on s.source is not distinct from p.source)
select doc_id, source, size, source_size, target,
       ((whole + case when sofar + size / 2.0 <= missing then 1 else 0 end) * size)::bigint as taken
from turns
"""
