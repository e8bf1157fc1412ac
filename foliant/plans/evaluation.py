"""Metrics over labels, benchmark and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import evaluation as X
from foliant.plans.registry import query, table


def _predicted(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") > 1200).cast("int").alias("predicted"))
    return table(spark, sf_dir, "labels").join(docs, "doc_id")


@query("select quality, (n_chars > 1200)::int as predicted, count(*) as n from labels join documents using (doc_id) group by 1, 2")
def confusion_matrix(spark, sf_dir):
    return X.confusion(_predicted(spark, sf_dir), "quality", "predicted")


@query("select avg((quality = (n_chars > 1200)::int)::int)::double as accuracy, count(*) as n from labels join documents using (doc_id)")
def accuracy(spark, sf_dir):
    return X.accuracy(_predicted(spark, sf_dir), "quality", "predicted")


@query("select doc_id, quality, (n_chars > 1200)::int as predicted from labels join documents using (doc_id) where quality <> (n_chars > 1200)::int")
def misclassified(spark, sf_dir):
    return _predicted(spark, sf_dir).where("quality <> predicted").select("doc_id", "quality", "predicted")


@query(
    """with r as (select lang as mode, source as kind, case when doc_id % 7 = 0 then null else doc_id % 7 end as rank from documents)
    select mode, kind, grouping_id(mode, kind)::bigint as level, count(*) as n, avg(case when rank = 1 then 1.0::double else 0 end) as hit1,
           avg(case when rank <= 5 then 1.0::double else 0 end) as hitk, avg(coalesce(1.0::double / rank, 0)) as mrr from r group by grouping sets ((mode), (mode, kind))"""
)
def retrieval_metrics(spark, sf_dir):
    r = table(spark, sf_dir, "documents").select(F.col("lang").alias("mode"), F.col("source").alias("kind"), F.nullif(F.col("doc_id") % 7, F.lit(0)).alias("rank"))
    return X.retrieval_metrics(r).withColumn("level", F.col("level").cast("long"))


@query("select source as q, min(case when contains(lower(text), 'the the') or doc_id % 5 = 2 then doc_id // 20 + 1 end) as rank from documents group by 1")
def first_relevant_rank(spark, sf_dir):
    hits = table(spark, sf_dir, "documents").select(F.col("source").alias("q"), F.floor(F.col("doc_id") / 20 + 1).alias("rank"), F.array((F.col("doc_id") % 5).cast("int")).alias("pages"), "text")
    has = F.contains(F.lower("text"), F.lit("the the")) | X.relevance(F.col("pages"), F.array(F.lit(2)), F.lit(""), F.lit(""))
    return X.first_relevant(hits, has, ["q"])


@query(
    """with p as (select doc_id, lang = 'en' as label, contains(lower(text), 'the') as fact, n_chars % 3 = 0 as figure from documents),
    s as (select unnest([struct_pack(id := 'label', score := label::int::double), struct_pack(id := 'facts', score := fact::int::double), struct_pack(id := 'figure', score := figure::int::double)]) as c from p)
    select c.id as id, avg(c.score) as score, count(*) filter (c.score >= 1) as passed, count(*) as n from s group by 1"""
)
def page_check_summary(spark, sf_dir):
    page = table(spark, sf_dir, "documents").select(
        F.col("lang").alias("label"), F.lit("en").alias("want_label"), "text", F.array(F.lit("the")).alias("want_facts"),
        F.array(F.when(F.col("n_chars") % 3 == 0, "chart").otherwise("photo")).alias("figure_kinds"), F.lit("chart").alias("want_figure"),
        F.array().cast("array<string>").alias("tables"), F.array().cast("array<string>").alias("titles"), F.array().cast("array<string>").alias("captions"), F.lit("").alias("figure_text"),
        *(F.lit(None).cast(t).alias(n) for n, t in (("want_text", "string"), ("want_title", "string"), ("want_no_single_column", "boolean"), ("want_cells", "array<string>"), ("want_columns", "int"), ("want_figure_facts", "array<string>"), ("want_language", "string"), ("want_caption", "string"))),
    )
    return X.check_summary(X.page_checks(page))


@query()
def dataset_version(spark, sf_dir):
    return X.dataset_version(table(spark, sf_dir, "benchmark"), "item_id", "text")


def _facts(a: str, b: str) -> str:
    return f"({a} + {b}) / 2.0"


@query(
    f"""with s as (select s_suppkey as k, s_acctbal >= 0 as solvent from supplier),
    c as (select k, unnest([struct_pack(id := 'title', score := (k % 2 = 0)::int::double), struct_pack(id := 'no_single_column', score := (k % 5 <> 0)::int::double),
      struct_pack(id := 'cells', score := {_facts("1", "(k % 3 = 0)::int")}::double), struct_pack(id := 'columns', score := (k % 4 = 0)::int::double),
      struct_pack(id := 'figure_facts', score := {_facts("(k % 7 <> 0)::int", "solvent::int")}::double), struct_pack(id := 'language', score := (k % 6 = 0)::int::double),
      struct_pack(id := 'caption', score := (k % 9 = 0)::int::double), struct_pack(id := 'facts', score := solvent::int::double), struct_pack(id := 'label', score := (k % 8 = 0)::int::double)]) as c from s)
    select k, c.id as id, c.score as score, c.score >= 1 as passed from c"""
)
def page_checks(spark, sf_dir):
    """Suppliers as pages whose titles, tables, figures and captions keep some of what is expected."""
    k, name = F.col("s_suppkey"), F.col("s_name")
    cell = F.when(k % 3 == 0, "found  HERE").otherwise("other")
    wide = F.concat(F.lit("| a | b | c |\n| --- | --- | --- |\n| "), name, F.lit(" | "), cell, F.lit(" | x |"))
    narrow = F.concat(F.lit("| a | b |\n| --- | --- |\n| "), name, F.lit(" | "), cell, F.lit(" |"))
    said = F.concat(F.when(k % 7 != 0, "rate of FIVE").otherwise("nothing"), F.lit(", "), F.when(F.col("s_acctbal") >= 0, "in credit").otherwise("in debt"))
    figure = F.concat(said, F.when(k % 6 == 0, F.repeat(F.lit("가"), F.lit(200))).otherwise(""))
    one = lambda c: F.array(c)
    pages = table(spark, sf_dir, "supplier").select(
        k.alias("k"), F.when(k % 8 == 0, "text").otherwise("mixed").alias("label"), F.lit("text").alias("want_label"), F.when(F.col("s_acctbal") >= 0, "the  Balance is fine").otherwise("no").alias("text"), one(F.lit("balance is")).alias("want_facts"),
        one(F.concat(F.lit("Report of "), name)).alias("titles"), F.when(k % 2 == 0, F.lower(name)).otherwise("no such").alias("want_title"),
        F.when(k % 5 == 0, F.array(F.when(k % 4 == 0, wide).otherwise(narrow), F.lit("| x |\n| --- |\n| y |"))).otherwise(F.array(F.when(k % 4 == 0, wide).otherwise(narrow))).alias("tables"),
        F.array(F.lower(name), F.lit("found here")).alias("want_cells"), F.lit(3).alias("want_columns"), F.lit(True).alias("want_no_single_column"),
        F.array().cast("array<string>").alias("figure_kinds"), figure.alias("figure_text"), F.array(F.lit("rate of five"), F.lit("in credit")).alias("want_figure_facts"), F.lit("ko").alias("want_language"),
        one(F.when(k % 9 == 0, "Figure 1:  Sales").otherwise("Figure 2")).alias("captions"), F.lit("figure 1: sales").alias("want_caption"),
    )
    return X.page_checks(pages).select("k", F.explode("checks").alias("c")).select("k", "c.*")


@query(
    """with f as (select user_id as k, count(*) as n, round(avg(value), 3) as mean from events group by user_id)
    select 'eval-' || k || '.json' as name, timestamp '2024-01-01' + to_days(k::int) as modified, case when k % 5 > 1 then k end as run, case when k % 5 > 1 then n end as cases, case when k % 5 > 1 then mean end as score,
      case k % 5 when 0 then 'not JSON' when 1 then 'empty' end as problem from f"""
)
def evaluation_listing(spark, sf_dir):
    """Results of evaluations, a JSON text for each user; some are cut off, some empty."""
    f = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 3).alias("mean"))
    whole = F.to_json(F.struct(F.col("k").alias("run"), F.col("n").alias("cases"), F.col("mean").alias("score")))
    text = F.when(F.col("k") % 5 == 0, F.left(whole, F.length(whole) - 3)).when(F.col("k") % 5 == 1, " ").otherwise(whole)
    files = f.select(F.concat(F.lit("eval-"), F.col("k"), F.lit(".json")).alias("name"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("k").cast("int")).cast("timestamp_ntz").alias("modified"), text.alias("content"))
    return X.results_listed(files, "run long, cases long, score double")


@query(
    r"""with c as (select quality as t, (n_chars > 1200)::int as p, count(*) as n from labels join documents using (doc_id) group by 1, 2), l as (select distinct unnest([t, p]) as x from c),
    r as (select a.x as t, string_agg(coalesce(n, 0)::varchar, ' | ' order by b.x) as line from l a cross join l b left join c on c.t = a.x and c.p = b.x group by a.x)
    select '| label \ pred | ' || (select string_agg(x::varchar, ' | ' order by x) from l) || ' |' || chr(10) || '|---|' || repeat('---|', (select count(*) from l)::int) || chr(10) || string_agg('| ' || t || ' | ' || line || ' |', chr(10) order by t) as markdown from r"""
)
def evaluation_report(spark, sf_dir):
    return X.matrix_markdown(X.confusion(_predicted(spark, sf_dir), "quality", "predicted"), "quality", "predicted")
