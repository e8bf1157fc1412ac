"""Relational reads, with customers as documents, orders as runs and line items as elements."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.operators import reads as R
from foliant.plans.registry import query, table


@query("select sha256(text) as sha256, count(*) as copies, min(doc_id) as first from documents where length(text) >= 1 group by sha256(text)")
def dedup_content(spark, sf_dir):
    docs = R.first_by_content(table(spark, sf_dir, "documents").where("length(text) >= 1"), "text", "doc_id")
    return docs.groupBy("sha256").agg(F.count(F.lit(1)).alias("copies"), F.min("first").alias("first"))


@query("select count(*) as documents, coalesce(sum(n_chars), 0)::bigint as size, coalesce(sum(length(text)), 0)::bigint as pages from documents")
def overview_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("size"), F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("long").alias("pages"))


@query("select coalesce(lang, '-') as format, count(*) as n, count(*) filter (source in ('src1', 'src2')) as active from documents group by 1")
def by_format(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.coalesce("lang", F.lit("-")).alias("format")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("source").isin("src1", "src2")).alias("active"))


@query("select o_orderstatus as status, count(*) as n, max(case o_orderstatus when 'F' then 3 when 'P' then 2 else 1 end)::int as severity from orders group by 1")
def by_status(spark, sf_dir):
    severity = F.when(F.col("o_orderstatus") == "F", 3).when(F.col("o_orderstatus") == "P", 2).otherwise(1)
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.max(severity).alias("severity"))


@query("select case max(case o_orderstatus when 'F' then 2 when 'P' then 1 else 0 end) when 2 then 'error' when 1 then 'warn' else 'ok' end as state, o_orderpriority as component from orders group by 2")
def worst_state(spark, sf_dir):
    severity = F.max(F.when(F.col("o_orderstatus") == "F", 2).when(F.col("o_orderstatus") == "P", 1).otherwise(0))
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("component")).agg(F.element_at(F.array(F.lit("ok"), F.lit("warn"), F.lit("error")), severity + 1).alias("state"))


@query("select o_custkey, o_orderkey from orders join (select o_custkey, max(o_orderdate) as d from orders group by o_custkey) t using (o_custkey) where o_orderdate = d")
def latest_per_key(spark, sf_dir):
    return R.latest_with_ties(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate").select("o_custkey", "o_orderkey")


_LATEST = "last as (select * from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as n from orders) where n = 1)"


@query(f"with {_LATEST} select count(*) as n, sum(l_quantity)::double as quantity from lineitem where l_orderkey in (select o_orderkey from last)")
def latest_semi(spark, sf_dir):
    last = R.latest(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey")
    items = table(spark, sf_dir, "lineitem").join(last.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    return items.agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


@query(f"with {_LATEST}, c as (select l_orderkey, count(*) as items from lineitem group by 1) select c_custkey, o_orderkey, coalesce(items, 0)::bigint as items from customer left join last on c_custkey = o_custkey left join c on l_orderkey = o_orderkey order by c_custkey desc limit 8")
def recent_with_counts(spark, sf_dir):
    recent = table(spark, sf_dir, "customer").select("c_custkey").orderBy(F.desc("c_custkey")).limit(8)
    runs = table(spark, sf_dir, "orders").join(recent.select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi")
    last = R.latest(runs, "o_custkey", "o_orderdate", "o_orderkey").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    wanted = table(spark, sf_dir, "lineitem").join(last.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    counts = wanted.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("items"))
    return recent.join(last, "c_custkey", "left").join(counts, "o_orderkey", "left").select("c_custkey", "o_orderkey", F.coalesce("items", F.lit(0)).alias("items"))


@query(f"with {_LATEST} select c_custkey, o_orderkey, case when o_orderkey is null then 'none' when o_orderstatus = 'F' then 'failed' when o_orderstatus = 'P' then 'active' else 'succeeded' end as state from customer left join last on c_custkey = o_custkey where contains(lower(c_name), '1')")
def sidebar_filter(spark, sf_dir):
    last = R.latest(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey").withColumnRenamed("o_custkey", "c_custkey")
    docs = table(spark, sf_dir, "customer").where(F.contains(F.lower("c_name"), F.lit("1"))).select("c_custkey")
    state = F.when(F.col("o_orderkey").isNull(), "none").when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "P", "active").otherwise("succeeded")
    return docs.join(last, "c_custkey", "left").select("c_custkey", "o_orderkey", state.alias("state"))


@query(f"with {_LATEST} select c_custkey, o_orderkey, (o_orderstatus in ('O', 'P')) is true as reuse from customer left join last on c_custkey = o_custkey")
def reuse_or_queue(spark, sf_dir):
    last = R.latest(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey").withColumnRenamed("o_custkey", "c_custkey")
    return table(spark, sf_dir, "customer").join(last, "c_custkey", "left").select("c_custkey", "o_orderkey", F.coalesce(F.col("o_orderstatus").isin("O", "P"), F.lit(False)).alias("reuse"))


@query("select l_returnflag as type, l_linestatus as tool, l_linenumber::bigint as page, grouping_id(l_linenumber, l_returnflag, l_linestatus)::bigint as level, count(*) as n, coalesce(sum(length(l_returnflag)), 0)::bigint as chars from lineitem group by grouping sets ((l_linenumber, l_returnflag), (l_linenumber, l_linestatus), (l_linenumber), (l_returnflag), ())")
def element_stats_grouping_sets(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("long").alias("page"), F.col("l_returnflag").alias("type"), F.col("l_linestatus").alias("tool"), F.col("l_returnflag").alias("content"))
    return R.element_counts(e).withColumn("level", F.col("level").cast("long")).withColumn("chars", F.col("chars").cast("long"))


@query("with c as (select l_suppkey as page, count(*) as n, sum(length(l_linestatus)) as chars from lineitem where l_returnflag = 'R' and l_quantity > 49 group by 1) select coalesce(s_suppkey, page) as page, s_name as label, coalesce(n, 0)::bigint as n, coalesce(chars, 0)::bigint as chars from (select * from supplier where s_acctbal > 0) full outer join c on s_suppkey = page")
def element_stats_full_outer(spark, sf_dir):
    profiles = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("page"), F.col("s_name").alias("label"))
    e = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity > 49").select(F.col("l_suppkey").alias("page"), F.col("l_linestatus").alias("content"))
    return R.pages_with_elements(profiles, e)


@query("select p_partkey, p_name, count(*) over () as total from part where p_size = 7 order by p_partkey limit 10 offset 5")
def paged_list(spark, sf_dir):
    return R.page_of(R.by_predicates(table(spark, sf_dir, "part"), p_size=7, p_brand=None).select("p_partkey", "p_name"), [F.col("p_partkey")], 5, 10)


@query("select event_id, user_id, event_type from events where event_id > 100 and user_id = 5")
def events_after_cursor(spark, sf_dir):
    e = R.by_predicates(table(spark, sf_dir, "events").where("event_id > 100"), user_id=5, event_type=None)
    return e.select("event_id", "user_id", "event_type").orderBy("event_id")


@query("select user_id, event_type, max(event_id) as event_id, arg_max(value, event_id) as value from events where value is not null group by 1, 2")
def latest_progress(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("value is not null")
    return e.groupBy("user_id", "event_type").agg(F.max("event_id").alias("event_id"), F.max_by("value", "event_id").alias("value"))


@query("with last as (select user_id, max(event_id) as event_id from events where event_type = 'view' group by 1) select event_id, event_type from events where event_type <> 'view' or event_id in (select event_id from last)")
def event_log_filter(spark, sf_dir):
    """All events, but of one kind only the last of each user."""
    e = table(spark, sf_dir, "events")
    last = e.where("event_type = 'view'").groupBy("user_id").agg(F.max("event_id").alias("event_id"))
    views = e.where("event_type = 'view'").join(last.select("event_id"), "event_id", "left_semi")
    return e.where("event_type <> 'view'").select("event_id", "event_type").unionByName(views.select("event_id", "event_type"))


_KIND = "case event_type when 'view' then 'started' when 'click' then 'finished' when 'purchase' then 'run_finished' when 'signup' then 'error' end"


@query(
    f"""with k as (select user_id, (value > 50)::int as step, event_id, {_KIND} as kind from events),
    over_ as (select distinct user_id from k where kind = 'run_finished'),
    last as (select user_id, step, arg_max(kind, event_id) as kind from k where kind in ('started', 'finished', 'error') group by 1, 2)
    select l.user_id, l.step, case kind when 'finished' then 'done' when 'error' then 'failed' else case when o.user_id is not null then 'stopped' else 'running' end end as state
    from last l left join over_ o on l.user_id = o.user_id"""
)
def step_state(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("step", (F.col("value") > 50).cast("int"))
    return R.step_states(e, ["user_id", "step"], F.expr(_KIND), F.col("event_id"))


@query("select user_id, avg((d >= 0)::int)::double as share, median(d) as step from (select user_id, value - lag(value) over (partition by user_id order by event_id) as d from events) where d is not null group by 1")
def monotonic_share(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("event_id")
    d = table(spark, sf_dir, "events").select("user_id", (F.col("value") - F.lag("value").over(w)).alias("d")).where("d is not null")
    return d.groupBy("user_id").agg(F.avg((F.col("d") >= 0).cast("int")).alias("share"), F.median("d").alias("step"))


@query("select user_id, min(event_id) as first from (select user_id, event_id, avg(value) over (partition by user_id order by event_id rows between current row and 3 following) as m from events) where m >= 60 group by 1")
def rolling_level(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(0, 3)
    m = table(spark, sf_dir, "events").select("user_id", "event_id", F.avg("value").over(w).alias("m"))
    return m.where("m >= 60").groupBy("user_id").agg(F.min("event_id").alias("first"))


@query("select l_linestatus, min(l_quantity) as low, max(l_quantity) as high, round(avg(l_quantity), 6) as mean, count(distinct l_quantity) as kinds, count(*) filter (isnan(l_tax)) as odd, avg((l_comment_ok)::int)::double as printable from (select *, regexp_matches(l_returnflag, '^[ -~]*$') as l_comment_ok from lineitem) group by 1")
def column_stats(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity")
    return i.groupBy("l_linestatus").agg(F.min(q).alias("low"), F.max(q).alias("high"), F.round(F.avg(q), 6).alias("mean"), F.count_distinct(q).alias("kinds"), F.count_if(F.isnan("l_tax")).alias("odd"), F.avg(F.rlike("l_returnflag", F.lit("^[ -~]*$")).cast("int")).alias("printable"))


@query("select * exclude (c_mktsegment), (c_mktsegment is not null and c_mktsegment <> '') as has_c_mktsegment from customer")
def masked_rows(spark, sf_dir):
    return R.without_secrets(table(spark, sf_dir, "customer"), "c_mktsegment")


@query("select c_custkey, c_name from customer where c_custkey::varchar = '000000017' or c_name = '000000017' or ends_with(c_name, '_000000017') or ends_with('000000017', '_' || c_name) or c_name like '%#000000017' order by c_custkey desc limit 1")
def resolve_name(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("name", F.replace("c_name", F.lit("#"), F.lit("_")))
    return R.resolve(c, "000000017", "c_custkey", "name", "c_custkey").select("c_custkey", "c_name")


@query("with gone as (select c_custkey from customer where c_nationkey = 3) select 'documents' as name, count(*) as rows from gone union all select 'runs', count(*) from orders where o_custkey in (select c_custkey from gone)")
def purge_counts(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    gone = c.where("c_nationkey = 3").select("c_custkey")
    return R.purge_counts(c, {"runs": (table(spark, sf_dir, "orders"), "o_custkey")}, gone, "c_custkey")


@query("select o_orderkey from orders where o_custkey not in (select c_custkey from customer where c_nationkey = 3)")
def purge_survivors(spark, sf_dir):
    gone = table(spark, sf_dir, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    return R.survivors(table(spark, sf_dir, "orders"), gone, "o_custkey").select("o_orderkey")


@query("select x as c_custkey from (values (999999999), (-4)) t(x) where x not in (select c_custkey from customer)")
def missing_ids(spark, sf_dir):
    _, missing = R.ordered_distinct([1, 999999999, 1, -4], table(spark, sf_dir, "customer"), "c_custkey")
    return missing.select(F.col("c_custkey").cast("int").alias("c_custkey"))


@query("select metric, name, value, low <> high and value = case when metric = 'acctbal' then low else high end as best from (select *, min(value) over (partition by metric) as low, max(value) over (partition by metric) as high from (select 'acctbal' as metric, s_name as name, s_acctbal as value from supplier union all select 'nation', s_name, s_nationkey::double from supplier))")
def best_values(spark, sf_dir):
    from foliant.operators.evaluation import best_values as best

    s = table(spark, sf_dir, "supplier")
    rows = s.select(F.lit("acctbal").alias("metric"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("value")).unionByName(s.select(F.lit("nation").alias("metric"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("double").alias("value")))
    return best(rows, "metric", "value", F.col("metric") == "acctbal")


@query("select event_id, round(epoch_ms(ts)::double / 1000, 2) - round(epoch_ms(lag(ts) over (partition by user_id order by event_id))::double / 1000, 2) is not null as timed, (epoch(ts) between 946684800 and 4102444800) as plausible from events")
def elapsed_times(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("event_id")
    t = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", (t - F.lag(t).over(w)).isNotNull().alias("timed"), t.between(946684800, 4102444800).alias("plausible"))


@query("select o_custkey, list(o_orderkey order by o_orderdate, o_orderkey)[1] as first, count(*) as runs, avg(o_totalprice) filter (o_orderstatus = 'O') as mean from orders group by 1")
def run_summary(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first"), F.count(F.lit(1)).alias("runs"), F.avg(F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice"))).alias("mean"))


@query("select doc_id, n_chars > 0 as kept from documents")
def empty_uploads(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") > 0).alias("kept"))
