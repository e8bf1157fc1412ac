"""Page classification over documents, with features derived from their texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import evidence as E
from foliant.operators import rules as R
from foliant.plans.registry import query, scratch, table

_FEATURES = r"""feat as (select doc_id, source, lang, n_chars as text_chars, len(regexp_extract_all(text, '[|]')) as tables, len(regexp_extract_all(text, '\d')) as drawings,
  least(len(regexp_extract_all(text, '[!#*&%$]'))::double / greatest(n_chars, 1) * 8, 1.0::double) as image_area_ratio,
  least(len(regexp_extract_all(text, '[|]'))::double / greatest(n_chars, 1) * 9, 1.0::double) as table_area_ratio,
  least(len(regexp_extract_all(text, '[|]'))::double / greatest(n_chars, 1) * 12, 1.0::double) as table_text_share from documents)"""


def _margin(name: str, value: float) -> str:
    return f"abs({name} - {value}::double) / {abs(value) or 1}::double"


def _case(rules=R.PAGE_RULES) -> str:
    ids, labels, confidence = [], [], []
    for r in rules:
        cond = " and ".join(f"{k[4:]} {'>=' if k.startswith('min_') else '<='} {v}" for k, v in r["when"].items())
        least = "least(1.0::double, " + ", ".join(_margin(k[4:], v) for k, v in r["when"].items()) + ")"
        ids.append(f"when {cond} then '{r['id']}'")
        labels.append(f"when {cond} then '{r['label']}'")
        confidence.append(f"when {cond} then round(0.5::double + 0.5::double * {least}, 2)")
    return f"case {' '.join(ids)} else '{R.DEFAULT[0]}' end as rule_id, case {' '.join(labels)} else '{R.DEFAULT[1]}' end as label, case {' '.join(confidence)} else {R.DEFAULT[2]}::double end as confidence"


def features(spark, sf_dir):
    return _features(table(spark, sf_dir, "documents"), "doc_id", "source", "lang", chars=F.col("n_chars"))


def _features(texts, *keep, chars):
    t = F.col("text")
    bars, n = F.regexp_count(t, F.lit("[|]")), F.greatest(chars, F.lit(1))
    held = lambda x: F.least(x, F.lit(1.0))
    return texts.select(
        *keep, chars.alias("text_chars"), bars.alias("tables"), F.regexp_count(t, F.lit(r"\d")).alias("drawings"),
        held(F.regexp_count(t, F.lit("[!#*&%$]")) / n * 8).alias("image_area_ratio"), held(bars / n * 9).alias("table_area_ratio"), held(bars / n * 12).alias("table_text_share"),
    )


@query(f"with {_FEATURES} select doc_id, {_case()} from feat")
def classify_pages(spark, sf_dir):
    return R.classified(features(spark, sf_dir)).select("doc_id", "rule_id", "label", "confidence")


@query(f"with {_FEATURES}, c as (select doc_id, {_case()} from feat) select doc_id, case rule_id " + " ".join(f"when '{r['id']}' then {i + 1}" for i, r in enumerate(R.PAGE_RULES)) + f" else {len(R.PAGE_RULES)} end as tried, rule_id <> '{R.DEFAULT[0]}' as matched from c")
def classify_evidence(spark, sf_dir):
    e = features(spark, sf_dir).select("doc_id", R.evidence().alias("e"))
    return e.select("doc_id", F.size("e").alias("tried"), F.element_at("e", -1)["matched"].alias("matched"))


@query(
    f"""with {_FEATURES}, c as (select doc_id, source, {_case()} from feat), n as (select source, label, count(*) as pages from c group by 1, 2),
    t as (select source, sum(pages)::bigint as total, arg_max(label, (pages, -ascii(label))) as top, max(pages) as most from n group by 1)
    select source, total, round(most / total, 3) as share, case when round(most / total, 3) >= 0.6 then top || '-dominant' else 'mixed' end as profile from t"""
)
def doc_profile(spark, sf_dir):
    return R.profile(R.classified(features(spark, sf_dir)), "source").select("source", "total", "share", "profile")


@query(f"with {_FEATURES}, c as (select doc_id, {_case()} from feat) select doc_id, case label when 'table' then 'table' when 'scanned' then 'text' when 'diagram' then 'text' when 'image_heavy' then 'text' else 'text' end as parser, label in ('scanned', 'diagram', 'image_heavy') as degraded, case when label in ('diagram', 'image_heavy') then 'chart' else label end as relabelled from c")
def parser_map(spark, sf_dir):
    c = R.classified(features(spark, sf_dir))
    return c.select("doc_id", R.parser_for(F.col("label"), vision=False)["parser"].alias("parser"), R.parser_for(F.col("label"), vision=False)["degraded"].alias("degraded"), R.chart_label(F.col("label"), F.lit(0.4)).alias("relabelled"))


@query(f"with {_FEATURES}, c as (select doc_id, {_case()} from feat) select doc_id, label, confidence from c where confidence < 0.6 order by confidence, doc_id limit 10")
def low_confidence(spark, sf_dir):
    return R.to_review(R.classified(features(spark, sf_dir)), ["doc_id"]).select("doc_id", "label", "confidence")


@query(f"with {_FEATURES}, c as (select doc_id, {_case()}, case when doc_id % 3 = 0 then 'text' when doc_id % 3 = 1 then 'table' end as other from feat) select doc_id, case when confidence < 0.6 and other is not null then other else label end as label, case when confidence < 0.6 and other = label then greatest(confidence, 0.7::double) when confidence < 0.6 and other is not null then 0.7::double else confidence end as confidence from c")
def second_opinion(spark, sf_dir):
    other = F.when(F.col("doc_id") % 3 == 0, "text").when(F.col("doc_id") % 3 == 1, "table")
    c = R.classified(features(spark, sf_dir)).select("doc_id", R.second_opinion(F.col("label"), F.col("confidence"), other).alias("s"))
    return c.select("doc_id", "s.label", "s.confidence")


@query("select doc_id, case when lang = 'fr' then 'page' when lang = 'de' and n_chars > 1000 then 'section' when (n_chars % 100) / 400.0 >= 0.15 then 'section' else 'recursive' end as strategy from documents")
def strategy_choice(spark, sf_dir):
    kind = F.when(F.col("lang") == "fr", "slides").when(F.col("lang") == "de", "word").otherwise("pdf")
    return table(spark, sf_dir, "documents").select("doc_id", R.strategy(kind, F.col("n_chars") > 1000, F.col("n_chars") % 100 / 400).alias("strategy"))


@query("select doc_id, t as target, least(64, floor(t / 4.0))::int as overlap, least(128, floor(t / 2.0))::int as least, case when n_chars >= 200 and n > 0 then round(least(greatest(n_chars / n, 0.8::double), 6.0::double), 3) else 2.5::double end as per_token from (select doc_id, n_chars, least(512, n_chars - 16)::int as t, ceil(n_chars / 2.2::double) as n from documents)")
def budget(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("b", R.budgets(F.col("n_chars")))
    return docs.select("doc_id", "b.target", "b.overlap", "b.least", R.characters_per_token(F.col("n_chars"), F.ceil(F.col("n_chars") / 2.2)).alias("per_token"))


#: Rules whose thresholds are fitted, in order.
_FITTED = [
    {"id": "vector_drawings", "label": "diagram", "when": {"min_drawings": 120}},
    {"id": "table_share", "label": "table", "when": {"min_table_area_ratio": 0.3, "max_text_chars": 900}},
    {"id": "text_rich", "label": "text", "when": {"min_text_chars": 200}},
]
_TRUTH = "case when drawings >= 40 and doc_id % 9 <> 0 then 'diagram' when table_area_ratio >= 0.05 and text_chars <= 2000 and doc_id % 7 <> 0 then 'table' when text_chars >= 900 then 'text' else 'mixed' end"


def _fitted_sql(passes: int) -> str:
    """Every midpoint against every page, threshold after threshold: a table for each, with all thresholds so far."""
    keys = [(i, k) for i, r in enumerate(_FITTED) for k in r["when"]]
    named = {x: f"t{n}" for n, x in enumerate(keys)}
    cond = lambda i, k, t: f"{k[4:]} {'>=' if k.startswith('min_') else '<='} {t}"

    def label(at=None, key=None, to="c"):
        cases = [f"when {' and '.join(cond(i, k, to if (i, k) == (at, key) else named[i, k]) for k in r['when'])} then '{r['label']}'" for i, r in enumerate(_FITTED)]
        return f"case {' '.join(cases)} else '{R.DEFAULT[1]}' end"

    all_names = list(named.values())
    first = ", ".join(f"{float(_FITTED[i]['when'][k])}::double as {named[i, k]}" for i, k in keys)
    out = [f"s0 as (select {first}, (select count(*) filter ({label()} = truth) from p, (select {first})) as best)"]
    step = 0
    for _ in range(passes):
        for i, k in keys:
            name, now = k[4:], named[i, k]
            tries = f"select distinct c, abs(c - {now}) as far from (select (v + lag(v) over (order by v)) / 2 as c from (select distinct {name}::double as v from p)), s{step} where c is not null union select {now}, 0.0::double from s{step}"
            scored = f"select round_even(raw.c, 4) as c, far, raw.c as raw, (select count(*) filter ({label(i, k, 'round_even(raw.c, 4)')} = truth) from p) as n from ({tries}) raw, s{step}"
            rest = ", ".join(f"s.{x}" for x in all_names if x != now)
            out.append(f"s{step + 1} as (select {rest}, case when z.n > s.best then z.c else s.{now} end as {now}, greatest(z.n, s.best) as best from s{step} s, (select * from ({scored}) order by n desc, far, raw limit 1) z)")
            step += 1
    rows = " union all ".join(f"select '{_FITTED[i]['id']}' as rule_id, '{k}' as condition, {named[i, k]} as threshold, best / (select count(*) from p)::double as accuracy from s{step}" for i, k in keys)
    return f"with {_FEATURES}, p as (select *, {_TRUTH} as truth from feat), {', '.join(out)} {rows}"


@query(_fitted_sql(1))
def threshold_sweep(spark, sf_dir):
    """Thresholds of three rules fitted to labels that differ from theirs, and the accuracy reached after a pass."""
    rules, best = R.sweep(features(spark, sf_dir).withColumn("truth", F.expr(_TRUTH)), _FITTED, "truth", 1)
    rows = [(r["id"], k, float(v), best) for r in rules for k, v in r["when"].items()]
    return spark.createDataFrame(rows, "rule_id string, condition string, threshold double, accuracy double")


#: Characters of a piece, and under how many it is short.
_PIECE, _SHORT = 500, 100
_PIECES = f"""pieces as (select doc_id, i as seq, '' as source, '' as lang, substr(text, i * {_PIECE} + 1, {_PIECE}) as text, length(substr(text, i * {_PIECE} + 1, {_PIECE})) as n_chars
    from (select doc_id, text, unnest(range(0, ceil(length(text) / {_PIECE}.0)::bigint)) as i from documents)),
  {_FEATURES.replace("from documents", "from pieces")}, labelled as (select {_case()} from feat), lone as (select count(distinct text) as n from pieces)"""
_LABELS = ("scanned", "table", "diagram", "image_heavy", "text", "mixed")


def _staged(spark, sf_dir):
    """Documents are cut, pieces are classified, and of equal pieces one stays; the run that did so."""
    run = E.Run(spark, "staged", scratch(spark, "staged"))
    run.emit("queued")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = run.stage("cut", docs, lambda d: d.select("doc_id", F.posexplode(T.fixed_cuts(F.col("text"), _PIECE)).alias("seq", "text")), {"short": F.count_if(F.length("text") < _SHORT), "documents": F.count_if(F.col("seq") == 0)})
    label = lambda d: R.classified(_features(d, "doc_id", "seq", "text", chars=F.length("text")))
    counts = {**{f"label_{x}": F.count_if(F.col("label") == x) for x in _LABELS}, "to_review": F.count_if(F.col("confidence") < R.SETTINGS["review"])}
    seen = run.stage("classify", cut, label, counts, lambda f: [E.Decision("pages to review", f"{f['to_review']} of {f['rows']}", "low_confidence", {"least": R.SETTINGS["review"]}, confidence=0.6)])
    one = lambda d: d.groupBy("text").agg(F.min_by(F.struct("doc_id", "seq", "label"), F.struct("doc_id", "seq")).alias("x")).select("x.*", "text")
    run.stage("unique", seen, one, decide=lambda f: [E.Decision("equal pieces", f"merged {f['rows_in']} -> {f['rows']}", "exact_text", {"before": f["rows_in"], "after": f["rows"]}, ["keep every copy"], 1.0)])
    run.finish()
    return run.read()


@query(
    f"""with {_PIECES} select 'cut' as step, 'rows' as figure, count(*)::varchar as value from pieces union all select 'cut', 'short', count(*) filter (n_chars < {_SHORT})::varchar from pieces
    union all select 'cut', 'documents', count(*) filter (seq = 0)::varchar from pieces union all select 'classify', 'rows', count(*)::varchar from labelled
    union all select 'classify', 'to_review', count(*) filter (confidence < {R.SETTINGS["review"]})::varchar from labelled union all select 'unique', 'rows', n::varchar from lone """
    + " ".join(f"union all select 'classify', 'label_{x}', count(*) filter (label = '{x}')::varchar from labelled" for x in _LABELS)
)
def stage_figures(spark, sf_dir):
    """What each stage of a run has counted while it wrote its result."""
    return E.figures(_staged(spark, sf_dir)).where("figure <> 'seconds'").select("step", "figure", "value")


@query(
    f"""with {_PIECES}, c as (select count(*) as n, count(*) filter (confidence < {R.SETTINGS["review"]}) as low from labelled)
    select 4::bigint as event_id, 'classify' as step, 'pages to review' as subject, low || ' of ' || c.n as choice, 'low_confidence' as rule_id, '{{"least": {R.SETTINGS["review"]}}}' as inputs, 0 as alternatives, 0.6::double as confidence from c
    union all select 7, 'unique', 'equal pieces', 'merged ' || c.n || ' -> ' || lone.n, 'exact_text', '{{"before": ' || c.n || ', "after": ' || lone.n || '}}', 1, 1.0 from c, lone"""
)
def stage_decisions(spark, sf_dir):
    """What a run has decided, with its evidence, numbered among all its events."""
    return E.decisions(_staged(spark, sf_dir)).select("event_id", "step", "subject", "choice", "rule_id", "inputs", F.size("alternatives").alias("alternatives"), "confidence")


@query(
    """select p_partkey % 50 as tool, count(*) as calls, count(*) filter (l_returnflag = 'R') as errors, count(*) filter (l_linestatus = 'O' and l_quantity > 40) as truncated, count(*) filter (l_linestatus = 'F' and l_quantity > 45) as retried,
    round(sum(l_quantity::double) filter (l_returnflag <> 'R') / nullif(count(*) filter (l_returnflag <> 'R'), 0), 2) as avg_seconds, round(sum(l_orderkey) / 1048576.0::double, 1) as mb
    from lineitem join part on l_partkey = p_partkey group by 1"""
)
def call_stats(spark, sf_dir):
    """Line items as calls of tools: returned ones have failed."""
    i = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey")), "l_partkey")
    big = F.col("l_quantity").cast("double")
    calls = i.select((F.col("l_partkey") % 50).alias("tool"), (F.col("l_returnflag") != "R").alias("ok"), ((F.col("l_linestatus") == "O") & (big > 40)).alias("truncated"), ((F.col("l_linestatus") == "F") & (big > 45)).alias("retried"), big.alias("seconds"), F.col("l_orderkey").alias("bytes"))
    return E.call_stats(calls, ["tool"])
