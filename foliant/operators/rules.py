"""Ordered classification rules compiled to Columns, with confidence and evidence; rule files and their changes."""

from __future__ import annotations

import copy
import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.operators import ordered

#: Rules in order, each with its label and least or most feature values; then what matches none.
PAGE_RULES = [
    {"id": "scanned", "label": "scanned", "when": {"max_text_chars": 50, "min_image_area_ratio": 0.5}},
    {"id": "table_dominant", "label": "table", "when": {"min_tables": 1, "min_table_area_ratio": 0.3}},
    {"id": "table_text_share", "label": "table", "when": {"min_tables": 1, "min_table_text_share": 0.5}},
    {"id": "vector_drawings", "label": "diagram", "when": {"min_drawings": 120}},
    {"id": "image_area", "label": "image_heavy", "when": {"min_image_area_ratio": 0.4}},
    {"id": "text_rich", "label": "text", "when": {"min_text_chars": 200}},
]
DEFAULT = ("fallback_mixed", "mixed", 0.4)
PARSERS = {"text": "text", "table": "table", "scanned": "vision", "diagram": "vision", "image_heavy": "vision", "mixed": "text"}
SETTINGS = {"heading_ratio": 1.15, "section_ratio": 0.15, "target": 512, "overlap": 64, "least": 128, "dominant": 0.6, "review": 0.6, "review_pages": 10, "chart_area": 0.3}


def _conditions(when: dict) -> list[tuple[str, bool, float]]:
    return [(k[4:], k.startswith("min_"), float(v)) for k, v in when.items()]


def _matches(when: dict) -> Column:
    out = F.lit(True)
    for name, least, value in _conditions(when):
        out = out & (F.col(name) >= value if least else F.col(name) <= value)
    return out


def _confidence(when: dict, digits) -> Column:
    """Half, and up to half more by the weakest condition's distance from its threshold."""
    margins = [F.abs(F.col(name) - value) / (abs(value) or 1.0) for name, _, value in _conditions(when)]
    weakest = F.least(*margins) if len(margins) > 1 else margins[0] if margins else F.lit(1.0)
    return digits(0.5 + 0.5 * F.least(weakest, F.lit(1.0)), 2)


def classified(df: DataFrame, rules: list[dict] = PAGE_RULES, half_even: bool = False) -> DataFrame:
    """df with rule_id, label and confidence of the first rule that matches."""
    missing = {n for r in rules for n, _, _ in _conditions(r["when"])} - set(df.columns)
    if missing:
        raise ValueError(f"features are missing: {sorted(missing)}")
    digits = F.bround if half_even else F.round
    chosen = F.struct(F.lit(DEFAULT[0]).alias("rule_id"), F.lit(DEFAULT[1]).alias("label"), F.lit(DEFAULT[2]).alias("confidence"))
    for r in reversed(rules):
        chosen = F.when(_matches(r["when"]), F.struct(F.lit(r["id"]).alias("rule_id"), F.lit(r["label"]).alias("label"), _confidence(r["when"], digits).alias("confidence"))).otherwise(chosen)
    return df.withColumn("_c", chosen).select(*df.columns, "_c.rule_id", "_c.label", "_c.confidence")


def evidence(rules: list[dict] = PAGE_RULES) -> Column:
    """The rules tried, up to the first that matched: struct(rule, matched, conditions(name, threshold, actual, met))."""
    tried = []
    for r in rules:
        met = [F.struct(F.lit(("min_" if least else "max_") + n).alias("name"), F.lit(v).alias("threshold"), F.col(n).cast("double").alias("actual"), F.coalesce(F.col(n) >= v if least else F.col(n) <= v, F.lit(False)).alias("met")) for n, least, v in _conditions(r["when"])]
        tried.append(F.struct(F.lit(r["id"]).alias("rule"), F.coalesce(_matches(r["when"]), F.lit(False)).alias("matched"), F.array(*met).alias("conditions")))
    every = F.array(*tried)
    first = F.array_position(F.transform(every, lambda x: x["matched"]), True).cast("int")
    return F.when(first > 0, F.slice(every, 1, first)).otherwise(every)


def second_opinion(label: Column, confidence: Column, other: Column, review: float = SETTINGS["review"]) -> Column:
    """struct(label, confidence) after a model's label for pages of low confidence; agreement and change both count."""
    asked = (confidence < review) & other.isNotNull()
    return F.struct(F.when(asked, other).otherwise(label).alias("label"), F.when(asked & (other == label), F.greatest(confidence, F.lit(0.7))).when(asked, F.lit(0.7)).otherwise(confidence).alias("confidence"))


def to_review(pages: DataFrame, order: list[str]) -> DataFrame:
    """The pages of lowest confidence under the review level, few enough for a model."""
    return pages.where(F.col("confidence") < SETTINGS["review"]).orderBy("confidence", *order).limit(SETTINGS["review_pages"])


def parser_for(label: Column, vision: bool = True) -> Column:
    """struct(parser, degraded): by label, with text in place of vision where there is no model."""
    found = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in PARSERS.items() for x in kv)), label), F.lit("text"))
    down = (found == "vision") & F.lit(not vision)
    return F.struct(F.when(down, "text").otherwise(found).alias("parser"), down.alias("degraded"))


def chart_label(label: Column, chart_area: Column) -> Column:
    """chart for diagrams and image pages that a chart figure covers enough of."""
    return F.when(label.isin("diagram", "image_heavy") & (F.coalesce(chart_area, F.lit(0.0)) >= SETTINGS["chart_area"]), "chart").otherwise(label)


def strategy(kind: Column, headings: Column, heading_ratio: Column) -> Column:
    """How to chunk a document by its format, whether it has headings, and how many pages begin one."""
    return F.when(kind.isin("slides", "sheet"), "page").when((kind == "word") & headings, "section").when(heading_ratio >= SETTINGS["section_ratio"], "section").otherwise("recursive")


def budgets(longest: Column) -> Column:
    """struct(target, overlap, least) of tokens, for a model's longest input."""
    target = F.least(F.lit(SETTINGS["target"]), longest - 16).cast("int")
    return F.struct(target.alias("target"), F.least(F.lit(SETTINGS["overlap"]), F.floor(target / 4).cast("int")).alias("overlap"), F.least(F.lit(SETTINGS["least"]), F.floor(target / 2).cast("int")).alias("least"))


def characters_per_token(characters: Column, tokens: Column) -> Column:
    """From a sample of 200 characters at least, within 0.8 and 6; else 2.5."""
    return F.when((characters >= 200) & (tokens > 0), F.round(F.least(F.greatest(characters / tokens, F.lit(0.8)), F.lit(6.0)), 3)).otherwise(2.5)


def profile(pages: DataFrame, by: str) -> DataFrame:
    """Per document: pages of each label, their share, and the label that dominates, or mixed; ties go by label."""
    counts = pages.groupBy(by, "label").agg(F.count(F.lit(1)).alias("pages"))
    totals = counts.groupBy(by).agg(F.sum("pages").alias("total"), F.max(F.struct("pages", (-F.ascii("label")).alias("early"), "label")).alias("top"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "pages")))).alias("labels"))
    share = F.round(F.col("top.pages") / F.col("total"), 3)
    return totals.select(by, "total", "labels", share.alias("share"), F.when(share >= SETTINGS["dominant"], F.concat(F.col("top.label"), F.lit("-dominant"))).otherwise("mixed").alias("profile"))


def validate(rules: list[dict]) -> list[str]:
    """What is wrong with a rule list; empty if nothing is."""
    wrong, seen = [], set()
    for i, r in enumerate(rules):
        where = f"rule {i + 1}"
        if not isinstance(r, dict) or {"id", "label", "when"} - set(r):
            wrong.append(f"{where}: id, label and when are needed")
            continue
        if r["id"] in seen:
            wrong.append(f"{where}: the id {r['id']} comes twice")
        seen.add(r["id"])
        for k, v in r["when"].items():
            if not k.startswith(("min_", "max_")) or len(k) < 5:
                wrong.append(f"{where}: {k} is no condition")
            elif isinstance(v, bool) or not isinstance(v, (int, float)):
                wrong.append(f"{where}: {k} is no number")
            elif "ratio" in k and not 0 <= v <= 1:
                wrong.append(f"{where}: {k} must be from 0 to 1")
            elif k.startswith("min_") and v > r["when"].get("max_" + k[4:], v):
                wrong.append(f"{where}: {k} is over its maximum")
    return wrong


def merged(base: dict, changes: dict) -> dict:
    """base with changes laid over it, key by key through nested dicts."""
    out = copy.deepcopy(base)
    for k, v in changes.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def difference(base: dict, wanted: dict) -> dict:
    """The least that merged() needs to make base into wanted (keys are never removed)."""
    out = {}
    for k, v in wanted.items():
        if isinstance(v, dict) and isinstance(base.get(k), dict):
            if inner := difference(base[k], v):
                out[k] = inner
        elif k not in base or base[k] != v:
            out[k] = copy.deepcopy(v)
    return out


def changed_paths(changes: dict, before: str = "") -> list[str]:
    return [p for k, v in sorted(changes.items()) for p in (changed_paths(v, f"{before}{k}.") if isinstance(v, dict) and v else [before + k])]


def version(rules) -> str:
    return hashlib.sha256(json.dumps(rules, sort_keys=True).encode()).hexdigest()[:12]


def _label(rules: list[dict]) -> Column:
    label = F.lit(DEFAULT[1])
    for r in reversed(rules):
        label = F.when(_matches(r["when"]), F.lit(r["label"])).otherwise(label)
    return label


def _best_threshold(pages: DataFrame, rules: list[dict], at: int, key: str, truth: str) -> tuple[int, float] | None:
    """(right pages, threshold) of the best threshold for one condition: all midpoints between the values that occur.

    With everything else fixed, a page is right or wrong if the condition holds, and if it doesn't. So the pages that
    are right under a threshold are a sum over the values on either side of it: one running total along the sorted
    distinct values serves all thresholds at once. Of equals, the threshold nearest the present one wins.
    """
    name, now = key[4:], float(rules[at]["when"][key])
    held = [{**r, "when": {k: v for k, v in r["when"].items() if k != key}} if i == at else r for i, r in enumerate(rules)]
    right = lambda some: F.coalesce(_label(some) == F.col(truth), F.lit(False)).cast("long")
    each = pages.select(F.col(name).cast("double").alias("x"), right(held).alias("yes"), right(rules[:at] + rules[at + 1 :]).alias("no"))
    no, gain = each.agg(F.sum("no"), F.sum(F.when(F.col("x").isNotNull(), F.col("yes") - F.col("no")))).first()
    values = each.where("x is not null").groupBy("x").agg(F.sum(F.col("yes") - F.col("no")).alias("gain"))
    middles = ordered.with_previous(values.select("x"), "x", "before").where("before is not null").select(((F.col("x") + F.col("before")) / 2).alias("c"))
    tries = middles.unionByName(pages.sparkSession.createDataFrame([(now,)], "c double")).distinct().select(F.bround("c", 4).alias("x"), F.abs(F.col("c") - now).alias("far"), "c")
    least = key.startswith("min_")
    # a threshold comes before values equal to it if they satisfy it as a least value, after them as a most
    both = values.select("x", F.lit(0).alias("side"), F.lit(0.0).alias("far"), "gain", F.lit(0.0).alias("c")).unionByName(tries.select("x", F.lit(-1 if least else 1).alias("side"), "far", F.lit(0).cast("long").alias("gain"), "c"))
    below = ordered.running_total(both, ["x", "side", "far", "c"], "gain", "below").where("side <> 0")
    total = F.lit((no or 0) + (gain or 0)) - F.col("below") if least else F.lit(no or 0) + F.col("below")
    best = below.select(total.alias("n"), F.struct(total, -F.col("far"), -F.col("c")).alias("k"), "x").agg(F.max("k").alias("k"), F.max_by(F.struct("n", "x"), "k").alias("b")).first()
    return None if best.b is None else (int(best.b.n), float(best.b.x))


def sweep(pages: DataFrame, rules: list[dict], truth: str, passes: int = 3) -> tuple[list[dict], float]:
    """Better thresholds by coordinate descent: (rules, accuracy).

    For each threshold in turn, every midpoint between the values observed is scored, rounded to four digits; the best
    is kept if it is right about more pages than before, of equals the nearest. Ends after a pass without change, or
    ``passes``. Only the counts and threshold of each best reach the driver. No pages give an accuracy of 0.
    """
    rules = copy.deepcopy(rules)
    n, best = pages.agg(F.count(F.lit(1)), F.sum((_label(rules) == F.col(truth)).cast("long"))).first()
    best = best or 0
    for _ in range(passes):
        before = best
        for i, r in enumerate(rules):
            for key in r["when"]:
                found = _best_threshold(pages, rules, i, key, truth)
                if found and found[0] > best:
                    best, r["when"][key] = found
        if best == before:
            break
    return rules, best / n if n else 0.0
