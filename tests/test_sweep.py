import random

from pyspark.sql import functions as F

from foliant.operators import ordered
from foliant.operators import rules as R


def brute(rows, rules, passes):
    """Every threshold of every condition tried on every row."""
    label = lambda row, rs: next((r["label"] for r in rs if all(row[k[4:]] is not None and (row[k[4:]] >= v if k.startswith("min_") else row[k[4:]] <= v) for k, v in r["when"].items())), R.DEFAULT[1])
    right = lambda rs: sum(label(row, rs) == row["truth"] for row in rows)
    rules = [{**r, "when": dict(r["when"])} for r in rules]
    best = right(rules)
    for _ in range(passes):
        before = best
        for r in rules:
            for k in r["when"]:
                now = r["when"][k]
                seen = sorted({row[k[4:]] for row in rows if row[k[4:]] is not None})
                for c in sorted({(a + b) / 2 for a, b in zip(seen, seen[1:])} | {now}, key=lambda c: (abs(c - now), c)):
                    was = r["when"][k]
                    r["when"][k] = round(c, 4)
                    if (n := right(rules)) > best:
                        best = n
                    else:
                        r["when"][k] = was
        if best == before:
            break
    return rules, best / len(rows)


def test_thresholds_are_the_best(spark):
    rng = random.Random(5)
    rows = [{"a": rng.choice([None, *range(20)]), "b": rng.randrange(0, 64) / 8, "truth": None} for _ in range(300)]
    for r in rows:
        r["truth"] = "x" if (r["a"] or 0) > 12 and r["b"] < 6 else "y" if r["b"] > 3 and rng.random() < 0.9 else "mixed"
    rules = [{"id": "1", "label": "x", "when": {"min_a": 3, "max_b": 2.0}}, {"id": "2", "label": "y", "when": {"min_b": 7.5}}]
    df = spark.createDataFrame([(r["a"], r["b"], r["truth"]) for r in rows], "a int, b double, truth string")
    assert R.sweep(df, rules, "truth") == brute(rows, rules, 3)
    assert R.sweep(df.limit(0), rules, "truth") == (rules, 0.0)


def test_running_totals(spark):
    rng = random.Random(6)
    values = sorted({rng.randrange(10**6) / 7 for _ in range(3000)})
    df = spark.createDataFrame([(v, i % 13) for i, v in enumerate(values)], "x double, n long").repartition(8)
    got = {r.x: r.t for r in ordered.running_total(df, ["x"], "n", "t", 50).collect()}
    want, run = {}, 0
    for i, v in enumerate(values):
        run += i % 13
        want[v] = run
    assert got == want
    assert {r.x: r.p for r in ordered.with_previous(df.select("x"), "x", "p", 50).collect()} == dict(zip(values, [None, *values]))
    assert ordered.running_total(df.where(F.lit(False)), ["x"], "n", "t").count() == 0
