import re

from foliant.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fill(sizes, weights, cap):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > cap * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in free}
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        free -= over
    return target


def check(spark, rows, weights=(5, 2, 1), cap=3):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, text string, size string")
    got = mixing.mix(docs, weights, cap).collect()
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    want = fill(sizes, weights, cap)
    assert len(got) == len(rows)
    for s in sizes:
        mine = [r for r in got if r.source == s]
        assert all(abs(r.target - want[s]) < 1e-6 * max(1, want[s]) and r.source_size == sizes[s] for r in mine)
        assert abs(sum(r.taken for r in mine) - want[s]) <= max((r.size for r in mine), default=0)
        assert all(0 <= r.taken <= cap * r.size for r in mine)
    again = mixing.mix(docs, weights, cap).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_against_sharing_by_hand(spark):
    rows = [(i, f"s{i % 7}" if i % 11 else None, "w " * (i % 37)) for i in range(900)]
    check(spark, rows)
    check(spark, [(i, "hot" if i % 3 else f"s{i % 5}", "a b c " * (i % 9)) for i in range(400)], (1, 9), 2)
    check(spark, [(1, "b", None), (2, "a", "one two"), (None, "a", "x"), (2, "a", "one two"), (3, None, " "), (4, "c", "")])


def test_rates_of_any_cap(spark):
    """Newton's multipliers against the logarithm of target by size, which they must come to."""
    rows = [(i, "big" if i % 50 else "small", "w " * (1 + i % 7)) for i in range(600)]
    for cap in (1, 3, 70, 1000):
        docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
        got = mixing.mix(docs, (1, 5000), cap).select("source", "source_size", "target", "rate").distinct().collect()
        assert len(got) == 2
        assert all(abs(r.rate * r.source_size / r.target - 1) < 1e-9 for r in got)
        check(spark, rows, (1, 5000), cap)


def test_long_text_beside_others(spark):
    check(spark, [(1, "a", "word " * 300_000), (2, "a", "b c"), (3, "b", "d e f")] + [(i, "c", "g h") for i in range(4, 40)])


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.mix(docs).count() == 0
