import pytest
from pyspark.sql import functions as F

from foliant.operators import evidence as E


def test_stages_log_what_they_made(spark, tmp_path):
    run = E.Run(spark, "r", str(tmp_path))
    df = spark.range(100)
    kept = run.stage("keep", df, lambda d: d.where("id % 3 = 0"), {"even": F.count_if(F.col("id") % 2 == 0)})
    run.stage("sum", kept, lambda d: d.repartition(5).groupBy((F.col("id") % 2).alias("k")).agg(F.sum("id").alias("s")), decide=lambda f: [E.Decision("rows", f"{f['rows_in']} to {f['rows']}", inputs=f, alternatives=["none"], confidence=0.5)])
    assert {(r.step, r.figure): r.value for r in E.figures(run.read()).where("figure <> 'seconds'").collect()} == {("keep", "rows"): "34", ("keep", "even"): "17", ("sum", "rows"): "2"}
    d = E.decisions(run.read()).first()
    assert (d.choice, d.rule_id, d.alternatives, d.confidence, d.inputs) == ("34 to 2", None, ["none"], 0.5, '{"rows": 2, "rows_in": 34}')
    with pytest.raises(Exception):
        run.stage("bad", kept, lambda d: d.select(F.raise_error(F.lit("broken")).alias("x"), "id"))
    log = [(r.type, r.step) for r in run.read().orderBy("event_id").collect()]
    assert log == [("step_started", "keep"), ("step_finished", "keep"), ("step_started", "sum"), ("decision", "sum"), ("step_finished", "sum"), ("step_started", "bad"), ("error", "bad"), ("run_finished", None)]
    assert "broken" in run.read().where("type = 'error'").first().message and run.read().where("type = 'run_finished'").first().message == "failed"


def test_calls(spark):
    calls = spark.createDataFrame([("a", True, False, True, 2.0, 1 << 20), ("a", True, True, False, 4.0, 1 << 20), ("a", False, False, False, 99.0, 0), ("b", None, None, None, None, None)], "tool string, ok boolean, truncated boolean, retried boolean, seconds double, bytes long")
    assert sorted(tuple(r) for r in E.call_stats(calls, ["tool"]).collect()) == [("a", 3, 1, 1, 1, 3.0, 2.0), ("b", 1, 1, 0, 0, None, None)]
