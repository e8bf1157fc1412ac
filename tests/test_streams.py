import pytest

from foliant.streaming import events as V
from foliant.streaming import follow as L
from foliant.streaming import queue as Q


def rows(*events):
    return [(i, run, None, kind, step, "", done, total) for i, run, kind, step, done, total in events]


def test_replay_and_follow(spark, tmp_path):
    log, seen = str(tmp_path / "log"), []
    df = lambda *e: spark.createDataFrame(rows(*e), V.EVENTS)
    V.append(df((1, "r", "queued", None, None, None), (2, "r", "running", None, None, None)), log)
    each = lambda b, _: seen.extend(r.event_id for r in b.collect())
    assert V.wait(V.replay(V.follow(spark, log, after=1), str(tmp_path / "c"), each), 60)
    V.append(df((3, "r", "succeeded", None, None, None)), log)
    assert V.wait(V.replay(V.follow(spark, log, after=1), str(tmp_path / "c"), each), 60)
    assert seen == [2, 3]


def test_run_states(spark, tmp_path):
    log = str(tmp_path / "log")
    V.append(spark.createDataFrame(rows((1, "a", "queued", None, None, None), (2, "a", "running", None, None, None), (3, "b", "queued", None, None, None), (4, "a", "succeeded", None, None, None), (5, "a", "running", None, None, None), (6, "b", "cancelled", None, None, None)), V.EVENTS), log)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    q = V.run_states(V.follow(spark, log)).writeStream.format("memory").queryName("run_states").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.event_id: (r.accepted, r.state) for r in spark.table("run_states").collect()}
    assert got == {1: (True, "queued"), 2: (True, "running"), 3: (True, "queued"), 4: (True, "succeeded"), 5: (False, "succeeded"), 6: (True, "cancelled")}


def test_step_states(spark, tmp_path):
    log = str(tmp_path / "log")
    V.append(spark.createDataFrame(rows((1, "a", "step_started", "parse", None, None), (2, "a", "progress", "parse", 3, 9), (3, "a", "progress", "parse", 5, 9), (4, "a", "step_finished", "parse", None, None), (5, "a", "step_started", "chunk", None, None), (6, "a", "error", "chunk", None, None)), V.EVENTS), log)
    q = V.step_states(V.follow(spark, log)).writeStream.format("memory").queryName("steps").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.step: (r.state, r.progress and r.progress.done) for r in spark.table("steps").collect()}
    assert got == {"parse": ("done", 5), "chunk": ("failed", None)}


@pytest.fixture
def keyed(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def drained(stream, tmp_path, name, mode="append"):
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-c")).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(str(tmp_path / name))


def test_followed_once_up_to_the_end(spark, tmp_path, keyed):
    log = str(tmp_path / "log")
    df = lambda *e: spark.createDataFrame(rows(*((i, r, t, None, None, None) for i, r, t in e)), V.EVENTS)
    V.append(df((1, "a", "x"), (2, "b", "x"), (3, "a", "x"), (4, "a", "x")), log)
    made = lambda name, **more: sorted((r.event_id, r.run_id) for r in drained(L.followed(L.log(spark, log, **more)), tmp_path, name).collect())
    assert made("all", after=1) == [(2, "b"), (3, "a"), (4, "a")]
    V.append(df((3, "a", "x"), (4, "a", "x"), (5, "b", "x"), (6, "a", "run_finished"), (7, "a", "x"), (7, "b", "x"), (5, "b", "x")), log)
    assert made("all", after=1) == [(2, "b"), (3, "a"), (4, "a"), (5, "b"), (6, "a"), (7, "b")]
    V.append(df((8, "a", "x"), (9, "c", "x")), log)
    assert made("all", after=1) == [(2, "b"), (3, "a"), (4, "a"), (5, "b"), (6, "a"), (7, "b"), (9, "c")]
    assert made("one", run_id="b") == [(2, "b"), (5, "b"), (7, "b")]
    reader = L.LogReader({"path": log}, L.log(spark, log).schema)
    assert len(list(reader.partitions({"id": 8}, {"id": 9}))) < len(list(reader.partitions({"id": -1}, {"id": 9})))


def test_one_run_at_a_time(spark, tmp_path, keyed):
    log = str(tmp_path / "log")
    hour = 3600
    df = lambda *e: spark.createDataFrame([(q, i, float(at + hour), t, r) for i, (q, at, t, r) in e], "queue string, event_id long, s double, type string, run_id string").selectExpr("queue", "event_id", "timestamp_seconds(s) ts", "type", "run_id")
    first = [("q", 0, "submit", "1"), ("q", 1, "submit", "2"), ("q", 2, "submit", "3"), ("q", 3, "submit", "4"), ("q", 4, "cancel", "3"), ("q", 5, "succeed", "2"), ("q", 6, "succeed", "1"), ("p", 6, "submit", "9")]
    second = [("q", 7, "cancel", "2"), ("q", 8, "submit", "5"), ("p", 3 * hour, "tick", None)]
    third = [("q", 4 * hour, "submit", "6"), ("q", 4 * hour + 1, "fail", "6")]
    messages = list(enumerate(first + second + third))
    changes = []
    for a, b in ((0, 8), (8, 11), (11, 13)):
        V.append(df(*messages[a:b]).coalesce(1), log)
        stream = Q.run_queue(L.log(spark, log, "queue string, event_id long, ts timestamp, type string, run_id string"), 2 * hour * 1000)
        changes = drained(stream, tmp_path, "queue").orderBy("queue", "n").collect()
    assert [(r.run_id, r.state, r.at // 1000 - hour, r.reason) for r in changes if r.queue == "q"] == [
        ("1", "queued", 0, ""), ("1", "running", 0, ""), ("2", "queued", 1, ""), ("3", "queued", 2, ""), ("4", "queued", 3, ""), ("3", "cancelled", 4, "while queued"),
        ("1", "succeeded", 6, ""), ("2", "running", 6, ""), ("2", "cancelled", 7, "by user"), ("4", "running", 7, ""), ("5", "queued", 8, ""),
        ("4", "failed", 7 + 2 * hour, "stale"), ("5", "running", 7 + 2 * hour, ""), ("6", "queued", 4 * hour, ""), ("5", "failed", 7 + 4 * hour, "stale"), ("6", "running", 7 + 4 * hour, ""),
    ][: sum(r.queue == "q" for r in changes)]  # fmt: skip  (the last run's time may be over or not)
    assert [(r.run_id, r.state) for r in changes if r.queue == "p"] == [("9", "queued"), ("9", "running"), ("9", "failed")]


def test_queue_of_a_user_whose_times_are_earlier(spark, tmp_path):
    """Later ids may have earlier times: another user's clock doesn't make them late."""
    from foliant.catalogue import ORACLES, QUERIES
    from tests.compare import differences

    spark.sql("""select id as event_id, id div 40 as user_id, array('view', 'view', 'click', 'signup', 'view', 'purchase', 'error')[cast(id % 7 as int)] as event_type, 1.0D as value,
        timestamp_ntz'2024-01-05 00:00:00' - make_dt_interval(cast(id div 40 as int) * 3) + make_dt_interval(0, cast(id % 40 as int)) as ts from range(400)""").write.parquet(str(tmp_path / "events.parquet"))
    assert differences(spark, str(tmp_path), QUERIES["stream_run_queue"], ORACLES["stream_run_queue"]) is None
