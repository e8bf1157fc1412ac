import hashlib
import json

from foliant.catalogue import ORACLES, QUERIES
from foliant.operators import evaluation as X
from tests.compare import differences


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_streams_end_in_files(spark, sf):
    """No rows of a stream are held by the driver: what is read back is a table of files."""
    for name in ("stream_replay_dedup", "stream_step_state", "stream_daily_counts"):
        assert all("foliant-stream-" in f for f in QUERIES[name](spark, sf).inputFiles() or ["none"]), name


def test_pages_without_a_window_over_all(spark, sf):
    for name in ("paged_list", "chunk_browse_page"):
        assert "Window" not in plan(QUERIES[name](spark, sf)), name


def test_version_of_buckets(spark):
    texts = ["a", "b", "b", "c"]
    version = lambda t: X.dataset_version(spark.createDataFrame([(x,) for x in t], "text string"), "text").first().version
    buckets = {}
    for x in set(texts):
        d = sha(json.dumps({"text": x}, separators=(",", ":")))
        buckets.setdefault(d[:4], []).append(f"{d} {texts.count(x)}")
    want = sha(",".join(sorted(f"{b} {sha(','.join(sorted(v)))}" for b, v in buckets.items())))[:12]
    assert version(texts) == version(texts[::-1]) == want != version(["a", "b", "c"])


def test_provenance_of_all_documents_and_their_ends(spark, tmp_path):
    rows = [(3, "plain words " * 60 + "zebra quagga okapi"), (20, "zebra quagga okapi plain words"), (21, "nothing alike")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = QUERIES["provenance_select"](spark, str(tmp_path))
    assert {r.id for r in found.collect()} == {3, 20}
    assert "Window" not in plan(found)


def test_cells_past_the_hundredth_row(spark, tmp_path):
    text = "\n".join(f"a{i}|b{i}" for i in range(150))
    spark.createDataFrame([(0, text)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    cells = QUERIES["delimited_cells"](spark, str(tmp_path)).collect()
    assert len(cells) == 150 and not any(r.truncated for r in cells)


def test_ids_and_times_as_in_sql_for_large_keys(spark, tmp_path):
    spark.createDataFrame([("http://a", 123_456), ("http://b", 7)], "url string, page_id long").write.parquet(str(tmp_path / "pages.parquet"))
    spark.sql("select explode(array(0L, 5L, 719500L, 800000L, 6000000L)) as event_id, timestamp_ntz'2024-01-05 00:00:00' as ts").write.parquet(str(tmp_path / "events.parquet"))
    for name in ("names", "iso_times"):
        assert differences(spark, str(tmp_path), QUERIES[name], ORACLES[name]) is None, name


def test_sample_text_orders_lengths_without_texts(spark, tmp_path):
    rows = [(i, None if i % 7 == 0 else f"{i} " * (i % 40), [None, "en", "de"][i % 3]) for i in range(2000)] + [(2000, "x" * 5000, "long"), (2001, "y", "long")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    assert differences(spark, str(tmp_path), QUERIES["sample_text"], ORACLES["sample_text"]) is None

    def windows(node):
        below = [w for i in range(node.children().size()) for w in windows(node.children().apply(i))]
        return below + ([node.output().mkString(" ")] if node.nodeName() == "Window" else [])

    seen = windows(QUERIES["sample_text"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan())
    assert seen and not any("text" in w for w in seen)
