import time

import pytest
from pyspark.sql import functions as F

from stmtflow.operators.review import apply_corrections, first_corrections, pending_reviews
from stmtflow.plans import catalog as cat
from stmtflow.plans import fixtures as fx
from stmtflow.session import materialize
from stmtflow.streaming import extract as se
from stmtflow.streaming import reviews as rv
from stmtflow.streaming.pipeline import ingested, read_stream

DOCS = "doc_id bigint, document_path string, document_type_hint string, text string"
QUEUE = "doc_id bigint, full_ocr_text string, document_type_hint string, original_document_path string"
CORRECTIONS = "doc_id bigint, corrected string, place int"


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(i, None if i == 7 else f"{i}.md", "T", " " if i == 8 else "bad" if i % 3 == 0 else f"# Account number\n\n{i}5\n") for i in range(10)]
    return spark.createDataFrame(rows, DOCS)


def counting_model(log):
    def make():
        def fn(text):
            with open(log, "a") as f:
                f.write("asked\n")
            return None if text == "bad" else '{"account_number": "1"}'

        return fn

    return make


def statuses(df):
    return sorted((r["doc_id"], r["status"], r["route"], r["branch"], r["record"] is not None) for r in df.collect())


def test_extraction_in_the_stream_equals_the_batch_run(spark, documents, tmp_path):
    from stmtflow.operators.responses import first_valid_response, model_extract
    from stmtflow.operators.routing import document_status, route_branch

    make = counting_model(tmp_path / "log")
    out, answers = se.stream_extract_once(spark, documents, make, batches=3, attempts=2)
    results = first_valid_response(model_extract(documents, make, attempts=2), 2).select("doc_id", "record")
    batch = document_status(documents.join(results, "doc_id", "left")).withColumn("branch", route_branch())
    assert statuses(out) == statuses(batch) and out.select("batch_id").distinct().count() > 1
    assert {(r["doc_id"], r["attempt"]) for r in answers.collect()} == {(i, 1) for i in range(10) if i != 8} | {(i, 2) for i in (0, 3, 6, 9)}


def test_a_batch_that_runs_again_asks_nothing_twice(spark, documents, tmp_path):
    log = tmp_path / "log"
    extract = se.by_model(counting_model(log), str(tmp_path / "answers"), attempts=2)
    se.extract_batch(documents, 0, extract, str(tmp_path / "out"))
    asked, first = len(log.read_text().split()), statuses(ingested(spark, str(tmp_path / "out")))
    assert asked == 9 + 4
    se.extract_batch(documents, 0, extract, str(tmp_path / "out"))
    assert len(log.read_text().split()) == asked and statuses(ingested(spark, str(tmp_path / "out"))) == first
    se.extract_batch(documents.where("doc_id = 1"), 1, extract, str(tmp_path / "out"))  # another batch is another matter
    assert len(log.read_text().split()) == asked + 1


def test_a_restarted_stream_asks_nothing_twice(spark, documents, tmp_path, monkeypatch):
    """The batch fails after the answers were stored; the restarted stream runs it again from them."""
    log, base = tmp_path / "log", str(tmp_path)
    materialize(documents, f"{base}/in")
    extract = se.by_model(counting_model(log), f"{base}/answers", attempts=2)
    run = lambda: se.stream_extract(read_stream(spark, f"{base}/in", documents.schema), extract, f"{base}/out", f"{base}/cp").awaitTermination()

    def fails(*args, **kw):
        raise OSError("disk full")

    monkeypatch.setattr(se, "route_branch", fails)
    with pytest.raises(Exception, match="disk full"):
        run()
    asked = len(log.read_text().split())
    assert asked == 9 + 4
    monkeypatch.undo()
    run()
    assert len(log.read_text().split()) == asked
    out = statuses(ingested(spark, f"{base}/out"))
    assert len(out) == 10 and [r[0] for r in out if r[3] == "failure"] == [0, 3, 6, 9]


def test_rules_in_the_stream(spark, documents):
    out, answers = se.stream_extract_once(spark, documents)
    got = {r["doc_id"]: (r["branch"], r["account"]) for r in out.select("doc_id", "branch", F.col("record.account_number").alias("account")).collect()}
    assert answers is None
    assert got == {i: ("unrouted", None) if i == 8 else ("unrouted", "75") if i == 7 else ("failure", None) if i % 3 == 0 else ("success", f"{i}5") for i in range(10)}


def test_first_correction_counts(spark):
    corrections = spark.createDataFrame([(1, "b", 2), (1, "a", 3), (1, "c", None), (2, None, 1), (3, "z", None), (3, "y", None)], CORRECTIONS)
    named = {r["doc_id"]: (r["corrected"], r["n_corrections"]) for r in first_corrections(corrections, order_col="place").collect()}
    assert named == {1: ("b", 3), 2: (None, 1), 3: ("y", 2)}
    plain = {r["doc_id"]: r["corrected"] for r in first_corrections(corrections).collect()}
    assert plain == {1: "a", 2: None, 3: "y"}
    queue = spark.createDataFrame([(i, "t", "T", "p") for i in (1, 2, 3, 4)], QUEUE)
    rows = apply_corrections(queue, corrections, order_col="place").collect()
    assert sorted(r["doc_id"] for r in rows) == [1, 2, 3]  # one stored row for a request
    assert [r["doc_id"] for r in pending_reviews(queue, corrections).collect()] == [4]


def states_of(df):
    return sorted((r["doc_id"], r["state"], r["corrected"]) for r in df.collect())


def test_pending_stream_equals_pending_reviews(spark, sf_small):
    queue, corrections = cat._run(spark, sf_small).queue, fx.corrections(spark, sf_small)
    states, corrected = rv.stream_reviews_once(spark, queue, corrections)
    pending = sorted(r["doc_id"] for r in pending_reviews(queue, corrections).collect())
    assert sorted(tuple(r) for r in rv.still_pending(states).collect()) == [(d, "waiting") for d in pending] and pending
    same = lambda df: sorted((r["doc_id"], r["correction_missing"], str(r["errors"])) for r in df.collect())
    assert same(corrected) == same(apply_corrections(queue, corrections))


def test_changes_over_several_batches(spark, tmp_path):
    """Corrections before their request, after it, and once more; each run is one micro-batch."""
    base = str(tmp_path)
    rows = spark.createDataFrame([(i, f"text {i}", "T", f"{i}.md") for i in range(4)], QUEUE)
    requests = materialize(rows, f"{base}/requests")

    def arrive(name, df):
        df.write.mode("append").parquet(f"{base}/{name}")

    def run():
        rv.stream_reviews(read_stream(spark, f"{base}/queue", requests.schema), read_stream(spark, f"{base}/corrections", corrections.schema), requests,
                          f"{base}/out", f"{base}/cp", order_col="place").awaitTermination()
        return ingested(spark, f"{base}/out/states")

    corrections = spark.createDataFrame([(1, '{"account_number": "1"}', 1)], CORRECTIONS)
    arrive("queue", rows.where("doc_id IN (0, 3)"))
    arrive("corrections", corrections)
    assert states_of(run()) == [(0, "waiting", None), (3, "waiting", None)]  # the correction of 1 came early
    arrive("queue", rows.where("doc_id IN (1, 2)"))
    arrive("corrections", spark.createDataFrame([(0, "{}", 2), (0, '{"account_number": "0"}', 1)], CORRECTIONS))
    run()
    arrive("corrections", spark.createDataFrame([(1, "{}", 1), (3, '{"billing_date": "x"}', 1)], CORRECTIONS))
    states = run()
    assert states_of(states) == [(0, "corrected", '{"account_number": "0"}'), (0, "repeated", "{}"), (0, "waiting", None), (1, "corrected", '{"account_number": "1"}'),
                                 (1, "repeated", "{}"), (2, "waiting", None), (3, "corrected", '{"billing_date": "x"}'), (3, "waiting", None)]
    assert [tuple(r) for r in rv.still_pending(states).collect()] == [(2, "waiting")]
    done = {r["doc_id"]: (r["full_ocr_text"], r["record"] is not None) for r in ingested(spark, f"{base}/out/corrected").collect()}
    assert done == {0: ("text 0", True), 1: ("text 1", True), 3: ("text 3", False)}


def test_requests_past_their_limit_come_out_as_pending(spark, tmp_path):
    base = str(tmp_path)
    requests = materialize(spark.createDataFrame([(i, "t", "T", "p") for i in (1, 2)], QUEUE), f"{base}/queue")
    corrections = materialize(spark.createDataFrame([(2, "{}", 1), (3, "{}", 1)], CORRECTIONS), f"{base}/corrections")
    streams = read_stream(spark, f"{base}/queue", requests.schema), read_stream(spark, f"{base}/corrections", corrections.schema)
    with pytest.raises(ValueError):
        rv.stream_reviews(*streams, requests, f"{base}/out", f"{base}/cp", limit_seconds=1)
    query = rv.stream_reviews(*streams, requests, f"{base}/out", f"{base}/cp", limit_seconds=2.0, available_now=False, processing_time="500 milliseconds")
    want = {(1, "waiting", None), (2, "corrected", "{}"), (1, "expired", None), (3, "unrequested", "{}")}
    try:
        deadline, late = time.monotonic() + 120, False
        while time.monotonic() < deadline and query.isActive:
            time.sleep(1)
            try:
                got = set(states_of(ingested(spark, f"{base}/out/states")))
            except Exception:  # no batch yet
                continue
            if (1, "expired", None) in got and not late:
                late = True
                spark.createDataFrame([(1, '{"late": 1}', 9)], CORRECTIONS).write.mode("append").parquet(f"{base}/corrections")
            if want <= got and any(s == "late" or s == "unrequested" and d == 1 for d, s, _ in got):
                break
    finally:
        query.stop()
    states = ingested(spark, f"{base}/out/states")
    assert want <= set(states_of(states))
    assert [tuple(r) for r in rv.still_pending(states).collect()] == [(1, "expired")]
    assert spark.conf.get(rv.PROVIDER) != rv.ROCKSDB


def test_micro_batches_are_read_by_many_tasks(spark):
    rows = [(i, f"p{i}", "T", "# Account number\n\n1234") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, document_path string, document_type_hint string, text string").repartition(8, "doc_id")
    out, answers = se.stream_extract_once(spark, docs, lambda: lambda text: '{"account_number": "1"}', batches=2, attempts=1)
    assert out.count() == 400 and answers.count() == 400
    assert out.select("batch_id").distinct().count() == 2
    stored = out.inputFiles()[0].split("/out/")[0] + "/in"
    assert len(spark.read.parquet(stored).inputFiles()) == 8


def test_streams_store_their_steps_in_less_room(spark):
    import pyarrow.parquet as pq
    from stmtflow.streaming.pipeline import stream_append_once
    from stmtflow.schemas import BILLS_TABLE

    names = [f.name for f in BILLS_TABLE.fields if f.name not in ("id", "created_at")]
    rows = spark.range(3).select(F.col("id").alias("doc_id"), F.lit("direct").alias("branch"),
                                 *[F.lit("1").cast(BILLS_TABLE[n].dataType).alias(n) if BILLS_TABLE[n].dataType.simpleString() != "date"
                                   else F.to_date(F.lit("2020-01-01")).alias(n) for n in names])
    table = stream_append_once(spark, rows)
    assert table.count() == 3
    written = [pq.ParquetFile(path.removeprefix("file://")).metadata for path in table.inputFiles()]
    codecs = {m.row_group(0).column(0).compression for m in written if m.num_row_groups}
    assert codecs == {"ZSTD"}


def test_reviews_store_their_steps_in_less_room(spark, tmp_path):
    """Requests, changes and corrected documents are written with the codec of the other streams."""
    import glob

    import pyarrow.parquet as pq

    queue = spark.createDataFrame([(i, f"text {i}", "T", f"{i}.md") for i in range(4)], QUEUE)
    corrections = spark.createDataFrame([(1, '{"account_number": "1"}', 1), (2, "{}", 1)], CORRECTIONS)
    states, corrected = rv.stream_reviews_once(spark, queue, corrections, order_col="place")
    assert states_of(states) == [(0, "waiting", None), (1, "corrected", '{"account_number": "1"}'), (2, "corrected", "{}"), (3, "waiting", None)]
    assert sorted((r["doc_id"], r["full_ocr_text"]) for r in corrected.collect()) == [(1, "text 1"), (2, "text 2")]
    base = states.inputFiles()[0].removeprefix("file://").split("/out/")[0]
    for step in ("queue", "corrections", "out/states", "out/corrected"):
        written = [pq.ParquetFile(f).metadata for f in glob.glob(f"{base}/{step}/**/*.parquet", recursive=True)]
        assert {m.row_group(0).column(0).compression for m in written if m.num_row_groups} == {"ZSTD"}, step
