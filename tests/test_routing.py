from pyspark.sql import functions as F

from stmtflow.operators.review import apply_corrections, pending_reviews
from stmtflow.operators.routing import (
    guard_required_path, route_decision, task_log, process_log, validate_corrected,
)
from stmtflow.plans.pipeline import run_pipeline
from stmtflow.schemas import MSG_NO_CONTENT, MSG_NO_PATH


def _docs(spark):
    return spark.createDataFrame(
        [(1, "a.md", "PSEG_BILL", "# x"), (2, None, "PSEG_BILL", "# x"), (3, "", "PSEG_BILL", "# x"),
         (4, "  ", "PSEG_BILL", "# x"), (5, "e.md", "PSEG_BILL", " \n"), (6, "f.md", None, "# x"),
         (7, "g.md", "PSEG_BILL", "# x")],
        "doc_id long, document_path string, document_type_hint string, text string")


def _responses(spark):
    return spark.createDataFrame(
        [(1, 1, '{"account_number": "1"}'), (4, 1, '{}'), (5, 1, '{}'), (6, 1, '{"account_number": "6"}'),
         (7, 1, '{"account_number": 7}')], "doc_id long, attempt int, response string")


def test_guard(spark):
    g = {r.doc_id: (r.path_ok, r.guard_reason) for r in guard_required_path(_docs(spark)).collect()}
    assert g[2] == (False, MSG_NO_PATH) and g[3] == (False, MSG_NO_PATH) and g[4] == (True, None)


def test_status_order_and_routes(spark):
    run = run_pipeline(_docs(spark), _responses(spark), spark.createDataFrame([], "doc_id long, corrected string"))
    st = {r.doc_id: (r.status, r.route, r.reason) for r in run.processed.collect()}
    assert st[1] == ("COMPLETED", "LLM_SUCCESS", None)
    assert st[2] == ("FAILED", None, MSG_NO_PATH)
    assert st[3] == ("FAILED", None, MSG_NO_PATH)
    assert st[4] == ("COMPLETED", "LLM_SUCCESS", None)  # whitespace path is truthy; {} is a valid record
    assert st[5] == ("FAILED", None, MSG_NO_CONTENT)
    assert st[7] == ("COMPLETED", "LLM_FAILURE", None)
    routes = route_decision(run.processed)
    assert sorted(r.doc_id for r in routes["unrouted"].collect()) == [2, 3, 5]
    # an explicit NULL type fails the direct store, an empty string would not
    direct = {r.doc_id: r.store_reason for r in run.direct.collect()}
    assert direct[6] == "Missing full_ocr_text or document_type" and direct[1] is None
    assert sorted(r.doc_id for r in run.pending.collect()) == [7]
    logs = task_log(run.processed, "process_document", process_log()).where("doc_id = 7").first()
    assert logs.entry == "no record read from g.md, a reviewer is asked"


def test_model_failures_go_to_review(spark):
    from stmtflow.operators.responses import model_extract

    def make():
        def fn(text):
            raise RuntimeError("model is down")

        return fn

    docs = _docs(spark).withColumn("pipeline_error", F.when(F.col("doc_id") == 7, F.lit("OSError: gone")))
    answers = model_extract(docs, make, attempts=2)
    run = run_pipeline(docs, answers, spark.createDataFrame([], "doc_id long, corrected string"))
    st = {r.doc_id: (r.status, r.route, r.reason) for r in run.processed.collect()}
    assert st[1] == st[4] == ("COMPLETED", "LLM_FAILURE", None)
    assert st[7] == ("FAILED", "PIPELINE_ERROR", "Critical error: OSError: gone")
    assert sorted(r.doc_id for r in run.queue.collect()) == [1, 4, 6]
    assert sorted(r.doc_id for r in run.unrouted.collect()) == [2, 3, 5, 7]


def test_direct_store_reasons_of_json_payloads(spark):
    from stmtflow.operators.routing import parse_storage_payload, validate_direct

    good = '"full_ocr_text": "", "document_type": "T"'
    cases = [(None, "Missing db_storage_payload"), ("{}", "Missing db_storage_payload"), ("null", "Missing db_storage_payload"),
             ("{%s}" % good, "Missing pseg_data_dict"), ('{"pseg_data_dict": {}, %s}' % good, "Missing pseg_data_dict"),
             ('{"pseg_data_dict": null, %s}' % good, "Missing pseg_data_dict"),
             ('{"pseg_data_dict": {"account_number": 5}}', "PSEGData model reconstruction failed: 1 validation error: account_number: string_type"),
             ('{"pseg_data_dict": {"account_number": "5"}, "document_type": "T"}', "Missing full_ocr_text or document_type"),
             ('{"pseg_data_dict": {"account_number": "5"}, %s}' % good, None), ('{"pseg_data_dict": {"x": 1}, %s}' % good, None)]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "doc_id int, payload_json string")
    out = {r.doc_id: (r.store_status, r.store_reason) for r in validate_direct(parse_storage_payload(df)).collect()}
    for i, (_, reason) in enumerate(cases):
        assert out[i] == ("FAILED" if reason else "COMPLETED", reason), cases[i]


def test_corrections_order_and_messages(spark):
    queue = spark.createDataFrame(
        [(1, "t", "PSEG_BILL", "p"), (2, "t", "PSEG_BILL", "p"), (3, None, "PSEG_BILL", "p"),
         (4, "", None, "p"), (5, "t", "PSEG_BILL", "p"), (6, "t", "PSEG_BILL", "p")],
        "doc_id long, full_ocr_text string, document_type_hint string, original_document_path string")
    corr = spark.createDataFrame(
        [(1, '{"account_number": "A"}'), (2, '{}'), (3, '{"account_number": "A"}'), (4, '{"account_number": 1}'),
         (5, '{"account_number": 1}'), (7, '{"account_number": "x"}')], "doc_id long, corrected string")
    checked = validate_corrected(apply_corrections(queue, corr))
    out = {r.doc_id: (r.store_status, r.store_reason) for r in checked.collect()}
    assert out[1] == ("COMPLETED", None)
    assert out[2][1] == "Missing 'corrected_pseg_data_dict' in input for human corrected data."
    assert out[3][1].endswith("OCR Text: missing, Type: present")
    # empty text reads as missing when the type is NULL (truthiness), before validation
    assert out[4][1].endswith("OCR Text: missing, Type: missing")
    assert out[5][1].startswith("Corrected PSEGData model reconstruction failed: 1 validation error")
    assert 6 not in out and 7 not in out
    assert [r.doc_id for r in pending_reviews(queue, corr).collect()] == [6]


def test_pipeline_row_conservation(spark, sf_small):
    from stmtflow.plans import catalog as cat

    run = cat._run(spark, sf_small, stored_stage=True)
    n_docs = run.processed.count()
    routed = run.success.count() + run.failure.count() + run.unrouted.count()
    assert routed == n_docs
    direct_ok = run.direct.where(F.col("store_status") == "COMPLETED").count()
    corrected_ok = run.corrected.where(F.col("store_status") == "COMPLETED").count()
    assert run.stored.count() == direct_ok + corrected_ok
    assert run.corrected.count() + run.pending.count() == run.failure.count()
