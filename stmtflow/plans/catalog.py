"""Registered queries: one per operator, each ``(spark, sf_dir) -> DataFrame``, and
the DuckDB SQL that computes the same result from the base tables.

Outputs are flat: strings, BIGINT and DOUBLE only (dates as ``yyyy-MM-dd`` text,
booleans as 0/1), with the same column names on both sides. Most oracles are
*independent*: they derive the expected value from ``orders``/``customer``/
``lineitem`` by the fixture rules (``plans.fixtures``) instead of re-running the
Spark logic.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_account, normalize_date, parse_money
from ..operators import extract as ex
from ..operators import markdown as md
from ..operators import text as tx
from ..operators.responses import (
    first_valid_response, model_extract, validate_invoice, validate_response,
)
from ..operators.routing import (
    build_storage_payload, capture_errors, document_status, guard_required_path, parse_storage_payload,
    process_log, route_decision, store_log, task_log, validate_direct, workflow_output,
)
from ..operators.stages import default_registry
from ..operators.store import (
    append_rows, assign_ids, constraint_error, ensure_bills_table, export_records_json, table_rows,
)
from ..session import cut, shared_path
from ..sources.documents import parse_workitems, read_text_documents, read_text_table, scan_documents
from . import fixtures as fx
from .pipeline import extraction_results, join_documents, run_pipeline, with_texts

Query = Callable[[SparkSession, str], DataFrame]


def ds(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.date_format(c, "yyyy-MM-dd")


def as_long(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("long")


def flag(c: Column) -> Column:
    return F.when(c, F.lit(1)).otherwise(F.lit(0)).cast("long")


def n_elements(c) -> Column:
    """Element count with NULL as 0, whatever ``spark.sql.legacy.sizeOfNull`` says."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNull(), F.lit(0)).otherwise(F.size(c)).cast("long")


# ---------------------------------------------------------------- shared Spark inputs

def _pipeline_docs(spark, sf):
    work = parse_workitems(fx.work_items(spark, sf))
    return join_documents(fx.pipeline_documents(spark, sf), work)


def _run(spark, sf, stored_stage=False, keep_text=True):
    """The whole run; ``stored_stage`` for queries that use two or more of its branches, without ``keep_text`` for those that write no text."""
    return run_pipeline(_pipeline_docs(spark, sf), fx.responses(spark, sf), fx.corrections(spark, sf), stored_stage=stored_stage, keep_text=keep_text)


def _items_sum(items: Column) -> Column:
    zero = F.lit(0).cast("decimal(18,2)")
    summed = F.aggregate(F.coalesce(items, F.array().cast("array<struct<description:string,amount:double>>")),
                         zero, lambda a, x: (a + x["amount"].cast("decimal(18,2)")).cast("decimal(18,2)"))
    return summed.cast("double")


def _json_items(col: str) -> Column:
    return F.from_json(F.col(col), "array<struct<description:string,amount:double>>")


# ---------------------------------------------------------------- 2.1 sources, sinks

def q_scan_documents(spark, sf):
    return read_text_table(spark, f"{sf}/documents.parquet")


def _file_id(path: str) -> Column:
    return F.regexp_extract(path, r"([0-9]+)\.md$", 1).cast("long")


def q_scan_document_files(spark, sf):
    """Documents as files of text, empty ones too."""
    root = shared_path(spark, "files", unique=True)
    fx.document_files(spark, sf, root)
    docs = read_text_documents(spark, root, path_glob="*.md")
    return docs.select(_file_id("document_path").alias("doc_id"), F.regexp_extract("document_path", r"([^/]+/[^/]+)/[^/]+$", 1).alias("folder"),
                       as_long(F.length("text")).alias("n_chars"), F.md5("text").alias("digest"))


def q_scan_binary_files(spark, sf):
    """The same files as bytes."""
    root = shared_path(spark, "files", unique=True)
    fx.document_files(spark, sf, root)
    files = scan_documents(spark, root, "files", path_glob="*.md")
    return files.select(_file_id("path").alias("doc_id"), "length", F.md5("content").alias("digest"))


def q_scan_workitems(spark, sf):
    return parse_workitems(fx.mixed_work_items(spark, sf)).select("doc_id", "document_path", "document_type_hint")


def _bill_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "doc_id", "account_number", "customer_name", "service_address", "billing_address",
        ds("billing_date").alias("billing_date"),
        ds("billing_period_start_date").alias("billing_period_start_date"),
        ds("billing_period_end_date").alias("billing_period_end_date"),
        ds("due_date").alias("due_date"),
        *[F.col(c).cast("double").alias(c) for c in
          ("total_amount_due", "previous_balance", "payments_received", "current_charges")],
        as_long(F.coalesce(F.json_array_length("line_items"), F.lit(0))).alias("n_items"),
        "raw_text_summary", "document_type")


def q_bills_table(spark, sf):
    """Created, filled and read back; the order's number is in the stored summary."""
    path = shared_path(spark, "tables", "bills", unique=True)
    ensure_bills_table(spark, path)
    st = fx.statements(spark, sf).withColumn("document_type", F.lit(fx.DEFAULT_DOCUMENT_TYPE))
    records = ex.extract_records(st, keep=("text", "document_type"))
    back = append_rows(table_rows(records, "record", "text", "document_type"), path, reread=True)
    return _bill_columns(back.withColumn("doc_id", F.regexp_extract("raw_text_summary", "([0-9]+)$", 1).cast("long")))


def q_append_bills(spark, sf):
    run = _run(spark, sf, stored_stage=True, keep_text=False)
    path = shared_path(spark, "tables", "bills", unique=True)
    back = append_rows(with_texts(run.stored.drop("branch"), _pipeline_docs(spark, sf)), path)
    return back.select(as_long("id").alias("id"), "account_number", ds("billing_date").alias("billing_date"),
                       F.col("total_amount_due").cast("double").alias("total_amount_due"), "document_type")


def q_export_records_json(spark, sf):
    st = fx.statements(spark, sf)
    recs = ex.extract_records(st)
    js = export_records_json(recs)
    return js.select(
        "doc_id",
        F.get_json_object("json", "$.account_number").alias("account_number"),
        F.get_json_object("json", "$.billing_date").alias("billing_date"),
        F.get_json_object("json", "$.total_amount_due").cast("double").alias("total_amount_due"),
        as_long(F.size(F.json_object_keys("json"))).alias("n_keys"),
        as_long(F.json_array_length(F.get_json_object("json", "$.line_items"))).alias("n_items"))


# ---------------------------------------------------------------- 2.2 projections, filters

def q_filter_blank_content(spark, sf):
    docs = read_text_table(spark, f"{sf}/documents.parquet")
    return tx.filter_blank_content(docs, mode="flag").select("doc_id", flag(F.col("is_blank")).alias("is_blank"))


def q_guard_required_path(spark, sf):
    items = parse_workitems(fx.mixed_work_items(spark, sf))
    g = guard_required_path(items)
    return g.select("doc_id", flag(F.col("path_ok")).alias("path_ok"), "guard_reason")


def q_build_storage_payload(spark, sf):
    run = _run(spark, sf)
    p = build_storage_payload(run.success)
    return p.select("doc_id", F.col("payload.document_type").alias("document_type"),
                    F.col("payload.record.account_number").alias("account_number"),
                    flag(F.col("payload.full_ocr_text").isNotNull()).alias("has_text"))


def q_review_queue(spark, sf):
    run = _run(spark, sf)
    return run.queue.select("doc_id", "document_type_hint", "original_document_path",
                            flag(F.col("full_ocr_text").isNotNull()).alias("has_text"))


def q_text_measure(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return tx.text_measure(docs).select("doc_id", as_long("n_chars_measured").alias("n_chars_measured"),
                                        as_long("n_chars").alias("n_chars"))


def q_context_budget(spark, sf):
    docs = read_text_table(spark, f"{sf}/documents.parquet")
    b = tx.context_budget(docs)
    return b.select("doc_id", as_long("approx_tokens").alias("approx_tokens"),
                    flag(F.col("over_budget")).alias("over_budget"),
                    as_long(F.char_length("text")).alias("kept_chars"))


def q_render_prompt(spark, sf):
    docs = read_text_table(spark, f"{sf}/documents.parquet")
    return tx.prompt_messages(docs).select("doc_id", as_long("seq").alias("seq"), "role", "content")


# ---------------------------------------------------------------- 2.3 document text

def q_assemble_parts(spark, sf):
    conv = spark.read.parquet(f"{sf}/conversations.parquet")
    return tx.assemble_parts(conv, id_col="conv_id", pos_col="turn", text_col="text")


def q_html_to_markdown(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    return tx.html_to_markdown(pages).select("page_id", "markdown")


def q_html_order_pages(spark, sf):
    return tx.html_to_markdown(fx.order_pages(spark, sf)).select("doc_id", "markdown")


def q_html_table_cells(spark, sf):
    cells = md.table_cells(tx.html_to_markdown(fx.order_pages(spark, sf), out_col="text"))
    return cells.select("doc_id", as_long("line").alias("line"), as_long("col").alias("col"), "cell")


def q_split_pages(spark, sf):
    pages = md.split_pages(fx.statements(spark, sf))
    lines = F.split("page_text", "\n")
    return pages.select("doc_id", as_long("page").alias("page"), as_long(F.size(lines)).alias("n_lines"),
                        F.get(lines, 0).alias("first_line"))


def q_heading_sections(spark, sf):
    hs = md.heading_sections(fx.statements(spark, sf))
    return (hs.groupBy("doc_id", "page", "heading").agg(F.count(F.lit(1)).alias("n_lines"))
              .select("doc_id", as_long("page").alias("page"), "heading", as_long("n_lines").alias("n_lines")))


def q_table_cells(spark, sf):
    cells = md.table_cells(fx.statements(spark, sf))
    return (cells.groupBy("doc_id", "page")
                 .agg(F.count_distinct("line").alias("n_rows"), F.count(F.lit(1)).alias("n_cells"))
                 .select("doc_id", as_long("page").alias("page"), as_long("n_rows").alias("n_rows"),
                         as_long("n_cells").alias("n_cells")))


# ---------------------------------------------------------------- 2.4 extraction

_DATE_FIELDS = ("billing_date", "billing_period_start_date", "billing_period_end_date", "due_date")
_MONEY_FIELDS = ("total_amount_due", "previous_balance", "payments_received", "current_charges")


def _normalized(field: Column, value: Column) -> Column:
    return (F.when(field.isin(*_DATE_FIELDS), ds(normalize_date(value)))
            .when(field.isin(*_MONEY_FIELDS), parse_money(value).cast("string"))
            .when(field == "account_number", normalize_account(value))
            .otherwise(value))


def q_label_candidates(spark, sf):
    c = ex.label_candidates(fx.statements(spark, sf))
    return c.select("doc_id", "field", as_long("rank").alias("rank"), as_long("page").alias("page"),
                    _normalized(F.col("field"), F.col("value")).alias("value"))


def q_normalize_dates(spark, sf):
    c = ex.label_candidates(fx.statements(spark, sf)).where(F.col("field").isin(*_DATE_FIELDS))
    return c.select("doc_id", "field", F.col("value").alias("raw"), ds(normalize_date("value")).alias("value"))


def q_parse_money(spark, sf):
    c = ex.label_candidates(fx.statements(spark, sf)).where(F.col("field").isin(*_MONEY_FIELDS))
    return c.select("doc_id", "field", as_long("rank").alias("rank"),
                    parse_money("value").cast("double").alias("amount"))


def q_normalize_account(spark, sf):
    c = ex.label_candidates(fx.statements(spark, sf)).where(F.col("field") == "account_number")
    return c.select("doc_id", F.col("value").alias("raw"), normalize_account("value").alias("account"))


def q_line_items(spark, sf):
    li = ex.line_items(fx.statements(spark, sf))
    return li.select("doc_id", as_long("item").alias("item"), "description", "amount")


def q_wide_line_items(spark, sf):
    """Charges in tables of three and four columns, over several sections."""
    li = ex.line_items(fx.wide_statements(spark, sf))
    return li.select("doc_id", as_long("item").alias("item"), "description", "amount")


def q_reconciled_bills(spark, sf):
    """Amounts chosen together, where they balance."""
    b = ex.extract_bills(fx.decoy_statements(spark, sf), reconcile=True)
    return b.select("doc_id", *_MONEY_FIELDS, flag(F.col("balanced")).alias("balanced"))


def q_extract_bills(spark, sf):
    b = ex.extract_bills(fx.statements(spark, sf))
    return b.select(
        "doc_id", "account_number", "customer_name", "service_address", "billing_address",
        ds("billing_date").alias("billing_date"),
        ds("billing_period_start_date").alias("billing_period_start_date"),
        ds("billing_period_end_date").alias("billing_period_end_date"),
        ds("due_date").alias("due_date"),
        "total_amount_due", "previous_balance", "payments_received", "current_charges",
        n_elements("line_items").alias("n_items"),
        _items_sum(F.col("line_items")).alias("items_sum"), "raw_text_summary")


STUB_ERROR = "ValueError: no charges table"


def make_stub_extractor():
    """A deterministic stand-in for a model client: reads two fields with Python
    regexes and fails on statements without a charges table."""
    import json
    import re

    account = re.compile(r"(?m)^(?:Your account number: |# Account number\n\n)([0-9 ]+)$")
    name = re.compile(r"(?m)^---\n# (.+)$")

    def extract(text: str) -> str:
        if "|Description|Amount|" not in text:
            raise ValueError("no charges table")
        a, n = account.search(text), name.search(text)
        return json.dumps({"account_number": a.group(1).replace(" ", "") if a else None,
                           "customer_name": n.group(1) if n else None})

    return extract


def q_model_extract(spark, sf):
    out = validate_response(model_extract(fx.pipeline_documents(spark, sf), make_stub_extractor))
    return out.select("doc_id", as_long("attempt").alias("attempt"), F.col("record.account_number").alias("account_number"),
                      F.col("record.customer_name").alias("customer_name"),
                      flag(F.col("error").isNotNull()).alias("has_error"))


def q_validate_response(spark, sf):
    v = validate_response(fx.responses(spark, sf))
    valid = F.size("errors") == 0
    return v.select(
        "doc_id", flag(valid).alias("valid"), F.try_element_at("errors", F.lit(1)).alias("first_error"),
        as_long(F.size("errors")).alias("n_errors"),
        F.col("record.account_number").alias("account_number"),
        ds("record.billing_date").alias("billing_date"),
        F.col("record.total_amount_due").alias("total_amount_due"),
        F.when(valid, n_elements("record.line_items")).alias("n_items"))


def q_first_valid_attempt(spark, sf):
    best = first_valid_response(fx.responses(spark, sf, retries=True), max_attempts=3)
    return best.select("doc_id", as_long("attempt").alias("attempt"))


def invoice_responses(spark, sf) -> DataFrame:
    """Invoice JSON per order by ``o_orderkey % 4``: 0 valid, 1 date as epoch seconds
    (valid), 2 amount not a number, 3 invoice number as a number."""
    facts = fx.order_facts(spark, sf)
    key = F.col("o_orderkey")
    m = key % 4
    base = {"invoice_number": F.format_string("INV-%d", key), "vendor_name": F.col("c_name"),
            "invoice_date": ds("d"), "total_amount": F.col("o_totalprice")}
    j = lambda **ch: F.to_json(F.struct(*[c.alias(n) for n, c in {**base, **ch}.items()]))
    resp = (F.when(m == 1, j(invoice_date=F.unix_date("d").cast("long") * 86400))
            .when(m == 2, j(total_amount=F.lit("n/a")))
            .when(m == 3, j(invoice_number=key))
            .otherwise(j()))
    return facts.select(key.alias("doc_id"), resp.alias("response"))


def q_validate_invoice(spark, sf):
    v = validate_invoice(invoice_responses(spark, sf))
    return v.select("doc_id", flag(F.size("errors") == 0).alias("valid"),
                    F.try_element_at("errors", F.lit(1)).alias("first_error"),
                    F.col("record.invoice_number").alias("invoice_number"),
                    ds("record.invoice_date").alias("invoice_date"),
                    F.col("record.total_amount").alias("total_amount"))


# ---------------------------------------------------------------- 2.5 routing, status

def q_document_status(spark, sf):
    return _run(spark, sf, keep_text=False).processed.select("doc_id", "status", "route", "reason")


def q_route_decision(spark, sf):
    processed = cut(_run(spark, sf, keep_text=False).processed.select("doc_id", "route"))
    routes = route_decision(processed)
    return (routes["success"].select("doc_id", F.lit("success").alias("branch"))
            .unionByName(routes["failure"].select("doc_id", F.lit("failure").alias("branch")))
            .unionByName(routes["unrouted"].select("doc_id", F.lit("unrouted").alias("branch"))))


def q_validate_direct(spark, sf):
    return _run(spark, sf, keep_text=False).direct.select("doc_id", "store_status", "store_reason")


def q_validate_corrected(spark, sf):
    return _run(spark, sf, keep_text=False).corrected.select("doc_id", "store_status", "store_reason")


READ_ERROR = "OSError: document store unavailable"


def q_validate_direct_json(spark, sf):
    parsed = parse_storage_payload(fx.storage_payloads(spark, sf))
    checked = validate_direct(parsed.withColumn("store_error", constraint_error("payload.record", "payload.document_type")))
    return checked.select("doc_id", "store_status", "store_reason")


def q_capture_errors(spark, sf):
    # The model raises on some documents; others could not be read at all.
    docs = _pipeline_docs(spark, sf).withColumn("pipeline_error", F.when(F.col("doc_id") % 13 == 0, F.lit(READ_ERROR)))
    results = extraction_results(model_extract(docs.where(F.col("pipeline_error").isNull()), make_stub_extractor, attempts=2))
    processed = capture_errors(document_status(docs.join(results, "doc_id", "left")))
    return processed.select("doc_id", "status", "route", "reason")


def q_task_log(spark, sf):
    run = _run(spark, sf, stored_stage=True, keep_text=False)
    ids = assign_ids(run.stored.select("doc_id"), "doc_id")
    logs = (task_log(run.processed, "process_document", process_log())
            .unionByName(task_log(run.direct.join(ids, "doc_id", "left"), "store_document_data", store_log(True)))
            .unionByName(task_log(run.corrected.join(ids, "doc_id", "left"), "process_human_corrected_data",
                                  store_log(False))))
    return logs.select("doc_id", "task", as_long("seq").alias("seq"), "entry")


def q_workflow_output(spark, sf):
    run = _run(spark, sf, stored_stage=True, keep_text=False)
    ids = assign_ids(run.stored.select("doc_id"), "doc_id")
    outcome = ("doc_id", "store_status", "store_reason")
    out = workflow_output(run.processed, run.direct.select(*outcome).join(ids, "doc_id", "left"),
                          run.corrected.select(*outcome).join(ids, "doc_id", "left"))
    return out.select(
        "doc_id", "final_status_doc_processing",
        F.col("direct_storage_output.status").alias("direct_status"),
        flag(F.col("direct_storage_output.db_insertion_id").isNotNull()).alias("direct_stored"),
        F.col("human_corrected_storage_output.status").alias("corrected_status"),
        F.col("human_corrected_storage_output.status_human_review").alias("status_human_review"))


# ---------------------------------------------------------------- 2.6 joins, store

def q_apply_corrections(spark, sf):
    c = _run(spark, sf, keep_text=False).corrected
    return c.select("doc_id", flag(F.col("correction_missing")).alias("correction_missing"),
                    flag(F.size("errors") == 0).alias("valid"), "document_type_hint",
                    F.col("record.account_number").alias("account_number"))


def q_pending_reviews(spark, sf):
    return _run(spark, sf, keep_text=False).pending.select("doc_id", "original_document_path")


def _stored_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "doc_id", "branch", "account_number", "customer_name", ds("billing_date").alias("billing_date"),
        ds("due_date").alias("due_date"),
        *[F.col(c).cast("double").alias(c) for c in ("total_amount_due", "previous_balance", "current_charges")],
        as_long(F.coalesce(F.json_array_length("line_items"), F.lit(0))).alias("n_items"),
        "document_type")


def q_store_all(spark, sf):
    return _stored_columns(_run(spark, sf, stored_stage=True, keep_text=False).stored)


def q_enforce_store_constraints(spark, sf):
    run = _run(spark, sf, stored_stage=True, keep_text=False)
    d = run.direct.select("doc_id", F.lit("direct").alias("branch"), "store_error")
    c = run.corrected.select("doc_id", F.lit("corrected").alias("branch"), "store_error")
    return d.unionByName(c)


def q_encode_line_items(spark, sf):
    stored = _run(spark, sf, stored_stage=True, keep_text=False).stored
    return stored.select("doc_id", "branch", flag(F.col("line_items").isNull()).alias("is_null"),
                         "line_items", _items_sum(_json_items("line_items")).alias("items_sum"))


# ---------------------------------------------------------------- 2.7 streaming

def q_stream_ingest(spark, sf):
    from ..streaming.pipeline import stream_ingest_once
    docs = _pipeline_docs(spark, sf)
    out = stream_ingest_once(spark, docs, fx.responses(spark, sf), batches=4)
    return out.select("doc_id", "status", "route", "reason")


def q_stream_corrections(spark, sf):
    from ..streaming.pipeline import stream_corrections_once
    run = _run(spark, sf)
    out = stream_corrections_once(spark, run.queue, fx.corrections(spark, sf))
    return out.select("doc_id", flag(F.col("correction_missing")).alias("correction_missing"),
                      flag(F.size("errors") == 0).alias("valid"), "document_type_hint",
                      F.col("record.account_number").alias("account_number"))


def q_stream_extract(spark, sf):
    """Documents alone in: the model is asked inside the micro-batches."""
    from ..streaming.extract import stream_extract_once
    out, answers = stream_extract_once(spark, _pipeline_docs(spark, sf), make_stub_extractor, batches=2, concurrency=2)
    asked = answers.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_answers"))
    return out.join(asked, "doc_id", "left").select(
        "doc_id", "status", "route", "branch", F.col("record.account_number").alias("account_number"),
        as_long(F.coalesce("n_answers", F.lit(0))).alias("n_answers"))


def q_stream_extract_rules(spark, sf):
    from ..streaming.extract import stream_extract_once
    out, _ = stream_extract_once(spark, _pipeline_docs(spark, sf))
    return out.select("doc_id", "status", "route", F.col("record.account_number").alias("account_number"),
                      F.col("record.total_amount_due").alias("total_amount_due"), ds("record.due_date").alias("due_date"))


def _requests(spark, sf):
    """Review requests and corrections; every fifth request gets a second correction, which comes later."""
    corrections = fx.corrections(spark, sf).withColumn("place", F.lit(1))
    second = corrections.where(F.col("doc_id") % 5 == 0).withColumn("corrected", F.lit("{}")).withColumn("place", F.lit(2))
    return _run(spark, sf).queue, corrections.unionByName(second)


def q_stream_reviews(spark, sf):
    """Every change of every review request."""
    from ..streaming.reviews import stream_reviews_once
    states, _ = stream_reviews_once(spark, *_requests(spark, sf), order_col="place")
    return states.select("doc_id", "state", flag(F.col("corrected") == "{}").alias("empty"))


def q_stream_pending(spark, sf):
    from ..streaming.reviews import still_pending, stream_reviews_once
    requests, corrections = _requests(spark, sf)
    states, _ = stream_reviews_once(spark, requests, corrections, order_col="place")
    return still_pending(states)


def q_first_corrections(spark, sf):
    from ..operators.review import apply_corrections
    requests, corrections = _requests(spark, sf)
    c = apply_corrections(requests, corrections, order_col="place")
    return c.select("doc_id", flag(F.col("correction_missing")).alias("correction_missing"),
                    flag(F.size("errors") == 0).alias("valid"), as_long("n_corrections").alias("n_corrections"))


HANG_EVERY = 1009
HANG_DEADLINE = 6.0


def make_hanging_extractor():
    """The stand-in client, over a service that never answers for some orders."""
    import re
    import time

    read, order = make_stub_extractor(), re.compile(r"(?m)^Summary: order ([0-9]+)$")

    def extract(text: str) -> str:
        number = order.search(text)
        if number and int(number.group(1)) % HANG_EVERY == 0:
            time.sleep(60)
        return read(text)

    return extract


def q_model_deadline(spark, sf):
    """Calls that hang become errors after the deadline, and their documents go to review."""
    docs = _pipeline_docs(spark, sf)
    answers = cut(model_extract(docs, make_hanging_extractor, attempts=1, concurrency=8, deadline=HANG_DEADLINE))
    status = document_status(docs.join(extraction_results(answers), "doc_id", "left"))
    late = F.coalesce(F.col("error").startswith("TimeoutError"), F.lit(False))
    return (status.join(answers.select("doc_id", "error"), "doc_id", "left")
            .select("doc_id", "status", "route", flag(late).alias("timed_out"), flag(F.col("error").isNotNull()).alias("has_error")))


def q_stream_append(spark, sf):
    from ..streaming.pipeline import stream_append_once
    table = stream_append_once(spark, _run(spark, sf, stored_stage=True).stored)
    return table.select(as_long("id").alias("id"), "account_number", "customer_name", ds("billing_date").alias("billing_date"),
                        F.col("total_amount_due").cast("double").alias("total_amount_due"), "document_type")


def q_stream_all(spark, sf):
    from ..streaming.pipeline import stream_all_once
    table = stream_all_once(spark, _pipeline_docs(spark, sf), fx.responses(spark, sf), fx.corrections(spark, sf))
    return table.select(as_long("id").alias("id"), "account_number", "customer_name", ds("billing_date").alias("billing_date"),
                        F.col("total_amount_due").cast("double").alias("total_amount_due"), "document_type")


# ---------------------------------------------------------------- 2.9 stages

def q_registered_stage(spark, sf):
    reg = default_registry()
    out = reg.run(fx.statements(spark, sf), ["filter_blank_content", "extract_bills"])
    return out.select("doc_id", "document_path", "account_number", "total_amount_due", ds("due_date").alias("due_date"))


QUERIES: dict[str, Query] = {
    "scan_documents": q_scan_documents,
    "scan_document_files": q_scan_document_files,
    "scan_binary_files": q_scan_binary_files,
    "scan_workitems": q_scan_workitems,
    "bills_table": q_bills_table,
    "append_bills": q_append_bills,
    "export_records_json": q_export_records_json,
    "filter_blank_content": q_filter_blank_content,
    "guard_required_path": q_guard_required_path,
    "build_storage_payload": q_build_storage_payload,
    "review_queue": q_review_queue,
    "text_measure": q_text_measure,
    "context_budget": q_context_budget,
    "render_prompt": q_render_prompt,
    "assemble_parts": q_assemble_parts,
    "html_to_markdown": q_html_to_markdown,
    "html_order_pages": q_html_order_pages,
    "html_table_cells": q_html_table_cells,
    "wide_line_items": q_wide_line_items,
    "split_pages": q_split_pages,
    "heading_sections": q_heading_sections,
    "table_cells": q_table_cells,
    "label_candidates": q_label_candidates,
    "normalize_dates": q_normalize_dates,
    "parse_money": q_parse_money,
    "normalize_account": q_normalize_account,
    "line_items": q_line_items,
    "reconciled_bills": q_reconciled_bills,
    "extract_bills": q_extract_bills,
    "model_extract": q_model_extract,
    "validate_response": q_validate_response,
    "first_valid_attempt": q_first_valid_attempt,
    "validate_invoice": q_validate_invoice,
    "document_status": q_document_status,
    "route_decision": q_route_decision,
    "validate_direct": q_validate_direct,
    "validate_direct_json": q_validate_direct_json,
    "validate_corrected": q_validate_corrected,
    "capture_errors": q_capture_errors,
    "task_log": q_task_log,
    "apply_corrections": q_apply_corrections,
    "pending_reviews": q_pending_reviews,
    "store_all": q_store_all,
    "enforce_store_constraints": q_enforce_store_constraints,
    "encode_line_items": q_encode_line_items,
    "workflow_output": q_workflow_output,
    "stream_ingest": q_stream_ingest,
    "stream_corrections": q_stream_corrections,
    "stream_extract": q_stream_extract,
    "stream_extract_rules": q_stream_extract_rules,
    "stream_reviews": q_stream_reviews,
    "stream_pending": q_stream_pending,
    "first_corrections": q_first_corrections,
    "model_deadline": q_model_deadline,
    "stream_append": q_stream_append,
    "stream_all": q_stream_all,
    "registered_stage": q_registered_stage,
}
