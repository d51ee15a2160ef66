"""The whole document run as one Spark plan.

work items + documents -> status (guard, blank check, extraction result) -> routes:
success -> payload -> direct-store checks; failure -> review queue -> corrections ->
corrected-store checks; everything else is counted, not stored. Both branches land
in one table. All joins are keyed by ``doc_id``. A caller that uses two or more
branches asks for ``stored_stage``: the routed stage (with texts only its validated records) is then computed once and kept in the
shared folder; with one branch only, Spark prunes what that branch does not need.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank
from ..operators.responses import first_valid_response
from ..operators.review import apply_corrections, pending_reviews
from ..operators.routing import (
    build_storage_payload, document_status, review_queue, route_decision, validate_corrected,
    validate_direct,
)
from ..operators.store import constraint_error, table_rows
from ..schemas import MODEL_MAX_RETRIES, STATUS_COMPLETED
from ..session import cut, stored


@dataclass
class PipelineRun:
    processed: DataFrame  # doc_id, document_path, document_type_hint, text, record, status, route, reason
    success: DataFrame
    failure: DataFrame
    unrouted: DataFrame
    direct: DataFrame  # success rows with payload, store_error, store_status, store_reason
    queue: DataFrame  # review requests
    corrected: DataFrame  # corrections joined to requests, with checks
    pending: DataFrame  # requests still waiting
    stored: DataFrame  # accepted rows in table layout (+ doc_id, branch), without id


def join_documents(documents: DataFrame, work: DataFrame) -> DataFrame:
    """Documents with their work item (path and type hint) by ``doc_id``."""
    return documents.drop("document_path").join(
        work.select("doc_id", "document_path", "document_type_hint"), "doc_id", "inner")


def extraction_results(responses: DataFrame, max_attempts: int = MODEL_MAX_RETRIES + 1) -> DataFrame:
    """``(doc_id, record)``: the first valid attempt. Documents whose model calls all failed or
    gave nothing valid are absent, so they have no record and go to review."""
    return first_valid_response(responses, max_attempts).select("doc_id", "record")


def text_mark(text: str = "text"):
    """What the checks ask of a text: NULL, empty if it is blank, else one mark."""
    return F.when(F.col(text).isNotNull(), F.when(is_blank(text), F.lit("")).otherwise(F.lit("text")))


def with_texts(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows of the table layout with the texts of their documents, for those that are written only."""
    texts = documents.select(F.col("doc_id").alias("_of"), F.col("text").alias("_text"))
    whole = rows.join(texts, F.col("doc_id") == F.col("_of"), "left").drop("_of")
    return whole.withColumn("raw_ocr_text", F.when(F.col("raw_ocr_text").isNotNull(), F.col("_text"))).drop("_text")


def run_pipeline(documents: DataFrame, responses: DataFrame, corrections: DataFrame,
                 max_attempts: int = MODEL_MAX_RETRIES + 1, stored_stage: bool = False, keep_text: bool = True) -> PipelineRun:
    """``documents``: doc_id, document_path, document_type_hint, text[, pipeline_error].
    ``responses``: doc_id, attempt, response. ``corrections``: doc_id, corrected.

    Without ``keep_text`` no text goes into a join or a stored stage: a mark stands for it from the scan on (``text_mark``),
    which every check treats like the text. ``with_texts`` fetches the texts of the rows that are written.
    With it a stored stage holds the validated records alone: each branch reads the texts from ``documents`` and writes no copy of them.
    """
    if not keep_text:
        documents = documents.withColumn("text", text_mark())
    results = extraction_results(responses, max_attempts)
    if stored_stage and keep_text:
        results = stored(results)
    processed = document_status(documents.join(results, "doc_id", "left"))
    if stored_stage and not keep_text:
        processed = cut(processed)
    routes = route_decision(processed)

    direct = build_storage_payload(routes["success"])
    direct = direct.withColumn("store_error", constraint_error("payload.record", "payload.document_type"))
    direct = validate_direct(direct)

    queue = review_queue(processed)
    corrected = apply_corrections(queue, corrections)
    corrected = corrected.withColumn("store_error", constraint_error("record", "document_type_hint"))
    corrected = validate_corrected(corrected)
    if stored_stage and not keep_text:
        corrected = cut(corrected)  # its keys number the rows, its rows are stored
    pending = pending_reviews(queue, corrections)

    ok = F.col("store_status") == STATUS_COMPLETED
    stored_direct = table_rows(direct.where(ok), "payload.record", "payload.full_ocr_text",
                               "payload.document_type").withColumn("branch", F.lit("direct"))
    stored_corrected = table_rows(corrected.where(ok), "record", "full_ocr_text",
                                  "document_type_hint").withColumn("branch", F.lit("corrected"))
    return PipelineRun(processed, routes["success"], routes["failure"], routes["unrouted"],
                       direct, queue, corrected, pending, stored_direct.unionByName(stored_corrected))


def extract_files(spark, path: str, path_glob: str | None = "*.md") -> DataFrame:
    """Markdown files -> one indented JSON record per file: ``(document_path, json)``.

    Whole-file read, rule extraction, JSON export; the batch form of running the
    extractor over single files from the command line.
    """
    from ..operators.extract import extract_records
    from ..operators.store import export_records_json
    from ..sources.documents import read_text_documents

    docs = read_text_documents(spark, path, path_glob=path_glob)
    records = extract_records(docs, id_col="document_path")
    return export_records_json(records, id_col="document_path")
