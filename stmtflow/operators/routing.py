"""Task status, routing, store-time checks and per-task logs, as column logic.

Each reference task is a chain of early returns; here each is one ``when`` chain
evaluated per row in its original order, so "first failing check wins" holds and
one bad document never stops the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col_of, is_blank
from ..functions.validation import falsy_variant, parse_object, validate_frame
from ..schemas import (
    BILL_RECORD, RECORD_KEY, RecordSchema,
    MSG_CORRECTION_INSERT_FAILED, MSG_CORRECTION_INVALID, MSG_CORRECTION_MISSING,
    MSG_CORRECTION_TEXT_OR_TYPE, MSG_CRITICAL, MSG_INSERT_FAILED, MSG_NO_CONTENT, MSG_NO_PATH,
    MSG_NO_PAYLOAD, MSG_NO_RECORD, MSG_NO_TEXT_OR_TYPE, MSG_RECORD_INVALID, REVIEW_STORED,
    ROUTE_ERROR, ROUTE_FAILURE, ROUTE_SUCCESS, STATUS_COMPLETED, STATUS_FAILED,
)
from .responses import error_detail


def _null_str() -> Column:
    return F.lit(None).cast("string")


def missing_path(path) -> Column:
    """Python ``not path``: NULL or empty (whitespace counts as a path)."""
    path = col_of(path)
    return path.isNull() | (path == "")


def guard_required_path(df: DataFrame, path_col: str = "document_path") -> DataFrame:
    """Add ``path_ok`` and, for rows without a path, the failure ``reason``."""
    bad = missing_path(path_col)
    return (df.withColumn("path_ok", ~bad)
              .withColumn("guard_reason", F.when(bad, F.lit(MSG_NO_PATH))))


def document_status(df: DataFrame, path_col: str = "document_path", text_col: str = "text",
                    record_col: str = "record", error_col: str | None = "pipeline_error") -> DataFrame:
    """Task status, routing value and reason per document; first match wins.

    no path -> FAILED (no route) · no content -> FAILED (no route) · a failure outside the
    model call (``error_col``) -> FAILED / PIPELINE_ERROR · record -> COMPLETED / LLM_SUCCESS ·
    otherwise, which includes every failure of the model itself, COMPLETED / LLM_FAILURE.
    """
    no_path = missing_path(path_col)
    no_text = is_blank(text_col)
    err = F.col(error_col) if error_col and error_col in df.columns else _null_str()
    has_record = F.col(record_col).isNotNull()
    status = (F.when(no_path | no_text | err.isNotNull(), F.lit(STATUS_FAILED))
              .otherwise(F.lit(STATUS_COMPLETED)))
    route = (F.when(no_path | no_text, _null_str())
             .when(err.isNotNull(), F.lit(ROUTE_ERROR))
             .when(has_record, F.lit(ROUTE_SUCCESS))
             .otherwise(F.lit(ROUTE_FAILURE)))
    reason = (F.when(no_path, F.lit(MSG_NO_PATH))
              .when(no_text, F.lit(MSG_NO_CONTENT))
              .when(err.isNotNull(), F.concat(F.lit(MSG_CRITICAL), err)))
    return df.withColumn("status", status).withColumn("route", route).withColumn("reason", reason)


def route_branch(route_col: str = "route") -> Column:
    """Branch of a row: ``success``, ``failure``, or ``unrouted`` for every other value (NULL, PIPELINE_ERROR)."""
    r = F.col(route_col)
    return (F.when(r == ROUTE_SUCCESS, F.lit("success")).when(r == ROUTE_FAILURE, F.lit("failure"))
            .otherwise(F.lit("unrouted")))


def route_decision(df: DataFrame, route_col: str = "route") -> dict[str, DataFrame]:
    """The rows of each branch (``route_branch``), as a dictionary of frames."""
    branch = route_branch(route_col)
    return {name: df.where(branch == name) for name in ("success", "failure", "unrouted")}


def build_storage_payload(df: DataFrame, record_col: str = "record", text_col: str = "text",
                          type_col: str = "document_type_hint") -> DataFrame:
    """Success rows -> ``payload struct<record, full_ocr_text, document_type>``."""
    payload = F.struct(F.col(record_col).alias("record"), F.col(text_col).alias("full_ocr_text"),
                       F.col(type_col).alias("document_type"))
    return df.withColumn("payload", payload)


def review_queue(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 type_col: str = "document_type_hint", path_col: str = "document_path") -> DataFrame:
    """Failure rows -> the review request ``(doc_id, full_ocr_text, document_type_hint,
    original_document_path)``."""
    return df.where(F.col("route") == ROUTE_FAILURE).select(
        id_col, F.col(text_col).alias("full_ocr_text"), F.col(type_col).alias("document_type_hint"),
        F.col(path_col).alias("original_document_path"))


def parse_storage_payload(df: DataFrame, json_col: str = "payload_json", schema: RecordSchema = BILL_RECORD) -> DataFrame:
    """JSON payloads -> ``payload struct<record, full_ocr_text, document_type>``, ``errors`` and ``record_missing``.

    An absent, null or empty payload (Python falsiness, ``{}`` counts) is a NULL ``payload``; an absent
    or empty record sets ``record_missing``; a record that fails the schema has ``errors``.
    """
    v = parse_object(F.col(json_col))
    staged = df.withColumn("_pv", v).withColumn("_rv", F.try_variant_get("_pv", f"$.{RECORD_KEY}", "variant"))
    record_type = F.coalesce(F.schema_of_variant("_rv"), F.lit("VOID"))
    staged = (staged.withColumn("record_missing", falsy_variant(F.col("_rv")))
              .withColumn("_no_payload", falsy_variant(F.col("_pv")) | ~F.coalesce(
                  F.schema_of_variant("_pv").startswith("OBJECT"), F.lit(False))))
    staged = staged.withColumn("_present", record_type != "VOID")
    checked = validate_frame(staged, "_rv", schema, present=F.col("_present"), record_col="_record", barrier=True)
    payload = F.struct(F.col("_record").alias("record"),
                       F.try_variant_get("_pv", "$.full_ocr_text", "string").alias("full_ocr_text"),
                       F.try_variant_get("_pv", "$.document_type", "string").alias("document_type"))
    return (checked.withColumn("payload", F.when(~F.col("_no_payload"), payload))
            .drop("_pv", "_rv", "_no_payload", "_present", "_record"))


def validate_direct(df: DataFrame, payload_col: str = "payload", errors_col: str = "errors",
                    store_error_col: str = "store_error", missing_col: str = "record_missing") -> DataFrame:
    """Checks of the direct store, in the reference's order.

    payload missing -> record missing -> record invalid -> text or type NULL (an empty
    string passes) -> the insert would be refused. Adds ``store_status`` and
    ``store_reason``; ``store_error`` comes from ``enforce_store_constraints``. A payload built
    from a validated record has a record or none; one parsed from JSON
    (``parse_storage_payload``) carries ``errors`` and ``record_missing``, which tell an invalid
    record from a missing one.
    """
    p = F.col(payload_col)
    store_err = F.col(store_error_col) if store_error_col in df.columns else _null_str()
    parsed = errors_col in df.columns
    invalid = (F.size(errors_col) > 0) if parsed else F.lit(False)
    missing = F.col(missing_col) if missing_col in df.columns else p["record"].isNull() & ~invalid
    detail = error_detail(errors_col) if parsed else _null_str()
    reason = (F.when(p.isNull(), F.lit(MSG_NO_PAYLOAD))
              .when(missing, F.lit(MSG_NO_RECORD))
              .when(invalid, F.concat(F.lit(MSG_RECORD_INVALID), detail))
              .when(p["full_ocr_text"].isNull() | p["document_type"].isNull(), F.lit(MSG_NO_TEXT_OR_TYPE))
              .when(store_err.isNotNull(), F.lit(MSG_INSERT_FAILED)))
    return (df.withColumn("store_reason", reason)
              .withColumn("store_status", F.when(reason.isNull(), F.lit(STATUS_COMPLETED))
                          .otherwise(F.lit(STATUS_FAILED))))


def _presence(c: Column) -> Column:
    """Python truthiness of a string: 'present' or 'missing'."""
    return F.when(c.isNotNull() & (c != ""), F.lit("present")).otherwise(F.lit("missing"))


def validate_corrected(df: DataFrame, missing_col: str = "correction_missing",
                       errors_col: str = "errors", text_col: str = "full_ocr_text",
                       type_col: str = "document_type_hint",
                       store_error_col: str = "store_error") -> DataFrame:
    """Checks of the corrected store, in *its* order (different from the direct one).

    record missing or empty (``{}`` counts) -> text or type NULL, naming which by
    truthiness -> record invalid -> the insert would be refused.
    """
    text, typ = F.col(text_col), F.col(type_col)
    store_err = F.col(store_error_col) if store_error_col in df.columns else _null_str()
    reason = (F.when(F.col(missing_col), F.lit(MSG_CORRECTION_MISSING))
              .when(text.isNull() | typ.isNull(),
                    F.format_string(MSG_CORRECTION_TEXT_OR_TYPE, _presence(text), _presence(typ)))
              .when(F.size(errors_col) > 0, F.concat(F.lit(MSG_CORRECTION_INVALID), error_detail(errors_col)))
              .when(store_err.isNotNull(), F.lit(MSG_CORRECTION_INSERT_FAILED)))
    return (df.withColumn("store_reason", reason)
              .withColumn("store_status", F.when(reason.isNull(), F.lit(STATUS_COMPLETED))
                          .otherwise(F.lit(STATUS_FAILED))))


def capture_errors(df: DataFrame, error_col: str = "pipeline_error") -> DataFrame:
    """Rows with a failure outside the model call become FAILED with ``Critical error: ...``; others,
    and rows that had failed before, go on as they are."""
    err = F.col(error_col)
    fresh = err.isNotNull() & (F.col("status") != STATUS_FAILED)
    return (df.withColumn("reason", F.when(fresh, F.concat(F.lit(MSG_CRITICAL), err)).otherwise(F.col("reason")))
              .withColumn("status", F.when(fresh, F.lit(STATUS_FAILED)).otherwise(F.col("status"))))


# Log wording is ours; one entry per task outcome.
def process_log(path_col: str = "document_path") -> Column:
    p = F.coalesce(F.col(path_col), F.lit("None"))
    r = F.col("route")
    entry = (F.when(missing_path(path_col), F.lit("skipped: no path given"))
             .when(F.col("reason") == MSG_NO_CONTENT, F.format_string("skipped %s: it holds no text", p))
             .when(r == ROUTE_ERROR, F.concat(F.lit("stopped by an error: "), F.col("reason")))
             .when(r == ROUTE_SUCCESS, F.format_string("record read from %s", p))
             .otherwise(F.format_string("no record read from %s, a reviewer is asked", p)))
    return F.array(entry)


def store_log(direct: bool) -> Column:
    source = "extracted" if direct else "reviewed"
    refused = F.lit(MSG_INSERT_FAILED if direct else MSG_CORRECTION_INSERT_FAILED)
    entry = (F.when(F.col("store_reason").isNull(), F.format_string(f"{source} record is row %d", F.col("id")))
             .when(F.col("store_reason") == refused, F.lit(f"{source} record refused by the table"))
             .otherwise(F.col("store_reason")))
    return F.array(entry)


def task_log(df: DataFrame, task: str, logs: Column, id_col: str = "doc_id") -> DataFrame:
    """Flat log table ``(doc_id, task, seq, entry)`` from a per-row array of entries."""
    return (df.select(F.col(id_col), F.posexplode(logs).alias("seq", "entry"))
              .select(id_col, F.lit(task).alias("task"), (F.col("seq") + 1).alias("seq"), "entry"))


def workflow_output(documents: DataFrame, direct: DataFrame, corrected: DataFrame, id_col: str = "doc_id",
                    route_col: str = "route") -> DataFrame:
    """Per document: final routing status and each branch's output; absent parts NULL.

    ``documents`` carry their ``route``; ``direct`` and ``corrected`` have ``store_status``,
    ``store_reason`` and ``id`` (NULL when not stored). A document is in one branch at most, so
    both branches are one frame and one join on the document key.
    """
    def output(df, kind):
        return df.select(id_col, F.lit(kind).alias("_kind"), F.col("store_status").alias("_status"),
                         F.col("id").cast("string").alias("_id"), F.col("store_reason").alias("_reason"))

    both = output(direct, "direct").unionByName(output(corrected, "corrected"))
    joined = documents.select(id_col, F.col(route_col).alias("final_status_doc_processing")).join(both, id_col, "left")
    stored = F.struct(F.col("_status").alias("status"), F.col("_id").alias("db_insertion_id"), F.col("_reason").alias("reason"))
    reviewed = F.struct(F.col("_status").alias("status"), F.col("_id").alias("db_insertion_id"),
                        F.when(F.col("_status") == STATUS_COMPLETED, F.lit(REVIEW_STORED)).alias("status_human_review"),
                        F.col("_reason").alias("reason"))
    return joined.select(id_col, "final_status_doc_processing",
                         F.when(F.col("_kind") == "direct", stored).alias("direct_storage_output"),
                         F.when(F.col("_kind") == "corrected", reviewed).alias("human_corrected_storage_output"))
