"""Record schemas, the stored-table contract, and fixed values.

A record schema is plain data: an ordered list of ``(field, kind)``. The validator
(``functions.validation``) and the Spark types are both generated from it, so a new
document type is a new entry in ``REGISTRY``, not new code.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

STRING = "string"
DATE = "date"
FLOAT = "float"


@dataclass(frozen=True)
class ListOf:
    """A nullable list of nested records."""

    item: "RecordSchema"


@dataclass(frozen=True)
class RecordSchema:
    """An object whose fields are all optional; unknown keys are ignored."""

    name: str
    fields: tuple

    @property
    def names(self) -> list[str]:
        return [f for f, _ in self.fields]

    def spark_type(self) -> T.StructType:
        return T.StructType([T.StructField(f, _spark_kind(k), True) for f, k in self.fields])


def _spark_kind(kind) -> T.DataType:
    if isinstance(kind, ListOf):
        return T.ArrayType(kind.item.spark_type(), True)
    return {STRING: T.StringType(), DATE: T.DateType(), FLOAT: T.DoubleType()}[kind]


LINE_ITEM = RecordSchema("LineItem", (("description", STRING), ("amount", FLOAT)))

BILL_RECORD = RecordSchema(
    "BillRecord",
    (
        ("account_number", STRING),
        ("customer_name", STRING),
        ("service_address", STRING),
        ("billing_address", STRING),
        ("billing_date", DATE),
        ("billing_period_start_date", DATE),
        ("billing_period_end_date", DATE),
        ("due_date", DATE),
        ("total_amount_due", FLOAT),
        ("previous_balance", FLOAT),
        ("payments_received", FLOAT),
        ("current_charges", FLOAT),
        ("line_items", ListOf(LINE_ITEM)),
        ("raw_text_summary", STRING),
    ),
)

INVOICE_RECORD = RecordSchema(
    "InvoiceRecord",
    (
        ("invoice_number", STRING),
        ("vendor_name", STRING),
        ("invoice_date", DATE),
        ("total_amount", FLOAT),
        ("raw_text", STRING),
    ),
)

# --- fixed values: these must equal the reference's for the same results -------------
DEFAULT_DOCUMENT_TYPE = "PSEG_BILL"
ROUTE_SUCCESS = "LLM_SUCCESS"
ROUTE_FAILURE = "LLM_FAILURE"
ROUTE_ERROR = "PIPELINE_ERROR"
STATUS_COMPLETED = "COMPLETED"
STATUS_FAILED = "FAILED"
REVIEW_STORED = "PROCESSED_AND_STORED"
MSG_NO_PATH = "Document path not provided"
MSG_NO_CONTENT = "Document parsing failed or no content"  # parser name left out
MSG_NO_PAYLOAD = "Missing db_storage_payload"
MSG_NO_RECORD = "Missing pseg_data_dict"
MSG_RECORD_INVALID = "PSEGData model reconstruction failed: "
MSG_NO_TEXT_OR_TYPE = "Missing full_ocr_text or document_type"
MSG_INSERT_FAILED = "DB insertion failed to return ID"
MSG_CORRECTION_MISSING = "Missing 'corrected_pseg_data_dict' in input for human corrected data."
MSG_CORRECTION_TEXT_OR_TYPE = ("Missing 'full_ocr_text' or 'document_type_hint' in input for human "
                               "corrected data. OCR Text: %s, Type: %s")
MSG_CORRECTION_INVALID = "Corrected PSEGData model reconstruction failed: "
MSG_CORRECTION_INSERT_FAILED = "DB insertion of human corrected data failed"
MSG_CRITICAL = "Critical error: "
RECORD_KEY = "pseg_data_dict"  # the record inside a storage payload
ACCOUNT_MAX_CHARS = 255      # VARCHAR(255)
DOCUMENT_TYPE_MAX_CHARS = 100  # VARCHAR(100)
AMOUNT_PRECISION, AMOUNT_SCALE = 10, 2  # NUMERIC(10, 2)
MODEL_MAX_RETRIES = 2
MODEL_TIMEOUT_SECONDS = 600
CONTEXT_MAX_TOKENS = 3000
PART_SEPARATOR = "\n\n"
# --- end of fixed values ---------------------------------------------------------------

REGISTRY = {
    DEFAULT_DOCUMENT_TYPE: BILL_RECORD,
    "GENERIC_INVOICE": INVOICE_RECORD,
}

AMOUNT_TYPE = T.DecimalType(AMOUNT_PRECISION, AMOUNT_SCALE)

# Target table: id, the record's scalar fields, JSON line items, text, type, time.
BILLS_TABLE = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("account_number", T.StringType(), True),
    T.StructField("customer_name", T.StringType(), True),
    T.StructField("service_address", T.StringType(), True),
    T.StructField("billing_address", T.StringType(), True),
    T.StructField("billing_date", T.DateType(), True),
    T.StructField("billing_period_start_date", T.DateType(), True),
    T.StructField("billing_period_end_date", T.DateType(), True),
    T.StructField("due_date", T.DateType(), True),
    T.StructField("total_amount_due", AMOUNT_TYPE, True),
    T.StructField("previous_balance", AMOUNT_TYPE, True),
    T.StructField("payments_received", AMOUNT_TYPE, True),
    T.StructField("current_charges", AMOUNT_TYPE, True),
    T.StructField("line_items", T.StringType(), True),
    T.StructField("raw_text_summary", T.StringType(), True),
    T.StructField("raw_ocr_text", T.StringType(), True),
    T.StructField("document_type", T.StringType(), True),
    T.StructField("created_at", T.TimestampType(), True),
])

BILLS_TABLE_DDL = """
  id BIGINT NOT NULL, account_number STRING, customer_name STRING, service_address STRING,
  billing_address STRING, billing_date DATE, billing_period_start_date DATE,
  billing_period_end_date DATE, due_date DATE, total_amount_due DECIMAL(10,2),
  previous_balance DECIMAL(10,2), payments_received DECIMAL(10,2),
  current_charges DECIMAL(10,2), line_items STRING, raw_text_summary STRING,
  raw_ocr_text STRING, document_type STRING, created_at TIMESTAMP
"""

AMOUNT_FIELDS = ("total_amount_due", "previous_balance", "payments_received", "current_charges")

WORK_ITEM = T.StructType([
    T.StructField("document_path", T.StringType(), True),
    T.StructField("document_type_hint", T.StringType(), True),
])
