"""Document-to-table processing on Spark: parse, extract, validate, route, correct, store.

Every operator takes and returns DataFrames (or Columns); nothing here creates a
session or runs a job at import time.
"""

from .operators.extract import extract_bills, extract_records, label_candidates, line_items
from .operators.markdown import heading_sections, split_lines, split_pages, table_cells
from .operators.responses import first_valid_attempt, model_extract, validate_invoice, validate_response
from .operators.review import apply_corrections, pending_reviews
from .operators.routing import (
    build_storage_payload, capture_errors, document_status, guard_required_path, review_queue,
    route_decision, task_log, validate_corrected, validate_direct, workflow_output,
)
from .operators.stages import StageRegistry, default_registry
from .operators.store import (
    append_bills, append_rows, assign_ids, encode_line_items, enforce_store_constraints,
    ensure_bills_table, export_records_json,
)
from .operators.text import (
    assemble_parts, context_budget, filter_blank_content, html_to_markdown, prompt_messages,
    render_prompt, text_measure,
)
from .plans.pipeline import run_pipeline
from .schemas import BILL_RECORD, BILLS_TABLE, INVOICE_RECORD, REGISTRY, RecordSchema
from .sources.documents import (
    parse_workitems, read_binary_documents, read_text_documents, read_text_table, scan_documents,
    scan_workitems,
)
from .sources.tables import write_bucketed

__all__ = [name for name in dir() if not name.startswith("_")]
