"""DuckDB SQL for every registered query, run on the same Parquet tables.

Expected values come from the base tables and the fixture rules of
``plans.fixtures`` (response class ``o_orderkey % 10``, review class
``(o_orderkey // 10) % 4``, constraint cases ``% 97``, ``% 101``, ``% 103``), not from
the Spark operators. ``html_to_markdown``, ``render_prompt`` and ``filter_blank_content`` are
written out here on their own, from the pages' known structure and the prompt's wording.
"""

from __future__ import annotations

from ..schemas import (
    DEFAULT_DOCUMENT_TYPE, MSG_CORRECTION_INSERT_FAILED, MSG_CORRECTION_INVALID, MSG_CORRECTION_MISSING,
    MSG_INSERT_FAILED, MSG_NO_CONTENT, MSG_NO_PATH, MSG_NO_PAYLOAD, MSG_NO_RECORD, MSG_NO_TEXT_OR_TYPE, MSG_RECORD_INVALID,
)
from .fixtures import LONG_TYPE

BLANK_CLASS = r"[\t\n\x0b\x0c\r \x1c-\x1f\x85\p{Z}]*"


def lit(s: str) -> str:
    """A SQL string literal; newlines go through chr(10)."""
    parts = s.split("\n")
    quoted = ["'" + p.replace("'", "''") + "'" for p in parts]
    return " || chr(10) || ".join(quoted) if len(parts) > 1 else quoted[0]


# Orders with their fixture classes, customer and line-item totals.
O = """
o AS (
  SELECT o_orderkey AS doc_id, o_orderkey % 10 AS k, (o_orderkey // 10) % 4 AS r, o_orderkey % 4 AS v,
         o_custkey, o_totalprice, CAST(o_orderdate AS DATE) AS d
  FROM orders),
li AS (
  SELECT l_orderkey, count(*) AS n, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS s
  FROM lineitem GROUP BY l_orderkey),
oc AS (
  SELECT o.*, c_name, c_acctbal, coalesce(li.n, 0) AS n_items, coalesce(li.s, 0) AS items_sum
  FROM o LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN li ON l_orderkey = doc_id)
"""

ACCOUNT = "lpad(CAST(o_custkey AS VARCHAR), 10, '0')"
ACCOUNT_OVR = f"CASE WHEN doc_id % 103 = 0 THEN repeat('9', 300) ELSE {ACCOUNT} END"
TOTAL_OVR = "CASE WHEN doc_id % 97 = 0 THEN 100000000.0 ELSE o_totalprice END"
TYPE_OVR = f"CASE WHEN doc_id % 101 = 0 THEN {lit(LONG_TYPE)} ELSE {lit(DEFAULT_DOCUMENT_TYPE)} END"
DS = "strftime({}, '%Y-%m-%d')"
PATH = "'statements/' || CAST(doc_id AS VARCHAR) || '.md'"
DIRECT_REFUSED = "(doc_id % 101 = 0 OR (k <> 6 AND (doc_id % 97 = 0 OR doc_id % 103 = 0)))"
CORRECTED_REFUSED = "(doc_id % 101 = 0 OR doc_id % 97 = 0 OR doc_id % 103 = 0)"
SUCCESS = "k IN (0, 1, 2, 6, 8)"
FAILURE = "k IN (3, 4, 5, 7)"
RECORD_INVALID = MSG_CORRECTION_INVALID + "1 validation error: billing_date: date_from_datetime_parsing"


def _w(body: str) -> str:
    return f"WITH {O.strip()}\n{body}"


SQL: dict[str, str] = {}

SQL["scan_documents"] = """
SELECT doc_id, concat_ws('/', source, CAST(doc_id AS VARCHAR) || '.md') AS document_path, text FROM documents
"""

FILE_TEXT = "CASE WHEN doc_id % 10 = 0 THEN '' ELSE coalesce(text, '') END"
SQL["scan_document_files"] = f"""
SELECT doc_id, coalesce(lang, 'None') || '/' || coalesce(source, 'None') AS folder, length({FILE_TEXT})::BIGINT AS n_chars,
  md5({FILE_TEXT}) AS digest FROM documents
"""
SQL["scan_binary_files"] = f"""
SELECT doc_id, strlen({FILE_TEXT})::BIGINT AS length, md5({FILE_TEXT}) AS digest FROM documents
"""

MIXED = """
m AS (SELECT o_orderkey AS doc_id, o_orderkey % 7 AS m FROM orders)
"""
SQL["scan_workitems"] = f"""
WITH {MIXED.strip()}
SELECT doc_id,
  CASE WHEN m IN (3, 5) THEN NULL WHEN m = 4 THEN '' ELSE {PATH} END AS document_path,
  CASE WHEN m = 1 THEN NULL WHEN m = 2 THEN 'GENERIC_INVOICE' ELSE 'PSEG_BILL' END AS document_type_hint
FROM m
"""

SQL["guard_required_path"] = f"""
WITH {MIXED.strip()}
SELECT doc_id, CASE WHEN m IN (3, 4, 5) THEN 0 ELSE 1 END::BIGINT AS path_ok,
  CASE WHEN m IN (3, 4, 5) THEN {lit(MSG_NO_PATH)} END AS guard_reason
FROM m
"""

# What the statement layouts (v) print.
SERVICE = "CAST(o_custkey AS VARCHAR) || ' Elm Street'"
MAIL = "'PO Box ' || CAST(o_custkey AS VARCHAR)"
SUMMARY = "'order ' || CAST(doc_id AS VARCHAR)"
DECOY = "CAST(CAST(o_totalprice + 100 AS DECIMAL(18,2)) AS DOUBLE)"
TOTAL_READ = f"CASE WHEN v < 2 THEN o_totalprice ELSE {DECOY} END"
PAYMENT = "CASE WHEN v % 2 = 1 THEN o_custkey % 500 + 0.25::DOUBLE END"

BILL_ROW = f"""
  doc_id, {ACCOUNT} AS account_number, c_name AS customer_name,
  {SERVICE} AS service_address, {MAIL} AS billing_address,
  {DS.format('d')} AS billing_date, {DS.format('d - 31')} AS billing_period_start_date,
  {DS.format('d - 1')} AS billing_period_end_date, {DS.format('d + 14')} AS due_date,
  {TOTAL_READ} AS total_amount_due, c_acctbal AS previous_balance, {PAYMENT} AS payments_received,
  o_totalprice AS current_charges"""

SQL["bills_table"] = _w(f"""
SELECT {BILL_ROW}, n_items::BIGINT AS n_items, {SUMMARY} AS raw_text_summary,
  {lit(DEFAULT_DOCUMENT_TYPE)} AS document_type
FROM oc""")

SQL["extract_bills"] = _w(f"""
SELECT {BILL_ROW}, n_items::BIGINT AS n_items, CAST(items_sum AS DOUBLE) AS items_sum, {SUMMARY} AS raw_text_summary
FROM oc""")

SQL["export_records_json"] = _w(f"""
SELECT doc_id, {ACCOUNT} AS account_number, {DS.format('d')} AS billing_date,
  {TOTAL_READ} AS total_amount_due, 14::BIGINT AS n_keys,
  CASE WHEN n_items > 0 THEN n_items END::BIGINT AS n_items
FROM oc""")

# Stored rows of the pipeline: the direct branch and the valid corrections.
STORED = f"""
stored AS (
  SELECT doc_id, CASE WHEN {SUCCESS} THEN 'direct' ELSE 'corrected' END AS branch,
    CASE WHEN k = 6 THEN NULL ELSE {ACCOUNT} END AS account_number,
    CASE WHEN k = 6 THEN NULL ELSE c_name END AS customer_name,
    CASE WHEN k = 6 THEN NULL ELSE {DS.format('d')} END AS billing_date,
    CASE WHEN k = 6 THEN NULL ELSE {DS.format('d + 14')} END AS due_date,
    CASE WHEN k = 6 THEN NULL ELSE o_totalprice END AS total_amount_due,
    CASE WHEN k = 6 THEN NULL ELSE c_acctbal END AS previous_balance,
    CASE WHEN k = 6 THEN NULL ELSE o_totalprice END AS current_charges,
    CASE WHEN k IN (6, 8) THEN 0 ELSE n_items END::BIGINT AS n_items,
    {lit(DEFAULT_DOCUMENT_TYPE)} AS document_type
  FROM oc
  WHERE ({SUCCESS} AND NOT {DIRECT_REFUSED}) OR ({FAILURE} AND r = 1 AND NOT {CORRECTED_REFUSED}))
"""

SQL["store_all"] = _w(f""", {STORED.strip()}
SELECT * FROM stored""")

SQL["append_bills"] = _w(f""", {STORED.strip()}
SELECT row_number() OVER (ORDER BY doc_id)::BIGINT AS id, account_number, billing_date, total_amount_due,
  document_type
FROM stored""")

SQL["stream_append"] = _w(f""", {STORED.strip()}
SELECT row_number() OVER (ORDER BY doc_id)::BIGINT AS id, account_number, customer_name, billing_date, total_amount_due,
  document_type
FROM stored""")
SQL["stream_all"] = SQL["stream_append"]

SQL["filter_blank_content"] = f"""
SELECT doc_id, CASE WHEN text IS NULL OR regexp_full_match(text, '{BLANK_CLASS}') THEN 1 ELSE 0 END::BIGINT
  AS is_blank
FROM documents
"""

SQL["build_storage_payload"] = _w(f"""
SELECT doc_id, {TYPE_OVR} AS document_type,
  CASE WHEN k = 6 THEN NULL ELSE {ACCOUNT_OVR} END AS account_number, 1::BIGINT AS has_text
FROM oc WHERE {SUCCESS}""")

SQL["review_queue"] = _w(f"""
SELECT doc_id, {TYPE_OVR} AS document_type_hint, {PATH} AS original_document_path, 1::BIGINT AS has_text
FROM o WHERE {FAILURE}""")

SQL["text_measure"] = """
SELECT doc_id, length(text)::BIGINT AS n_chars_measured, n_chars::BIGINT AS n_chars FROM documents
"""

SQL["context_budget"] = """
SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS approx_tokens,
  CASE WHEN ceil(length(text) / 4.0) > 3000 THEN 1 ELSE 0 END::BIGINT AS over_budget,
  length(text)::BIGINT AS kept_chars
FROM documents
"""

SYSTEM = ("You turn PSEG_BILL documents into JSON. Answer with a single JSON object that follows the BillRecord schema; "
          "write dates as YYYY-MM-DD. The document is Markdown.")
HEAD = ("Fields to extract: account_number, customer_name, service_address, billing_address, billing_date, "
        "billing_period_start_date, billing_period_end_date, due_date, total_amount_due, previous_balance, payments_received, "
        "current_charges, line_items, raw_text_summary.\nDocument:\n<<<\n")
TAIL = "\n>>>\nAnswer with the JSON object only."
SQL["render_prompt"] = f"""
SELECT doc_id, 1::BIGINT AS seq, 'system' AS role, {lit(SYSTEM)} AS content FROM documents
UNION ALL
SELECT doc_id, 2::BIGINT AS seq, 'user' AS role, {lit(HEAD)} || text || {lit(TAIL)} AS content FROM documents
"""

SQL["assemble_parts"] = f"""
WITH ids AS (SELECT DISTINCT conv_id FROM conversations),
agg AS (
  SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text
  FROM conversations
  WHERE text IS NOT NULL AND NOT regexp_full_match(text, '{BLANK_CLASS}')
  GROUP BY conv_id)
SELECT ids.conv_id, agg.text FROM ids LEFT JOIN agg ON ids.conv_id = agg.conv_id
"""


# The pages' known structure: what counts stands between the menu and the footer, in a few kinds of elements.
_BLOCKS = ["<div class=\"ad\">", "</div>", "<article>", "</article>", "</h1>", "<p>", "</p>", "<br>"]
_html = "split_part(split_part(html, '</nav>', 2), '<footer>', 1)"
for _tag in _BLOCKS:
    _html = f"replace({_html}, {lit(_tag)}, chr(10))"
for _old, _new in (("<h1>", "chr(10) || '# '"), ("<b>", "''"), ("</b>", "''")):
    _html = f"replace({_html}, {lit(_old)}, {_new})"
_html = f"regexp_replace({_html}, '<!-- ad [0-9]+ -->', '', 'g')"
for _old, _new in (("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
    _html = f"replace({_html}, {lit(_old)}, {lit(_new)})"
SQL["html_to_markdown"] = f"""
SELECT page_id, trim(regexp_replace({_html}, '\\n\\n+', chr(10) || chr(10), 'g'), chr(10)) AS markdown FROM pages
"""

P1_LINES = "CASE v WHEN 0 THEN 17 WHEN 1 THEN 21 ELSE 24 END"
ITEM_LINES = "CASE WHEN n_items > 0 THEN 2 + n_items ELSE 0 END"
DUE_HEADING = "'Total amount due by ' || strftime(d + 14, '%b %-d, %Y')"
CHARGES = "CASE WHEN v < 2 THEN 'Charges' ELSE 'This month''s charges and credits' END"
SQL["split_pages"] = _w(f"""
SELECT doc_id, 1::BIGINT AS page, ({P1_LINES})::BIGINT AS n_lines, '# Total amount due' AS first_line FROM oc
UNION ALL
SELECT doc_id, 2::BIGINT AS page, (CASE WHEN v < 2 THEN 7 ELSE 9 END + {ITEM_LINES})::BIGINT AS n_lines,
  '# ' || coalesce(c_name, '') AS first_line FROM oc""")

SQL["heading_sections"] = _w(f"""
SELECT doc_id, 1::BIGINT AS page, 'Total amount due' AS heading,
  (CASE v WHEN 0 THEN 17 WHEN 1 THEN 18 WHEN 2 THEN 10 ELSE 11 END)::BIGINT AS n_lines FROM oc
UNION ALL SELECT doc_id, 1::BIGINT, {DUE_HEADING}, 3::BIGINT FROM oc WHERE v = 1
UNION ALL SELECT doc_id, 1::BIGINT, 'Service address', 4::BIGINT FROM oc WHERE v >= 2
UNION ALL SELECT doc_id, 1::BIGINT, 'Billing address', (CASE WHEN v = 2 THEN 4 ELSE 9 END)::BIGINT FROM oc WHERE v >= 2
UNION ALL SELECT doc_id, 1::BIGINT, 'Please pay by', 6::BIGINT FROM oc WHERE v = 2
UNION ALL SELECT doc_id, 2::BIGINT, coalesce(c_name, ''), (CASE WHEN v < 2 THEN 4 ELSE 2 END)::BIGINT FROM oc
UNION ALL SELECT doc_id, 2::BIGINT, 'Account number', 4::BIGINT FROM oc WHERE v >= 2
UNION ALL SELECT doc_id, 2::BIGINT, {CHARGES}, (3 + {ITEM_LINES})::BIGINT FROM oc""")

SQL["table_cells"] = _w("""
SELECT doc_id, 1::BIGINT AS page, (CASE WHEN v = 2 THEN 1 ELSE 2 END)::BIGINT AS n_rows,
  (CASE WHEN v = 2 THEN 2 ELSE 4 END)::BIGINT AS n_cells FROM oc
UNION ALL
SELECT doc_id, 2::BIGINT, (1 + CASE WHEN n_items > 0 THEN 1 + n_items ELSE 0 END)::BIGINT,
  (2 * (1 + CASE WHEN n_items > 0 THEN 1 + n_items ELSE 0 END))::BIGINT FROM oc""")

MONEY_TXT = "CAST(CAST({} AS DECIMAL(18,2)) AS VARCHAR)"
RANK_12 = "CASE WHEN v < 2 THEN 1 ELSE 2 END"
CANDIDATES = f"""
cand AS (
  SELECT doc_id, 'account_number' AS field, {RANK_12} AS rank, 2 AS page, {ACCOUNT} AS value, {ACCOUNT} AS raw FROM oc
  UNION ALL SELECT doc_id, 'customer_name', 1, 2, c_name, NULL FROM oc
  UNION ALL SELECT doc_id, 'service_address', {RANK_12}, 1, {SERVICE}, NULL FROM oc
  UNION ALL SELECT doc_id, 'billing_address', {RANK_12}, 1, {MAIL}, NULL FROM oc
  UNION ALL SELECT doc_id, 'billing_date', 1, 1, {DS.format('d')},
                   CASE WHEN v = 3 THEN strftime(d, '%b. %-d, %Y') ELSE strftime(d, '%B %-d, %Y') END FROM oc
  UNION ALL SELECT doc_id, 'billing_period_start_date', 1, 1, {DS.format('d - 31')}, strftime(d - 31, '%B %-d, %Y') FROM oc
  UNION ALL SELECT doc_id, 'billing_period_end_date', 1, 1, {DS.format('d - 1')}, strftime(d - 1, '%B %-d, %Y') FROM oc
  UNION ALL SELECT doc_id, 'due_date', CASE WHEN v < 2 THEN 1 ELSE v END, 1, {DS.format('d + 14')},
                   CASE v WHEN 2 THEN strftime(d + 14, '%B %-d, %Y') WHEN 3 THEN strftime(d + 14, '%Y-%m-%d') ELSE strftime(d + 14, '%b %-d, %Y') END FROM oc
  UNION ALL SELECT doc_id, 'total_amount_due', v + 1, 1, {MONEY_TXT.format('o_totalprice')}, NULL FROM oc WHERE v < 2
  UNION ALL SELECT doc_id, 'total_amount_due', 3, 1, {MONEY_TXT.format('o_totalprice + 100')}, NULL FROM oc
  UNION ALL SELECT doc_id, 'previous_balance', {RANK_12}, 1, {MONEY_TXT.format('c_acctbal')}, NULL FROM oc
  UNION ALL SELECT doc_id, 'payments_received', 1, 1, {MONEY_TXT.format('-(' + PAYMENT + ')')}, NULL FROM oc WHERE v % 2 = 1
  UNION ALL SELECT doc_id, 'current_charges', {RANK_12}, 2, {MONEY_TXT.format('o_totalprice')}, NULL FROM oc
  UNION ALL SELECT doc_id, 'raw_text_summary', 1, 1, {SUMMARY}, NULL FROM oc)
"""

SQL["label_candidates"] = _w(f""", {CANDIDATES.strip()}
SELECT doc_id, field, rank::BIGINT AS rank, page::BIGINT AS page, value FROM cand""")

SQL["normalize_dates"] = _w(f""", {CANDIDATES.strip()}
SELECT doc_id, field, raw, value FROM cand
WHERE field IN ('billing_date', 'billing_period_start_date', 'billing_period_end_date', 'due_date')""")

SQL["parse_money"] = _w(f""", {CANDIDATES.strip()}
SELECT doc_id, field, rank::BIGINT AS rank, CAST(value AS DOUBLE) AS amount FROM cand
WHERE field IN ('total_amount_due', 'previous_balance', 'payments_received', 'current_charges')""")

SQL["normalize_account"] = _w(f"""
SELECT doc_id, substr({ACCOUNT}, 1, 2) || ' ' || substr({ACCOUNT}, 3, 3) || ' ' || substr({ACCOUNT}, 6, 5) AS raw,
  {ACCOUNT} AS account
FROM oc""")

SQL["line_items"] = """
SELECT l_orderkey AS doc_id,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)::BIGINT AS item,
  'Part ' || CAST(l_partkey AS VARCHAR) || ' supplier ' || CAST(l_suppkey AS VARCHAR) AS description,
  l_extendedprice AS amount
FROM lineitem
"""

# Items of odd place, then a service charge, then the others.
SQL["wide_line_items"] = """
WITH li AS (
  SELECT l_orderkey AS doc_id, 'Part ' || CAST(l_partkey AS VARCHAR) || ' | supplier ' || CAST(l_suppkey AS VARCHAR) AS description,
    l_extendedprice AS amount, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n
  FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)),
every AS (
  SELECT doc_id, CASE n % 2 WHEN 1 THEN 0 ELSE 2 END AS part, n, description, amount FROM li
  UNION ALL SELECT o_orderkey, 1, 0, 'Monthly service charge', 5.84 FROM orders)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part, n)::BIGINT AS item, description, amount::DOUBLE AS amount FROM every
"""

HTML_ROWS = """
rows AS (
  SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n,
    'Part ' || CAST(l_partkey AS VARCHAR) AS part, CAST(l_suppkey AS VARCHAR) AS supplier, CAST(l_linenumber AS VARCHAR) AS line,
    CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS amount FROM lineitem)
"""
SQL["html_order_pages"] = _w(f""", {HTML_ROWS.strip()},
joined AS (
  SELECT l_orderkey, string_agg('|' || part || '|' || supplier || '\\|' || line || '|' || amount || '|' || chr(10), '' ORDER BY n) AS t
  FROM rows GROUP BY l_orderkey)
SELECT doc_id, '# Order #' || CAST(doc_id AS VARCHAR) || chr(10) || chr(10) || 'For [' || coalesce(c_name, '') || ' & Co](/customer/'
  || CAST(o_custkey AS VARCHAR) || '?x=1&y=2), café ½♥' || chr(10) || chr(10) || '- Date' || chr(10) || '  - ' || CAST(d AS VARCHAR) || chr(10)
  || '- Total' || chr(10) || '  1. ' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) || chr(10) || chr(10)
  || '|Part|Supplier\\|Line|Amount|' || chr(10) || '|---|---|---|' || chr(10) || coalesce(t, '') || chr(10)
  || '```' || chr(10) || 'ref  ' || CAST(doc_id AS VARCHAR) || chr(10) || chr(10) || chr(10) || '  <end>' || chr(10) || '```' AS markdown
FROM oc LEFT JOIN joined ON l_orderkey = doc_id""")

SQL["html_table_cells"] = _w(f""", {HTML_ROWS.strip()},
every AS (
  SELECT doc_id, 10 AS line, ['Part', 'Supplier|Line', 'Amount'] AS cells FROM o
  UNION ALL SELECT doc_id, 11 + n, [part, supplier || '|' || rows.line, amount] FROM o JOIN rows ON l_orderkey = doc_id)
SELECT doc_id, line::BIGINT AS line, i::BIGINT AS col, cells[i] AS cell FROM every, unnest([1, 2, 3]) AS u(i)""")

SQL["model_extract"] = _w(f"""
SELECT doc_id, attempt::BIGINT AS attempt, CASE WHEN n_items > 0 THEN {ACCOUNT} END AS account_number,
  CASE WHEN n_items > 0 THEN c_name END AS customer_name,
  CASE WHEN n_items > 0 THEN 0 ELSE 1 END::BIGINT AS has_error
FROM oc, unnest([1, 2, 3]) AS u(attempt) WHERE k <> 9 AND (attempt = 1 OR n_items = 0)""")

SQL["validate_response"] = _w(f"""
SELECT doc_id, CASE WHEN {FAILURE} THEN 0 ELSE 1 END::BIGINT AS valid,
  CASE k WHEN 3 THEN 'account_number: string_type' WHEN 4 THEN 'billing_date: date_from_datetime_parsing'
         WHEN 5 THEN 'line_items: list_type' WHEN 7 THEN 'json_invalid' END AS first_error,
  CASE WHEN {FAILURE} THEN 1 ELSE 0 END::BIGINT AS n_errors,
  CASE WHEN {FAILURE} OR k = 6 THEN NULL ELSE {ACCOUNT_OVR} END AS account_number,
  CASE WHEN {FAILURE} OR k = 6 THEN NULL ELSE {DS.format('d')} END AS billing_date,
  CASE WHEN {FAILURE} OR k = 6 THEN NULL ELSE {TOTAL_OVR} END AS total_amount_due,
  CASE WHEN {FAILURE} THEN NULL WHEN k IN (6, 8) THEN 0 ELSE n_items END::BIGINT AS n_items
FROM oc""")

SQL["first_valid_attempt"] = _w(f"""
SELECT doc_id, CASE WHEN k IN (3, 4) THEN 2 ELSE 1 END::BIGINT AS attempt
FROM o WHERE NOT ({FAILURE}) OR (k IN (3, 4) AND (doc_id // 10) % 2 = 0)""")

SQL["reconciled_bills"] = _w("""
, a AS (
  SELECT doc_id, v, CAST(o_totalprice AS DECIMAL(18,2)) AS c, CAST(o_custkey % 700 + 0.10 AS DECIMAL(18,2)) AS p1,
    CAST(o_custkey % 700 + 33.43 AS DECIMAL(18,2)) AS p2, CAST(o_custkey % 500 + 0.25 AS DECIMAL(18,2)) AS y FROM o),
t AS (SELECT *, CASE v WHEN 0 THEN p1 - y + c WHEN 2 THEN p2 - y + c WHEN 3 THEN c ELSE p1 - y + c + 5000000.01 END AS good FROM a)
SELECT doc_id, CAST(CASE WHEN v = 1 THEN good + 1000000.07 ELSE good END AS DOUBLE) AS total_amount_due,
  CAST(CASE v WHEN 2 THEN p2 WHEN 3 THEN NULL ELSE p1 END AS DOUBLE) AS previous_balance,
  CAST(CASE WHEN v <> 3 THEN y END AS DOUBLE) AS payments_received, CAST(c AS DOUBLE) AS current_charges,
  CASE WHEN v = 1 THEN 0 ELSE 1 END::BIGINT AS balanced FROM t""")

SQL["validate_invoice"] = _w("""
SELECT doc_id, CASE WHEN doc_id % 4 IN (2, 3) THEN 0 ELSE 1 END::BIGINT AS valid,
  CASE doc_id % 4 WHEN 2 THEN 'total_amount: float_parsing' WHEN 3 THEN 'invoice_number: string_type' END
    AS first_error,
  CASE WHEN doc_id % 4 IN (2, 3) THEN NULL ELSE 'INV-' || CAST(doc_id AS VARCHAR) END AS invoice_number,
  CASE WHEN doc_id % 4 IN (2, 3) THEN NULL ELSE strftime(d, '%Y-%m-%d') END AS invoice_date,
  CASE WHEN doc_id % 4 IN (2, 3) THEN NULL ELSE o_totalprice END AS total_amount
FROM oc""")

STATUS = f"""
SELECT doc_id, CASE WHEN k = 9 THEN 'FAILED' ELSE 'COMPLETED' END AS status,
  CASE WHEN k = 9 THEN NULL WHEN {FAILURE} THEN 'LLM_FAILURE' ELSE 'LLM_SUCCESS' END AS route,
  CASE WHEN k = 9 THEN {lit(MSG_NO_CONTENT)} END AS reason
FROM o"""
SQL["document_status"] = _w(STATUS)
SQL["stream_ingest"] = _w(STATUS)

READ = "k <> 9 AND n_items > 0"
SQL["stream_extract"] = _w(f"""
SELECT doc_id, CASE WHEN k = 9 THEN 'FAILED' ELSE 'COMPLETED' END AS status,
  CASE WHEN k = 9 THEN NULL WHEN {READ} THEN 'LLM_SUCCESS' ELSE 'LLM_FAILURE' END AS route,
  CASE WHEN k = 9 THEN 'unrouted' WHEN {READ} THEN 'success' ELSE 'failure' END AS branch,
  CASE WHEN {READ} THEN {ACCOUNT} END AS account_number,
  CASE WHEN k = 9 THEN 0 WHEN {READ} THEN 1 ELSE 3 END::BIGINT AS n_answers
FROM oc""")

SQL["stream_extract_rules"] = _w(f"""
SELECT doc_id, CASE WHEN k = 9 THEN 'FAILED' ELSE 'COMPLETED' END AS status,
  CASE WHEN k <> 9 THEN 'LLM_SUCCESS' END AS route, CASE WHEN k <> 9 THEN {ACCOUNT} END AS account_number,
  CASE WHEN k <> 9 THEN {TOTAL_READ} END AS total_amount_due, CASE WHEN k <> 9 THEN {DS.format('d + 14')} END AS due_date
FROM oc""")

SQL["model_deadline"] = _w(f"""
SELECT doc_id, CASE WHEN k = 9 THEN 'FAILED' ELSE 'COMPLETED' END AS status,
  CASE WHEN k = 9 THEN NULL WHEN {READ} AND doc_id % 1009 <> 0 THEN 'LLM_SUCCESS' ELSE 'LLM_FAILURE' END AS route,
  CASE WHEN k <> 9 AND doc_id % 1009 = 0 THEN 1 ELSE 0 END::BIGINT AS timed_out,
  CASE WHEN k <> 9 AND (n_items = 0 OR doc_id % 1009 = 0) THEN 1 ELSE 0 END::BIGINT AS has_error
FROM oc""")

SQL["stream_reviews"] = _w(f"""
SELECT doc_id, CASE WHEN r = 0 THEN 'waiting' ELSE 'corrected' END AS state, CASE WHEN r = 3 THEN 1 ELSE 0 END::BIGINT AS empty
FROM o WHERE {FAILURE}
UNION ALL SELECT doc_id, 'repeated', 1::BIGINT FROM o WHERE {FAILURE} AND r <> 0 AND doc_id % 5 = 0""")

SQL["stream_pending"] = _w(f"""
SELECT doc_id, 'waiting' AS state FROM o WHERE {FAILURE} AND r = 0""")

SQL["first_corrections"] = _w(f"""
SELECT doc_id, CASE WHEN r = 3 THEN 1 ELSE 0 END::BIGINT AS correction_missing, CASE WHEN r IN (1, 3) THEN 1 ELSE 0 END::BIGINT AS valid,
  CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 1 END::BIGINT AS n_corrections
FROM o WHERE {FAILURE} AND r <> 0""")

SQL["route_decision"] = _w(f"""
SELECT doc_id, CASE WHEN k = 9 THEN 'unrouted' WHEN {FAILURE} THEN 'failure' ELSE 'success' END AS branch
FROM o""")

SQL["validate_direct"] = _w(f"""
SELECT doc_id, CASE WHEN {DIRECT_REFUSED} THEN 'FAILED' ELSE 'COMPLETED' END AS store_status,
  CASE WHEN {DIRECT_REFUSED} THEN {lit(MSG_INSERT_FAILED)} END AS store_reason
FROM o WHERE {SUCCESS}""")

CORRECTED_REASON = f"""CASE WHEN r = 3 THEN {lit(MSG_CORRECTION_MISSING)}
    WHEN r = 2 THEN {lit(RECORD_INVALID)}
    WHEN {CORRECTED_REFUSED} THEN {lit(MSG_CORRECTION_INSERT_FAILED)} END"""
SQL["validate_corrected"] = _w(f"""
SELECT doc_id, CASE WHEN ({CORRECTED_REASON}) IS NULL THEN 'COMPLETED' ELSE 'FAILED' END AS store_status,
  {CORRECTED_REASON} AS store_reason
FROM o WHERE {FAILURE} AND r <> 0""")

SQL["validate_direct_json"] = _w(f"""
SELECT doc_id, CASE WHEN reason IS NULL THEN 'COMPLETED' ELSE 'FAILED' END AS store_status, reason AS store_reason
FROM (SELECT doc_id, CASE
    WHEN k IN (7, 9) THEN {lit(MSG_NO_PAYLOAD)}
    WHEN k = 6 THEN {lit(MSG_NO_RECORD)}
    WHEN k = 3 THEN {lit(MSG_RECORD_INVALID + '1 validation error: account_number: string_type')}
    WHEN k = 4 THEN {lit(MSG_RECORD_INVALID + '1 validation error: billing_date: date_from_datetime_parsing')}
    WHEN k = 5 THEN {lit(MSG_RECORD_INVALID + '1 validation error: line_items: list_type')}
    WHEN k = 8 THEN {lit(MSG_NO_TEXT_OR_TYPE)}
    WHEN doc_id % 97 = 0 OR doc_id % 103 = 0 THEN {lit(MSG_INSERT_FAILED)} END AS reason FROM o)""")

SQL["capture_errors"] = _w(f"""
SELECT doc_id, CASE WHEN k = 9 OR doc_id % 13 = 0 THEN 'FAILED' ELSE 'COMPLETED' END AS status,
  CASE WHEN k = 9 THEN NULL WHEN doc_id % 13 = 0 THEN 'PIPELINE_ERROR' WHEN n_items = 0 THEN 'LLM_FAILURE'
       ELSE 'LLM_SUCCESS' END AS route,
  CASE WHEN k = 9 THEN {lit(MSG_NO_CONTENT)}
       WHEN doc_id % 13 = 0 THEN 'Critical error: OSError: document store unavailable' END AS reason
FROM oc""")

SQL["task_log"] = _w(f""", {STORED.strip()},
ids AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS id FROM stored)
SELECT doc_id, 'process_document' AS task, 1::BIGINT AS seq,
  CASE WHEN k = 9 THEN 'skipped ' || {PATH} || ': it holds no text'
       WHEN {FAILURE} THEN 'no record read from ' || {PATH} || ', a reviewer is asked'
       ELSE 'record read from ' || {PATH} END AS entry
FROM o
UNION ALL
SELECT doc_id, 'store_document_data', 1::BIGINT,
  CASE WHEN {DIRECT_REFUSED} THEN 'extracted record refused by the table'
       ELSE 'extracted record is row ' || CAST(ids.id AS VARCHAR) END
FROM o LEFT JOIN ids USING (doc_id) WHERE {SUCCESS}
UNION ALL
SELECT doc_id, 'process_human_corrected_data', 1::BIGINT,
  CASE WHEN r = 3 THEN {lit(MSG_CORRECTION_MISSING)} WHEN r = 2 THEN {lit(RECORD_INVALID)}
       WHEN {CORRECTED_REFUSED} THEN 'reviewed record refused by the table'
       ELSE 'reviewed record is row ' || CAST(ids.id AS VARCHAR) END
FROM o LEFT JOIN ids USING (doc_id) WHERE {FAILURE} AND r <> 0""")

SQL["apply_corrections"] = _w(f"""
SELECT doc_id, CASE WHEN r = 3 THEN 1 ELSE 0 END::BIGINT AS correction_missing,
  CASE WHEN r IN (1, 3) THEN 1 ELSE 0 END::BIGINT AS valid, {TYPE_OVR} AS document_type_hint,
  CASE WHEN r = 1 THEN {ACCOUNT_OVR} END AS account_number
FROM o WHERE {FAILURE} AND r <> 0""")
SQL["stream_corrections"] = SQL["apply_corrections"]

SQL["pending_reviews"] = _w(f"""
SELECT doc_id, {PATH} AS original_document_path FROM o WHERE {FAILURE} AND r = 0""")

SQL["enforce_store_constraints"] = _w(f"""
SELECT doc_id, 'direct' AS branch,
  CASE WHEN k <> 6 AND doc_id % 97 = 0 THEN 'numeric field overflow: total_amount_due'
       WHEN k <> 6 AND doc_id % 103 = 0 THEN 'value too long for account_number (255)'
       WHEN doc_id % 101 = 0 THEN 'value too long for document_type (100)' END AS store_error
FROM o WHERE {SUCCESS}
UNION ALL
SELECT doc_id, 'corrected',
  CASE WHEN r = 1 AND doc_id % 97 = 0 THEN 'numeric field overflow: total_amount_due'
       WHEN r = 1 AND doc_id % 103 = 0 THEN 'value too long for account_number (255)'
       WHEN doc_id % 101 = 0 THEN 'value too long for document_type (100)' END
FROM o WHERE {FAILURE} AND r <> 0""")

SQL["encode_line_items"] = _w(f""",
items AS (
  SELECT l_orderkey,
    to_json(list({{'description': 'Part ' || CAST(l_partkey AS VARCHAR) || ' supplier ' || CAST(l_suppkey AS VARCHAR),
                   'amount': l_extendedprice}} ORDER BY l_linenumber, l_partkey, l_suppkey))::VARCHAR AS js
  FROM lineitem GROUP BY l_orderkey)
SELECT doc_id, CASE WHEN {SUCCESS} THEN 'direct' ELSE 'corrected' END AS branch,
  CASE WHEN k IN (6, 8) OR n_items = 0 THEN 1 ELSE 0 END::BIGINT AS is_null,
  CASE WHEN k IN (6, 8) THEN NULL ELSE js END AS line_items,
  CASE WHEN k IN (6, 8) THEN 0.0 ELSE CAST(items_sum AS DOUBLE) END AS items_sum
FROM oc LEFT JOIN items ON l_orderkey = doc_id
WHERE ({SUCCESS} AND NOT {DIRECT_REFUSED}) OR ({FAILURE} AND r = 1 AND NOT {CORRECTED_REFUSED})""")

SQL["workflow_output"] = _w(f"""
SELECT doc_id,
  CASE WHEN k = 9 THEN NULL WHEN {FAILURE} THEN 'LLM_FAILURE' ELSE 'LLM_SUCCESS' END
    AS final_status_doc_processing,
  CASE WHEN {SUCCESS} THEN CASE WHEN {DIRECT_REFUSED} THEN 'FAILED' ELSE 'COMPLETED' END END AS direct_status,
  CASE WHEN {SUCCESS} AND NOT {DIRECT_REFUSED} THEN 1 ELSE 0 END::BIGINT AS direct_stored,
  CASE WHEN {FAILURE} AND r <> 0 THEN CASE WHEN r = 1 AND NOT {CORRECTED_REFUSED} THEN 'COMPLETED'
       ELSE 'FAILED' END END AS corrected_status,
  CASE WHEN {FAILURE} AND r = 1 AND NOT {CORRECTED_REFUSED} THEN 'PROCESSED_AND_STORED' END
    AS status_human_review
FROM o""")

SQL["registered_stage"] = _w(f"""
SELECT doc_id, {PATH} AS document_path, {ACCOUNT} AS account_number, {TOTAL_READ} AS total_amount_due,
  {DS.format('d + 14')} AS due_date
FROM oc""")
