"""A sample of registered queries against their DuckDB oracles at sf0.001 (the full
set runs with tools/check_oracle.py)."""

import duckdb
import pytest

import __spark_entry__ as entry
from stmtflow.plans.catalog import QUERIES
from stmtflow.plans.oracle import SQL
from tools.check_oracle import TABLES, compare

SAMPLE = ["extract_bills", "line_items", "label_candidates", "validate_response", "first_valid_attempt",
          "assemble_parts", "html_to_markdown", "store_all", "workflow_output", "append_bills",
          "heading_sections", "scan_workitems", "wide_line_items", "reconciled_bills", "html_table_cells"]


@pytest.fixture(scope="module")
def con(sf_small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(SQL) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, sf_small, con, name):
    ok, msg, _ = compare(spark, sf_small, name, entry.queries()[name], entry.oracle_sql()[name], con)
    assert ok, msg


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "account_number" in df.columns
