import datetime as dt
import json

import pytest

from stmtflow.operators import extract as ex

# A water bill of our own: every field, two totals, two date styles, a credit, a subtotal row, a second charges section.
BILL = """# Harbour Water Board

Summary: quarterly water and sewer charges

Bill date:
Billing date: Sept. 3, 2021

For the billing period June 1, 2021 to August 31, 2021

# Service address

14 Quay Road, Unit 2

Mailing address: PO Box 77, Northport

# Total amount due

$301.10

|Previous balance|$120.40|
|---|---|
|Payment received July 15 - thanks|-$120.40|

# Total amount due by Sep 24, 2021

$180.70
---
# R. Okafor

Account no.: 55 20 31 884

# Current charges

|Water use, 41 units|$102.50|
|---|---|
|Sewer|$88.20|
|Leak credit|-$10.00|
|Total current charges|$180.70|
---
# Past charges

|Water use, 39 units|$97.50|
|---|---|
"""


@pytest.fixture(scope="module")
def bill(spark):
    return spark.createDataFrame([(1, BILL)], "doc_id long, text string")


def test_golden_record(bill):
    r = ex.extract_bills(bill).first()
    assert (r.account_number, r.customer_name) == ("552031884", "R. Okafor")
    assert (r.service_address, r.billing_address) == ("14 Quay Road, Unit 2", "PO Box 77, Northport")
    assert r.billing_date == dt.date(2021, 9, 3)  # the empty label above does not hide it
    assert (r.billing_period_start_date, r.billing_period_end_date) == (dt.date(2021, 6, 1), dt.date(2021, 8, 31))
    assert r.due_date == dt.date(2021, 9, 24)
    assert r.total_amount_due == 180.70  # the dated total outranks the bare heading (301.10)
    assert (r.previous_balance, r.payments_received, r.current_charges) == (120.40, 120.40, 180.70)
    assert [(i.description, i.amount) for i in r.line_items] == [
        ("Water use, 41 units", 102.50), ("Sewer", 88.20), ("Leak credit", -10.00)]
    assert round(sum(i.amount for i in r.line_items), 2) == r.current_charges
    assert round(r.previous_balance - r.payments_received + r.current_charges, 2) == r.total_amount_due
    assert r.raw_text_summary == "quarterly water and sewer charges"


def test_label_candidates_are_all_matches(spark, bill):
    c = {(x.field, x.rank, x.page, x.nth, x.value) for x in ex.label_candidates(bill).collect()}
    assert ("total_amount_due", 2, 1, 1, "$180.70") in c and ("total_amount_due", 3, 1, 1, "$301.10") in c
    names = sorted((x[2], x[4]) for x in c if x[0] == "customer_name")
    assert names == [(2, "R. Okafor"), (3, "Past charges")]
    text = "Bill date: May 1, 2020\nBill date: May 2, 2020\n---\nBill date: May 3, 2020\n"
    two = ex.label_candidates(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert sorted((x.page, x.nth, x.value) for x in two) == [(1, 1, "May 1, 2020"), (1, 2, "May 2, 2020"), (2, 1, "May 3, 2020")]


def test_unreadable_matches_do_not_win(spark):
    text = ("Total amount due by Foo. 77, 2018\nDue date: March 7, 2018\n|Total amount due|$1,2,3.00|\n|Total amount due|$7.00|\n"
            "---   \t            \n# NAME BELOW A LONG BREAK\n")
    r = ex.extract_bills(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.due_date == dt.date(2018, 3, 7) and r.total_amount_due == 7.0 and r.customer_name == "NAME BELOW A LONG BREAK"


def test_blank_runs_do_not_overflow_the_stack(spark):
    texts = [f"# {label}" + " \n" * 100_000 + value for label, value in (
        ("Total amount due", "$5.00"), ("Account number", "12 34"), ("Please pay by", "March 7, 2018"), ("Service address", "1 X Rd"))]
    rows = ex.extract_bills(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert (rows[0].total_amount_due, rows[1].account_number, rows[2].due_date, rows[3].service_address) == (
        5.0, "1234", dt.date(2018, 3, 7), "1 X Rd")


def test_missing_fields_are_null(spark):
    df = spark.createDataFrame([(1, "nothing to see"), (2, "")], "doc_id long, text string")
    for r in ex.extract_bills(df).collect():
        assert all(v is None for k, v in r.asDict().items() if k != "doc_id")


def test_line_items_flat(bill):
    items = ex.line_items(bill).orderBy("item").collect()
    assert [i.item for i in items] == [1, 2, 3] and items[1].description == "Sewer"


def test_every_field_has_a_value_somewhere(spark, sf_small):
    from stmtflow.plans import fixtures as fx
    from stmtflow.schemas import BILL_RECORD
    from pyspark.sql import functions as F

    records = ex.extract_bills(fx.statements(spark, sf_small))
    counts = records.agg(*[F.count(n).alias(n) for n in BILL_RECORD.names]).first().asDict()
    assert len(counts) == 14 and all(counts.values())


def test_extract_files_to_json(spark, tmp_path):
    from stmtflow.plans.pipeline import extract_files

    (tmp_path / "bill.md").write_text(BILL, encoding="utf-8")
    (tmp_path / "empty.md").write_text("", encoding="utf-8")
    (tmp_path / "bytes.md").write_bytes(b"Due date: 2020-01-02\n\xff\xfe")
    out = {r.document_path.rsplit("/", 1)[-1]: json.loads(r.json) for r in extract_files(spark, str(tmp_path)).collect()}
    assert out["bill.md"]["due_date"] == "2021-09-24" and len(out["bill.md"]["line_items"]) == 3
    assert set(out["empty.md"].values()) == {None}  # an empty file is a document without content
    assert out["bytes.md"]["due_date"] == "2020-01-02"


def _balanced(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = ex.extract_bills(df, reconcile=True).first()
    plain = ex.extract_bills(df).first()
    return (r.total_amount_due, r.previous_balance, r.payments_received, r.current_charges, r.balanced), plain


def test_amounts_are_chosen_together(spark):
    text = ("# Total amount due\n\n$80.00\n\n|Balance from last bill|$50.00|\n|---|---|\n|Payment received A|-$50.00|\n|Payment received B|-$20.00|\n"
            "|Total amount due by Mar 1, 2020|$999.00|\n---\n# N\n\n# Charges\n\n|Total charges|$50.00|\n|Total current charges|$30.00|\n")
    got, plain = _balanced(spark, text)
    # Both 50 - 20 + 50 = 80 and, with places further back, nothing else.
    assert got == (80.0, 50.0, 20.0, 50.0, True)
    assert (plain.total_amount_due, plain.payments_received) == (999.0, 50.0)


def test_without_a_balance_ranks_decide(spark, bill):
    for text in (BILL.replace("$120.40|\n|---", "$1.00|\n|---"), "no amounts here", "# Total amount due\n\n$5.00\n"):
        got, plain = _balanced(spark, text)
        assert got == (plain.total_amount_due, plain.previous_balance, plain.payments_received, plain.current_charges, False)
    got, plain = _balanced(spark, BILL)
    assert got == (180.70, 120.40, 120.40, 180.70, True)


def test_many_candidates(spark):
    rows = "".join(f"|Payment received {i}|-${i}.01|\n" for i in range(200)) + "".join(f"|Total amount due|${i + 300}.00|\n" for i in range(200))
    text = f"|Previous balance|$150.01|\n{rows}|Total charges|$400.00|\n"
    got, _ = _balanced(spark, text)
    assert got[4] and abs(got[0] - (150.01 - got[2] + 400.0)) < 1e-9


WIDE = """# Delivery charges

|Description|Qty|Rate|Amount|
|---|---|---|---|
|Power \\| peak|3|$1.00|$3.00|
|Power \\\\ night|3|$1.00|n/a|
|Subtotal| | |$3.00|

# Supply charges

|Usage|Temperature|
|---|---|
|9|8|

|Cost of gas supplied:|9.409 therms x $0.339037|$3.19|
|---|---|---|
|Base fee|$5.84| |
|Total supply charges| |$9.03|

# Other charges

|$1.50|Late fee|2 days|
|Total charges| |$13.53|

# More charges

|Not|$7.00|
"""


def test_line_items_by_column_roles(spark):
    df = spark.createDataFrame([(1, WIDE), (2, WIDE.replace("Total charges", "Sum of charges"))], "doc_id long, text string")
    got = [(r.doc_id, r.description, r.amount) for r in ex.line_items(df).orderBy("doc_id", "item").collect()]
    first = [("Power | peak", 3.0), ("Cost of gas supplied:", 3.19), ("Base fee", 5.84), ("Late fee", 1.5)]
    assert [x[1:] for x in got if x[0] == 1] == first
    assert [x[1:] for x in got if x[0] == 2] == [*first, ("Sum of charges", 13.53), ("Not", 7.0)]  # no section states the total
