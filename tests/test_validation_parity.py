"""The native validator against a pydantic model of the tests' own: errors and values."""

import datetime as dt
import json
import math

import pytest

from stmtflow.operators.responses import validate_response

pydantic = pytest.importorskip("pydantic")

DATES = ["2018-02-21", "2018-02-21T00:00:00+00:00", "2018-02-21T00:00:00-05:00", "2018-02-21t00:00:00z", "2018-02-21_00:00:00",
         "2018-02-21 00:00", "2018-02-21T00:00:00,0", "2018-02-21T00:00:00.000000", "2018-02-21T00:00Z", "2018-02-21T00:00:00+0000",
         "2018-02-21T00:00:00+00", "2018-02-21T00:00:00 Z", "2018-02-21T00:00:00+24:00", "2018-02-21T00:00:00+23:59",
         "2018-02-21T24:00:00", "2018-02-21T00:00:60", "2018-02-21T00:60", "1519171200.0", "1519171200.5", "+1519171200", "-86400",
         " 1519171200", "1519171200 ", "0000-01-01", "0001-01-01", "9999-12-31", "1e9", "1519171200.", "1_519171200", "0", "00",
         "-0", "1519171200000", "20000000000", "19999958400", "2018-02-21 ", " 2018-02-21", "2018-02-21T", "20180221",
         "2018/02/21", "2018-02-21T00:00:00−05:00", "2018-02-21T10:00:00-05:00", "2018-02-30", "2018-02-30T00:00:00",
         "2018-02-21T00:00:00.", "2018-02-21T0:00:00", "86400.0", "253402300800", "-62135596800", ".0", "99999999999999999999",
         "inf", "nan", "+", "", "March 7, 2018", 1519171200, 1519171200.5, 20000000001, -86400, 0, 0.5, 253402300800,
         1519171200000, 1728000000000.0, True, False, [], {}, None, "２018-02-21"]
FLOATS = ["1.5_0", "1_000.5_5", "1e5_0", "_1", "1_", "1__0", "1_.5", "1._5", "-_1", "1e_5", "+1.5", "1.", ".", ".5", "-.5e-3",
          " 1.5", "\xa01.5\xa0", "\x1c1.5", "1.5 ", "1 5", "inf", "-Infinity", "+nan", "infinit", "0x10", "1d", "1f",
          "٣", "- 1", "1,5", "1e", "e5", "_", "​1", "\x851", "", "$1", 5, -2.25, True, False, None, [1], {}, "12.5"]
TEXTS = ['{"account_number":"x"}}', '{"account_number":"x"} {"b":2}', '{"account_number":"x"},{"b":2}', '{"account_number":"x"}],[{"b":2}',
         '{"account_number":"x"} x', ' {"account_number":"x"} \n', '[]', '""', 'null', '', ' ', '{', '{}', '{"account_number":1}',
         '{"account_number":true}', '{"account_number":["a"]}', '{"line_items":"x"}', '{"line_items":[{"description":5}]}',
         # Repeated keys and bare numbers that are none; and what must not pass with them.
         '{"account_number":"a","account_number":"b"}', '{"account_number":1,"account_number":"b"}', '{"account_number":"b","account_number":1}',
         '{"total_amount_due":NaN}', '{"total_amount_due":Infinity}', '{"total_amount_due":-Infinity}', '{"account_number":NaN}', '{"zzz":NaN,"account_number":"x"}',
         ' {"zzz":1,"zzz":2} ', '{"line_items":[{"amount":NaN},{"amount":Infinity}]}', '{"line_items":NaN}', '{"line_items":[],"line_items":[{"amount":1}]}',
         '{"account_number":"a","account_number":"b"} x', '{"account_number":"a","account_number":"b"},{"zzz":1}', '{"account_number":NaN',
         '{"account_number":"a","account_number":"b"', "{'account_number':'x'}", '{"account_number":NaN}}', '{account_number:"x"}', '{"total_amount_due":NaN},1',
         '{"total_amount_due":01}', '{"zzz":NaN}, {}]', '{"zzz":NaN}}, {"a":1}]', '{"zzz":NaN}, "mark":1', '{"account_number":"NaN, \\" NaN","account_number":"c","total_amount_due":NaN}',
         '{"line_items":[{"amount":"1_0"},{"description":"d"}]}', '{"zzz":1}', '1', '{"account_number":"\\u00e9\\n"}']


@pytest.fixture(scope="module")
def both(spark):
    class Item(pydantic.BaseModel):
        description: str | None = None
        amount: float | None = None

    class Bill(pydantic.BaseModel):
        account_number: str | None = None
        billing_date: dt.date | None = None
        total_amount_due: float | None = None
        line_items: list[Item] | None = None

    texts = ([json.dumps({"billing_date": d}) for d in DATES] + [json.dumps({"total_amount_due": f}) for f in FLOATS] + TEXTS)
    rows = {r.i: r for r in validate_response(spark.createDataFrame(list(enumerate(texts)), "i int, response string")).collect()}
    out = []
    for i, text in enumerate(texts):
        try:
            want, codes = Bill.model_validate_json(text), []
        except pydantic.ValidationError as e:
            want, codes = None, [x["type"] for x in e.errors()]
        out.append((text, want, codes, rows[i]))
    return out


def test_errors_and_values_agree(both):
    assert len(both) > 100
    different = []
    for text, want, codes, row in both:
        got = [e.rsplit(": ", 1)[-1] for e in row.errors]
        if got != codes:
            different.append((text, codes, got))
        elif want is not None:
            a, b = want.total_amount_due, row.record.total_amount_due
            same = a == b or a is not None and b is not None and math.isnan(a) and math.isnan(b)
            items = None if want.line_items is None else [(x.description, x.amount) for x in want.line_items]
            rows = None if row.record.line_items is None else [tuple(x) for x in row.record.line_items]
            if not same or want.billing_date != row.record.billing_date or want.account_number != row.record.account_number or repr(items) != repr(rows):
                different.append((text, want, row.record))
    assert not different, "\n".join(map(str, different))


def test_long_numbers_do_not_overflow_the_stack(spark):
    texts = ['{"total_amount_due": "' + "1_" * 50_000 + '1"}', '{"total_amount_due": "' + "1" * 300 + '"}',
             '{"billing_date": "' + "1" * 100_000 + '"}']
    rows = validate_response(spark.createDataFrame(list(enumerate(texts)), "i int, response string")).orderBy("i").collect()
    assert [list(r.errors) for r in rows] == [[], [], ["billing_date: date_from_datetime_parsing"]]
