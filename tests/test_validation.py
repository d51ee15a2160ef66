import datetime as dt

import pytest

from stmtflow.operators.responses import first_valid_attempt, validate_invoice, validate_response

CASES = [
    ('{}', []),
    ('{"account_number": 123}', ["account_number: string_type"]),
    ('{"account_number": "A1", "extra": 1}', []),
    ('{"account_number": null}', []),
    ('{"billing_date": "2018-02-21"}', []),
    ('{"billing_date": "2018-2-3"}', ["billing_date: date_from_datetime_parsing"]),
    ('{"billing_date": "March 7, 2018"}', ["billing_date: date_from_datetime_parsing"]),
    ('{"billing_date": "2018-02-30"}', ["billing_date: date_from_datetime_parsing"]),
    ('{"billing_date": ""}', ["billing_date: date_from_datetime_parsing"]),
    ('{"billing_date": "2018-02-21T00:00:00"}', []),
    ('{"billing_date": "2018-02-21T10:00:00"}', ["billing_date: date_from_datetime_inexact"]),
    ('{"billing_date": 1519171200}', []),
    ('{"billing_date": "1519171200"}', []),
    ('{"billing_date": 1519171200000}', []),
    ('{"billing_date": 1519171201}', ["billing_date: date_from_datetime_inexact"]),
    ('{"billing_date": true}', ["billing_date: date_type"]),
    ('{"total_amount_due": "12.5"}', []),
    ('{"total_amount_due": " 12.5 "}', []),
    ('{"total_amount_due": "1e3"}', []),
    ('{"total_amount_due": "1_0"}', []),
    ('{"total_amount_due": true}', []),
    ('{"total_amount_due": "$12.5"}', ["total_amount_due: float_parsing"]),
    ('{"total_amount_due": "1,234.5"}', ["total_amount_due: float_parsing"]),
    ('{"total_amount_due": ""}', ["total_amount_due: float_parsing"]),
    ('{"total_amount_due": [1]}', ["total_amount_due: float_type"]),
    ('{"line_items": []}', []),
    ('{"line_items": null}', []),
    ('{"line_items": [{}]}', []),
    ('{"line_items": {}}', ["line_items: list_type"]),
    ('{"line_items": [null]}', ["line_items: model_type"]),
    ('{"line_items": [1]}', ["line_items: model_type"]),
    ('{"line_items": [{"amount": "x"}]}', ["line_items: amount: float_parsing"]),
    ('[1]', ["model_type"]),
    ('"text"', ["model_type"]),
    ('{"a": 1} trailing', ["json_invalid"]),
    ('{"account_number": "1"', ["json_invalid"]),
    (None, ["json_invalid"]),
]


@pytest.fixture(scope="module")
def validated(spark):
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(CASES)], "doc_id long, response string")
    return {r.doc_id: r for r in validate_response(df).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_error_codes(validated, i):
    text, expected = CASES[i]
    r = validated[i]
    assert list(r.errors) == expected, text
    assert (r.record is not None) == (not expected)


def test_converted_values(spark):
    df = spark.createDataFrame([(1, '{"total_amount_due": "1_0", "billing_date": 1519171200, '
                                   '"line_items": [{"description": "x", "amount": true}], "zzz": 5}')],
                               "doc_id long, response string")
    rec = validate_response(df).first().record
    assert rec.total_amount_due == 10.0 and rec.billing_date == dt.date(2018, 2, 21)
    assert rec.line_items[0].amount == 1.0 and rec.account_number is None


def test_empty_record_is_valid(spark):
    df = spark.createDataFrame([(1, "{}")], "doc_id long, response string")
    rec = validate_response(df).first().record
    assert rec is not None and all(v is None for v in rec.asDict().values())


def test_invoice_schema(spark):
    df = spark.createDataFrame([(1, '{"invoice_number": "I-1", "invoice_date": "2020-01-02", "total_amount": 3}'),
                                (2, '{"invoice_number": 5}')], "doc_id long, response string")
    out = {r.doc_id: r for r in validate_invoice(df).collect()}
    assert out[1].record.invoice_date == dt.date(2020, 1, 2) and out[1].record.total_amount == 3.0
    assert list(out[2].errors) == ["invoice_number: string_type"]


def test_first_valid_attempt(spark):
    df = spark.createDataFrame(
        [(1, 1, '{"account_number": 1}'), (1, 2, '{"account_number": "B"}'), (1, 3, '{"account_number": "C"}'),
         (2, 1, '{"account_number": "A"}'), (2, 2, '{"account_number": "Z"}'),
         (3, 1, 'bad'), (3, 2, 'bad'), (3, 3, '{"account_number": "late"}')],
        "doc_id long, attempt int, response string")
    v = validate_response(df)
    best = {r.doc_id: (r.attempt, r.record.account_number) for r in first_valid_attempt(v, max_attempts=2).collect()}
    assert best == {1: (2, "B"), 2: (1, "A")}  # doc 3's only valid attempt is beyond the limit
    best3 = {r.doc_id: r.attempt for r in first_valid_attempt(v, max_attempts=3).collect()}
    assert best3[3] == 3


def test_model_extract_retries_only_on_failure(spark, tmp_path):
    import os

    from stmtflow.operators.responses import model_extract

    def maker(folder):
        def make():
            def fn(text):
                if text == "boom":
                    raise ValueError("down")
                first = not os.path.exists(f"{folder}/{text}")
                open(f"{folder}/{text}", "w").close()
                if first and text == "flaky":
                    return "not json"
                if first and text == "typed":
                    return '{"account_number": 5}'
                return '{"account_number": "%s"}' % text

            return fn

        return make

    docs = spark.createDataFrame([(1, "ok"), (2, "flaky"), (3, "boom"), (4, "  "), (5, "typed")], "doc_id long, text string")
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    make = maker(str(tmp_path / "a"))
    rows = model_extract(docs, make, attempts=3).collect()
    per_doc = {}
    for r in rows:
        per_doc.setdefault(r.doc_id, []).append(r)
    assert len(per_doc[1]) == 1 and len(per_doc[2]) == 2 and len(per_doc[3]) == 3
    assert 4 not in per_doc  # blank documents never reach the extractor
    assert len(per_doc[5]) == 2  # JSON of the wrong types is asked for again
    assert per_doc[3][0].error == "ValueError: down"
    named = docs.selectExpr("concat('d', doc_id) AS name", "text")  # keys of any type
    answers = model_extract(named, maker(str(tmp_path / "b")), id_col="name", attempts=3)
    best = first_valid_attempt(validate_response(answers)).collect()
    assert {(r.doc_id, r.attempt) for r in best} == {("d1", 1), ("d2", 2), ("d5", 2)}


def test_attempts_past_the_limit_are_not_validated(spark):
    from stmtflow.operators.responses import first_valid_response

    df = spark.createDataFrame([(1, 1, "bad"), (1, 2, '{}')], "doc_id long, attempt int, response string")
    plan = first_valid_response(df, max_attempts=1)._jdf.queryExecution().optimizedPlan().toString()
    import re

    assert re.search(r"attempt#\d+ <= 1", plan[plan.index("CollectMetrics"):])  # the limit lies below the validation
    assert first_valid_response(df, max_attempts=1).count() == 0 and first_valid_response(df, max_attempts=2).count() == 1


def test_each_variant_value_is_converted_once(spark):
    import re

    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        df = spark.createDataFrame([(1, "{}")], "doc_id long, response string").filter("doc_id > 0")
        plan = validate_response(df)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert len(re.findall(r"variant_get\(_x_due_date#\d+", plan)) == 1


def test_lists_of_fitting_types(spark):
    """A list whose type alone shows that it fits gives what its elements give one by one; nulls among them are found."""
    cases = {'[{"description":"a\\n\\"b","amount":1.25},{"amount":2},{}]': [('a\n"b', 1.25), (None, 2.0), (None, None)],
             '[]': [], '[{"description":null,"amount":1e3}]': [(None, 1000.0)], '[{"amount":1,"zzz":[2]}]': [(None, 1.0)],
             '[{"amount":"2"},{"amount":true}]': [(None, 2.0), (None, 1.0)]}
    bad = {'[null]': "line_items: model_type", '[{"amount":1},null]': "line_items: model_type", '[[]]': "line_items: model_type",
           '[{"amount":1},{"amount":"x"}]': "line_items: amount: float_parsing", '[{"description":1}]': "line_items: description: string_type"}
    texts = [*cases, *bad]
    rows = validate_response(spark.createDataFrame([(i, f'{{"line_items":{t}}}') for i, t in enumerate(texts)], "doc_id long, response string"))
    got = {texts[r.doc_id]: r for r in rows.collect()}
    for text, items in cases.items():
        assert got[text].errors == [] and [tuple(x) for x in got[text].record.line_items] == items, text
    for text, error in bad.items():
        assert got[text].errors == [error], text
