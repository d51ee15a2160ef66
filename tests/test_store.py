import json

from pyspark.sql import functions as F

from stmtflow.operators.store import (
    append_bills, assign_ids, constraint_error, encode_line_items, ensure_bills_table, export_records_json,
)
from stmtflow.operators.responses import validate_response
from stmtflow.schemas import BILLS_TABLE
from stmtflow.session import cut, shared_path


def test_assign_ids_dense_in_key_order(spark):
    df = spark.range(0, 5000, 1, 7).select((F.col("id") * 3 + 11).alias("doc_id")).repartition(5)
    out = assign_ids(df, "doc_id", start=100).orderBy("doc_id").collect()
    assert [r.id for r in out] == list(range(101, 5101))


def test_assign_ids_keeps_null_repeated_and_text_keys(spark):
    df = spark.createDataFrame([("b", 1), (None, 2), ("a", 3), ("a", 4), (None, 5), ("c", 6)], "key string, x int").repartition(4)
    out = {r.x: r.id for r in assign_ids(df, "key", start=10, parts=3).collect()}
    assert {out[3], out[4]} == {11, 12} and out[1] == 13 and out[6] == 14 and {out[2], out[5]} == {15, 16}
    assert assign_ids(df.limit(0), "key").count() == 0


def test_assign_ids_parts_are_balanced(spark):
    from stmtflow.operators import store

    df = spark.range(0, 80_000, 2).withColumnRenamed("id", "doc_id")
    ids = assign_ids(df, "doc_id", parts=40)
    assert ids.filter("id = doc_id / 2 + 1").count() == 40_000
    part = store.F.spark_partition_id()
    sizes = [r["count"] for r in df.repartitionByRange(40, "doc_id").groupBy(part).count().collect()]
    assert max(sizes) < 2 * 40_000 / 40


def test_encode_line_items(spark):
    df = spark.createDataFrame([(1, [("a", None)]), (2, []), (3, None)],
                               "k int, items array<struct<description:string,amount:double>>")
    out = {r.k: r.j for r in df.select("k", encode_line_items("items").alias("j")).collect()}
    assert json.loads(out[1]) == [{"description": "a", "amount": None}]
    assert out[2] is None and out[3] is None


def _records(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, response string, full_ocr_text string, document_type string")
    return validate_response(df)


def test_constraints(spark):
    recs = _records(spark, [
        (1, '{"total_amount_due": 99999999.99}', "t", "X"),
        (2, '{"total_amount_due": 99999999.995}', "t", "X"),
        (3, '{"account_number": "' + "9" * 256 + '"}', "t", "X"),
        (4, '{}', "t", "Y" * 101),
        (5, '{"previous_balance": "NaN"}', "t", "X"),
    ])
    out = {r.doc_id: r.e for r in recs.select("doc_id", constraint_error().alias("e")).collect()}
    assert out[1] is None
    assert out[2] == "numeric field overflow: total_amount_due"  # rounds half up past the limit
    assert out[3].startswith("value too long for account_number")
    assert out[4].startswith("value too long for document_type")
    assert out[5] == "numeric field overflow: previous_balance"


def test_table_create_and_append(spark):
    path = shared_path(spark, "test", "bills", unique=True)
    empty = ensure_bills_table(spark, path)
    assert empty.count() == 0
    assert [(f.name, f.dataType) for f in empty.schema] == [(f.name, f.dataType) for f in BILLS_TABLE]
    ensure_bills_table(spark, path)  # idempotent
    recs = _records(spark, [(5, '{"account_number": "A", "line_items": []}', "t", "PSEG_BILL"),
                            (3, '{"total_amount_due": 1.005}', "t", "PSEG_BILL")])
    first = {r.id: r for r in append_bills(recs, path).collect()}
    assert sorted(first) == [1, 2]
    assert first[1].total_amount_due is not None and str(first[1].total_amount_due) == "1.01"
    assert first[2].account_number == "A" and first[2].line_items is None
    second = append_bills(recs, path)  # append-only: a rerun duplicates, ids continue
    assert sorted(r.id for r in second.collect()) == [3, 4]
    assert spark.read.parquet(path).count() == 4


def test_export_keeps_nulls(spark):
    recs = _records(spark, [(1, '{"account_number": "A"}', "t", "X")])
    js = export_records_json(recs).first().json
    parsed = json.loads(js)
    assert parsed["account_number"] == "A" and "due_date" in parsed and parsed["due_date"] is None
    assert "\n" in js  # indented


def test_exported_files_keep_ids_and_are_not_overwritten(spark, tmp_path):
    import pytest

    recs = _records(spark, [(1, '{"account_number": "A"}', "t", "X"), (2, '{"account_number": "B"}', "t", "X")])
    export_records_json(recs, path=str(tmp_path / "out"))
    back = {r.doc_id: json.loads(r.json)["account_number"] for r in spark.read.json(str(tmp_path / "out")).collect()}
    assert back == {1: "A", 2: "B"}
    with pytest.raises(Exception):
        export_records_json(recs, path=str(tmp_path / "out"))


def test_rows_are_numbered_where_they_lie(spark):
    """The ids of ``assign_ids``, with one exchange of the rows and no join of them on the key."""
    import random

    from stmtflow.operators.store import number_rows

    rng = random.Random(2)
    rows = [(rng.choice([None, *range(90)]), f"text {i}") for i in range(700)] + [(50, "same")] * 30
    for kind in ("long", "string"):
        df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc_id", F.col("doc_id").cast(kind)).repartition(5)
        got = sorted((r.id, str(r.doc_id)) for r in number_rows(df, "doc_id", 10, parts=7).collect())
        assert [i for i, _ in got] == list(range(11, 741))
        assert got == sorted((r.id, str(r.doc_id)) for r in assign_ids(df, "doc_id", 10, parts=3).collect())
    assert number_rows(df.limit(0), "doc_id").count() == 0
    whole = cut(spark.range(1000).selectExpr("id AS doc_id", "repeat('x', 100) AS text"))
    plan = number_rows(whole, "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange" in line and "text" in line for line in plan.partition("Initial Plan")[0].splitlines()) <= 1 and "SortMergeJoin" not in plan


def test_texts_stay_out_of_the_stored_stage(spark, sf_small):
    from stmtflow.plans import catalog as cat

    with_text, without = cat._run(spark, sf_small), cat._run(spark, sf_small, stored_stage=True, keep_text=False)
    assert {r[0] for r in without.processed.select("text").distinct().collect()} <= {None, "", "text"}
    for name in ("processed", "direct", "corrected", "pending"):
        cols = [c for c in ("doc_id", "status", "route", "reason", "store_status", "store_reason") if c in getattr(without, name).columns]
        assert sorted(map(str, getattr(without, name).select(cols).collect())) == sorted(map(str, getattr(with_text, name).select(cols).collect())), name
    from stmtflow.plans.pipeline import with_texts

    same = lambda df: sorted((r.doc_id, r.raw_ocr_text, r.account_number or "") for r in df.collect())
    assert same(with_texts(without.stored, cat._pipeline_docs(spark, sf_small))) == same(with_text.stored)


def exchanges_of(df, column):
    """How many exchanges of the plan carry a column of this name."""
    plan = df._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0].splitlines()
    return sum("Exchange " in line and any(column in below for below in plan[i + 1:i + 2]) for i, line in enumerate(plan))


def test_ids_leave_rows_where_their_key_puts_them(spark):
    """Rows partitioned by their key get ids without an exchange of their texts, with the ids of stored rows."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [(k, f"text {i}") for i, k in enumerate([5, None, 3, 3, 9, None, 7] * 20)]
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        df = spark.createDataFrame(rows, "doc_id long, body string").repartition(n, "doc_id")
        out = assign_ids(df, "doc_id", 10)
        assert exchanges_of(out, "body") == exchanges_of(df, "body")
        assert sorted((r.id, str(r.doc_id)) for r in out.collect()) == sorted(
            [*((11 + i, k) for i, k in enumerate("3" * 40 + "5" * 20 + "7" * 20 + "9" * 20)), *((111 + i, "None") for i in range(40))])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_rows_appended_twice_over_are_those_appended_once(spark):
    from stmtflow.operators.store import append_rows, table_rows

    recs = _records(spark, [(k, '{"account_number": "' + str(i) + '"}', f"text {i}", "X") for i, k in enumerate([4, 2, None, 2, 8])])
    rows = table_rows(recs)
    kept = [sorted((r.id, r.account_number, r.raw_ocr_text) for r in append_rows(rows, shared_path(spark, "test", "bills", unique=True), reread=again).collect())
            for again in (False, True)]
    assert kept[0] == kept[1] and [r[0] for r in kept[0]] == [1, 2, 3, 4, 5] and kept[0][4][1] == "2"


def test_keys_that_change_between_readings_are_an_error(spark, monkeypatch):
    import pytest

    from stmtflow.operators import store

    monkeypatch.setattr(store, "cut", lambda df: cut(df.where("_k <> 5")))  # as if the first reading had not seen it
    df = spark.range(9).withColumnRenamed("id", "doc_id")
    with pytest.raises(Exception, match="keys changed"):
        assign_ids(df, "doc_id").collect()


def test_a_filled_table_is_stored_once(spark, sf_small, monkeypatch):
    """bills_table: no text goes through an exchange or into a copy beside the table, which is written with the codec of the stages."""
    import pyarrow.parquet as pq

    from stmtflow.operators import store
    from stmtflow.plans import catalog as cat

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    stored = []
    monkeypatch.setattr(store, "cut", lambda df: stored.append(df.columns) or cut(df))
    try:
        docs = cat._pipeline_docs(spark, sf_small)  # the text holds this street
        assert exchanges_of(docs.join(spark.range(10).withColumnRenamed("id", "doc_id"), "doc_id", "left"), "Elm Street") == 0
        out = cat.q_bills_table(spark, sf_small)
        assert out.count() == 1500 and all("raw_ocr_text" not in c for c in stored)
        written = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in out.inputFiles()]
        assert {m.row_group(0).column(0).compression for m in written if m.num_row_groups} == {"ZSTD"}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
