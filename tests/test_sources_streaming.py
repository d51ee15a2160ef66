import os

from pyspark.sql import functions as F

from stmtflow.plans import catalog as cat
from stmtflow.plans import fixtures as fx
from stmtflow.session import shared_path
from stmtflow.sources.documents import parse_workitems, read_binary_documents, read_text_documents, scan_workitems
from stmtflow.streaming.pipeline import append_batch, last_id_before, read_stream_table


def test_read_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("# A\n\nline\n", encoding="utf-8")
    (tmp_path / "b.md").write_text("# B", encoding="utf-8")
    (tmp_path / "c.txt").write_text("skip", encoding="utf-8")
    (tmp_path / "empty.md").write_text("", encoding="utf-8")
    docs = {os.path.basename(r.document_path): r.text
            for r in read_text_documents(spark, str(tmp_path), path_glob="*.md").collect()}
    assert docs == {"a.md": "# A\n\nline\n", "b.md": "# B", "empty.md": ""}
    binary = read_binary_documents(spark, str(tmp_path), path_glob="*.md")
    assert set(binary.columns) >= {"path", "modificationTime", "length", "content"} and binary.count() == 2  # Spark passes over empty files


def test_workitems_missing_vs_null(spark, tmp_path):
    p = tmp_path / "items.jsonl"
    p.write_text('{"document_path": "a"}\n{"document_path": "b", "document_type_hint": null}\n'
                 '{"document_path": "c", "document_type_hint": "INV"}\n', encoding="utf-8")
    out = {r.document_path: r.document_type_hint for r in scan_workitems(spark, str(p)).collect()}
    assert out == {"a": "PSEG_BILL", "b": None, "c": "INV"}


def test_stream_append_replay_is_idempotent(spark, sf_small):
    table = shared_path(spark, "test", "stream_table", unique=True)
    rows = cat._run(spark, sf_small, stored_stage=True).stored.drop("branch")
    part_a = rows.where(F.col("doc_id") % 2 == 0)
    part_b = rows.where(F.col("doc_id") % 2 == 1)
    append_batch(part_a, 0, table)
    append_batch(part_b, 1, table)
    append_batch(part_b, 1, table)  # replay of batch 1 replaces itself
    out = read_stream_table(spark, table)
    n = rows.count()
    assert out.count() == n
    ids = sorted(r.id for r in out.select("id").collect())
    assert ids == list(range(1, n + 1))


def test_stream_ingest_equals_batch(spark, sf_small):
    stream = cat.q_stream_ingest(spark, sf_small)
    batch = cat.q_document_status(spark, sf_small)
    assert sorted(stream.collect()) == sorted(batch.collect())


def test_stream_corrections_equals_batch(spark, sf_small):
    assert sorted(cat.q_stream_corrections(spark, sf_small).collect()) == \
        sorted(cat.q_apply_corrections(spark, sf_small).collect())


def test_work_item_fixture_parse(spark, sf_small):
    parsed = parse_workitems(fx.mixed_work_items(spark, sf_small))
    counts = {r.document_type_hint: r["count"] for r in parsed.groupBy("document_type_hint").count().collect()}
    assert None in counts and "GENERIC_INVOICE" in counts


def test_streams_connect_and_equal_the_batch_run(spark, sf_small):
    def rows(df):
        return sorted((r.account_number or "", str(r.billing_date), str(r.total_amount_due), r.document_type) for r in df.collect())

    streamed = cat.q_stream_all(spark, sf_small)
    stored = cat.q_store_all(spark, sf_small)
    assert rows(streamed) == rows(stored)
    n = stored.count()
    assert sorted(r.id for r in streamed.collect()) == list(range(1, n + 1))


def test_append_raises_when_the_manifest_cannot_be_read(spark):
    import pytest

    table = shared_path(spark, "test", "broken", unique=True)
    assert last_id_before(spark, table, 0) == 0
    spark.range(1).selectExpr("'x' AS last_id").write.parquet(f"{table}_manifest/batch_id=0")
    with pytest.raises(Exception):
        last_id_before(spark, table, 1)


def test_bucketed_inputs_join_without_exchange(spark, sf_small):
    from stmtflow.plans.pipeline import extraction_results
    from stmtflow.sources.tables import write_bucketed

    docs = write_bucketed(cat._pipeline_docs(spark, sf_small), "t_docs", shared_path(spark, "t", "docs", unique=True), 8)
    resp = write_bucketed(fx.responses(spark, sf_small), "t_resp", shared_path(spark, "t", "resp", unique=True), 8)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # force the shuffle-join path
    try:
        joined = docs.join(extraction_results(resp), "doc_id", "left")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan, plan
        assert "SortMergeJoin" in plan
        assert joined.count() == docs.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_files_of_a_tree(spark, tmp_path):
    """Folders at several depths, empty and hidden files, one file alone, and many files over few tasks."""
    from stmtflow.sources.files import list_files, packed, read_files
    from stmtflow.sources.documents import scan_documents

    want = {}
    for i in range(60):
        folder = tmp_path / "/".join(f"d{i % k}" for k in (2, 3, 5)[: i % 4])
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{i}.md").write_bytes(b"" if i % 7 == 0 else bytes([i]) * i)
        want[str(folder / f"{i}.md")] = 0 if i % 7 == 0 else i
    (tmp_path / "_skip").mkdir()
    for name in ("_skip/x.md", ".hidden.md", "other.txt"):
        (tmp_path / name).write_text("no")
    files = list_files(spark, str(tmp_path), "*.md")
    assert {r["path"]: r["length"] for r in files.collect()} == want
    got = {r["path"]: r["content"] for r in read_files(files).collect()}
    assert {p: len(c) for p, c in got.items()} == want and got[str(tmp_path / "4.md")] == b"\x04" * 4
    assert packed(files, task_bytes=1 << 40).select("bin").distinct().count() == 1
    assert 15 <= packed(files, task_bytes=2 << 20).select("bin").distinct().count() <= 60
    single = scan_documents(spark, f"file:{tmp_path}/4.md", "files")
    assert [(r["path"], r["length"]) for r in single.collect()] == [(f"file:{tmp_path}/4.md", 4)]
    (tmp_path / "none").mkdir()
    assert read_files(list_files(spark, str(tmp_path / "none"))).count() == 0
    (tmp_path / "bad.md").write_bytes(b"a\xffb")
    assert read_text_documents(spark, str(tmp_path / "bad.md")).first()["text"] == "a\ufffdb"


def test_a_stage_with_texts_stores_records_alone(spark, sf_small, monkeypatch):
    """stream_append: the validated records are stored, the texts are read from the documents by each branch."""
    from stmtflow.plans import pipeline as pl

    stages = []
    monkeypatch.setattr(pl, "stored", lambda df: stages.append(df.columns) or kept(df))
    monkeypatch.setattr(pl, "cut", lambda df: stages.append(df.columns) or df)
    kept = cat.cut
    staged = cat._run(spark, sf_small, stored_stage=True).stored
    assert stages == [["doc_id", "record"]]
    same = lambda df: sorted((r.doc_id, r.branch, r.raw_ocr_text, r.account_number or "") for r in df.collect())
    assert same(staged) == same(cat._run(spark, sf_small).stored)


def _table_rows(spark, keys):
    from stmtflow.schemas import BILLS_TABLE

    names = [f for f in BILLS_TABLE.fields if f.name not in ("id", "created_at")]
    rows = spark.createDataFrame([(k, f"text {i}") for i, k in enumerate(keys)], "doc_id long, raw_ocr_text string")
    return rows.select("doc_id", *["raw_ocr_text" if f.name == "raw_ocr_text" else F.lit(None).cast(f.dataType).alias(f.name) for f in names])


def test_a_batch_read_again_is_numbered_as_a_stored_one(spark, monkeypatch):
    """Null and repeated keys over two batches: the same ids, and nothing stored but the table."""
    from stmtflow.streaming import pipeline as sp

    first, second = _table_rows(spark, [4, None, 2, 2]), _table_rows(spark, [1, 9])
    tables = {}
    for again in (False, True):
        table = shared_path(spark, "test", "again", unique=True)
        for number, batch in enumerate((first, second, second)):  # the second is replayed
            append_batch(batch, min(number, 1), table, reread=again)
        tables[again] = sorted((r.id, r.raw_ocr_text, r.batch_id) for r in read_stream_table(spark, table).collect())
        assert last_id_before(spark, table, 2) == 6
        monkeypatch.setattr(sp, "stored", lambda df: 1 / 0)
    assert tables[True] == tables[False] and [r[0] for r in tables[True]] == [1, 2, 3, 4, 5, 6] and tables[True][3][1] == "text 1"


def test_shuffles_of_a_stored_step_are_removed(spark):
    import time

    from stmtflow.session import REMOVE_SHUFFLES, materialize

    def shuffles():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_") and name.endswith(".data")}

    before, setting = shuffles(), spark.conf.get(REMOVE_SHUFFLES)
    kept = materialize(spark.range(1000).repartition(3, "id"), shared_path(spark, "test", "removed", unique=True))
    until = time.monotonic() + 20
    while shuffles() - before and time.monotonic() < until:
        time.sleep(0.2)
    assert not shuffles() - before and kept.count() == 1000 and spark.conf.get(REMOVE_SHUFFLES) == setting


def test_ingest_in_several_micro_batches(spark):
    """The documents are dealt to the micro-batches by their files; the rows are those of one batch."""
    from stmtflow.streaming.pipeline import stream_ingest_once

    rows = [(i, f"{i}.md", "T", " " if i % 5 == 0 else f"text {i}") for i in range(60)] + [(None, "n.md", "T", "text")]
    docs = spark.createDataFrame(rows, "doc_id long, document_path string, document_type_hint string, text string").repartition(8)
    responses = spark.createDataFrame([(i, 1, '{"account_number": "1"}' if i % 3 else "{") for i in range(50)], "doc_id long, attempt int, response string")
    outs = [stream_ingest_once(spark, docs, responses, batches=n) for n in (1, 4)]
    seen = [sorted(str((r.doc_id, r.text, r.status, r.route, r.branch, r.record)) for r in out.collect()) for out in outs]
    assert seen[0] == seen[1] and len(seen[0]) == 61
    assert [out.select("batch_id").distinct().count() for out in outs] == [1, 4]
