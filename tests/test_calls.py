import threading
import time

import pytest
from pyspark.sql import functions as F

from stmtflow.operators import calls
from stmtflow.operators.responses import first_valid_response, model_extract, validate_response
from stmtflow.operators.routing import document_status


def test_answers_keep_their_order_and_errors():
    def fn(text):
        time.sleep((hash(text) % 7) / 500)
        if text.endswith("3"):
            raise ValueError(text)
        return text.upper()

    rows = [(i, f"t{i}") for i in range(100)]
    want = list(calls.one_by_one(fn, rows))
    assert list(calls.in_order(fn, iter(rows), 6, 5.0)) == want == list(calls.in_order(fn, rows))
    assert want[3] == (3, None, "ValueError: t3") and list(calls.in_order(fn, [], 4, 1.0)) == []


def test_at_most_so_many_calls_at_once_and_bounded_lookahead():
    now, most, taken = 0, 0, []
    lock = threading.Lock()

    def fn(text):
        nonlocal now, most
        with lock:
            now += 1
            most = max(most, now)
        time.sleep(0.3 if text == "0" else 0.002)
        with lock:
            now -= 1
        return text

    def rows():
        for i in range(200):
            taken.append(i)
            yield i, str(i)

    out = calls.in_order(fn, rows(), 3, None)
    first = next(out)
    assert first[:2] == (0, "0") and len(taken) <= 3 * calls.AHEAD + 1
    assert [k for k, _, _ in out] == list(range(1, 200)) and most == 3


def test_wall_time_falls_with_concurrency():
    rows = [(i, str(i)) for i in range(24)]
    spent = {}
    for n in (1, 8):
        t = time.monotonic()
        list(calls.in_order(lambda x: time.sleep(0.05), rows, n, 10.0))
        spent[n] = time.monotonic() - t
    assert spent[1] > 1.1 and spent[8] < spent[1] / 3


def test_a_hanging_call_is_an_error_and_blocks_nobody():
    release = threading.Event()

    def fn(text):
        if text in ("2", "5"):
            release.wait(30)
        return text

    t = time.monotonic()
    got = list(calls.in_order(fn, [(i, str(i)) for i in range(10)], 2, 0.3))
    release.set()
    assert time.monotonic() - t < 5
    assert [k for k, a, e in got if e] == [2, 5] and all("TimeoutError" in e for _, _, e in got if e)
    assert [a for _, a, e in got if not e] == [str(i) for i in range(10) if i not in (2, 5)]


def test_a_service_that_never_answers_does_not_fill_the_process():
    release = threading.Event()
    before = threading.active_count()
    got = list(calls.in_order(lambda x: release.wait(60), [(i, "") for i in range(60)], 1, 0.02))
    during = threading.active_count() - before
    release.set()
    assert len(got) == 60 and all("TimeoutError" in e for _, _, e in got) and during <= calls.LOST + 2


def test_threads_end_with_the_rows():
    before = threading.active_count()
    assert len(list(calls.in_order(lambda x: x, [(1, "a")] * 50, 4, 1.0))) == 50
    deadline = time.monotonic() + 5
    while threading.active_count() > before and time.monotonic() < deadline:
        time.sleep(0.01)
    assert threading.active_count() <= before


@pytest.fixture(scope="module")
def documents(spark):
    texts = ["hang", "good", "bad json", "raise", " ", "good"]
    return spark.createDataFrame([(f"d{i}", t, "p", "T") for i, t in enumerate(texts)], "doc_id string, text string, document_path string, document_type_hint string").coalesce(1)


def a_model():
    def make():  # local, so that tasks get it by value
        def fn(text):
            if text == "hang":
                time.sleep(120)
            if text == "raise":
                raise RuntimeError("no")
            return '{"account_number": "1"}' if text == "good" else "{"

        return fn

    return make


def test_model_extract_sends_hanging_calls_to_review(spark, documents):
    t = time.monotonic()
    answers = model_extract(documents, a_model(), attempts=2, concurrency=3, deadline=1.0)
    rows = sorted((r["doc_id"], r["attempt"], r["response"], r["error"]) for r in answers.collect())
    assert time.monotonic() - t < 110
    late = "TimeoutError: no answer within 1 s"
    assert rows == [("d0", 1, None, late), ("d0", 2, None, late), ("d1", 1, '{"account_number": "1"}', None), ("d2", 1, "{", None), ("d2", 2, "{", None),
                    ("d3", 1, None, "RuntimeError: no"), ("d3", 2, None, "RuntimeError: no"), ("d5", 1, '{"account_number": "1"}', None)]
    status = document_status(documents.join(first_valid_response(answers).select("doc_id", "record"), "doc_id", "left"))
    routes = {r["doc_id"]: r["route"] for r in status.collect()}
    assert routes == {"d0": "LLM_FAILURE", "d1": "LLM_SUCCESS", "d2": "LLM_FAILURE", "d3": "LLM_FAILURE", "d4": None, "d5": "LLM_SUCCESS"}


def test_concurrency_changes_no_row(spark, documents):
    quick = documents.where("text <> 'hang'")
    plain = model_extract(quick, a_model(), attempts=2)
    wide = model_extract(quick.repartition(3), a_model(), attempts=2, concurrency=5, deadline=30.0)
    same = lambda df: sorted(map(str, df.collect()))
    assert same(plain) == same(wide)


def test_stored_answers_are_not_asked_again(spark, tmp_path):
    log = tmp_path / "asked"
    log.write_text("")

    def make():
        def fn(text):
            with open(log, "a") as f:
                f.write(text + "\n")
            return '{"account_number": "1"}' if text != "c" else None

        return fn

    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "doc_id int, text string")
    store = str(tmp_path / "answers")
    first = sorted(map(str, model_extract(docs, make, attempts=2, store=store).collect()))
    assert sorted(log.read_text().split()) == ["a", "b", "c", "c"]
    again = sorted(map(str, model_extract(docs, make, attempts=2, store=store).collect()))
    assert again == first and len(log.read_text().split()) == 4
    # A round whose write did not end is asked again, a complete one is not.
    (tmp_path / "answers" / "attempt=2" / "_SUCCESS").unlink()
    model_extract(docs, make, attempts=2, store=store).collect()
    assert sorted(log.read_text().split()) == ["a", "b", "c", "c", "c"]
    assert validate_response(model_extract(docs, make, attempts=2, store=store)).where(F.size("errors") == 0).count() == 2


def test_hanging_calls_are_waited_for_together():
    release = threading.Event()

    def fn(text):
        if int(text) % 100 == 0:
            release.wait(30)
        return text

    t = time.monotonic()
    got = list(calls.as_answered(fn, [(i, str(i)) for i in range(800)], 10, 1.0))
    spent = time.monotonic() - t
    release.set()
    assert spent < 4  # eight hang: in order they are waited for in turn
    assert sorted(k for k, _, _ in got) == list(range(800)) and sorted(k for k, _, e in got if e) == list(range(0, 800, 100))


def test_documents_wait_for_lost_calls_to_end():
    def fn(text):
        if int(text) % 10 == 0:
            time.sleep(1.0)
        return text

    for run in (calls.in_order, calls.as_answered):
        got = list(run(fn, [(i, str(i)) for i in range(120)], 1, 0.2))
        assert sorted(k for k, _, e in got if e) == list(range(0, 120, 10)) and len(got) == 120


def test_a_deadline_gathers_small_partitions(spark, documents):
    quick = documents.where("text <> 'hang'").repartition(64)
    answers = model_extract(quick, a_model(), attempts=1, concurrency=3, deadline=30.0)
    assert answers.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism and answers.count() == 4
