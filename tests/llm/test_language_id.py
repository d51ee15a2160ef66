from pyspark.sql import functions as F

from stmtflow.llm import language_id as li


def test_held_out_accuracy(spark, sf_small):
    from stmtflow.llm.catalog import QUERIES

    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    got = QUERIES["op9_language_id"](spark, sf_small).collect()
    assert len(got) == len(truth) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert held and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def test_words_then_shorter_grams():
    tables = [{"known": [-1.0, -9.0]}, {"z": [-3.0, -1.0]}, {}, {" ab": [-2.0, -4.0], "bx ": [-4.0, -2.0]}, {}, {}]
    assert li.word_scores("known", tables, 2) == [-1.0, -9.0]
    assert li.word_scores("abx", tables, 2) == [-3.0, -3.0]  # both known trigrams
    assert li.word_scores("zq", tables, 2) == [-3.0, -1.0]   # single letters
    assert li.word_scores("q", tables, 2) == [0.0, 0.0]


def test_odd_rows(spark, odd_docs, no_docs):
    model = li.fit(odd_docs, F.lit(True))
    got = li.identify(odd_docs, model, F.col("doc_id") == 3).collect()
    assert len(got) == odd_docs.count()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[0].lang_pred == by[1].lang_pred == by[2].lang_pred == "und" and by[0].score == 0
    assert by[5].lang_pred in ("en", "fr") and by[3].held_out and not by[5].held_out
    nothing = li.fit(no_docs, F.lit(True))
    assert nothing[0] == [] and {r.lang_pred for r in li.identify(odd_docs, nothing, F.lit(False)).collect()} == {"und"}
    assert li.identify(no_docs, model, F.lit(False)).count() == 0


def test_copies_take_no_room_in_the_sample(spark):
    rows = [(i, "the very same words", "en") for i in range(3000)] + [(5000 + i, f"other{chr(97 + i)} text", "en") for i in range(20)]
    rows += [(9000 + i, "toujours le texte", "fr") for i in range(3000)]
    langs, tables = li.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), F.lit(True), per_language=30)
    assert langs == ["en", "fr"] and {f"other{chr(97 + i)}" for i in range(20)} <= set(tables[0])
