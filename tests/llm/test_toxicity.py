import random

import numpy as np
from pyspark.sql import functions as F

from stmtflow.llm import toxicity as tx


def corpus(spark, n=1500):
    r = random.Random(6)
    plain, rude = [f"w{i}" for i in range(300)], [f"rude{i}" for i in range(12)]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 7 == 0
        words = r.choices(plain, k=60) + (r.sample(rude, 4) if toxic else [])
        r.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return (spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int"), dict(labels))


def test_held_out_accuracy_and_evidence(spark):
    docs, labels, truth = corpus(spark)
    held = F.col("doc_id") % 5 == 0
    index = tx.fit(docs, labels, ~held)
    got = tx.score(docs, index, held).collect()
    assert len(got) == len(truth)
    wrong = [r.doc_id for r in got if r.held_out and r.predicted != truth[r.doc_id]]
    assert len(wrong) <= 2
    toxic = [r for r in got if r.held_out and r.predicted]
    assert all(truth[e] == 1 and e % 5 for r in toxic for e in r.evidence)


def test_nearest_is_exact(spark):
    docs, labels, _ = corpus(spark, 600)
    index = tx.fit(docs, labels, F.lit(True), k=7)
    n = len(index.ids)
    dense = np.zeros((n, len(index.idf)))
    for b, (word, local, weight) in enumerate(index.blocks):
        dense[b * tx.BLOCK + local, word] = weight
    for r in docs.limit(80).collect():
        vector = index.vector(r.text.split())
        scores = dense[:, list(vector)] @ np.array(list(vector.values())) if vector else np.zeros(n)
        want = [e for e in sorted(range(n), key=lambda e: (-round(scores[e], 10), index.ids[e])) if scores[e] > 1e-12][:7]
        got = index.nearest(vector) if vector else []
        assert np.allclose([s for s, _ in got], scores[want])


def test_isotonic_is_monotone_and_weighted():
    x, y = tx.isotonic(np.array([0.0, 0.2, 0.2, 0.6, 1.0]), np.array([0.0, 1.0, 0.0, 0.0, 1.0]), np.array([1.0, 1.0, 1.0, 2.0, 1.0]))
    assert (np.diff(y) >= 0).all() and np.interp(0.3, x, y) == 0.25


def test_query(spark, sf_small):
    from stmtflow.llm.catalog import QUERIES

    got = QUERIES["op10_toxicity"](spark, sf_small).collect()
    assert len(got) == spark.read.parquet(f"{sf_small}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(5, 1), (5, 0), (7, 1), (10, 0), (12, 0), (13, None), (999, 1), (None, 1)], "doc_id bigint, toxic int")
    index = tx.fit(odd_docs, labels, F.lit(True))
    assert len(tx.score(odd_docs, index, F.col("doc_id") == 3).collect()) == odd_docs.count()
    kept = tx.clean_documents(odd_docs, index)
    assert kept.columns == odd_docs.columns
    none = tx.fit(odd_docs, labels.limit(0), F.lit(True))
    assert none is None and {r.score for r in tx.score(odd_docs, none, F.lit(False)).collect()} == {0.0}
    assert tx.fit(no_docs, labels, F.lit(True)) is None and tx.clean_documents(no_docs, index).count() == 0
