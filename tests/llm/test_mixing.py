from collections import Counter, defaultdict

import pytest

from stmtflow.llm import mixing as mx


def water_fill(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Targets by sharing and resharing until none is above its ceiling."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, free = dict.fromkeys(order, 0.0), share * sum(sizes.values()), set(order)
    while left > 1e-9 and free:
        total = sum(weight[s] for s in free)
        for s in free:
            target[s] += left * weight[s] / total
        left, over = 0.0, {s for s in free if target[s] > most * sizes[s]}
        for s in over:
            left += target[s] - most * sizes[s]
            target[s] = most * sizes[s]
        free -= over
    return target


def check(got, docs):
    sizes = defaultdict(int)
    for r in docs:
        sizes[r.source] += len([w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", r.text or "")])
    target, taken, largest = water_fill(sizes), Counter(), Counter()
    assert len(got) == len(docs)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    return {s: abs(taken[s] - target[s]) / max(largest[s], 1) for s in sizes}


def test_query(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    first = mx.mix_sizes(docs).collect()
    assert all(miss < 1 for miss in check(first, docs.collect()).values())
    again = mx.mix_sizes(docs.repartition(5)).collect()
    assert Counter(map(tuple, first)) == Counter(map(tuple, again))


def test_small_chunks_make_a_tree(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").withColumn("source", __import__("pyspark").sql.functions.lit("one"))
    docs = docs.withColumn("source", __import__("pyspark").sql.functions.when(docs.doc_id % 3 > 0, "big"))
    misses = check(mx.mix_sizes(docs, chunk=4).collect(), docs.collect())
    assert all(m < 1 for m in misses.values())


def test_odd_rows(spark, odd_docs, no_docs):
    got = mx.mix_sizes(odd_docs).collect()
    assert len(got) == odd_docs.count()
    copies = {}
    for r in got:  # rows that repeat get the same copies
        assert r.taken <= 2 * r.size
        copies.setdefault((r.doc_id, r.source, r.size), set()).add(r.copies)
    mixed = mx.mix(odd_docs)
    assert mixed.columns == odd_docs.columns
    assert mixed.count() == sum(r.copies for r in got)
    assert mx.mix_sizes(no_docs).count() == 0 and mx.mix(no_docs).count() == 0
