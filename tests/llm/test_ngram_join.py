import random
import re
from collections import defaultdict

import pytest

from stmtflow.llm import ngram_join as nj


def brute(rows):
    """{doc_id: (class id, links)} from all pairs of (doc_id, text)."""
    words = re.compile(r"[^\x20\x09-\x0D]+").findall

    def shingles(text):
        w = words(text or "")
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [(d, t or "", shingles(t)) for d, t in rows]
    parent, links = list(range(len(sets))), [0] * len(sets)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a, s) in enumerate(sets):
        for j in range(i):
            both = len(s & sets[j][2])
            if a == sets[j][1] or both and 10 * both >= 8 * len(s | sets[j][2]):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _, _) in enumerate(sets):
        if d is not None:
            least[find(i)].append(d)
    return [(d, min(least[find(i)], default=None), links[i]) for i, (d, _, _) in enumerate(sets)]


def key(row):
    return tuple((x is None, x) for x in row)


def same(got, rows):
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got), key=key) == sorted(brute(rows), key=key)


def test_query_equals_all_pairs(spark, sf_small):
    from stmtflow.llm.catalog import QUERIES

    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    same(QUERIES["op2_ngram_join"](spark, sf_small).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_large_group_of_near_copies_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(nj, "LEAF", 8)
    monkeypatch.setattr(nj, "BROADCAST_ROWS", 5)
    r = random.Random(3)
    base = [f"w{r.randrange(900)}" for _ in range(200)]
    rows = []
    for i in range(70):
        words = list(base)
        for _ in range(r.randrange(5)):
            words[r.randrange(200)] = f"n{r.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(f"u{r.randrange(10**6)}" for _ in range(60))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    same(nj.duplicate_groups(docs).collect(), rows)


def test_few_long_members_leave_blocks_empty(spark, monkeypatch):
    monkeypatch.setattr(nj, "BLOCK_BYTES", 2048)  # of each group, far more blocks than members
    r = random.Random(7)
    rows = []
    for g in range(12):
        words = [f"g{g}w{r.randrange(10**6)}" for _ in range(300)]
        for i in range(3):
            rows.append((10 * g + i, " ".join([*words, f"end{i}"])))
    same(nj.duplicate_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect(), rows)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    same(nj.duplicate_groups(odd_docs).collect(), rows)
    assert nj.duplicate_groups(no_docs).count() == 0
    kept = nj.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    groups = {c for _, c, _ in brute(rows)}
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(g for g in groups if g is not None)
    # Rows without id whose text nobody else has stay, once.
    assert sum(r.doc_id is None for r in kept.collect()) == 1


@pytest.mark.parametrize("recall", [0.9, 0.9999])
def test_runs_meet_the_recall(recall):
    p = nj.THRESHOLD
    for _ in range(nj.DEPTH - 1):
        p = nj.THRESHOLD * (1 - (1 - p) ** nj.BRANCHES)
    n = nj.runs_needed(recall=recall)
    assert 1 - (1 - p) ** n >= recall > 1 - (1 - p) ** (n - 1)
