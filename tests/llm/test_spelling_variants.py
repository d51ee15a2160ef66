import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from stmtflow.llm import catalog, spelling_variants as sv


def one_edit(a, b):
    """Whether exactly one inserted, deleted or replaced code point makes b of a."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(counts, ratio=10):
    """word -> (form, root, n, n_near, form_n)."""
    out, forms = {}, {}
    for w, n in counts.items():
        near = [v for v in counts if one_edit(w, v)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if best is not None and counts[best] >= ratio * n else None
        out[w] = (n, len(near))
    for w, (n, k) in out.items():
        root = w
        while forms[root]:
            root = forms[root]
        out[w] = (forms[w], root, n, k, forms[w] and counts[forms[w]])
    return out


def words(rng, many, letters, low, high):
    found = {"".join(rng.choice(letters) for _ in range(rng.randint(low, high))) for _ in range(many)}
    for w in sorted(found)[: many // 2]:
        i = rng.randrange(len(w))
        found |= {w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1:], w[:i] + w[i + 1:]}
    return sorted(w for w in found if len(w) >= low)


@pytest.mark.parametrize("seed", range(5))
def test_scan_equals_all_pairs(seed):
    rng = random.Random(seed)
    listed, asking = words(rng, 80, "abé", 2, 9), words(rng, 60, "abéc", 1, 9)
    exact = np.array([rng.randint(0, min(3, len(w))) for w in asking])
    got = sorted(zip(*[x.tolist() for x in sv.SortedList(listed).one_edit(asking, exact)]))
    assert got == [(i, q) for i, w in enumerate(listed) for q, a in enumerate(asking) if one_edit(w, a) and w[:exact[q]] == a[:exact[q]]]


def test_shared_prefixes_skip_only_far_ranges():
    rng = random.Random(1)
    vocabulary = words(rng, 300, "abc", 3, 8)
    for prefix in {w[:rng.randint(0, 5)] for w in vocabulary[:60]}:
        for word in vocabulary:
            if any(one_edit(word, v) or word == v for v in vocabulary if v.startswith(prefix)):
                assert sv.may_start(prefix, word)
    ranges = sv.Ranges(sorted(rng.sample(vocabulary, 40)))
    for word in vocabulary:
        for exact in range(4):
            wanted = {ranges.of(v) for v in vocabulary if one_edit(word, v) and v[:exact] == word[:exact]}
            assert wanted <= set(ranges.near(word, exact))
    assert sv.shared_prefix("abcd", "abxd") == "ab" and sv.shared_prefix("", "a") == "" and sv.shared_prefix("abc", "abc") == "abc"


@pytest.mark.parametrize("range_words", [1, 7, 100_000])
@pytest.mark.parametrize("min_length", [1, 5])
def test_variants_equal_all_pairs(spark, range_words, min_length):
    """With one word a range, a few, and all in one."""
    rng = random.Random(4)
    counts = {w: rng.choice([2, 3, 30, 31, 400, 400, 5000]) for w in words(rng, 150, "abcß", min_length, 11)}
    counts |= {"long" * 300 + x: n for x, n in (("", 2), ("a", 20), ("ab", 200))}
    got = sv.variants(spark.createDataFrame(list(counts.items()), "word string, n bigint"), min_length, range_words=range_words)
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got.collect()} == brute(counts)


def test_most_ranges_bounds_what_tasks_get(spark):
    rng = random.Random(5)
    counts = {w: 2 for w in words(rng, 400, "abcd", 7, 9)}
    got = sv.variants(spark.createDataFrame(list(counts.items()), "word string, n bigint"), range_words=1, most_ranges=3)
    assert {r["word"]: r["n_near"] for r in got.collect()} == {w: v[3] for w, v in brute(counts).items()}


def counted(rows, every=31):
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if every and h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                total[run] += 1
    return {w: n for w, n in total.items() if n >= 2}


def test_counts_and_odd_rows(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    rows += [(i, "Grüße Überraschung ÜBERRASCHUNG sentence sentence's xyzzyxyzzy " * 40 + "é×÷ÀÿABCD") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    want = counted(rows)
    assert {r["word"]: r["n"] for r in sv.word_counts(docs, damage_every=31).collect()} == want and len(want) > 4
    assert {r["word"]: r["n"] for r in sv.word_counts(docs).collect()} == counted(rows, 0)
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in sv.variant_groups(docs).collect()}
    assert got == brute(want) and any(v[0] for v in got.values())
    assert sv.variant_groups(no_docs).count() == 0


def test_query_equals_sql(spark, sf_small, con):
    got, want = catalog.op13_spelling_variants(spark, sf_small), con.execute(catalog.SQL["op13_spelling_variants"])
    order = [c[0] for c in want.description]
    assert sorted(map(str, map(tuple, got.select(order).collect()))) == sorted(map(str, want.fetchall()))
