import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from stmtflow.llm import catalog, decontamination

ITEMS = "item_id bigint, text string, key string, spans string"


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(text, items, window=10, shingle=3, containment=1.0):
    """(words hit, ids of items) by trying every stretch against every window."""
    w, hit, ids = words(text), set(), set()
    for item, item_text in items:
        v = words(item_text)
        n = min(window, len(v))
        for i in range(len(v) - n + 1) if v else ():
            win = v[i:i + n]
            size = min(shingle, n)
            grams = {tuple(win[k:k + size]) for k in range(n - size + 1)}
            for j in range(len(w) - n + 1):
                part = w[j:j + n]
                if containment >= 1:
                    good = part == win
                else:
                    own = {tuple(part[k:k + size]) for k in range(n - size + 1)}
                    good = len(grams & own) >= math.ceil(containment * len(grams) - 1e-9)
                if good:
                    hit |= set(range(j, j + n))
                    ids.add(item)
    return len(w), len(hit), sorted(str(i) for i in ids if i is not None)


@pytest.fixture(scope="module")
def made(spark):
    """Documents and items over few words, so that windows overlap, repeat and nearly match."""
    rng = random.Random(3)
    prose = lambda n: " ".join(rng.choice(["aa", "Bb", "c3", "é", "dd", "ß", "x", "yy"]) for _ in range(n))
    passage = prose(30)
    items = [(1, passage), (2, prose(4)), (10, passage[:60] + " " + prose(12)), (3, None), (4, " .,- "), (None, prose(12)), (1, passage), (5, "yy")]
    docs = [(i, prose(rng.randint(0, 60))) for i in range(25)]
    docs += [(100, f"{prose(20)}. {passage.upper()}! {prose(20)}"), (101, passage.replace("aa", "zz", 1)), (102, None), (103, ""),
             (104, f"{passage} {passage}"), (104, f"{passage} {passage}"), (None, passage), (105, passage[: len(passage) // 2])]
    return docs, items, spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(i, t, "k", "s") for i, t in items], ITEMS)


def found(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), sorted(r["items"])) for r in df.collect())


@pytest.mark.parametrize("containment", [1.0, 0.75, 0.4])
@pytest.mark.parametrize("slice_bytes", [1 << 20, 200])
def test_equals_brute_force(made, containment, slice_bytes):
    docs, items, docs_df, items_df = made
    got = decontamination.find(docs_df, items_df, containment=containment, slice_bytes=slice_bytes)
    assert found(got) == sorted((d is None, d or 0, *brute(t, items, containment=containment)) for d, t in docs)


def test_spans_are_word_ranges(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, f"zero {item} twelve; {item[4:]}")], "doc_id int, text string")
    got = decontamination.find(docs, spark.createDataFrame([("i", item)], "item_id string, text string")).first()
    assert [tuple(s) for s in got["spans"]] == [(1, 12), (13, 23)] and got["items"] == ["i"]


def test_prefix_is_the_rarest_shingle():
    """Of each window only the shingle that is rarest in the documents leads to it."""
    index = decontamination.WindowIndex([("a b c d e f g h i j", "1")], 3, 1.0)
    rarity = [9, 8, 7, 2, 7, 8, 9, 9]
    codes = index.groups[0][4][0]
    by_code = dict(zip(codes.tolist(), rarity))
    index.order_by_rarity(np.array([by_code[c] for c in index.codes.tolist()]))
    assert index.prefixes[0][0].tolist() == [codes[3]] and index.prefixes[0][3].tolist() == [3]


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "one two three four", "k", None), (2, None, None, None), (None, None, None, None)], ITEMS)
    got = decontamination.digests(decontamination.find(odd_docs, items))
    assert got.count() == odd_docs.count()
    assert [r["doc_id"] for r in got.filter("contaminated").collect()] == [4]
    empty = hashlib.sha256(b"").hexdigest()
    assert got.filter("NOT contaminated").select("items_sha256").distinct().collect()[0][0] == empty
    assert decontamination.find(no_docs, items).count() == 0
    none = decontamination.digests(decontamination.find(odd_docs, items.limit(0)))
    assert none.count() == odd_docs.count() and none.agg(F.sum("n_hit")).first()[0] == 0
    same = lambda df: sorted(map(str, (r["n_words"] for r in df.collect())))
    assert same(none) == same(got)


def test_query_equals_sql(spark, sf_small, con):
    got = catalog.op12_decontamination(spark, sf_small)
    want = con.execute(catalog.SQL["op12_decontamination"])
    order = [c[0] for c in want.description]
    assert sorted(map(tuple, got.select(order).collect())) == sorted(want.fetchall())
    assert got.filter("contaminated").count() > 0
