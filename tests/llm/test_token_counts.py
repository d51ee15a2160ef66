import random
import re

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from stmtflow.llm.token_counts import LongestMatch, byte_vocabulary, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


def greedy(word, starting, continuing):
    at = n = 0
    while at < len(word):
        pieces = starting if at == 0 else continuing
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 0
        at, n = end, n + 1
    return n


@settings(max_examples=400, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=4).map(lambda b: bytes(97 + x % 3 for x in b))),
       st.sets(st.binary(min_size=1, max_size=4).map(lambda b: bytes(97 + x % 3 for x in b))),
       st.lists(st.binary(max_size=12).map(lambda b: bytes(97 + x % 3 for x in b)), max_size=8))
def test_automaton_equals_greedy_matching(starting, continuing, words):
    automaton = LongestMatch(starting, continuing)
    for w in words:
        assert automaton.count(w) == greedy(w, starting, continuing)


def test_query_over_whole_table(spark, sf_small):
    from stmtflow.llm.catalog import QUERIES

    starting, continuing = (set(x) for x in byte_vocabulary(PATH))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    got = QUERIES["op1_token_counts"](spark, sf_small).collect()
    assert len(got) == len(texts)
    for r in random.Random(1).sample(got, 60):
        words = re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or "")
        assert r.n_words == len(words) and r.n_unknown == 0
        assert r.n_tokens == sum(greedy(b" " + w.encode(), starting, continuing) for w in words)


def test_odd_rows(spark, odd_docs, no_docs):
    vocabulary = ([b" one"], [b"t", b"w", b"o"])
    got = token_counts(odd_docs, *vocabulary).collect()
    assert len(got) == odd_docs.count()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert (by[0].n_words, by[0].n_tokens) == (0, 0) and by[2].n_words == 0
    assert (by[3].n_words, by[3].n_tokens, by[3].n_unknown) == (1, 1, 0)
    assert by[11].n_words == 1 and by[11].n_unknown == 1
    assert token_counts(no_docs, *vocabulary).count() == 0
