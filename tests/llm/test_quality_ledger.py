import re
from collections import Counter

from stmtflow.llm import quality_ledger as ql
from tools.check_oracle import compare


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if times[w] > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def test_query_equals_oracle(spark, sf_small, con):
    from stmtflow.llm.catalog import QUERIES, SQL

    ok, msg, _ = compare(spark, sf_small, "op5", QUERIES["op5_quality_rules"], SQL["op5_quality_rules"], con)
    assert ok, msg


def test_odd_rows_and_repeats(spark, odd_docs, no_docs):
    extra = ["a b c d e " * 3, "a b c d e f a b c d e", "x x x x x x", "l\nl\n \nl\r\nl", "#*$ %&|<>", "a b\x0bc\x0cd\x1ce", "\n\n"]
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame(list(enumerate(extra, 500)), "doc_id bigint, text string"))
    rows = ql.ledger(docs.selectExpr("doc_id", "text", "1 AS failed", "2 AS n_words")).collect()
    assert len(rows) == docs.count()
    key = lambda x: tuple((v is None, v) for v in x)
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows), key=key)
    assert got == sorted(((r.doc_id, *brute(r.text)) for r in docs.collect()), key=key)
    assert ql.ledger(no_docs).count() == 0


def test_plan_is_native(spark, sf_small):
    plan = ql.ledger(spark.read.parquet(f"{sf_small}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def test_policies_and_ablation(spark):
    masks = [0, 0, 1, 3, 4, 4, 5, 8]
    rows = spark.createDataFrame([(i, m) for i, m in enumerate(masks)], "doc_id bigint, failed int")
    kept = {p: {r.doc_id for r in rows.filter(ql.passes(p)).collect()} for p in ql.POLICIES}
    assert kept["base-1"] == {0, 1, 4, 5, 7} and kept["standard-1"] == {0, 1}
    got = {r.rule: r for r in ql.ablation(rows, "standard-1").collect()}
    for i, rule in enumerate(ql.RULES):
        bit = 1 << i
        assert (got[rule].n_failed, got[rule].n_only, got[rule].n_kept, got[rule].n_kept_without) == (
            sum(m & bit > 0 for m in masks), masks.count(bit), masks.count(0), sum(m & ~bit == 0 for m in masks))
