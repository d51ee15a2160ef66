"""Registered queries of the corpus operators (thin: rows come from the operators)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (conversation_repair, decontamination, html_main, language_id, mixing, ngram_join, packing, pii_spans, quality_ledger, spelling_variants, token_counts, topk_search,
               toxicity)
from .common import id_remainder, table

TOKENIZER = "byte_bpe_50k.json"
QUERY_STEP = 20


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    starting, continuing = token_counts.byte_vocabulary(public_tokenizers.path(TOKENIZER))
    return token_counts.token_counts(table(spark, sf_dir, "documents"), starting, continuing)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.duplicate_groups(table(spark, sf_dir, "documents"))


def op3_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(table(spark, sf_dir, "pages"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii_spans.find(docs, pii_spans.fit(docs))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_ledger.ledger(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       (~quality_ledger.passes("base-1")).alias("base_failed"),
                       quality_ledger.passes("standard-1").alias("kept"), "failed")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_STEP == 0)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_remainder("doc_id", 4) == 2
    return language_id.identify(docs, language_id.fit(docs, ~held_out), held_out)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_remainder("doc_id", 5) == 0
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out), held_out)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.audited(table(spark, sf_dir, "conversations"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digests(decontamination.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.variant_groups(table(spark, sf_dir, "documents"))


QUERIES = {q.__name__: q for q in (op1_token_counts, op2_ngram_join, op3_html_main, op4_pii, op5_quality_rules, op6_packing, op7_mixing, op8_topk_search,
                                     op9_language_id, op10_toxicity, op11_conversation_repair, op12_decontamination, op13_spelling_variants)}

# A word is a maximal run without white space (space, tab to carriage return).
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

# Lower-cased A-Z, then words of 0-9, a-z and all characters beyond ASCII.
_PLAIN_WORDS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
                r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")



def _crc32(text: str) -> str:
    """Unsigned crc32 of the UTF-8 bytes of ``text`` (code points below 2048); needs the table ``crc`` (column t: 256 numbers)."""
    units = (f"flatten(list_transform(string_split({text}, ''), lambda c: IF(unicode(c) < 128, [unicode(c)::BIGINT], "
             f"[(192 + unicode(c) // 64)::BIGINT, (128 + unicode(c) % 64)::BIGINT])))")
    return f"xor(list_reduce({units}, lambda h, b: xor(h // 256, crc.t[(xor(h % 256, b) + 1)::INT]), 4294967295::BIGINT), 4294967295::BIGINT)"


# The 256 numbers of crc32 by its rule: eight halvings, with the polynomial where a bit falls out.
_CRC_TABLE = """crc AS (
  SELECT list_transform(range(0, 256), lambda i: list_reduce(range(0, 8), lambda h, k:
    IF(h % 2 = 1, xor(h // 2, 3988292384::BIGINT), h // 2), i::BIGINT)) AS t)"""

SQL: dict[str, str] = {
    "op11_conversation_repair": rf"""
WITH RECURSIVE {_CRC_TABLE},
c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS k
  FROM conversations, crc),
dam AS (
  SELECT conv_id, turn, IF(k = 4, 'user', role) AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM c, unnest(range(0, CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS u(copy)),
i AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM dam),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen FROM i),
f AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN seen > 1 THEN 'duplicate'
                 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE 'none' END AS fault,
         lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) || substr(role, 1, 1) AS pair FROM o),
-- States: 0 nothing yet, 1 system, 2 user, 3 assistant.
nxt(s, t, name) AS (VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')),
ins(s, t, cost, ed, lines) AS (
  SELECT s, s, 0, '', CAST([] AS VARCHAR[]) FROM nxt
  UNION ALL SELECT s, t, 5, 'I', [name || ':'] FROM nxt
  UNION ALL SELECT a.s, b.t, 10, 'II', [a.name || ':', b.name || ':'] FROM nxt a JOIN nxt b ON a.t = b.s),
ops(s, initial, t, cost, ed, name) AS (
  SELECT s, CAST(NULL AS VARCHAR), s, 2, 'D', CAST(NULL AS VARCHAR) FROM nxt
  UNION ALL SELECT s, NULL, t, 1, 'R', name FROM nxt
  UNION ALL VALUES (0, 's', 1, 0, 'K', NULL), (0, 'u', 2, 0, 'K', NULL), (1, 'u', 2, 0, 'K', NULL), (2, 'a', 3, 0, 'K', NULL), (3, 'u', 2, 0, 'K', NULL)),
dp AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, 0 AS s, CAST(0 AS BIGINT) AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS lines FROM conversations
  UNION ALL
  SELECT dp.conv_id, f.i, ops.t, dp.cost + ins.cost + ops.cost + IF(ops.ed <> 'D' AND fault = 'truncated', 5, 0), dp.audit || ins.ed || ops.ed,
         dp.lines || ins.lines || CASE ops.ed WHEN 'D' THEN [] WHEN 'R' THEN [ops.name || ':' || f.text] ELSE [f.role || ':' || f.text] END
  FROM dp JOIN f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.i = dp.i + 1 JOIN ins ON ins.s = dp.s
  JOIN ops ON ops.s = ins.t AND (ops.ed = 'D' OR fault IN ('none', 'truncated')) AND (initial IS NULL OR initial = substr(f.role, 1, 1))
  QUALIFY row_number() OVER (PARTITION BY dp.conv_id, ops.t ORDER BY dp.cost + ins.cost + ops.cost + IF(ops.ed <> 'D' AND fault = 'truncated', 5, 0),
                                                                   dp.audit || ins.ed || ops.ed) = 1),
m AS (
  SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM f GROUP BY conv_id),
e AS (
  SELECT dp.conv_id, dp.cost + ins.cost AS cost, dp.audit || ins.ed AS audit, dp.lines || ins.lines AS lines
  FROM dp JOIN ins ON ins.s = dp.s AND ins.t IN (0, 3) LEFT JOIN m ON m.conv_id IS NOT DISTINCT FROM dp.conv_id WHERE dp.i = coalesce(m.n, 0)
  QUALIFY row_number() OVER (PARTITION BY dp.conv_id ORDER BY dp.cost + ins.cost, dp.audit || ins.ed) = 1)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(cost AS BIGINT) AS cost, audit,
       sha256(array_to_string(lines, chr(10))) AS repaired_sha256
FROM e LEFT JOIN m ON m.conv_id IS NOT DISTINCT FROM e.conv_id""",
    "op13_spelling_variants": rf"""
WITH RECURSIVE {_CRC_TABLE},
r AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
         translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents),
o AS (SELECT id, run, count(*) AS k FROM r WHERE length(run) >= {spelling_variants.MIN_LENGTH} GROUP BY ALL),
h AS (SELECT run, k, {_crc32("id || ':' || run")} AS h FROM o, crc),
w AS (
  SELECT CASE WHEN h % {spelling_variants.DAMAGE_EVERY} <> 0 THEN run
              ELSE substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) END AS word, k FROM h),
v AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n FROM w WHERE length(word) >= {spelling_variants.MIN_LENGTH}
  GROUP BY word HAVING sum(k) >= {spelling_variants.MIN_COUNT}),
del AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM v, unnest(range(1, length(word) + 1)) AS u(i)),
one AS (
  SELECT a.word, b.word AS near FROM del a JOIN del b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
  UNION SELECT del.word, v.word FROM del JOIN v ON del.d = v.word
  UNION SELECT v.word, del.word FROM del JOIN v ON del.d = v.word),
best AS (SELECT one.word, count(*) AS n_near, max(struct_pack(n := b.n)).n AS top FROM one JOIN v b ON b.word = one.near GROUP BY one.word),
f AS (
  SELECT v.word, v.n, coalesce(best.n_near, 0) AS n_near, IF(best.top >= {spelling_variants.RATIO} * v.n,
         (SELECT min(one.near) FROM one JOIN v b ON b.word = one.near WHERE one.word = v.word AND b.n = best.top), NULL) AS form,
         IF(best.top >= {spelling_variants.RATIO} * v.n, best.top, NULL) AS form_n
  FROM v LEFT JOIN best USING (word)),
walk AS (
  SELECT word, word AS root, 0 AS step FROM f
  UNION ALL SELECT walk.word, f.form, step + 1 FROM walk JOIN f ON f.word = walk.root WHERE f.form IS NOT NULL),
roots AS (SELECT word, arg_max(root, step) AS root FROM walk GROUP BY word)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM f JOIN roots USING (word)""",
    "op12_decontamination": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_PLAIN_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_PLAIN_WORDS} AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item, w[i:i + {decontamination.WINDOW - 1}] AS g
  FROM b, unnest(range(1, greatest(len(w) - {decontamination.WINDOW - 2}, 2))) AS u(i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT len(g) AS l FROM iw),
dw AS (SELECT rid, i, l, w[i:i + l - 1] AS g FROM d, lens, unnest(range(1, len(w) - l + 2)) AS u(i)),
hit AS (SELECT rid, i, l, item FROM dw JOIN iw USING (g)),
cov AS (SELECT rid, count(DISTINCT i + j) AS n FROM hit, unnest(range(0, l)) AS u(j) GROUP BY rid),
its AS (SELECT rid, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hit GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(its.n, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(cov.n, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (rid) LEFT JOIN its USING (rid)""",
    "op5_quality_rules": rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
win AS (
  SELECT rid, i, w[i:i + 4] AS g FROM d, unnest(range(1, len(w) - 3)) AS u(i)),
rep AS (
  SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
cov AS (
  SELECT rid, count(DISTINCT i + j) AS n FROM rep, unnest(range(0, 5)) AS u(j) GROUP BY rid),
lin AS (
  SELECT rid, l FROM d, unnest(string_split(t, chr(10))) AS u(l) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
dup AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n FROM lin GROUP BY rid),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, coalesce(dup.n_lines, 0) AS n_lines,
         CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN cov USING (rid) LEFT JOIN dup USING (rid)),
b AS (
  SELECT *, CAST((n_words < 10)::INT + 2 * (100 * n_repeat_words > 20 * n_words)::INT
         + 4 * (10 * n_symbols > n_words)::INT + 8 * (n_dup_lines >= 5 AND 10 * n_dup_lines > 3 * n_lines)::INT
         + 16 * (word_chars < 2 * n_words)::INT + 32 * (word_chars > 20 * n_words)::INT AS INTEGER) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       failed & 3 <> 0 AS base_failed, failed = 0 AS kept, failed FROM b""",
    "op8_topk_search": f"""
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % {QUERY_STEP} = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id, score FROM s QUALIFY rank <= {topk_search.K}""",
}
