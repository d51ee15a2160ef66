"""Operator 5: document quality rules as a bitmask ledger, built-in functions only.

``ledger`` evaluates every rule once and stores, per document, the measurements and a
bitmask with one bit per failed rule. A policy is a named, versioned set of rules (a
mask); applying one is a bitwise AND over the stored column, so several policies, or a
changed one, never touch the texts again. ``ablation`` derives from the ledger alone what
each rule removes, alone and together with others, by aggregating the few distinct masks.

Cases: null text reads as empty (no words: the first rule fails); null ids are kept; rows
that repeat are scored one by one; an empty table gives an empty result; other columns
are ignored. Windows are compared by a 64-bit hash of their five words' hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, whole_text

MIN_WORDS = 10
WINDOW = 5
# Characters that count as symbols.
SYMBOLS = "#*$%&|<>"

# Rule name -> condition of failure over the measurements. Bit i belongs to the i-th rule.
RULES: dict[str, str] = {
    "few_words": f"n_words < {MIN_WORDS}",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "many_symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "n_dup_lines >= 5 AND 10 * n_dup_lines > 3 * n_lines",  # a short text may well repeat a line
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
}
BASE_RULES = ("few_words", "repeated_words")
# Versioned policies: the rules whose failure rejects a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base-1": BASE_RULES,
    "standard-1": (*BASE_RULES, "many_symbols", "duplicate_lines", "short_words", "long_words"),
}


def mask_of(rules) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in rules)


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, and ``failed``: the bitmask of failed rules."""
    text = F.col("_text")
    solid = F.translate(text, SPACE_CHARS, "")
    measured = docs.select(F.col("doc_id"), whole_text().alias("_text"))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, SPACE_CHARS, "")) > 0)
    # One kind of space, so that the split takes the literal path; runs leave empty strings, dropped below.
    words = F.filter(F.split(F.translate(text, SPACE_CHARS, " " * len(SPACE_CHARS)), " ", -1), lambda x: x != "")
    measured = measured.select(
        "doc_id", F.length(solid).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        lines.alias("_lines"), F.transform(words, lambda w: F.xxhash64(w)).alias("_h"))
    measured = measured.select(
        "doc_id", "word_chars", "n_symbols", F.size("_lines").cast("bigint").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.size("_h").cast("bigint").alias("n_words"), "_h")
    windows = F.expr(f"""IF(size(_h) < {WINDOW}, array(),
        transform(slice(_h, 1, greatest(size(_h) - {WINDOW - 1}, 0)),
                  (x, i) -> xxhash64(x, {', '.join(f'_h[i + {j}]' for j in range(1, WINDOW))})))""")
    measured = measured.withColumn("_w", windows).drop("_h")
    # Most documents repeat no window; only the others are sorted.
    some = F.size("_w") > F.size(F.array_distinct("_w"))
    ordered = F.when(some, F.array_sort(F.transform("_w", lambda x, i: F.struct(x.alias("h"), i.alias("p")))))
    measured = measured.withColumn("_s", ordered).drop("_w")
    repeats = F.expr("""array_sort(filter(
        transform(_s, (x, i) -> IF(x.h = get(_s, i - 1).h OR x.h = get(_s, i + 1).h, x.p, -1)), p -> p >= 0))""")
    measured = measured.withColumn("_r", repeats).drop("_s")
    covered = F.expr(f"aggregate(zip_with(_r, slice(_r, 2, size(_r)), (p, q) -> "
                     f"IF(q IS NULL, {WINDOW}, least(q - p, {WINDOW}))), 0, (a, x) -> a + x)")
    measured = measured.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("bigint")).drop("_r")
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(0) for i, rule in enumerate(RULES.values())]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return measured.withColumn("failed", failed.cast("int"))


def passes(policy: str) -> Column:
    """Whether a ledger row passes a policy."""
    return F.col("failed").bitwiseAND(F.lit(mask_of(POLICIES[policy]))) == 0


def ablation(rows: DataFrame, policy: str) -> DataFrame:
    """Per rule of a policy: documents that fail it, that fail nothing else, and that the policy keeps.

    ``rows`` is a ledger. Counts are first taken per distinct mask (2 ** rules rows at most).
    """
    mask = mask_of(POLICIES[policy])
    masks = rows.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("failed")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(mask_of([r])).alias("bit")) for r in POLICIES[policy]])
    each = masks.withColumn("r", F.explode(rules)).select("r.rule", "r.bit", "failed", "n")
    count = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("bigint")
    return each.groupBy("rule").agg(
        count(F.col("failed").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        count(F.col("failed") == F.col("bit")).alias("n_only"),
        count(F.col("failed") == 0).alias("n_kept"),
        count(F.col("failed").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0).alias("n_kept_without"),
        F.bit_or("failed").alias("failed_with"))
