"""Operator 9: language identification, whole words first, character n-grams for the rest.

The model holds, per learned language, log frequencies of its commonest words and of its
commonest character n-grams of each length. A known word adds its log frequencies; an
unseen word falls back to its longest n-grams that are known anywhere, then to shorter
ones. The language of the largest total wins; the score is its share after the totals
are tempered by the number of words.

The model is fitted on a bounded sample: at most about ``per_language`` distinct texts of each of the
``MAX_LANGUAGES`` commonest languages, chosen by a hash of the text, and keeps at most ``words``
words and ``grams`` n-grams of each length per language. Its size is thus fixed by parameters,
whatever the size of the table; it goes to the tasks as a broadcast.

Cases: null text, or text without a letter, is ``und`` with score 0; so is everything if no
language can be learned. Null lang, and null ids, are never learned from. Repeated rows stay
rows of their own; an empty table gives an empty result; ties go to the language first by
code point; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, whole_text

UNDETERMINED = "und"
MAX_LANGUAGES = 256
LONGEST = 5
CACHE_WORDS = 200_000
LETTERS = re.compile(r"[^\W\d_]+")
RESULT = "doc_id bigint, held_out boolean, lang_pred string, score double"


def grams_of(word: str, n: int) -> list[str]:
    padded = f" {word} " if n > 1 else word
    return [padded[i:i + n] for i in range(len(padded) - n + 1)]


def _count_pieces(batches: Iterator) -> Iterator:
    """(lang, text) rows to partial counts (lang, n, piece, count); n 0 are whole words."""
    import pyarrow as pa

    for batch in batches:
        words: dict[str, Counter] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words.setdefault(lang, Counter()).update(LETTERS.findall(text.lower()))
        for lang, counts in words.items():
            tables = [counts, *[Counter() for _ in range(LONGEST)]]
            for word, count in counts.items():
                for n in range(1, LONGEST + 1):
                    for gram in grams_of(word, n):
                        tables[n][gram] += count
            for n, t in enumerate(tables):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(t), pa.string()), pa.array([n] * len(t), pa.int32()),
                     pa.array(list(t.keys()), pa.string()), pa.array(list(t.values()), pa.int64())],
                    names=["lang", "n", "piece", "count"])


def fit(docs: DataFrame, learn: Column, per_language: int = 2000, words: int = 20_000, grams: int = 5_000) -> tuple:
    """(languages, tables): tables[n] maps a piece to its log frequencies, n 0 for words."""
    rows = docs.select(F.col("lang").cast("string").alias("lang"), whole_text().alias("text"),
                       learn.alias("learn")).filter("learn AND lang IS NOT NULL")
    found = (rows.groupBy("lang").agg(F.count(F.lit(1)).alias("count"), F.countDistinct(F.xxhash64("text")).alias("texts"))
             .orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect())
    if not found:
        return [], [{} for _ in range(LONGEST + 1)]
    # The share of each language's distinct texts that is read, each once; at most MAX_LANGUAGES entries.
    share = F.create_map(*[F.lit(x) for r in found for x in (r["lang"], min(1.0, per_language / r["texts"]))])
    in_sample = F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * (1 << 20)
    pieces = (rows.filter(in_sample).select("lang", "text").distinct()
              .mapInArrow(_count_pieces, "lang string, n int, piece string, count bigint")
              .groupBy("lang", "n", "piece").agg(F.sum("count").alias("count")))
    pieces = cut(pieces)
    totals = {(r["lang"], r["n"]): r["total"] for r in pieces.groupBy("lang", "n").agg(F.sum("count").alias("total")).collect()}
    nth = F.row_number().over(Window.partitionBy("lang", "n").orderBy(F.desc("count"), "piece"))
    kept = pieces.withColumn("nth", nth).filter(F.col("nth") <= F.when(F.col("n") == 0, words).otherwise(grams))
    langs = sorted({r["lang"] for r in found} & {lang for lang, _ in totals})
    at = {lang: i for i, lang in enumerate(langs)}
    counts: list[dict] = [{} for _ in range(LONGEST + 1)]
    for r in kept.select("lang", "n", "piece", "count").collect():
        counts[r["n"]].setdefault(r["piece"], {})[at[r["lang"]]] = r["count"]
    tables = []
    for n, table in enumerate(counts):
        total = [totals.get((lang, n), 0) + 1.0 for lang in langs]
        base = [math.log(0.5 / t) for t in total]
        out = {}
        for piece, per in table.items():
            row = list(base)
            for i, c in per.items():
                row[i] = math.log((c + 0.5) / total[i])
            out[piece] = row
        tables.append(out)
    return langs, tables


def word_scores(word: str, tables: list[dict], width: int) -> list[float]:
    """Log frequencies of a word: its own, or the mean over its longest known n-grams."""
    own = tables[0].get(word)
    if own is not None:
        return own
    for n in range(LONGEST, 0, -1):
        rows = [tables[n][g] for g in grams_of(word, n) if g in tables[n]]
        if rows:
            return [sum(col) / len(rows) for col in zip(*rows)]
    return [0.0] * width


def predict_text(counts: Counter, langs: list[str], rows: np.ndarray) -> tuple[str, float]:
    """(language, score) from word counts and one row of log frequencies per distinct word."""
    n = np.fromiter(counts.values(), float, len(counts))
    totals = n @ rows
    odds = np.exp((totals - totals.max()) / max(1.0, n.sum() / 16))
    best = int(np.argmax(totals))
    return langs[best], float(odds[best] / odds.sum())


def identify(docs: DataFrame, model: tuple, held_out: Column) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        langs, tables = shared.value
        row_of: dict[str, int] = {}
        matrix = np.zeros((4096, max(len(langs), 1)))
        for batch in batches:
            out = []
            for text in batch.column(2).to_pylist():
                counts = Counter(LETTERS.findall(text.lower()))
                if not langs or not any(c.isalpha() for w in counts for c in w):
                    out.append((UNDETERMINED, 0.0))
                    continue
                if len(row_of) + len(counts) > CACHE_WORDS:
                    row_of.clear()
                need = len(row_of) + len(counts)
                if need > len(matrix):
                    matrix = np.concatenate([matrix, np.zeros((need, len(langs)))])
                at = []
                for word in counts:
                    i = row_of.get(word)
                    if i is None:
                        i = row_of[word] = len(row_of)
                        matrix[i] = word_scores(word, tables, len(langs))
                    at.append(i)
                out.append(predict_text(counts, langs, matrix[at]))
            cols = list(zip(*out)) or [(), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"),
                       whole_text().alias("text")).mapInArrow(run, RESULT)
