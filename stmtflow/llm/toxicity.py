"""Operator 10: toxicity by nearest labelled examples under exact TF-IDF cosine.

Labelled documents become TF-IDF vectors over the words that tell the labels apart
(chosen by association with the label in the learning rows). Their inverted index is cut
into blocks of examples; for every word a block knows the largest weight in it. A query
adds these maxima up to a bound per block, opens blocks in order of bound, and stops when
the bound of the next block is below its k-th best cosine: the k nearest are exact.
They vote with weights that grow with similarity; an isotonic fit over the examples' own
leave-one-out votes, weighted back to the true class shares, turns votes into
probabilities. The nearest examples are returned as evidence.

The examples are a bounded sample: at most about ``per_class`` labelled documents of each class, by
a hash of the id and without copies of each other, and at most ``features`` words. Index and calibration are of that size whatever
the corpus; they go to the tasks as a broadcast.

Cases: null or empty text, and text without any chosen word, get the rate of label 1 among
such examples; labels that are null, or whose document is missing, teach nothing; a document
with several labels counts as 1 if any is; with no labels every score is 0. Null ids are
scored but never learned from; repeated rows stay rows of their own; an empty table gives
an empty result; ties between examples go to the smaller id; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, packed, whole_text
from .ngram_join import shingles, sketch

WORD = re.compile(r"\w+")
RESULT = "doc_id bigint, held_out boolean, score double, predicted int, evidence array<bigint>"
BLOCK = 64


def _document_frequencies(batches: Iterator) -> Iterator:
    """(label, text) rows to partial document frequencies (word, clean, toxic)."""
    import pyarrow as pa

    for batch in batches:
        by = (Counter(), Counter())
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            by[label].update(set(WORD.findall(text.lower())))
        words = list(by[0].keys() | by[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(words, pa.string()), *[pa.array([c[w] for w in words], pa.int64()) for c in by]],
            names=["word", "clean", "toxic"])


def labelled_sample(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int) -> tuple[DataFrame, list[int]]:
    """(doc_id, label, text) of the examples, and the number of learning rows of each class."""
    known = (labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.col("toxic") > 0).cast("int").alias("label"))
             .filter("doc_id IS NOT NULL AND label IS NOT NULL")
             .groupBy("doc_id").agg(F.max("label").alias("label")).filter(learn))
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    share = F.when(F.col("label") == 1, per_class / max(sizes.get(1, 0), 1)).otherwise(per_class / max(sizes.get(0, 0), 1))
    # At most about 2 * per_class ids: the bound of the broadcast.
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30)).limit(3 * per_class)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))
    rows = rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text").mapInArrow(
        _marked, "doc_id bigint, label int, text string, m0 bigint, m1 bigint, m2 bigint")
    # Copies would make every word of theirs look telling: of examples with a common mark one stays.
    for m in ("m0", "m1", "m2"):
        rest = [c for c in rows.columns if c not in ("label", m)]
        rows = rows.groupBy("label", m).agg(F.min(F.struct(*rest)).alias("first")).select("label", m, "first.*")
    return cut(rows.select("doc_id", "label", "text")), [sizes.get(0, 0), sizes.get(1, 0)]


def _marked(batches: Iterator) -> Iterator:
    """Adds three MinHash values of the word shingles; a text without any is marked by its id."""
    import pyarrow as pa

    for batch in batches:
        marks = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            hashes = shingles(text)
            marks.append([int(x) for x in sketch(hashes)[:3]] if len(hashes) else [-1 - doc_id] * 3)
        cols = list(zip(*marks)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, pa.int64()) for c in cols]],
                                         names=[*batch.schema.names, "m0", "m1", "m2"])


def critical_chi_square(tests: int, level: float = 0.05) -> float:
    """Chi-square (one degree of freedom) that chance exceeds once in ``tests / level`` words."""
    x = 2 * math.log(max(tests, 1) / level)
    return x - math.log(x) - math.log(math.pi / 2)


def choose_words(rows: DataFrame, features: int) -> list[tuple]:
    """(word, document frequency): words over-represented in one class, beyond what chance gives among so many words."""
    n0, n1 = (rows.filter(F.col("label") == y).count() for y in (0, 1))
    freq = cut(rows.select("label", "text").mapInArrow(_document_frequencies, "word string, clean bigint, toxic bigint")
               .groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
               .filter(F.col("clean") + F.col("toxic") > 2))
    a, b = F.col("toxic") + 0.5, F.col("clean") + 0.5
    c, d = F.lit(n1 + 1.0) - a, F.lit(n0 + 1.0) - b
    odds = F.abs(F.log(a * d / (b * c)))
    chi = (a * d - b * c) * (a * d - b * c) * (n0 + n1 + 2.0) / ((a + b) * (c + d) * (a + c) * (b + d))
    best = (freq.withColumn("odds", odds).withColumn("chi", chi)
            .filter((F.col("odds") > math.log(4)) & (F.col("chi") > critical_chi_square(freq.count())))
            .orderBy(F.desc("chi"), "word").limit(features))
    return [(r["word"], r["clean"] + r["toxic"]) for r in best.collect()]


@dataclass
class Index:
    """Block-max inverted index of example vectors, with what turns neighbours into a score."""
    at: dict[str, int]
    idf: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    k: int
    blocks: list = field(default_factory=list)  # per block: word, example within the block, weight
    maxima: np.ndarray | None = None            # block x word
    empty: float = 0.0
    votes: np.ndarray | None = None
    chances: np.ndarray | None = None

    def vector(self, words) -> dict[int, float]:
        """Unit-length TF-IDF weights of the chosen words."""
        counts = Counter(self.at[w] for w in words if w in self.at)
        weights = {i: (1 + math.log(n)) * float(self.idf[i]) for i, n in counts.items()}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        return {i: weights[i] / norm for i in sorted(weights)}

    def nearest(self, vector: dict[int, float], skip: int = -1) -> list[tuple[float, int]]:
        """The k examples of largest cosine above 0, as (cosine, example); exact."""
        words, weights = list(vector), np.array(list(vector.values()))
        bounds = self.maxima[:, words] @ weights
        query = np.zeros(len(self.idf))
        query[words] = weights
        best: list[tuple[float, int]] = []
        for b in np.argsort(-bounds, kind="stable"):
            if bounds[b] <= 0 or len(best) >= self.k and bounds[b] < best[-1][0] - 1e-9:
                break
            word, local, weight = self.blocks[b]
            scores = np.bincount(local, query[word] * weight, BLOCK)
            best += [(float(round(scores[j], 12)), int(b) * BLOCK + int(j)) for j in np.flatnonzero(scores > 0)
                     if b * BLOCK + j != skip]
            best.sort(key=lambda x: (-x[0], self.ids[x[1]]))
            del best[self.k:]
        return best

    def vote(self, neighbours) -> float:
        weights = [s ** 4 / (1.0001 - min(s, 1.0)) for s, _ in neighbours]
        return sum(w for w, (_, e) in zip(weights, neighbours) if self.labels[e]) / max(sum(weights), 1e-300)

    def score(self, words) -> tuple[float, list[int]]:
        vector = self.vector(words)
        near = self.nearest(vector) if vector else []
        if not near:
            return self.empty, []
        return (float(np.interp(self.vote(near), self.votes, self.chances)),
                [int(self.ids[e]) for _, e in near[:3]])


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the weighted least-squares non-decreasing fit, as (x, value) knots."""
    pools: list[list[float]] = []  # low x, high x, weighted sum, weight
    for i in np.argsort(x, kind="stable"):
        pools.append([x[i], x[i], y[i] * w[i], w[i]])
        while len(pools) > 1 and (pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3] or pools[-2][1] == pools[-1][0]):
            top = pools.pop()
            pools[-1][1:] = [top[1], pools[-1][2] + top[2], pools[-1][3] + top[3]]
    return (np.array([v for p in pools for v in p[:2]]), np.array([p[2] / p[3] for p in pools for _ in range(2)]))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = 4000, features: int = 4096,
        k: int = 15) -> Index | None:
    """The index over the examples; None if there are none. ``learn`` is a condition on ``doc_id``."""
    rows, sizes = labelled_sample(docs, labels, learn, per_class)
    chosen = choose_words(rows, features)
    at = {w: i for i, (w, _) in enumerate(chosen)}
    wanted = docs.sparkSession.sparkContext.broadcast(set(at))

    def words_of(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = [[w for w in WORD.findall(t.lower()) if w in wanted.value] for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.string()))],
                                             names=["doc_id", "label", "words"])

    examples = rows.select("doc_id", "label", "text").mapInArrow(
        words_of, "doc_id bigint, label int, words array<string>").collect()  # bounded by per_class
    if not examples:
        return None
    n = len(examples)
    idf = np.log((n + 1.0) / (np.array([f for _, f in chosen], dtype=float) + 1.0)) + 1.0
    index = Index(at, idf, np.empty(0), np.empty(0), k)
    vectors = [(r["doc_id"], r["label"], index.vector(r["words"])) for r in examples]
    share = [sizes[y] / max(1, sum(v[1] == y for v in vectors)) for y in (0, 1)]
    without = [share[y] * sum(v[1] == y and not v[2] for v in vectors) for y in (0, 1)]
    index.empty = (without[1] + 0.5 * sizes[1] / max(sum(sizes), 1)) / (sum(without) + 0.5)
    # Examples with the same strongest word lie together, so that block maxima are tight.
    vectors = sorted((v for v in vectors if v[2]), key=lambda v: (max(v[2], key=v[2].get), v[1], v[0]))
    index.ids, index.labels = np.array([v[0] for v in vectors], dtype=np.int64), np.array([v[1] for v in vectors], dtype=int)
    n_blocks = -(-len(vectors) // BLOCK)
    index.maxima = np.zeros((n_blocks, len(idf)))
    for b in range(n_blocks):
        entries = [(i, j, x) for j, v in enumerate(vectors[b * BLOCK:(b + 1) * BLOCK]) for i, x in v[2].items()]
        word, local, weight = (np.array(c) for c in zip(*entries))
        index.blocks.append((word, local, weight))
        np.maximum.at(index.maxima[b], word, weight)
    votes, truth = [], []
    for e, (_, label, vector) in enumerate(vectors):
        near = index.nearest(vector, skip=e)
        if near:
            votes.append(index.vote(near))
            truth.append(label)
    y = np.array([*truth, 0, 1], dtype=float)
    index.votes, index.chances = isotonic(np.array([*votes, 0.0, 1.0]), y, np.where(y > 0, share[1] or 1.0, share[0] or 1.0))
    return index


def score(docs: DataFrame, index: Index | None, held_out: Column) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence (ids of the nearest examples) for every row."""
    return _scored(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                               F.coalesce(held_out, F.lit(False)).alias("held_out"), whole_text().alias("text")),
                   index, RESULT, keep=2)


def _scored(rows: DataFrame, index: Index | None, schema, keep: int, within: str | None = None) -> DataFrame:
    """Scores after the first ``keep`` columns; the text is the last column, or its field ``within``."""
    shared = rows.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        index = shared.value
        for batch in batches:
            scores, evidence = [], []
            texts = batch.column(batch.num_columns - 1)
            texts = texts if within is None else texts.field(texts.type.get_field_index(within))
            for text in texts:
                text = text.as_py() or ""
                s, e = index.score(WORD.findall(text.lower())) if index else (0.0, [])
                scores.append(min(max(s, 0.0), 1.0))
                evidence.append(e)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(keep)], pa.array(scores, pa.float64()),
                 pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(evidence, pa.list_(pa.int64()))],
                names=[*batch.schema.names[:keep], "score", "predicted", "evidence"])

    return rows.mapInArrow(run, schema)


def clean_documents(docs: DataFrame, index: Index | None) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    rows = packed(docs)  # the text travels once, as a field of its row
    schema = T.StructType([rows.schema["row"], *T.StructType.fromDDL("score double, predicted int, evidence array<bigint>").fields])
    return _scored(rows, index, schema, keep=1, within="text").filter("predicted = 0").select("row.*")
