"""Operator 12: benchmark decontamination by a prefix-filtered set join.

An item is cut into windows of ``window`` consecutive words (a shorter item is one window), and a
window is the set of its shingles of ``shingle`` words. A stretch of a document as long as the
window holds it if it contains at least ``containment`` of these shingles; at 1 it has to
be the very words of the window, in order.

1. Every shingle of the items is counted over all documents; a window's shingles are ordered by
   rarity. To hold k of a window's m shingles a stretch must hold one of its m - k + 1 rarest, so
   only these are joined (at containment 1: the rarest one alone).
2. A match of a prefix shingle fixes where the stretch may begin. Positions before the text's first or
   beyond its last word are left out (positional and length bound).
3. What remains is verified exactly over stretches of the window's length.

The items are the small side: their windows are dealt by a hash over slices of about ``SLICE_BYTES``
and each slice is an index of that size, broadcast, against which all documents are read. So memory
is bounded at any number of items, and no document or common passage is ever gathered by key; with one
slice the documents are not shuffled at all. Beyond it, the hits of the slices are merged by text.

Words: A-Z are lower-cased, then maximal runs of 0-9, a-z and all characters beyond ASCII.
Cases: null and empty texts have no words, and so no hits or windows; null and repeated document ids
stay rows of their own; items of equal id are one item; an item without an id marks words but is not
listed; repeated items change nothing; empty tables give no hits or no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, whole_text

WINDOW = 10
SHINGLE = 3
SLICE_BYTES = 16 << 20
BATCH_WORDS = 1 << 20   # documents are looked at together up to so many words
CANDIDATES = 1 << 18    # and so many candidate stretches are verified together
CHUNK = 4 << 20         # bytes of a text split into words at once
SPANS = "spans array<struct<start: bigint, end: bigint>>"
# Bytes of words stay, A-Z in lower case; all others part words. Bytes of characters beyond ASCII are 128 and up.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def word_numbers(text: bytes, numbers: dict[bytes, int]) -> np.ndarray:
    """The number of each word of a text, 0 for words of no item."""
    data, parts, at = text.translate(WORD_BYTES), [], 0
    while at < len(data):
        to = data.find(b" ", at + CHUNK)
        to = len(data) if to < 0 else to
        words = data[at:to].split()
        parts.append(np.fromiter(map(numbers.get, words, repeat(0)), np.int64, len(words)))
        at = to
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)


def shingle_codes(numbers: np.ndarray, size: int) -> np.ndarray:
    """A code for the shingle at each position along the last axis; 0 where a word of it is unknown."""
    n = numbers.shape[-1] - size + 1
    if n <= 0:
        return np.zeros((*numbers.shape[:-1], 0), dtype=np.uint64)
    code, known = np.zeros((*numbers.shape[:-1], n), dtype=np.uint64), np.ones((*numbers.shape[:-1], n), dtype=bool)
    for i in range(size):
        part = numbers[..., i:i + n]
        code = (code ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        code ^= code >> np.uint64(29)
        known &= part > 0
    return np.where(known, code | np.uint64(1), np.uint64(0))


class WindowIndex:
    """The windows of one slice, by length, with the prefix shingles that lead to them."""

    def __init__(self, pairs: list[tuple], shingle: int, containment: float):
        windows = sorted({w for w, _ in pairs})
        self.items = sorted({i for _, i in pairs if i is not None})
        at, item_at = {w: k for k, w in enumerate(windows)}, {i: k for k, i in enumerate(self.items)}
        held = sorted({(at[w], item_at[i]) for w, i in pairs if i is not None})
        self.item_of = np.array([i for _, i in held], dtype=np.int64)
        self.items_from = np.searchsorted(np.array([w for w, _ in held], dtype=np.int64), np.arange(len(windows) + 1))
        words = [w.encode().split(b" ") for w in windows]
        self.numbers = {w: k for k, w in enumerate(sorted({x for ws in words for x in ws}), 1)}
        self.containment = containment
        self.groups = []  # per length of windows: length, shingle size, window ids, word numbers, shingle codes
        for length in sorted({len(ws) for ws in words}):
            ids = np.array([k for k, ws in enumerate(words) if len(ws) == length], dtype=np.int64)
            matrix = np.array([[self.numbers[x] for x in words[k]] for k in ids], dtype=np.int64)
            size = min(shingle, length)
            self.groups.append((length, size, ids, matrix, shingle_codes(matrix, size)))
        self.codes = np.unique(np.concatenate([g[4].ravel() for g in self.groups]))
        self.sizes = sorted({g[1] for g in self.groups})
        self.prefixes: list = []

    def order_by_rarity(self, counts: np.ndarray) -> None:
        """Keep, of every window, the shingles that one of any sufficient number must be among."""
        for length, size, ids, matrix, codes in self.groups:
            rarity = counts[np.searchsorted(self.codes, codes)]
            entries = []
            for row in range(len(ids)):
                order = np.lexsort((codes[row], rarity[row]))
                _, first = np.unique(codes[row][order], return_index=True)
                order = order[np.sort(first)]  # each shingle once, rarest first
                need = max(1, math.ceil(self.containment * len(order) - 1e-9))
                entries += [(codes[row][p], row, p, need) for p in order[:len(order) - need + 1]]
            entries.sort()
            code = np.array([e[0] for e in entries], dtype=np.uint64)
            first = np.zeros(1 << 16, dtype=bool)  # most codes of a text are turned away here
            first[(code >> np.uint64(48)).astype(np.int64)] = True
            self.prefixes.append((code, first, *[np.array([e[i] for e in entries], dtype=np.int64) for i in (1, 2, 3)]))

    def occurrences(self, numbers: np.ndarray) -> np.ndarray:
        """How often each shingle of ``codes`` is in the texts."""
        total = np.zeros(len(self.codes), dtype=np.int64)
        for size in self.sizes:
            codes = shingle_codes(numbers, size)
            codes = codes[codes > 0]
            at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
            total += np.bincount(at[self.codes[at] == codes], minlength=len(self.codes))
        return total

    def matches(self, numbers: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, window) of the stretches that hold a window. The text around position p goes from low[p] to high[p]."""
        out = []
        for (length, size, ids, matrix, window_codes), (code, first, row, offset, need) in zip(self.groups, self.prefixes):
            codes = shingle_codes(numbers, size)
            at = np.flatnonzero(first[(codes >> np.uint64(48)).astype(np.int64)] & (codes > 0))
            a, b = np.searchsorted(code, codes[at]), np.searchsorted(code, codes[at], "right")
            at, a, n = at[b > a], a[b > a], (b - a)[b > a]
            if self.containment < 1:  # the shingle may be anywhere in the stretch
                free = length - size + 1
                at, a, n = np.repeat(at, free), np.repeat(a, free), np.repeat(n, free)
                shift = np.tile(np.arange(free), len(at) // free)
            upto = np.concatenate([[0], np.cumsum(n)])
            begin = 0
            while begin < len(at):
                end = max(begin + 1, int(np.searchsorted(upto, upto[begin] + CANDIDATES, "right")) - 1)
                many = n[begin:end]
                entry = np.repeat(a[begin:end] - (upto[begin:end] - upto[begin]), many) + np.arange(many.sum())
                position = np.repeat(at[begin:end], many)
                start = position - (offset[entry] if self.containment >= 1 else np.repeat(shift[begin:end], many))
                inside = (start >= low[position]) & (start + length <= high[position])
                start, entry = start[inside], entry[inside]
                if self.containment >= 1:
                    same = (numbers[start[:, None] + np.arange(length)] == matrix[row[entry]]).all(axis=1)
                else:
                    same = self._shared(codes[start[:, None] + np.arange(length - size + 1)], window_codes[row[entry]]) >= need[entry]
                out.append((start[same], start[same] + length, ids[row[entry[same]]]))
                begin = end
        if not out:
            return (np.zeros(0, dtype=np.int64),) * 3
        return tuple(np.concatenate(c) for c in zip(*out))

    @staticmethod
    def _shared(stretch: np.ndarray, window: np.ndarray) -> np.ndarray:
        """Per row, how many distinct codes of the window the stretch has."""
        shared = np.zeros(len(stretch), dtype=np.int64)
        for p in range(window.shape[1]):
            new = ~(window[:, :p] == window[:, p:p + 1]).any(axis=1)
            shared += new & (stretch == window[:, p:p + 1]).any(axis=1)
        return shared


def _groups(texts: list[bytes], numbers: dict) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """The word numbers of consecutive texts, alone and laid out together with a 0 after each."""
    held, total = [], 0
    for text in texts:
        held.append(word_numbers(text or b"", numbers))
        total += len(held[-1]) + 1
        if total >= BATCH_WORDS:
            yield held, np.concatenate([x for h in held for x in (h, [0])])
            held, total = [], 0
    if held:
        yield held, np.concatenate([x for h in held for x in (h, [0])])


def _item_windows(items: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """Distinct (window, item): a window's words joined by a space, the item's id as text."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for item, data in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                words = words_of(data)
                n = len(words) - window + 1 if len(words) > window else min(1, len(words))
                for low in range(0, n, 4096):
                    found = [b" ".join(words[i:i + window]) for i in range(low, min(n, low + 4096))]
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()).cast(pa.string()), pa.array([item] * len(found), pa.string())],
                                                     names=["window", "item"])

    rows = items.select(F.col(item_id).cast("string").alias("item"), whole_text(text).alias("text"))
    return cut(rows.mapInArrow(run, "window string, item string").distinct())


def _rarity(texts: DataFrame, index: WindowIndex) -> np.ndarray:
    """Occurrences of each shingle of a slice over all texts."""
    shared = texts.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        index, total = shared.value, None
        for batch in batches:
            for _, numbers in _groups(batch.column(0).cast(pa.binary()).to_pylist(), index.numbers):
                found = index.occurrences(numbers)
                total = found if total is None else total + found
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["at", "n"])

    counts = np.zeros(len(index.codes), dtype=np.int64)
    for r in texts.mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect():  # one row a shingle of the slice
        counts[r["at"]] = r["n"]
    shared.unpersist()
    return counts


def _matched(rows: DataFrame, index: WindowIndex) -> DataFrame:
    """n_words, spans and items behind the columns of ``rows``, whose last one, the text, goes."""
    shared, keep = rows.sparkSession.sparkContext.broadcast(index), len(rows.columns) - 1

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        index = shared.value
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            low = 0
            for texts, numbers in _groups(batch.column(keep).cast(pa.binary()).to_pylist(), index.numbers):
                lengths = np.array([len(t) for t in texts], dtype=np.int64)
                first = np.concatenate([[0], np.cumsum(lengths + 1)])
                text_of = np.repeat(np.arange(len(texts)), lengths + 1)
                start, end, window = index.matches(numbers, first[text_of], (first[1:] - 1)[text_of])
                edge = np.zeros(len(numbers) + 1, dtype=np.int64)
                np.add.at(edge, start, 1)
                np.add.at(edge, end, -1)
                covered = np.concatenate([[0], (np.cumsum(edge) > 0).astype(np.int8)])
                begins, ends = np.flatnonzero(np.diff(covered) > 0), np.flatnonzero(np.diff(covered) < 0)
                spans: list = [[] for _ in texts]
                for s, e, t in zip(begins.tolist(), ends.tolist(), text_of[begins].tolist()):
                    spans[t].append({"start": s - int(first[t]), "end": e - int(first[t])})
                n = np.diff(index.items_from)[window]
                at = np.repeat(index.items_from[window] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                pairs = np.unique(np.repeat(text_of[start], n) * max(1, len(index.items)) + index.item_of[at])
                items: list = [[] for _ in texts]
                for pair in pairs.tolist():
                    items[pair // len(index.items)].append(index.items[pair % len(index.items)])
                part = batch.slice(low, len(texts))
                low += len(texts)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:keep], pa.array(lengths), pa.array(spans, span), pa.array(items, pa.list_(pa.string()))],
                    names=[*batch.schema.names[:keep], "n_words", "spans", "items"])

    kept = rows.schema.fields[:keep]
    return rows.mapInArrow(run, T.StructType([*kept, *T.StructType.fromDDL(f"n_words bigint, {SPANS}, items array<string>").fields]))


def _merged(rows: DataFrame) -> DataFrame:
    """Columns spans and items with those of all slices (``more``, ``listed``) put together."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            spans, items = [], []
            for own, more, mine, listed in zip(*[batch.column(c).to_pylist() for c in ("spans", "more", "items", "listed")]):
                out: list = []
                for s in sorted([*own, *(more or [])], key=lambda s: s["start"]):
                    if out and s["start"] <= out[-1]["end"]:
                        out[-1]["end"] = max(out[-1]["end"], s["end"])
                    else:
                        out.append(dict(s))
                spans.append(out)
                items.append(sorted({*mine, *(listed or [])}))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, batch.column(2).type), pa.array(items, pa.list_(pa.string()))],
                                             names=["doc_id", "n_words", "spans", "items"])

    kind = rows.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), *T.StructType.fromDDL(f"n_words bigint, {SPANS}, items array<string>").fields])
    return rows.select("doc_id", "n_words", "spans", "items", "more", "listed").mapInArrow(run, schema)


def find(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, containment: float = 1.0,
         item_id: str = "item_id", item_text: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """doc_id, n_words, spans (word ranges held by items, merged, end exclusive), items (ids as text, sorted) for every row."""
    windows = _item_windows(items, item_id, item_text, window)
    size = windows.agg(F.sum(F.octet_length("window"))).first()[0] or 0
    slices = -(-size // slice_bytes)
    texts = docs.select(F.col("doc_id"), F.md5(whole_text()).alias("key"), whole_text().alias("text"))
    if not slices:
        n = F.size(F.regexp_extract_all("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0)))
        return texts.select("doc_id", n.cast("bigint").alias("n_words"), F.expr(f"CAST(array() AS {SPANS.split(' ', 1)[1]})").alias("spans"),
                            F.expr("CAST(array() AS array<string>)").alias("items"))
    found = None
    for part in range(slices):
        mine = windows if slices == 1 else windows.filter(F.pmod(F.xxhash64("window", "item"), F.lit(slices)) == part)
        pairs = [(r["window"], r["item"]) for r in mine.collect()]  # bounded by the bytes of a slice
        if not pairs:
            continue
        index = WindowIndex(pairs, shingle, containment)
        index.order_by_rarity(_rarity(texts.select("text"), index))
        if slices == 1:
            return _matched(texts.drop("key"), index)
        if found is None:
            found, more = _matched(texts.select("doc_id", "key", "text"), index), None
        else:
            hits = _matched(texts.select("key", "text"), index).filter("size(spans) > 0").dropDuplicates(["key"])
            more = hits if more is None else more.unionByName(hits)
    if more is None:
        return found.select("doc_id", "n_words", "spans", "items")
    # Stored first, so that the join's large partitions (a text of very many copies) can be split.
    more = cut(more.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("more"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("listed")))
    return _merged(found.join(more, "key", "left"))


def digests(found: DataFrame) -> DataFrame:
    """The counts and the digest of the item ids per document, from what ``find`` returns."""
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
