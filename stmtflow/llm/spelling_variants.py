"""Operator 13: spelling variants by dynamic programming over the sorted vocabulary.

Two words are near if one edit (a code point inserted, deleted or replaced) makes one of the
other. A word's form is its most frequent near word if that is ``ratio`` times as frequent.

1. Words are counted with partial sums per task, so a common word costs one row a task.
2. Two near words of n or more code points share their first n // 2 ones, or else their last n - n // 2 ones:
   pairs of the first kind are found in the sorted list of words, others in that of the
   words written backwards. Each list is cut into ranges of about ``RANGE_WORDS`` words
   at words chosen by a hash; words are distinct, so no range is hot. A word is sent to the other ranges that may hold
   a near word: ranges of ranges whose shared prefix is more than one edit away are skipped together.
3. A range is scanned against its words and those sent to it, all at once: the longest common prefixes of
   neighbours (LCP) cut the list into stretches of words with the same first d code points.
   Row d of the edit matrix depends on these alone, so each stretch has one row for all its words, three cells
   wide (the band of one edit), computed from the row of the stretch around it. Stretches whose cells all exceed
   one edit are skipped with all their words.

Cases: null and empty texts have no words; a null id is written as no characters when damage is drawn; repeated rows
count again; ties go to the word first in code-point order; an empty table, or one without frequent words, gives no
rows; other columns are ignored. Words may be of any length.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, whole_text

MIN_LENGTH = 7
MIN_COUNT = 2
RATIO = 10
DAMAGE_EVERY = 31
RANGE_WORDS = 2048      # mean size of a range
MOST_RANGES = 100_000   # of a list; beyond, ranges grow: bounds what every task gets
QUERIES = 4096          # words looked up together in a range
TALLY = 200_000         # distinct words a task holds before it passes their counts on
LONG_TEXT = 1 << 22
FAR = 2                 # stands for all distances beyond one edit
LAST = "\U0010ffff"
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def lowered(run: str) -> str:
    """A-Z in lower case; other letters as they are."""
    return run.lower() if run.isascii() else run.translate(LOWER)


def damaged(run: str, seed: int, every: int) -> str:
    """The run, or, if ``every`` divides the crc32 that goes on from ``seed``, without one of its code points."""
    h = zlib.crc32(run.encode("utf-8", "replace"), seed)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, damage_every: int = 0) -> DataFrame:
    """(word, n): the words of at least ``min_length`` code points with at least ``min_count`` occurrences in all texts.

    A word is a maximal run of letters (A-Z, a-z, U+00C0 to U+00FF) with A-Z in lower case. With ``damage_every``, runs
    whose crc32 (with the document's id) it divides lose one code point: spelling mistakes that are known beforehand.
    """
    letters = re.compile("[A-Za-zÀ-ÿ]{%d,}" % min_length)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

        total: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if len(text) < LONG_TEXT:
                    runs = Counter(letters.findall(text))
                else:
                    runs = Counter(m.group() for m in letters.finditer(text))
                seed = zlib.crc32(f"{doc_id}:".encode())
                for word, n in runs.items():
                    word = lowered(word)
                    if damage_every:
                        word = damaged(word, seed, damage_every)
                        if len(word) < min_length:
                            continue
                    total[word] += n
                if len(total) >= TALLY:
                    yield rows()
                    total.clear()
        if total:
            yield rows()

    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), whole_text().alias("text"))
    return texts.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def shared_prefix(a: str, b: str) -> str:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return a[:n]
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid)
    return a[:low]


def may_start(prefix: str, word: str) -> bool:
    """Whether a word within one edit of ``word`` can begin with ``prefix``."""
    if word.startswith(prefix):
        return True
    a = len(shared_prefix(prefix, word))
    rest = prefix[a + 1:]  # after a replaced one, one more in the other word, or one less there
    return word.startswith(rest, a + 1) or word.startswith(rest, a) or word.startswith(prefix[a:], a + 1)


class Ranges:
    """A sorted list cut at ``bounds``: range i holds what is at or after bound i - 1 and before bound i."""

    def __init__(self, bounds: list[str]):
        self.bounds, self.shared = bounds, {}

    def of(self, word: str) -> int:
        return bisect_right(self.bounds, word)

    def prefix(self, low: int, high: int) -> str:
        """What all words of the ranges ``low`` to ``high`` begin with, as far as the bounds show."""
        found = self.shared.get((low, high))
        if found is None:
            outer = low == 0 or high == len(self.bounds)
            found = self.shared[low, high] = "" if outer else shared_prefix(self.bounds[low - 1], self.bounds[high])
        return found

    def near(self, word: str, exact: int) -> list[int]:
        """Ranges that may hold near words of ``word`` with the same first ``exact`` code points."""
        first, last = self.of(word[:exact]), bisect_left(self.bounds, word[:exact] + LAST)
        if first == last:
            return [first]
        out, stack = [], [(0, len(self.bounds))]
        while stack:
            low, high = stack.pop()
            if high < first or low > last or not may_start(self.prefix(low, high), word):
                continue
            if low == high:
                out.append(low)
            else:
                mid = (low + high) // 2
                stack += [(low, mid), (mid + 1, high)]
        return out


class SortedList:
    """A sorted list of distinct words as stretches of equal first code points, by their number."""

    def __init__(self, words: list[str]):
        self.lengths = np.array([len(w) for w in words], dtype=np.int64)
        self.codes = code_points(words)
        starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        lcp = np.zeros(len(words), dtype=np.int64)
        pairs, d = np.arange(1, len(words)), 0
        while len(pairs):
            pairs = pairs[(self.lengths[pairs] > d) & (self.lengths[pairs - 1] > d)]
            pairs = pairs[self.codes[starts[pairs] + d] == self.codes[starts[pairs - 1] + d]]
            d += 1
            lcp[pairs] = d
        lcp[0] = -1
        # Per depth: the first word of each stretch, and of the stretches one deeper their parents' number and
        # code point as one sorted key, and where each parent's begin.
        self.levels, first, alive = [], np.zeros(1, dtype=np.int64), np.arange(len(words))
        for d in range(int(self.lengths.max())):
            alive = alive[self.lengths[alive] > d]
            deeper = alive[lcp[alive] <= d]
            parent = np.searchsorted(first, deeper, "right") - 1
            key = parent << 21 | self.codes[starts[deeper] + d]
            self.levels.append((first, key, np.searchsorted(parent, np.arange(len(first) + 1))))
            first = deeper
        self.levels.append((first, np.zeros(0, dtype=np.int64), np.zeros(len(first) + 1, dtype=np.int64)))

    def one_edit(self, words: list[str], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index in the list, index in ``words``) of pairs one edit apart whose first ``exact`` code points agree."""
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        codes = np.append(code_points(words), 0)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        node, query = np.zeros(len(words), dtype=np.int64), np.arange(len(words))
        # Cells d - 1, d and d + 1 of row d.
        row = np.tile(np.array([[FAR], [0], [1]], dtype=np.int8), (1, len(words)))
        found = []

        def letter(query: np.ndarray, at: int) -> np.ndarray:
            return codes[np.minimum(starts[query] + at, len(codes) - 1)]

        for d, (first, key, children) in enumerate(self.levels):
            cell = lengths[query] - d + 1
            fixed = exact[query] > d  # code points still have to agree
            ends = np.flatnonzero((self.lengths[first[node]] == d) & (cell >= 0) & (cell <= 2) & ~fixed)
            hit = ends[row[cell[ends], ends] == 1]
            found.append((first[node[hit]], query[hit]))
            # Down to the stretches within: one, while code points have to agree, then all.
            wanted = node[fixed] << 21 | letter(query[fixed], d)
            at = np.searchsorted(key, wanted)
            there = at < len(key)
            there[there] = key[at[there]] == wanted[there]
            held = np.flatnonzero(~fixed)
            many = children[node[held] + 1] - children[node[held]]
            source = np.concatenate([np.flatnonzero(fixed)[there], np.repeat(held, many)])
            below = np.concatenate([at[there], np.repeat(children[node[held]] - np.cumsum(many) + many, many) + np.arange(many.sum())])
            if not len(below):
                break
            query, old, c = query[source], row[:, source], key[below] & 0x1FFFFF
            room = lengths[query] - d - 1  # cell d + 1 of the new row is within the word if this is not negative
            left = np.minimum(old[0] + (c != letter(query, d - 1)) if d else FAR, old[1] + 1)
            left = np.where(room >= -1, np.minimum(left, FAR), FAR)
            middle = np.minimum(np.minimum(old[1] + (c != letter(query, d)), old[2] + 1), left + 1)
            middle = np.where(room >= 0, np.minimum(middle, FAR), FAR)
            right = np.minimum(old[2] + (c != letter(query, d + 1)), middle + 1)
            right = np.where(room >= 1, np.minimum(right, FAR), FAR)
            row = np.stack([left, middle, right]).astype(np.int8)
            stay = np.flatnonzero(row.min(axis=0) < FAR)
            node, query, row = below[stay], query[stay], row[:, stay]
        words_at, queries = zip(*found)
        return np.concatenate(words_at), np.concatenate(queries)


def code_points(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)


def exact_length(n: int, min_length: int, backwards: bool) -> int:
    """First code points that a word of n ones shares with its near words found in a list, at least."""
    n = max(n - 1, min_length)
    return n - n // 2 if backwards else n // 2


def _belongs(a: str, b: str, backwards: bool) -> bool:
    """Whether a near pair is the list's to report (the other list may see it too)."""
    half = min(len(a), len(b)) // 2
    if backwards:
        return a[:-half - 1:-1] != b[:-half - 1:-1]
    return a[:half] == b[:half]


class RangeScan:
    """One range: its own words, and those of others that ask it."""

    def __init__(self, backwards: bool, min_length: int):
        self.backwards, self.min_length = backwards, min_length
        self.own: list[tuple[str, int]] = []
        self.asking: list[tuple[str, int]] = []
        self.listed: SortedList | None = None

    def answers(self) -> list[tuple]:
        """(word, n, n_near, near, near_n): first for all own words, afterwards for words asking that are near to some."""
        whole, asking = self.listed is None, self.asking
        if whole:
            self.listed, asking = SortedList([k for k, _ in self.own]) if self.own else None, self.own
        out, backwards = [], self.backwards
        for low in range(0, len(asking) if self.listed else 0, QUERIES):
            part = asking[low:low + QUERIES]
            exact = np.array([exact_length(len(k), self.min_length, backwards) for k, _ in part], dtype=np.int64)
            n_near, best = [0] * len(part), [None] * len(part)
            for w, q in zip(*[x.tolist() for x in self.listed.one_edit([k for k, _ in part], exact)]):
                key, n = self.own[w]
                if _belongs(key, part[q][0], backwards):
                    n_near[q] += 1
                    new = (-n, key[::-1] if backwards else key)
                    if best[q] is None or new < best[q]:
                        best[q] = new
            out += [(k[::-1] if backwards else k, n, m, b and b[1], b and -b[0]) for (k, n), m, b in zip(part, n_near, best)
                    if m or whole and not backwards]
        if not whole:
            self.asking.clear()
        return out


def near_words(words: DataFrame, min_length: int = MIN_LENGTH, range_words: int = RANGE_WORDS, most_ranges: int = MOST_RANGES) -> DataFrame:
    """(word, n, n_near, near, near_n) for every row (word, n): its number of near words and the most frequent one."""
    spark = words.sparkSession
    lists = words.select("n", F.explode(F.array(
        F.struct(F.lit(False).alias("backwards"), F.col("word").alias("key")),
        F.struct(F.lit(True).alias("backwards"), F.reverse("word").alias("key")))).alias("s")).select("s.backwards", "s.key", "n")
    size = max(range_words, -(-words.count() // most_ranges))
    chosen = lists.filter(F.pmod(F.xxhash64("key", "backwards"), F.lit(size)) == 0).select("backwards", "key").collect()  # about most_ranges a list at most
    ranges = spark.sparkContext.broadcast({b: sorted(r["key"] for r in chosen if r["backwards"] == b) for b in (False, True)})

    def sent(batches: Iterator) -> Iterator:
        """Each word to its own range (asks false) and to others that may hold near words (asks true)."""
        import pyarrow as pa

        cuts = {b: Ranges(bounds) for b, bounds in ranges.value.items()}
        for batch in batches:
            out = []
            for backwards, key, n in zip(*[c.to_pylist() for c in batch.columns]):
                own = cuts[backwards].of(key)
                out.append((backwards, own, False, key, n))
                out += [(backwards, r, True, key, n) for r in cuts[backwards].near(key, exact_length(len(key), min_length, backwards)) if r != own]
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.bool_(), pa.int64(), pa.bool_(), pa.string(), pa.int64()))],
                                             names=["backwards", "range", "asks", "key", "n"])

    def scanned(batches: Iterator) -> Iterator:
        """Rows sorted by range, its own words first, then those that only ask."""
        import pyarrow as pa

        def record(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows)) or [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()))],
                                              names=["word", "n", "n_near", "near", "near_n"])

        at, scan = None, None
        for batch in batches:
            out: list[tuple] = []
            for backwards, number, asks, key, n in zip(*[c.to_pylist() for c in batch.columns]):
                if (backwards, number) != at:
                    out += scan.answers() if scan else []
                    at, scan = (backwards, number), RangeScan(backwards, min_length)
                if asks and scan.listed is None:
                    out += scan.answers()
                (scan.asking if asks else scan.own).append((key, n))
            if scan and scan.listed:
                out += scan.answers()
            yield record(out)
        if scan:
            yield record(scan.answers())

    dealt = lists.mapInArrow(sent, "backwards boolean, range bigint, asks boolean, key string, n bigint")
    dealt = dealt.repartition("backwards", "range").sortWithinPartitions("backwards", "range", "asks", "key")
    found = dealt.mapInArrow(scanned, "word string, n bigint, n_near bigint, near string, near_n bigint")
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))))
    return (found.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best"))
            .select("word", "n", "n_near", "best.near", (-F.col("best.less")).alias("near_n")))


def variants(words: DataFrame, min_length: int = MIN_LENGTH, ratio: int = RATIO, **sizes: int) -> DataFrame:
    """word, form, root, n, n_near, form_n for every row (word, n) of a vocabulary of distinct words."""
    words = cut(words)
    found = near_words(words, min_length, **sizes)
    has = F.col("near_n") >= ratio * F.col("n")
    found = cut(found.select("word", "n", "n_near", F.when(has, F.col("near")).alias("form"), F.when(has, F.col("near_n")).alias("form_n")))
    forms = found.filter("form IS NOT NULL").select(F.col("word").alias("of"), F.col("form").alias("next"))
    least, most = found.agg(F.min("n"), F.max("n")).first()
    roots = found.filter("form IS NOT NULL").select(F.col("word").alias("from"), F.col("form").alias("root"))
    # A form is ``ratio`` times as frequent, which bounds the number of steps (at ratio 1 or less there may be cycles).
    while ratio > 1 and least is not None and least * ratio ** 2 <= most:
        roots = roots.join(forms, F.col("root") == F.col("of"), "left").select("from", F.coalesce("next", "root").alias("root"))
        least *= ratio
    return found.join(roots, F.col("word") == F.col("from"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variant_groups(docs: DataFrame, damage_every: int = DAMAGE_EVERY) -> DataFrame:
    """``variants`` of the words of all texts."""
    return variants(word_counts(docs, damage_every=damage_every))
