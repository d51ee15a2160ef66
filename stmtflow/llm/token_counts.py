"""Operator 1: token counts by a linear longest-match automaton.

A vocabulary of word pieces is a trie. Greedy longest-match splitting of a word needs no
backtracking when every trie node knows, for the case that the next character has no
edge, which pieces are certain by then (only their number is kept: the popped count) and
at which node the rest of the word continues (the failure link). Each character is read
once; no piece is built. Pieces that start a word and pieces that continue one have a
root each; after the first popped piece a word is below the continuation root.

Words are ``[^\\x20\\x09-\\x0D]+`` over UTF-8 bytes. A word that the vocabulary cannot spell
counts as one unknown token.

Cases: null text has no words; null ids and repeated rows stay rows of their own; an empty
table gives an empty result; very long words take time in proportion to their length;
other columns are ignored.
"""

from __future__ import annotations

import json
import hashlib
import re
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_PATTERN, whole_text

RESULT = "doc_id bigint, n_words bigint, n_tokens bigint, n_unknown bigint"
CACHE_WORDS = 200_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: character -> byte.

    Printable Latin-1 bytes stand for themselves; the others, in order, for 256, 257, ...
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def byte_vocabulary(path: str) -> tuple[list[bytes], list[bytes]]:
    """(starting, continuing) pieces of a byte-level tokenizer file; a leading space marks a start."""
    with open(path, encoding="utf-8") as f:
        entries = json.load(f)["model"]["vocab"]
    alphabet = byte_alphabet()
    pieces = [bytes(alphabet[c] for c in p) for p in entries if all(c in alphabet for c in p)]
    return [p for p in pieces if p[:1] == b" "], [p for p in pieces if p[:1] != b" "]


class LongestMatch:
    """Greedy longest-match piece counts in one pass over the bytes of a word."""

    def __init__(self, starting: Iterable[bytes], continuing: Iterable[bytes]):
        self.edges: list[dict[int, int]] = [{}, {}]  # 0: start of a word, 1: inside a word
        ends: list[bool] = [False, False]
        for root, pieces in ((0, starting), (1, continuing)):
            for piece in pieces:
                node = root
                for byte in piece:
                    nxt = self.edges[node].get(byte)
                    if nxt is None:
                        nxt = self.edges[node][byte] = len(self.edges)
                        self.edges.append({})
                        ends.append(False)
                    node = nxt
                if node > 1:
                    ends[node] = True
        # fail: -1 where the word cannot be spelled from here; popped: pieces certain by then.
        self.fail, self.popped = [-1] * len(ends), [0] * len(ends)
        level = [0, 1]
        while level:
            below = []
            for parent in level:
                for byte, node in self.edges[parent].items():
                    below.append(node)
                    if ends[node]:
                        self.fail[node], self.popped[node] = 1, 1
                        continue
                    at, count = self.fail[parent], self.popped[parent]
                    while at >= 0 and byte not in self.edges[at]:
                        count += self.popped[at]
                        at = self.fail[at]
                    if at >= 0:
                        self.fail[node], self.popped[node] = self.edges[at][byte], count
            level = below

    def count(self, word: bytes) -> int:
        """Number of pieces; 0 if the word cannot be spelled."""
        edges, fail, popped = self.edges, self.fail, self.popped
        node = total = 0
        for byte in word:
            nxt = edges[node].get(byte)
            while nxt is None:
                total += popped[node]
                node = fail[node]
                if node < 0:
                    return 0
                nxt = edges[node].get(byte)
            node = nxt
        while node > 1:
            total += popped[node]
            node = fail[node]
        return total if node == 1 else 0


_built: dict = {}


def token_counts(docs: DataFrame, starting: list[bytes], continuing: list[bytes], mark: bytes = b" ") -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown for every row of ``docs``.

    ``mark`` is put before each word (the space of byte-level vocabularies). The vocabulary goes
    to the tasks as a broadcast of its own size, fixed by the tokenizer and not by the data; a
    worker builds the automaton once.
    """
    pieces = docs.sparkSession.sparkContext.broadcast((starting, continuing))
    key = hashlib.sha256(repr((starting, continuing)).encode()).hexdigest()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        if key not in _built:
            _built.clear()
            _built[key] = LongestMatch(*pieces.value)
        count, words_of, known = _built[key].count, re.compile(WORD_PATTERN).findall, {}
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                tokens = unknown = 0
                for w in words:
                    n = known.get(w)
                    if n is None:
                        n = count(mark + w.encode("utf-8", "replace"))
                        if len(known) >= CACHE_WORDS:
                            known.clear()
                        if len(w) < 64:
                            known[w] = n
                    tokens += n
                    unknown += not n
                out.append((len(words), tokens + unknown, unknown))
            cols = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in cols]],
                                             names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text")).mapInArrow(run, RESULT)
