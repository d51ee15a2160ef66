"""Operator 6: pack documents into training sequences by lexical retrieval.

A document is its token ids and one end id. Full windows at its start are sequences of
their own; what is left, less than a window, is a fragment to be packed with others. The
fragments are dealt over shards by content, as many as the tokens ask for: the BM25 weights of a
fragment, projected at random to ``DIMENSIONS`` numbers, lead it down a tree of two-means
splits, learned from bounded samples and grown until its leaves are smaller than a shard. Leaves
next to each other share a shard; one that does not separate (copies) is spread over several by a
hash. So most near neighbours of a fragment are in its shard, but not all: a seed does not ask the
other shards (README gives the share found). A shard holds a BM25 inverted index of its fragments (terms are token ids, document frequencies are those
of the whole corpus). The longest unused fragment seeds a window and asks with all of its terms; its
neighbours that are still unused fill it in order of score, ``NEIGHBOURS`` at a time until it is full: of
each lot those that fit go in whole, then the first that does not is cut at the end of the
window, and its rest stays in the index. So windows are full; the last fragments of a shard, less than a window, are laid out in
sequences whose lengths are powers of two, which need no padding.

Cases: null text is an empty document (its end id alone); null ids and repeated rows are
packed like any other row; an empty table gives an empty result; a very long document is
mostly windows of its own; equal scores go to the fragment first in hash order; other
columns are ignored. Sequence ids are unique, not dense.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, released, trimmed, whole_text
from .token_counts import byte_alphabet

WINDOW = 1024
END_ID = 0
SHARD_TOKENS = 2_000_000
NEIGHBOURS = 32    # looked at together for those that fit; the next ones follow while there is room
DENSE_TERM = 8     # a term that one fragment in so many holds has a row of all fragments as its postings
REBUILT = 8        # one in so many fragments of a shard's index is used up when the index is built again
K1, B = 1.2, 0.75
DIMENSIONS = 64
SAMPLE = 100_000   # fragments from which the tree grows in one round
LEAF_SAMPLE = 512  # and at least so many of each leaf that is split in it
LEAST_SAMPLE = 32  # a part of fewer sampled ones is not split further in that round
CACHE_CHUNKS = 300_000  # at most so many before a group is encoded, some 6 MB per 100,000
CACHE_BYTES = 64        # longer ones are not kept
KEPT_CHUNKS = 150_000   # and so many from one task of a worker to its next
GROUP_BYTES = 3 << 20   # of text, whose chunks are made distinct together
GROUP_IDS = 100_000     # written together
LEARNED = 32_000        # chunks at once
CALL_CHUNKS = 64        # in one string for the model,
CALL_PIECES = 32        # and so many strings in one call
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # punctuation of ASCII without the apostrophe, which begins pre-tokens of its own
PLAIN = r"\A\n?\pL+[!-&(-/:-@\[-`{-~]*\z"  # letters and MARKS
BREAKS = r"\x09\x0b-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"  # white space but \n
UNEVEN = rf"[{BREAKS}\n][{BREAKS}\n]|\A[{BREAKS}\n]|[{BREAKS}]\z"  # texts for the tokenizer as they are
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
PLACED = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, ids binary, key bigint, leaf bigint"

_tokenizers: dict = {}
_directions: dict = {}


def packed_ids(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit numbers."""
    return struct.pack(f"<{len(ids)}I", *ids)


def spans(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All positions of the spans, one after the other."""
    before = np.cumsum(count) - count
    return np.repeat(start - before, count) + np.arange(int(count.sum()))


def separable(vocabulary: dict[str, int]) -> bool:
    """Whether no token goes over the end of a chunk, nor from a letter or a line break to one of ``MARKS``."""
    alphabet = byte_alphabet()
    for token in vocabulary:
        if not all(c in alphabet for c in token):
            continue
        data = bytes(alphabet[c] for c in token)
        try:
            text = data.decode("utf-8")
        except UnicodeDecodeError:  # parts of characters, which may be those of a letter
            if any(b < 128 and not chr(b).isalpha() for b in data[1:]) or data[:1] == b"\n":
                return False
            continue
        for before, after in zip(text, text[1:]):
            if after in " \n" and not before.isspace() or before == "\n" and not after.isspace() or before.isalpha() and after in MARKS:
                return False
    return True


class ChunkEncoder:
    """Token ids of texts by a tokenizers file, with the ids of chunks between spaces cached.

    Byte-level pre-tokenization keeps a single space with what follows it and a single line
    break apart from it. So a text without two adjacent white-space characters is the
    concatenation of its chunks: words after a space, and words after a line break, which
    here begin with that break. Other texts, and those that hold an added token, go to the tokenizer whole.

    The chunks of many texts are made distinct together, and those not known yet are encoded
    together: where the vocabulary is ``separable``, the tokenizer's model splits many letter chunks in one
    call, and each ends where a token begins with a space or a line break.
    """

    def __init__(self, path: str):
        import pyarrow as pa
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # A text that holds an added token is not the concatenation of its chunks' ids.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.narrow = self.tokenizer.get_vocab_size() <= 1 << 16  # ids fit 16 bits
        self.spelling = np.zeros(256, dtype="<u2")
        for c, byte in byte_alphabet().items():
            self.spelling[byte] = ord(c)
        model, vocabulary = self.tokenizer.model, self.tokenizer.get_vocab(with_added_tokens=False)
        space, newline = chr(self.spelling[32]), chr(self.spelling[10])
        self.begins = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.begins[[i for t, i in vocabulary.items() if t[0] in (space, newline)]] = True
        self.bare = Tokenizer(model)  # the same model, without the steps around it
        # Letters alone are one pre-token, and marks after them are another.
        self.direct = (type(model).__name__ == "BPE" and not model.dropout and not model.ignore_merges
                       and self.tokenizer.normalizer is None and separable(vocabulary))
        if self.direct:
            probe = ["word", "Über", "żółw,", "a", "\nnaïveté.", "日本", "\nend.***"]
            start, count, ids = self.learned(pa.array(probe))
            self.direct = [ids[a:a + n].tolist() for a, n in zip(start, count)] == self.ids([c if c[0] == "\n" else " " + c for c in probe])
        # What is known: chunks, where its ids begin in the pool, how many they are, and groups that asked again.
        self.words = pa.array(["", "\n"], pa.string())
        self.pool = np.array(self.ids(["\n"])[0], dtype="<u4")
        self.start, self.count, self.hits = np.zeros(2, dtype=np.int64), np.array([0, len(self.pool)], dtype=np.int32), np.zeros(2, dtype=np.int32)

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def shrink(self, to: int) -> None:
        """Keep the chunks asked for most often, of these the ones met first, and free the others."""
        if len(self.words) <= to:
            return
        keep = np.argsort(-self.hits[2:], kind="stable")[:to - 2] + 2  # the first two always stay
        keep = np.concatenate([[0, 1], np.sort(keep)])
        start, self.count, self.hits = self.start[keep], self.count[keep], self.hits[keep]
        self.words, self.pool = self.words.take(keep), self.pool[spans(start, self.count)]
        self.start = np.cumsum(self.count, dtype=np.int64) - self.count

    def learned(self, chunks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the ids of each chunk of an Arrow array begin, how many they are, and all ids."""
        import pyarrow as pa
        import pyarrow.compute as pc

        plain = pc.match_substring_regex(chunks, PLAIN).to_numpy(zero_copy_only=False) if self.direct else np.zeros(len(chunks), dtype=bool)
        said = pc.replace_substring(pc.binary_join_element_wise(" ", chunks, ""), " \n", "\n")
        start, count = np.zeros(len(chunks), dtype=np.int64), np.zeros(len(chunks), dtype=np.int64)
        together = said.filter(pa.array(plain))
        ends = np.cumsum(pc.binary_length(together).to_numpy(), dtype=np.int64)[CALL_CHUNKS - 1::CALL_CHUNKS].tolist()
        joined = pa.ListArray.from_arrays(pa.array([0, len(together)], pa.int32()), together)
        data = np.frombuffer(pc.binary_join(joined, "")[0].as_buffer(), dtype=np.uint8)
        spelled = self.spelling[data].tobytes().decode("utf-16-le")  # a character for each byte
        pieces = [spelled[low:high] for low, high in zip([0, *ends], [*ends, len(spelled)]) if low < high]
        ids = [np.array(e.ids, dtype="<u4") for low in range(0, len(pieces), CALL_PIECES)
               for e in self.bare.encode_batch_fast(pieces[low:low + CALL_PIECES], add_special_tokens=False)]
        ids = np.concatenate([np.zeros(0, dtype="<u4"), *ids])
        start[plain] = first = np.flatnonzero(self.begins[ids])
        count[plain] = np.diff(first, append=len(ids))
        rest = [np.array(x, dtype="<u4") for x in self.ids(said.filter(pa.array(~plain)).to_pylist())]
        count[~plain] = sizes = np.array([len(x) for x in rest], dtype=np.int64)
        start[~plain] = len(ids) + np.cumsum(sizes) - sizes
        return start, count, np.concatenate([ids, *rest])

    def found(self, chunks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``learned``, for an Arrow array of distinct chunks; those not known are learned, and remembered if they are short."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if len(self.words) > CACHE_CHUNKS:
            self.shrink(CACHE_CHUNKS // 2)
        place = pc.index_in(chunks, value_set=self.words).fill_null(-1).to_numpy()
        self.hits[place[place >= 0]] += 1
        start, count, pools, size = self.start[place], self.count[place], [self.pool], len(self.pool)
        short = pc.less_equal(pc.binary_length(chunks), CACHE_BYTES).to_numpy(zero_copy_only=False)
        for kept in (True, False):
            new = np.flatnonzero((place < 0) & (short == kept))
            for low in range(0, len(new), LEARNED):
                some = new[low:low + LEARNED]
                at, count[some], ids = self.learned(chunks.take(some))
                start[some] = at + size
                size += len(ids)
                pools.append(ids)
            if kept:
                self.words = pa.concat_arrays([self.words, chunks.take(new)])
                self.start, self.count = np.concatenate([self.start, start[new]]), np.concatenate([self.count, count[new]])
                self.hits = np.concatenate([self.hits, np.zeros(len(new), dtype=np.int32)])
                self.pool = np.concatenate(pools)
                pools = [self.pool]
        return start, count, np.concatenate(pools) if len(pools) > 1 else self.pool

    def joined(self, texts) -> Iterator[np.ndarray]:
        """The ids of each text that is the concatenation of its chunks."""
        import pyarrow as pa
        import pyarrow.compute as pc

        # A line break before the text makes its first chunk one like others; its id is left out again.
        texts = pc.binary_join_element_wise(pa.scalar("\n", texts.type), texts, pa.scalar("", texts.type))
        chunks = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        coded = chunks.flatten().dictionary_encode()
        bounds, index = chunks.offsets.to_numpy(), coded.indices.to_numpy()
        start, count, pool = self.found(coded.dictionary.cast(pa.string()))
        lead = self.count[1]
        del texts, chunks, coded
        ends = np.concatenate([[0], np.cumsum(count[index], dtype=np.int64)])[bounds]  # in ids, of each text
        low = 0
        while low + 1 < len(bounds):
            high = max(low + 1, int(np.searchsorted(ends, ends[low] + GROUP_IDS, "right")) - 1)
            part = index[bounds[low]:bounds[high]]
            ids = pool[spans(start[part], count[part])]
            for a, b in zip(ends[low:high] - ends[low], ends[low + 1:high + 1] - ends[low]):
                yield ids[a + lead:b]
            low = high

    def encode(self, texts) -> Iterator[bytes]:
        """The packed ids of each text of a list or an Arrow array, which are taken in groups of GROUP_BYTES."""
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        whole = pc.match_substring_regex(texts, UNEVEN)
        for token in self.added:
            whole = pc.or_(whole, pc.match_substring(texts, token))
        group = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64) // GROUP_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
        for low, high in zip(cuts, cuts[1:]):
            part, apart = texts.slice(low, high - low), whole.slice(low, high - low)
            if high - low == 1:  # may be longer than a group
                part = part.cast(pa.large_string())
            even = self.joined(part.filter(pc.invert(apart)))
            flags, rest = apart.to_pylist(), part.filter(apart)
            others = (np.array(x, dtype="<u4") for at in range(0, len(rest), 64) for x in self.ids(rest.slice(at, 64).to_pylist()))
            for flag in flags:
                yield next(others if flag else even).tobytes()
            trimmed()


def crc_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def tokenized(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """Full windows (ids null, crc set) and fragments (ids set) of every document."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = _tokenizers.get(path) or _tokenizers.setdefault(path, ChunkEncoder(path))
        end = packed_ids([END_ID])
        for batch in batches:
            encoded = encoder.encode(batch.column(1))
            for low in range(0, batch.num_rows, 512):
                rows = []
                for doc_id, data in zip(batch.column(0).slice(low, 512).to_pylist(), encoded):
                    data += end
                    n = len(data) // 4
                    full = n - n % window
                    rows += [(doc_id, s, window, zlib.crc32(data[4 * s:4 * (s + window)]), n, None) for s in range(0, full, window)]
                    if full < n:
                        rest = np.frombuffer(data, dtype="<u4", offset=4 * full)
                        rows.append((doc_id, full, n - full, None, n,
                                     rest.astype("<u2").tobytes() if encoder.narrow else rest.tobytes()))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:5]], pa.array(cols[5], pa.binary())],
                                                 names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])
        encoder.shrink(KEPT_CHUNKS)
        released()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text")).mapInArrow(
        run, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, ids binary")


def unpacked(data: bytes, length: int) -> np.ndarray:
    return np.frombuffer(data, dtype="<u2" if len(data) == 2 * length else "<u4").astype(np.int64)


def term_counts(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(terms, counts) of all fragments, one after the other, each in order of terms, and where each one's begin and the last one's end."""
    lengths = np.array([len(x) for x in ids])
    joined = np.concatenate(ids)
    width = int(joined.max()) + 1
    joined += np.repeat(np.arange(len(ids)) * width, lengths)
    joined.sort()
    first = np.flatnonzero(np.diff(joined, prepend=-1))
    key = joined[first]
    return key % width, np.diff(first, append=len(joined)), np.searchsorted(key, np.arange(len(ids) + 1) * width)


def document_frequencies(fragments: DataFrame) -> dict[int, int]:
    """Fragments that hold each token id: a table of the vocabulary's size."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counts = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                terms, _, _ = term_counts([unpacked(d, n) for d, n in zip(part.column(0).to_pylist(), part.column(1).to_pylist())])
                more = np.bincount(terms, minlength=len(counts))
                more[:len(counts)] += counts
                counts = more
        terms = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.int64()), pa.array(counts[terms], pa.int64())], names=["term", "n"])

    rows = fragments.select("ids", "length").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    return {r["term"]: r["n"] for r in rows.collect()}


def projected(ids: list[np.ndarray], idf: np.ndarray, mean_length: float) -> np.ndarray:
    """A unit vector per fragment: its BM25 term weights, projected at random."""
    directions = _directions.get(len(idf))
    if directions is None:
        _directions.clear()
        random = np.random.Generator(np.random.PCG64(7))
        directions = _directions[len(idf)] = random.standard_normal((len(idf), DIMENSIONS), dtype=np.float32)
    out = np.zeros((len(ids), DIMENSIONS), dtype=np.float32)
    terms, tf, first = term_counts(ids)
    norm = np.repeat(K1 * (1 - B + B * np.array([len(x) for x in ids]) / mean_length), np.diff(first))
    weight = (idf[terms] * tf * (K1 + 1) / (tf + norm)).astype(np.float32)
    for i, (low, high) in enumerate(zip(first.tolist(), first[1:].tolist())):
        v = weight[low:high] @ directions[terms[low:high]]
        out[i] = v / max(float(np.linalg.norm(v)), 1e-9)
    return out


class ContentTree:
    """A binary tree over vectors: inner nodes hold a plane, leaves are the nodes without children."""

    def __init__(self):
        self.plane = np.zeros((1, DIMENSIONS + 1), dtype=np.float32)
        self.children = np.full((1, 2), -1, dtype=np.int64)

    def leaf_of(self, x: np.ndarray, node: int = 0) -> np.ndarray:
        at = np.full(len(x), node, dtype=np.int64)
        while True:
            inner = np.flatnonzero(self.children[at, 0] >= 0)
            if not len(inner):
                return at
            plane = self.plane[at[inner]]
            side = np.einsum("ij,ij->i", x[inner], plane[:, :-1]) > plane[:, -1]
            at[inner] = self.children[at[inner], side.astype(np.int64)]

    def leaves(self) -> list[int]:
        """Leaves in the order of the tree."""
        out, stack = [], [0]
        while stack:
            node = stack.pop()
            if self.children[node, 0] < 0:
                out.append(node)
            else:
                stack += [int(self.children[node, 1]), int(self.children[node, 0])]
        return out

    def grow(self, leaf: int, x: np.ndarray, tokens: np.ndarray, most: float, least: int) -> bool:
        """Split a leaf by sampled vectors until parts have at most ``most`` tokens or fewer than ``least`` vectors."""
        grown, planes, children = False, [], []
        stack = [(leaf, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            if len(rows) < max(least, 2) or tokens[rows].sum() <= most:
                continue
            y = x[rows]
            # The two centres start at a vector and the one least like it.
            centres = np.stack([y[0], y[np.argmin(y @ y[0])]])
            for _ in range(8):
                normal, offset = centres[1] - centres[0], (centres[1] @ centres[1] - centres[0] @ centres[0]) / 2
                side = y @ normal > offset
                if side.all() or not side.any():
                    break
                centres = np.stack([y[~side].mean(axis=0), y[side].mean(axis=0)])
            if side.all() or not side.any():
                continue
            new = len(self.plane) + len(planes)
            planes += [np.zeros(DIMENSIONS + 1, dtype=np.float32)] * 2
            children += [(-1, -1)] * 2
            plane = np.append(normal, offset).astype(np.float32)
            if node < len(self.plane):
                self.plane[node], self.children[node] = plane, (new, new + 1)
            else:
                planes[node - len(self.plane)], children[node - len(self.plane)] = plane, (new, new + 1)
            stack += [(new, rows[~side]), (new + 1, rows[side])]
            grown = True
        if grown:
            self.plane = np.concatenate([self.plane, np.stack(planes)])
            self.children = np.concatenate([self.children, np.array(children, dtype=np.int64)])
        return grown


def shard_places(sizes: dict[int, int], order: list[int], shards: int) -> list[tuple[int, float, float]]:
    """(leaf, from, to) in shards: small leaves have one place, so one shard; large ones are spread between two places."""
    total, before, out = sum(sizes.values()), 0, []
    for leaf in order:
        if leaf in sizes:
            low, high = before * shards / total, (before + sizes[leaf]) * shards / total
            if high - low <= 1:
                low = high = (low + high) / 2
            out.append((leaf, low, high))
            before += sizes[leaf]
    return out


def by_content(fragments: DataFrame, shared, tokens: int, shard_tokens: int) -> DataFrame:
    """``fragments`` with ``key`` (a hash) and ``shard``. ``shared`` broadcasts idf and mean length."""
    spark = fragments.sparkSession
    shards = max(1, -(-tokens // shard_tokens))
    fragments = fragments.withColumn("key", F.xxhash64("doc_id", "start", "ids"))
    if shards == 1:
        return fragments.withColumn("shard", F.lit(0).cast("bigint"))

    def vectors(rows: DataFrame, tree: ContentTree, schema: str, finish) -> DataFrame:
        grown = spark.sparkContext.broadcast(tree)

        def run(batches: Iterator) -> Iterator:
            for batch in batches:
                for low in range(0, batch.num_rows, 512):
                    part = batch.slice(low, 512)
                    ids = [unpacked(d, n) for d, n in zip(part.column("ids").to_pylist(), part.column("length").to_pylist())]
                    x = projected(ids, *shared.value)
                    yield finish(part, x, grown.value.leaf_of(x))

        return rows.mapInArrow(run, schema)

    def sampled(part, x, leaf):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array(leaf), part.column("length"), pa.array([v.tobytes() for v in x], pa.binary())],
                                          names=["leaf", "length", "vector"])

    def placed(part, x, leaf):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([*part.columns, pa.array(leaf)], names=[*part.schema.names, "leaf"])

    tree, rows, turn = ContentTree(), fragments.withColumn("leaf", F.lit(0).cast("bigint")), 0
    counts = {0: (fragments.count(), tokens)}
    whole: set[int] = set()  # leaves that a full sample of their own does not separate
    while True:
        big = sorted((leaf for leaf, (_, size) in counts.items() if size > shard_tokens and leaf not in whole), key=lambda leaf: -counts[leaf][1])
        if not big:
            break
        # As many leaves in a round as the sample has room for, each with enough vectors of its own; the others have their turn later.
        big = big[:max(1, SAMPLE // LEAF_SAMPLE)]
        share = {leaf: min(1.0, SAMPLE / len(big) / counts[leaf][0]) for leaf in big}
        turn += 1
        shares = F.broadcast(spark.createDataFrame([(leaf, x) for leaf, x in share.items()], "of bigint, share double"))  # one row a leaf of the round
        inside = rows.join(shares, F.col("leaf") == F.col("of"))
        wanted = inside.filter(F.pmod(F.xxhash64("key", F.lit(turn)), F.lit(1 << 30)) < F.col("share") * (1 << 30)).select("ids", "length")
        found = vectors(wanted, tree, "leaf bigint, length bigint, vector binary", sampled).toPandas()  # about SAMPLE rows
        x = np.frombuffer(b"".join(found["vector"]), dtype=np.float32).reshape(-1, DIMENSIONS)
        at, length, split = found["leaf"].to_numpy(), found["length"].to_numpy(), []
        for leaf in big:
            mine = np.flatnonzero(at == leaf)
            # Parts of a quarter of a shard, so that the shards put together from them are even.
            if tree.grow(leaf, x[mine], length[mine], share[leaf] * shard_tokens / 4, LEAST_SAMPLE if share[leaf] < 1 else 2):
                split.append(leaf)
            else:
                whole.add(leaf)
        if not split:
            continue
        # Only fragments of leaves that were split are projected again, and only they are written.
        moved = rows.filter(F.col("leaf").isin(split)).drop("leaf") if tree.children[0, 0] >= 0 and len(counts) > 1 else rows.drop("leaf")
        moved = cut(vectors(moved, tree, PLACED, placed))
        rows = moved if len(counts) == 1 else rows.filter(~F.col("leaf").isin(split)).unionByName(moved)
        counts = {leaf: n for leaf, n in counts.items() if leaf not in split}
        counts |= {r["leaf"]: (r["n"], r["size"]) for r in
                   moved.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("size")).collect()}
    places = shard_places({leaf: size for leaf, (_, size) in counts.items()}, tree.leaves(), shards)
    places = spark.createDataFrame(places, "leaf bigint, low double, high double")
    within = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / float(1 << 30)
    shard = F.least(F.floor(F.col("low") + within * (F.col("high") - F.col("low"))), F.lit(shards - 1)).cast("bigint")
    return rows.join(F.broadcast(places), "leaf").withColumn("shard", shard).drop("leaf", "low", "high")


def shard_windows(ids: list[np.ndarray], idf: np.ndarray, mean_length: float, window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences of one shard as lists of (fragment, from, to)."""
    n = len(ids)
    lengths = np.array([len(x) for x in ids])
    found, tf, first = term_counts(ids)
    fragment_of = np.repeat(np.arange(n, dtype=np.int32), np.diff(first))
    norm = K1 * (1 - B + B * lengths / mean_length)
    weight = (idf[found] * tf * (K1 + 1) / (tf + norm[fragment_of])).astype(np.float32)
    terms = np.flatnonzero(np.bincount(found))
    number = np.zeros(int(terms[-1]) + 1, dtype=np.int32)
    number[terms] = np.arange(len(terms))
    asked_by = number[found]  # the terms of a fragment, in order
    by_term = np.argsort(asked_by.astype(np.uint16) if len(terms) <= 1 << 16 else asked_by, kind="stable")
    term_of, fragment_of, weight = asked_by[by_term], fragment_of[by_term], weight[by_term]
    del found, tf, norm, by_term  # as large as the shard
    alive = np.arange(n)  # fragments in the index, which is built again when a part of them is used up
    row_of = np.full(len(terms), -1)  # terms of long postings, at most DENSE_TERM numbers for each of theirs
    long = np.flatnonzero(np.bincount(term_of) * DENSE_TERM > n)
    row_of[long] = np.arange(len(long))
    postings = dense = np.zeros(0)

    def index() -> None:
        """Postings of the fragments not used up."""
        nonlocal alive, term_of, fragment_of, weight, postings, dense
        left = room_of[alive] > 0
        if not left.all():
            held = left[fragment_of]
            term_of, weight = term_of[held], weight[held]
            fragment_of = (np.cumsum(left, dtype=np.int32) - 1)[fragment_of[held]]
            alive = alive[left]
        postings = np.searchsorted(term_of, np.arange(len(terms) + 1))
        dense = np.zeros((len(long), len(alive)), dtype=np.float32)
        in_row = row_of[term_of] >= 0
        dense[row_of[term_of[in_row]], fragment_of[in_row]] = weight[in_row]

    left_from = np.zeros(n, dtype=np.int64)  # what is left of a fragment begins here
    room_of = lengths.copy()                 # and is this long; 0 when used up
    seeds = np.argsort(-lengths, kind="stable")
    sequences, total, at, used = [], int(lengths.sum()), 0, 0
    index()

    def take(pieces: list, fragment: int, most: int) -> int:
        nonlocal used
        size = min(int(room_of[fragment]), most)
        a = int(left_from[fragment])
        pieces.append((int(fragment), a, a + size))
        left_from[fragment] += size
        room_of[fragment] -= size
        used += not room_of[fragment]
        return size

    def scored(seed: int) -> np.ndarray:
        """Scores of the fragments in the index for all terms of the seed; -1 for those used up."""
        asked = asked_by[first[seed]:first[seed + 1]]
        rows = row_of[asked]
        scores = dense[rows[rows >= 0]].sum(axis=0)
        rare = asked[rows < 0]
        low = postings[rare]
        at = spans(low, postings[rare + 1] - low)
        np.add.at(scores, fragment_of[at], weight[at])  # in the order of the terms
        scores[room_of[alive] == 0] = -1
        return scores

    def nearest(scores: np.ndarray) -> Iterator[np.ndarray]:
        """All unused fragments in order of score, NEIGHBOURS at a time."""
        n, done, most = len(scores), 0, 4 * NEIGHBOURS
        while True:
            if most < n:  # with all that score as much as the last one
                near = np.flatnonzero(scores >= np.partition(scores, n - most)[n - most])
            else:
                near = np.arange(n)
            near = near[np.lexsort((near, -scores[near]))]
            near = near[scores[near] >= 0]
            for low in range(done, len(near), NEIGHBOURS):
                yield alive[near[low:low + NEIGHBOURS]]
            if most >= n:
                return
            done, most = len(near), 8 * most

    while total >= window:
        while room_of[seeds[at]] == 0:
            at += 1
        seed = seeds[at]
        pieces: list[tuple[int, int, int]] = []
        room = window - take(pieces, seed, window)
        if room:
            if used >= len(alive) // REBUILT:
                index()
                used = 0
            for near in nearest(scored(seed)):
                for fragment in near:
                    if 0 < room_of[fragment] <= room:
                        room -= take(pieces, fragment, room)
                for fragment in near:
                    if room and room_of[fragment]:
                        room -= take(pieces, fragment, room)
                if not room:
                    break
        sequences.append(pieces)
        total -= window
    size = window
    while total:
        while size > total:
            size //= 2
        pieces, room = [], size
        while room:
            if room_of[seeds[at]]:
                room -= take(pieces, seeds[at], room)
            else:
                at += 1
        sequences.append(pieces)
        total -= size
    return sequences


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    parts = cut(tokenized(docs, tokenizer_path, window))
    fragments = parts.filter("ids IS NOT NULL")
    counted = fragments.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("tokens")).first()
    n, tokens = counted["n"], counted["tokens"] or 0
    frequency = document_frequencies(fragments)
    idf = np.zeros(max(frequency, default=0) + 1)
    for term, count in frequency.items():
        idf[term] = np.log(1 + (n - count + 0.5) / (count + 0.5))
    shared = spark.sparkContext.broadcast((idf, tokens / max(n, 1)))  # bounded by the vocabulary

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        _tokenizers.clear()  # of the stage before, in this worker
        _directions.clear()
        idf, mean_length = shared.value
        pdf = pdf.sort_values(["key", "doc_id", "start"], kind="stable").reset_index(drop=True)
        ids = [unpacked(d, k) for d, k in zip(pdf["ids"], pdf["length"])]
        shard, rows = int(pdf["shard"].iloc[0]), []
        doc, start, doc_tokens = pdf["doc_id"].astype("Int64"), pdf["start"].to_numpy(), pdf["doc_tokens"].to_numpy()
        for k, pieces in enumerate(shard_windows(ids, idf, mean_length, window)):
            offset = 0
            for fragment, a, b in pieces:
                rows.append((fragment, start[fragment] + a, b - a, crc_of(ids[fragment][a:b]), doc_tokens[fragment],
                             2 * ((shard << 32) + k) + 1, offset))
                offset += b - a
        out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
        out["doc_id"] = doc.iloc[out["doc_id"]].reset_index(drop=True)
        del pdf, ids
        released()
        return out

    mixed = by_content(fragments, shared, tokens, shard_tokens).groupBy("shard").applyInPandas(run, PIECES)
    full = parts.filter("ids IS NULL").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.monotonically_increasing_id() * 2).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    return full.unionByName(mixed)
