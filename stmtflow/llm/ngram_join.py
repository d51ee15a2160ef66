"""Operator 2: near-duplicate join on word five-grams (Jaccard 0.8 or more) by chosen paths.

1. Equal texts are one class, represented by its key (a digest of the text). Each class has
   the set of its five-word shingles and a sketch: ``COORDINATES`` MinHash values. The share of
   equal coordinates of two sketches estimates the Jaccard similarity of the sets.
2. Chosen paths: a run starts at a node that holds every class and chooses coordinates at
   random; classes with equal value there go to the same child. A node with more than ``LEAF``
   classes chooses again, ``BRANCHES`` coordinates, while that separates its classes (a child with more
   than ``DENSE`` of its node is a group of near copies and a leaf) and down to ``DEPTH`` levels; a pair of
   similarity s goes on to a common child with probability s per coordinate. Runs (one first coordinate each) are
   repeated until the chance to miss a pair at the threshold in all of them is below ``1 - RECALL``.
3. Leaves are compared by brute force on sketches, and a spanning forest of what looks
   similar is kept. Leaves that stay large (groups of near copies never split) are cut into blocks
   and compared block by block, by as many tasks as there are block pairs.
4. Candidates form components. Within each, all pairs are compared exactly on the shingle sets,
   again in blocks of bounded size. Each task emits, per class, its number of links and one
   edge of a spanning forest, never the pairs. So also pairs that no run brought together count,
   and every number of links is exact within a component.
5. Components over the exact links are the duplicate groups.

Words are ``[^\\x20\\x09-\\x0D]+``. A text of one to four words has one shingle, all its words.

Cases: null text reads as empty; empty texts are equal texts and so one class without links to
others; null ids take part, and a group's id is its smallest id that is not null; rows that repeat
are copies of each other; an empty table gives an empty result; other columns are kept by
``one_of_each`` and ignored otherwise.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_PATTERN, cut, packed, whole_text

SHINGLE = 5
THRESHOLD = 0.8
COORDINATES = 64
LOOSE = 0.6          # sketches that agree less are not candidates: four standard deviations below the threshold
LEAF = 512
BRANCHES = 2
DEPTH = 8            # a bound; splitting ends when no node is large, or when it no longer separates
DENSE = 0.5          # share of a node in one child from which on splitting does not separate
RECALL = 0.9999
BLOCK_BYTES = 4 << 20
BROADCAST_ROWS = 500_000

_words = re.compile(WORD_PATTERN).findall
_rng = np.random.Generator(np.random.PCG64(2))
FACTORS = _rng.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)


def runs_needed(threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """Runs after which a pair at the threshold is missed with less than 1 - recall, all levels taken."""
    found = threshold
    for _ in range(DEPTH - 1):
        found = threshold * (1 - (1 - found) ** BRANCHES)
    return math.ceil(math.log(1 - recall) / math.log(1 - found))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(text: str, known: dict | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = _words(text)
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if known is None:
        known = {}
    hashes = []
    for w in words:
        h = known.get(w)
        if h is None:
            h = xxhash.xxh64_intdigest(w)
            if len(w) < 64:
                known[w] = h
        hashes.append(h)
    h = np.array(hashes, dtype=np.uint64)
    n = max(1, len(h) - SHINGLE + 1)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(min(SHINGLE, len(h))):
        out = mixed(out + h[i:i + n])
    return np.unique(out)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """MinHash values of a set, 32 bits each."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 2048):
        part = hashes[None, at:at + 2048] * FACTORS[:, None] + OFFSETS[:, None]
        least = np.minimum(least, part.min(axis=1))
    return (least >> np.uint64(32)).astype("<u4")


def _cleared(known: dict) -> dict:
    if len(known) > 200_000:
        known.clear()
    return known


def _sketches(batches: Iterator) -> Iterator:
    """(key, text) to (key, size, sketch)."""
    import pyarrow as pa

    known: dict = {}
    for batch in batches:
        sizes, out = [], []
        for text in batch.column(1).to_pylist():
            s = shingles(text, _cleared(known))
            sizes.append(len(s))
            out.append(sketch(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), pa.array(out, pa.binary())],
                                         names=["key", "size", "sketch"])


def _sets(batches: Iterator) -> Iterator:
    """(key, comp, copies, text) to (key, comp, copies, shingle set)."""
    import pyarrow as pa

    known: dict = {}
    for batch in batches:
        out = [shingles(t, _cleared(known)).tobytes() for t in batch.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(3)], pa.array(out, pa.binary())],
                                         names=["key", "comp", "copies", "shingles"])


def runs_of(batches: Iterator) -> Iterator:
    """Arrow tables of equal ``piece`` from batches sorted by it (one piece is bounded by two blocks)."""
    import pyarrow as pa

    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        piece = batch.column("piece").to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(piece[1:] != piece[:-1]) + 1).tolist(), len(piece)]
        if held and held[0].column("piece")[0].as_py() != piece[0]:
            yield pa.Table.from_batches(held)
            held = []
        for low, high in zip(edges[:-1], edges[1:]):
            if low and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(low, high - low))
    if held:
        yield pa.Table.from_batches(held)


def forest(near: np.ndarray) -> np.ndarray:
    """For each row of a symmetric adjacency matrix, the smallest row of its component."""
    label = np.arange(len(near))
    near = near | np.eye(len(near), dtype=bool)
    while True:
        least = np.where(near, label[None, :], len(near)).min(axis=1)
        least = least[least]
        if (least == label).all():
            return label
        label = least


def pairs_asked(side: np.ndarray) -> np.ndarray:
    """Pairs that a piece compares: all of one block (side 0), or those across two (sides 1 and 2, one of which may be empty)."""
    asked = (side[:, None] != side[None, :]) | (side[:, None] == 0)
    np.fill_diagonal(asked, False)
    return asked


def _leaf_edges(batches: Iterator) -> Iterator:
    """Rows (piece, side, key, sketch) to a forest (a, b) of pairs whose sketches look similar."""
    import pyarrow as pa

    for run in runs_of(batches):
        if run.num_rows < 2:
            continue
        keys = run.column("key").to_pylist()
        order = sorted(range(len(keys)), key=keys.__getitem__)
        rows = run.column("sketch").to_pylist()
        values = np.frombuffer(b"".join(rows[i] for i in order), dtype="<u4").reshape(len(rows), -1)
        equal = np.zeros((len(rows), len(rows)), dtype=np.uint8)
        for k in range(values.shape[1]):
            equal += values[:, k][:, None] == values[:, k][None, :]
        near = (equal >= LOOSE * values.shape[1]) & pairs_asked(run.column("side").to_numpy()[order])
        root = forest(near)
        hit = np.flatnonzero(root != np.arange(len(root)))
        if len(hit):
            yield pa.RecordBatch.from_arrays([pa.array([keys[order[i]] for i in hit], pa.binary()),
                                              pa.array([keys[order[root[i]]] for i in hit], pa.binary())], names=["a", "b"])


def common_counts(sets: list[np.ndarray], side: np.ndarray) -> np.ndarray:
    """Numbers of common elements of every two sets."""
    n = len(sets)
    counts = np.zeros((n, n), dtype=np.int64)
    if n <= 12:
        for i in range(n):
            for j in range(i):
                if side[i] == side[j] != 0:
                    continue
                counts[i, j] = counts[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return counts
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    elements, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    everywhere = times == n
    counts += int(everywhere.sum())
    shared = (times > 1) & ~everywhere
    number = np.cumsum(shared) - 1
    keep = shared[at]
    owner, column = owner[keep], number[at[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for low in range(0, int(shared.sum()), 8192):  # a slice of the elements as a 0/1 matrix
        a, b = np.searchsorted(column, (low, low + 8192))
        marks = np.zeros((n, 8192), dtype=np.float32)
        marks[owner[a:b], column[a:b] - low] = 1
        counts += np.rint(marks @ marks.T).astype(np.int64)
    return counts


def _exact_links(batches: Iterator) -> Iterator:
    """Rows (piece, side, key, copies, shingles) to (key, links, root): linked documents, and one forest edge."""
    import pyarrow as pa

    tenths = round(THRESHOLD * 10)
    for run in runs_of(batches):
        if run.num_rows < 2:
            continue
        keys = run.column("key").to_pylist()
        order = sorted(range(len(keys)), key=keys.__getitem__)
        data, copies = run.column("shingles").to_pylist(), run.column("copies").to_numpy()[order]
        sets = [np.frombuffer(data[i], dtype=np.uint64) for i in order]
        side = run.column("side").to_numpy()[order]
        sizes = np.array([len(s) for s in sets])
        common = common_counts(sets, side)
        linked = (10 * common >= tenths * (sizes[:, None] + sizes[None, :] - common)) & pairs_asked(side) & (common > 0)
        hit = np.flatnonzero(linked.any(axis=1))
        if len(hit):
            root = forest(linked)
            links = linked @ copies
            yield pa.RecordBatch.from_arrays([pa.array([keys[order[i]] for i in hit], pa.binary()), pa.array(links[hit], pa.int64()),
                                              pa.array([keys[order[root[i]]] for i in hit], pa.binary())], names=["key", "links", "root"])


def in_blocks(rows: DataFrame, blocks: str) -> DataFrame:
    """Each row once per block pair of its group: columns piece and side are added.

    ``group`` is the group's number and ``blocks`` its number of blocks; a row of block x goes to
    the pairs (x, y), x first if x <= y. The side is 0 in a pair of a block with itself, 1 for the first and
    2 for the second of two. Rows are sorted by piece within partitions.
    """
    spread = (rows.withColumn("_x", F.pmod(F.xxhash64("key"), F.col(blocks)))
              .withColumn("_y", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(blocks) - 1)))
              .withColumn("piece", F.xxhash64("group", F.least("_x", "_y"), F.greatest("_x", "_y")))
              .withColumn("side", F.when(F.col("_x") == F.col("_y"), 0).when(F.col("_x") < F.col("_y"), 1).otherwise(2)).drop("_x", "_y"))
    return spread.repartition("piece").sortWithinPartitions("piece")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest key of each connected component, for nodes with an edge (a, b).

    Alternating large-star and small-star steps; every step is joins and minima by key.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    seen = None
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"),
                                               F.col("m").alias("b")).filter("a <> b").distinct())
        now = cut(small)
        state = tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        if state == seen:
            break
        seen = state
    comp = now.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    return comp.union(comp.select(F.col("comp").alias("node"), "comp").distinct())


def path_edges(reps: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of the classes (key, sketch): a forest over what the chosen paths bring together."""
    def value(at):
        return F.substring(F.col("sketch"), (at * 4 + 1).cast("int"), F.lit(4))

    runs = runs_needed()
    first = np.random.Generator(np.random.PCG64(11)).permutation(COORDINATES)[:runs]
    rows = reps.select("key", "sketch", F.explode(F.array(*[F.lit(int(c)) for c in first])).alias("c"))
    rows = rows.select("key", F.xxhash64("c", value(F.col("c"))).alias("path"), F.lit(None).cast("bigint").alias("above"), F.array("c").alias("used"))
    leaves, level = None, 1
    while True:
        # Only nodes that hold two classes or more go on. Their counts are stored first: a join of two plain
        # exchanges is one whose large partitions (a node with a shingle of very many texts) Spark can split.
        counts = cut(rows.groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
        rows = cut(rows.join(counts, "path"))
        ends = (F.col("n") <= LEAF) | F.coalesce(F.col("n") > DENSE * F.col("above"), F.lit(False)) | F.lit(level == DEPTH)
        leaf = rows.filter(ends).select("key", F.col("path").alias("group"), F.ceil(F.col("n") / LEAF).alias("blocks"))
        leaves = leaf if leaves is None else leaves.union(leaf)
        rows = rows.filter(~ends)
        level += 1
        if level > DEPTH or rows.isEmpty():
            break
        # A coordinate that led here would put the whole node into one child: only others are chosen.
        others = F.array_except(F.sequence(F.lit(0), F.lit(COORDINATES - 1)), F.col("used"))
        chosen = F.explode(F.array(*[F.struct(F.lit(b).alias("b"), F.get(others, F.pmod(F.xxhash64("path", F.lit(b)), F.size(others)).cast("int")).alias("c"))
                                     for b in range(BRANCHES)])).alias("s")
        rows = (rows.select("key", "path", "n", "used", chosen).join(reps.select("key", "sketch"), "key")
                .select("key", F.xxhash64("path", "s.b", "s.c", value(F.col("s.c"))).alias("path"), F.col("n").alias("above"),
                        F.array_append("used", F.col("s.c")).alias("used")))
    compared = in_blocks(leaves.join(reps.select("key", "sketch"), "key"), "blocks")
    return compared.select("piece", "side", "key", "sketch").mapInArrow(_leaf_edges, "a binary, b binary")


def keyed(docs: DataFrame) -> DataFrame:
    """key (digest of the text), doc_id, text."""
    return docs.select(F.unhex(F.md5(whole_text())).alias("key"), F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))


def classes(docs: DataFrame) -> DataFrame:
    """Per distinct text: key, copies, rep (its smallest id), comp (the group's smallest key), links.

    ``links`` counts the documents with another text that are similar to this one.
    """
    rows = keyed(docs)
    sketched = rows.select("key", "text").mapInArrow(_sketches, "key binary, size int, sketch binary")
    reps = cut(sketched.groupBy("key").agg(F.max("size").alias("size"), F.max("sketch").alias("sketch")))
    copies = rows.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("rep"))
    candidates = components(path_edges(reps.filter("size > 0")))
    members = cut(candidates.withColumnRenamed("node", "key").join(reps.select("key", "size"), "key").join(copies, "key"))
    # Texts are read again for the candidates only; their keys go along as a broadcast while they are few.
    wanted = members.select(F.col("key"), F.col("comp"), F.col("copies"), F.col("rep"))
    wanted = F.broadcast(wanted) if members.count() <= BROADCAST_ROWS else wanted
    texts = (rows.join(wanted, "key").filter(F.col("doc_id").eqNullSafe(F.col("rep")))
             .select("key", "comp", "copies", "text").mapInArrow(_sets, "key binary, comp binary, copies bigint, shingles binary"))
    sizes = members.groupBy("comp").agg(F.greatest(F.ceil(F.count(F.lit(1)) / LEAF), F.ceil(F.sum("size") * 8 / BLOCK_BYTES)).alias("blocks"))
    # A repeated row (same id and text) may bring its set twice.
    sets = texts.dropDuplicates(["key"]).join(sizes, "comp").withColumn("group", F.xxhash64("comp")).drop("comp")
    pieces = in_blocks(sets, "blocks").select("piece", "side", "key", "copies", "shingles")
    found = cut(pieces.mapInArrow(_exact_links, "key binary, links bigint, root binary"))
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    comps = components(found.select(F.col("key").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "key")
    return (copies.join(links, "key", "left").join(comps, "key", "left")
            .select("key", "copies", "rep", F.coalesce("comp", "key").alias("comp"), F.coalesce("links", F.lit(0)).alias("links")))


def duplicate_groups(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, class_id (smallest id of its group), n_links (other documents similar or equal to it), n_copies."""
    per = cut(classes(docs))
    groups = per.groupBy("comp").agg(F.min("rep").alias("class_id"))
    return (keyed(docs).select("doc_id", "key")
            .join(per.join(groups, "comp"), "key")
            .select("doc_id", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n_copies")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one document of each duplicate group left: the one of the smallest id."""
    per = cut(classes(docs))
    groups = per.groupBy("comp").agg(F.min(F.struct(F.col("rep").isNull(), "rep", "key")).alias("kept"), F.count(F.lit(1)).alias("texts"))
    # Only groups of several rows decide anything; the others stay without being looked up.
    special = cut(per.join(groups, "comp").filter("texts > 1 OR copies > 1").select(
        F.col("key").alias("of"), (F.col("key") == F.col("kept.key")).alias("stays"), "rep", "copies"))
    special = F.broadcast(special) if special.count() <= BROADCAST_ROWS else special
    rows = packed(docs, key=F.unhex(F.md5(whole_text())), doc_id=F.col("doc_id").cast("bigint"))
    rows = rows.join(special, F.col("key") == F.col("of"), "left")
    rows = rows.filter(F.col("of").isNull() | (F.col("stays") & F.col("doc_id").eqNullSafe(F.col("rep"))))
    # Copies may repeat the very row that stays.
    copied = rows.filter("copies > 1").dropDuplicates(["key"])
    return rows.filter(F.coalesce("copies", F.lit(1)) == 1).unionByName(copied).select("row.*")
