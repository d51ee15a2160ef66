"""Operator 11: repair of conversation structure at least cost, by Four-Russians block tables.

The rows of a conversation, in order, are edited so that the initials of the roles read
``(s?(ua)+)?``: Keep (cost 0), Rerole to user or assistant (1), Delete (2; the only edit of blank and
repeated rows), Insert an empty user or assistant row anywhere (5). A truncated row that is not
deleted adds 5. Of the cheapest edits those whose initials are least in ASCII order are taken.

* What a row means to the edits is one of 8 symbols: first letter of its role, truncated or not. Rows that must go cost
  the same in every state; they are no symbols and leave the tables alone.
* The least cost to the end, for each of the four states (nothing yet, system, user, assistant), less their
  minimum, is one of few vectors (21). For each of them and each block of ``BLOCK`` symbols a table holds the vector
  before the block and what it costs. A conversation is read from its end by one lookup a block.
* Tracing goes from the start, where the least edit that stays on a cheapest way is right; each block
  is expanded from its end to the vectors between its rows. Expanded blocks are kept for the next ones alike.

Rows are range-partitioned by conversation and turn, so a very large conversation is in many tasks. A segment at
the edge of a partition tells for every vector at its end the vector at its start, then for every state at its start the state
at its end: a few numbers, put together on the driver for at most two segments a partition. Only then
all segments are traced. Equal rows are first counted together, so a row repeated without end is one row.

Cases: order is by turn, nulls first, then role and text; a null conversation id is a conversation of its own; null roles and texts read as
one space; a role that begins with none of s, u, a can be reroled or deleted; repeated rows are duplicates; the largest gap is that of 64 bits; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE_CHARS, cut

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)  # the state after the one row that may be put in at a state
GRAMMAR = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (USER, 2): ASSISTANT, (ASSISTANT, 1): USER}
SYMBOLS = 8             # first letter s, u, a or another; 4 more if truncated
BLOCK = 4
EXPANDED = 50_000       # expanded blocks kept by a task
BROADCAST_ROWS = 200_000
NAMES = {USER: "user", ASSISTANT: "assistant"}
EDITED = "edits string, new_role string, inserted array<string>, appended array<string>"


def with_inserts(costs: list[int]) -> list[int]:
    for _ in range(3):
        costs = [min(c, INSERT + costs[NEXT[s]]) for s, c in enumerate(costs)]
    return costs


def before(symbol: int, after: tuple[int, ...]) -> list[int]:
    """Least costs to the end before a row, from those after it."""
    extra = TRUNCATED if symbol >= 4 else 0
    costs = []
    for state in range(4):
        best = min(DELETE + after[state], REROLE + extra + after[NEXT[state]])
        kept = GRAMMAR.get((state, symbol % 4))
        costs.append(best if kept is None else min(best, KEEP + extra + after[kept]))
    return with_inserts(costs)


class BlockTables:
    """Normalised cost vectors, and for each and every block of symbols the vector before it and the cost."""

    def __init__(self, block: int = BLOCK):
        self.block = block
        end = tuple(with_inserts([0, 99, 99, 0]))
        self.vectors, number, steps = [end], {end: 0}, []
        for vector in self.vectors:  # grows while it is read
            for symbol in range(SYMBOLS):
                costs = before(symbol, vector)
                new = tuple(c - min(costs) for c in costs)
                if new not in number:
                    number[new] = len(self.vectors)
                    self.vectors.append(new)
                steps.append((number[new], min(costs)))
        n = len(self.vectors)
        self.step = np.array([s for s, _ in steps], dtype=np.int64).reshape(n, SYMBOLS)
        self.cost = np.array([c for _, c in steps], dtype=np.int64).reshape(n, SYMBOLS)
        to, cost = np.arange(n)[:, None], np.zeros((n, 1), dtype=np.int64)
        for _ in range(block):  # the last symbol is the lowest digit and is read first
            code = np.arange(to.shape[1] * SYMBOLS)
            first, rest = code % SYMBOLS, code // SYMBOLS
            to, cost = to[self.step[:, first], rest], cost[self.step[:, first], rest] + self.cost[:, first]
        self.to, self.total = to, cost
        self.expanded: dict[tuple[int, int, int], tuple[list[tuple[str, list[int]]], int]] = {}

    def codes(self, symbols: np.ndarray) -> tuple[list[int], list[int]]:
        """Whole blocks from the start as numbers, and the symbols left."""
        n = len(symbols) - len(symbols) % self.block
        weights = SYMBOLS ** np.arange(self.block - 1, -1, -1)
        return (symbols[:n].reshape(-1, self.block) @ weights).tolist(), symbols[n:].tolist()

    def all_starts(self, symbols: np.ndarray) -> np.ndarray:
        """For every vector at the end of a segment the one at its start."""
        codes, rest = self.codes(symbols)
        at = np.arange(len(self.vectors))
        for symbol in reversed(rest):
            at = self.step[at, symbol]
        for code in reversed(codes):
            at = self.to[at, code]
        return at

    def cheapest(self, symbols: np.ndarray, end: int = 0) -> int:
        """The least cost of a conversation's symbols."""
        codes, rest = self.codes(symbols)
        at, total = end, 0
        for symbol in reversed(rest):
            at, total = int(self.step[at, symbol]), total + int(self.cost[at, symbol])
        for code in reversed(codes):
            at, total = int(self.to[at, code]), total + int(self.total[at, code])
        return total + self.vectors[at][START]

    def trace(self, symbols: np.ndarray, end: int = 0, state: int = START) -> tuple[list[tuple[str, list[int]]], int]:
        """Per symbol its edits (inserts before it, then its own) and the states these lead to; the state at the end."""
        codes, rest = self.codes(symbols)
        at = [end]
        for symbol in reversed(rest):
            at.append(int(self.step[at[-1], symbol]))
        ends = [at[-1]]
        for code in reversed(codes):
            ends.append(int(self.to[ends[-1], code]))
        out = []
        for code, vector in zip(codes, reversed(ends[:-1])):
            edits, state = self.expand(vector, code, state)
            out += edits
        for symbol, vector in zip(rest, reversed(at[:-1])):
            edits, state = self.edit(vector, symbol, state)
            out.append(edits)
        return out, state

    def expand(self, vector: int, code: int, state: int) -> tuple[list[tuple[str, list[int]]], int]:
        """The trace of one block, from the vector at its end."""
        key = (vector, code, state)
        found = self.expanded.get(key)
        if found is None:
            symbols, after = [], [vector]
            for _ in range(self.block):
                symbols.append(code % SYMBOLS)
                code //= SYMBOLS
                after.append(int(self.step[after[-1], symbols[-1]]))
            edits = []
            for symbol, v in zip(reversed(symbols), reversed(after[:-1])):
                one, state = self.edit(v, symbol, state)
                edits.append(one)
            if len(self.expanded) >= EXPANDED:
                self.expanded.clear()
            found = self.expanded[key] = edits, state
        return found

    def edit(self, vector: int, symbol: int, state: int) -> tuple[tuple[str, list[int]], int]:
        """The least edits of one row on a cheapest way: D, I, K, R in this order; ``vector`` is the one after the row."""
        after, here = self.vectors[vector], self.vectors[int(self.step[vector, symbol])]
        paid = int(self.cost[vector, symbol])  # real costs before the row are ``here`` and this
        extra = TRUNCATED if symbol >= 4 else 0
        edits, states = "", []
        while True:
            if here[state] + paid == DELETE + after[state]:
                return (edits + "D", states), state
            if here[state] == INSERT + here[NEXT[state]]:
                edits, state = edits + "I", NEXT[state]
            else:
                kept = GRAMMAR.get((state, symbol % 4))
                if kept is not None and here[state] + paid == KEEP + extra + after[kept]:
                    return (edits + "K", [*states, kept]), kept
                return (edits + "R", [*states, NEXT[state]]), NEXT[state]
            states.append(state)

    @staticmethod
    def closing(state: int) -> list[int]:
        """States led to by the rows put in at the end of a conversation."""
        return {SYSTEM: [USER, ASSISTANT], USER: [ASSISTANT]}.get(state, [])


@lru_cache(maxsize=1)
def tables() -> BlockTables:
    return BlockTables()


def _faults(rows: DataFrame) -> DataFrame:
    """Equal rows counted together, with fault (blank, duplicate, truncated or none) and symbol (null: has to go)."""
    keys = ["conv_id", "turn", "role", "text"]
    rows = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))
    mark = F.xxhash64("conv_id", "role", F.md5("text"))  # only brings equal texts together; the digest decides
    marked = cut(rows.withColumn("mark", mark).withColumn("digest", F.md5("text")))
    # Texts that a conversation has at several turns: the first one is no duplicate.
    again = (marked.groupBy("mark", "conv_id", "role", "digest").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("turn")).alias("first"))
             .filter("times > 1").select(F.col("mark").alias("m"), F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first"))
    again = cut(again)
    again = F.broadcast(again) if again.count() <= BROADCAST_ROWS else again
    rows = marked.join(again, (F.col("mark") == F.col("m")) & F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r"))
                       & (F.col("digest") == F.col("d")), "left")
    later = F.col("first").isNotNull() & F.col("turn").isNotNull() & (F.col("first.turn").isNull() | (F.col("turn") > F.col("first.turn")))
    last = F.right(F.rtrim(F.col("text"), F.lit(SPACE_CHARS)), F.lit(1))
    fault = (F.when(F.translate("text", SPACE_CHARS, "") == "", "blank").when(later, "duplicate")
             .when(~last.isin(".", "!", "?"), "truncated").otherwise("none"))
    rows = rows.select(*keys, "copies", fault.alias("fault"))
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return rows.withColumn("symbol", F.when(F.col("fault") == "truncated", code + 4).when(F.col("fault") == "none", code))


def _segments(batches: Iterator) -> Iterator[tuple[list, list, list[int]]]:
    """Whole segments: a conversation's rows in this partition are never parted. (batches, conversation ids, where segments begin and end)."""
    held: list = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("conv_id").to_pylist()
        if held and ids[0] != last:
            yield _bounded(held)
            held = []
        last, low = ids[-1], len(ids)
        while low and ids[low - 1] == last:
            low -= 1
        if low:
            yield _bounded([*held, batch.slice(0, low)])
            held = []
        held.append(batch.slice(low))
    if held:
        yield _bounded(held)


def _values(held: list, name: str) -> list:
    return [x for batch in held for x in batch.column(name).to_pylist()]


def _bounded(held: list) -> tuple[list, list, list[int]]:
    ids = _values(held, "conv_id")
    return held, ids, [i for i in range(len(ids)) if not i or ids[i] != ids[i - 1]] + [len(ids)]


def _kept(symbols: list) -> np.ndarray:
    return np.array([x for x in symbols if x is not None], dtype=np.int64)


def _edge_vectors(batches: Iterator) -> Iterator:
    """For the first and the last segment of a partition: (part, place, conv_id, vector at the start for each at the end)."""
    import pyarrow as pa

    first = last = None
    for held, ids, edges in _segments(batches):
        symbols, part, kind = _values(held, "symbol"), held[0].column("part")[0].as_py(), held[0].schema.field("conv_id").type
        if first is None:
            first = last = (part, 0, ids[0], tables().all_starts(_kept(symbols[:edges[1]])).tolist())
        if len(edges) > 2 or last[2] != ids[-1]:
            last = (part, 1, ids[-1], tables().all_starts(_kept(symbols[edges[-2]:])).tolist())
    if first is not None:
        parts, place, conv, starts = zip(*([first] if last is first else [first, last]))
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(place, pa.int32()), pa.array(conv, kind), pa.array(starts, pa.list_(pa.int64()))],
                                         names=["part", "place", "conv_id", "starts"])


def _chains(edges: list) -> list[list[tuple]]:
    """Segments of conversations that go on over several partitions: lists of (part, conv_id, vector at the end)."""
    chains: list[list[tuple]] = []
    follower, vector = None, 0
    for i in range(len(edges) - 1, -1, -1):
        row = edges[i]
        goes_on = follower is not None and follower["part"] != row["part"] and follower["conv_id"] == row["conv_id"]
        if not goes_on:
            chains.append([])
            vector = 0
        chains[-1].insert(0, (row["part"], row["conv_id"], vector))
        vector = row["starts"][vector]
        follower = row
    return [c for c in chains if len(c) > 1]


def repair(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The edits of every row, and the conversations that lie in several partitions (part, conv_id).

    One row per different row, in order within a partition: part, pos, conv_id, turn, role, text, copies (how often it is there;
    all but the first are deleted), fault, edits (inserts before it, its own, deletes of its copies, inserts after the last row),
    new_role (null: deleted), inserted and appended (roles of empty rows put in before and after it).
    """
    spark = rows.sparkSession
    rows = _faults(rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("bigint").alias("turn"),
                               *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text"))]))
    order = ["conv_id", "turn", "role", "text"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = cut(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    narrow = ordered.select("part", "conv_id", "symbol")
    kind = rows.schema["conv_id"].dataType
    edge_schema = T.StructType([*T.StructType.fromDDL("part int, place int").fields, T.StructField("conv_id", kind),
                                *T.StructType.fromDDL("starts array<bigint>").fields])
    # At most two segments a partition, whatever its size.
    chains = _chains(sorted(narrow.mapInArrow(_edge_vectors, edge_schema).collect(), key=lambda r: (r["part"], r["place"])))
    inside = spark.sparkContext.broadcast({(part, conv): vector for chain in chains for part, conv, vector in chain})

    def states(batches: Iterator) -> Iterator:
        """For segments of such conversations: the state at the end for each at the start."""
        import pyarrow as pa

        for held, ids, edges in _segments(batches):
            symbols, part = _values(held, "symbol"), held[0].column("part")[0].as_py()
            for low, high in zip(edges, edges[1:]):
                vector = inside.value.get((part, ids[low]))
                if vector is not None:
                    ends = [tables().trace(_kept(symbols[low:high]), vector, s)[1] for s in range(4)]
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([ids[low]], held[0].schema.field("conv_id").type),
                                                      pa.array([ends], pa.list_(pa.int64()))], names=["part", "conv_id", "ends"])

    given: dict[tuple, tuple[int, int, bool]] = {}  # vector at the end, state at the start, whether the conversation ends here
    if chains:
        states_schema = T.StructType([*T.StructType.fromDDL("part int").fields, T.StructField("conv_id", kind), *T.StructType.fromDDL("ends array<bigint>").fields])
        ends = {(r["part"], r["conv_id"]): r["ends"] for r in narrow.mapInArrow(states, states_schema).collect()}
        for chain in chains:
            state = START
            for part, conv, vector in chain:
                given[part, conv] = (vector, state, (part, conv) == chain[-1][:2])
                state = ends[part, conv][state]
    known = spark.sparkContext.broadcast(given)

    def traced(batches: Iterator) -> Iterator:
        import pyarrow as pa

        pos = 0
        for held, ids, edges in _segments(batches):
            part, symbols, copies, roles = held[0].column("part")[0].as_py(), *(_values(held, c) for c in ("symbol", "copies", "role"))
            edits, new_role, inserted, appended = [], [], [], []
            for low, high in zip(edges, edges[1:]):
                vector, state, ends_here = known.value.get((part, ids[low]), (0, START, True))
                steps, state = tables().trace(_kept(symbols[low:high]), vector, state)
                step = iter(steps)
                for i in range(low, high):
                    own, states = next(step) if symbols[i] is not None else ("D", [])
                    kept = own[-1] != "D"
                    edits.append(own + "D" * (copies[i] - 1))
                    new_role.append((roles[i] if own[-1] == "K" else NAMES[states[-1]]) if kept else None)
                    inserted.append([NAMES[s] for s in (states[:-1] if kept else states)])
                    appended.append([])
                if ends_here:
                    appended[-1] = [NAMES[s] for s in tables().closing(state)]
                    edits[-1] += "I" * len(appended[-1])
            low = 0
            for batch in held:
                mine = slice(low, low + batch.num_rows)
                low = mine.stop
                cols = [c for c in batch.schema.names if c != "symbol"]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in cols], pa.array(range(pos, pos + batch.num_rows), pa.int64()), pa.array(edits[mine], pa.string()),
                     pa.array(new_role[mine], pa.string()), pa.array(inserted[mine], pa.list_(pa.string())), pa.array(appended[mine], pa.list_(pa.string()))],
                    names=[*cols, "pos", "edits", "new_role", "inserted", "appended"])
                pos += batch.num_rows

    schema = T.StructType([*[f for f in ordered.schema.fields if f.name != "symbol"], *T.StructType.fromDDL(f"pos bigint, {EDITED}").fields])
    spanning = spark.createDataFrame([(part, conv) for part, conv in given], T.StructType([*T.StructType.fromDDL("part int").fields, T.StructField("conv_id", kind)]))
    return ordered.mapInArrow(traced, schema), spanning


DIGEST = ("gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string")


class Digest:
    """Figures of one conversation, taken row by row."""

    def __init__(self):
        self.sha, self.lines, self.audit = hashlib.sha256(), 0, []
        self.blank = self.duplicate = self.truncated = self.illegal = self.cost = self.turns = 0
        self.first = self.turn = self.initial = None

    def line(self, role: str, text: bytes) -> None:
        self.sha.update(b"\n" * (self.lines > 0) + role.encode() + b":")
        self.sha.update(text)
        self.lines += 1

    def add(self, turn, role, text: bytes, copies, fault, edits, new_role, inserted, appended) -> None:
        if fault == "blank":
            self.blank += copies
        else:
            self.duplicate += copies - 1 + (fault == "duplicate")
            self.truncated += fault == "truncated"
        initial = role[:1]
        self.illegal += copies - 1 + (self.initial is not None and self.initial + initial not in ("su", "ua", "au"))
        self.initial = initial
        if turn is not None and turn != self.turn:
            self.first = turn if self.first is None else self.first
            self.turn, self.turns = turn, self.turns + 1
        self.audit.append(edits)
        self.cost += (REROLE * edits.count("R") + DELETE * edits.count("D") + INSERT * edits.count("I")
                      + TRUNCATED * (fault == "truncated" and new_role is not None))
        for r in inserted:
            self.line(r, b"")
        if new_role is not None:
            self.line(new_role, text)
        for r in appended:
            self.line(r, b"")

    def row(self) -> tuple:
        gaps = self.turn - self.first + 1 - self.turns if self.turns else 0
        return min(gaps, (1 << 63) - 1), self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest()


def digests(repaired: DataFrame, spanning: DataFrame) -> DataFrame:
    """Per conversation with rows: conv_id, gaps, counts of faults, illegal neighbours, cost, audit, repaired_sha256.

    Conversations within one partition are digested there. Rows of those in several ones are brought together in order and
    streamed through a running digest, as SHA-256 reads its bytes one after another; no more than a batch is held.
    """
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def record(ids: list, rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows))
            kinds = [pa.int64()] * 6 + [pa.string()] * 2
            return pa.RecordBatch.from_arrays([pa.array(ids, kind), *[pa.array(c, k) for c, k in zip(cols, kinds)]],
                                              names=["conv_id", *[c.split()[0] for c in DIGEST.split(", ")]])

        now, current, kind = None, None, None
        for batch in batches:
            kind, ids, rows = batch.schema.field("conv_id").type, [], []
            columns = [batch.column(c) for c in ("turn", "role", "text", "copies", "fault", "edits", "new_role", "inserted", "appended")]
            columns[2] = columns[2].cast(pa.binary())
            for conv, *row in zip(batch.column("conv_id").to_pylist(), *[c.to_pylist() for c in columns]):
                if now is None or conv != current:
                    if now is not None:
                        ids.append(current)
                        rows.append(now.row())
                    now, current = Digest(), conv
                now.add(*row)
            if ids:
                yield record(ids, rows)
        if now is not None:
            yield record([current], [now.row()])

    schema = T.StructType([repaired.schema["conv_id"], *T.StructType.fromDDL(DIGEST).fields])
    marks = F.broadcast(spanning.select(F.col("part").alias("p"), F.col("conv_id").alias("c")))  # at most two rows a partition
    inside = (F.col("part") == F.col("p")) & F.col("conv_id").eqNullSafe(F.col("c"))
    alone = repaired.join(marks, inside, "left_anti")
    several = repaired.join(marks, inside, "left_semi").repartition("conv_id").sortWithinPartitions("conv_id", "part", "pos")
    return alone.mapInArrow(run, schema).unionByName(several.mapInArrow(run, schema))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults of known places: by crc32 of ``conv_id:turn`` rows go, lose text or marks, repeat or change role."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), one("role").alias("role"), one("text").alias("text"),
                                (F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")) % 20).alias("kind")).filter("kind <> 0")
    kind: Column = F.col("kind")
    return rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")).drop("copy")


def audited(conversations: DataFrame) -> DataFrame:
    """The digest of every conversation of a table after damage and repair; zeros where no row is left."""
    found = digests(*repair(damaged(conversations)))
    every = conversations.select(F.col("conv_id").alias("of")).distinct()
    rows = every.join(found, F.col("of").eqNullSafe(F.col("conv_id")) & F.col("audit").isNotNull(), "left")
    numbers = [F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return rows.select(F.col("of").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"),
                       F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
