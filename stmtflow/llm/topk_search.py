"""Operator 8: exact top-k inner-product search by columnar branch and bound.

Vectors are cut into candidate blocks and query blocks of a fixed number of rows; each
pair of blocks is one task-sized piece of work. Inside a piece the candidates lie
vertically, one dimension after another, and scores are accumulated one block of
dimensions at a time. After a block, the best possible rest of a candidate is the product
of the remaining norms of query and candidate; candidates that cannot reach the query's
current k-th score are dropped and the survivors are compacted before the next block.
Norms are compared in 64-bit floats with a margin above their rounding, scores are
integers, so the result is exact. The k best of each piece are merged per query.

Cases: vectors that are null or hold a null or non-finite component take no part, as
queries or candidates, and neither do rows without an id; exactly repeated rows count
once; vectors of another length than the query's are not candidates for it; ties go to
the smaller id; components so large that a score may not fit 64 bits are refused with an error; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

K = 20
SCALE = 64
BLOCK_ROWS = 4096
DIMENSIONS = 16
RESULT = "query_id bigint, vec_id bigint, score bigint"


def quantized(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, v: floor(scale * x) of each component, for the vectors that take part."""
    v = F.col(vec_col).cast("array<double>")
    usable = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.when(usable, v).alias("v"))
            .filter("vec_id IS NOT NULL AND v IS NOT NULL")
            .select("vec_id", F.transform("v", lambda x: F.floor(x * scale)).alias("v"), F.array_max(F.transform("v", lambda x: F.abs(x * scale) + 1)).alias("most"))
            .distinct())


def check_range(rows: DataFrame) -> None:
    """Refuse components whose scores may not fit 64 bits."""
    most, dims = rows.agg(F.max("most"), F.max(F.size("v"))).first()
    if most is not None and most * most * dims >= 2 ** 62:
        raise ValueError(f"components of up to {most:g} in {dims} dimensions give scores beyond 64 bits")


def branch_and_bound(q_ids, queries, ids, candidates, k: int, step: int = DIMENSIONS) -> list[tuple]:
    """(query position, candidate id, score) of the k best candidates of each query."""
    dims, n = candidates.shape[1], len(ids)
    most = max(np.abs(candidates).max(initial=0), np.abs(queries).max(initial=0))
    if float(most) ** 2 * dims < 2**52:  # every partial sum is exact in a 64-bit float, which multiplies faster
        candidates, queries = candidates.astype(float), queries.astype(float)
    columns = np.ascontiguousarray(candidates.T)  # vertical layout
    squares = np.zeros((dims + 1, n))
    squares[:dims] = np.cumsum((columns.astype(float) ** 2)[::-1], axis=0)[::-1]
    rest_c = np.sqrt(squares)
    rest_q = np.sqrt(np.concatenate([np.cumsum((queries.astype(float) ** 2)[:, ::-1], axis=1)[:, ::-1],
                                     np.zeros((len(queries), 1))], axis=1))
    # The candidates of largest norm come first: their full scores give the first threshold.
    lead = np.argsort(-rest_c[0], kind="stable")[: 4 * k]
    lead_scores = queries @ columns[:, lead]
    found = []
    for i, query in enumerate(queries):
        own = ids[lead] != q_ids[i]
        seen = lead_scores[i][own]
        floor = np.partition(seen, len(seen) - k)[len(seen) - k] if len(seen) >= k else None
        alive, score = np.flatnonzero(ids != q_ids[i]), None
        for at in range(0, dims, step):
            to = min(at + step, dims)
            block = columns[at:to] if len(alive) == n else columns[at:to, alive]
            part = query[at:to] @ block
            score = part if score is None else score + part
            if to < dims:
                bound = score + rest_q[i, to] * rest_c[to, alive] * (1 + 1e-9) + 1e-6
                if len(alive) > k:
                    low = score - rest_q[i, to] * rest_c[to, alive] * (1 + 1e-9) - 1e-6
                    sure = np.partition(low, len(low) - k)[len(low) - k]
                    floor = sure if floor is None else max(floor, sure)
                if floor is not None:
                    stay = bound >= floor
                    alive, score = alive[stay], score[stay]
        if score is None:
            score = np.zeros(len(alive))
        best = np.lexsort((ids[alive], -score))[:k]
        found += [(i, int(ids[alive[j]]), int(score[j])) for j in best]
    return found


def unpack(rows: list, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(r) for r in rows), dtype="<i8").reshape(-1, dims)


def top_k(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding",
          scale: int = SCALE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best others for every query row.

    ``is_query`` is a condition on ``vec_id``. Blocks are numbered by a hash of the id, as many
    as the row count asks for, so a block stays near ``block_rows`` rows at any size.
    """
    rows = cut(quantized(vectors, id_col, vec_col, scale).withColumn("dims", F.size("v")))
    check_range(rows)
    rows = rows.select("vec_id", F.col("v").cast("array<int>").alias("v"), "dims")  # the range leaves 31 bits at most
    counted = rows.groupBy("dims").agg(F.count(F.lit(1)).alias("n"), F.sum(is_query.cast("int")).alias("q"))
    counted = counted.select(F.col("dims").alias("of"), F.ceil(F.col("n") / block_rows).alias("c_blocks"),
                             F.ceil(F.col("q") / block_rows).alias("q_blocks"))
    rows = rows.join(counted, F.col("dims") == F.col("of"))
    hashed = F.xxhash64("vec_id")
    members = F.sort_array(F.collect_list(F.struct("vec_id", "v")))
    # One row per block: bounded by block_rows vectors; pieces meet by an equality join on the block numbers.
    queries = (rows.filter(is_query & (F.col("q_blocks") > 0))
               .groupBy("dims", "c_blocks", F.pmod(hashed, F.col("q_blocks")).alias("qb"))
               .agg(members.alias("queries"))
               .withColumn("cb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("c_blocks") - 1))))
    candidates = (rows.filter("q_blocks > 0")
                  .groupBy("dims", "q_blocks", F.pmod(hashed, F.col("c_blocks")).alias("cb"))
                  .agg(members.alias("candidates"))
                  .withColumn("qb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("q_blocks") - 1))))
    pieces = (queries.join(candidates, ["dims", "qb", "cb"]).select("dims", "queries", "candidates"))

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                dims = batch.column(0)[i].as_py()
                sides = []
                for c in (1, 2):
                    inner = batch.column(c).slice(i, 1).flatten()
                    ids = inner.field(0).to_numpy(zero_copy_only=False)
                    flat = inner.field(1).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), dims)
                    sides.append((ids.astype(np.int64), flat.astype(np.int64)))
                (q_ids, q), (ids, c) = sides
                found = branch_and_bound(q_ids, q, ids, c, k)
                if found:
                    pos, vec, score = zip(*found)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(q_ids[list(pos)]), pa.array(vec, pa.int64()), pa.array(score, pa.int64())],
                        names=["query_id", "vec_id", "score"])

    found = pieces.mapInArrow(work, RESULT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
