"""Blocked search of a stated set of query vectors against all vectors: what exact and approximate search share."""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

import numpy as np
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .common import ship, written

#: Vectors in a block, blocks that a task holds at once, queries in a block.
BLOCK, HELD, QUERIES = 4096, 2, 512


def usable(table: DataFrame, zero: bool) -> DataFrame:
    """vec_id, x (array of double) of the rows whose vector isn't null and has only finite components; without `zero`, only those that aren't zero."""
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    fine = F.forall("x", lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & fine)
    return rows if zero else rows.where(F.exists("x", lambda v: v != 0))


def matrix(column, dim: int) -> np.ndarray:
    """Rows of a list column, shorter ones followed by zeros."""
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), dim))
    at = np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    out[at] = flat
    return out


def blocks(rows: DataFrame, count: int, size: int, dim: int, pack: Callable[[np.ndarray, np.ndarray], bytes]) -> DataFrame:
    """(block, body): blocks of up to `size` vectors in ascending vec_id order; pack(ids, matrix) makes a body."""
    ship(rows.sparkSession)

    def packed(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, seq, ids, held = TaskContext.get().partitionId(), 0, np.zeros(0, np.int64), np.zeros((0, dim))

        def body(n):
            nonlocal seq, ids, held
            row = pa.RecordBatch.from_pydict({"block": pa.array([part << 20 | seq], pa.int64()), "body": pa.array([pack(ids[:n], held[:n])], pa.binary())})
            seq, ids, held = seq + 1, ids[n:], held[n:]
            return row

        for batch in batches:
            for a in range(0, batch.num_rows, size):
                ids = np.concatenate([ids, batch.column("vec_id").slice(a, size).to_numpy()])
                held = np.concatenate([held, matrix(batch.column("x").slice(a, size), dim)])
                while len(ids) >= size:
                    yield body(size)
        if len(ids):
            yield body(len(ids))

    return rows.repartitionByRange(max(1, ceil(count / size)), "vec_id").sortWithinPartitions("vec_id").mapInArrow(packed, "block long, body binary")


def search(candidates: DataFrame, queries: DataFrame, groups: int, k: int, look: Callable, kind: str) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best, ties to the smaller vec_id.

    Blocks of candidates are dealt into groups of a bounded number of vectors, blocks of queries go to every group, and a task holds one
    group at a time: look(bodies of the group, in order, body of a query block) gives its best k as (query ids, vec_ids, scores). kind: the score's type.
    """
    ship(candidates.sparkSession)
    held = candidates.select(F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int").alias("group"), F.lit(0).alias("what"), "block", "body")
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(1).alias("what"), "block", "body")

    def found(batches):
        import pyarrow as pa

        now, bodies = None, []
        for batch in batches:
            for group, what, body in zip(*(batch.column(c).to_pylist() for c in ("group", "what")), batch.column("body")):
                if group != now:
                    now, bodies = group, []
                if what == 0:
                    bodies.append(body.as_py())
                elif bodies:
                    q, v, s = look(bodies, body.as_py())
                    yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64() if kind == "double" else pa.int64())], ["query_id", "vec_id", "score"])

    near = held.unionByName(asked).repartition(groups, "group").sortWithinPartitions("group", "what", "block").mapInArrow(found, f"query_id long, vec_id long, score {kind}")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def groups_for(count: int) -> int:
    return max(1, ceil(count / (BLOCK * HELD)))


def best_pairs(q: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int):
    """Of pairs (query number, id, score) each query's k best, by score, then id."""
    order = np.lexsort((ids, -scores if scores.dtype != object else np.array([-s for s in scores]), q))
    q, ids, scores = q[order], ids[order], scores[order]
    first = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, int)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    keep = rank < k
    return q[keep], ids[keep], scores[keep]


def shape(rows: DataFrame, each: int) -> tuple[int, int, int]:
    """(vectors, queries among them, longest vector)."""
    r = rows.agg(F.count(F.lit(1)), F.count_if(F.col("vec_id") % each == 0), F.max(F.size("x"))).first()
    return r[0], r[1], r[2] or 0


def prepared(table: DataFrame, zero: bool, name: str) -> DataFrame:
    return written(usable(table, zero), name)
