"""Exact top-k by inner product of quantised vectors: aggregation of sorted lists without random access."""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .vectors import BLOCK, QUERIES, best_pairs, blocks, groups_for, prepared, search, shape


class Lists:
    """A block's candidates as one sorted list for each dimension: values ascending, and whose they are.

    A list is read from its high end for queries with a positive component there, from its low end for negative ones.
    """

    def __init__(self, ids: np.ndarray, values: np.ndarray, order: np.ndarray):
        self.ids, self.values, self.order = ids, values, order

    @classmethod
    def build(cls, ids: np.ndarray, x: np.ndarray) -> "Lists":
        order = np.argsort(x, axis=0, kind="stable").T
        return cls(ids, np.take_along_axis(x.T, order, 1), order.astype(np.int32))

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, ids=self.ids, values=self.values.astype(np.int32) if self.values.size and np.abs(self.values).max() < 2**31 else self.values, order=self.order)
        return out.getvalue()

    @classmethod
    def load(cls, body: bytes) -> "Lists":
        z = np.load(io.BytesIO(body))
        return cls(z["ids"], z["values"].astype(np.float64), z["order"])

    def read(self, depth: int, kind) -> tuple[np.ndarray, np.ndarray]:
        """(high, low): dimensions x candidates, with what `depth` entries from each list's high and low end tell,
        and the last value read in place of what is unread: the most, and the least, that it can be."""
        n = self.values.shape[1]
        high = np.repeat(self.values[:, n - depth, None], n, 1).astype(kind)
        low = np.repeat(self.values[:, depth - 1, None], n, 1).astype(kind)
        np.put_along_axis(high, self.order[:, n - depth :], self.values[:, n - depth :].astype(kind), 1)
        np.put_along_axis(low, self.order[:, :depth], self.values[:, :depth].astype(kind), 1)
        return high, low

    def rows(self) -> np.ndarray:
        x = np.empty_like(self.values)
        np.put_along_axis(x, self.order, self.values, 1)
        return x.T


def aggregate(lists: Lists, q: np.ndarray, query_ids: np.ndarray, known: np.ndarray, k: int):
    """Pairs (query number, candidate number, score) among which are each query's k best of the block, if they reach known[query],
    a lower bound for its k-th best score. Reads the lists round by round, deeper each time.

    In a round a candidate's upper bound has the last value read for what is unread, its lower bound the list's far end. The k-th best lower
    bound raises `known`. Unread candidates and seen ones alike are out when their upper bound is below it. The rounds stop when few pairs
    are left, outsiders among them can't qualify; those pairs' scores are resolved from the lists' remaining entries.
    """
    n = len(lists.ids)
    most = float(np.abs(lists.values).max(initial=0)) * float(np.abs(q).max(initial=0)) * q.shape[1]
    if most >= 2**53:  # beyond exact doubles: Python's integers, all pairs
        x = [[int(v) for v in row] for row in lists.rows()]
        exact = [(i, j, sum(int(a) * b for a, b in zip(row, x[j]))) for i, row in enumerate(q) for j in range(n) if lists.ids[j] != query_ids[i]]
        qi, ci, s = (np.array([e[i] for e in exact], dtype=object if i == 2 else np.int64) for i in range(3))
        return qi, ci, s
    kind = np.float32 if most < 2**24 else np.float64
    up, down = np.maximum(q, 0).astype(kind), np.minimum(q, 0).astype(kind)
    own = lists.ids[None, :] == query_ids[:, None]
    whole = None
    for depth in dict.fromkeys(max(1, n * f // 8) for f in (3, 5, 8)):
        high, low = lists.read(depth, kind)
        upper = up @ high + down @ low
        upper[own] = -np.inf
        if depth == n:
            lower, whole = upper, upper
        elif np.isinf(known).any():
            far = far_ends(lists, depth, high, low, kind)
            lower = up @ far[0] + down @ far[1]
            lower[own] = -np.inf
        else:
            lower = None
        if lower is not None and n >= k:
            known = np.maximum(known, np.partition(lower, n - k, axis=1)[:, n - k])
        left = upper >= known[:, None]
        left &= ~own
        if whole is not None or left.sum() <= max(4 * k * len(q), left.size // 40):
            break
    qi, ci = np.nonzero(left)
    if whole is not None:
        return qi, ci, whole[qi, ci].astype(np.int64)
    x, score = lists.rows(), np.empty(len(qi), np.int64)
    for a in range(0, len(qi), 65536):
        s = slice(a, a + 65536)
        score[s] = np.einsum("ij,ij->i", q[qi[s]], x[ci[s]])
    return qi, ci, score


def far_ends(lists: Lists, depth: int, high: np.ndarray, low: np.ndarray, kind):
    """The same matrices with each list's far end in place of what is unread."""
    n = lists.values.shape[1]
    far_high = np.repeat(lists.values[:, :1], n, 1).astype(kind)
    far_low = np.repeat(lists.values[:, -1:], n, 1).astype(kind)
    for far, src, own in ((far_high, high, lists.order[:, n - depth :]), (far_low, low, lists.order[:, :depth])):
        np.put_along_axis(far, own, np.take_along_axis(src, own, 1), 1)
    return far_high, far_low


def top_k(table: DataFrame, each: int = 20, k: int = 20, scale: float = 64.0) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose vec_id `each` divides, against all others; score: inner product of floor(scale * x).

    table: vec_id, embedding; other columns are ignored. Vectors that are null or hold null or non-finite components, and null vec_ids, take no part;
    shorter vectors count as followed by zeros. Rows of one vec_id are candidates each, but never for a query of that id; a query id
    that repeats is answered once, over all its vectors. Ties go to the smaller vec_id. No rows, no answers.
    Components too large for exact doubles are multiplied as Python integers; a score beyond 64 bits raises OverflowError.
    """
    rows = prepared(table, True, "vectors")
    count, asked, dim = shape(rows, each)
    quantised = lambda x: np.floor(scale * x)

    def body(ids, x):
        return Lists.build(ids, quantised(x)).dump()

    def question(ids, x):
        out = io.BytesIO()
        np.savez(out, ids=ids, x=quantised(x))
        return out.getvalue()

    def look(bodies, body):
        z = np.load(io.BytesIO(body))
        q, ids = z["x"], z["ids"]
        known, best = np.full(len(ids), -np.inf), None
        for b in bodies:
            lists = Lists.load(b)
            qi, ci, s = aggregate(lists, q, ids, known, k)
            found = (qi, lists.ids[ci], s)
            best = best_pairs(*(found if best is None else (np.concatenate(x) for x in zip(best, found))), k)
            full = np.flatnonzero(np.bincount(best[0], minlength=len(ids)) == k)
            stop = np.searchsorted(best[0], full, "right") - 1
            known[full] = best[2][stop].astype(float)
        return ids[best[0]], best[1], best[2]

    lists = blocks(rows, count, BLOCK, dim, body)
    asking = blocks(rows.where(F.col("vec_id") % each == 0), asked, QUERIES, dim, question)
    return search(lists, asking, groups_for(count), k, look, "long")
