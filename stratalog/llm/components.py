"""Connected components of an edge table, without a task that holds a component."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import ship, written


def union(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) for the nodes of the edges (a[i], b[i]) that aren't least themselves."""
    nodes, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = code[: len(a)], code[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = np.minimum(new, new[label])
        while (nxt := new[new]).tobytes() != new.tobytes():
            new = nxt
        if (new == label).all():
            break
        label = new
    rest = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[rest], nodes[label[rest]]


def _stars(edges: DataFrame) -> DataFrame:
    """Each partition's edges as stars around the least node of what they join within it: as many components, fewer edges."""

    def rows(batches):
        import pyarrow as pa

        held, n = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            n += batch.num_rows
            if n > 1_000_000:
                held = [union(*(np.concatenate(x) for x in zip(*held)))]
                if len(held[0][0]) > 500_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in held[0]], ["u", "v"])
                    held = []
                n = sum(len(x) for x, _ in held)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in union(*(np.concatenate(x) for x in zip(*held)))], ["u", "v"])

    return edges.mapInArrow(rows, "u long, v long")


def _flat(stars: DataFrame) -> bool:
    """Whether every node has one edge up at most, and none whose node has edges down."""
    ends = stars.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(stars.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up = 1 AND down = 1").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (least node of it) for each node of the edges (a, b: longs; no nulls); loops alone give nothing.

    What meets in a partition is joined there; then alternating large and small stars: every round points a node's larger neighbours, then
    its smaller ones, to the least neighbour, until each node points to its component's least node. Rounds are written, so lineage doesn't
    grow, and so that a hub's edges come to the join straight from their shuffle, which AQE can split.
    """
    ship(edges.sparkSession)
    own = edges.select(F.greatest(*edges.columns[:2]).alias("u"), F.least(*edges.columns[:2]).alias("v")).where("u <> v")
    stars = written(_stars(_stars(own).distinct()), "edges")
    while not _flat(stars):
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m")), "least")
        large = written(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        stars = written(_stars(small.distinct()), "edges")
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
