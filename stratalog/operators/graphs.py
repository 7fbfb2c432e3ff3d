"""Graph analyses as DataFrame loops: each round joins only what the last one found, and is written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..session import written


def grow(seed: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame], name: str = "grow") -> DataFrame:
    """The least set that holds seed and step's rows of it. step(new, all) gives rows that have a premise in `new`, columns as seed's."""
    columns = seed.columns
    pieces = [written(seed.distinct(), name)]
    new = pieces[0]
    while not new.isEmpty():
        every = pieces[0]
        for p in pieces[1:]:
            every = every.union(p)
        if len(pieces) > 8:
            pieces = [every := written(every, name)]
        made = step(new, every).select(columns).distinct().alias("made")
        known = every.alias("known")
        new = written(made.join(known, [F.col(f"made.{c}").eqNullSafe(F.col(f"known.{c}")) for c in columns], "left_anti"), name)
        pieces.append(new)
    out = pieces[0]
    for p in pieces[1:]:
        out = out.union(p)
    return out


def _edges(edges: DataFrame, *names: str) -> DataFrame:
    return edges.toDF(*names)


def closure(edges: DataFrame) -> DataFrame:
    """(a, b): b is reached from a by one edge or more. Paths double, so rounds grow with the logarithm of the depth."""

    def step(new, every):
        ahead = new.join(_edges(every, "b", "c"), "b").select("a", F.col("c").alias("b"))
        back = _edges(every, "a", "m").join(_edges(new, "m", "b"), "m").select("a", "b")
        return ahead.union(back)

    return grow(_edges(edges, "a", "b").where("a IS NOT NULL AND b IS NOT NULL"), step, "closure")


def reach(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node): the seeds and what edges reach from them."""
    arcs = _edges(edges, "node", "next")
    return grow(seeds.toDF("node"), lambda new, _: new.join(arcs, "node").select(F.col("next").alias("node")), "reach")


def reach_from(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(a, b) of the closure for the seeds a alone."""
    arcs = _edges(edges, "b", "next")
    first = seeds.toDF("a").join(_edges(edges, "a", "b"), "a").select("a", "b")
    return grow(first, lambda new, _: new.join(arcs, "b").select("a", F.col("next").alias("b")), "reach")


def groups(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, root): the least node of each node's undirected component. Labels sink along edges and are followed twice a round."""
    arcs = _edges(edges, "x", "y").where("x IS NOT NULL AND y IS NOT NULL AND x <> y")
    both = written(arcs.union(arcs.select("y", "x")).distinct(), "arcs")
    label = written(nodes.toDF("node").union(both.select("x")).distinct().select("node", F.col("node").alias("root")), "roots")
    while True:
        seen = both.join(label, F.col("y") == F.col("node")).groupBy(F.col("x").alias("node")).agg(F.min("root").alias("near"))
        low = label.join(seen, "node", "left").select("node", "root", F.least("root", "near").alias("low"))
        jump = label.select(F.col("node").alias("low"), F.col("root").alias("far"))
        after = written(low.join(jump, "low", "left").select("node", F.col("root").alias("was"), F.least("low", "far").alias("root")), "roots")
        label = after.select("node", "root")
        if after.where(~F.col("was").eqNullSafe(F.col("root"))).isEmpty():
            return label


def dominators(nodes: DataFrame, edges: DataFrame, entries: DataFrame) -> DataFrame:
    """(a, b): every path from the function's entry to b passes a. nodes, entries: (fn, node); edges: (a, b). Nodes that no entry reaches are left out."""
    own, entry = nodes.toDF("fn", "node"), entries.toDF("fn", "entry")
    live = reach(edges, entry.select("entry"))
    arcs = _edges(edges, "at", "next")
    # paths from the entry that avoid `a`
    first = own.join(entry, "fn").where("node <> entry").select(F.col("node").alias("a"), F.col("entry").alias("at"))
    around = grow(first, lambda new, _: new.join(arcs, "at").where("next <> a").select("a", F.col("next").alias("at")), "avoid")
    pairs = own.select("fn", F.col("node").alias("a")).join(own.select("fn", F.col("node").alias("b")).join(live.toDF("b"), "b"), "fn").select("a", "b")
    return pairs.join(around.toDF("a", "b"), ["a", "b"], "left_anti")


def back_edges(edges: DataFrame, dominates: DataFrame) -> DataFrame:
    """(a, b): edges to a node that dominates their start."""
    return _edges(edges, "a", "b").join(dominates.toDF("b", "a"), ["a", "b"], "left_semi")


def reaching(defines: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, definition, var): definitions that reach a node's begin. defines: (node, var); edges: (a, b)."""
    defs, arcs = defines.toDF("node", "var"), _edges(edges, "at", "node")
    kills = defs.distinct()
    start = defs.select(F.col("node").alias("at"), F.col("node").alias("definition"), "var").join(arcs, "at").select("node", "definition", "var")

    def step(new, _):
        out = new.join(kills, ["node", "var"], "left_anti").select(F.col("node").alias("at"), "definition", "var")
        return out.join(arcs, "at").select("node", "definition", "var")

    return grow(start, step, "reaching")


def live(uses: DataFrame, defines: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, var): variables whose value at a node's begin may still be used."""
    arcs, kills = _edges(edges, "node", "next"), defines.toDF("node", "var").distinct()

    def step(new, _):
        out = arcs.join(new.select(F.col("node").alias("next"), "var"), "next").select("node", "var")
        return out.join(kills, ["node", "var"], "left_anti")

    return grow(uses.toDF("node", "var"), step, "live")


def live_out(live_in: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, var): what is live at some successor's begin."""
    return _edges(edges, "node", "next").join(live_in.toDF("next", "var"), "next").select("node", "var").distinct()
