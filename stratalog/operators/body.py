"""Rule bodies as DataFrames.

While a body is compiled, a DataFrame holds one column v_<name> for each bound variable. Positive atoms join on equality, so
absent never matches; negated atoms are anti-joins on null-safe equality; folds run once for all distinct keys of the outer rows and
are joined back null-safe, so that empty groups have a result.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.scalars import component, compile_expression, literal, truncate, wrong
from ..functions.values import SPARK
from ..plans.analysis import Builtin, Fold, Relation, Rule, is_wild, needs
from ..plans.syntax import Compare, Const, Negative, Positive, Presence, Var, renamed, variables


def col(name: str) -> Column:
    return F.col(f"v_{name}")


class Bodies:
    """Compiles literals over the relations' DataFrames (columns c0, c1, …)."""

    def __init__(self, spark: SparkSession, relations: dict[str, Relation], table: Callable[[str], DataFrame], defined: Callable[[str], Rule | None] = lambda n: None, rows: Callable[[str], DataFrame] | None = None):
        """defined(name): the one rule that is all there is to a relation; rows(name): its rows, where repeated ones don't matter."""
        self.spark, self.relations, self.table, self.defined, self.rows = spark, relations, table, defined, rows or table
        self.skipped: list = []  # what aggregates skip, for the report: (rule number, fold, frame of counts)

    def one(self) -> DataFrame:
        return self.spark.range(1).select(F.lit(True).alias("v_"))

    def rule(self, rule: Rule, tables: dict[int, DataFrame] | None = None, start: DataFrame | None = None) -> DataFrame:
        """The head's rows (not yet distinct), columns c0, c1, …; tables: replacements by literal position."""
        frame = self.body(rule.body, rule.types, variables(rule.head), tables, start)
        return frame.select(*[self.term(a, i, rule) for i, a in enumerate(rule.head.args)])

    def term(self, a, i: int, rule: Rule) -> Column:
        kind = (self.relations[rule.head.name].types if rule.nr >= 0 else [rule.types.get(a.name, "string") if isinstance(a, Var) else "bool"] * (i + 1))[i]
        return (col(a.name) if isinstance(a, Var) else literal(a.value)).cast(SPARK[kind]).alias(f"c{i}")

    def body(self, body, types, wanted: set[str], tables=None, start: DataFrame | None = None, keep: bool = False) -> DataFrame:
        """keep: every variable stays, wildcards too (an aggregate's goal counts assignments)."""
        frame, first = start, 0
        if start is None and not tables and not keep:
            for k, x in enumerate(body):
                if isinstance(x, Fold):
                    later = wanted.union(*(variables_in(y) for y in body[k + 1 :]), set())
                    if later & set().union(*map(variables_in, body[:k])) <= set(x.keys) and (tests := self.own_goal(body[:k], x)) is not None:
                        frame, first = self.grouped(x, tests, types), k + 1
                    break
        atoms = [variables(x) for x in body if isinstance(x, Positive)]
        solid = {v for a in atoms for v in a if sum(v in b for b in atoms) > 1}
        for k, x in enumerate(body[first:], first):
            later = wanted.union(*(variables_in(y) for y in body[k + 1 :]), set())
            frame = self.literal(x, frame, types, (tables or {}).get(k), None if keep else later, solid)
        return frame if frame is not None else self.one()

    def literal(self, x, frame, types, table=None, later: set[str] | None = None, solid: set[str] = frozenset()) -> DataFrame:
        if isinstance(x, Positive):
            read = self.table if later is None else self.rows
            return self.positive(x, frame, table if table is not None else read(x.atom.name), later)
        frame = frame if frame is not None else self.one()
        if isinstance(x, Negative):
            return self.negative(x, frame, table if table is not None else self.rows(x.atom.name), solid)
        if isinstance(x, Compare):
            return self.compare(x, frame, types)
        if isinstance(x, Presence):
            c, _ = compile_expression(x.of, types, col)
            return frame.where(c.isNull() if x.absent else c.isNotNull())
        if isinstance(x, Builtin):
            c, kind = compile_expression(x.of, types, col)
            return self.assign(frame, x.out, truncate(x.unit, c, kind) if x.unit else component(x.name, c))
        return self.fold(x, frame, types)

    def bound(self, frame: DataFrame | None) -> set[str]:
        return {c[2:] for c in frame.columns if c != "v_"} if frame is not None else set()

    def assign(self, frame: DataFrame, out, c: Column) -> DataFrame:
        if isinstance(out, Var) and out.name not in self.bound(frame):
            return frame.withColumn(f"v_{out.name}", c)
        return frame.where(c == (col(out.name) if isinstance(out, Var) else literal(out.value)))

    def scan(self, atom, table: DataFrame) -> tuple[DataFrame, dict[str, str]]:
        """The table filtered by the atom's constants and repeated variables, and each variable's column."""
        first: dict[str, str] = {}
        for i, a in enumerate(atom.args):
            if isinstance(a, Const):
                table = table.where(F.col(f"c{i}") == literal(a.value))
            elif a.name in first:
                table = table.where(F.col(first[a.name]) == F.col(f"c{i}"))
            else:
                first[a.name] = f"c{i}"
        return table, first

    def positive(self, x: Positive, frame, table: DataFrame, later: set[str] | None) -> DataFrame:
        table, first = self.scan(x.atom, table)
        have = self.bound(frame)
        shared = [v for v in first if v in have]
        new = [v for v in first if v not in have and (later is None or v in later)]
        own = table.select(*[F.col(first[v]).alias(f"v_{v}") for v in [*shared, *new]], *([] if shared or new else [F.lit(True).alias("v__")]))
        if frame is None:
            return own if shared or new else own.limit(1).select(F.lit(True).alias("v_"))
        if later is not None and not new:  # nothing but a test
            if not shared:
                return frame.join(own.limit(1), how="left_semi", on=F.lit(True))
            return frame.join(own, [f"v_{v}" for v in shared], "left_semi")
        if not shared:
            return frame.crossJoin(own)
        return frame.join(own, [f"v_{v}" for v in shared])

    def negative(self, x: Negative, frame: DataFrame, table: DataFrame, solid: set[str]) -> DataFrame:
        """solid: variables that two atoms share. They end up present, so plain equality does, which keeps the rows where they are."""
        have, tests = self.bound(frame), []
        for i, a in enumerate(x.atom.args):
            if isinstance(a, Const):
                table = table.where(F.col(f"c{i}").eqNullSafe(literal(a.value)))
            elif a.name in have:
                tests.append((a.name, i))
        if not tests:
            return frame.join(table.select(F.lit(True).alias("n_")).limit(1), how="left_anti", on=F.lit(True))
        right = table.select(*[F.col(f"c{i}").alias(f"n_{i}") for _, i in tests])
        on = [col(v) == F.col(f"n_{i}") if v in solid else col(v).eqNullSafe(F.col(f"n_{i}")) for v, i in tests]
        return frame.join(right, on, "left_anti")

    def compare(self, x: Compare, frame: DataFrame, types) -> DataFrame:
        have = self.bound(frame)
        if x.op == "=":
            for a, b in ((x.left, x.right), (x.right, x.left)):
                if isinstance(a, Var) and a.name not in have:
                    c, kind = compile_expression(b, types, col)
                    return frame.withColumn(f"v_{a.name}", c.cast(SPARK[types.get(a.name, kind or "string")]))
        (a, _), (b, _) = compile_expression(x.left, types, col), compile_expression(x.right, types, col)
        return frame.where({"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[x.op])

    def own_goal(self, body, x: Fold) -> list | None:
        """Where the literals before an aggregate are its own goal and tests of its keys, those tests: then each group of the goal that passes
        them is an answer, and nothing is joined."""
        atoms, tests = [], []
        for y in self.unfolded(body, set(x.keys)):
            (atoms if isinstance(y, Positive) else tests).append(y)
        goal = list(x.goal)
        if not x.keys or not all(isinstance(y, (Compare, Presence)) and variables(y) <= set(x.keys) for y in tests):
            return None
        if not all(isinstance(y, Positive) for y in goal) or not set(x.keys) <= set().union(*map(variables, goal)) or len(atoms) != len(goal) or len(goal) > 4:
            return None
        return tests if any(self.alike(atoms, p, set(x.keys)) for p in permutations(goal)) else None

    def unfolded(self, body, keys: set[str]) -> list:
        """Atoms of relations that are one rule of atoms and tests, replaced by that rule's body."""
        out = []
        for n, y in enumerate(body):
            rule = self.defined(y.atom.name) if isinstance(y, Positive) else None
            if rule is not None and all(isinstance(z, (Positive, Compare, Presence)) for z in rule.body):
                inner, outer = rule.head.args, y.atom.args
                plain = all(isinstance(a, Var) for a in (*inner, *outer)) and len({a.name for a in inner}) == len(inner)
                if plain and {a.name for a in outer} <= keys and [rule.types.get(a.name) for a in inner] == self.relations[y.atom.name].types:
                    names = {v: f"_u{n}_{v}" for z in rule.body for v in variables(z)} | {a.name: b.name for a, b in zip(inner, outer)}
                    out += self.unfolded([renamed(z, names) for z in rule.body], keys)
                    continue
            out.append(y)
        return out

    def alike(self, atoms, goal, keys: set[str]) -> bool:
        """The same atoms but for one-to-one names of what is no key."""
        names: dict[str, str] = {}
        for a, b in zip(atoms, goal):
            if a.atom.name != b.atom.name or len(a.atom.args) != len(b.atom.args):
                return False
            for v, w in zip(a.atom.args, b.atom.args):
                if isinstance(v, Const) or isinstance(w, Const):
                    if v != w or type(v.value) is not type(w.value):
                        return False
                elif v.name in keys or w.name in keys:
                    if v.name != w.name:
                        return False
                elif names.setdefault(v.name, w.name) != w.name:
                    return False
        return len(set(names.values())) == len(names)

    def grouped(self, x: Fold, tests: list, types) -> DataFrame:
        """The keys and the aggregate of every group of the goal. An absent key joins nothing, so its group is empty."""
        keys = list(x.keys)
        goal = self.body(x.goal, types, variables(x.of), keep=True)
        for y in tests:
            goal = self.literal(y, goal, types)
        found = self.totals(x, goal, types)
        joins = F.lit(True)
        for i in range(len(keys)):
            joins = joins & F.col(f"k_{i}").isNotNull()
        result = F.when(joins, F.col("f_"))
        return found.select(*[F.col(f"k_{i}").alias(f"v_{k}") for i, k in enumerate(keys)], (F.coalesce(result, F.lit(0).cast("bigint")) if x.op == "count" else result).alias(f"v_{x.out.name}"))

    def totals(self, x: Fold, goal: DataFrame, types) -> DataFrame:
        """k_0, k_1, … and f_: the aggregate of the goal's rows in each group."""
        value, kind = compile_expression(x.of, types, col)
        by = [col(k).alias(f"k_{i}") for i, k in enumerate(x.keys)]
        if kind == "float" and x.op in ("sum", "avg"):
            return float_totals(goal.select(*by, value.alias("x_")), [f"k_{i}" for i in range(len(x.keys))], x.op)
        return goal.groupBy(*by).agg(aggregate(x.op, value, kind or "int").alias("f_"))

    def fold(self, x: Fold, frame: DataFrame, types) -> DataFrame:
        keys = list(x.keys)
        seeds = frame.select(*[f"v_{k}" for k in keys]).distinct() if keys else None
        goal = self.body(x.goal, types, variables(x.of), None, seeds, keep=True)
        found = self.totals(x, goal, types)
        if not keys:
            joined = frame.crossJoin(found)
        else:
            joined = frame.join(found, [col(k).eqNullSafe(F.col(f"k_{i}")) for i, k in enumerate(keys)], "left").drop(*[f"k_{i}" for i in range(len(keys))])
        result = F.coalesce("f_", F.lit(0).cast("bigint")) if x.op == "count" else F.col("f_")
        kept = self.assign(joined.withColumn("f_", result), x.out, F.col("f_"))
        return kept.drop("f_")


def variables_in(x) -> set[str]:
    if isinstance(x, Fold):
        return set(x.keys) | {x.out.name}
    if isinstance(x, Builtin):
        return variables(x.of) | variables(x.out)
    return variables(x)


def aggregate(op: str, value: Column, kind: str) -> Column:
    """One aggregate over a goal's rows; sums and averages of floats are float_totals'. Sums of integers are exact, in decimals."""
    if op == "count":
        return F.count(F.lit(1))
    if op in ("min", "max"):
        return getattr(F, op)(value)
    if kind in ("int", "duration"):
        total = F.sum(value.cast("decimal(38,0)"))
        if op == "sum":
            low, high = (F.lit(str(v)).cast("decimal(38,0)") for v in (-(2**63), 2**63 - 1))
            return F.when(total.between(low, high), total.cast("bigint")).when(total.isNotNull(), wrong("arithmetic-error", "the sum doesn't fit 64 bits", "bigint"))
        if kind == "duration":
            return F.call_function("div", total, F.count(value).cast("decimal(38,0)")).cast("bigint")
        return total.cast("double") / F.count(value)


#: Floats are summed in windows of so many binary places; in a window a value is an integer below 2 ** (WINDOW + 57).
WINDOW, HALF = 16, 40


def shifted(x: Column, places: Column) -> Column:
    """x * 2 ** places, in two steps, as either factor alone may be out of range."""
    first = F.floor(places / 2)
    return x * F.pow(F.lit(2.0), first) * F.pow(F.lit(2.0), places - first)


def float_totals(rows: DataFrame, keys: list[str], op: str) -> DataFrame:
    """keys and f_: sum or average of the floats x_ in each group; null where none is present.

    Each value is an integer in units of its window of exponents. Integers are summed exactly in decimals, group by group and window by window, in any
    order; a group's few windows (128 at most) are then added from the largest down with a compensation, so the result is the exact sum but
    for its last place, whatever the magnitudes. A sum out of range is infinite, and one of opposite infinities an error.
    """
    finite = F.abs("x_") < float("inf")
    window = F.when(finite & (F.col("x_") != 0), F.floor(F.log2(F.abs("x_")) / WINDOW)).otherwise(0)
    placed = rows.withColumn("w_", window.cast("int")).withColumn("v_", F.when(finite, shifted(F.col("x_"), F.lit(56) - F.col("w_") * WINDOW)))
    high = F.floor(F.col("v_") / float(1 << HALF))
    parts = [("h_", high), ("l_", (F.col("v_") - high * float(1 << HALF)).cast("bigint"))]
    sums = [F.sum(c.cast("decimal(38,0)")).alias(n) for n, c in parts]
    each = placed.groupBy(*keys, "w_").agg(*sums, F.count("x_").alias("n_"), F.sum(F.when(~finite, F.col("x_"))).alias("odd_"))
    whole = each.groupBy(*keys).agg(F.collect_list(F.when(F.col("h_").isNotNull(), F.struct("w_", "h_", "l_"))).alias("p_"), F.sum("n_").alias("n_"), F.sum("odd_").alias("odd_"))

    def doubles(p):
        # h and l may be long; each gives two doubles that hold it exactly
        unit = F.lit(str(1 << HALF)).cast("decimal(38,0)")
        out = []
        for name, base in (("h_", HALF), ("l_", 0)):
            upper = F.call_function("div", p[name], unit)
            out += [(upper.cast("bigint").cast("double"), base + HALF), ((p[name] - upper.cast("decimal(20,0)") * unit).cast("bigint").cast("double"), base)]
        return F.array(*[shifted(c, p["w_"] * WINDOW + F.lit(place - 56)) for c, place in out])

    terms = F.array_sort(F.flatten(F.transform("p_", doubles)), lambda a, b: F.signum(F.abs(b) - F.abs(a)).cast("int"))

    def add(acc, x):
        t = acc["s"] + x
        lost = F.when(F.abs(acc["s"]) >= F.abs(x), (acc["s"] - t) + x).otherwise((x - t) + acc["s"])
        return F.struct(t.alias("s"), (acc["c"] + lost).alias("c"))

    nothing = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c"))
    exact = F.aggregate(terms, nothing, add, lambda acc: F.when(F.abs(acc["s"]) < float("inf"), acc["s"] + acc["c"]).otherwise(acc["s"]))
    total = F.when(F.col("n_") > 0, F.coalesce("odd_", exact))
    total = F.when(F.isnan(total), wrong("arithmetic-error", "the sum is no number", "double")).otherwise(total)
    return whole.select(*keys, (total if op == "sum" else total / F.col("n_")).alias("f_"))
