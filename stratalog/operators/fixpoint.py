"""Strata to relations: one pass where nothing recurses, semi-naive rounds where something does."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.values import SPARK, to_spark
from ..plans.analysis import Builtin, Fold, Program, Rule, live, reads
from ..plans.syntax import Compare, Negative, Positive, Var
from ..session import bucketed, plain, written
from .body import Bodies

#: Rows of a table for each bucket, and those from which on a recursion has buckets at all.
BUCKET, PLACED = 50_000, 10_000
#: A bucket may have so many times its share of the rows, and so many rows are hashed in a task at most (for each row of the last round).
SKEW, HASHED = 4, 200_000


def schema(types: list[str]) -> T.StructType:
    return T.StructType([T.StructField(f"c{i}", SPARK[k]) for i, k in enumerate(types)])


class Model:
    """The least model of a program, relation by relation, as far as it is asked for.

    Relations that one rule of another reads are plans within plans; recursive ones, and those that several rules read,
    are written once. `rounds[name]` has the rows with the round they first appeared in, for explanations.
    """

    def __init__(self, spark: SparkSession, program: Program, given: dict[str, list[DataFrame]], max_rounds: int | None = None, keep_rounds: bool = False):
        self.spark, self.program, self.given, self.max_rounds = spark, program, given, max_rounds
        self.tables: dict[str, DataFrame] = {}
        self.rounds: dict[str, DataFrame] = {}
        self.keep_rounds = keep_rounds
        self.buckets = 0
        self.kept: dict[tuple[str, int | None], DataFrame] = {}  # written tables, by the column that they have buckets by
        self.bodies = Bodies(spark, program.relations, self.table, self.defined, self.unsifted)
        needed = live(program)
        uses: dict[str, int] = {}
        for r in program.rules:
            if r.head.name in needed:
                for n, _ in reads(r.body):
                    uses[n] = uses.get(n, 0) + 1
        for a in program.asks:
            for n, _ in reads(a.rule.body):
                uses[n] = uses.get(n, 0) + 1
        for group in program.strata:
            if not needed & set(group):
                continue
            rules = [r for n in group for r in program.rules_of(n)]
            if any(n in group for r in rules for n, _ in reads(r.body)):
                self.recurse(group, rules)
            else:
                name = group[0]
                parts = [self.base(name), *(self.bodies.rule(r) for r in rules)]
                parts = [p for p in parts if p is not None]
                if not rules:
                    self.tables[name] = parts[0]
                    continue
                out = parts[0]
                for p in parts[1:]:
                    out = out.union(p)
                out = out.distinct()
                self.tables[name] = self.once(name, out) if uses.get(name, 0) > 1 else out

    def table(self, name: str) -> DataFrame:
        if name not in self.tables:
            self.tables[name] = self.base(name)
        return self.tables[name]

    def once(self, name: str, frame: DataFrame | None = None) -> DataFrame:
        """The relation as a written table."""
        if (name, None) not in self.kept:
            self.tables[name] = self.kept[name, None] = written(self.table(name) if frame is None else frame, name)
        return self.kept[name, None]

    def defined(self, name: str) -> Rule | None:
        rules = self.program.rules_of(name)
        if len(rules) == 1 and not self.given.get(name) and not self.program.relations[name].facts and not any(n == name for n, _ in reads(rules[0].body)):
            return rules[0]
        return None

    def unsifted(self, name: str) -> DataFrame:
        """A relation's rows; imported ones as they are, since what is made of them becomes a set anyway."""
        given = self.given.get(name)
        if not given or self.program.relations[name].facts or self.program.rules_of(name):
            return self.table(name)
        frame = given[0]
        for f in given[1:]:
            frame = frame.union(f)
        return frame

    def base(self, name: str) -> DataFrame:
        """Facts and imported rows, as a set."""
        r = self.program.relations[name]
        shape = schema(r.types)
        out = list(self.given.get(name, []))
        if r.facts or not out:
            rows = [tuple(map(to_spark, f)) for f in dict.fromkeys(r.facts)]
            out.append(self.spark.createDataFrame(rows, shape))
        frame = out[0]
        for f in out[1:]:
            frame = frame.union(f)
        return frame.distinct() if self.given.get(name) else frame

    def recurse(self, group: list[str], rules: list[Rule]) -> None:
        if not self.keep_rounds:
            rules = [doubled(r, rules) for r in rules]
        first = {}
        for n in group:
            parts = [self.base(n)]
            self.tables[n] = self.spark.createDataFrame([], schema(self.program.relations[n].types))
            for r in rules:
                if r.head.name == n and not any(isinstance(x, Positive) and x.atom.name in group for x in r.body):
                    parts.append(self.bodies.rule(r))
            out = parts[0]
            for p in parts[1:]:
                out = out.union(p)
            first[n] = out.distinct()
        deltas = {n: written(f, n) for n, f in first.items()}
        recursive = [r for r in rules if any(isinstance(x, Positive) and x.atom.name in group for x in r.body)]
        if not self.keep_rounds and len(group) == 1 and is_closure(group[0], recursive, self.program.relations[group[0]].types):
            return self.close(group[0], deltas[group[0]])
        if self.in_place(group, deltas[group[0]], recursive):
            return
        pieces = {n: [d] for n, d in deltas.items()}
        old = dict(self.tables)
        full = dict(deltas)
        nr, empty = 0, {n for n, d in deltas.items() if d.isEmpty()}
        while len(empty) < len(group):
            nr += 1
            if self.max_rounds is not None and nr > self.max_rounds:
                raise RuntimeError(f"{', '.join(group)} did not end in {self.max_rounds} rounds")
            made: dict[str, list[DataFrame]] = {}
            self.tables.update(full)
            for r in recursive:
                places = [i for i, x in enumerate(r.body) if isinstance(x, Positive) and x.atom.name in group]
                for p in places:
                    name = r.body[p].atom.name
                    if name in empty:
                        continue
                    views = {i: full[r.body[i].atom.name] if i < p else deltas[name] if i == p else old[r.body[i].atom.name] for i in places}
                    made.setdefault(r.head.name, []).append(self.bodies.rule(r, views))
            new = {}
            for n in group:
                if n not in made:
                    continue
                out = made[n][0]
                for m in made[n][1:]:
                    out = out.union(m)
                out = out.distinct().alias("new")
                have = full[n].alias("have")
                same = [F.col(f"new.c{i}").eqNullSafe(F.col(f"have.c{i}")) for i in range(len(out.columns))]
                new[n] = written(out.join(have, same, "left_anti"), n)
            old = dict(full)
            empty = set()
            for n in group:
                if n in new and not new[n].isEmpty():
                    deltas[n] = new[n]
                    pieces[n].append(new[n])
                    full[n] = self.gathered(pieces, n)
                else:
                    empty.add(n)
        self.tables.update(full)
        if self.keep_rounds:
            for n in group:
                self.rounds[n] = _stamped(pieces[n])

    def in_place(self, group: list[str], first: DataFrame, rules: list[Rule]) -> bool:
        """Rounds of one relation over tables in buckets, if they can be had: a round shuffles what it makes, once at most, and reads all else where
        it lies. Earlier rounds are probed with what is made, so that they are neither sorted nor hashed again."""
        name = group[0]
        if len(group) > 1 or self.keep_rounds or (p := shared_column(name, rules, self.program.relations[name].arity)) is None:
            return False
        place, rules, sources = f"c{p}", [delta_first(r, name) for r in rules], []
        for r in rules:
            v, h = next(x for x in r.body if isinstance(x, Positive) and x.atom.name == name).atom.args[p], r.head.args[p]
            for i, x in enumerate(r.body):
                if isinstance(x, (Positive, Negative)) and x.atom.name != name:
                    sources.append((r, i, x.atom.name, x.atom.args.index(v) if v in x.atom.args else None))
                    if isinstance(x, Positive) and h != v and h in x.atom.args and not self.once(x.atom.name).where(F.col(f"c{x.atom.args.index(h)}").isNull()).isEmpty():
                        return False  # a round's rows without a place would never be found again
        most = max(f.count() for f in [first, *[self.once(n) for n in {n for _, _, n, _ in sources}]])
        if most < PLACED:
            return False
        self.buckets = self.buckets or max(8, -(-most // BUCKET))
        spread = self.spread
        # tables in buckets by one of a join's columns lie right for it; by default Spark shuffles them unless it is by all
        self.spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        ends = {(n, q): self.once(n) for _, _, n, q in sources if q is not None}
        if any(self.uneven(*spread(f, f"c{q}")) for (_, q), f in ends.items()):
            return False
        for (n, q), f in ends.items():
            if (n, q) not in self.kept:
                self.kept[n, q] = bucketed(f, n, f"c{q}", self.buckets)
        views = {id(r): {i: self.once(n) if q is None else self.kept[n, q] for s, i, n, q in sources if s is r} for r in rules}
        delta = full = bucketed(first, name, place, self.buckets)
        rows, high = spread(delta, place)
        pieces, nr = [(delta, rows)], 0
        while rows:
            nr += 1
            if self.max_rounds is not None and nr > self.max_rounds:
                raise RuntimeError(f"{name} did not end in {self.max_rounds} rounds")
            made = [self.bodies.rule(r, {**views[id(r)], **{i: delta for i, x in enumerate(r.body) if isinstance(x, Positive) and x.atom.name == name}}) for r in rules]
            out = made[0]
            for m in made[1:]:
                out = out.union(m)
            delta = bucketed(fresh(out.repartition(self.buckets, place).distinct(), full, p, high), name, place, self.buckets)
            rows, high = spread(delta, place)
            pieces.append((delta, rows))
            while len(pieces) > 8:  # the last ones become one table, up to the first that is larger than they are together
                k, total = len(pieces) - 2, pieces[-1][1] + pieces[-2][1]
                while k and pieces[k - 1][1] <= 2 * total:
                    k -= 1
                    total += pieces[k][1]
                pieces[k:] = [(bucketed(joined([f for f, _ in pieces[k:]]), name, place, self.buckets), total)]
            full = joined([f for f, _ in pieces])
        self.tables[name] = self.kept[name, None] = self.kept[name, p] = full
        return True

    def spread(self, f: DataFrame, c: str) -> tuple[int, int]:
        """Rows, and those of the largest bucket."""
        found = f.groupBy(F.pmod(F.hash(c), F.lit(self.buckets))).count().agg(F.sum("count"), F.max("count")).first()
        return found[0] or 0, found[1] or 0

    def uneven(self, rows: int, high: int) -> bool:
        return high > SKEW * (rows / self.buckets + BUCKET)

    def close(self, name: str, first: DataFrame) -> None:
        """A closure by distances. Pairs whose distance is the last power of two, its `far` ones, are joined with all up to it, which gives those up to the next
        power: a pair is made once for each node at that distance on its shortest ways, where joining any two pairs makes it at every node between.

        Large relations lie in buckets by the end that has more values: a round shuffles its far pairs and what it makes."""
        ends = first.agg(F.count(F.lit(1)), *[f(c) for f in (F.approx_count_distinct, F.count) for c in ("c0", "c1")]).first()
        rows, p = ends[0], int(ends[2] > ends[1])
        place, other = f"c{p}", f"c{1 - p}"
        placed, high, setting = rows >= PLACED and ends[3 + p] == rows, 0, "spark.sql.requireAllClusterKeysForCoPartition"
        before = self.spark.conf.get(setting)
        delta = first.withColumn("far", F.lit(True))
        if placed:
            self.buckets = self.buckets or max(8, -(-rows // BUCKET))
            placed = not self.uneven(*self.spread(first, place))
        if placed:
            self.spark.conf.set(setting, "false")  # as in in_place
            delta = bucketed(delta, name, place, self.buckets)
            high = self.spread(delta, place)[1]
        pieces, nr = [delta], 0
        try:
            while True:
                far = delta.where("far").select(F.col(place).alias("a"), F.col(other).alias("k"))
                some, most = self.spread(far, "k") if placed else (int(not far.isEmpty()), 0)
                if not some:
                    break
                nr += 1
                if self.max_rounds is not None and nr > self.max_rounds:
                    raise RuntimeError(f"{name} did not end in {self.max_rounds} rounds")
                views = [f.withColumn("far", F.lit(False)) for f in pieces[:-1]] + [delta]
                if placed and self.uneven(some, most):  # Spark splits large partitions of shuffled rows alone
                    views = [plain(f).withColumn("far", F.col("far") & F.lit(f is delta)) for f in pieces]
                elif placed and most <= HASHED:
                    far = far.hint("shuffle_hash")
                near = joined(views).select(F.col(place).alias("k"), F.col(other).alias("b"), "far")
                out = far.join(near, "k").select(F.col("a").alias(place), F.col("b").alias(other), "far").select("c0", "c1", "far")
                out = (out.repartition(self.buckets, place) if placed else out).groupBy("c0", "c1").agg(F.min("far").alias("far"))
                full = joined([f.select("c0", "c1") for f in pieces])
                if placed:
                    delta = bucketed(fresh(out, full, p, high), name, place, self.buckets)
                    rows, high = self.spread(delta, place)
                    if self.uneven(rows, high):
                        placed, pieces, delta = False, [plain(f) for f in pieces], plain(delta)
                else:
                    have = full.toDF("h0", "h1")
                    delta = written(out.join(have, [F.col(f"c{i}").eqNullSafe(F.col(f"h{i}")) for i in (0, 1)], "left_anti"), name)
                pieces.append(delta)
        finally:
            self.spark.conf.set(setting, before)
        self.tables[name] = self.kept[name, None] = joined([f.select("c0", "c1") for f in pieces])
        if placed:
            self.kept[name, p] = self.tables[name]

    def gathered(self, pieces: dict[str, list[DataFrame]], n: str) -> DataFrame:
        """All rounds' rows; every eighth time as one table, so that plans stay short."""
        if len(pieces[n]) > 8 and not self.keep_rounds:
            whole = pieces[n][0]
            for p in pieces[n][1:]:
                whole = whole.union(p)
            pieces[n][:] = [written(whole, n)]
        out = pieces[n][0]
        for p in pieces[n][1:]:
            out = out.union(p)
        return out


def fresh(out: DataFrame, full: DataFrame, p: int, high: int) -> DataFrame:
    """Rows that aren't among earlier ones, both in buckets by column p; high: rows in the last round's largest bucket."""
    keys = [c for c in out.columns if c in full.columns]
    have = full.toDF(*[f"h{i}" for i in range(len(keys))])  # renamed, or Spark loses a union's buckets under a filter
    same = [F.col(c) == F.col(f"h{i}") if i == p else F.col(c).eqNullSafe(F.col(f"h{i}")) for i, c in enumerate(keys)]
    if high <= HASHED:
        return out.hint("shuffle_hash").join(have, same, "left").where(F.col(f"h{p}").isNull()).select(*out.columns)
    return out.join(have, same, "left_anti")


def is_closure(name: str, rules: list[Rule], types: list[str]) -> bool:
    """Whether r(X, Z) :- r(X, Y), r(Y, Z) is the only recursive rule."""
    if len(rules) != 1 or len(types) != 2 or types[0] != types[1] or len(rules[0].body) != 2:
        return False
    if not all(isinstance(x, Positive) and x.atom.name == name for x in rules[0].body):
        return False
    parts = [*(x.atom.args for x in rules[0].body), rules[0].head.args]
    if not all(isinstance(a, Var) for args in parts for a in args):
        return False
    (a, b), (c, d), (x, z) = [[v.name for v in args] for args in parts]
    if b != c:
        a, b, c, d = c, d, a, b
    return b == c and (a, d) == (x, z) and len({a, b, d}) == 3


def joined(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def shared_column(name: str, rules: list[Rule], arity: int) -> int | None:
    """A column of a linear recursion whose value in the recursive atom another atom shares and whose value in the head an atom has, in
    each rule; one that heads keep as it is, if there is one, else the one that most literals share."""
    best = {}
    for p in range(arity):
        kept, shared = True, 0
        for r in rules:
            own = [x for x in r.body if isinstance(x, Positive) and x.atom.name == name]
            others = [x for x in r.body if isinstance(x, (Positive, Negative)) and x.atom.name != name]
            if len(own) != 1 or any(isinstance(x, Fold) for x in r.body):
                return None
            v, h = own[0].atom.args[p], r.head.args[p]
            inner = {a.name for x in others if isinstance(x, Positive) for a in x.atom.args if isinstance(a, Var)}
            if not isinstance(v, Var) or not isinstance(h, Var) or v.name not in inner or h.name not in inner:
                break
            kept, shared = kept and v == h, shared + sum(v in x.atom.args for x in others)
        else:
            best[p] = kept, shared
    return max(best, key=best.get) if best else None


def delta_first(rule: Rule, name: str) -> Rule:
    """The recursive atom moved to the body's front, if nothing before it binds variables but atoms: then a round joins from its new rows on."""
    at = next(i for i, x in enumerate(rule.body) if isinstance(x, Positive) and x.atom.name == name)
    if any(isinstance(x, (Builtin, Fold)) or isinstance(x, Compare) and x.op == "=" for x in rule.body[:at]):
        return rule
    return replace(rule, body=(rule.body[at], *rule.body[:at], *rule.body[at + 1 :]))


def _stamped(pieces: list[DataFrame]) -> DataFrame:
    out = pieces[0].withColumn("round", F.lit(0))
    for i, p in enumerate(pieces[1:], 1):
        out = out.union(p.withColumn("round", F.lit(i)))
    return out


def doubled(rule: Rule, rules: list[Rule]) -> Rule:
    """r(X, Z) :- r(X, Y), r(Y, Z) for r(X, Z) :- e(X, Y), r(Y, Z) (or r, e), where r(X, Y) :- e(X, Y) is r's only other rule: the same
    closure in as many rounds as its depth has binary digits."""
    name, body = rule.head.name, rule.body
    others = [r for r in rules if r.head.name == name and r is not rule]
    if len(others) != 1 or len(body) != 2 or not all(isinstance(x, Positive) for x in body) or len(rule.head.args) != 2:
        return rule
    if {r.head.name for r in rules} != {name}:
        return rule
    base = others[0]
    edge = next((x for x in body if x.atom.name != name), None)
    step = next((x for x in body if x.atom.name == name), None)
    if edge is None or step is None or len(base.body) != 1 or not isinstance(base.body[0], Positive):
        return rule
    if base.body[0].atom.name != edge.atom.name or len(edge.atom.args) != 2 or len(base.body[0].atom.args) != 2:
        return rule
    names = lambda args: [a.name if isinstance(a, Var) else None for a in args]
    if names(base.head.args) != names(base.body[0].atom.args) or None in names(base.head.args) or len(set(names(base.head.args))) < 2:
        return rule
    left, right = (edge, step) if body[0] is edge else (step, edge)
    (a, b), (c, d), (x, z) = names(left.atom.args), names(right.atom.args), names(rule.head.args)
    if (a, b, c, d) != (x, b, b, z) or None in (a, b, c, d) or len({a, b, d}) < 3:
        if (c, d, a, b) != (x, d, d, z) or len({c, d, b}) < 3:
            return rule
        left, right = right, left
    made = tuple(Positive(type(y.atom)(name, y.atom.args, False, y.atom.at)) for y in (left, right))
    return Rule(rule.nr, rule.head, made, rule.types, rule.at)
