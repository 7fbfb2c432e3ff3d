"""Why a fact holds, as one proof; why it doesn't, as one near miss for each rule that could give it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import compile_expression, literal
from ..functions.values import SPARK, from_spark, spell, to_spark
from ..plans.analysis import Builtin, Fold, Rule, spell_literal
from ..plans.syntax import Compare, Const, Negative, Op, Cast, Positive, Presence, Var, variables


class Explainer:
    """Each step is one small job filtered by the fact's values; nothing but the proof's rows reaches the driver."""

    def __init__(self, model):
        self.model, self.program, self.bodies = model, model.program, model.bodies
        self.group = {n: set(g) for g in model.program.strata for n in g}

    # facts

    def fact(self, name: str, values) -> str:
        r = self.program.relations[name]
        args = [spell(v) if v is not ... else "_" for v in values]
        return f"{name}({', '.join(f'{f}: {a}' for f, a in zip(r.fields, args)) if r.fields else ', '.join(args)})"

    def matching(self, frame: DataFrame, values) -> DataFrame:
        for i, v in enumerate(values):
            if v is not ...:
                frame = frame.where(F.col(f"c{i}").eqNullSafe(literal(v)))
        return frame

    def holds(self, name: str, values) -> bool:
        return name in self.program.relations and not self.matching(self.model.table(name), values).isEmpty()

    def is_base(self, name: str, values) -> bool:
        r = self.program.relations[name]
        if tuple(values) in {tuple(f) for f in r.facts}:
            return True
        return any(not self.matching(g, values).isEmpty() for g in self.model.given.get(name, []))

    # why

    def why(self, name: str, values) -> list[str]:
        head = f"% why {name}({', '.join(map(spell, values))})"
        if name not in self.program.relations:
            return [head, f"% unknown: nothing defines {name}"]
        if self.holds(name, values):
            return [head, *self.proof(name, tuple(values), 0)]
        return [head, "% not derivable", *self.misses(name, values)]

    def why_not(self, name: str, values) -> list[str]:
        head = f"% whynot {name}({', '.join(map(spell, values))})"
        if name not in self.program.relations:
            return [head, f"% unknown: nothing defines {name}"]
        if self.holds(name, values):
            return [head, "% it holds", *self.proof(name, tuple(values), 0)]
        return [head, "% not derivable", *self.misses(name, values)]

    def line(self, depth: int, text: str) -> str:
        return f"% {depth}  {'  ' * depth}{text}"

    def proof(self, name: str, values: tuple, depth: int) -> list[str]:
        said = self.fact(name, values)
        if self.is_base(name, values):
            return [self.line(depth, f"{said}  [fact]")]
        for rule in self.program.rules_of(name):
            row = self.derivation(rule, values)
            if row is None:
                continue
            out = [self.line(depth, f"{said}  by {self.rule_text(rule)}")]
            for x in rule.body:
                if isinstance(x, Positive):
                    out += self.proof(x.atom.name, tuple(self.value(a, row) for a in x.atom.args), depth + 1)
                else:
                    out.append(self.line(depth + 1, self.premise(x, row, rule)))
            return out
        return [self.line(depth, f"{said}  [no derivation found]")]

    def derivation(self, rule: Rule, values: tuple) -> dict | None:
        """The least row of the body's variables that gives the fact from facts of earlier rounds."""
        name, tables = rule.head.name, {}
        if name in self.model.rounds:
            own = self.matching(self.model.rounds[name], values).agg(F.min("round")).first()[0]
            for i, x in enumerate(rule.body):
                if isinstance(x, Positive) and x.atom.name in self.model.rounds and x.atom.name in self.group[name]:
                    tables[i] = self.model.rounds[x.atom.name].where(F.col("round") < own).drop("round")
        frame = self.bodies.body(rule.body, rule.types, variables(rule.head), tables, None, keep=True)
        for a, v in zip(rule.head.args, values):
            frame = frame.where((F.col(f"v_{a.name}") if isinstance(a, Var) else literal(a.value)).eqNullSafe(literal(v)))
        return self.least(frame, rule)

    def least(self, frame: DataFrame, rule: Rule) -> dict | None:
        names = sorted(c for c in frame.columns if c not in ("v_", "v__"))
        row = frame.orderBy(*[F.col(c).asc_nulls_first() for c in names]).limit(1).collect()
        if not row:
            return None
        return {c[2:]: from_spark(row[0][c], rule.types.get(c[2:])) for c in names}

    def value(self, a, row: dict):
        return a.value if isinstance(a, Const) else row.get(a.name, ...)

    def rule_text(self, rule: Rule) -> str:
        return f"{spell_literal(rule.head)} :- {', '.join(map(spell_literal, rule.body))}"

    def put(self, x, row: dict) -> str:
        """An expression with the row's values."""
        if isinstance(x, Var):
            return spell(row[x.name]) if x.name in row else x.name
        if isinstance(x, Op):
            return f"{self.put(x.left, row)} {x.op} {self.put(x.right, row)}"
        if isinstance(x, Cast):
            return f"{self.put(x.of, row)} as {x.to}"
        return spell(x.value)

    def premise(self, x, row: dict, rule: Rule) -> str:
        if isinstance(x, Negative):
            return "no " + self.fact(x.atom.name, [self.value(a, row) for a in x.atom.args])
        if isinstance(x, Compare):
            return f"{spell_literal(x)}  ({self.put(x.left, row)} {x.op} {self.put(x.right, row)})"
        if isinstance(x, Presence):
            return f"{spell_literal(x)}  ({self.put(x.of, row)})"
        if isinstance(x, Builtin):
            return f"{spell_literal(x)}  ({self.put(x.of, row)}, {self.put(x.out, row)})"
        assert isinstance(x, Fold)
        if x.op == "count":
            return f"{spell_literal(x)}  ({spell(row[x.out.name])})"
        seed = self.model.spark.range(1).select(*[literal(row[k]).alias(f"v_{k}") for k in x.keys], F.lit(True).alias("v_"))
        goal = self.bodies.body(x.goal, rule.types, variables(x.of), None, seed, keep=True)
        c, _ = compile_expression(x.of, rule.types, lambda n: F.col(f"v_{n}"))
        have, gone = goal.agg(F.count(c), F.count_if(c.isNull())).first()
        return f"{spell_literal(x)}  ({spell(row[x.out.name])} over {have} values, {gone} absent skipped)"

    # why not

    def misses(self, name: str, values) -> list[str]:
        out = []
        for rule in self.program.rules_of(name):
            bound: dict[str, object] = {}
            for a, v in zip(rule.head.args, values):
                if isinstance(a, Const):
                    if to_spark(a.value) != to_spark(v):
                        break
                elif a.name in bound and to_spark(bound[a.name]) != to_spark(v):
                    break
                else:
                    bound[a.name] = v
            else:
                out += self.miss(rule, bound)
        return out or [self.line(0, "no rule's head matches")]

    def miss(self, rule: Rule, bound: dict) -> list[str]:
        """The longest prefix of the body that has a row, what blocks it, and a step that would pass it."""
        frame = self.model.spark.range(1).select(*[literal(v).cast(_type(rule, n)).alias(f"v_{n}") for n, v in bound.items()], F.lit(True).alias("v_"))
        row, done, blocked = dict(bound), [], None
        for x in rule.body:
            nxt = self.bodies.literal(x, frame, rule.types, None, None)
            got = self.least(nxt, rule)
            if got is None:
                blocked = x
                break
            frame, row = nxt, got
            done.append(x)
        out = [self.line(0, self.rule_text(rule))]
        for x in done:
            if isinstance(x, Positive):
                out.append(self.line(1, self.fact(x.atom.name, [self.value(a, row) for a in x.atom.args])))
            else:
                out.append(self.line(1, self.premise(x, row, rule)))
        if blocked is not None:
            out.append(self.line(1, f"blocked at {spell_literal(blocked)}"))
            out.append(self.line(1, f"repair: {self.repair(blocked, row)}"))
        return out

    def repair(self, x, row: dict) -> str:
        if isinstance(x, (Positive, Negative)):
            values = [self.value(a, row) for a in x.atom.args]
            said = self.fact(x.atom.name, values)
            if isinstance(x, Negative):
                found = self.matching(self.model.table(x.atom.name), values).limit(1).collect()
                types = self.program.relations[x.atom.name].types
                return "refuted by " + self.fact(x.atom.name, [from_spark(v, k) for v, k in zip(found[0], types)]) if found else f"refuted by {said}"
            if any(v is None for v in values):
                return f"none: no stored value matches absent in {said}"
            if any(v is ... for v in values):
                return f"a fact that matches {said}"
            if self.program.rules_of(x.atom.name):
                return f"ask ?whynot {said}"
            return f"add {said}"
        if isinstance(x, Compare):
            return f"none: {self.put(x.left, row)} {x.op} {self.put(x.right, row)} fails"
        return f"none: {spell_literal(x)} fails"


def _type(rule: Rule, name: str):
    return SPARK[rule.types.get(name, "string")]
