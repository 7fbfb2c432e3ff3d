"""Warnings that need the data: what aggregates skipped, and what conversions lost."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import compile_expression
from ..plans.analysis import Fold, Rule, live, spell_expression
from ..plans.errors import Diagnostic
from ..plans.syntax import Cast, Compare, Op, Presence, Var, variables
from .body import col


def casts(x) -> list[Cast]:
    if isinstance(x, Cast):
        return [x, *casts(x.of)]
    if isinstance(x, Op):
        return casts(x.left) + casts(x.right)
    return []


def reports(model) -> list[Diagnostic]:
    """One job for each aggregate that may skip, and for each conversion of text that nothing guards."""
    needed, out = live(model.program), []
    rules = [r for r in model.program.rules if r.head.name in needed] + [a.rule for a in model.program.asks if a.shape != "named"]
    for rule in rules:
        guarded = {v for x in rule.body if isinstance(x, Presence) for v in variables(x.of)}
        for k, x in enumerate(rule.body):
            if isinstance(x, Fold) and x.op != "count":
                out += skipped(model, rule, k, x)
            elif isinstance(x, Compare):
                target = {s.name for s in (x.left, x.right) if isinstance(s, Var)}
                if not (x.op == "=" and target & guarded):
                    out += [w for side in (x.left, x.right) for c in casts(side) for w in lost(model, rule, k, c)]
    return out


def before(model, rule: Rule, k: int) -> DataFrame:
    return model.bodies.body(rule.body[:k], rule.types, set(), keep=True)


def skipped(model, rule: Rule, k: int, x: Fold) -> list[Diagnostic]:
    """Values that the aggregate skips, over all instances of the rule, and the instances that skip any."""
    frame, keys = before(model, rule, k), list(x.keys)
    seeds = frame.select(*[f"v_{n}" for n in keys]).distinct() if keys else None
    goal = model.bodies.body(x.goal, rule.types, variables(x.of), None, seeds, keep=True)
    value, _ = compile_expression(x.of, rule.types, col)
    gone = F.count_if(value.isNull()).alias("gone")
    if keys:
        each = goal.groupBy(*[col(n).alias(f"k_{i}") for i, n in enumerate(keys)]).agg(gone)
        frame = frame.join(each, [col(n).eqNullSafe(F.col(f"k_{i}")) for i, n in enumerate(keys)])
    else:
        frame = frame.crossJoin(goal.agg(gone))
    n, instances = frame.where("gone > 0").agg(F.sum("gone"), F.count(F.lit(1))).first()
    if not n:
        return []
    return [Diagnostic("absent-skipped", f"{x.op} skipped {n} absent value{'s' if n > 1 else ''} in {instances} group{'s' if instances > 1 else ''} of {rule.head.name}", *x.at, warning=True)]


def lost(model, rule: Rule, k: int, x: Cast) -> list[Diagnostic]:
    """Texts that the conversion made absent."""
    frame = before(model, rule, k)
    if variables(x.of) - model.bodies.bound(frame):
        return []
    of, kind = compile_expression(x.of, rule.types, col)
    if kind not in ("string", "symbol") or x.to == "string":
        return []
    made, _ = compile_expression(x, rule.types, col)
    n = frame.agg(F.count_if(of.isNotNull() & made.isNull())).first()[0]
    if not n:
        return []
    return [Diagnostic("conversion-failed-on-data", f"{spell_expression(x)} made {n} value{'s' if n > 1 else ''} absent in {rule.head.name}; test 'is absent' to choose", *x.at, warning=True)]
