"""A brute-force evaluator over Python sets: every rule over every binding until nothing is new. For tests alone."""

from __future__ import annotations

from stratalog.functions.values import order_key
from stratalog.plans.analysis import Analyser, Fold
from stratalog.plans.constants import convert, operate
from stratalog.plans.syntax import Cast, Compare, Const, Negative, Op, Positive, Presence, Var, parse


def same(a, b):
    return a is not None and b is not None and order_key(a) == order_key(b)


def value(x, env):
    if isinstance(x, Var):
        return env[x.name]
    if isinstance(x, Const):
        return x.value
    if isinstance(x, Cast):
        return convert(value(x.of, env), x.to)
    return operate(x.op, value(x.left, env), value(x.right, env))


def solutions(body, env, model):
    if not body:
        yield env
        return
    x, rest = body[0], body[1:]
    if isinstance(x, Positive):
        for row in model.get(x.atom.name, ()):
            new = dict(env)
            for a, v in zip(x.atom.args, row):
                if isinstance(a, Const):
                    if not same(a.value, v):
                        break
                elif a.name in new:
                    if not same(new[a.name], v):
                        break
                else:
                    new[a.name] = v
            else:
                yield from solutions(rest, new, model)
    elif isinstance(x, Negative):
        for row in model.get(x.atom.name, ()):
            if all(order_key(a.value if isinstance(a, Const) else env[a.name]) == order_key(v) for a, v in zip(x.atom.args, row) if isinstance(a, Const) or a.name in env):
                return
        yield from solutions(rest, env, model)
    elif isinstance(x, Compare):
        for a, b in ((x.left, x.right), (x.right, x.left)):
            if x.op == "=" and isinstance(a, Var) and a.name not in env:
                yield from solutions(rest, {**env, a.name: value(b, env)}, model)
                return
        a, b = value(x.left, env), value(x.right, env)
        if a is None or b is None:
            return
        a, b = order_key(a), order_key(b)
        if {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[x.op]:
            yield from solutions(rest, env, model)
    elif isinstance(x, Presence):
        if (value(x.of, env) is None) == x.absent:
            yield from solutions(rest, env, model)
    elif isinstance(x, Fold):
        seed = {k: env[k] for k in x.keys}
        found = [value(x.of, e) for e in solutions(x.goal, seed, model)]
        have = [v for v in found if v is not None]
        if x.op == "count":
            out = len(found)
        elif not have:
            out = None
        elif x.op in ("min", "max"):
            out = (min if x.op == "min" else max)(have, key=order_key)
        elif x.op == "sum":
            out = have[0]
            for v in have[1:]:
                out = operate("+", out, v)
        else:
            out = sum(have) / len(have)
        if x.out.name in env:
            if same(env[x.out.name], out):
                yield from solutions(rest, env, model)
        else:
            yield from solutions(rest, {**env, x.out.name: out}, model)


def model(text: str) -> dict[str, set[tuple]]:
    program = Analyser(parse(text)).run()
    out = {n: set(map(tuple, r.facts)) for n, r in program.relations.items()}
    for group in program.strata:
        rules = [r for n in group for r in program.rules_of(n)]
        while True:
            new = 0
            for r in rules:
                made = {tuple(a.value if isinstance(a, Const) else e[a.name] for a in r.head.args) for e in solutions(r.body, {}, out)}
                new += len(made - out[r.head.name])
                out[r.head.name] |= made
            if not new:
                break
    return out
