"""Closures by distances: the pairs that brute force finds, each made once where there is one way, however a round's rows lie."""

import random
from itertools import count

import pytest

from stratalog.engine import Engine
from stratalog.operators import fixpoint
from stratalog.packs import catalogue

RULES = ["r(A, C) :- e(A, B), r(B, C).", "r(A, C) :- r(A, B), e(B, C).", "r(A, C) :- r(A, B), r(B, C).", "r(A, C) :- r(B, C), r(A, B)."]
RNG = random.Random(4)
GRAPHS = {
    "up": [(i, i // 2) for i in range(1, 60)],
    "down": [(i // 2, i) for i in range(1, 60)],
    "chain": [(i, i + 1) for i in range(37)],
    "cycle": [(i, (i + 1) % 11) for i in range(11)] + [(3, 3), (20, 3)],
    "mixed": [(RNG.randrange(30), RNG.randrange(30)) for _ in range(45)],
    "absent": [(1, 2), (2, 3), (3, None), (None, 1), (None, None), (4, None), (3, 5), (5, 1)],
}


def closure(edges):
    out = set(edges)
    while new := {(a, d) for a, b in out for c, d in edges if b == c and b is not None} - out:
        out |= new
    return out


def found(spark, edges, rule=RULES[0], **options):
    e = Engine(spark, **options).register("e", spark.createDataFrame(edges, "a long, b long")).load("r(A, B) :- e(A, B). " + rule)
    rows = [tuple(r) for r in e.query("r(A, B)").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("graph", GRAPHS)
@pytest.mark.parametrize("most", [0, 10**9])
def test_pairs(spark, monkeypatch, graph, most):
    monkeypatch.setattr(fixpoint, "PLACED", most)
    monkeypatch.setattr("stratalog.engine.BROADCAST", -1)
    for rule in RULES if graph in ("mixed", "absent") else RULES[:1]:
        assert found(spark, GRAPHS[graph], rule) == closure(GRAPHS[graph]), rule


@pytest.mark.parametrize("uneven", [lambda n: True, lambda n: n % 2 == 1, lambda n: n == 2, lambda n: n == 4])
def test_uneven_rows(spark, monkeypatch, uneven):
    """Far pairs, or a round's rows, that pile up in a bucket: they are shuffled like any."""
    calls = count()
    monkeypatch.setattr(fixpoint, "PLACED", 0)
    monkeypatch.setattr(fixpoint.Model, "uneven", lambda *a: uneven(next(calls)), raising=False)
    for graph in ("down", "cycle"):
        calls = count()
        assert found(spark, GRAPHS[graph]) == closure(GRAPHS[graph])


def made(spark, frame):
    """Rows of a round before they become a set."""
    node = frame._jdf.queryExecution().analyzed()
    while node.nodeName() not in ("Aggregate", "Deduplicate", "Distinct"):
        node = node.children().head()
    return spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, node.children().head()).count()


def test_a_pair_is_made_once(spark, monkeypatch):
    """A chain has one way between two nodes; each pair was made once for every node between."""
    kept, written = [], fixpoint.written
    monkeypatch.setattr(fixpoint, "written", lambda df, n: (kept.append((n, df)), written(df, n))[1])
    pairs = found(spark, GRAPHS["chain"])
    rounds = [made(spark, f) for n, f in kept if n == "r"]
    assert len(rounds) > 4 and sum(rounds) <= len(pairs)


def test_rounds_shuffle_far_pairs_and_what_they_make(spark, monkeypatch):
    monkeypatch.setattr(fixpoint, "PLACED", 0)
    monkeypatch.setattr("stratalog.engine.BROADCAST", -1)
    plans, bucketed = [], fixpoint.bucketed
    monkeypatch.setattr(fixpoint, "bucketed", lambda df, n, *a: (plans.append(df._jdf.queryExecution().executedPlan().toString()), bucketed(df, n, *a))[1])
    item = catalogue.ITEMS["most_specific"]
    parts = [(p, p % 23) for p in range(700)]
    got = Engine(spark).register("part", spark.createDataFrame(parts, "p_partkey long, p_size long")).load(item.program).query(item.question).collect()
    size, want = dict(parts), set()
    for c in size:
        k = c
        while k >= 1 and size[k] >= 10:
            k //= 2
        if k >= 1 or c == 0:
            want.add((c, k, size[k]))
    assert {tuple(r) for r in got} == want
    assert len(plans) > 3 and all(p.count("Exchange hashpartitioning") <= 2 for p in plans[1:])


def test_a_bound_of_rounds(spark):
    assert found(spark, GRAPHS["chain"], max_rounds=6) == closure(GRAPHS["chain"])
    with pytest.raises(RuntimeError):
        found(spark, GRAPHS["chain"], max_rounds=3)


def test_what_is_a_closure(spark):
    def closes(text):
        program, _ = Engine(spark).load("e(1, 2). " + text).program()
        rules = [r for r in program.rules_of("r") if any(getattr(getattr(x, "atom", None), "name", "") == "r" for x in r.body)]
        return fixpoint.is_closure("r", rules, program.relations["r"].types)

    base = "r(A, B) :- e(A, B). "
    assert closes(base + RULES[2]) and closes(base + RULES[3])
    for rule in ("r(A, C) :- r(A, B), r(C, B).", "r(C, A) :- r(A, B), r(B, C).", "r(A, C) :- r(A, B), r(B, C), A < C.", "r(A, B) :- r(A, B), r(B, B).", "r(A, C) :- r(A, 2), r(2, C).", RULES[2] + " r(A, B) :- r(B, A)."):
        assert not closes(base + rule), rule
