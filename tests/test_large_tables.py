"""Plans whose cost grew faster than the tables: what they do now, and that answers stay."""

from collections import Counter
from itertools import permutations

import pytest

from stratalog.engine import BROADCAST, PARTITION, Engine, at_most
from stratalog.packs import catalogue


def joins(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString().count("Join ")


TOUCHED = [(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 10, 1), (2, 11, 2), (3, 10, 1), (3, 10, 1), (4, None, 2), (4, 12, None), (None, 11, 3)]


@pytest.mark.parametrize("name, column, most", [("confidence", 2, 2), ("cochange_pairs", 1, 1)])
def test_an_aggregate_of_its_own_body_joins_once(spark, name, column, most):
    """Pairs are counted where they are made; they were looked up again in all that either of them touches."""
    item = catalogue.ITEMS[name]
    found = Engine(spark).register("lineitem", spark.createDataFrame(TOUCHED, "l_orderkey long, l_partkey long, l_suppkey long")).load(item.program).query(item.question)
    touch = {(r[0], r[column]) for r in TOUCHED}
    pairs = Counter((a[1], b[1]) for a, b in permutations(touch, 2) if a[0] is not None and a[0] == b[0] and None not in (a[1], b[1]))
    whole = Counter(p for _, p in touch)
    if name == "confidence":
        want = {(a, b, n, whole[a], n / whole[a]) for (a, b), n in pairs.items() if n / whole[a] > 0.05}
    else:
        want = {(a, b, n) for (a, b), n in pairs.items() if a < b and n >= 2}
    assert want and {tuple(r) for r in found.collect()} == want
    assert joins(found) <= most


def test_groups_of_absent_keys_are_empty(spark):
    e = Engine(spark).load("t(1, absent). t(1, 2). t(2, 2). t(absent, 3). r(P, N) :- t(_, P), N = count { O | t(O, P) }. s(P, N) :- t(_, P), N = sum { O | t(O, P) }.")
    assert {tuple(r) for r in e.query("r(P, N)").collect()} == {(None, 0), (2, 2), (3, 1)}
    assert {tuple(r) for r in e.query("s(P, N)").collect()} == {(None, None), (2, 3), (3, None)}


def test_an_aggregate_over_other_rows_than_its_body(spark):
    e = Engine(spark).load("t(1, 5). t(1, 6). t(2, 5). u(1, 5). u(3, 7). r(P, N) :- u(_, P), N = count { O | t(O, P) }. s(P, N) :- t(1, P), N = count { O | t(O, P) }. v(O, P, N) :- t(O, P), N = count { X | t(X, P) }.")
    assert {tuple(r) for r in e.query("r(P, N)").collect()} == {(5, 2), (7, 0)}
    assert {tuple(r) for r in e.query("s(P, N)").collect()} == {(5, 2), (6, 1)}
    assert {tuple(r) for r in e.query("v(O, P, N)").collect()} == {(1, 5, 2), (1, 6, 1), (2, 5, 2)}


def test_rows_become_a_set_once(spark):
    """Imported tables aren't sifted before what is made of them is."""
    item = catalogue.ITEMS["point_difference"]
    engine = Engine(spark)
    for t in item.tables.split():
        engine.register(t, (f := spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet")).union(f))
    found = engine.query(item.question)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
    assert found.count() == f.select("l_orderkey", "l_linenumber", "l_shipdate").distinct().count()
    assert engine.query("N = count { K | lineitem(l_orderkey: K) }").first()[0] == f.distinct().count()  # an aggregate counts a row once


def test_what_passes_through_the_driver_and_a_task_is_bounded(spark):
    names = {"spark.sql.autoBroadcastJoinThreshold": BROADCAST, "spark.sql.adaptive.advisoryPartitionSizeInBytes": PARTITION}
    for name, most in names.items():
        spark.conf.unset(name)
    Engine(spark)
    for name, most in names.items():
        assert int(spark.conf.get(name).rstrip("b")) <= most
    assert [at_most(x, 1 << 20) for x in ("10485760b", "-1", "64k", "1g", "10MB")] == [1 << 20, -1, 65536, 1 << 20, 1 << 20]


def shuffles(frame):
    return frame._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def recursed(spark, monkeypatch, name, parts):
    """A query's answer over these parts with rounds in buckets, the rounds' tables, and the answer without buckets."""
    from stratalog.operators import fixpoint

    kept, rounds = [], fixpoint.bucketed
    monkeypatch.setattr(fixpoint, "bucketed", lambda df, n, *a: (kept.append((n, df)), rounds(df, n, *a))[1])
    item, found = catalogue.ITEMS[name], []
    for most in (0, 10**9):
        monkeypatch.setattr(fixpoint, "PLACED", most)
        engine = Engine(spark).register("part", spark.createDataFrame(parts, "p_partkey long, p_size long"))
        found.append(sorted(tuple(r) for r in engine.load(item.program).query(item.question).collect()))
    return found[0], kept, found[1]


@pytest.mark.parametrize("name, relation, most", [("dominators", "free", 1), ("points_to", "pts", 1), ("reaching_definitions", "at", 1)])
def test_rounds_leave_earlier_rows_where_they_are(spark, monkeypatch, name, relation, most):
    """A round shuffled all rows so far, and joined whole tables before it came to its new rows."""
    monkeypatch.setattr("stratalog.engine.BROADCAST", -1)
    got, kept, want = recursed(spark, monkeypatch, name, [(p, p % 50) for p in range(130)])
    assert got and got == want
    rounds = [f for n, f in kept if n == relation]
    assert len(rounds) > 3 and all(shuffles(f) <= most for f in rounds[1:])


def test_rounds_in_buckets_of_rows_with_absent_values(spark, monkeypatch):
    from stratalog.operators import fixpoint

    monkeypatch.setattr(fixpoint, "PLACED", 0)
    rows = [(1, 1, 2), (1, 2, 3), (1, 3, 1), (1, 3, None), (None, 1, 2), (2, None, 1), (2, 1, 5), (None, None, None)]
    program = "r(F, A, O) :- e(F, A, O). r(F, A, O) :- e(F, A, B), r(F, B, O). s(A, V, O) :- e(A, V, O). s(A, V, O) :- s(A, V, M), not e(O, M, V), e(_, M, O)."
    found = []
    for most in (0, 10**9):
        monkeypatch.setattr(fixpoint, "PLACED", most)
        e = Engine(spark).register("e", spark.createDataFrame(rows, "f long, a long, o long")).load(program)
        found.append([{tuple(r) for r in e.query(q).collect()} for q in ("r(F, A, O)", "s(A, V, O)")])
    assert found[0] == found[1]
    closure = {r for r in rows}
    while new := {(f, a, o) for f, a, b in rows for g, c, o in closure if f == g and b == c and None not in (f, b)} - closure:
        closure |= new
    assert found[0][0] == closure


def test_a_column_for_buckets(spark):
    from stratalog.operators.fixpoint import shared_column

    def column(text, name):
        program, _ = Engine(spark).load(text).program()
        return shared_column(name, [r for r in program.rules_of(name) if any(getattr(getattr(x, "atom", None), "name", "") == name for x in r.body)], program.relations[name].arity)

    assert column("e(1, 2, 3). r(F, A, B) :- e(F, A, B). r(F, A, C) :- e(F, A, B), r(F, B, C).", "r") == 0
    assert column("e(1, 2). k(1, 2). r(D, V, N) :- e(D, N), k(D, V). r(D, V, N) :- r(D, V, M), not k(M, V), e(M, N).", "r") == 2
    assert column("e(1, 2). r(A, B) :- e(A, B). r(A, C) :- r(A, B), r(B, C).", "r") is None
    assert column("e(1, 2). r(A, B) :- e(A, B). r(A, N) :- r(A, M), e(A, _), N = M + 1, N < 5.", "r") == 0
