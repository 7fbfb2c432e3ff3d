"""The queries over whole tables: rows past any key bound are answered too. test_catalogue compares them with their SQL."""

import pytest

import __spark_entry__ as entry
from stratalog.engine import Engine
from stratalog.packs import catalogue

SF = "/root/testdata/sf0.001"
#: query: its table, the table's key, the key in the answer.
WHOLE = {
    "head_expression": ("lineitem", ("l_orderkey", "l_linenumber"), ("k", "l")), "cast_number": ("lineitem", ("l_orderkey", "l_linenumber"), ("k", "l")), "cast_text": ("orders", ("o_orderkey",), ("k",)),
    "point_difference": ("lineitem", ("l_orderkey", "l_linenumber"), ("k", "l")), "point_shift": ("events", ("event_id",), ("e",)), "duration_algebra": ("events", ("event_id",), ("e",)), "components": ("orders", ("o_orderkey",), ("k",)),
}


@pytest.mark.parametrize("name", WHOLE)
def test_every_key_is_answered(spark, name):
    table, key, answered = WHOLE[name]
    got = {tuple(r) for r in entry.queries()[name](spark, SF).select(*answered).collect()}
    assert got == {tuple(r) for r in spark.read.parquet(f"{SF}/{table}.parquet").select(*key).collect()}


def test_union_past_any_bound(spark):
    rows = [(1, "F", 1.0), (2, "O", 1.0), (5000, "F", 1.0), (10**9, "F", 1.0), (6000, "O", 400000.0), (6001, "O", 1.0)]
    item = catalogue.ITEMS["union_disjunction"]
    found = Engine(spark).register("orders", spark.createDataFrame(rows, "o_orderkey long, o_orderstatus string, o_totalprice double")).load(item.program).query(item.question)
    assert sorted(r[0] for r in found.collect()) == [1, 5000, 6000, 10**9]


def test_dominators_of_every_function(spark):
    """By taking each node out and walking from the entry, in functions of 40 parts and a part of one."""
    item = catalogue.ITEMS["dominators"]
    parts = [*range(40), *range(4000, 4023)]
    found = Engine(spark).register("part", spark.createDataFrame([(p,) for p in parts], "p_partkey long")).load(item.program).query(item.question)
    want = set()
    for f, nodes in ((0, range(40)), (100, range(23))):
        steps = {a: [b for b in {a + 1 if a % 10 else a * 2, a * 2} if b in nodes] for a in nodes}

        def walk(without):
            seen, todo = set(), [1] if without != 1 else []
            while todo:
                if (n := todo.pop()) not in seen and n != without:
                    seen.add(n)
                    todo += steps[n]
            return seen

        want |= {(f, a, b) for a in nodes for b in walk(None) - walk(a)}
    assert {(r["F"], r["D"], r["N"]) for r in found.collect()} == want


def test_taint_and_grants_past_any_bound(spark):
    parts = [(p, 41 if p == 3000 else 1) for p in (93, 187, 375, 750, 1500, 3000, 6000, 6001)]
    frame = spark.createDataFrame(parts, "p_partkey long, p_size long")
    item = catalogue.ITEMS["taint"]
    found = Engine(spark).register("part", frame).load(item.program).query(item.question)
    assert sorted(r[0] for r in found.collect()) == [6000, 6001]  # 3000 is clean and lets nothing through
    item = catalogue.ITEMS["access_closure"]
    engine = Engine(spark).register("part", frame).register("nation", spark.createDataFrame([(0,)], "n_nationkey long"))
    assert sorted(tuple(r) for r in engine.load(item.program).query(item.question).collect()) == [(3000, 1), (6000, 41), (6001, 41)]
