"""Sums and averages of floats against math.fsum, whatever the magnitudes and the order."""

import math
import random

import pytest

from stratalog.engine import Engine


def total(spark, groups, op="sum"):
    rows = [(g, i, v) for g, values in groups.items() for i, v in enumerate(values)]
    random.Random(1).shuffle(rows)
    engine = Engine(spark).register("t", spark.createDataFrame(rows, "g long, i long, v double"))
    found = engine.query(f"t(g: G), S = {op} {{ V | t(g: G, i: _, v: V) }}")
    return {r["G"]: r["S"] for r in found.collect()}


def test_sums(spark):
    rng = random.Random(2)
    groups = {
        1: [1e-20, 1e-20], 2: [1.2345678901234e-12], 3: [1e17, 0.1, -1e17], 4: [9.0e16] * 1300, 5: [0.1] * 10, 6: [None, None], 7: [None, 2.5], 8: [5e-324] * 3, 9: [1e308, 1e308],
        10: [1.7e308, -1.7e308, 3.0], 11: [0.0, -0.0], 12: [2.0**k for k in range(-60, 60)], 13: [float("inf"), 1.0], 14: [1e16, -1e16, 0.1],
    }
    for g in range(100, 120):
        groups[g] = [rng.choice((-1, 1)) * rng.random() * 10 ** rng.randrange(-30, 30) for _ in range(rng.randrange(1, 60))]
    got = total(spark, groups)
    for g, values in groups.items():
        present = [v for v in values if v is not None]
        if g == 9:
            assert got[g] == math.inf
        elif not present:
            assert got[g] is None
        else:
            assert got[g] == pytest.approx(math.fsum(present), rel=1e-15, abs=0), (g, values)
    got = total(spark, groups, "avg")
    assert got[1] == 1e-20 and got[2] == 1.2345678901234e-12 and got[3] == 0.1 / 3 and got[7] == 2.5


def test_no_rows_and_opposite_infinities(spark):
    engine = Engine(spark).register("t", spark.createDataFrame([], "v double"))
    assert [r["S"] for r in engine.query("S = sum { V | t(v: V) }").collect()] == [None]
    with pytest.raises(Exception, match="no number"):
        total(spark, {1: [float("inf"), float("-inf")]})


def test_registered_query(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    groups = {}
    for r in spark.read.parquet(f"{sf}/lineitem.parquet").distinct().collect():
        groups.setdefault(r.l_suppkey, []).append(r.l_discount)
    got = {r.s: (r.d, r.a) for r in entry.queries()["sum_float"](spark, sf).collect()}
    assert got.keys() == groups.keys()
    for k, v in groups.items():
        assert got[k] == pytest.approx((math.fsum(v), math.fsum(v) / len(v)), rel=4e-16, abs=0)
