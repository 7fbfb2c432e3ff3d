"""Sources of the same size / weight, against targets by repeated capping."""

import pytest

from stratalog.llm import mixing
from .helpers import documents


def targets(sizes, weights, share=1.5, most=2.0):
    """The sources in turn of their names; caps those that can't take their share until all the others can."""
    capped, total = set(), share * sum(sizes)
    while True:
        rest = [i for i in range(len(sizes)) if i not in capped]
        if not rest:
            return [most * s for s in sizes]
        water = (total - sum(most * sizes[i] for i in capped)) / sum(weights[i % len(weights)] for i in rest)
        over = {i for i in rest if most * sizes[i] < weights[i % len(weights)] * water}
        if not over:
            return [most * s if i in capped else weights[i % len(weights)] * water for i, s in enumerate(sizes)]
        capped |= over


@pytest.mark.parametrize("sizes, weights", [([300, 100], (3, 1)), ([900, 5, 700, 900], (3, 1, 2)), ([900, 5, 700, 900], (3, 1, 2, 3)), ([10, 10, 10], (1,)), ([300, 100, 200], (3, 1, 2)), ([0, 0, 7], (3, 1, 2)), ([40, 400, 30], (3, 1, 2))])
def test_ties(spark, sizes, weights):
    sized = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_rates(sized, weights).collect()}
    assert [got[f"s{i}"] for i in range(len(sizes))] == pytest.approx(targets(sizes, weights))
    assert sum(got.values()) == pytest.approx(1.5 * sum(sizes))


def test_mix_keeps_tied_sources(spark):
    docs = documents(spark, [(1, "w " * 300, "a"), (2, "w " * 100, "b")])
    assert {r.doc_id for r in mixing.mix(docs, weights=(3, 1)).collect()} == {1, 2}
