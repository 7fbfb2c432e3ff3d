"""Statistics over outcome tables: intervals, paired tests, resampling. Counting runs on Spark; what follows has a few numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F


def wilson(successes: Column, n: Column, z: float = 1.959963984540054) -> Column:
    """Struct (low, high): Wilson's score interval of a share; the whole range where n is 0."""
    p = successes / n
    middle, spread = (p + z * z / (2 * n)) / (1 + z * z / n), z / (1 + z * z / n) * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.when(n > 0, F.struct(F.greatest(F.lit(0.0), middle - spread).alias("low"), F.least(F.lit(1.0), middle + spread).alias("high"))).otherwise(F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high")))


def binomial_two_sided(k: int, n: int, p: float = 0.5) -> float:
    """Exact: the chances of all outcomes that are no likelier than k."""
    if n == 0:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + (i * math.log(p) if i else 0.0) + ((n - i) * math.log1p(-p) if n - i else 0.0) for i in range(n + 1)]
    return min(1.0, math.fsum(math.exp(x) for x in logs if x <= logs[k] + 1e-7))


def mcnemar(pairs: DataFrame, first: str, second: str) -> tuple[int, int, float]:
    """(only first, only second, exact level) of two 0/1 columns of paired outcomes."""
    a, b = pairs.agg(F.count_if((F.col(first) == 1) & (F.col(second) == 0)), F.count_if((F.col(first) == 0) & (F.col(second) == 1))).first()
    return a, b, binomial_two_sided(min(a, b), a + b)


def paired_bootstrap(pairs: DataFrame, first: str, second: str, key: str, rounds: int = 1000, level: float = 0.95, seed: int = 1) -> tuple[float, float]:
    """Interval of the mean difference. Each row's weight in each round is a Poisson draw from a hash of its key, so
    resampling is one aggregation over the rows without collecting them."""
    u = lambda r: (F.pmod(F.xxhash64(F.col(key), F.lit(seed), r), F.lit(1 << 40)) + 0.5) / F.lit(float(1 << 40))
    steps, chance, total = [], math.exp(-1), 0.0
    for k in range(12):
        total += chance
        steps.append(total)
        chance /= k + 1
    drawn = pairs.select((F.col(first) - F.col(second)).cast("double").alias("d"), F.col(key), F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("r"))
    weight = sum((F.when(u(F.col("r")) > s, 1).otherwise(0) for s in steps), F.lit(0))
    means = drawn.withColumn("w", weight).groupBy("r").agg((F.sum(F.col("w") * F.col("d")) / F.sum("w")).alias("m"))
    low, high = means.agg(F.percentile("m", [(1 - level) / 2, (1 + level) / 2])).first()[0]
    return low, high


def f1(found: DataFrame, truth: DataFrame) -> tuple[float, float, float]:
    """(precision, recall, F1) of two tables of rows as sets; two empty ones agree."""
    found, truth = found.distinct(), truth.distinct()
    both, a, b = found.intersect(truth).count(), found.count(), truth.count()
    if not a and not b:
        return 1.0, 1.0, 1.0
    p, r = both / a if a else 0.0, both / b if b else 0.0
    return p, r, 2 * p * r / (p + r) if p + r else 0.0


def power(p1: float, p2: float, n: int, z: float = 1.959963984540054) -> float:
    """Of a two-sided comparison of two shares with n each, by the normal approximation."""
    if n <= 0 or p1 == p2:
        return 0.05
    m = (p1 + p2) / 2
    shift = (abs(p1 - p2) * math.sqrt(n) - z * math.sqrt(2 * m * (1 - m))) / math.sqrt(p1 * (1 - p1) + p2 * (1 - p2))
    return 0.5 * math.erfc(-shift / math.sqrt(2))
