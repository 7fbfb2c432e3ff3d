"""Documents of several sources mixed to target weights, by repetition rates and seeded coin tosses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .common import written

WORDS = r"[^\x20\x09-\x0D]+"
#: Source tables up to so many rows are broadcast; longer ones are joined by a shuffle.
BROADCAST_ROWS = 10_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def coin(doc_id: Column, seed: int, other: Column) -> Column:
    """Uniform in [0, 1), from the first 52 bits of an MD5 of seed and id, or of `other` where there is no id."""
    said = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), other.cast("string")), F.lit("")))
    return F.conv(F.substring(F.md5(said.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_rates(sized: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target, rate from rows (source, size).

    The targets fill like water: sources in order of most * size / weight are capped until the rest can take its share by weight.
    """
    total = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    listed = total.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), ((place - 1) % len(weights) + 1).cast("int")).cast("double").alias("weight"))
    listed = listed.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("level", F.col("cap") / F.col("weight"))
    by = Window.orderBy("level", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    listed = (
        listed.withColumn("before", F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("rest", F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("water", (F.sum("source_size").over(everything) * F.lit(float(share)) - F.col("before")) / F.col("rest"))
        .withColumn("place", F.row_number().over(by))  # of the same level only the first has a water that no tied source was taken from
        .withColumn("found", F.min(F.when(F.col("water") <= F.col("level"), F.struct("place", "water"))).over(everything))
    )
    listed = listed.withColumn("target", F.when(F.col("found").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * F.col("found.water"))))
    return listed.select("source", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"))


def plan(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """The rows of docs (doc_id, source and `size`, its words) with source_size, target, rate and copies.

    copies is floor(rate) plus one with probability the fraction, by a coin that depends on seed and doc_id alone, so reruns agree.
    A null source is a source, last in order; rows without doc_id toss by `_toss` (a column of docs; else by size); repeated rows toss alike;
    a source of no words has target and rate 0; empty tables give none. Other columns stay, save those named here.
    """
    rates = written(source_rates(docs.select("source", "size"), weights, share, most), "rates")
    rates = rates.withColumnsRenamed({c: f"_mix_{c}" for c in rates.columns})
    if rates.count() <= BROADCAST_ROWS:
        rates = F.broadcast(rates)
    joined = docs.drop("source_size", "target", "rate", "copies").join(rates, F.col("source").eqNullSafe(F.col("_mix_source")), "inner")
    rate = F.col("_mix_rate")
    copies = (F.floor(rate) + F.when(coin(F.col("doc_id"), seed, F.col("_toss" if "_toss" in docs.columns else "size")) < rate - F.floor(rate), 1).otherwise(0)).cast("int")
    return joined.withColumns({"source_size": F.col("_mix_source_size"), "target": F.col("_mix_target"), "copies": copies, "rate": rate}).drop("_mix_source", "_mix_source_size", "_mix_target", "_mix_rate")


def mix(docs: DataFrame, **parameters) -> DataFrame:
    """The documents themselves, each as often as its plan says; columns as they came."""
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("_toss"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    taken = plan(sized, **parameters).where(F.col("copies") > 0)
    return taken.select("row", F.explode(F.expr("sequence(1, copies)"))).select("row.*")
