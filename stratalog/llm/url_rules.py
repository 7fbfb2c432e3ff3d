"""Block and allow rules on URLs, by a sorted sweep over prefix intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .common import partitions

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null or without ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_table(spark, rules=RULES) -> DataFrame:
    """Rules (verdict, 'host/path') as rows: rule, verdict."""
    return spark.sql("SELECT col1 AS verdict, col2 AS rule FROM VALUES " + ", ".join(f"('{v}', '{r}')" for v, r in rules))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, url, host, path, rule, verdict for each row of pages (page_id, url; other columns are ignored).

    A rule is 'host/path'; it fits its host and all subdomains where the url's path starts with '/path'.
    The longest fitting rule decides, of equally long ones that with the longer host; without any the verdict is `default`.
    A null url, or one without ://, has empty host and path and fits no rule. Null page_ids are kept, repeated rows stay
    repeated, repeated rules count once, empty tables give no rows or only defaults.

    Canonical keys are a host, labels reversed, and a path. Each host of a url's chain of suffixes is a key of its own, which
    makes a rule with a path an interval of keys under one host: from 'path' to 'path' followed by byte FF.
    Intervals of prefixes nest or are apart, so a sweep in key order needs a stack. The rules' own boundaries are swept
    first: after each, the stack's top is the last rule opened at the depth then reached. Those tops are merged with the
    urls' keys by one sort for each host, where the last top before a key is the innermost rule around it.
    Hot hosts are dealt over as many salts as there are shuffle partitions, with the rules' boundaries copied to each.
    """
    spark = pages.sparkSession
    salts = partitions(spark)
    key = lambda h: F.concat_ws(".", F.reverse(F.split(h, r"\.")))
    rule = rules.where(F.col("rule").contains("/")).groupBy("rule").agg(F.min("verdict").alias("verdict"))
    rule = rule.withColumn("slash", F.instr("rule", "/")).select(
        "rule", "verdict", key(F.translate(F.expr("substring(rule, 1, slash - 1)"), UPPER, LOWER)).alias("key"), F.expr("cast(substring(rule, slash) AS binary)").alias("from")
    )
    # boundaries: an end goes before a start at the same place; longer prefixes end first
    start = rule.select("key", F.col("from").alias("at"), F.lit(1).alias("step"), "rule", "verdict", F.length("from").alias("n"))
    end = rule.select("key", F.concat("from", F.expr("X'FF'")).alias("at"), F.lit(-1).alias("step"), F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"), (-F.length("from")).alias("n"))
    sweep = Window.partitionBy("key").orderBy("at", "step", "n")
    bounds = start.unionByName(end).withColumns({"depth": F.sum("step").over(sweep), "nr": F.row_number().over(sweep)})
    opened = F.last(F.when(F.col("step") == 1, F.struct("rule", "verdict")), ignorenulls=True)
    tops = bounds.withColumn("top", F.when(F.col("depth") > 0, opened.over(Window.partitionBy("key", "depth").orderBy("nr"))))
    # of bounds at one place only the last one's top holds there; 'kind' puts them before the urls of that place
    tops = tops.select("key", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "at", F.lit(0).alias("kind"), "nr", F.coalesce("top", F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))).alias("top"))

    rows = pages.select("page_id", F.col("url").cast("string")).groupBy("page_id", "url").agg(F.count(F.lit(1)).alias("times"))
    rows = rows.select("page_id", "url", "times", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.slice(F.reverse(labels), F.lit(1), i))
    keys = rows.select(
        F.explode(F.transform(suffixes, lambda x: F.concat_ws(".", x))).alias("key"), F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int").alias("salt"),
        F.col("path").cast("binary").alias("at"), F.lit(1).alias("kind"), F.lit(0).alias("nr"), "page_id", "url", "times", "host", "path",
    )
    merged = keys.unionByName(tops, allowMissingColumns=True)
    around = F.last("top", ignorenulls=True).over(Window.partitionBy("key", "salt").orderBy("at", "kind", "nr").rowsBetween(Window.unboundedPreceding, 0))
    fits = F.when(F.col("around.rule").isNotNull(), F.struct(F.length("around.rule").alias("n"), F.length("key").alias("h"), F.col("around.rule").alias("rule"), F.col("around.verdict").alias("verdict")))
    best = merged.withColumn("around", around).where("kind = 1").groupBy("page_id", "url", "host", "path", "times").agg(F.max(fits).alias("best"))
    return best.select("page_id", "url", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"), F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("_n")).drop("_n")
