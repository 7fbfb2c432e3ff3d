"""Secrets in texts: fixed patterns, and a battery of randomness tests for strings that no pattern names.

All of it is DataFrame functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

# The patterns.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # AKIA[A-Z0-9]+ of 16 characters or more: a run that is too short holds none that isn't
HEX = r"[0-9a-f]{32,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
ASSIGN_VALUE = 8
KINDS = ("assign", "access", "hex", "random")

# Encodings, the smallest alphabet that fits is the inferred one.
_LOW, _UP, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ENCODINGS = [
    ("digits", "^[0-9]+$", _DIGITS),
    ("hex", "^[0-9a-f]+$", _DIGITS + "abcdef"),
    ("HEX", "^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    ("low26", "^[a-z]+$", _LOW),
    ("up26", "^[A-Z]+$", _UP),
    ("base32", "^[A-Z2-7]+$", _UP + "234567"),
    ("low36", "^[a-z0-9]+$", _LOW + _DIGITS),
    ("up36", "^[A-Z0-9]+$", _UP + _DIGITS),
    ("letters", "^[A-Za-z]+$", _UP + _LOW),
    ("alnum", "^[A-Za-z0-9]+$", _UP + _LOW + _DIGITS),
    ("base64", "^[A-Za-z0-9+/]+$", _UP + _LOW + _DIGITS + "+/"),
    ("base64url", "^[A-Za-z0-9_-]+$", _UP + _LOW + _DIGITS + "-_"),
]

SPAN = "array<struct<start:int,end:int>>"
PLACED = "array<struct<start:int,kind:int,end:int>>"
#: Levels that a stratum may take, strictest evidence of randomness last.
LEVELS = (0.001, 0.005, 0.01, 0.05, 0.1, 0.2)


#: A fold that appends copies its array at each step; folds go over runs of so many items, and then over the runs.
RUN = 256
#: Code points in a window of a text that is cut at many places.
WINDOW = 4096


def _scan(items: Column, state: Column, kind: str, step) -> Column:
    """What step(state, item) = (next state, array of results) gives for all items in order, in one array of type `kind`."""
    none = F.expr(f"cast(array() as {kind})")

    def inside(acc, x):
        after, out = step(acc["state"], x)
        return F.struct(after.alias("state"), F.concat(acc["out"], out).alias("out"))

    def run(acc, i):
        begin = F.struct(acc["last"]["state"].alias("state"), none.alias("out"))
        return F.struct(F.aggregate(F.slice(items, i * RUN + 1, RUN), begin, inside).alias("last"), F.concat(acc["all"], F.array(acc["last"]["out"])).alias("all"))

    first = F.struct(F.struct(state.alias("state"), none.alias("out")).alias("last"), F.expr(f"cast(array() as array<{kind}>)").alias("all"))
    runs = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / RUN).cast("int"))
    whole = F.aggregate(runs, first, run, lambda acc: F.flatten(F.concat(acc["all"], F.array(acc["last"]["out"]))))
    return F.when(F.size(items) > 0, whole).otherwise(none)


def _found(text: Column, pattern: str, group: int | None, more, kind: str) -> Column:
    """Matches as structs with start and end in code points; more(match, group's text) gives the condition and further fields."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    if group is None:
        steps = F.zip_with(pieces, matches, lambda p, x: F.struct(F.length(p).alias("gap"), x.alias("m"), x.alias("g")))
    else:
        named = F.arrays_zip(matches.alias("m"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("g"))
        steps = F.zip_with(pieces, named, lambda p, x: F.struct(F.length(p).alias("gap"), x["m"].alias("m"), x["g"].alias("g")))
    none = F.expr(f"cast(array() as {kind})")

    def step(at, x):
        start = at + x["gap"]
        end = start + F.coalesce(F.length(x["m"]), F.lit(0))
        keep, fields = more(x["m"], x["g"])
        return end, F.when(x["m"].isNotNull() & keep, F.array(F.struct(start.alias("start"), end.alias("end"), *fields))).otherwise(none)

    # the steps are made once, as the element of an array of one
    return F.when(text.rlike(pattern), F.flatten(F.transform(F.array(steps), lambda s: _scan(s, F.lit(0), kind, step)))).otherwise(none)


def _erfc(x: Column) -> Column:
    """Complementary error function for x >= 0 (error below 2e-7)."""
    t = 1.0 / (1.0 + 0.3275911 * x)
    return t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x)


def randomness(token: Column) -> Column:
    """For an array of strings: structs (enc, n, p), p being the battery's level under 'uniform over the inferred alphabet'.

    Chi-squared for the alphabet's uniformity (Wilson-Hilferty), Wald-Wolfowitz runs above and below the alphabet's middle, and
    lag-one serial correlation; the three levels are combined by Fisher's method. A string that fits no alphabet has p 0.
    """
    first = F.transform(token, lambda t: F.struct(F.regexp_replace(t, "=+$", "").alias("core")))
    enc = lambda x: F.coalesce(*[F.when(x["core"].rlike(pattern), F.lit(i)) for i, (_, pattern, _) in enumerate(ENCODINGS)])
    alphabets = F.array(*[F.lit(a) for _, _, a in ENCODINGS])
    second = F.transform(first, lambda x: F.struct(x["core"].alias("core"), enc(x).alias("enc")))
    third = F.transform(second, lambda x: F.struct(x["core"].alias("core"), x["enc"].alias("enc"), F.get(alphabets, x["enc"]).alias("abc"), F.length(x["core"]).cast("double").alias("n")))
    fourth = F.transform(
        third,
        lambda x: F.struct(
            x["enc"].alias("enc"), x["n"].alias("n"), F.length(x["abc"]).cast("double").alias("k"),
            F.aggregate(F.split(x["abc"], ""), F.lit(0.0), lambda s, a: s + F.when(a == "", 0.0).otherwise(F.pow(x["n"] - F.length(F.replace(x["core"], a, F.lit(""))), F.lit(2.0)))).alias("squares"),
            F.transform(F.filter(F.split(x["core"], ""), lambda c: c != ""), lambda c: F.instr(x["abc"], c).cast("double") - 1.0).alias("at"),
        ),
    )
    total = lambda items: F.aggregate(items, F.lit(0.0), lambda s, v: s + v)
    fifth = F.transform(
        fourth,
        lambda x: F.struct(
            x["enc"].alias("enc"), x["n"].alias("n"), x["k"].alias("k"), (x["k"] / x["n"] * x["squares"] - x["n"]).alias("chi"), x["at"].alias("at"),
            (total(x["at"]) / x["n"]).alias("mean"), total(F.transform(x["at"], lambda v: F.when(v >= x["k"] / 2, 1.0).otherwise(0.0))).alias("high"),
        ),
    )
    pairs = lambda x: F.zip_with(F.slice(x["at"], 1, F.size(x["at"]) - 1), F.slice(x["at"], 2, F.size(x["at"]) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    sixth = F.transform(
        fifth,
        lambda x: F.struct(
            x["enc"].alias("enc"), x["n"].alias("n"), x["k"].alias("k"), x["chi"].alias("chi"), x["high"].alias("high"),
            (1.0 + total(F.transform(pairs(x), lambda p: F.when((p["a"] >= x["k"] / 2) != (p["b"] >= x["k"] / 2), 1.0).otherwise(0.0)))).alias("runs"),
            total(F.transform(pairs(x), lambda p: (p["a"] - x["mean"]) * (p["b"] - x["mean"]))).alias("lagged"),
            total(F.transform(x["at"], lambda v: (v - x["mean"]) * (v - x["mean"]))).alias("spread"),
        ),
    )
    crossed = lambda x: 2.0 * x["high"] * (x["n"] - x["high"]) / x["n"]
    df = lambda x: x["k"] - 1.0
    seventh = F.transform(
        sixth,
        lambda x: F.struct(
            x["enc"].alias("enc"), x["n"].alias("n"),
            ((F.cbrt(F.greatest(x["chi"], F.lit(0.0)) / df(x)) - (1.0 - 2.0 / (9.0 * df(x)))) / F.sqrt(2.0 / (9.0 * df(x)))).alias("z_chi"),
            F.when(crossed(x) > 1.0, (x["runs"] - crossed(x) - 1.0) / F.sqrt(crossed(x) * (crossed(x) - 1.0) / (x["n"] - 1.0))).otherwise(40.0).alias("z_runs"),
            F.when(x["spread"] > 0, (x["lagged"] / x["spread"] + 1.0 / x["n"]) * F.sqrt(x["n"])).otherwise(40.0).alias("z_serial"),
        ),
    )
    both = lambda z: _erfc(F.abs(z) / math.sqrt(2))
    upper = lambda z: F.when(z >= 0, 0.5 * _erfc(F.abs(z) / math.sqrt(2))).otherwise(1.0 - 0.5 * _erfc(F.abs(z) / math.sqrt(2)))
    tiny = F.lit(1e-300)
    eighth = F.transform(seventh, lambda x: F.struct(x["enc"].alias("enc"), x["n"].alias("n"), (-F.log(F.greatest(upper(x["z_chi"]), tiny)) - F.log(F.greatest(both(x["z_runs"]), tiny)) - F.log(F.greatest(both(x["z_serial"]), tiny))).alias("h")))
    return F.transform(eighth, lambda x: F.struct(x["enc"].alias("enc"), x["n"].cast("int").alias("n"), F.coalesce(F.exp(-x["h"]) * (1.0 + x["h"] + x["h"] * x["h"] / 2.0), F.lit(0.0)).alias("p")))


def scanned(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep` and `scan`, a struct: assign, access, hex (arrays of spans) and candidates (spans with enc, n, p) of `text`.

    Base patterns match leftmost without overlap, each kind for itself; positions are code points, ends exclusive.
    What is used twice is a column of its own, so that each pattern runs over a text once.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    yes = lambda m, g: (F.lit(True), [])
    tokens = _found(text, CANDIDATE, None, lambda m, g: (F.lit(True), [m.alias("token")]), "array<struct<start:int,end:int,token:string>>")
    assign = _found(text, ASSIGN, 1, lambda m, g: (F.length(g) >= ASSIGN_VALUE, []), SPAN)
    found = docs.select(*keep, assign.alias("_assign"), _found(text, ACCESS, None, yes, SPAN).alias("_access"), _found(text, HEX, None, yes, SPAN).alias("_hex"), tokens.alias("_tokens"))
    tested = found.withColumn("_tests", randomness(F.transform("_tokens", lambda x: x["token"])))
    candidates = F.zip_with("_tokens", "_tests", lambda a, b: F.struct(a["start"].alias("start"), a["end"].alias("end"), b["enc"].alias("enc"), b["n"].alias("n"), b["p"].alias("p")))
    return tested.select(*keep, F.struct(F.col("_assign").alias("assign"), F.col("_access").alias("access"), F.col("_hex").alias("hex"), candidates.alias("candidates")).alias("scan"))


def thresholds(scans: DataFrame, rate: float = 0.05, least: int = 30) -> dict[tuple[int, int], float]:
    """Levels by (encoding, length band), from a column `scan`: strings of a stratum whose p is above its level are random.

    Truly random strings have uniform p, others p near 0, the nearer the longer they are; so in each encoding and band of length (powers of
    two) twice the strings with p above one half estimate the random ones, and a level's expected share of others among the
    strings above it follows. A stratum takes its lowest level at which that share is at most `rate`, or none. Strata of fewer
    than `least` strings take their encoding's. The counts are of all rows; there are at most (encodings x 32) of them.
    """
    c = scans.select(F.explode("scan.candidates").alias("c")).where(F.col("c.enc").isNotNull() & (F.col("c.n") > 0))
    above = [F.count_if(F.col("c.p") > a).alias(f"a{i}") for i, a in enumerate((*LEVELS, 0.5))]
    rows = c.groupBy(F.col("c.enc").alias("enc"), F.floor(F.log2("c.n")).cast("int").alias("band")).agg(F.count(F.lit(1)).alias("m"), *above).collect()

    def level(counts: list[int]) -> float | None:
        for a, n in zip(LEVELS, counts):
            if n and 1 - min(1.0, 2 * counts[-1] * (1 - a) / n) <= rate:
                return a
        return None

    out, whole = {}, {}
    for r in rows:
        own = whole.setdefault(r.enc, [0] * (len(LEVELS) + 1))
        for i in range(len(own)):
            own[i] += r[f"a{i}"]
    for r in rows:
        counts = [r[f"a{i}"] for i in range(len(LEVELS) + 1)] if r.m >= least else whole[r.enc]
        if (a := level(counts)) is not None:
            out[r.enc, r.band] = a
    return out


def with_spans(scans: DataFrame, levels: dict[tuple[int, int], float]) -> DataFrame:
    """The rows with `spans`, structs (start, kind: place in KINDS, end), sorted: the base ones, and random strings that touch none of them."""
    kind = lambda name, i: F.transform(F.col(f"scan.{name}"), lambda x: F.struct(x["start"].alias("start"), F.lit(i).alias("kind"), x["end"].alias("end")))
    based = scans.withColumn("spans", F.concat(*[kind(name, i) for i, name in enumerate(KINDS[:3])]))
    if not levels:
        return based.withColumn("spans", F.array_sort("spans"))
    limit = F.create_map(*[F.lit(v) for (e, b), a in sorted(levels.items()) for v in (e * 64 + b, a)])
    passed = lambda x: F.when(x["enc"].isNotNull() & (x["n"] > 0), x["p"] > F.element_at(limit, x["enc"] * 64 + F.floor(F.log2(F.greatest(x["n"], F.lit(1)))).cast("int"))).otherwise(False)
    random = F.transform(F.filter("scan.candidates", passed), lambda x: F.struct(x["start"].alias("start"), F.lit(3).alias("kind"), x["end"].alias("end")))
    merged = based.withColumn("_random", random).withColumn("_all", F.array_sort(F.concat("spans", "_random")))
    # forwards by the furthest end of a base span so far, backwards by the nearest start of one
    fits = lambda x, free: F.when((x["kind"] < 3) | free, F.array(x)).otherwise(F.expr(f"cast(array() as {PLACED})"))
    base = lambda x, yes, no: F.when(x["kind"] < 3, yes).otherwise(no)
    after = _scan(F.col("_all"), F.lit(-1), PLACED, lambda end, x: (base(x, F.greatest(end, x["end"]), end), fits(x, end <= x["start"])))
    merged = merged.withColumn("_back", F.when(F.size("_random") > 0, F.reverse(after)))
    before = _scan(F.col("_back"), F.lit(2**31 - 1), PLACED, lambda start, x: (base(x, x["start"], start), fits(x, start >= x["end"])))
    return merged.withColumn("spans", F.when(F.size("_random") > 0, F.reverse(before)).otherwise(F.col("_all"))).drop("_random", "_all", "_back")


def said(items: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(items, lambda x: F.concat_ws(":", F.get(F.array(*map(F.lit, KINDS)), x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def find(docs: DataFrame, rate: float = 0.05) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans for each row of docs (doc_id, text; other columns are ignored).

    A null text is empty and has no spans; a null doc_id and repeated rows are kept; an empty table gives no rows.
    The scans are written before the levels are derived, so texts are read once.
    """
    from .common import written

    scans = written(scanned(docs.select("doc_id", "text"), "doc_id"), "scans")
    every = with_spans(scans, thresholds(scans, rate))
    size = lambda c: F.size(c).cast("long")
    return every.select(
        "doc_id", size(F.col("scan.assign")).alias("n_assign"), size(F.col("scan.access")).alias("n_access"), size(F.col("scan.hex")).alias("n_hex"), size(F.filter("spans", lambda x: x["kind"] == 3)).alias("n_random"),
        F.sha2(said(F.filter("spans", lambda x: x["kind"] < 3)).cast("binary"), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "<secret>", rate: float = 0.05) -> DataFrame:
    """The rows of docs with every span of `text` replaced by `mark` (overlapping spans by one); other columns and null texts stay."""
    levels = thresholds(scanned(docs.select("text")), rate)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    found = with_spans(scanned(whole, "row"), levels)
    # a substring is found by walking from its text's start, so it is cut from the windows that it lies in
    windows = F.transform(F.sequence(F.lit(0), F.floor(F.length("row.text") / WINDOW).cast("int")), lambda i: F.substring(F.col("row.text"), i * WINDOW + 1, F.lit(WINDOW)))
    found = found.withColumn("_windows", F.when(F.size("spans") > 0, windows))

    def cut(start, end):
        first = F.floor(start / WINDOW).cast("int")
        own = F.array_join(F.slice("_windows", first + 1, F.floor(end / WINDOW).cast("int") - first + 1), "")
        return F.substring(own, start - first * WINDOW + 1, end - start)

    def step(at, x):
        kept = F.when(x["start"] >= at, F.array(cut(at, x["start"]), F.lit(mark))).otherwise(F.expr("cast(array() as array<string>)"))
        return F.greatest(at, x["end"]), kept

    last = F.array_max(F.transform("spans", lambda x: x["end"]))
    whole = F.concat(F.array_join(_scan(F.col("spans"), F.lit(0), "array<string>", step), ""), cut(last, F.length("row.text")))
    text = F.when(F.size("spans") > 0, whole).otherwise(F.col("row.text"))
    return found.select(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
