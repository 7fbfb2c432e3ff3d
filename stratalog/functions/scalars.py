"""Expressions as Spark columns: checked arithmetic, temporal algebra, conversions, calendar functions.

Absent is NULL and annihilates; errors that data raises carry a mark that the engine turns into a diagnostic.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..plans.constants import read
from ..plans.syntax import Cast, Const, Op, Var
from .values import RESERVED, SPARK, UNITS, to_spark, type_of

DAY = UNITS["d"]
MARK = "STRATALOG|"
INT = r"^\s*-?[0-9]+\s*$"
FLOAT = r"^\s*-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?\s*$"
DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
STAMP = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,6})?$"


def literal(value) -> Column:
    kind = type_of(value)
    if kind is None:
        return F.lit(None)
    if kind == "timestamp":
        return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
    if kind == "date":
        return F.lit(value.isoformat()).cast("date")
    return F.lit(to_spark(value)).cast(SPARK[kind])


def wrong(code: str, message: str, like: str) -> Column:
    return F.raise_error(F.lit(f"{MARK}{code}|{message}")).cast(like)


def _number(c: Column) -> Column:
    """A float that isn't NaN, with one zero."""
    return F.when(F.isnan(c), wrong("arithmetic-error", "the result is no number", "double")).otherwise(c + F.lit(0.0))


def _checked(c: Column) -> Column:
    """A decimal as bigint, or an error where it doesn't fit."""
    return F.when(c.between(F.lit("-9223372036854775808").cast("decimal(38,0)"), F.lit("9223372036854775807").cast("decimal(38,0)")), c.cast("bigint")).when(
        c.isNotNull(), wrong("arithmetic-error", "the result doesn't fit 64 bits", "bigint")
    )


def _wide(c: Column) -> Column:
    return c.cast("decimal(20,0)")


def integer(op: str, a: Column, b: Column) -> Column:
    if op == "/":
        zero = F.when((b == 0) & a.isNotNull(), wrong("arithmetic-error", "division by zero", "bigint"))
        # the one quotient beyond 64 bits; and Spark's div of 64-bit numbers otherwise
        edge = zero.when((a == F.lit(-(2**63))) & (b == -1), wrong("arithmetic-error", "the result doesn't fit 64 bits", "bigint"))
        q = F.call_function("div", a, F.when(b == 0, F.lit(None)).otherwise(b))
        return edge.otherwise(q)
    tried = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](a, b)
    return F.when(tried.isNull() & a.isNotNull() & b.isNotNull(), wrong("arithmetic-error", "the result doesn't fit 64 bits", "bigint")).otherwise(tried)


def _float(op: str, a: Column, b: Column) -> Column:
    if op == "/":
        inf = F.when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
        zero = F.when(a == 0, wrong("arithmetic-error", "0.0 / 0.0 is no number", "double")).when(a.isNotNull(), inf)
        return _number(F.when(b == 0, zero).otherwise(a / F.when(b == 0, F.lit(None)).otherwise(b)))
    return _number(a + b if op == "+" else a - b if op == "-" else a * b)


def micros(c: Column, kind: str) -> Column:
    """Microseconds of a date or timestamp since 1970."""
    if kind == "date":
        return F.unix_date(c).cast("bigint") * F.lit(DAY)
    return F.unix_micros(c.cast("timestamp"))


def _point(c: Column, kind: str) -> Column:
    if kind == "date":
        return F.date_from_unix_date(F.call_function("div", c, F.lit(DAY)).cast("int"))
    return F.timestamp_micros(c).cast("timestamp_ntz")


def operate(op: str, a: Column, ta: str, b: Column, tb: str) -> tuple[Column, str]:
    if ta == tb == "int":
        return integer(op, a, b), "int"
    if ta == tb == "float":
        return _float(op, a, b), "float"
    if ta == tb == "duration":
        if op == "/":
            zero = F.when((b == 0) & a.isNotNull(), wrong("arithmetic-error", "division by a duration of zero", "double"))
            return zero.otherwise(a.cast("double") / F.when(b == 0, F.lit(None)).otherwise(b).cast("double")), "float"
        return integer(op, a, b), "duration"
    if op == "-" and ta == tb:
        return integer("-", micros(a, ta), micros(b, tb)), "duration"
    if tb == "duration" and ta in ("date", "timestamp") or ta == "duration" and tb in ("date", "timestamp"):
        (p, kind), d = ((a, ta), b) if tb == "duration" else ((b, tb), a)
        moved = _point(integer(op, micros(p, kind), d), kind)
        if kind == "date":
            moved = F.when((d % DAY != 0) & p.isNotNull(), wrong("arithmetic-error", "a date moves by whole days only", "date")).otherwise(moved)
        return moved, kind
    (d, n), kind = ((a, b), tb) if ta == "duration" else ((b, a), ta)
    if kind == "int":
        return integer(op, d, n), "duration"
    if op == "/":
        r = _float("/", d.cast("double"), F.when((n == 0) & d.isNotNull(), wrong("arithmetic-error", "division by zero", "double")).otherwise(n))
    else:
        r = d.cast("double") * n
    fits = (r > -9.3e18) & (r < 9.3e18)
    return F.when(fits, _checked(F.when(fits, F.when(r < 0, F.ceil(r)).otherwise(F.floor(r))).cast("decimal(38,0)"))).when(r.isNotNull(), wrong("arithmetic-error", "the result doesn't fit 64 bits", "bigint")), "duration"


def spell_float(c: Column) -> Column:
    """Shortest digits with a point, or an exponent from 1e16 up and below 1e-4."""
    text = c.cast("string")  # 1.0E16, 0.001, 1.0E-5
    mantissa, power = F.regexp_replace(F.regexp_extract(text, r"^(-?[0-9.]+)E", 1), r"\.0$", ""), F.regexp_extract(text, r"E(-?[0-9]+)$", 1)
    exponent = F.concat(mantissa, F.lit("e"), power)
    small = (F.abs(c) >= 1e7) & (F.abs(c) < 1e16)
    whole = F.regexp_replace(F.regexp_replace(c.cast("decimal(38,9)").cast("string"), r"0+$", ""), r"\.$", ".0")
    low = (F.abs(c) < 1e-3) & (F.abs(c) >= 1e-4)
    return (
        F.when(c == float("inf"), F.lit("inf")).when(c == float("-inf"), F.lit("-inf")).when(~text.contains("E"), text)
        .when(small, whole).when(low, F.regexp_replace(F.regexp_replace(c.cast("decimal(38,25)").cast("string"), r"0+$", ""), r"\.$", ".0")).otherwise(exponent)
    )


def spell_duration(c: Column) -> Column:
    rest = F.abs(_wide(c))
    parts = []
    for unit, size in UNITS.items():
        n = F.floor(rest / F.lit(size)).cast("decimal(20,0)")
        parts.append(F.when(n > 0, F.concat(n.cast("string"), F.lit(unit))).otherwise(""))
        rest = (rest - n * F.lit(size)).cast("decimal(20,0)")
    return F.when(c == 0, F.lit("0s")).when(c.isNotNull(), F.concat(F.when(c < 0, F.lit("-")).otherwise(""), *parts))


def spell_timestamp(c: Column) -> Column:
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    frac = F.pmod(F.unix_micros(c.cast("timestamp")), F.lit(1_000_000))
    return F.when(frac == 0, whole).otherwise(F.concat(whole, F.lit("."), F.rtrim(F.lpad(frac.cast("string"), 6, "0"), F.lit("0"))))


def read_duration(c: Column) -> Column:
    """Text to microseconds, or NULL: units largest first, each once; or ISO."""
    total = F.lit(0).cast("decimal(38,0)")
    own = r"^-?(?:([0-9]+)d)?(?:([0-9]+)h)?(?:([0-9]+)m(?!s))?(?:([0-9]+)s)?(?:([0-9]+)ms)?(?:([0-9]+)us)?$"
    iso = r"^-?P(?:([0-9]+)D)?(?:T(?:([0-9]+)H)?(?:([0-9]+)M)?(?:([0-9]+)S)?)?$"
    for pattern, sizes in ((own, list(UNITS.values())), (iso, list(UNITS.values())[:4])):
        for i, size in enumerate(sizes):
            n = F.regexp_extract(c, pattern, i + 1)
            total = total + F.coalesce(F.when(n != "", n.try_cast("decimal(18,0)")), F.lit(0).cast("decimal(18,0)")) * F.lit(size)
    ok = (c.rlike(own) | c.rlike(iso)) & c.rlike("[0-9]")
    signed = F.when(c.startswith("-"), -total).otherwise(total)
    return F.when(ok, signed.try_cast("bigint"))


def convert(c: Column, of: str, to: str) -> Column:
    if of == to:
        return c
    if to == "string":
        return {"float": spell_float, "duration": spell_duration, "timestamp": spell_timestamp}.get(of, lambda x: x.cast("string"))(c)
    if of in ("string", "symbol"):
        if to == "int":
            return F.when(c.rlike(INT), F.trim(c).try_cast("bigint"))
        if to == "float":
            x = F.when(c.rlike(FLOAT), F.trim(c).try_cast("double"))
            return F.when(F.abs(x) < float("inf"), x + F.lit(0.0))
        if to == "bool":
            return F.when(c == "true", F.lit(True)).when(c == "false", F.lit(False))
        if to == "symbol":
            return F.when(c.rlike(r"^[a-z][A-Za-z0-9_]*$") & ~c.isin(*sorted(RESERVED)), c)
        if to == "date":
            return F.when(c.rlike(DATE), c.try_cast("date"))
        if to == "timestamp":
            return F.when(c.rlike(STAMP) | c.rlike(DATE), c.try_cast("timestamp_ntz"))
        return read_duration(c)
    if (of, to) == ("int", "float"):
        d = c.cast("double")
        back = F.when(d < 9.223372036854775e18, d.cast("bigint") == c).otherwise(False)
        return F.when(c.isNull(), F.lit(None).cast("double")).when(back, d).otherwise(wrong("lossy-conversion", "an int that no float equals", "double"))
    if (of, to) == ("float", "int"):
        fits = (c == F.floor(F.when(F.abs(c) < 9.2e18, c))) & (F.abs(c) < 9.2e18)
        return F.when(c.isNull(), F.lit(None).cast("bigint")).when(fits, F.when(fits, c).cast("bigint")).otherwise(wrong("lossy-conversion", "a float that no int equals", "bigint"))
    if (of, to) == ("date", "timestamp"):
        return c.cast("timestamp_ntz")
    if (of, to) == ("timestamp", "date"):
        return F.when(c.isNull(), F.lit(None).cast("date")).when(c == c.cast("date").cast("timestamp_ntz"), c.cast("date")).otherwise(wrong("lossy-conversion", "a timestamp within a day as date", "date"))
    raise ValueError(f"no {of} as {to}")


def component(name: str, c: Column) -> Column:
    return getattr(F, {"day": "dayofmonth"}.get(name, name))(c).cast("bigint")


def truncate(period: str, c: Column, kind: str) -> Column:
    if kind == "date":
        return c if period == "day" else F.trunc(c, period)
    return F.date_trunc(period, c).cast("timestamp_ntz")


def compile_expression(x, types: dict[str, str], column) -> tuple[Column, str | None]:
    """(column, type) of an expression; column(name) is a variable's column."""
    if isinstance(x, Var):
        return column(x.name), types.get(x.name, "string")
    if isinstance(x, Const):
        return literal(x.value), type_of(x.value)
    if isinstance(x, Cast):
        c, kind = compile_expression(x.of, types, column)
        if isinstance(x.of, Const) and x.of.value is not None and kind in ("string", "symbol") and x.to != "string":
            return (literal(v) if (v := read(str(x.of.value), x.to)) is not None else F.lit(None).cast(SPARK[x.to])), x.to
        return (F.lit(None).cast(SPARK[x.to]) if kind is None else convert(c, kind, x.to)), x.to
    if isinstance(x, Op):
        a, ta = compile_expression(x.left, types, column)
        b, tb = compile_expression(x.right, types, column)
        if ta is None or tb is None:
            return F.lit(None), ta or tb
        return operate(x.op, a, ta, b, tb)
    raise TypeError(x)
