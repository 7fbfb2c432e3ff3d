"""Ground values, their canonical spelling and how they travel through Spark.

On the Spark side: symbol and string are strings, int is bigint, float is double, bool, date, timestamp is
timestamp_ntz, duration is bigint microseconds, absent is NULL.
"""

from __future__ import annotations

import datetime as dt
import math
import re
from dataclasses import dataclass

from pyspark.sql import types as T

SPARK = {
    "symbol": T.StringType(), "string": T.StringType(), "int": T.LongType(), "float": T.DoubleType(), "bool": T.BooleanType(),
    "date": T.DateType(), "timestamp": T.TimestampNTZType(), "duration": T.LongType(),
}
TYPES = tuple(SPARK)
RESERVED = {"import", "as", "declare", "not", "is", "true", "false", "absent"}
UNITS = {"d": 86_400_000_000, "h": 3_600_000_000, "m": 60_000_000, "s": 1_000_000, "ms": 1_000, "us": 1}
INT_MIN, INT_MAX = -(1 << 63), (1 << 63) - 1


class Symbol(str):
    """A bare identifier, distinct from a string of the same letters."""

    def __eq__(self, other):
        return isinstance(other, Symbol) and str.__eq__(self, other)

    def __ne__(self, other):
        return not self == other

    __hash__ = str.__hash__


@dataclass(frozen=True, order=True)
class Duration:
    micros: int


def type_of(value) -> str | None:
    """The type's name; None for absent."""
    if value is None:
        return None
    for kind, name in ((Symbol, "symbol"), (bool, "bool"), (str, "string"), (int, "int"), (float, "float"), (Duration, "duration"), (dt.datetime, "timestamp"), (dt.date, "date")):
        if isinstance(value, kind):
            return name
    raise TypeError(f"no such value: {value!r}")


def to_spark(value):
    if isinstance(value, Duration):
        return value.micros
    return str(value) if isinstance(value, Symbol) else value


def from_spark(value, kind: str | None):
    if value is None:
        return None
    if kind == "symbol":
        return Symbol(value)
    if kind == "duration":
        return Duration(value)
    return value + 0.0 if kind == "float" else value


def order_key(value):
    """Sorts values: absent, then by type (symbol, string, int, float, bool, date, timestamp, duration), then by value."""
    kind = type_of(value)
    rank = -1 if kind is None else TYPES.index(kind)
    if isinstance(value, str):
        value = str(value).encode()
    return (rank, value if value is not None else 0)


def parse_duration(text: str) -> Duration | None:
    """1d12h, -90m, 0s; or ISO (PT36H, P1DT2H)."""
    sign, body = (-1, text[1:]) if text.startswith("-") else (1, text)
    if m := re.fullmatch(r"P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?", body):
        if not any(m.groups()):
            return None
        total = sum(int(x) * UNITS[u] for x, u in zip(m.groups(), "dhms") if x)
    else:
        parts = re.findall(r"(\d+)(us|ms|d|h|m|s)", body)
        if not parts or "".join(a + b for a, b in parts) != body or len({u for _, u in parts}) < len(parts):
            return None
        if [u for _, u in parts] != sorted((u for _, u in parts), key=list(UNITS).index):
            return None
        total = sum(int(x) * UNITS[u] for x, u in parts)
    total *= sign
    return Duration(total) if INT_MIN <= total <= INT_MAX else None


def parse_date(text: str) -> dt.date | None:
    if re.fullmatch(r"\d{4}-\d\d-\d\d", text):
        try:
            return dt.date.fromisoformat(text)
        except ValueError:
            pass
    return None


def parse_timestamp(text: str) -> dt.datetime | None:
    if m := re.fullmatch(r"(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d)(?:\.(\d{1,6}))?", text):
        try:
            return dt.datetime.fromisoformat(m[1]).replace(microsecond=int((m[2] or "0").ljust(6, "0")))
        except ValueError:
            pass
    return None


def spell_float(x: float) -> str:
    """Shortest form that reads back, always with a point or an exponent."""
    if math.isinf(x):
        return "inf" if x > 0 else "-inf"
    text = repr(x + 0.0)
    if "e" in text:
        digits, power = text.split("e")
        return f"{digits}e{int(power)}"
    return text


def spell_duration(micros: int) -> str:
    if micros == 0:
        return "0s"
    out, rest = "-" if micros < 0 else "", abs(micros)
    for unit, size in UNITS.items():
        n, rest = divmod(rest, size)
        out += f"{n}{unit}" if n else ""
    return out


def plain(value) -> str:
    """What `as string` gives."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return spell_float(value)
    if isinstance(value, Duration):
        return spell_duration(value.micros)
    if isinstance(value, dt.datetime):
        frac = f".{value.microsecond:06d}".rstrip("0") if value.microsecond else ""
        return f"{value:%Y-%m-%dT%H:%M:%S}".rjust(19, "0") + frac
    if isinstance(value, dt.date):
        return value.isoformat()
    return str(value)


def spell(value) -> str:
    """Canonical literal: the language reads it back as the same value."""
    if value is None:
        return "absent"
    if isinstance(value, (Duration, dt.date)):
        return "@" + plain(value)
    if isinstance(value, str) and not isinstance(value, Symbol):
        return '"' + value.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\t", "\\t") + '"'
    return plain(value)
