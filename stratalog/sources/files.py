"""CSV, JSON Lines and Parquet as relations: columns c0, c1, … of the language's types."""

from __future__ import annotations

import os
import urllib.parse

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.scalars import DATE, FLOAT, INT, STAMP, convert, wrong
from ..functions.values import SPARK
from ..plans.errors import fail

KINDS = ("int", "float", "bool", "date", "timestamp")
#: Stands for a quoted empty cell while Spark reads, which takes an unquoted one as NULL.
QUOTED_EMPTY = "\ue000\ue001"
SUFFIXES = {".csv": "csv", ".jsonl": "json", ".ndjson": "json", ".parquet": "parquet"}


def suffix(path: str) -> str:
    """The format's ending; a URL's query string doesn't count."""
    plain = urllib.parse.urlsplit(path).path if "://" in path else path
    return os.path.splitext(plain.rstrip("/"))[1].lower()


def located(spark: SparkSession, path: str, base: str, at=None) -> str:
    """Where Spark reads the source from: URLs are fetched for all executors, relative paths start at the program's folder."""
    if path.startswith(("http://", "https://")):
        spark.sparkContext.addFile(path)
        from pyspark import SparkFiles

        return "file://" + SparkFiles.get(os.path.basename(urllib.parse.urlsplit(path).path))
    full = path if "://" in path or os.path.isabs(path) else os.path.join(base, path)
    if "://" not in full and not os.path.exists(full):
        raise fail("file-not-found", f"no file {path}", at)
    return full


def load(spark: SparkSession, path: str, base: str = ".", declared: tuple | None = None, table: str | None = None, at=None) -> tuple[DataFrame, list[str], list[str]]:
    """(rows, field names, types). declared: ((field, type or None), …), by position for CSV and by name otherwise."""
    kind = SUFFIXES.get(suffix(path))
    if table is not None or kind is None:
        raise fail("unsupported-format", f"{path}: files end in {', '.join(SUFFIXES)}" if table is None else "tables of databases can't be read", at)
    full = located(spark, path, base, at)
    try:
        return {"csv": _csv, "json": _json, "parquet": _parquet}[kind](spark, full, path, declared, at)
    except (PySparkException, Py4JJavaError) as e:
        raise fail("unreadable-source", f"{path}: {next(iter(str(e).splitlines()), '')}", at) from e


def _csv(spark, full, path, declared, at):
    """Cells are read as text and typed by the literals they spell; an empty cell is absent, a quoted empty one a string."""
    options = {"header": True, "inferSchema": False, "mode": "FAILFAST", "multiLine": True, "escape": '"', "enforceSchema": True, "emptyValue": QUOTED_EMPTY}
    first = spark.read.options(**{**options, "header": False}).csv(full).limit(1).collect()
    if not first:
        if declared is None:
            raise fail("unreadable-source", f"{path}: an empty file has no header", at)
        first = [[f for f, _ in declared]]
    names = [str(x) for x in first[0]]
    if declared is not None and len(declared) != len(names):
        raise fail("source-schema-mismatch", f"{path} has {len(names)} columns, the schema {len(declared)}", at)
    own = [f for f, _ in declared] if declared else names
    shape = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(own))])
    header = declared is None or own == names
    frame = spark.read.schema(shape).options(**{**options, "header": header}).csv(full)
    frame = frame.select([F.when(F.col(c) == QUOTED_EMPTY, "").otherwise(F.col(c)).alias(c) for c in frame.columns])
    wanted = [k for _, k in declared] if declared else [None] * len(own)
    types = spelled_types(frame, wanted)
    return converted(frame, own, types, path, at), own, types


def spelled(c: Column) -> Column:
    """The kind of literal a cell spells; NULL for an absent cell."""
    return (
        F.when(c.isNull(), F.lit(None)).when(c.rlike(INT) & F.trim(c).try_cast("bigint").isNotNull(), "int").when(c.rlike(FLOAT), "float").when(c.isin("true", "false"), "bool")
        .when(c.rlike(DATE) & c.try_cast("date").isNotNull(), "date").when(c.rlike(STAMP) & c.try_cast("timestamp_ntz").isNotNull(), "timestamp").otherwise("string")
    )


def spelled_types(frame: DataFrame, wanted: list[str | None]) -> list[str]:
    """Declared types, and for other columns the narrowest that all cells spell, from one pass over the rows."""
    asked = [i for i, k in enumerate(wanted) if k is None]
    if not asked:
        return list(wanted)
    row = frame.agg(*[F.collect_set(spelled(F.col(f"c{i}"))).alias(f"c{i}") for i in asked]).first()
    out = list(wanted)
    for i in asked:
        seen = set(row[f"c{i}"])
        out[i] = seen.pop() if len(seen) == 1 else "float" if seen == {"int", "float"} else "timestamp" if seen == {"date", "timestamp"} else "string"
    return out


def converted(frame: DataFrame, names: list[str], types: list[str], path: str, at, of: list[str] | None = None) -> DataFrame:
    """The columns in their types; cells that can't be converted are an error naming some of them."""
    of = of or ["string"] * len(types)
    out, bad = [], []
    for i, (k, have) in enumerate(zip(types, of)):
        c = F.col(f"c{i}")
        done = c if k == have or {k, have} <= {"string", "symbol"} else convert(c, have, k)
        out.append(done.cast(SPARK[k]).alias(f"c{i}"))
        if k != have and have == "string" and k not in ("string", "symbol"):
            bad.append((names[i], k, c, c.isNotNull() & done.isNull()))
    if bad:
        row = frame.agg(*[F.min(F.when(b, c)).alias(f"b{j}") for j, (_, _, c, b) in enumerate(bad)]).first()
        for j, (name, k, _, _) in enumerate(bad):
            if row[f"b{j}"] is not None:
                raise fail("unconvertible-cell", f"{path}, column {name}: {row[f'b{j}']!r} is no {k}", at)
    return frame.select(out)


def _json(spark, full, path, declared, at):
    frame = spark.read.option("mode", "FAILFAST").option("prefersDecimal", False).json(full)
    if not frame.columns:
        if declared is None:
            raise fail("unreadable-source", f"{path}: an empty file needs a schema", at)
        frame = spark.createDataFrame([], T.StructType([T.StructField(f, SPARK[k or "string"]) for f, k in declared]))
    return _typed(frame, path, declared, at)


def _parquet(spark, full, path, declared, at):
    return _typed(spark.read.parquet(full), path, declared, at)


def native(frame: DataFrame, path: str = "a table", at=None, wide: bool = False) -> tuple[list[Column], list[str], list[str]]:
    """(columns, names, types) of a DataFrame in the language's types. wide: integers may come as decimals without places (unsigned
    64-bit ones of Parquet, long ones of JSON); one that doesn't fit 64 bits is an error, not a float."""
    columns, names, types = [], [], []
    for f in frame.schema.fields:
        c, k = F.col(f"`{f.name}`"), f.dataType
        if isinstance(k, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            c, own = c.cast("bigint"), "int"
        elif wide and isinstance(k, T.DecimalType) and k.scale == 0 and k.precision >= 19:
            low, high = (F.lit(str(v)).cast("decimal(38,0)") for v in (-(2**63), 2**63 - 1))
            big = wrong("unreadable-source", f"{path}: column {f.name} has an integer beyond 64 bits", "bigint")
            c, own = F.when(c.isNull(), None).when(c.between(low, high), c.cast("bigint")).otherwise(big), "int"
        elif isinstance(k, (T.FloatType, T.DoubleType, T.DecimalType)):
            c, own = c.cast("double") + F.lit(0.0), "float"
            if not isinstance(k, T.DecimalType):
                c = F.when(F.isnan(c), wrong("unreadable-source", f"{path}: column {f.name} has a value that is no number", "double")).otherwise(c) if wide else F.when(~F.isnan(c), c)
        elif isinstance(k, T.BooleanType):
            own = "bool"
        elif isinstance(k, T.DateType):
            own = "date"
        elif isinstance(k, (T.TimestampType, T.TimestampNTZType)):
            c, own = c.cast("timestamp_ntz"), "timestamp"
        elif isinstance(k, (T.StringType, T.CharType, T.VarcharType)):
            own = (f.metadata or {}).get("dl_type", "string")
        elif isinstance(k, T.NullType):
            c, own = c.cast("string"), "string"
        else:
            raise fail("unsupported-column", f"{path}: column {f.name} is {k.simpleString()}", at)
        if (f.metadata or {}).get("dl_type") == "duration" and own == "int":
            own = "duration"
        columns.append(c)
        names.append(f.name)
        types.append(own)
    return columns, names, types


def _typed(frame: DataFrame, path: str, declared, at):
    columns, names, types = native(frame, path, at, True)
    if declared is not None:
        if {f for f, _ in declared} != set(names):
            raise fail("source-schema-mismatch", f"{path} has the columns {', '.join(names)}", at)
        order = [names.index(f) for f, _ in declared]
        frame = frame.select([columns[j].alias(f"c{i}") for i, j in enumerate(order)])
        of = [types[j] for j in order]
        types = [k or of[i] for i, (_, k) in enumerate(declared)]
        for (f, k), have in zip(declared, of):
            if k and k != have and have != "string" and (have, k) not in (("int", "float"), ("float", "int"), ("date", "timestamp"), ("timestamp", "date")):
                raise fail("source-schema-mismatch", f"{path}: column {f} is {have}, not {k}", at)
        names = [f for f, _ in declared]
        return converted(frame, names, types, path, at, of), names, types
    return frame.select([c.alias(f"c{i}") for i, c in enumerate(columns)]), names, types
