"""The library's front: programs in, DataFrames or canonical facts out."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions.scalars import MARK
from .functions.values import from_spark, order_key, spell
from .operators.explain import Explainer
from .operators.fixpoint import Model
from .operators.reports import reports
from .plans.analysis import Analyser, Ask, Program, live
from .plans.errors import DataError, Diagnostic, ProgramError, fail
from .plans.syntax import Clause, Const, Goal, Import, Parser, Query, Var, parse
from .sources import files

#: Bytes of a table on disk up to which it may be broadcast.
BROADCAST = 256 << 10
#: Bytes of shuffled rows that a task takes at most, where Spark joins small partitions; hash tables are about 20 times that.
PARTITION = 16 << 20


@dataclass
class Answers:
    """Facts and explanations in order, warnings, and the exit code: 0 for rows (or nothing asked), 1 for none."""

    lines: list[str]
    warnings: list[Diagnostic]
    code: int


def raised(error: Exception) -> Exception:
    """The diagnostic that a failed job carries, if it does."""
    text = str(error)
    if MARK in text:
        code, _, message = text.split(MARK, 1)[1].split("\n", 1)[0].partition("|")
        return DataError([Diagnostic(code, message.split("'")[0].split(" SQLSTATE")[0].strip())])
    if "ARITHMETIC_OVERFLOW" in text or "CAST_OVERFLOW" in text or "DIVIDE_BY_ZERO" in text:
        return DataError([Diagnostic("arithmetic-error", "the result doesn't fit, or a division by zero")])
    if "MALFORMED" in text or "FAILED_READ_FILE" in text:
        return DataError([Diagnostic("unreadable-source", text.splitlines()[0])])
    return error


def at_most(setting: str, most: int) -> int:
    """A size in the session's settings, in bytes, or the bound if it is larger."""
    m = re.fullmatch(r"(-?[0-9]+)\s*([kmgtp]?)b?", setting.strip().lower())
    return min(most, int(m[1]) * 1024 ** " kmgtp".index(m[2] or " ")) if m else most


class Engine:
    """Collects program text and DataFrames; each question is planned over all of it.

    >>> e = Engine(spark).load('edge(1, 2). edge(2, 3). path(X, Y) :- edge(X, Y). path(X, Z) :- edge(X, Y), path(Y, Z).')
    >>> e.query("path(1, X)").show()
    """

    def __init__(self, spark: SparkSession, base: str = ".", max_rounds: int | None = None):
        self.spark, self.base, self.max_rounds = spark, base, max_rounds
        spark.conf.set("spark.sql.ansi.enabled", "true")
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        # a broadcast table passes through the driver, in every round of a recursion again
        for name, most in (("spark.sql.autoBroadcastJoinThreshold", BROADCAST), ("spark.sql.adaptive.advisoryPartitionSizeInBytes", PARTITION)):
            spark.conf.set(name, str(at_most(spark.conf.get(name), most)))
        self.statements: list = []
        self.frames: dict[str, tuple[list[str], list[str], DataFrame]] = {}
        self.std_time = False
        self.loaded: set[str] = set()

    def register(self, name: str, frame: DataFrame, fields: list[str] | None = None) -> "Engine":
        """A DataFrame as a base relation; columns become fields, in order (or those named in `fields`)."""
        columns, names, types = files.native(frame if fields is None else frame.select(*[F.col(f"`{f}`") for f in fields]), name)
        self.frames[name] = (names, types, frame.select([c.alias(f"c{i}") for i, c in enumerate(columns)]))
        return self

    def load(self, text: str, base: str | None = None) -> "Engine":
        self.statements += self.resolved(parse(text), base or self.base, False)
        return self

    def load_file(self, path: str) -> "Engine":
        if not os.path.exists(path):
            raise fail("file-not-found", f"no file {path}")
        self.loaded.add(os.path.realpath(path))
        with open(path, encoding="utf-8") as f:
            return self.load(f.read(), os.path.dirname(os.path.abspath(path)))

    def resolved(self, statements: list, base: str, module: bool) -> list:
        """Module imports replaced by the modules' statements, each module once; data imports with full paths."""
        out = []
        for s in statements:
            if module and isinstance(s, (Query, Goal)):
                raise fail("module-misuse", "a module asks no questions", getattr(s, "at", None))
            if isinstance(s, Import) and s.name is None:
                if s.path == "std/time":
                    self.std_time = True
                    continue
                if not s.path.endswith(".dl"):
                    raise fail("module-not-found" if "." not in os.path.basename(s.path) else "unsupported-construct", f"{s.path}: modules end in .dl; data is imported 'as' a relation", s.at)
                path = os.path.realpath(os.path.join(base, s.path))
                if path in self.loaded:
                    continue
                if not os.path.exists(path):
                    raise fail("module-not-found", f"no module {s.path}", s.at)
                self.loaded.add(path)
                with open(path, encoding="utf-8") as f:
                    out += self.resolved(parse(f.read()), os.path.dirname(path), True)
            elif isinstance(s, Import):
                path = s.path if "://" in s.path or os.path.isabs(s.path) else os.path.join(base, s.path)
                out.append(Import(path, s.name, s.fields, s.table, s.at))
            else:
                out.append(s)
        return out

    def program(self, extra: list = ()) -> tuple[Program, dict[str, list[DataFrame]]]:
        """The checked program and the base rows that are not written in it. Imports with schemas that nothing asked needs aren't read."""
        statements = [*self.statements, *extra]
        registered = {n: (names, types) for n, (names, types, _) in self.frames.items()}
        given = {n: [f] for n, (_, _, f) in self.frames.items()}
        imports = [s for s in statements if isinstance(s, Import)]
        late = [s for s in imports if s.fields and all(k for _, k in s.fields)]
        for s in imports:
            if s in late:
                continue
            frame, names, types = files.load(self.spark, s.path, "", s.fields, s.table, s.at)
            given.setdefault(s.name, []).append(self.merged(registered, s, frame, names, types))
        program = Analyser([s for s in statements if not isinstance(s, Import) or s in late], self.std_time, registered).run()
        needed = live(program)
        for s in late:
            if s.name in needed:
                frame, _, _ = files.load(self.spark, s.path, "", s.fields, s.table, s.at)
                given.setdefault(s.name, []).append(frame)
            elif "://" not in s.path and not os.path.exists(s.path):
                raise fail("file-not-found", f"no file {s.path}", s.at)
        return program, given

    def merged(self, registered: dict, s: Import, frame: DataFrame, names, types) -> DataFrame:
        if s.name not in registered:
            registered[s.name] = (tuple(names), tuple(types))
            return frame
        have = registered[s.name]
        if len(have[0]) != len(names):
            raise fail("schema-conflict", f"{s.name} has the fields {', '.join(have[0])}", s.at)
        if tuple(have[1]) != tuple(types):
            raise fail("schema-conflict", f"{s.name} is imported with types {', '.join(have[1])} and {', '.join(types)}", s.at)
        return frame

    def model(self, extra: list = (), rounds: bool = False) -> Model:
        program, given = self.program(extra)
        self.warnings = program.warnings
        try:
            return Model(self.spark, program, given, self.max_rounds, rounds)
        except PySparkException as e:
            raise raised(e) from e

    def query(self, body: str) -> DataFrame:
        """Answers to a conjunction, one column a variable."""
        found = parse(f"?- {body.strip().rstrip('.')}.")
        model = self.model([s for s in found])
        ask = model.program.asks[-1]
        return model_answers(model, ask)

    def table(self, name: str) -> DataFrame:
        """A relation's rows, columns by field names where it has them."""
        model = self.model()
        r = model.program.relations.get(name)
        if r is None:
            raise fail("undefined-predicate", f"nothing defines {name}")
        names = r.fields or [f"c{i}" for i in range(r.arity)]
        return model.table(name).toDF(*names)

    def run(self) -> Answers:
        """All queries' answers as canonical facts, then the explanations asked for."""
        model = self.model(rounds=any(isinstance(s, Goal) for s in self.statements))
        lines: list[str] = []
        try:
            for ask in model.program.asks:
                lines += shown(model, ask)
            rows = bool(lines) or not model.program.asks
            explainer = Explainer(model)
            for why, name, values in model.program.goals:
                lines += explainer.why(name, values) if why else explainer.why_not(name, values)
            found = [*model.program.warnings, *reports(model)]
        except PySparkException as e:
            raise raised(e) from e
        return Answers(lines, found, 0 if rows else 1)

    def why(self, fact: str) -> list[str]:
        return self._explained(f"?why {fact.strip().rstrip('.')}.")

    def why_not(self, fact: str) -> list[str]:
        return self._explained(f"?whynot {fact.strip().rstrip('.')}.")

    def _explained(self, goal: str) -> list[str]:
        model = self.model(parse(goal), rounds=True)
        why, name, values = model.program.goals[-1]
        try:
            return Explainer(model).why(name, values) if why else Explainer(model).why_not(name, values)
        except PySparkException as e:
            raise raised(e) from e


def model_answers(model: Model, ask: Ask) -> DataFrame:
    frame = model.bodies.rule(ask.rule).distinct()
    names = [a.name if isinstance(a, Var) else "holds" for a in ask.rule.head.args]
    return frame.toDF(*names)


def facts(frame: DataFrame, name: str, types: list[str]) -> list[str]:
    """Rows as sorted canonical facts; they go to the driver, as printing does."""
    rows = {tuple(from_spark(v, k) for v, k in zip(r, types)) for r in frame.toLocalIterator()}
    return [f"{name}({', '.join(map(spell, r))})." for r in sorted(rows, key=lambda r: [order_key(v) for v in r])]


def shown(model: Model, ask: Ask) -> list[str]:
    """The query's answers in its shape: its atoms with answers put in, its own name, answer(…) or holds(true)."""
    frame, head = model_answers(model, ask), ask.rule.head
    types = [ask.rule.types.get(a.name, "string") if isinstance(a, Var) else "bool" for a in head.args]
    if ask.shape == "named":
        return facts(frame, ask.name, types)
    if ask.shape in ("answer", "holds"):
        return facts(frame, "answer" if ask.shape == "answer" else "holds", types)
    if not any(isinstance(a, Var) for atom in ask.atoms for a in atom.args):
        if frame.isEmpty():
            return []
        out = {(a.name, tuple(c.value for c in a.args)) for a in ask.atoms}
        return [f"{n}({', '.join(map(spell, v))})." for n, v in sorted(out, key=lambda x: (x[0], [order_key(v) for v in x[1]]))]
    atom = ask.atoms[0]
    if any(isinstance(a, Var) and a.name.startswith("_") for a in atom.args):  # a wildcard has nothing to put in
        return facts(frame, "answer" if any(isinstance(a, Var) for a in head.args) else "holds", types)
    place = {a.name: i for i, a in enumerate(head.args) if isinstance(a, Var)}
    rows = {tuple(from_spark(v, k) for v, k in zip(r, types)) for r in frame.toLocalIterator()}
    out = {tuple(a.value if isinstance(a, Const) else r[place[a.name]] for a in atom.args) for r in rows}
    return [f"{atom.name}({', '.join(map(spell, v))})." for v in sorted(out, key=lambda v: [order_key(x) for x in v])]


def run_text(spark: SparkSession, text: str, base: str = ".") -> Answers:
    return Engine(spark, base).load(text).run()


def question(text: str) -> list:
    """What `-q` takes: an explanation goal, a rule (which is asked for its head), or a body."""
    text = text.strip().rstrip(".")
    if text.startswith("?"):
        return parse(text + ".")
    try:
        found = parse(text + ".")
    except ProgramError:
        return parse(f"?- {text}.")
    if len(found) == 1 and isinstance(found[0], Clause) and found[0].bodies:
        head = found[0].head
        names = [f"A{i}" for i in range(len(head.args))]
        args = ", ".join(f"{a[0]}: {n}" if head.named else n for a, n in zip(head.args, names))
        return [*found, *Parser(f"?- {head.name}({args}).").program()]
    return parse(f"?- {text}.")
