"""Rules over streams: programs without recursion, negation and aggregates only ever add answers, so they run incrementally."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.body import Bodies
from ..plans.analysis import Analyser, Fold, live
from ..plans.errors import fail
from ..plans.syntax import Negative, parse
from ..sources import files


def stream(spark, program: str, question: str, streams: dict[str, DataFrame], tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """The question's answers as a streaming DataFrame, each once.

    streams and tables are base relations by name. The program may only have rules that are not recursive, without `not` and aggregates;
    a rule that joins two streams keeps state for both (add watermarks to bound it).
    """
    spark.conf.set("spark.sql.ansi.enabled", "true")
    frames, registered = {}, {}
    for name, frame in {**streams, **(tables or {})}.items():
        columns, names, types = files.native(frame, name)
        registered[name] = (names, types)
        frames[name] = frame.select([c.alias(f"c{i}") for i, c in enumerate(columns)])
    checked = Analyser(parse(program) + parse(f"?- {question.strip().rstrip('.')}."), False, registered).run()
    for rule in [*checked.rules, checked.asks[-1].rule]:
        if any(isinstance(x, (Negative, Fold)) for x in rule.body):
            raise fail("unsupported-construct", "a stream's rules have no 'not' and no aggregates", rule.at)
    if any(len(g) > 1 for g in checked.strata) or any(x.atom.name == r.head.name for r in checked.rules for x in r.body if hasattr(x, "atom")):
        raise fail("unsupported-construct", "a stream's rules are not recursive")
    made: dict[str, DataFrame] = {}
    bodies = Bodies(spark, checked.relations, lambda n: made[n])
    needed = live(checked)
    for (name,) in checked.strata:
        if name not in needed:
            continue
        parts = [frames[name]] if name in frames else []
        parts += [bodies.rule(r) for r in checked.rules_of(name)]
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        made[name] = out
    ask = checked.asks[-1]
    names = [a.name for a in ask.rule.head.args if hasattr(a, "name")] or ["holds"]
    return bodies.rule(ask.rule).toDF(*names).dropDuplicates()


