"""python -m stratalog.cli [FILE | -] [-q QUESTION]...

Answers go to standard output as facts, diagnostics to standard error. Exit codes: 0 rows, or nothing asked; 1 no rows; 2 no answer.
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from .engine import Engine, question
from .plans.errors import ProgramError


def main(args: list[str], spark: SparkSession | None = None) -> int:
    source, questions, i = None, [], 0
    while i < len(args):
        if args[i] == "-q" and i + 1 < len(args):
            questions.append(args[i + 1])
            i += 2
        elif source is None and (args[i] == "-" or not args[i].startswith("-")):
            source = args[i]
            i += 1
        else:
            print(__doc__, file=sys.stderr)
            return 2
    if source is None and not questions:
        print(__doc__, file=sys.stderr)
        return 2
    try:
        engine = Engine(spark or SparkSession.builder.appName("stratalog").getOrCreate())
        if source == "-":
            engine.load(sys.stdin.read())
        elif source is not None:
            engine.load_file(source)
        for q in questions:
            engine.statements += question(q)
        answers = engine.run()
    except ProgramError as e:
        for d in e.diagnostics:
            print(d, file=sys.stderr)
        return 2
    for w in answers.warnings:
        print(w, file=sys.stderr)
    for line in answers.lines:
        print(line)
    return answers.code


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
