"""Diagnostics: data first, a sentence second."""

from __future__ import annotations

from dataclasses import dataclass

LEX = {"unsupported-token", "unterminated-string", "malformed-literal"}
PARSE = {"unexpected-token", "trailing-comma", "uppercase-relation", "chained-comparison", "compound-term", "unknown-aggregate", "unsupported-construct"}
SOURCE = {"file-not-found", "unsupported-format", "unreadable-source", "source-schema-mismatch", "unconvertible-cell", "unsupported-column", "module-not-found", "module-misuse"}


@dataclass(frozen=True)
class Diagnostic:
    code: str
    message: str
    line: int = 0
    column: int = 0
    warning: bool = False

    @property
    def category(self) -> str:
        return "lex" if self.code in LEX else "parse" if self.code in PARSE else "source" if self.code in SOURCE else "semantic"

    def __str__(self) -> str:
        where = f" (at {self.line}:{self.column})" if self.line else ""
        kind = "warning" if self.warning else f"{self.category} error"
        return f"{kind} [{self.code}]: {self.message}{where}"


class ProgramError(Exception):
    """All diagnostics of the stage that failed."""

    def __init__(self, found: list[Diagnostic]):
        super().__init__("\n".join(map(str, found)))
        self.diagnostics = found

    @property
    def codes(self) -> list[str]:
        return [d.code for d in self.diagnostics]


def fail(code: str, message: str, at=None) -> ProgramError:
    line, column = at or (0, 0)
    return ProgramError([Diagnostic(code, message, line, column)])


class DataError(ProgramError):
    """An error that the data raised while a job ran (arithmetic, lossy conversion)."""
