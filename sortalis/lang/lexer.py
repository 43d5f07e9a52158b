"""Tokens of the theory language."""

from __future__ import annotations

import re
from dataclasses import dataclass

KEYWORDS = frozenset("namespace theory instance query forall exists true false extends chase Sort Prop".split())
_TOKEN = re.compile(
    r"(?P<space>\s+)|(?P<comment>//[^\n]*)|(?P<name>[A-Za-z_][A-Za-z0-9_']*|[0-9]+)|(?P<mark>\|-|->|/\\|\\/|[{}()\[\];:,.=/?])"
)


class LanguageError(ValueError):
    """A text that the language does not allow, with its place."""

    def __init__(self, message: str, line: int = 0, column: int = 0):
        super().__init__(f"{line}:{column}: {message}" if line else message)
        self.line, self.column = line, column


@dataclass(frozen=True)
class Token:
    kind: str  # "name", "keyword", "mark" or "end"
    text: str
    line: int
    column: int


def tokens(source: str) -> list[Token]:
    """The tokens of a text, with an end token; comments run from // to the end of the line."""
    out, at, line, start = [], 0, 1, 0
    while at < len(source):
        m = _TOKEN.match(source, at)
        if m is None:
            raise LanguageError(f"unexpected {source[at]!r}", line, at - start + 1)
        if m.lastgroup in ("name", "mark"):
            kind = "keyword" if m.lastgroup == "name" and m[0] in KEYWORDS else m.lastgroup
            out.append(Token(kind, m[0], line, at - start + 1))
        if n := m[0].count("\n"):
            line, start = line + n, at + m[0].rindex("\n") + 1
        at = m.end()
    out.append(Token("end", "", line, at - start + 1))
    return out
