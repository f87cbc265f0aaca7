"""Tokens of the piped query language."""

from __future__ import annotations

import re
from dataclasses import dataclass

_TOKEN = re.compile(
    r"""
    (?P<skip>\s+|//[^\n]*|/\*.*?\*/)
  | (?P<number>\d+\.\d+(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+|\.\d+|\d+)
  | (?P<string>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|`[^`]*`)
  | (?P<name>[A-Za-z_@][A-Za-z0-9_]*)
  | (?P<symbol><=|>=|<>|!=|==|[-+*/%=<>!(),.|\[\]:])
    """,
    re.X | re.S,
)


class QueryError(ValueError):
    """A query that can't be understood; the message says where."""


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    at: int
    end: int

    @property
    def low(self) -> str:
        return self.text.lower()


def tokenize(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise QueryError(f"unexpected {text[at]!r} at {at}")
        if m.lastgroup != "skip":
            out.append(Token(m.lastgroup, m.group(), at, m.end()))
        at = m.end()
    out.append(Token("end", "", at, at))
    return out


def unquote(text: str) -> str:
    """The value of a quoted string: a quote or backslash may be escaped; other escapes stay as written,
    for strings are often regular expressions."""
    body = text[1:-1]
    return body if text[0] == "`" else re.sub(r"\\(\\|\"|')" if text[0] == '"' else r"\\(')", lambda m: m.group(1) if m.group(1) != "\\" else "\\\\", body)
