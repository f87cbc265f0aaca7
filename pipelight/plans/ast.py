"""What a query is made of."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Lit:
    value: Any


@dataclass(frozen=True)
class Field:
    name: str
    index: int | None = None


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple
    distinct: bool = False
    #: name=value arguments of relevance functions
    options: tuple = ()


@dataclass(frozen=True)
class Unary:
    op: str
    arg: Any


@dataclass(frozen=True)
class Binary:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Case:
    whens: tuple
    default: Any


@dataclass(frozen=True)
class InList:
    arg: Any
    values: tuple
    negated: bool


@dataclass(frozen=True)
class InQuery:
    arg: Any
    query: Query
    negated: bool


@dataclass(frozen=True)
class Exists:
    query: Query
    negated: bool


@dataclass(frozen=True)
class Scalar:
    query: Query


@dataclass(frozen=True)
class Agg:
    call: Call
    name: str


@dataclass(frozen=True)
class Span:
    n: float
    unit: str


@dataclass
class Command:
    name: str
    args: dict[str, Any] = field(default_factory=dict)


@dataclass
class Query:
    commands: list[Command]
    explain: bool = False

    def __hash__(self) -> int:
        return id(self)
