"""Syntax tree of the dialect."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


class Expr:
    pass


@dataclass
class Lit(Expr):
    kind: str  # int, float, string, bytes, bool, null, date, timestamp, datetime, time, json, numeric
    value: Any


@dataclass
class Name(Expr):
    path: list[str]


@dataclass
class Param(Expr):
    name: str | None  # None: positional
    system: bool = False


@dataclass
class Star(Expr):
    of: str | None = None
    without: list[str] = field(default_factory=list)
    replace: list[tuple[Expr, str]] = field(default_factory=list)


@dataclass
class Unary(Expr):
    op: str
    x: Expr


@dataclass
class Binary(Expr):
    op: str
    a: Expr
    b: Expr


@dataclass
class Between(Expr):
    x: Expr
    low: Expr
    high: Expr
    negated: bool


@dataclass
class InList(Expr):
    x: Expr
    items: list[Expr] | None
    query: Any
    unnest: Expr | None
    negated: bool


@dataclass
class Like(Expr):
    x: Expr
    how: str  # '', ANY, ALL
    patterns: list[Expr]
    negated: bool


@dataclass
class Is(Expr):
    x: Expr
    what: str  # NULL, TRUE, FALSE, UNKNOWN
    negated: bool


@dataclass
class Distinct(Expr):
    a: Expr
    b: Expr
    negated: bool


@dataclass
class Case(Expr):
    of: Expr | None
    whens: list[tuple[Expr, Expr]]
    other: Expr | None


@dataclass
class Cast(Expr):
    x: Expr
    type: str
    safe: bool
    format: Expr | None = None
    zone: Expr | None = None


@dataclass
class Interval(Expr):
    amount: Expr
    unit: str
    to: str | None = None


@dataclass
class Extract(Expr):
    part: str
    x: Expr
    zone: Expr | None


@dataclass
class Order:
    x: Expr
    down: bool
    nulls: str | None  # FIRST, LAST


@dataclass
class Window:
    base: str | None = None
    partition: list[Expr] = field(default_factory=list)
    order: list[Order] = field(default_factory=list)
    frame: str | None = None
    frame_parts: list | None = None


@dataclass
class Call(Expr):
    name: str
    args: list[Expr]
    named: dict[str, Expr] = field(default_factory=dict)
    distinct: bool = False
    nulls: str | None = None  # IGNORE, RESPECT
    having: tuple[str, Expr] | None = None
    order: list[Order] = field(default_factory=list)
    limit: Expr | None = None
    over: Window | str | None = None
    safe: bool = False


@dataclass
class Lambda(Expr):
    names: list[str]
    body: Expr


@dataclass
class ArrayLit(Expr):
    items: list[Expr]
    type: str | None = None


@dataclass
class StructLit(Expr):
    items: list[tuple[Expr, str | None]]
    types: list[tuple[str | None, str]] | None = None


@dataclass
class Sub(Expr):
    kind: str  # scalar, array, exists
    query: Any


@dataclass
class Field(Expr):
    x: Expr
    name: str


@dataclass
class Index(Expr):
    x: Expr
    how: str  # OFFSET, ORDINAL, SAFE_OFFSET, SAFE_ORDINAL, KEY
    at: Expr


@dataclass
class With(Expr):
    items: list[tuple[str, Expr]]
    body: Expr


# queries


@dataclass
class TableRef:
    path: list[str]
    alias: str | None = None
    sample: str | None = None


@dataclass
class Derived:
    query: Any
    alias: str | None = None


@dataclass
class Unnest:
    arrays: list[Expr]
    alias: str | None = None
    offset: str | None = None
    mode: str | None = None


@dataclass
class TableCall:
    name: str
    args: list
    named: dict
    alias: str | None = None


@dataclass
class GraphMatch:
    graph: str
    body: Any
    alias: str | None = None


@dataclass
class Join:
    left: Any
    right: Any
    kind: str
    on: Expr | None = None
    using: list[str] | None = None


@dataclass
class Pivot:
    of: Any
    aggs: list[tuple[Expr, str | None]]
    key: Expr
    values: list[tuple[Expr, str | None]]
    alias: str | None = None


@dataclass
class Unpivot:
    of: Any
    value: list[str]
    name: str
    columns: list[tuple[list[str], Expr | None]]
    nulls: bool = False
    alias: str | None = None


@dataclass
class Select:
    items: list[tuple[Expr, str | None]]
    distinct: bool = False
    as_kind: str | None = None  # STRUCT, VALUE
    source: Any = None
    where: Expr | None = None
    group: Any = None  # list, or ('ALL',)
    having: Expr | None = None
    qualify: Expr | None = None
    windows: list[tuple[str, Window]] = field(default_factory=list)


@dataclass
class SetOp:
    op: str
    all: bool
    left: Any
    right: Any
    by_name: bool = False


@dataclass
class Query:
    body: Any
    ctes: list[tuple[str, Any]] = field(default_factory=list)
    recursive: bool = False
    order: list[Order] = field(default_factory=list)
    limit: Expr | None = None
    offset: Expr | None = None
    pipes: list[tuple] = field(default_factory=list)
