"""Nodes of parsed statements. They compare by content, so equal expressions are found by ==."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Expr:
    pass


@dataclass(frozen=True)
class Literal(Expr):
    value: object


@dataclass(frozen=True)
class Interval(Expr):
    text: str


@dataclass(frozen=True)
class Ref(Expr):
    name: str


@dataclass(frozen=True)
class Star(Expr):
    pass


@dataclass(frozen=True)
class Unary(Expr):
    op: str
    arg: Expr


@dataclass(frozen=True)
class Binary(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class IsNull(Expr):
    arg: Expr
    negated: bool


@dataclass(frozen=True)
class Between(Expr):
    arg: Expr
    low: Expr
    high: Expr
    negated: bool


@dataclass(frozen=True)
class InList(Expr):
    arg: Expr
    items: tuple[Expr, ...]
    negated: bool


@dataclass(frozen=True)
class Match(Expr):
    """LIKE, ILIKE or RLIKE."""

    op: str
    arg: Expr
    pattern: Expr
    negated: bool
    escape: str | None = None


@dataclass(frozen=True)
class Case(Expr):
    subject: Expr | None
    branches: tuple[tuple[Expr, Expr], ...]
    default: Expr | None


@dataclass(frozen=True)
class Cast(Expr):
    arg: Expr
    type_name: str
    safe: bool


@dataclass(frozen=True)
class OrderItem:
    expr: Expr
    ascending: bool = True
    nulls_first: bool | None = None


@dataclass(frozen=True)
class Frame:
    unit: str
    start: Expr | str
    end: Expr | str


@dataclass(frozen=True)
class Over:
    partition: tuple[Expr, ...] = ()
    order: tuple[OrderItem, ...] = ()
    frame: Frame | None = None


@dataclass(frozen=True)
class Call(Expr):
    name: str
    args: tuple[Expr, ...] = ()
    distinct: bool = False
    where: Expr | None = None
    within: tuple[OrderItem, ...] = ()
    over: Over | None = None


@dataclass(frozen=True)
class SelectItem:
    expr: Expr
    alias: str | None
    text: str


@dataclass(frozen=True)
class Grouping:
    """One element of GROUP BY: the alternatives it stands for, each a tuple of keys."""

    sets: tuple[tuple[Expr, ...], ...]


@dataclass
class Select:
    items: list[SelectItem]
    table: str | None
    distinct: bool = False
    where: Expr | None = None
    group: list[Grouping] = field(default_factory=list)
    having: Expr | None = None
    qualify: Expr | None = None
    order: list[OrderItem] = field(default_factory=list)
    limit: int | None = None
    offset: int = 0


@dataclass
class CreateTable:
    name: str
    columns: list[tuple[str, str]]
    order: list[str]
    if_not_exists: bool


@dataclass
class Insert:
    table: str
    columns: list[str] | None
    rows: list[list[Expr]]


@dataclass
class Update:
    table: str
    values: list[tuple[str, Expr]]
    where: Expr | None


@dataclass
class Delete:
    table: str
    where: Expr | None
