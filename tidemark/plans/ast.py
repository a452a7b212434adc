"""Syntax tree of the dialect. Nodes are frozen, so equal expressions compare
equal and serve as keys."""

from __future__ import annotations

from dataclasses import dataclass, field


class Expr:
    pass


@dataclass(frozen=True)
class Num(Expr):
    value: float


@dataclass(frozen=True)
class Str(Expr):
    value: str


@dataclass(frozen=True)
class Null(Expr):
    pass


@dataclass(frozen=True)
class Col(Expr):
    name: str
    table: str | None = None


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
class Between(Expr):
    arg: Expr
    low: Expr
    high: Expr
    negated: bool = False


@dataclass(frozen=True)
class InList(Expr):
    arg: Expr
    items: tuple[Expr, ...]
    negated: bool = False


@dataclass(frozen=True)
class IsNull(Expr):
    arg: Expr
    negated: bool = False


@dataclass(frozen=True)
class Case(Expr):
    whens: tuple[tuple[Expr, Expr], ...]
    default: Expr | None = None


@dataclass(frozen=True)
class Cast(Expr):
    arg: Expr
    kind: str


@dataclass(frozen=True)
class Array(Expr):
    items: tuple[Expr, ...]


@dataclass(frozen=True)
class Call(Expr):
    name: str
    args: tuple[Expr, ...]


@dataclass(frozen=True)
class Item:
    expr: Expr
    alias: str | None = None


@dataclass(frozen=True)
class Source:
    name: str
    alias: str | None = None

    @property
    def label(self) -> str:
        return self.alias or self.name


@dataclass(frozen=True)
class Join:
    source: Source
    left: Col
    right: Col
    kind: str = "inner"


@dataclass(frozen=True)
class Order:
    expr: Expr
    descending: bool = False


@dataclass(frozen=True)
class Select:
    items: tuple[Item, ...]
    sources: tuple[Source, ...]
    joins: tuple[Join, ...] = ()
    where: Expr | None = None
    group_by: tuple[Expr, ...] = ()
    having: Expr | None = None
    order_by: tuple[Order, ...] = ()
    limit: int | None = None


@dataclass(frozen=True)
class CreateStream:
    name: str
    columns: tuple[str, ...]
    keys: tuple[str, ...] = ()
    table: bool = False


@dataclass(frozen=True)
class CreateView:
    name: str
    select: Select
    materialized: bool
    text: str = field(default="", compare=False)


@dataclass(frozen=True)
class Insert:
    name: str
    columns: tuple[str, ...]
    rows: tuple[tuple[Expr, ...], ...]


@dataclass(frozen=True)
class Delete:
    name: str
    column: str
    value: Expr


@dataclass(frozen=True)
class Drop:
    kind: str
    name: str
    if_exists: bool = False


@dataclass(frozen=True)
class Explain:
    select: Select


def walk(e: Expr | None):
    """The expression and all below it."""
    if e is None:
        return
    yield e
    for child in children(e):
        yield from walk(child)


def children(e: Expr) -> tuple[Expr, ...]:
    if isinstance(e, (Unary, Cast)):
        return (e.arg,)
    if isinstance(e, Binary):
        return (e.left, e.right)
    if isinstance(e, Between):
        return (e.arg, e.low, e.high)
    if isinstance(e, InList):
        return (e.arg, *e.items)
    if isinstance(e, IsNull):
        return (e.arg,)
    if isinstance(e, Case):
        return (*[x for w in e.whens for x in w], *([e.default] if e.default is not None else []))
    if isinstance(e, Array):
        return e.items
    if isinstance(e, Call):
        return e.args
    return ()


def rebuild(e: Expr, f) -> Expr:
    """The expression with f applied to its children."""
    if isinstance(e, Unary):
        return Unary(e.op, f(e.arg))
    if isinstance(e, Cast):
        return Cast(f(e.arg), e.kind)
    if isinstance(e, Binary):
        return Binary(e.op, f(e.left), f(e.right))
    if isinstance(e, Between):
        return Between(f(e.arg), f(e.low), f(e.high), e.negated)
    if isinstance(e, InList):
        return InList(f(e.arg), tuple(map(f, e.items)), e.negated)
    if isinstance(e, IsNull):
        return IsNull(f(e.arg), e.negated)
    if isinstance(e, Case):
        return Case(tuple((f(a), f(b)) for a, b in e.whens), None if e.default is None else f(e.default))
    if isinstance(e, Array):
        return Array(tuple(map(f, e.items)))
    if isinstance(e, Call):
        return Call(e.name, tuple(map(f, e.args)))
    return e
