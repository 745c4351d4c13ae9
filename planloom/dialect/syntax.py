"""Syntax trees of the dialect, as plain values."""

from __future__ import annotations

import datetime
from collections.abc import Iterator
from dataclasses import dataclass, fields


class Expr:
    """A scalar, aggregate or star expression."""

    def children(self) -> Iterator[Expr]:
        for f in fields(self):
            v = getattr(self, f.name)
            if isinstance(v, Expr):
                yield v
            elif isinstance(v, tuple):
                yield from (x for x in v if isinstance(x, Expr))

    def walk(self) -> Iterator[Expr]:
        yield self
        for c in self.children():
            yield from c.walk()

    def columns(self) -> list[Column]:
        return [e for e in self.walk() if isinstance(e, Column)]


@dataclass(frozen=True)
class Number(Expr):
    value: float

    def __str__(self) -> str:
        return f"{self.value:g}"


@dataclass(frozen=True)
class Text(Expr):
    value: str

    def __str__(self) -> str:
        return repr(self.value)


@dataclass(frozen=True)
class Boolean(Expr):
    value: bool

    def __str__(self) -> str:
        return str(self.value).lower()


@dataclass(frozen=True)
class Date(Expr):
    value: datetime.date

    def __str__(self) -> str:
        return f"DATE '{self.value}'"


@dataclass(frozen=True)
class Column(Expr):
    name: str
    table: str | None = None

    def __str__(self) -> str:
        return f"{self.table}.{self.name}" if self.table else self.name


@dataclass(frozen=True)
class Star(Expr):
    table: str | None = None

    def __str__(self) -> str:
        return f"{self.table}.*" if self.table else "*"


@dataclass(frozen=True)
class Unary(Expr):
    op: str
    operand: Expr

    def __str__(self) -> str:
        return f"{self.op}({self.operand})"


@dataclass(frozen=True)
class Binary(Expr):
    op: str
    left: Expr
    right: Expr

    def __str__(self) -> str:
        return f"({self.left} {self.op} {self.right})"


@dataclass(frozen=True)
class Between(Expr):
    value: Expr
    low: Expr
    high: Expr

    def __str__(self) -> str:
        return f"({self.value} between {self.low} and {self.high})"


@dataclass(frozen=True)
class InList(Expr):
    value: Expr
    items: tuple[Expr, ...]

    def __str__(self) -> str:
        return f"({self.value} in ({', '.join(map(str, self.items))}))"


@dataclass(frozen=True)
class Call(Expr):
    name: str
    args: tuple[Expr, ...]

    def __str__(self) -> str:
        return f"{self.name}({', '.join(map(str, self.args))})"


@dataclass(frozen=True)
class Subquery(Expr):
    query: Select

    def __str__(self) -> str:
        return "(subquery)"


@dataclass(frozen=True)
class Target:
    expr: Expr
    alias: str | None = None


@dataclass(frozen=True)
class TableRef:
    name: str
    alias: str


@dataclass(frozen=True)
class DerivedRef:
    query: Select
    alias: str | None


@dataclass(frozen=True)
class FunctionRef:
    call: Call
    alias: str | None


@dataclass(frozen=True)
class SortKey:
    expr: Expr
    ascending: bool = True


@dataclass(frozen=True)
class Select:
    targets: tuple[Target, ...]
    sources: tuple[TableRef | DerivedRef | FunctionRef, ...] = ()
    where: Expr | None = None
    groups: tuple[Expr, ...] = ()
    having: Expr | None = None
    order: tuple[SortKey, ...] = ()
    limit: Expr | None = None
    offset: Expr | None = None
    distinct: bool = False


def conjuncts(e: Expr | None) -> list[Expr]:
    """The parts of a top-level conjunction."""
    if e is None:
        return []
    if isinstance(e, Binary) and e.op == "and":
        return conjuncts(e.left) + conjuncts(e.right)
    return [e]


def conjunction(parts: list[Expr]) -> Expr | None:
    out = None
    for p in parts:
        out = p if out is None else Binary("and", out, p)
    return out


def outline(x: object, depth: int = 0) -> str:
    """An indented rendering of a syntax tree."""
    pad = "  " * depth
    if isinstance(x, tuple):
        return "\n".join(outline(i, depth) for i in x)
    if isinstance(x, Expr) and not isinstance(x, Subquery):
        return f"{pad}{x}"
    if hasattr(x, "__dataclass_fields__"):
        lines = [f"{pad}{type(x).__name__}"]
        for f in fields(x):
            v = getattr(x, f.name)
            if v is None or v == ():
                continue
            nested = isinstance(v, tuple) or hasattr(v, "__dataclass_fields__")
            lines.append(f"{pad}  {f.name}:\n{outline(v, depth + 2)}" if nested else f"{pad}  {f.name}: {v}")
        return "\n".join(lines)
    return f"{pad}{x}"
