"""Plan nodes: what to compute, as plain values. plans.lowering turns them into DataFrames.

They can be built by hand (expressions as text or as syntax trees) or from SQL by plans.binder.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, fields, replace

from planloom.dialect import parse_expression
from planloom.dialect.syntax import Boolean, Column, Expr


def _expr(e: Expr | str) -> Expr:
    return parse_expression(e) if isinstance(e, str) else e


class Plan:
    """A node; its identity is the object, so one tree may hold equal nodes twice."""

    def children(self) -> list[Plan]:
        out: list[Plan] = []
        for f in fields(self):
            v = getattr(self, f.name)
            out += [v] if isinstance(v, Plan) else [x for x in v if isinstance(x, Plan)] if isinstance(v, (list, tuple)) else []
        return out

    def walk(self) -> Iterator[Plan]:
        yield self
        for c in self.children():
            yield from c.walk()

    def rebuilt(self, change) -> Plan:
        """The tree with change applied to every node, children first."""
        new = {}
        for f in fields(self):
            v = getattr(self, f.name)
            if isinstance(v, Plan):
                new[f.name] = v.rebuilt(change)
            elif isinstance(v, list) and v and isinstance(v[0], Plan):
                new[f.name] = [x.rebuilt(change) for x in v]
        same = all(getattr(self, k) is v for k, v in new.items() if not isinstance(v, list)) and not any(isinstance(v, list) for v in new.values())
        return change(self if same else replace(self, **new))

    def label(self) -> str:
        parts = []
        for f in fields(self):
            v = getattr(self, f.name)
            if isinstance(v, Plan) or isinstance(v, list) and v and isinstance(v[0], Plan):
                continue
            shown = ", ".join(map(str, v)) if isinstance(v, (list, tuple)) else v
            if shown not in (None, "", False, []):
                parts.append(f"{f.name}={shown}")
        return f"{type(self).__name__}({'; '.join(parts)})"

    def pretty(self, depth: int = 0) -> str:
        return "\n".join(["  " * depth + self.label(), *(c.pretty(depth + 1) for c in self.children())])


@dataclass(eq=False)
class Scan(Plan):
    table: str
    alias: str | None = None

    def __post_init__(self):
        self.alias = self.alias or self.table


@dataclass(eq=False)
class Derived(Plan):
    """A query in FROM; only its alias qualifies its columns."""

    child: Plan
    alias: str


@dataclass(eq=False)
class TableFunction(Plan):
    """Rows of a registered table function with constant arguments."""

    name: str
    args: list = field(default_factory=list)
    alias: str | None = None

    def __post_init__(self):
        self.args = [_expr(a) for a in self.args]
        self.alias = self.alias or self.name


@dataclass(eq=False)
class OneRow(Plan):
    """One row without columns, for SELECT without FROM."""


@dataclass(eq=False)
class From(Plan):
    """Inner join of all sources on equalities between two of them each; the planner orders it."""

    sources: list[Plan]
    predicates: list = field(default_factory=list)

    def __post_init__(self):
        self.predicates = [_expr(p) for p in self.predicates]


@dataclass(eq=False)
class ThetaJoin(Plan):
    left: Plan
    right: Plan
    cond: Expr | str = Boolean(True)

    def __post_init__(self):
        self.cond = _expr(self.cond)


@dataclass(eq=False)
class HashJoin(Plan):
    """Inner join on one pair of expressions; of which side a table is built, Spark decides."""

    left: Plan
    right: Plan
    on: tuple

    def __post_init__(self):
        self.on = tuple(_expr(e) for e in self.on)


@dataclass(eq=False)
class Filter(Plan):
    child: Plan
    cond: Expr | str

    def __post_init__(self):
        self.cond = _expr(self.cond)


@dataclass(eq=False)
class Project(Plan):
    """child may be None: one row."""

    child: Plan | None
    exprs: list
    aliases: list[str] = field(default_factory=list)

    def __post_init__(self):
        self.exprs = [_expr(e) for e in self.exprs]
        self.aliases = list(self.aliases) or default_names(self.exprs)


@dataclass(eq=False)
class GroupBy(Plan):
    """Groups and projects: exprs may hold aggregates, group columns, and columns that group expressions refer to."""

    child: Plan
    groups: list
    exprs: list
    aliases: list[str] = field(default_factory=list)

    def __post_init__(self):
        self.groups, self.exprs = [_expr(e) for e in self.groups], [_expr(e) for e in self.exprs]
        self.aliases = list(self.aliases) or default_names(self.exprs)


@dataclass(eq=False)
class OrderBy(Plan):
    """Stable: rows that tie keep their order in the child."""

    child: Plan
    keys: list
    ascending: list[bool] = field(default_factory=list)

    def __post_init__(self):
        self.keys = [_expr(e) for e in self.keys]
        self.ascending = list(self.ascending) or [True] * len(self.keys)


@dataclass(eq=False)
class Limit(Plan):
    child: Plan
    limit: Expr | str | float
    offset: Expr | str | float = 0

    def __post_init__(self):
        self.limit, self.offset = _expr(self.limit), _expr(self.offset)


@dataclass(eq=False)
class Distinct(Plan):
    child: Plan


@dataclass(eq=False)
class Sink(Plan):
    child: Plan


class Yield(Sink):
    """Rows one by one, a partition at a time on the driver."""


class Collect(Sink):
    """All rows as a list."""


class Print(Sink):
    """Every row printed."""


def default_names(exprs: list[Expr], given: list[str | None] | None = None) -> list[str]:
    """A column keeps its name, anything else without an alias is a0, a1, ... in order."""
    out, n = [], 0
    for i, e in enumerate(exprs):
        name = given[i] if given else None
        if name is None and isinstance(e, Column):
            name = e.name
        if name is None:
            name, n = f"a{n}", n + 1
        out.append(name)
    return out
