"""Syntax tree to plan: aliases, stars, join predicates, grouping checks, hidden columns and constant limits.

The order of a block is From, Filter (one for each conjunct), GroupBy, Filter (having), OrderBy, Limit, Project. Sorting
stands below the projection, so it sees source columns and never output names.
"""

from __future__ import annotations

from dataclasses import fields, replace

from planloom import operators as P
from planloom.dialect import syntax as S
from planloom.functions import Registry
from planloom.sources import Catalog


class BindError(ValueError):
    """A query that parses but has no meaning."""


def constant(e: S.Expr | float) -> float:
    """The value of an expression without columns."""
    match e:
        case int() | float():
            return e
        case S.Number(value=v) | S.Boolean(value=v):
            return float(v)
        case S.Unary(op="-", operand=x):
            return -constant(x)
        case S.Unary(op="+", operand=x):
            return constant(x)
        case S.Unary(op="not", operand=x):
            return float(not constant(x))
        case S.Binary(op=op, left=a, right=b):
            x, y = constant(a), constant(b)
            ops = {"+": x + y, "-": x - y, "*": x * y, "=": x == y, "<>": x != y, "<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y, "and": x and y, "or": x or y}
            if op == "/":
                return x / y
            if op in ops:
                return float(ops[op])
    raise BindError(f"{e} is not a constant number")


def count_of(e: S.Expr | float) -> int:
    """A LIMIT or OFFSET: constant, cut to a whole number, not negative."""
    v = constant(e)
    if v < 0:
        raise BindError(f"a limit of {v:g} is negative")
    return int(v)


def swap(e: S.Expr, change) -> S.Expr:
    """e with change applied to its parts from the top; where change gives None it goes on below."""
    new = change(e)
    if new is not None:
        return new
    updates = {}
    for f in fields(e):
        v = getattr(e, f.name)
        if isinstance(v, S.Expr):
            updates[f.name] = swap(v, change)
        elif isinstance(v, tuple):
            updates[f.name] = tuple(swap(x, change) if isinstance(x, S.Expr) else x for x in v)
    return replace(e, **updates) if updates else e


class Binder:
    def __init__(self, catalog: Catalog, functions: Registry):
        self.catalog, self.functions = catalog, functions

    def aggregates(self, e: S.Expr) -> list[S.Call]:
        return [x for x in e.walk() if isinstance(x, S.Call) and self.functions.is_aggregate(x.name)]

    def output(self, plan: P.Plan) -> list[tuple[str | None, str]]:
        """(qualifier, name) of each column of a plan."""
        match plan:
            case P.Scan():
                return [(plan.alias, n) for n, _ in self.catalog.schema(plan.table)]
            case P.Derived():
                return [(plan.alias, n) for _, n in self.output(plan.child)]
            case P.TableFunction():
                f = self.functions.get(plan.name, len(plan.args))
                return [(plan.alias, n) for n in f.build(self.catalog.spark, *map(constant, plan.args)).columns]
            case P.Project() | P.GroupBy():
                return [(None, n) for n in plan.aliases]
        return [c for child in plan.children() for c in self.output(child)]

    def resolve(self, c: S.Column, scope: list[tuple[str | None, str]]) -> tuple[str | None, str]:
        found = [x for x in scope if x[1] == c.name and c.table in (None, x[0])]
        if len(found) != 1:
            raise BindError(f"{c} is {'ambiguous' if found else 'unknown'}")
        return found[0]

    def check(self, e: S.Expr, scope: list[tuple[str | None, str]]) -> None:
        for x in e.walk():
            if isinstance(x, S.Subquery):
                raise BindError("a subquery is only allowed in FROM")
            if isinstance(x, S.Star):
                raise BindError("* stands alone in a select list")
            if isinstance(x, S.Column):
                self.resolve(x, scope)
            if isinstance(x, S.Call):
                self.functions.get(x.name, len(x.args))

    def bind(self, q: S.Select) -> P.Plan:
        sources, scope = self.sources(q)
        exprs, given = self.targets(q, sources, scope)
        names = P.default_names(exprs, given)
        everything = [*exprs, *S.conjuncts(q.where), *q.groups, *S.conjuncts(q.having), *(k.expr for k in q.order)]
        for e in everything:
            self.check(e, scope)
        for e in [*S.conjuncts(q.where), *q.groups]:
            if self.aggregates(e):
                raise BindError(f"an aggregate cannot stand in WHERE or GROUP BY: {e}")
        plan = self.joined(q, sources, scope)
        grouped = bool(q.groups) or any(self.aggregates(e) for e in [*exprs, *S.conjuncts(q.having), *(k.expr for k in q.order)])
        order = [k for k in q.order if k.expr.columns() or self.aggregates(k.expr)]  # a constant key sorts nothing
        if grouped:
            plan, exprs, order, having = self.grouped(q, plan, exprs, names, order, scope)
        else:
            having = S.conjuncts(q.having)
        for e in having:
            plan = P.Filter(plan, e)
        if q.distinct:
            return self.distinct(q, plan, exprs, names, order)
        if order:
            plan = P.OrderBy(plan, [k.expr for k in order], [k.ascending for k in order])
        plan = self.limited(q, plan)
        return P.Project(plan, exprs, names)

    def limited(self, q: S.Select, plan: P.Plan) -> P.Plan:
        if q.limit is None:
            return plan
        return P.Limit(plan, count_of(q.limit), count_of(q.offset) if q.offset is not None else 0)

    def distinct(self, q, plan, exprs, names, order) -> P.Plan:
        """SELECT DISTINCT: duplicates go after the projection, so keys must be among the targets."""
        plan = P.Distinct(P.Project(plan, exprs, names))
        keys = []
        for k in order:
            if k.expr not in exprs:
                raise BindError(f"with DISTINCT, {k.expr} must be selected to sort by it")
            keys.append(S.Column(names[exprs.index(k.expr)]))
        if keys:
            plan = P.OrderBy(plan, keys, [k.ascending for k in order])
        return self.limited(q, plan)

    def sources(self, q: S.Select) -> tuple[list[P.Plan], list[tuple[str | None, str]]]:
        plans: list[P.Plan] = []
        unnamed = 0
        for s in q.sources:
            match s:
                case S.TableRef(name=name, alias=alias):
                    if name not in self.catalog:
                        raise BindError(f"no table is named {name}")
                    plans.append(P.Scan(name, alias))
                case S.FunctionRef(call=call, alias=alias):
                    self.functions.get(call.name, len(call.args))
                    plans.append(P.TableFunction(call.name, list(call.args), alias))
                case S.DerivedRef(query=query, alias=alias):
                    if alias is None:
                        alias, unnamed = f"t{unnamed}", unnamed + 1
                    plans.append(P.Derived(self.bind(query), alias))
        aliases = [p.alias for p in plans]
        if len(set(aliases)) != len(aliases):
            raise BindError(f"an alias stands twice: {', '.join(aliases)}")
        return plans, [c for p in plans for c in self.output(p)]

    def targets(self, q, sources, scope) -> tuple[list[S.Expr], list[str | None]]:
        exprs: list[S.Expr] = []
        given: list[str | None] = []
        for t in q.targets:
            if not isinstance(t.expr, S.Star):
                exprs.append(t.expr)
                given.append(t.alias)
                continue
            if not sources:
                raise BindError("* needs a FROM")
            of = [c for c in scope if t.expr.table in (None, c[0])]
            if not of:
                raise BindError(f"no source is named {t.expr.table}")
            exprs += [S.Column(n, a) for a, n in of]
            given += [n for _, n in of]
        return exprs, given

    def joined(self, q, sources, scope) -> P.Plan:
        """From with the equalities between two sources; every other conjunct is a filter of its own."""
        join, rest = [], []
        for e in S.conjuncts(q.where):
            sides = {self.resolve(c, scope)[0] for c in e.columns()}
            (join if isinstance(e, S.Binary) and e.op == "=" and len(sides) == 2 else rest).append(e)
        plan: P.Plan = P.From(sources, join) if sources else P.OneRow()
        for e in rest:
            plan = P.Filter(plan, e)
        return plan

    def grouped(self, q, plan, exprs, names, order, scope):
        """GroupBy with the targets and, hidden, what HAVING and ORDER BY need; then what reads these columns."""
        allowed = {self.resolve(c, scope) for g in q.groups for c in g.columns()}

        def outside(e: S.Expr) -> list[S.Column]:
            if isinstance(e, S.Call) and self.functions.is_aggregate(e.name):
                return []
            return [e] if isinstance(e, S.Column) else [c for x in e.children() for c in outside(x)]

        for e in [*exprs, *S.conjuncts(q.having), *(k.expr for k in order)]:
            for c in outside(e):
                if self.resolve(c, scope) not in allowed:
                    raise BindError(f"{c} is neither grouped nor aggregated")
        made: list[S.Expr] = []

        def hidden(e: S.Expr) -> S.Expr:
            def change(x: S.Expr) -> S.Expr | None:
                if not (isinstance(x, S.Column) or isinstance(x, S.Call) and self.functions.is_aggregate(x.name)):
                    return None
                if x not in made:
                    made.append(x)
                return S.Column(f"_h{made.index(x)}")

            return swap(e, change)

        having = [hidden(e) for e in S.conjuncts(q.having)]
        keys = [replace(k, expr=hidden(k.expr)) for k in order]
        outer = [f"_o{i}" for i in range(len(exprs))]
        plan = P.GroupBy(plan, list(q.groups), [*exprs, *made], [*outer, *(f"_h{i}" for i in range(len(made)))])
        return plan, [S.Column(o) for o in outer], keys, having
