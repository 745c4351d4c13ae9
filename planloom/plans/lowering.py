"""Plans to DataFrames.

Every column gets an internal name of its own, so sources may share column names; which output column a name means is
decided here, by qualifier and name with upper and lower case told apart. Expressions carry a kind (num, str, bool, date):
comparisons count as numbers and numbers as conditions, strings and numbers never mix. Everything is built-in
expressions, so Catalyst prunes columns, pushes filters down and picks the joins.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planloom import operators as P
from planloom.dialect import syntax as S
from planloom.functions import AggregateFunction, FunctionError, Registry, reduced
from planloom.plans.binder import BindError, constant, count_of, swap
from planloom.sources import Catalog, kind_of


#: The whole numbers of each integral type.
_RANGES = {name: (-(1 << bits - 1), (1 << bits - 1) - 1) for name, bits in (("tinyint", 8), ("smallint", 16), ("int", 32), ("bigint", 64))}


class KindError(TypeError):
    """An operator applied to a kind that it is not for."""


@dataclass(frozen=True)
class Field:
    table: str | None
    name: str
    kind: str
    column: str  # internal name
    type: str = ""  # of a source's column, as Spark names it


@dataclass(frozen=True)
class Members:
    """Rows of a grouping's input: tags by group. keys: (column of the groups, column of df), equal or both null."""

    df: DataFrame
    keys: tuple[tuple[str, str], ...]
    tags: dict[str, str]
    inner: tuple[Members, ...] = ()  # of groupings below, whose keys df has


@dataclass(frozen=True)
class Relation:
    """A DataFrame with its fields; for lineage, which columns hold the row ids of tagged nodes."""

    df: DataFrame
    fields: tuple[Field, ...]
    tags: dict[str, str] = field(default_factory=dict)
    members: tuple[Members, ...] = ()
    order: tuple[Column, ...] = ()  # of the rows, where the plan sorts them


class Lowering:
    """tag: called with each plan node and its relation, may return the relation with a row id added."""

    def __init__(self, spark: SparkSession, catalog: Catalog, functions: Registry, strict_empty: bool = False, tag: Callable[[P.Plan, Relation], Relation] | None = None):
        self.spark, self.catalog, self.functions = spark, catalog, functions
        self.strict_empty = strict_empty
        self.tagging = tag is not None
        self.tag = tag or (lambda plan, r: r)
        self._made = 0

    def fresh(self, name: str) -> str:
        self._made += 1
        return f"{re.sub(r'[^A-Za-z0-9_]', '_', name)}_{self._made}"

    def frame(self, plan: P.Plan) -> DataFrame:
        """The result under its output names; conditions as 0 and 1."""
        return self.result(self.lower(plan))

    def result(self, r: Relation, extra: tuple[Column, ...] = ()) -> DataFrame:
        shown = [F.col(f.column).cast("double") if f.kind == "bool" else F.col(f.column) for f in r.fields]
        return r.df.select(*[c.alias(f.name) for c, f in zip(shown, r.fields, strict=True)], *extra)

    def lower(self, plan: P.Plan) -> Relation:
        match plan:
            case P.Scan():
                r = self.source(self.catalog[plan.table], plan.alias)
            case P.TableFunction():
                f = self.functions.get(plan.name, len(plan.args))
                r = self.source(f.build(self.spark, *map(constant, plan.args)), plan.alias)
            case P.Derived():
                r = self.lower(self.unsorted(plan.child))
                r = replace(r, fields=tuple(replace(f, table=plan.alias) for f in r.fields))
            case P.OneRow():
                r = Relation(self.spark.range(1).select(), ())
            case P.From():
                r = self.joined(plan)
            case P.ThetaJoin():
                r = self.theta(self.lower(plan.left), self.lower(plan.right), plan.cond)
            case P.HashJoin():
                left, right = self.lower(plan.left), self.lower(plan.right)
                (a, ak), (b, bk) = self.expr(plan.on[0], left.fields), self.expr(plan.on[1], right.fields)
                r = self.both(left, right, self.compared("=", a, ak, b, bk))
            case P.Filter():
                r = self.lower(plan.child)
                r = replace(r, df=r.df.where(self.condition(plan.cond, r.fields)))
            case P.Project():
                r = self.project(plan)
            case P.GroupBy():
                r = self.grouped(plan)
            case P.OrderBy():
                r = self.sorted(plan)
            case P.Limit():
                r = self.lower(plan.child)
                n, skip = count_of(plan.limit), count_of(plan.offset)
                r = replace(r, df=(r.df.offset(skip) if skip else r.df).limit(n))
            case P.Distinct():
                r = self.distinct(self.lower(plan.child))
            case P.Sink():
                return self.lower(plan.child)
            case _:
                raise BindError(f"cannot run {type(plan).__name__}")
        return self.tag(plan, r)

    # sources and joins

    def source(self, df: DataFrame, alias: str) -> Relation:
        fields = tuple(Field(alias, f.name, kind_of(f.dataType), self.fresh(f"{alias}_{f.name}"), f.dataType.simpleString()) for f in df.schema)
        return Relation(df.toDF(*[f.column for f in fields]), fields)

    def both(self, a: Relation, b: Relation, cond: Column | None) -> Relation:
        df = a.df.crossJoin(b.df) if cond is None else a.df.join(b.df, cond)
        return Relation(df, a.fields + b.fields, a.tags | b.tags, a.members + b.members)

    def theta(self, a: Relation, b: Relation, cond: S.Expr) -> Relation:
        on = None if cond == S.Boolean(True) else self.condition(cond, a.fields + b.fields)
        return self.both(a, b, on)

    def joined(self, plan: P.From) -> Relation:
        """In the written order, but linked sources first, so that a cross product is made only where nothing links."""
        waiting, conds = [self.lower(s) for s in plan.sources], list(plan.predicates)
        r = waiting.pop(0)
        while waiting:
            ready = lambda s: [c for c in conds if self.bound(c, r.fields + s.fields)]
            s = next((s for s in waiting if ready(s)), waiting[0])
            waiting.remove(s)
            on = ready(s)
            conds = [c for c in conds if c not in on]
            r = self.theta(r, s, S.conjunction(on) or S.Boolean(True))
        for c in conds:
            r = replace(r, df=r.df.where(self.condition(c, r.fields)))
        return r

    def bound(self, e: S.Expr, fields: tuple[Field, ...]) -> bool:
        return all(len(self.matches(c, fields)) == 1 for c in e.columns())

    # projection, grouping, sorting

    def project(self, plan: P.Project) -> Relation:
        r = Relation(self.spark.range(1).select(), ()) if plan.child is None else self.lower(plan.child)
        made, fields = [], []
        for e, name in zip(plan.exprs, plan.aliases, strict=True):
            c, kind = self.expr(e, r.fields)
            of = self.matched(e, r.fields).type if isinstance(e, S.Column) else ""
            fields.append(Field(None, name, kind, self.fresh(name), of))
            made.append(c.alias(fields[-1].column))
        held = self.held(r)
        return replace(r, df=r.df.select(*made, *held), fields=tuple(fields), order=())

    def held(self, r: Relation) -> list[str]:
        """Columns that lineage needs beside the fields."""
        return list(dict.fromkeys([*r.tags.values(), *(k for m in r.members for k, _ in m.keys)]))

    def grouped(self, plan: P.GroupBy) -> Relation:
        r = self.lower(plan.child)
        keys = {self.fresh("g"): self.expr(g, r.fields) for g in plan.groups}
        of_key = dict(zip(plan.groups, keys, strict=True))
        scope = r.fields
        # A column that stands inside a group expression without being a key: its value in the group's last row.
        inner = [c for g in plan.groups for c in g.columns()]
        loose: dict[str, Field] = {}
        fields: list[Field] = []
        df = r.df
        for c in dict.fromkeys(inner):
            f = self.matched(c, scope)
            key = next((of_key[g] for g in of_key if isinstance(g, S.Column) and self.matched(g, scope) == f), None)
            if key is None:
                loose[self.fresh(f"last_{f.name}")] = f
            fields.append(replace(f, column=key or list(loose)[-1]))  # of the same type
        aggs: dict[S.Expr, tuple[str, AggregateFunction, list[Column]]] = {}

        def lifted(e: S.Expr) -> S.Expr:
            def change(x: S.Expr) -> S.Expr | None:
                if isinstance(x, S.Call) and self.functions.is_aggregate(x.name):
                    if x not in aggs:
                        aggs[x] = (self.fresh(x.name), self.functions.get(x.name, len(x.args)), [self.number(a, scope) for a in x.args])
                    return S.Column(aggs[x][0], "*agg")
                return None

            return swap(e, change)

        exprs = [lifted(e) for e in plan.exprs]
        order = self.fresh("order")
        df = df.select("*", *[c.alias(k) for k, (c, _) in keys.items()], *([F.monotonically_increasing_id().alias(order)] if loose else []))
        tagged = df
        native = [f.over(df, args).alias(name) for name, f, args in aggs.values() if f.native]
        if loose:
            last = F.max_by(F.struct(*[F.col(f.column).alias(k) for k, f in loose.items()]), order)
            native.append(last.alias("__last"))
        whole = [(name, f, args) for name, f, args in aggs.values() if not f.native and not f.partial]
        parts = [(name, f, args) for name, f, args in aggs.values() if f.partial]
        frames = [df.groupBy(*keys).agg(*native)] if native else []
        if whole:  # pandas aggregates share one shuffle, but not with native ones
            frames.append(df.groupBy(*keys).agg(*[f.build(*args).alias(name) for name, f, args in whole]))
        if parts:
            frames.append(reduced(df, list(keys), parts))
        if not frames:
            frames.append(df.select(*keys).distinct() if keys else df.groupBy().agg(F.count(F.lit(1)).alias("__rows")))
        out = frames[0]
        for one in frames[1:]:
            renamed = one.withColumnsRenamed({k: f"{k}_r" for k in keys})
            cond = None
            for k in keys:
                on = out[k].eqNullSafe(renamed[f"{k}_r"])
                cond = on if cond is None else cond & on
            out = (out.crossJoin(renamed) if cond is None else out.join(renamed, cond)).drop(*[f"{k}_r" for k in keys])
        if loose:
            out = out.select("*", "__last.*")
        if not keys and self.strict_empty and aggs:
            n = df.agg(F.count(F.lit(1)).alias("__n")).where("__n > 0")
            out = out.crossJoin(n).drop("__n")
        fields += [Field("*agg", name, "num", name) for name, _, _ in aggs.values()]
        made, shown = [], []
        for e, name in zip(exprs, plan.aliases, strict=True):
            c, kind = self.expr(e, tuple(fields))
            shown.append(Field(None, name, kind, self.fresh(name)))
            made.append(c.alias(shown[-1].column))
        members = r.members
        if r.tags or r.members:
            renamed = tagged.select(*[F.col(k).alias(f"{k}_m") for k in keys], *self.held(r))
            members = (Members(renamed, tuple((k, f"{k}_m") for k in keys), dict(r.tags), r.members),)
        return Relation(out.select(*made, *(keys if members else [])), tuple(shown), {}, members)

    def unsorted(self, plan: P.Plan) -> P.Plan:
        """A query in FROM without the sort that only orders its rows: joins and groups above do not see it.

        Where row ids are taken the sort stays, as a row's place is its id.
        """
        if self.tagging:
            return plan
        if isinstance(plan, P.Project) and plan.child is not None:
            child = self.unsorted(plan.child)
            return plan if child is plan.child else replace(plan, child=child)
        return plan.child if isinstance(plan, P.OrderBy) else plan

    def distinct(self, r: Relation) -> Relation:
        columns, members = [f.column for f in r.fields], ()
        if r.tags or r.members:  # a grouping by all columns
            renamed = r.df.select(*[F.col(c).alias(f"{c}_m") for c in columns], *self.held(r))
            members = (Members(renamed, tuple((c, f"{c}_m") for c in columns), dict(r.tags), r.members),)
            fields = tuple(replace(f, column=self.fresh(f.name)) for f in r.fields)
            df = r.df.select(*columns).distinct().select("*", *[F.col(c).alias(f.column) for c, f in zip(columns, fields, strict=True)])
            return Relation(df, fields, {}, members)
        return replace(r, df=r.df.select(*columns).distinct(), order=())

    def sorted(self, plan: P.OrderBy) -> Relation:
        """Rows that tie keep the order in which the child makes them; constants sort nothing."""
        r = self.lower(plan.child)
        tie = self.fresh("order")
        keys = []
        for e, up in zip(plan.keys, plan.ascending, strict=True):
            if e.columns():
                c, _ = self.expr(e, r.fields)
                keys.append(c.asc() if up else c.desc())
        if not keys:
            return r
        df = r.df.withColumn(tie, F.monotonically_increasing_id()).orderBy(*keys, tie)
        return replace(r, df=df, order=(*keys, F.col(tie)))

    # expressions

    def matches(self, c: S.Column, fields: tuple[Field, ...]) -> list[Field]:
        return [f for f in fields if f.name == c.name and c.table in (None, f.table) and (c.table or f.table != "*agg")]

    def matched(self, c: S.Column, fields: tuple[Field, ...]) -> Field:
        found = self.matches(c, fields)
        if len(found) != 1:
            raise BindError(f"{c} is {'ambiguous' if found else 'unknown'}")
        return found[0]

    def number(self, e: S.Expr, fields: tuple[Field, ...]) -> Column:
        c, kind = self.expr(e, fields)
        return c.cast("double") if kind == "bool" else c

    def condition(self, e: S.Expr, fields: tuple[Field, ...]) -> Column:
        c, kind = self.expr(e, fields)
        return c if kind == "bool" else self.truth(c, kind)

    def truth(self, c: Column, kind: str) -> Column:
        if kind == "num":
            return c != 0
        if kind == "bool":
            return c
        raise KindError("a string or date is not a condition")

    def numeric(self, c: Column, kind: str, op: str) -> Column:
        if kind not in ("num", "bool"):
            raise KindError(f"Type error in expression: {op} of a {kind}")
        return c.cast("double") if kind == "bool" else c

    def compared(self, op: str, a: Column, ak: str, b: Column, bk: str) -> Column:
        numbers = {"num", "bool"}
        if ak in numbers and bk in numbers:
            a, b = self.numeric(a, ak, op), self.numeric(b, bk, op)
        elif ak != bk or op in ("<", ">", "<=", ">=") and ak == "str":
            raise KindError(f"Type error in expression: {ak} {op} {bk}")
        return {"=": a == b, "<>": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]

    def whole(self, e: S.Expr, other: S.Expr, fields: tuple[Field, ...]) -> Column | None:
        """A whole number beside an integral column as a literal of the column's type, so that scans see the comparison.

        Beside anything else numbers are doubles, to which a comparison would cast the column, off the scan's filters and
        inexact above 2 ** 53.
        """
        value = -e.operand.value if isinstance(e, S.Unary) and e.op == "-" and isinstance(e.operand, S.Number) else e.value if isinstance(e, S.Number) else None
        if value is None or not isinstance(other, S.Column) or isinstance(value, float) and not value.is_integer():
            return None
        f = self.matched(other, fields)
        low, high = _RANGES.get(f.type, (1, 0))
        return F.lit(int(value)).cast(f.type) if low <= int(value) <= high else None

    def sides(self, op: str, a: S.Expr, b: S.Expr, fields: tuple[Field, ...]) -> Column:
        (x, xk), (y, yk) = self.expr(a, fields), self.expr(b, fields)
        left, right = self.whole(a, b, fields), self.whole(b, a, fields)
        return self.compared(op, x if left is None else left, xk, y if right is None else right, yk)

    def expr(self, e: S.Expr, fields: tuple[Field, ...]) -> tuple[Column, str]:
        match e:
            case S.Number(value=v):
                return F.lit(float(v)), "num"
            case S.Text(value=v):
                return F.lit(v), "str"
            case S.Boolean(value=v):
                return F.lit(v), "bool"
            case S.Date(value=v):
                return F.lit(v), "date"
            case S.Column():
                f = self.matched(e, fields)
                return F.col(f.column), f.kind
            case S.Unary(op=op, operand=x):
                c, kind = self.expr(x, fields)
                if op == "not":
                    return ~self.truth(c, kind), "bool"
                c = self.numeric(c, kind, op)
                return (-c if op == "-" else c), "num"
            case S.Binary(op="and" | "or" as op, left=a, right=b):
                x, y = self.condition(a, fields), self.condition(b, fields)
                return (x & y if op == "and" else x | y), "bool"
            case S.Binary(op="like", left=a, right=S.Text(value=p)):
                c, kind = self.expr(a, fields)
                if kind != "str":
                    raise KindError("like is for strings")
                return c.like(p), "bool"
            case S.Binary(op=op, left=a, right=b):
                if op in ("+", "-", "*", "/"):
                    (x, xk), (y, yk) = self.expr(a, fields), self.expr(b, fields)
                    x, y = self.numeric(x, xk, op), self.numeric(y, yk, op)
                    return {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: x / y}[op](), "num"
                if op == "like":
                    raise KindError("like needs a literal pattern")
                return self.sides(op, a, b, fields), "bool"
            case S.Between(value=v, low=lo, high=hi):
                (x, xk), (a, ak), (b, bk) = (self.expr(p, fields) for p in (v, lo, hi))
                if xk == ak == bk == "str":
                    return x.between(a, b), "bool"
                return self.sides(">=", v, lo, fields) & self.sides("<=", v, hi, fields), "bool"
            case S.InList(value=v, items=items):
                x, xk = self.expr(v, fields)
                out = None
                listed = [self.expr(i, fields) for i in items]
                if all(isinstance(i, (S.Number, S.Text)) for i in items) and all(k == xk for _, k in listed):
                    known = [self.whole(i, v, fields) for i in items]
                    if all(c is not None for c in known):
                        return x.isin(known), "bool"
                    return x.isin([i.value for i in items]), "bool"
                for i in items:
                    one = self.sides("=", v, i, fields)
                    out = one if out is None else out | one
                return out, "bool"
            case S.Call(name=name, args=args):
                f = self.functions.get(name, len(args))
                if isinstance(f, AggregateFunction):
                    raise FunctionError(f"{name} is an aggregate and has no group here")
                return f.build(*[self.number(a, fields) for a in args]), f.kind
        raise BindError(f"cannot evaluate {e}")
