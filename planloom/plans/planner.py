"""Join order by estimated cost: dynamic programming over sets of sources, or exhaustive search.

Works on names and numbers only: the result is a join tree, and the order never changes a query's result. Each pair of
inputs can be joined by nested loops either way round, by a table on each equality between them either way round (other
equalities filter its result), or by a cross product if no equality links them. `plans_tested` counts the alternatives
whose cost was estimated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from planloom import operators as P
from planloom.dialect import syntax as S
from planloom.sources import Catalog

#: Fixed values of the cost model.
DEFAULT_SELECTIVITY = 0.05
OUTPUT_COST = 0.05


class Estimates:
    """Cardinality of a source and selectivity of an attribute, from the catalog's statistics."""

    def __init__(self, catalog: Catalog):
        self.catalog = catalog

    def rows(self, plan: P.Plan) -> float:
        match plan:
            case P.Scan():
                return float(self.catalog.stats(plan.table).card)
            case P.Filter():
                return self.rows(plan.child) * DEFAULT_SELECTIVITY
            case P.OneRow():
                return 1.0
            case P.TableFunction():
                return 1000.0
        out = 1.0
        for c in plan.children():
            out *= self.rows(c)
        return out

    def attribute(self, column: S.Column, source: P.Plan) -> float:
        if not isinstance(source, P.Scan):
            return 1.0
        kinds, stats = dict(self.catalog.schema(source.table)), self.catalog.stats(source.table)
        if column.name not in kinds or not stats.card:
            return 1.0
        c = stats.column(column.name)
        if kinds[column.name] == "num" and c["min"] is not None:
            return 1.0 / (float(c["max"]) - float(c["min"]) + 1)
        return 1.0 / max(c["ndistinct"], 1)


@dataclass(frozen=True)
class Edge:
    """An equality between two sources; columns are None where a side is not a bare column."""

    cond: S.Expr
    sources: frozenset[int]
    sides: tuple[tuple[int, S.Expr], ...] = ()  # (source, expression), if each side has one source


@dataclass(frozen=True)
class Candidate:
    """The best known way to join a set of sources."""

    sources: frozenset[int]
    cost: float
    rows: float
    build: Callable[[], P.Plan]


@dataclass
class JoinPlanner:
    estimates: Estimates
    plans_tested: int = 0
    _sources: list[P.Plan] = field(default_factory=list)
    _edges: list[Edge] = field(default_factory=list)

    def order(self, sources: list[P.Plan], edges: list[Edge]) -> P.Plan:
        self._sources, self._edges, self.plans_tested = sources, edges, 0
        return self.search([self.single(i) for i in range(len(sources))]).build()

    def search(self, singles: list[Candidate]) -> Candidate:
        raise NotImplementedError

    def single(self, i: int) -> Candidate:
        n = self.estimates.rows(self._sources[i])
        return Candidate(frozenset([i]), n, n, lambda: self._sources[i])

    def touching(self, a: frozenset[int]) -> list[Edge]:
        return [e for e in self._edges if e.sources & a]

    def selectivity(self, i: int, e: S.Expr) -> float:
        return self.estimates.attribute(e, self._sources[i]) if isinstance(e, S.Column) else DEFAULT_SELECTIVITY

    def alternatives(self, a: Candidate, b: Candidate) -> Iterator[Candidate]:
        """Every way to join a and b. An edge that touches both but does not lie between them only filters."""
        both, product = a.sources | b.sources, a.rows * b.rows
        edges = [e for e in self.touching(a.sources) if e.sources & b.sources]
        if not edges:
            yield Candidate(both, a.cost + a.rows * b.cost + OUTPUT_COST * product, product, lambda: P.ThetaJoin(a.build(), b.build()))
            return
        cond, sel = S.conjunction([e.cond for e in edges]), DEFAULT_SELECTIVITY ** len(edges)
        for x, y in ((a, b), (b, a)):
            yield Candidate(both, x.cost + x.rows * y.cost + OUTPUT_COST * product * sel, product * sel, lambda x=x, y=y: P.ThetaJoin(x.build(), y.build(), cond))
        for e in edges:
            if not e.sides or not e.sources <= both:
                continue
            rest = S.conjunction([o.cond for o in edges if o is not e])
            joined = product * min(1.0, *(self.selectivity(i, x) for i, x in e.sides))
            rows = joined * DEFAULT_SELECTIVITY ** (len(edges) - 1)
            for x, y in ((a, b), (b, a)):
                on = tuple(next(s for i, s in e.sides if i in z.sources) for z in (x, y))

                def build(x=x, y=y, on=on, rest=rest) -> P.Plan:
                    join = P.HashJoin(x.build(), y.build(), on)
                    return P.Filter(join, rest) if rest else join

                yield Candidate(both, x.cost + y.cost + OUTPUT_COST * joined, rows, build)

    def best(self, found: Candidate | None, options: Iterator[Candidate]) -> Candidate | None:
        for c in options:
            self.plans_tested += 1
            if found is None or c.cost < found.cost:
                found = c
        return found


class Selinger(JoinPlanner):
    """The best plan of each linked set of sources, from the best plans of sets with one source less."""

    def search(self, singles: list[Candidate]) -> Candidate:
        self.plans_tested += len(singles)
        level = {s.sources: s for s in singles}
        for _ in singles[1:]:
            grown: dict[frozenset[int], Candidate] = {}
            for known in level.values():
                for s in singles:
                    target = known.sources | s.sources
                    if s.sources <= known.sources or target in grown or not self.touching(target):
                        continue
                    found = None
                    for one in singles:
                        if one.sources < target and (rest := level.get(target - one.sources)):
                            found = self.best(found, self.alternatives(one, rest))
                    grown[target] = found
            if not grown:  # nothing is linked any more: cross products, from the cheapest
                last = min(level.values(), key=lambda c: c.cost)
                for s in singles:
                    if not s.sources <= last.sources:
                        last = self.best(None, self.alternatives(last, s))
                return last
            level = grown
        return next(iter(level.values()))


class Exhaustive(JoinPlanner):
    """Every order: each source in turn joins the best plan of all others. For comparison only."""

    def search(self, singles: list[Candidate]) -> Candidate:
        if len(singles) == 1:
            return singles[0]
        found = None
        for i, one in enumerate(singles):
            found = self.best(found, self.alternatives(self.search(singles[:i] + singles[i + 1 :]), one))
        return found


PLANNERS = {"selinger": Selinger, "exhaustive": Exhaustive}


def ordered(plan: P.Plan, catalog: Catalog, sides, kind: str) -> tuple[P.Plan, int]:
    """plan with every From replaced by joins in the order that the planner picks, and the plans it tested.

    sides: (sources, expression) -> the places of the sources that an expression refers to.
    """
    planner, tested = PLANNERS[kind](Estimates(catalog)), 0

    def change(node: P.Plan) -> P.Plan:
        nonlocal tested
        if not isinstance(node, P.From):
            return node
        edges, filters = [], []
        for s in (s for s in node.sources if isinstance(s, P.Scan)):  # one scan of a table for all that is asked of it
            known = {n for n, _ in catalog.schema(s.table)}
            catalog.stats(s.table).gather([c.name for p in node.predicates for c in p.columns() if c.table in (None, s.alias) and c.name in known])
        for p in node.predicates:
            of = sides(node.sources, p)
            parts = [(sides(node.sources, x), x) for x in (p.left, p.right)] if isinstance(p, S.Binary) and p.op == "=" else []
            if len(of) != 2:
                filters.append(p)
                continue
            single = len(parts) == 2 and all(len(s) == 1 for s, _ in parts)
            edges.append(Edge(p, of, tuple((min(s), x) for s, x in parts) if single else ()))
        out = planner.order(node.sources, edges)
        tested += planner.plans_tested
        for f in filters:
            out = P.Filter(out, f)
        return out

    return plan.rebuilt(change), tested
