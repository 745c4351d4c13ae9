"""The engine: SQL text or plans in, DataFrames out."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession

from planloom import operators as P
from planloom.dialect import parse
from planloom.dialect import syntax as S
from planloom.functions import Registry
from planloom.plans import planner
from planloom.plans.binder import Binder
from planloom.plans.lineage import Lineage, LineagePolicy
from planloom.plans.lowering import Lowering
from planloom.sources import Catalog


class Engine:
    """join_order: None leaves it to Catalyst; "selinger" and "exhaustive" fix it by estimated cost.

    The planners need the statistics of the tables, which are computed by scanning them.
    strict_empty: a global aggregate of no rows gives no row (SQL gives one).
    """

    def __init__(self, spark: SparkSession, join_order: str | None = None, strict_empty: bool = False, views: bool = True):
        self.spark, self.join_order, self.strict_empty = spark, join_order, strict_empty
        self.catalog, self.functions = Catalog(spark, views), Registry()
        self.plans_tested = 0

    @property
    def binder(self) -> Binder:
        return Binder(self.catalog, self.functions)

    def plan(self, query: str | S.Select | P.Plan) -> P.Plan:
        """The plan that runs: bound, and with joins ordered if the engine orders them."""
        if isinstance(query, str):
            query = parse(query)
        plan = self.binder.bind(query) if isinstance(query, S.Select) else query
        if not self.join_order:
            return plan
        plan, self.plans_tested = planner.ordered(plan, self.catalog, self._sides, self.join_order)
        return plan

    def _sides(self, sources: list[P.Plan], e: S.Expr) -> frozenset[int]:
        scopes = [self.binder.output(s) for s in sources]
        return frozenset(i for c in e.columns() for i, scope in enumerate(scopes) if any(n == c.name and c.table in (None, q) for q, n in scope))

    def lowering(self, **options) -> Lowering:
        return Lowering(self.spark, self.catalog, self.functions, self.strict_empty, **options)

    def df(self, query: str | P.Plan) -> DataFrame:
        return self.lowering().frame(self.plan(query))

    def schema(self, query: str | P.Plan) -> list[tuple[str, str]]:
        """(name, kind) of each output column."""
        return [(f.name, "num" if f.kind == "bool" else f.kind) for f in self.lowering().lower(self.plan(query)).fields]

    def code(self, query: str | P.Plan) -> str:
        """The plan, and the Java code that Spark generates for each of its stages."""
        conf, name = self.spark.conf, "spark.sql.adaptive.enabled"
        before = conf.get(name)
        conf.set(name, "false")  # an adaptive plan generates its code only while it runs
        try:
            found = self.df(query)._jdf.queryExecution().debug().codegenToSeq()
        finally:
            conf.set(name, before)
        return "\n\n".join([self.plan(query).pretty(), *(x for i in range(found.size()) for x in (found.apply(i)._1(), found.apply(i)._2()))])

    def write_code(self, query: str | P.Plan, path: str) -> None:
        with open(path, "w") as f:
            f.write(self.code(query))

    def run(self, query: str | P.Plan) -> list[Row] | Iterator[Row] | None:
        """Run to the plan's sink; a list of all rows without one."""
        plan = self.plan(query)
        df = self.lowering().frame(plan)
        match plan:
            case P.Yield():
                return df.toLocalIterator()
            case P.Print():
                for row in df.toLocalIterator():
                    print(*row, sep="\t")
                return None
        return df.collect()

    def lineage(self, query: str | P.Plan, policy: LineagePolicy | None = None) -> Lineage:
        """The result with its row-level lineage under a policy (end to end by default)."""
        return Lineage(self, self.plan(query), policy)
