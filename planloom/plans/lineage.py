"""Record-level lineage: which rows of one operator's output come from which rows of another's.

A row's id is its place in its operator's output, from 0. Ids travel as ordinary columns through the plan, so filters,
joins and sorts compose them for free. At a grouping no list of ids is gathered; the grouping's tagged input is kept
beside it and joined on the group's keys when edges are asked for, so a group's rows never meet in one task's memory.

Through several groupings these inputs are joined one after the other, and DISTINCT is a grouping by all columns.

Numbering is exact and distributed. A scan of files numbers its rows by file, in order of the paths, and place in the
file, which the reader tells; only the rows of each file are counted, from one column of metadata, and the offsets joined.
Ids so depend on neither file sizes nor splits. Other rows are written to the shared folder in order, each partition is
counted, and a row's id is its place in its partition after the rows of the partitions before.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, fields, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from planloom import operators as P
from planloom import storage
from planloom.dialect.syntax import Expr
from planloom.plans.lowering import Lowering, Relation

FORWARD, BACKWARD = 1, 2
BOTH = FORWARD | BACKWARD


class LineageError(ValueError):
    """Lineage that the policy does not capture."""


@dataclass
class LineagePolicy:
    """The paths (from source up to destination, and directions) whose lineage may be asked for."""

    paths: list[tuple[P.Plan, P.Plan, int]] = field(default_factory=list)

    def add_path(self, source: P.Plan, destination: P.Plan, directions: int = BOTH) -> None:
        if source not in list(destination.walk()):
            raise LineageError("the destination is not above the source")
        self.paths.append((source, destination, directions))

    def allows(self, root: P.Plan, source: P.Plan, destination: P.Plan, direction: int) -> bool:
        return any(s is source and d is destination and x & direction for s, d, x in self.paths)


class NoLineage(LineagePolicy):
    """Nothing is captured."""


class AllLineage(LineagePolicy):
    """Between any operator and any below it."""

    def allows(self, root, source, destination, direction) -> bool:
        return True


class EndToEnd(LineagePolicy):
    """Between the result and the scans."""

    def allows(self, root, source, destination, direction) -> bool:
        return destination is root and isinstance(source, P.Scan)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df, written in its order, with each row's place in it."""
    place, part = "__place", "__part"
    df, _ = storage.materialise(df.withColumn(place, F.monotonically_increasing_id()))
    df = df.withColumn(part, F.shiftright(place, 33))
    out = df.join(_offsets(df, part), part, "left")
    return out.withColumn(name, (F.col(place) - F.shiftleft(F.col(part), 33) + F.col("__start")).cast("long")).drop(place, part, "__start")


def _offsets(df: DataFrame, part: str) -> DataFrame:
    """(part, __start): how many rows the parts before have; a row for each partition or file."""
    before = W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    return df.groupBy(part).agg(F.count(F.lit(1)).alias("n")).select(part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))


def scanned(df: DataFrame, name: str) -> DataFrame | None:
    """df, a bare scan of files, with each row's place in them by path and row; None for anything else."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() == "Project":
        plan = plan.child()
    if plan.nodeName() != "LogicalRelation" and not plan.nodeName().startswith("Relation"):
        return None
    path, row = "__path", "__row"
    try:
        numbers = df.withColumns({path: F.col("_metadata.file_path"), row: F.col("_metadata.row_index")})
        numbers.schema  # noqa: B018  readers without row numbers are refused here
        df = numbers
    except AnalysisException:
        # written once: in a block of a file rows stand in order, and blocks in order of where they begin
        block = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"))
        df, _ = storage.materialise(df.withColumns({path: block, "__place": F.monotonically_increasing_id()}))
        least = df.groupBy(path).agg(F.min("__place").alias("__least"))
        df = df.join(least, path).withColumn(row, F.col("__place") - F.col("__least")).drop("__place", "__least")
    return df.join(_offsets(df, path), path).withColumn(name, (F.col(row) + F.col("__start")).cast("long")).drop(path, row, "__start")


def _named(plan: P.Plan) -> set[str]:
    """The column names that a plan's expressions refer to."""
    values = [getattr(p, f.name) for p in plan.walk() for f in fields(p)]
    exprs = [x for v in values for x in (v if isinstance(v, (list, tuple)) else [v]) if isinstance(x, Expr)]
    return {c.name for e in exprs for c in e.columns()}


def _projected(plan: P.Plan, below: P.Plan) -> bool:
    """Whether a projection or grouping stands between the two."""
    if plan is below:
        return False
    return any(isinstance(plan, (P.Project, P.GroupBy)) or _projected(c, below) for c in plan.children() if below in list(c.walk()))


class Lineage:
    def __init__(self, engine, plan: P.Plan, policy: LineagePolicy | None = None):
        self.engine, self.plan, self.policy = engine, plan, policy or EndToEnd()
        self._edges: dict[tuple[int, int], DataFrame] = {}
        self._result: DataFrame | None = None

    @property
    def scans(self) -> list[P.Scan]:
        return [p for p in self.plan.walk() if isinstance(p, P.Scan)]

    def node(self, ref: P.Plan | str) -> P.Plan:
        """A node, or the scan with an alias."""
        if isinstance(ref, P.Plan):
            return ref
        found = [s for s in self.scans if s.alias == ref]
        if len(found) != 1:
            raise LineageError(f"no single scan is named {ref}")
        return found[0]

    def _tagged(self, top: P.Plan, below: list[P.Plan]) -> tuple[Lowering, Relation, dict[int, str]]:
        names, used = {id(p): f"__rid{i}" for i, p in enumerate(below)}, _named(self.plan)

        def tag(plan: P.Plan, r: Relation) -> Relation:
            name = names.get(id(plan))
            if name is None or plan is top:
                return r
            if isinstance(plan, P.Scan) and _projected(top, plan):  # what no expression names is not written
                kept = tuple(f for f in r.fields if f.name in used)
                r = replace(r, df=r.df.select(*[f.column for f in kept]), fields=kept)
            df = scanned(r.df, name) if isinstance(plan, P.Scan) else None
            return replace(r, df=numbered(r.df, name) if df is None else df, tags=r.tags | {name: name})

        lowering = self.engine.lowering(tag=tag)
        return lowering, lowering.lower(top), names

    def _numbered(self, r: Relation) -> DataFrame:
        """The output rows with their ids: in the plan's order, else by the ids of what they come from."""
        if not r.order and r.tags and not self._sorted(self.plan):
            return numbered(r.df.orderBy(*r.tags.values()), "oid")
        return numbered(r.df, "oid")

    def _sorted(self, plan: P.Plan) -> bool:
        while isinstance(plan, (P.Project, P.Limit, P.Sink, P.Filter)):
            plan = plan.child
            if plan is None:
                return False
        return isinstance(plan, P.OrderBy)

    def result(self) -> DataFrame:
        """The query's rows with their ids (oid)."""
        self._root()
        return self._result

    def _root(self) -> None:
        if self._result is None:
            lowering, r, names = self._tagged(self.plan, list(self.scans))
            df = self._numbered(r)
            self._result = lowering.result(replace(r, df=df), (F.col("oid"),))
            for s in self.scans:
                self._edges[(id(self.plan), id(s))] = self._of(df, r, names[id(s)])

    def _of(self, df: DataFrame, r: Relation, name: str) -> DataFrame:
        """(oid, iid) of one tag."""
        if name in r.tags:
            return df.select("oid", F.col(r.tags[name]).alias("iid"))
        for path in self._paths(r.members, name):
            now = df
            for m in path:
                on = F.lit(True)
                for a, b in m.keys:
                    on = on & F.col(a).eqNullSafe(F.col(b))
                # what the next grouping needs, and each output row once for it
                needed = [k for k, _ in path[path.index(m) + 1].keys] if m is not path[-1] else [m.tags[name]]
                now = now.join(m.df.select(*[b for _, b in m.keys], *needed).distinct() if m is not path[-1] else m.df, on)
                now = now.select("oid", *needed).distinct() if m is not path[-1] else now.select("oid", F.col(needed[0]).alias("iid"))
            return now
        raise LineageError("there is no path between the two")

    def _paths(self, members, name: str) -> list[list]:
        """The groupings from the top down to the one whose input has the tag."""
        out = []
        for m in members:
            out += [[m]] if name in m.tags else [[m, *p] for p in self._paths(m.inner, name)]
        return out

    def edges(self, source: P.Plan | str, top: P.Plan | None = None) -> DataFrame:
        """(oid, iid): rows of top (the result by default) and the rows of source that they come from."""
        top, source = top or self.plan, self.node(source)
        if not any(self.policy.allows(self.plan, source, top, d) for d in (FORWARD, BACKWARD)):
            raise LineageError("the policy captures nothing on this path")
        if source not in list(top.walk()) or source is top:
            raise LineageError("there is no path between the two")
        if top is self.plan and source in self.scans:
            self._root()
        if (id(top), id(source)) not in self._edges:
            _, r, names = self._tagged(top, [source])
            self._edges[(id(top), id(source))] = self._of(self._numbered(r), r, names[id(source)])
        return self._edges[(id(top), id(source))]

    def _ask(self, direction: int, ids: Iterable[int] | int, source, top) -> DataFrame:
        top, source = top or self.plan, self.node(source)
        if not self.policy.allows(self.plan, source, top, direction):
            raise LineageError("the policy does not capture this direction")
        ids = [ids] if isinstance(ids, int) else list(ids)
        return self.edges(source, top).where(F.col("oid" if direction == BACKWARD else "iid").isin(ids)).distinct()

    def back(self, oids: Iterable[int] | int, source: P.Plan | str, top: P.Plan | None = None) -> DataFrame:
        """The rows of source that output rows come from."""
        return self._ask(BACKWARD, oids, source, top)

    def forw(self, iids: Iterable[int] | int, source: P.Plan | str, top: P.Plan | None = None) -> DataFrame:
        """The output rows that rows of source went into."""
        return self._ask(FORWARD, iids, source, top)
