import pytest

from planloom import operators as P
from planloom.plans.lineage import BACKWARD, AllLineage, LineageError, LineagePolicy, NoLineage


def edges(lineage, name):
    return sorted(map(tuple, lineage.edges(name).select("oid", "iid").collect()))


# The four queries of test_sorts, test_filter and test_three_way_join have edges that must hold exactly.


@pytest.mark.parametrize("text", ["SELECT * from data ORDER BY 1", "SELECT a+b FROM data ORDER BY a"])
def test_sorts(engine, text):
    assert edges(engine.lineage(text), "data") == [(i, i) for i in range(20)]


def test_filter(engine):
    assert edges(engine.lineage("SELECT a, b FROM data WHERE (a+b) > 3"), "data") == [(i, i + 2) for i in range(18)]


def test_three_way_join(engine):
    text = "SELECT d1.a FROM data as d1, data as d2, (SELECT * FROM data) as d3 WHERE d1.a = d2.b and d2.b = d3.a and d1.a = d3.c"
    lineage = engine.lineage(text)
    by_alias = {n: dict(edges(lineage, n)) for n in ("data", "d1", "d2")}
    rows = sorted(tuple(by_alias[n][o] for n in ("data", "d2", "d1")) for o in range(8))
    assert rows == sorted((k, k + 5 * i, k) for k in (0, 1) for i in range(4))


def test_grouping(engine):
    lineage = engine.lineage("SELECT c, count(a) AS n FROM data GROUP BY c ORDER BY c")
    assert edges(lineage, "data") == sorted((i % 2, i) for i in range(20))
    assert [tuple(r) for r in lineage.result().orderBy("oid").collect()] == [(0, 10, 0), (1, 10, 1)]


def test_grouping_by_null_and_all(spark, engine):
    engine.catalog.register("gaps", spark.createDataFrame([(1, 1), (None, 2), (None, 3)], "k int, v int").coalesce(1))
    assert edges(engine.lineage("SELECT k, sum(v) FROM gaps GROUP BY k ORDER BY k"), "gaps") == [(0, 1), (0, 2), (1, 0)]
    assert edges(engine.lineage("SELECT sum(v) FROM gaps"), "gaps") == [(0, 0), (0, 1), (0, 2)]


def test_back_and_forw(engine):
    lineage = engine.lineage("SELECT x.a, y.a FROM data AS x, data AS y WHERE x.a = y.b ORDER BY y.a")
    assert [r["iid"] for r in lineage.back(7, "x").collect()] == [2]
    assert sorted(r["oid"] for r in lineage.forw([2], "x").collect()) == [2, 7, 12, 17]


def test_descending(engine):
    assert edges(engine.lineage("SELECT e FROM data ORDER BY a desc LIMIT 3"), "data") == [(0, 19), (1, 18), (2, 17)]


def test_groupings_of_groupings(engine):
    text = "SELECT q.n, count(q.b) AS m FROM (SELECT b, count(a) AS n FROM data WHERE a < 18 GROUP BY b) AS q GROUP BY q.n ORDER BY q.n"
    lineage = engine.lineage(text)
    assert [tuple(r) for r in lineage.result().orderBy("oid").collect()] == [(3, 2, 0), (4, 3, 1)]
    assert edges(lineage, "data") == sorted((0 if a % 5 > 2 else 1, a) for a in range(18))
    three = engine.lineage(f"SELECT count(r.n) AS z FROM ({text}) AS r")
    assert edges(three, "data") == [(0, a) for a in range(18)]


def test_distinct(engine):
    assert edges(engine.lineage("SELECT DISTINCT c FROM data ORDER BY c"), "data") == sorted((a % 2, a) for a in range(20))
    text = "SELECT q.b FROM (SELECT DISTINCT b, c FROM data) AS q WHERE q.c = 1 ORDER BY q.b desc"
    assert edges(engine.lineage(text), "data") == sorted((4 - a % 5, a) for a in range(20) if a % 2)


@pytest.mark.parametrize("kind", ["parquet", "csv"])
def test_rows_are_numbered_by_file(spark, tmp_path, kind):
    """Of the files in order of their names, however large each is."""
    import pandas as pd

    from planloom.engine import Engine

    first, second = (pd.DataFrame({"k": range(a, b)}) for a, b in ((0, 10), (10, 30_000)))
    for name, part in (("a", first), ("b", second)):
        part.to_parquet(tmp_path / name) if kind == "parquet" else part.to_csv(tmp_path / name, index=False)
    e = Engine(spark, views=False)
    e.catalog.register_parquet(str(tmp_path), "t") if kind == "parquet" else e.catalog.register_csv(str(tmp_path), "t")
    lineage = e.lineage("SELECT k FROM t WHERE k > 4 and k < 14 ORDER BY k desc")
    assert edges(lineage, "t") == [(i, 13 - i) for i in range(9)]


def test_policies(engine):
    scan = P.Scan("data")
    kept = P.Filter(scan, "a > 14")
    plan = P.Project(P.OrderBy(kept, ["a"], [False]), ["a"])
    with pytest.raises(LineageError):
        engine.lineage(plan, NoLineage()).edges(scan)
    with pytest.raises(LineageError):
        engine.lineage(plan).edges(kept)
    assert edges(engine.lineage(plan, AllLineage()), kept) == [(i, 4 - i) for i in range(5)]
    policy = LineagePolicy()
    policy.add_path(scan, plan, BACKWARD)
    lineage = engine.lineage(plan, policy)
    assert lineage.back(0, scan).collect()[0]["iid"] == 19
    with pytest.raises(LineageError):
        lineage.forw(0, scan)
    with pytest.raises(LineageError):
        policy.add_path(plan, scan)


def test_only_named_columns_are_written(engine):
    lineage = engine.lineage("SELECT 1 FROM data AS x, data AS y WHERE x.a = y.b")
    scan = lineage.scans[0]
    _, r, _ = lineage._tagged(lineage.plan, lineage.scans)
    assert sorted(map(tuple, lineage.edges(scan).select("iid").distinct().collect())) == [(i,) for i in range(5)]
    plan = lineage.result()._jdf.queryExecution().optimizedPlan().toString()
    assert "_f_" not in plan and "_e_" not in plan
