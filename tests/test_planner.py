import pytest

from planloom import operators as P
from planloom.engine import Engine


@pytest.fixture(scope="module")
def tables(spark):
    def make(kind):
        e = Engine(spark, join_order=kind, views=False)
        for t in range(5):
            e.catalog.register(f"t{t}", spark.range(20 * (t + 1)).selectExpr("id AS a", f"id % {t + 2} AS b"))
        return e

    return make


def chain(n):
    preds = [f"T{i}.a = T{i - 1}.a" for i in range(1, n)]
    return P.Filter(P.From([P.Scan("t0", f"T{i}") for i in range(n)], preds), "T0.a = 1")


@pytest.mark.parametrize("kind,counts", [("selinger", [1, 10, 35, 100, 260, 640, 1520]), ("exhaustive", [0, 8, 32, 126, 574, 3122])])
def test_plans_tested(tables, kind, counts):
    e, tested = tables(kind), []
    for n in range(1, len(counts) + 1):
        e.plan(chain(n))
        tested.append(e.plans_tested)
    assert tested == counts


STAR = "SELECT t0.b FROM t0, t1, t2, t3, t4 WHERE t0.a = t1.a AND t1.a = t2.a AND t2.a = t4.a AND t2.b = t3.b"


@pytest.mark.parametrize("kind,most", [("selinger", 258), ("exhaustive", 571)])
def test_star(tables, kind, most):
    e = tables(kind)
    e.plan(STAR)
    assert abs(e.plans_tested - most) <= 0.2 * most


@pytest.mark.parametrize("kind,tested", [("selinger", 9), ("exhaustive", 205)])
def test_cross_products(tables, kind, tested):
    e = tables(kind)
    e.plan("SELECT t0.a FROM t0, t1, t2, t3, t4")
    assert e.plans_tested == tested


@pytest.mark.parametrize("text", [STAR, "SELECT t0.a, t1.b FROM t0, t1, t2 WHERE t0.a = t1.b and t2.b = t1.b and t0.b = t2.a", "SELECT t0.a, t4.a FROM t0, t4, t1 WHERE t0.a = t1.a"])
def test_order_never_changes_the_result(tables, text):
    results = [sorted(map(tuple, tables(k).df(text).collect())) for k in (None, "selinger", "exhaustive")]
    assert results[0] == results[1] == results[2]


def test_hash_joins_are_picked(tables):
    plan = tables("selinger").plan("SELECT t0.a FROM t0, t1, t2 WHERE t0.a = t1.a and t1.a = t2.a")
    assert sum(isinstance(p, P.HashJoin) for p in plan.walk()) == 2
