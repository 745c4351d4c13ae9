import numpy as np
import pytest
from pyspark.sql import functions as F

from planloom.llm import ann, hilbert

TYPES = "vec_id long, embedding array<float>, score string"


def table(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "clash") for i, v in zip(ids, vectors, strict=True)], TYPES)


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["vec_id"])
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_hilbert_keys():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.array(np.meshgrid(*[np.arange(1 << bits)] * dims)).reshape(dims, -1).T
        k = hilbert.keys(grid, bits)
        assert sorted(k.tolist()) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(k)], axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("clustered", [False, True])
def test_recall(spark, clustered):
    r = np.random.default_rng(2)
    x = r.normal(size=(2000, 32)).astype(np.float32)
    if clustered:
        x = (r.normal(size=(40, 32))[r.integers(0, 40, 2000)] * 3 + x).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = found(ann.nearest(table(spark, x), F.col("vec_id") % 50 == 0))
    ids = np.arange(len(x))
    exact = ann.exact(x, ids, x[::50], ids[::50])
    recall = np.mean([len(set(got[int(q)]) & set(e)) / 10 for q, e in zip(ids[::50], exact, strict=True)])
    assert recall >= 0.9


def test_exact_scores_order_and_ties(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(120, 8)).astype(np.float32)
    x[20:100] = x[20]  # equal vectors: ties go to smaller ids
    df = ann.nearest(table(spark, x), F.col("vec_id").isin(5, 50), window=1000)
    got = found(df)
    ids = np.arange(len(x))
    assert [got[5], got[50]] == ann.exact(x, ids, x[[5, 50]], ids[[5, 50]])
    assert got[50] == list(range(20, 30))
    for row in df.collect():
        assert row["score"] == np.sqrt(((x[row["query_id"]].astype(float) - x[row["vec_id"]].astype(float)) ** 2).sum())


def test_awkward(spark):
    v = [[1, 0], [0, 0], None, [1, None], [float("nan"), 1], [float("inf"), 1], [1, 2, 3], [2, 0], [2, 0], [0, 1], []]
    got = found(ann.nearest(table(spark, v), F.lit(True)))
    assert got == {0: [7, 8, 9], 7: [8, 0, 9], 8: [7, 0, 9], 9: [0, 7, 8]}
    ids = [0, 1, 1, None, 2]  # repeated and null ids
    got = found(ann.nearest(table(spark, [[1, 0], [2, 0], [1, 1], [1, 0], [5, 5]], ids), F.col("vec_id") == 0))
    assert got == {0: [1, 2]}
    assert ann.nearest(table(spark, []), F.lit(True)).collect() == []
    assert ann.nearest(table(spark, [[1, 2]]), F.lit(True)).collect() == []
