import duckdb
from corpus import awkward, documents, prose
from pyspark.sql import functions as F

from planloom.llm import mixing as M


def many(n=300):
    return [(i, prose(i, 5 + i % 97), "en", f"s{min(i % 11, 4)}", 1) for i in range(n)]


def test_targets_and_caps(spark):
    rows = M.mix(documents(spark, many())).collect()
    total, by = sum(r["size"] for r in rows), {}
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by.setdefault(r["source"], []).append(r)
    assert abs(sum(v[0]["target"] for v in by.values()) - total) < 1e-6 * total
    for v in by.values():
        assert v[0]["target"] <= 3 * v[0]["source_size"] + 1e-9
        assert v[0]["source_size"] == sum(r["size"] for r in v)
        assert abs(sum(r["taken"] for r in v) - v[0]["target"]) < 0.05 * v[0]["target"]


def test_water_level_by_hand(spark):
    """s0 can take 30 of its share; what it leaves goes to the others 2 : 3."""
    rows = [(1, "w " * 10, "en", "s0", 1), (2, "w " * 300, "en", "s1", 1), (3, "w " * 290, "en", "s2", 1)]
    got = {r["source"]: r["target"] for r in M.mix(documents(spark, rows)).collect()}
    assert got == {"s0": 30.0, "s1": 570 * 2 / 5, "s2": 570 * 3 / 5}


def test_sainte_lague_against_brute_force(spark):
    import random

    r = random.Random(4)
    for seats in (0, 1, 7, 1000, 12345):
        claims = [r.random() ** 3 * 100 for _ in range(40)] + [0.0]
        won = [0] * len(claims)
        for _ in range(seats):
            best = max(range(len(claims)), key=lambda i: (claims[i] / (2 * won[i] + 1), -i))
            won[best] += 1
        df = spark.createDataFrame([(1, i, c) for i, c in enumerate(claims)], "g int, k int, claim double")
        got = M.sainte_lague(df, ["g"], "k", F.col("claim"), F.lit(seats)).orderBy("k").collect()
        assert [x["quota"] for x in got] == won


def test_awkward(spark):
    rows = M.mix(documents(spark)).collect()
    assert len(rows) == len(awkward())
    assert all(r["taken"] == 0 for r in rows if r["size"] == 0)
    assert any(r["source"] is None for r in rows)
    assert M.mix(documents(spark, [])).collect() == []
    empty = M.mix(documents(spark, [(1, None, "en", "a", 0), (2, "", "en", None, 0)])).collect()
    assert [(r["target"], r["taken"]) for r in empty] == [(0.0, 0), (0.0, 0)]


def test_reruns_agree_and_clashing_columns(spark):
    docs = documents(spark, many()).withColumns({"size": F.lit("x"), "k": F.lit(1), "shard": F.lit(2), "order": F.lit(3)})
    a, b = (sorted(map(tuple, M.mix(d).select("doc_id", "size", "taken", "k", "shard").collect())) for d in (docs, docs.repartition(7)))
    assert a == b and {(x[3], x[4]) for x in a} == {(1, 2)}


def test_native(spark):
    plan = M.mix(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_matches_sql(spark, tmp_path):
    documents(spark, many() + awkward()).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted((tuple(r) for r in M.query(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted(con.execute(M.SQL).fetchall(), key=repr)
