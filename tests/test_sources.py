import pandas as pd
import pytest

from planloom.engine import Engine
from planloom.shell import Shell
from planloom.sources import UnknownTable


def test_csv(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "one.csv").write_text("a,b\n1,x\n2,y\n")
    (tmp_path / "deep" / "two.csv").write_text("|a|b\n0|1.5|p\n1|2.5|\n")
    (tmp_path / "deep" / "three.csv").write_text("a\tb\n1\t2\n")
    e = Engine(spark)
    assert sorted(e.catalog.crawl_csv(str(tmp_path))) == ["one", "three", "two"]
    assert e.catalog.schema("one") == [("a", "num"), ("b", "str")]
    assert e.catalog.schema("two") == [("a", "num"), ("b", "str")]
    assert [tuple(r) for r in e.df("SELECT sum(a) FROM two").collect()] == [(4.0,)]
    assert e.catalog.schema("three") == [("a", "num"), ("b", "num")]
    assert spark.table("one").count() == 2


def test_registration(spark):
    e = Engine(spark, views=False)
    e.catalog.register_pandas("p", pd.DataFrame({"x": [1, 2], "y": ["a", "b"]}))
    e.catalog.register_rows("r", [{"x": 1, "y": "a"}])
    assert "p" in e.catalog and e.catalog.names == ["p", "r"]
    assert len(e.df("SELECT p.x FROM p, r WHERE p.y = r.y").collect()) == 1
    with pytest.raises(UnknownTable):
        e.catalog["none"]
    s = e.catalog.stats("p")
    assert (s.card, s.column("x")) == (2, {"min": 1, "max": 2, "ndistinct": 2})


def test_empty_table(spark):
    e = Engine(spark, join_order="selinger", views=False)
    e.catalog.register("none", spark.createDataFrame([], "a int, b string"))
    assert e.df("SELECT x.a FROM none AS x, none AS y WHERE x.a = y.a ORDER BY x.a").collect() == []


def test_shell(engine):
    shell = Shell(engine)
    assert "data" in shell.answer("SHOW TABLES").split()
    assert shell.answer("SHOW data").splitlines()[1] == "a\tnum"
    assert shell.answer("SHOW none") == "none not in database"
    assert shell.answer("SELECT a FROM data WHERE a = 3").startswith("3\n1 rows")
    assert shell.answer("PARSE a + 1 * 2") == "(a + (1 * 2))"
    assert "Select" in shell.answer("PARSE SELECT 1")
    assert shell.answer("SELECT nope FROM data").startswith("ERROR")
    assert "BindError" in shell.answer("TRACE")
    assert "generated" in shell.answer("COMPILE SELECT a FROM data WHERE b = 1").lower()
    assert "0 <- 1" in shell.answer("LINEAGE SELECT a FROM data WHERE a = 1")
    assert "Scan" in shell.answer("EXPLAIN SELECT a FROM data")
    assert shell.answer("q") is None and "SHOW TABLES" in shell.answer("help")


def test_written_code(engine, tmp_path):
    engine.write_code("SELECT sum(a) FROM data GROUP BY b", str(tmp_path / "code.java"))
    assert "GroupBy" in (text := (tmp_path / "code.java").read_text()) and "class" in text


def test_shipping(spark):
    from planloom import shipping

    shipping.ship(spark)  # the workers start where the package is
    assert spark.sparkContext.applicationId not in shipping._shipped
    shipping.ship(spark, force=True)
    assert spark.sparkContext.applicationId in shipping._shipped
