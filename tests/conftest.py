import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

#: The string columns of the 20-row table, in row order.
E = "a b c d abc cde a b c d abc cde a b c d abc cde a b".split()
G = "c d e cde a b c abc c d e cde a b c abc c d e cde".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{shared}")
        .config("spark.sql.warehouse.dir", str(shared / "warehouse"))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


def data_rows():
    return [(a, a % 5, a % 2, 0, E[a], 2 * a + 2, G[a]) for a in range(20)]


@pytest.fixture(scope="session")
def engine(spark):
    from planloom.engine import Engine

    e = Engine(spark)
    e.catalog.register("data", spark.createDataFrame(data_rows(), "a long, b long, c long, d long, e string, f long, g string").coalesce(1))
    return e
