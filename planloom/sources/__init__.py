"""The catalog: named tables over CSV, Parquet, pandas and DataFrames, with statistics on demand."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEPARATORS = (",", "|", "\t")
#: Relative standard deviation of the estimated numbers of distinct values.
DEVIATION = 0.01


class UnknownTable(KeyError):
    pass


def kind_of(t: T.DataType) -> str:
    """num, str, bool or date; anything else is opaque."""
    if isinstance(t, T.NumericType):
        return "num"
    if isinstance(t, T.StringType):
        return "str"
    return "bool" if isinstance(t, T.BooleanType) else "date" if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)) else "any"


@dataclass
class Stats:
    """A table's cardinality, and a column's minimum, maximum and (estimated) number of distinct values.

    One scan computes the cardinality and the columns asked for together, each once.
    """

    df: DataFrame
    _card: int | None = None
    _columns: dict[str, dict] = field(default_factory=dict)

    def gather(self, names: list[str]) -> None:
        """The cardinality and these columns' statistics, those not known yet, in one scan."""
        new = [n for n in dict.fromkeys(names) if n not in self._columns]
        if not new and self._card is not None:
            return
        of = lambda n: F.struct(F.min(f"`{n}`").alias("min"), F.max(f"`{n}`").alias("max"), F.approx_count_distinct(f"`{n}`", DEVIATION).alias("ndistinct"))
        row = self.df.agg(F.count(F.lit(1)).alias("n"), *[of(n).alias(f"c{i}") for i, n in enumerate(new)]).first()
        self._card = row["n"]
        for i, n in enumerate(new):
            self._columns[n] = row[f"c{i}"].asDict()

    @property
    def card(self) -> int:
        self.gather([])
        return self._card

    def column(self, name: str) -> dict:
        self.gather([name])
        return self._columns[name]


class Catalog:
    """views: whether each table is a temporary view of the session too."""

    def __init__(self, spark: SparkSession, views: bool = True):
        self.spark, self.views = spark, views
        self._tables: dict[str, DataFrame] = {}
        self._stats: dict[str, Stats] = {}

    # registration

    def register(self, name: str, df: DataFrame) -> None:
        self._tables[name] = df
        self._stats[name] = Stats(df)
        if self.views and re.fullmatch(r"\w+", name):
            df.createOrReplaceTempView(name)

    def register_pandas(self, name: str, frame) -> None:
        self.register(name, self.spark.createDataFrame(frame))

    def register_rows(self, name: str, rows: list[dict]) -> None:
        """From dictionaries that share their keys."""
        self.register(name, self.spark.createDataFrame([tuple(r.values()) for r in rows], list(rows[0])))

    def register_csv(self, path: str, name: str | None = None, schema: str | None = None) -> str:
        """A CSV file or folder with a header, separated by a comma, a bar or a tab, whichever its header has.

        A column without a name is a row number and is dropped. Types are inferred from all rows unless given; empty
        cells are null.
        """
        first = self.spark.read.text(path).limit(1).collect()
        header = first[0][0] if first else ""
        sep = max(SEPARATORS, key=header.count)
        reader = self.spark.read.option("header", True).option("sep", sep)
        df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
        df = df.drop(*[c for c, h in zip(df.columns, header.split(sep), strict=False) if not h.strip()])
        name = name or re.sub(r"\.\w+$", "", path.rstrip("/").rsplit("/", 1)[-1])
        self.register(name, df)
        return name

    def crawl_csv(self, root: str) -> list[str]:
        """Register every *.csv under root, by its stem; of equal stems the last path in order holds.

        The files are listed by Hadoop's file system, so root may be in any store that Spark reads.
        """
        path = self.spark._jvm.org.apache.hadoop.fs.Path(root)
        files, found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listFiles(path, True), []
        while files.hasNext():
            f = files.next().getPath().toString()
            if f.endswith(".csv"):
                found.append(f)
        return [self.register_csv(f) for f in sorted(found)]

    def register_parquet(self, path: str, name: str | None = None) -> str:
        name = name or re.sub(r"\.parquet$", "", path.rstrip("/").rsplit("/", 1)[-1])
        self.register(name, self.spark.read.parquet(path))
        return name

    # lookup

    def __contains__(self, name: str) -> bool:
        return name in self._tables

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._tables:
            raise UnknownTable(name)
        return self._tables[name]

    @property
    def names(self) -> list[str]:
        return list(self._tables)

    def schema(self, name: str) -> list[tuple[str, str]]:
        return [(f.name, kind_of(f.dataType)) for f in self[name].schema]

    def stats(self, name: str) -> Stats:
        self[name]
        return self._stats[name]
