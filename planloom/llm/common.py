"""What the corpus operators share: the word pattern, native word counts, and the tables written to cut lineage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planloom.storage import discard, materialise, scratch

__all__ = ["SPACES", "WORD", "bind", "discard", "materialise", "release", "scratch", "table", "word_count", "words"]

#: Words are maximal runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, also where body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text, [] for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def release() -> None:
    """Hand freed memory back to the system: the driver has little, and Python workers go on to other tasks."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library offers it
        ctypes.CDLL(None).malloc_trim(0)
