"""Functions of the dialect: built-ins as native expressions, and user-defined scalar, aggregate and table functions.

A scalar function runs over Arrow batches; an aggregate one gets whole columns (as pandas Series) of its group; an
incremental one is a reducer (init, update, finalize, and merge where its states merge). Scalar and aggregate names must not collide.
"""

from __future__ import annotations

import inspect
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class FunctionError(ValueError):
    """An unknown function, a wrong number of arguments, or a name that is taken."""


@dataclass(frozen=True)
class ScalarFunction:
    name: str
    nargs: int
    build: Callable[..., Column]
    kind: str  # of the result: num, str, bool


@dataclass(frozen=True)
class Reducer:
    """update(state, *values) from init() over rows, merge(state, state) over partial states, then finalize(state)."""

    init: Callable
    update: Callable
    merge: Callable
    finalize: Callable
    returns: str


@dataclass(frozen=True)
class AggregateFunction:
    """native: a Spark aggregate expression; otherwise a grouped-aggregate pandas UDF, which native ones cannot stand beside.

    partial: a reducer whose states merge, so that each batch of rows is reduced before the shuffle (see reduced()).
    doubles: what is built instead of `build` for an argument of type double.
    """

    name: str
    nargs: int
    build: Callable[..., Column]
    native: bool = True
    partial: Reducer | None = None
    doubles: Callable[..., Column] | None = None

    def over(self, df: DataFrame, args: list[Column]) -> Column:
        of_doubles = self.doubles and df.select(*args).dtypes[0][1] == "double"
        return (self.doubles if of_doubles else self.build)(*args)


@dataclass(frozen=True)
class TableFunction:
    """build: (SparkSession, *constants) -> DataFrame."""

    name: str
    nargs: int
    build: Callable[..., Any]


def _of_arity(f: Callable, nargs: int, of: type, result: type) -> Callable:
    """f as a function of nargs named parameters with these types, whatever f's own say."""

    def one(*columns):
        return f(*columns)

    names = [f"x{i}" for i in range(nargs)]
    one.__signature__ = inspect.Signature([inspect.Parameter(n, inspect.Parameter.POSITIONAL_ONLY, annotation=of) for n in names], return_annotation=result)
    one.__annotations__ = dict.fromkeys(names, of) | {"return": result}
    return one


def reduced(df: DataFrame, keys: list[str], aggs: list[tuple[str, AggregateFunction, list[Column]]]) -> DataFrame:
    """(keys, name of each aggregate): reducers with merge, as partial states of every batch and their merge.

    A group's states are as many as the batches that it stands in, each pickled, so a hot group is small where it meets.
    """
    reducers = [f.partial for _, f, _ in aggs]
    n = [len(args) for _, _, args in aggs]
    flat = [c.alias(f"__v{i}") for i, c in enumerate(c for _, _, args in aggs for c in args)]
    of_key = F.struct(*keys) if keys else F.lit(0)
    rows = df.select(F.to_binary(F.to_json(of_key, {"ignoreNullFields": "false"}), F.lit("utf-8")).alias("__key") if keys else F.lit(b"").alias("__key"), *keys, *flat)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            states: dict[bytes, list] = {}
            first: dict[bytes, int] = {}
            columns = [batch[f"__v{i}"].to_pylist() for i in range(sum(n))]
            for at, key in enumerate(batch["__key"].to_pylist()):
                if key not in states:
                    states[key], first[key] = [r.init() for r in reducers], at
                own, begin = states[key], 0
                for i, r in enumerate(reducers):
                    own[i] = r.update(own[i], *(columns[begin + j][at] for j in range(n[i])))
                    begin += n[i]
            taken = batch.select(["__key", *keys]).take(pa.array(list(first.values()), pa.int64()))
            yield taken.append_column("__state", pa.array([pickle.dumps(states[k]) for k in first], pa.binary()))

    schema = T.StructType([rows.schema["__key"], *[rows.schema[k] for k in keys], T.StructField("__state", T.BinaryType())])
    states = rows.mapInArrow(partial, schema)

    def merged(series):
        whole = None
        for data in series:
            own = pickle.loads(data)
            whole = own if whole is None else [r.merge(a, b) for r, a, b in zip(reducers, whole, own, strict=True)]
        return pickle.dumps([r.finalize(s) for r, s in zip(reducers, whole or [r.init() for r in reducers], strict=True)])

    import pandas as pd

    together = F.pandas_udf(_of_arity(merged, 1, pd.Series, bytes), "binary")
    one = states.groupBy(*keys).agg(together("__state").alias("__done"))

    def value(i: int) -> Column:
        return F.udf(lambda data: pickle.loads(data)[i], reducers[i].returns)("__done")

    return one.select(*keys, *[value(i).alias(name) for i, (name, _, _) in enumerate(aggs)])


_LIMB = 28


def _exact_sum(x: Column) -> Column:
    """The sum of doubles without rounding on the way, so that neither the order nor the splits of the rows show in it.

    Each value is cut into whole numbers of 28 bits, from 2 ** 53 down to 2 ** -84, whose sums are exact. Where a value
    of the group is 2 ** 53 or more, below 2 ** -32 (but not zero) or not finite, it is Spark's sum.
    """
    limbs, rest = [], F.when(F.abs(x) < 2.0**53, x) * 2.0**-_LIMB
    for _ in range(5):
        limbs.append(F.sum(rest.cast("long")))
        rest = (rest - rest.cast("long")) * 2.0**_LIMB
    carry, value = F.lit(0), F.lit(0.0)
    for limb in limbs[:0:-1]:  # carried so that equal sums have equal limbs
        total = limb + carry
        carry = F.shiftright(total + (1 << _LIMB - 1), _LIMB)
        value = value * 2.0**-_LIMB + (total - F.shiftleft(carry, _LIMB))
    # value counts in units of the second limb, which holds whole numbers
    exact = (limbs[0] + carry) * 2.0**_LIMB + value
    held = (F.max(F.abs(x)) < 2.0**53) & (F.coalesce(F.min(F.when(x != 0, F.abs(x))), F.lit(1.0)) >= 2.0**-32)
    return F.when(held, exact).otherwise(F.sum(x))


def _spread(x: Column) -> Column:
    return F.stddev_pop(x)


BUILT_IN = (
    ScalarFunction("lower", 1, lambda s: F.lower(s.cast("string")), "str"),
    ScalarFunction("upper", 1, lambda s: F.upper(s.cast("string")), "str"),
    AggregateFunction("count", 1, lambda x: F.count(F.lit(1))),
    AggregateFunction("sum", 1, F.sum, doubles=_exact_sum),
    AggregateFunction("avg", 1, F.avg, doubles=lambda x: _exact_sum(x) / F.count(x)),
    AggregateFunction("std", 1, _spread),
    AggregateFunction("stdev", 1, _spread),
)


class Registry:
    def __init__(self):
        self._known: dict[str, ScalarFunction | AggregateFunction | TableFunction] = {}
        for f in BUILT_IN:
            self.add(f)

    def add(self, function: ScalarFunction | AggregateFunction | TableFunction) -> None:
        old = self._known.get(function.name)
        if old is not None and type(old) is not type(function):
            raise FunctionError(f"{function.name} is already a {type(old).__name__}")
        self._known[function.name] = function

    def __contains__(self, name: str) -> bool:
        return name in self._known

    def get(self, name: str, nargs: int):
        f = self._known.get(name)
        if f is None:
            raise FunctionError(f"no function is named {name}")
        if f.nargs != nargs:
            raise FunctionError(f"{name} takes {f.nargs} arguments, not {nargs}")
        return f

    def is_aggregate(self, name: str) -> bool:
        return isinstance(self._known.get(name), AggregateFunction)

    def scalar(self, name: str, nargs: int, f: Callable, returns: str = "double") -> None:
        """Register f, called for each row."""
        spark_f = F.udf(f, returns, useArrow=True)
        self.add(ScalarFunction(name, nargs, spark_f, "str" if returns == "string" else "bool" if returns == "boolean" else "num"))

    def vectorised(self, name: str, nargs: int, f: Callable, returns: str = "double") -> None:
        """Register f, called with pandas Series of a batch of rows."""
        import pandas as pd

        one = _of_arity(f, nargs, pd.Series, pd.Series)
        self.add(ScalarFunction(name, nargs, F.pandas_udf(one, returns), "str" if returns == "string" else "bool" if returns == "boolean" else "num"))

    def aggregate(self, name: str, nargs: int, f: Callable, returns: str = "double") -> None:
        """Register f, called with the columns of a group as pandas Series."""
        import pandas as pd

        one = _of_arity(f, nargs, pd.Series, float)
        self.add(AggregateFunction(name, nargs, F.pandas_udf(one, returns), native=False))

    def incremental(self, name: str, nargs: int, init: Callable, update: Callable, finalize: Callable, returns: str = "double", merge: Callable | None = None) -> None:
        """Register a reducer: update(state, *values) over a group's rows, from init(), then finalize(state).

        With merge(state, state) every batch is reduced to a state for each of its groups before the shuffle, and the
        states are merged after it; without it all rows of a group meet in one task.
        """
        if merge:
            self.add(AggregateFunction(name, nargs, lambda *_: None, native=False, partial=Reducer(init, update, merge, finalize, returns)))
            return

        def reduce(*columns):
            state = init()
            for values in zip(*columns, strict=True):
                state = update(state, *values)
            return finalize(state)

        self.aggregate(name, nargs, reduce, returns)

    def table(self, name: str, nargs: int, build: Callable) -> None:
        self.add(TableFunction(name, nargs, build))
