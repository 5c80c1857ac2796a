"""Aggregates of a user's own, by name, whose states merge: for DataFrames and as table functions for SQL.

An aggregate turns rows into a state of numbers, merges two states and turns a state into its result.
Each task adds up its own rows before anything is shuffled, so a key that holds a third of all rows
sends one small state a task; a walk over sorted states then merges them, two at a time.

Rows with a null among the values count for nothing; a key without other rows has a null result.
Null keys are a group.  States merge in no fixed order, so results agree to rounding.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, PartitioningColumn

from .ordered import batched

State = list[float]


@dataclass(frozen=True)
class Aggregate:
    """``add`` makes a state of the rows of ``inputs`` numpy columns, at least one row."""

    inputs: int
    add: Callable[..., State]
    merge: Callable[[State, State], State]
    finish: Callable[[State], float | None]


def _moments(x: np.ndarray) -> State:
    mean = x.mean()
    return [len(x), mean, ((x - mean) ** 2).sum()]


def _both_moments(a: State, b: State) -> State:
    n, gap = a[0] + b[0], b[1] - a[1]
    return [n, a[1] + gap * b[0] / n, a[2] + b[2] + gap * gap * a[0] * b[0] / n]


def _sums(a: State, b: State) -> State:
    return [x + y for x, y in zip(a, b, strict=True)]


_KNOWN = {
    "population_sd": Aggregate(1, _moments, _both_moments, lambda s: math.sqrt(s[2] / s[0])),
    "weighted_mean": Aggregate(2, lambda x, w: [(x * w).sum(), w.sum()], _sums, lambda s: s[0] / s[1] if s[1] else None),
}


def define_aggregate(name: str, aggregate: Aggregate) -> None:
    """Make an aggregate known by name; call ``register_aggregates`` after it for SQL."""
    if not name.isidentifier() or name in _KNOWN:
        raise ValueError(f"{name} is no name, or is an aggregate already")
    _KNOWN[name] = aggregate


def aggregate_of(name: str) -> Aggregate:
    if name not in _KNOWN:
        raise KeyError(f"no aggregate {name}; there are {', '.join(sorted(_KNOWN))}")
    return _KNOWN[name]


def _same(key: tuple) -> tuple:
    """A key that equals itself where it holds a NaN."""
    return tuple("NaN" if isinstance(x, float) and x != x else x for x in key)


class _Held:
    """States of the keys met so far, and rows that wait to be added to them."""

    def __init__(self, aggregate: Aggregate):
        self.aggregate, self.states = aggregate, {}

    def put(self, key: tuple, state: State | None) -> None:
        own = self.states.get(_same(key), (key, None))[1]
        self.states[_same(key)] = key, state if own is None else own if state is None else self.aggregate.merge(own, state)

    def add(self, key: tuple, columns: list[np.ndarray]) -> None:
        self.put(key, [float(x) for x in self.aggregate.add(*columns)] if len(columns[0]) else None)

    def drain(self) -> Iterator[tuple]:
        states, self.states = self.states, {}
        for key, state in states.values():
            yield *key, state


def user_aggregate(df: DataFrame, keys: list[str], name: str, columns: list[str], out: str, most: int = 50_000) -> DataFrame:
    """keys and ``out``: the named aggregate of the columns of each key.  A task holds ``most`` keys' states at once."""
    own = aggregate_of(name)
    if not keys or len(columns) != own.inputs:
        raise ValueError(f"{name} takes one key or more and {own.inputs} columns")
    held_keys = df.select(*keys).schema.fields
    n = len(keys)
    states = StructType([*(StructField(f"k{i}", f.dataType) for i, f in enumerate(held_keys)), StructField("state", ArrayType(DoubleType()))])
    result = StructType([*states.fields[:-1], StructField("value", DoubleType())])
    states_arrow, result_arrow = to_arrow_schema(states), to_arrow_schema(result)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(own)
        for batch in batches:
            names = batch.schema.names
            rows = pa.Table.from_batches([batch]).append_column("row", pa.array(np.arange(batch.num_rows)))
            whole = np.logical_and.reduce([batch.column(n + i).is_valid().to_numpy(zero_copy_only=False) for i in range(own.inputs)])
            values = [batch.column(n + i).to_numpy(zero_copy_only=False) for i in range(own.inputs)]
            groups = rows.group_by(names[:n]).aggregate([("row", "list")]).select([*names[:n], "row_list"])
            for *key, places in zip(*(c.to_pylist() for c in groups.columns[:n]), groups.column(n), strict=True):
                at = places.values.to_numpy()
                at = at[whole[at]]
                held.add(tuple(key), [v[at] for v in values])
            if len(held.states) >= most:
                yield from batched(held.drain(), states_arrow)
        yield from batched(held.drain(), states_arrow)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def results() -> Iterator[tuple]:
            held = _Held(own)
            for batch in batches:
                for *key, state in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if held.states and _same(tuple(key)) not in held.states:
                        yield from map(finished, held.drain())
                    held.put(tuple(key), state)
            yield from map(finished, held.drain())

        def finished(row: tuple) -> tuple:
            return *row[:-1], None if row[-1] is None else own.finish(row[-1])

        yield from batched(results(), result_arrow)

    rows = df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)])
    names = [f"k{i}" for i in range(n)]
    sorted_states = rows.mapInArrow(partial, states).repartition(*names).sortWithinPartitions(*names)
    return sorted_states.mapInArrow(merged, result).toDF(*[f.name for f in held_keys], out)


def _table_functions(own: Aggregate) -> tuple[type, type]:
    """The class that makes states of a task's rows (keys, then values), and the one that merges them."""

    class States:
        def __init__(self) -> None:
            self.held, self.waiting = _Held(own), {}

        @staticmethod
        def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
            fields = rows.dataType.fields[: -own.inputs]
            return AnalyzeResult(schema=StructType([*fields, StructField("state", ArrayType(DoubleType()))]))

        def eval(self, row):  # noqa: ANN001, ANN202 - a row of any table
            key, values = tuple(row[: -own.inputs]), row[-own.inputs :]
            keep = self.waiting.setdefault(_same(key), (key, []))[1]
            if None not in values:
                keep.append([float(x) for x in values])
            if len(keep) >= 1024 or len(self.waiting) >= 4096:
                self._settle()
                if len(self.held.states) >= 50_000:
                    yield from self.held.drain()

        def _settle(self) -> None:
            for key, rows in self.waiting.values():
                self.held.add(key, list(np.array(rows, np.float64).reshape(-1, own.inputs).T))
            self.waiting = {}

        def terminate(self) -> Iterator[tuple]:
            self._settle()
            yield from self.held.drain()

    class Merged:
        def __init__(self) -> None:
            self.held = _Held(own)

        @staticmethod
        def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
            fields = rows.dataType.fields[:-1]
            # A NaN does not equal itself where a group's end is looked for.
            parts = [[f"`{f.name}`"] if not isinstance(f.dataType, DoubleType | FloatType) else [f"nanvl(`{f.name}`, 0)", f"isnan(`{f.name}`)"] for f in fields]
            return AnalyzeResult(schema=StructType([*fields, StructField("value", DoubleType())]), partitionBy=[PartitioningColumn(p) for own in parts for p in own])

        def eval(self, row) -> None:  # noqa: ANN001
            self.held.put(tuple(row[:-1]), row[-1])

        def terminate(self) -> Iterator[tuple]:
            for *key, state in self.held.drain():
                yield *key, None if state is None else own.finish(state)

    return States, Merged


def register_aggregates(spark: SparkSession) -> None:
    """Make all aggregates known to SQL, each as two table functions.

    ``SELECT * FROM n_merged(TABLE(SELECT * FROM n_states(TABLE(SELECT key, x FROM t))))`` gives key and value.
    """
    for name, own in _KNOWN.items():
        states, merged = _table_functions(own)
        spark.udtf.register(f"{name}_states", udtf(states))
        spark.udtf.register(f"{name}_merged", udtf(merged))
