"""Operators by name; the window generator and the users' aggregates as table functions for SQL."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from .operators import annotations, cohort, motion, order_statistics, pose, segments, sequences, tracking, user_aggregates

_MODULES = (annotations, cohort, motion, order_statistics, pose, segments, sequences, tracking, user_aggregates)


def operators() -> dict[str, Callable[..., DataFrame]]:
    """Every operator over a DataFrame: its name and function."""
    found = {}
    for module in _MODULES:
        for name, f in inspect.getmembers(module, inspect.isfunction):
            first = next(iter(inspect.signature(f).parameters.values()), None)
            if f.__module__ == module.__name__ and not name.startswith("_") and first is not None and first.annotation == "DataFrame":
                found[name] = f
    return found


def op(name: str) -> Callable[..., DataFrame]:
    """The operator of a name, as in ``op("merge_runts")(scenes, keys=["video"], min_len=1.0)``."""
    known = operators()
    if name not in known:
        raise KeyError(f"no operator {name}; there are {', '.join(sorted(known))}")
    return known[name]


@udtf(returnType="segment_index int, start_sec double, end_sec double")
class FixedWindows:
    """Windows of one duration for SQL: LATERAL fixed_windows(duration, window, min_tail).

    DataFrames have ``segments.fixed_windows``, which needs no Python.
    """

    def eval(self, duration: float, window: float, min_tail: float) -> Iterator[tuple[int, float, float]]:
        if duration is None or duration <= 0:
            return
        whole = int(duration // window)
        rest = duration - whole * window
        n = whole + (rest > 0 and (rest >= min_tail or whole == 0))
        for k in range(n):
            yield k, k * window, duration if k == n - 1 else (k + 1) * window


def register(spark: SparkSession) -> None:
    """Make the table functions known to SQL."""
    spark.udtf.register("fixed_windows", FixedWindows)
    user_aggregates.register_aggregates(spark)
