"""Tables of latest records kept by streams: a batch adds a run of files, runs of a size are merged now and then.

A batch writes its own latest records and nothing else.  When ``fanout`` runs of one level are there, they become
one run of the next, so a record is rewritten once for each level and a reader meets few runs.  A
manifest names the runs of each batch; it is written last, so a batch that failed leaves nothing that is read,
and one that comes again changes nothing.  Runs that neither of the last two manifests names are removed: a reader
that began before a batch can finish, and old versions do not pile up.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..work import Folder

_BATCH = "__loom_batch"


def _manifests(folder: Folder) -> list[str]:
    return [n for n in folder.names("_manifests") if n.endswith(".json")]


def _state(folder: Folder) -> dict:
    """The newest manifest: its batch, the columns, and the runs (name, level)."""
    known = _manifests(folder)
    return json.loads(folder.read(f"_manifests/{known[-1]}")) if known else {"batch": -1, "columns": "", "runs": []}


def _latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last record of each key; of equal ones that of the later batch."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order, _BATCH)).alias("best")
    return rows.groupBy(*keys).agg(best).select(*[F.col(c) if c in keys else F.col(f"best.`{c}`").alias(c) for c in rows.columns])


def _runs(spark: SparkSession, path: str, state: dict, names: list[str]) -> DataFrame:
    return spark.read.schema(state["columns"]).parquet(*[f"{path}/{n}" for n in names])


def upsert_latest(path: str, keys: list[str], order: list[str], fanout: int = 4) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps the last record of each key, by the ``order`` columns, in a table of runs."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        folder = Folder(spark, path)
        state = _state(folder)
        if number <= state["batch"]:
            return
        rows = batch.withColumn(_BATCH, F.lit(number).cast("long"))
        state = {"batch": number, "columns": ", ".join(f"`{c}` {kind}" for c, kind in rows.dtypes), "runs": state["runs"], "keys": keys, "order": order}
        own, level = [f"run-{number}-0", 0], 0
        _latest(rows, keys, order).write.mode("overwrite").parquet(f"{path}/{own[0]}")
        state["runs"] = [*state["runs"], own]
        while len(same := [name for name, at in state["runs"] if at == level]) >= fanout:
            merged = [f"run-{number}-{level + 1}", level + 1]
            _latest(_runs(spark, path, state, same), keys, order).write.mode("overwrite").parquet(f"{path}/{merged[0]}")
            state["runs"] = [r for r in state["runs"] if r[1] != level] + [merged]
            level += 1
        folder.write(f"_manifests/{number:020d}.json", json.dumps(state))
        _tidy(folder)

    return write


def _tidy(folder: Folder) -> None:
    """Removes the runs and manifests that only older batches name."""
    known = _manifests(folder)
    for old in known[:-2]:
        folder.remove(f"_manifests/{old}")
    named = {name for m in known[-2:] for name, _ in json.loads(folder.read(f"_manifests/{m}"))["runs"]}
    for name in folder.names():
        if name.startswith("run-") and name not in named:
            folder.remove(name)


def last_batch(spark: SparkSession, path: str) -> int:
    """The number of the last batch that the table holds; -1 if there is no table."""
    return _state(Folder(spark, path))["batch"]


def latest_of(spark: SparkSession, path: str) -> DataFrame:
    """The current records of a table that ``upsert_latest`` keeps."""
    state = _state(Folder(spark, path))
    if state["batch"] < 0:
        raise ValueError(f"no table at {path}")
    rows = _runs(spark, path, state, [name for name, _ in state["runs"]])
    return _latest(rows, state["keys"], state["order"]).drop(_BATCH)


def first_seen(path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that stores each key, nulls included, in the batch in which it first comes.

    ``path``/new has the keys of each batch, ``path``/seen is the table of all.  A batch that comes again
    changes nothing.
    """
    remember = upsert_latest(f"{path}/seen", keys, keys)

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = last_batch(spark, f"{path}/seen")
        if number <= known:
            return
        fresh = batch.select(*keys).distinct()
        if known >= 0:
            seen = latest_of(spark, f"{path}/seen")
            same = fresh[keys[0]].eqNullSafe(seen[keys[0]])
            for k in keys[1:]:
                same = same & fresh[k].eqNullSafe(seen[k])
            fresh = fresh.join(seen, same, "left_anti")
        kind = fresh.schema
        fresh.write.mode("overwrite").parquet(f"{path}/new/batch={number}")
        remember(spark.read.schema(kind).parquet(f"{path}/new/batch={number}"), number)

    return write
