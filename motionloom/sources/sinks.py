"""Sinks: feature tables, appended records, flat and wide CSV, manifests.  Spark's commit makes them atomic."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..work import Folder


class RowsLost(RuntimeError):
    """A sink holds another number of rows than were written to it."""


def counted(df: DataFrame, write: Callable[[DataFrame], None], read: Callable[[], DataFrame], where: str) -> int:
    """Write rows, counting them on their way (no further pass), and compare with what is read back; their number."""
    sent = Observation()
    write(df.observe(sent, F.count(F.lit(1)).alias("n")))
    n, there = sent.get["n"], read().count()
    if n != there:
        raise RowsLost(f"{where}: {n} rows were written, {there} are there")
    return n


def _to_csv(df: DataFrame, path: str) -> int:
    back = lambda: df.sparkSession.read.csv(path, header=True, multiLine=True, escape='"', schema=", ".join(f"`{c}` string" for c in df.columns))
    return counted(df, lambda rows: rows.write.mode("overwrite").csv(path, header=True, escape='"'), back, path)


def sink_features(df: DataFrame, path: str, key: str = "video") -> None:
    """The whole table as Parquet, one folder per recording, and as CSV; row counts are checked."""
    back = lambda: df.sparkSession.read.schema(df.schema).parquet(f"{path}/parquet")
    counted(df, lambda rows: rows.write.mode("overwrite").partitionBy(key).parquet(f"{path}/parquet"), back, f"{path}/parquet")
    _to_csv(df, f"{path}/csv")


def sink_jsonl_append(df: DataFrame, path: str) -> None:
    """Rows as further lines of a folder of JSON files; only the new files are counted again."""
    spark, folder = df.sparkSession, Folder(df.sparkSession, path)
    before = set(folder.names())

    def new_lines() -> DataFrame:
        added = [f"{path}/{n}" for n in folder.names() if n not in before and n.startswith("part-")]
        return spark.read.text(added) if added else spark.createDataFrame([], "value string")

    counted(df, lambda rows: rows.write.mode("append").json(path), new_lines, path)


def sink_flat_csv(tables: list[DataFrame], path: str, first: str = "video_id") -> None:
    """Rows of all tables under the union of their columns: ``first``, then the others sorted; row counts are checked."""
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    _to_csv(df.select(first, *sorted(c for c in df.columns if c != first)), path)


def wide_timeseries(df: DataFrame) -> DataFrame:
    """A row per frame: x, y, score and speed of 17 points, rounded to four places."""
    cells = [F.round(F.max(F.when(F.col("kp") == k, F.col(c))), 4).alias(f"{c}_{k}") for k in range(17) for c in ("x", "y", "score", "speed")]
    return df.groupBy("video", "frame").agg(*cells)


def sink_wide_timeseries(df: DataFrame, path: str) -> None:
    _to_csv(wide_timeseries(df).repartition("video").sortWithinPartitions("video", "frame"), path)


def manifest(windows: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Every window, and whether a file of its key is there."""
    there = files.select(key).distinct().withColumn("__loom_there", F.lit(1))
    return windows.join(there, key, "left").withColumn("downloaded", F.when(F.col("__loom_there") == 1, "yes").otherwise("no")).drop("__loom_there")


def sink_manifest(windows: DataFrame, files: DataFrame, key: str, path: str) -> None:
    _to_csv(manifest(windows, files, key), path)
