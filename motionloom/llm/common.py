"""Helpers shared by the corpus operators: projections, shared work folders and batch slicing."""

from __future__ import annotations

import atexit
import gc
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prefix of columns that live only inside an operator; keeps clear of any input column.
TMP = "__loom_"

_made: list[tuple[object, str]] = []
_tables: list[tuple[DataFrame, SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the driver tables through Spark, so any Hadoop path works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text column with null read as the empty string."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just the id and the whole text (null: empty); other columns never reach an operator."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_of(text_col).alias("text"))


def fold_of(column: str, modulus: int) -> Column:
    """crc32 of the id written as decimal text, modulo ``modulus``."""
    return F.expr(f"pmod(crc32(encode(cast({column} AS string), 'UTF-8')), {modulus})")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; an error where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not held.isDefined():
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = held.get()
    return base


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _forget() -> None:
    for spark, path in _made:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone at exit; each folder is tried
            continue


atexit.register(_forget)


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: lineage ends there.

    The table survives the loss of any executor.  It is deleted when the driver process ends.
    Row groups are small, as rows may be large.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/motionloom/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    df.write.options(**{"parquet.block.size": str(16 << 20)} | options).parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    _tables.append((made, spark, path))
    return made


def drop(df: DataFrame) -> None:
    """Delete the table that ``materialise`` has written for ``df``, which nothing may read any more."""
    for k, (held, spark, path) in enumerate(_tables):
        if held is df:
            _delete(spark, path)
            _made.remove((spark, path))
            del _tables[k]
            return


def sliced(batches: Iterator[pa.RecordBatch], text: str = "text", chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``chars`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = batch.column(batch.schema.get_field_index(text)).nbytes / batch.num_rows
        step = max(1, min(batch.num_rows, int(chars / max(size, 1))))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def give_back() -> None:
    """Return a Python worker's free memory to the system before the worker waits for its next task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
