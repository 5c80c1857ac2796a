"""Work tables in the folder that all executors share, which go when the driver ends; small files of any file system."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def place(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; an error where no shared folder is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = f"{base}/motionloom-io/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


@atexit.register
def _forget() -> None:
    for spark, path in _made:
        try:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        except Exception:  # noqa: BLE001 - the session may be gone at exit; each folder is tried
            continue


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: what follows reads it as often as it likes."""
    path = place(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Folder:
    """Small files and folders below a path of any Hadoop file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, path
        self.fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):  # noqa: ANN202 - a Hadoop path
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, folder: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._at(folder))) if self.fs.exists(self._at(folder)) else []

    def folders(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._at("")) if s.isDirectory())

    def read(self, name: str) -> str:
        stream = self.fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Written aside and renamed, so that it is there as a whole or not at all."""
        aside = self._at(f"{name}.tmp")
        stream = self.fs.create(aside, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self.fs.delete(self._at(name), False)
        self.fs.rename(aside, self._at(name))

    def remove(self, name: str) -> None:
        self.fs.delete(self._at(name), True)
