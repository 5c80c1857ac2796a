"""Sinks that count what they write; bins of recordings kept as chunks of any length."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from motionloom.operators import segments as G
from motionloom.sources import files as S
from motionloom.sources import sinks as K


def test_a_sink_that_loses_rows_fails(spark, tmp_path):
    df, path = spark.range(100).withColumn("v", F.col("id") * 2), str(tmp_path / "t")
    read = lambda: spark.read.parquet(path)
    assert K.counted(df, lambda rows: rows.write.mode("overwrite").parquet(path), read, path) == 100
    with pytest.raises(K.RowsLost, match="100 rows were written, 99 are there"):
        K.counted(df, lambda rows: rows.write.mode("overwrite").parquet(path), lambda: read().where("id != 7"), path)


def test_sinks_count_texts_of_many_lines_and_empty_tables(spark, tmp_path):
    rows = spark.createDataFrame([("a", 'two\nlines, "quoted"'), ("b", None), ("c", "")], "video string, t string")
    for k, df in enumerate((rows, rows.where("false"))):
        path = str(tmp_path / f"f{k}")
        K.sink_features(df, path)
        K.sink_flat_csv([df.withColumnRenamed("video", "video_id")], f"{path}/flat")
        K.sink_jsonl_append(df, f"{path}/lines")
        K.sink_jsonl_append(df, f"{path}/lines")
        assert spark.read.text(f"{path}/lines").count() == (6 if k == 0 else 0)


def test_folders_without_a_scene_file(spark, tmp_path):
    for name, file in (("v1", "scenes.csv"), ("v2", "other.csv"), ("v3", None)):
        (tmp_path / name).mkdir()
        if file:
            (tmp_path / name / file).write_text("split,start,end,duration,cut_confidence\n1,0,1,1,0.5\n")
    assert sorted(r.video_id for r in S.scenes_missing(spark, str(tmp_path)).collect()) == ["v2", "v3"]


@pytest.mark.parametrize("length,block", [(1, 4), (7, 16), (1000, 16), (13, 5)])
def test_bins_cross_chunks(spark, length, block):
    rng = np.random.default_rng(length)
    wave = {k: rng.normal(size=n).tolist() for k, n in enumerate((0, 1, 50, 333))}
    chunks = [(k, at, w[at : at + length]) for k, w in wave.items() for at in range(0, max(len(w), 1), length)]
    bins = [(k, i, int(a), int(n)) for k in [*wave, 9] for i, (a, n) in enumerate(zip(rng.integers(0, 340, 12), rng.integers(1, 60, 12)))]
    got = G.bins_of_chunks(spark.createDataFrame(chunks, "k int, offset int, samples array<double>"), spark.createDataFrame(bins, "k int, i int, first int, width int"), ["k"], block)
    want = {(k, i): (wave.get(k, [])[a : a + n] + [0.0] * n)[:n] for k, i, a, n in bins}
    assert {(r.k, r.i): r.own for r in got.collect()} == want
