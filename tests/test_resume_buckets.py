"""Keys of the resume stream are looked after a bucket at a time, with the results of one key at a time."""

import datetime
import random

import pytest
from pyspark.errors import PySparkException

from motionloom.streaming import resume as R
from motionloom.streaming import streams as W

START = datetime.datetime(2024, 1, 1)
BIG = 2**53


def run(spark, tmp_path, kinds, keys, waves, name="s", **how):
    """Each wave with the stream started anew; rows, and the number of states that were kept last."""
    path, held = str(tmp_path / f"{name}-in"), 0
    for wave in waves:
        spark.createDataFrame(wave, kinds).coalesce(1).write.mode("append").parquet(path)
        df = R.stream_resume(spark.readStream.schema(kinds).parquet(path), keys, "ok", "n", **how)
        q = df.writeStream.format("parquet").option("path", str(tmp_path / f"{name}-out")).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
        q.awaitTermination()
        held = q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"]
    got = spark.read.schema(df.schema).parquet(str(tmp_path / f"{name}-out"))
    assert got.columns == [*keys, "n", "ts"]
    return got.collect(), held


def test_many_keys_are_few_states(spark, tmp_path):
    rng, kinds = random.Random(4), "ts timestamp, a long, b string, at timestamp, n long, ok boolean"
    # Keys with nulls, with quotes, with times a microsecond apart; ties beyond 2**53, one apart, and a missing one.
    keys = [(a, b, at) for a in (None, BIG, BIG + 1, 0) for b in (None, "", '"', "null", "x,y") for at in (None, *(START + datetime.timedelta(microseconds=k) for k in range(8)))]
    rows = []
    for k in range(1200):
        key, at = rng.choice(keys), START + datetime.timedelta(hours=k // 4)
        rows.append((at, *key, BIG + k if k % 400 else None, rng.choice([None, None, True, False])))
    waves = [rows[:400], rows[400:800], rows[800:]]
    states, want = {}, []
    for wave in waves:
        for row in sorted(wave, key=lambda r: (r[0], r[4] is None, r[4] or 0)):
            us = (row[0] - START) // datetime.timedelta(microseconds=1)
            (go,), states[row[1:4]] = R.decide(states.get(row[1:4]), [(us, row[5])], 6 * 3600 * 10**6)
            if go:
                want.append((*row[1:5], row[0]))
    shuffled = [rng.sample(wave, len(wave)) for wave in waves]
    got, held = run(spark, tmp_path, kinds, ["a", "b", "at"], shuffled, buckets=8)
    assert len(states) > 100 and held <= 8
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_numbers_that_are_one_key(spark, tmp_path):
    rows = [(START + datetime.timedelta(minutes=n), v, n, None) for n, v in enumerate([0.0, -0.0, float("nan"), float("nan"), 0.1, None, None])]
    got, _ = run(spark, tmp_path, "ts timestamp, v double, n int, ok boolean", ["v"], [rows])
    assert sorted(r.n for r in got) == [0, 2, 4, 5]


def test_a_key_is_forgotten_while_its_bucket_lives(spark, tmp_path):
    """One bucket: key a has no rows for longer than it is kept, key b has; the watermark passes a's time in the third wave."""
    day = lambda n: START + datetime.timedelta(days=n)
    waves = [[(day(0), "a", 0, True), (day(0), "b", 1, True)], [(day(8), "b", 2, True)], [(day(16), "b", 3, None)], [(day(17), "b", 4, None)], [(day(18), "a", 5, None), (day(18), "b", 6, None)]]
    got, held = run(spark, tmp_path, "ts timestamp, k string, n int, ok boolean", ["k"], waves, keep=datetime.timedelta(days=10), late="1 day", buckets=1)
    assert sorted((r.k, r.n) for r in got) == [("a", 5)] and held == 1
    waves = [[(day(0), "a", 0, True)], [(day(30), "a", 1, True)], [(day(60), None, 2, None)], [(day(90), None, 3, True)], [(day(91), "a", 4, None)]]
    got, _ = run(spark, tmp_path, "ts timestamp, k string, n int, ok boolean", ["k"], waves, name="t", keep=datetime.timedelta(days=10), late="1 day", patience=datetime.timedelta(days=1))
    assert sorted((r.k or "", r.n) for r in got) == [("", 2), ("a", 4)]


def test_a_checkpoint_keeps_its_number_of_buckets(spark, tmp_path):
    kinds, path = "ts timestamp, k string, n int, ok boolean", str(tmp_path / "in")
    spark.createDataFrame([(START, "a", 0, None)], kinds).write.parquet(path)
    W.run_to_files(R.stream_resume(spark.readStream.schema(kinds).parquet(path), ["k"], "ok", "n", buckets=1), str(tmp_path / "out"), str(tmp_path / "state"))
    spark.createDataFrame([(START, k, 1, None) for k in "abcdefgh"], kinds).write.mode("append").parquet(path)
    with pytest.raises(PySparkException, match="buckets of keys"):
        W.run_to_files(R.stream_resume(spark.readStream.schema(kinds).parquet(path), ["k"], "ok", "n", buckets=2), str(tmp_path / "out"), str(tmp_path / "state"))
