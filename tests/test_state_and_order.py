"""Walks over sorted rows, streamed tracks, tables and requests over several batches, order statistics of parts."""

import datetime
import os
import random
import re
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from motionloom.operators import cohort as H
from motionloom.operators import tracking as K
from motionloom.operators.order_statistics import exact_quantiles, placed_counts, rank_avg
from motionloom.streaming import resume as R
from motionloom.streaming import streams as W
from motionloom.streaming import upserts as U

BOXES = "video int, frame int, person int, x1 double, y1 double, x2 double, y2 double"


def random_boxes(seed, videos=3, last=80):
    rng, rows = np.random.default_rng(seed), []
    for v in range(videos):
        for f in sorted(rng.choice(last, last // 2, replace=False).tolist()):
            for p in range(int(rng.integers(1, 4))):
                x, y, w, h = 50 * p + rng.normal(0, 25), rng.normal(0, 20), *rng.choice([0.0, 20.0, 60.0], 2, p=[0.05, 0.5, 0.45])
                rows.append((v, f, p, *((None,) * 4 if rng.random() < 0.03 else (float(x), float(y), float(x + w), float(y + h)))))
    return rows


def linked(rows):
    """Tracks by one linker a recording, frame by frame in memory."""
    out = {}
    for v in {r[0] for r in rows}:
        linker, own = K.Linker(), [r for r in rows if r[0] == v]
        for f in sorted({r[1] for r in own}):
            people = sorted(r[2:] for r in own if r[1] == f)
            out |= {(v, f, p[0]): t for p, t in zip(people, linker.step(f, [K.box_of(p[1:]) for p in people]))}
    return out


@pytest.mark.parametrize("rows_a_batch", [1, 7, 10_000])
def test_linking_holds_batches_only(spark, rows_a_batch):
    rows = random_boxes(rows_a_batch)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_a_batch)
    try:
        got = K.link_tracks(spark.createDataFrame(random.Random(1).sample(rows, len(rows)), BOXES)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r.video, r.frame, r.person): r.track for r in got} == linked(rows)
    assert K.link_tracks(spark.createDataFrame([], BOXES)).count() == 0


def test_only_live_tracks_are_held():
    linker = K.Linker(max_gap=5)
    for f in range(2000):
        linker.step(f, [(1000.0 * f, 0.0, 1000.0 * f + 5, 5.0)])
    assert linker.made == 2000 and len(linker.live) <= 7


def test_streamed_tracks_are_the_batch_tracks(spark, tmp_path):
    rows = random_boxes(9, videos=4, last=120)
    start = datetime.datetime(2024, 1, 1)
    data = [(start + datetime.timedelta(seconds=r[1]), *r) for r in rows]
    path, got = str(tmp_path / "in"), None
    kinds = f"ts timestamp, {BOXES}"
    waves = [[d for d in data if (d[2] + (d[2] * 7) % 5) // 25 == k] for k in range(6)]  # frames of two waves are mixed
    assert sum(map(len, waves)) == len(data)
    for k, wave in enumerate([*waves, [(start + datetime.timedelta(days=3), *(None,) * 7)]]):
        spark.createDataFrame(wave, kinds).write.mode("append").parquet(path)
        # The stream is stopped after every wave and goes on from its checkpoint.
        stream = spark.readStream.schema(kinds).parquet(path)
        got = W.run_to_files(W.stream_track_gap(stream, late="6 seconds", idle=datetime.timedelta(days=30)), str(tmp_path / "out"), str(tmp_path / "state"))
        if k == 3:
            assert 0 < got.count() < len(rows)  # tracks come as the watermark passes, not at the end
    assert {(r.video, r.frame, r.person): r.track for r in got.collect()} == linked(rows)


def test_idle_recordings_are_forgotten(spark, tmp_path):
    start, box, path = datetime.datetime(2024, 1, 1), (0.0, 0.0, 9.0, 9.0), str(tmp_path / "in")
    kinds = f"ts timestamp, {BOXES}"
    got = None
    for day, rows in ((0, [(1, 0, 0, *box), (1, 0, 1, *(b + 500 for b in box))]), (5, [(2, 0, 0, *box)]), (9, [(1, 1, 0, *box)]), (20, [(3, 0, 0, *box)])):
        spark.createDataFrame([(start + datetime.timedelta(days=day), *r) for r in rows], kinds).coalesce(1).write.mode("append").parquet(path)
        got = W.run_to_files(W.stream_track_gap(spark.readStream.schema(kinds).parquet(path), idle=datetime.timedelta(days=1)), str(tmp_path / "out"), str(tmp_path / "state"))
        time.sleep(1.1)
    assert sorted((r.video, r.frame, r.track) for r in got.where("video = 1").collect()) == [(1, 0, 0), (1, 0, 1), (1, 1, 0)]


def test_ranks_and_quantiles_of_parts(spark):
    rng = np.random.default_rng(3)
    rows = [(None if k % 7 == 0 else int(rng.integers(0, 3)), float(v)) for k, v in enumerate(np.round(rng.normal(0, 3, 3000), 1))] + [(8, 5.0)] * 400 + [(9, None), (8, None)]
    df = spark.createDataFrame(rows, "k int, v double")
    pdf = pd.DataFrame(rows, columns=["k", "v"]).dropna(subset="v")
    at = {"low": 0.05, "mid": 0.5, "high": 0.999}
    got = {r.k: r for r in exact_quantiles(df, ["k"], "v", at).collect()}
    for k, own in pdf.groupby("k", dropna=False):
        r = got[None if pd.isna(k) else int(k)]
        assert r.n == len(own) and [r[c] for c in at] == pytest.approx([np.quantile(own.v, q) for q in at.values()])
    assert set(got) == {None, 0, 1, 2, 8}
    ranks = {(r.k, r.v): (r.rank_avg, r.ties) for r in rank_avg(df, ["k"], "v").collect()}
    own = pdf.dropna()
    own = own.assign(rank=own.groupby("k").v.rank(), ties=own.groupby(["k", "v"]).v.transform("size"))
    assert ranks == {(int(r.k), r.v): (r["rank"], r.ties) for _, r in own.iterrows()}


def test_no_window_holds_a_group(spark):
    df = spark.range(2000).selectExpr("1 AS k", "id * 1.5 AS v", "id % 3 = 0 AS own")
    counts = placed_counts(df, ["k"], "v")
    assert counts.count() == 2000 and counts.agg(F.max(F.col("before") + F.col("ties"))).first()[0] == 2000
    for made in (counts, H.mann_whitney(df, ["k"], "v", "own")):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        specs = re.findall(r"windowspecdefinition\(([^)]*)\)", plan)
        assert specs and all("__loom_part" in s or "v#" not in s for s in specs) and "percentile" not in plan
    assert counts.select(F.spark_partition_id()).distinct().count() >= 1


def test_upserts_write_what_they_get_and_keep_few_runs(spark, tmp_path):
    path, kinds = str(tmp_path / "table"), "k int, at int, v string"
    upsert, rng, state = U.upsert_latest(path, ["k"], ["at"], fanout=3), random.Random(4), {}
    most = 0
    for n in range(14):
        rows = [(rng.choice([None, *range(40)]), rng.randint(0, 30), f"{n}-{j}") for j in range(10)]
        rows = list({r[:2]: r for r in rows}.values())  # one row a key and place in a batch
        for _ in range(2 if n % 4 == 0 else 1):  # some batches come twice
            upsert(spark.createDataFrame(rows, kinds), n)
        for k, at, v in sorted(rows, key=lambda r: r[1]):
            if k not in state or at >= state[k][0]:
                state[k] = at, v
        assert {r.k: (r["at"], r.v) for r in U.latest_of(spark, path).collect()} == state
        runs = [d for d in os.listdir(path) if d.startswith("run-")]
        most = max(most, len(runs))
        if f"run-{n}-0" in runs:
            assert spark.read.parquet(f"{path}/run-{n}-0").count() == len({r[0] for r in rows})
    assert most <= 2 * 2 * 4 and len(os.listdir(f"{path}/_manifests")) <= 4 and U.last_batch(spark, path) == 13
    upsert(spark.createDataFrame([(1, 99, "old batch")], kinds), 5)  # has been taken
    assert {r.k: (r["at"], r.v) for r in U.latest_of(spark, path).collect()} == state


def test_a_failed_batch_leaves_nothing(spark, tmp_path):
    path, kinds = str(tmp_path / "table"), "k int, at int"
    upsert = U.upsert_latest(path, ["k"], ["at"], fanout=2)
    upsert(spark.createDataFrame([(1, 1)], kinds), 0)
    spark.createDataFrame([(7, 7, 1)], "k int, at int, __loom_batch long").write.parquet(f"{path}/run-1-0")  # files, but no manifest
    assert [tuple(r) for r in U.latest_of(spark, path).collect()] == [(1, 1)]
    upsert(spark.createDataFrame([(1, 2)], kinds), 1)
    assert [tuple(r) for r in U.latest_of(spark, path).collect()] == [(1, 2)]
    with pytest.raises(ValueError):
        U.latest_of(spark, str(tmp_path / "none"))


def test_first_seen_over_batches(spark, tmp_path):
    path, kinds = str(tmp_path / "keys"), "a int, b string"
    write = U.first_seen(path, ["a", "b"])
    batches = [[(1, "x"), (1, "x"), (None, "y")], [(1, "x"), (2, None)], [(None, "y"), (2, None), (3, "z")], []]
    for n in (0, 1, 1, 2, 3):
        write(spark.createDataFrame(batches[n], kinds), n)
    got = spark.read.parquet(f"{path}/new")
    assert sorted(((r.batch, r.a or 0, r.b or "") for r in got.collect())) == [(0, 0, "y"), (0, 1, "x"), (1, 2, ""), (2, 3, "z")]


def test_requests_come_again_until_they_are_answered(spark, tmp_path):
    assert R.decide(None, [(0, None), (1, None), (2, False), (3, None), (4, True), (5, None), (6, False), (7, None)], 100) == ([True, False, False, True, False, False, False, False], (R.DONE, 4))
    assert R.decide((R.ASKED, 0), [(100, None), (101, None), (102, None)], 100) == ([False, True, False], (R.ASKED, 101))
    assert R.decide((R.FAILED, 0), [], 100) == ([], (R.FAILED, 0))
    start, kinds, path = datetime.datetime(2024, 1, 1), "ts timestamp, k string, n int, ok boolean", str(tmp_path / "in")
    waves = [[("a", None), ("b", None), (None, None)], [("a", False), ("b", True), ("a", None), ("b", None), ("c", None)], [("a", None), ("c", False)], [("a", True), ("c", None), ("b", None), (None, None), ("a", None)]]
    got, n = None, 0
    for wave in waves:
        rows = []
        for k, ok in wave:
            rows.append((start + datetime.timedelta(minutes=n), k, n, ok))
            n += 1
        spark.createDataFrame(rows, kinds).write.mode("append").parquet(path)
        stream = spark.readStream.schema(kinds).parquet(path)
        got = W.run_to_files(R.stream_resume(stream, ["k"], "ok", "n"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted((r.n, r.k or "") for r in got.collect()) == [(0, "a"), (1, "b"), (2, ""), (5, "a"), (7, "c"), (11, "c")]


def test_late_texts_collapse_in_their_order(spark, tmp_path):
    """Each row alone in a batch, in a shuffled order, and the stream started anew twice: as over all rows together."""
    import datetime
    import random

    from motionloom.streaming import streams as W

    rng, at = random.Random(8), datetime.datetime(2024, 1, 1)
    rows = [(k, at + datetime.timedelta(seconds=k // 2), rng.choice([1, 2, None]), rng.choice(["a", "b", None])) for k in range(60)]
    rows.sort(key=lambda r: (r[1], rng.random()))
    kinds = "event_id long, ts timestamp, user_id long, event_type string"
    want, last = [], {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        if r[2] not in last or last[r[2]] != r[3]:
            want.append((r[2], r[0], r[3]))
        last[r[2]] = r[3]
    path = str(tmp_path / "in")
    waves = [[r for i, r in enumerate(rows) if i % 3 == w] for w in range(3)]
    got = None
    for wave in (*waves, None):
        if wave:
            spark.createDataFrame(wave, kinds).coalesce(1).write.mode("append").parquet(path)
        else:
            W.heartbeat(spark.read.parquet(path), path)
        stream = W.stream_collapse_in_order(W.event_stream(spark, path, 10), "user_id", "event_type", late="2 minutes")
        got = W.run_to_files(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    key = lambda r: (r[1], r[0] or 0)
    assert sorted([(r.user_id, r.event_id, r.event_type) for r in got.collect()], key=key) == sorted(want, key=key)
