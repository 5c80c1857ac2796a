"""Operators against numpy and pandas restatements, and their properties."""

import datetime
import itertools
import math
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from motionloom.functions import circular as C
from motionloom.functions import scalars as Z
from motionloom.operators import annotations as A
from motionloom.operators import cohort as H
from motionloom.operators import motion as M
from motionloom.operators import pose as P
from motionloom.operators import segments as G
from motionloom.operators import sequences as S
from motionloom.operators import tracking as K


def series(seed, n=60, gaps=0.3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=n).cumsum()
    x[rng.random(n) < gaps] = np.nan
    return x


def frame(spark, x, fps=25):
    return spark.createDataFrame([(1, "a", i, None if np.isnan(v) else float(v), fps) for i, v in enumerate(x)], "video int, bp string, frame int, x double, fps int")


def column(df, name, order="frame"):
    return df.orderBy(order).select(name).toPandas()[name].to_numpy(float)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_interpolate_is_pandas(spark, seed):
    x = series(seed)
    got = column(S.interpolate(frame(spark, x), ["x"], ["video", "bp"], "frame"), "x")
    np.testing.assert_allclose(got, pd.Series(x).interpolate().to_numpy())


@pytest.mark.parametrize("width", [1, 2, 6, 7, 12])
def test_rolling_is_pandas(spark, width):
    x = series(3, gaps=0.05)
    df = frame(spark, x).withColumn("w", F.lit(width))
    for how in ("median", "mean"):
        got = column(S.rolling_centered(df, {"o": "x"}, ["video", "bp"], "frame", "w", how), "o")
        np.testing.assert_allclose(got, getattr(pd.Series(x).rolling(width, center=True), how)().to_numpy())
    got = column(S.rolling_trailing(df, {"o": "x"}, ["video", "bp"], "frame", "w"), "o")
    np.testing.assert_allclose(got, pd.Series(x).rolling(width).mean().to_numpy())


def test_gradient_is_numpy(spark):
    x = series(4, gaps=0)
    got = column(frame(spark, x).withColumn("o", S.gradient("x", F.lit(0.04), ["video", "bp"], "frame")), "o")
    np.testing.assert_allclose(got, np.gradient(x, 0.04))


def test_savgol_is_least_squares(spark):
    x = series(5, n=40, gaps=0.12)
    got = column(M.savgol_smooth(frame(spark, x), "x", "o", ["video"], "frame", 7), "o")
    want = x.copy()
    for run in np.split(np.arange(40), np.flatnonzero(np.diff(np.isnan(x).astype(int))) + 1):
        if not np.isnan(x[run[0]]) and len(run) >= 7:
            for k, i in enumerate(run):
                a = min(max(k - 3, 0), len(run) - 7)
                want[i] = np.polyval(np.polyfit(np.arange(7), x[run[a : a + 7]], 2), k - a)
    np.testing.assert_allclose(got, want, atol=1e-9)


def test_angle_deltas_and_folding(spark):
    df = spark.createDataFrame([(1, "a", i, v) for i, v in enumerate([350.0, 10.0, 200.0, 20.0])], "video int, bp string, frame int, x double")
    assert column(df.withColumn("o", S.angle_delta("x", ["video", "bp"], "frame")), "o").tolist() == [0.0, 20.0, -170.0, -180.0]
    a = np.linspace(-3, 3, 13)
    got = spark.createDataFrame([(float(v),) for v in a], "a double").select(P.folded(F.col("a")).alias("f")).toPandas()["f"]
    np.testing.assert_allclose(got, (np.pi - a) % (2 * np.pi))


def test_trunk_is_one_after_scaling(spark):
    rng = np.random.default_rng(6)
    parts = ["LShoulder", "RShoulder", "LHip", "RHip", "LKnee"]
    df = spark.createDataFrame([(1, f, p, *map(float, rng.normal(size=2))) for f in range(5) for p in parts], "video int, frame int, bp string, x double, y double")
    refs = P.skeleton_refs(P.rotate_scale_skeleton(df)).toPandas()
    np.testing.assert_allclose(refs.trunk, np.ones(5))


@pytest.mark.parametrize("dur", [0.0, 1.0, 9.9, 10.0, 11.0, 12.5, 95.0])
def test_windows_tile(spark, dur):
    w = G.fixed_windows(spark.createDataFrame([(dur,)], "d double"), "d").orderBy("segment_index").toPandas()
    if dur == 0:
        assert not len(w)
        return
    assert w.start_sec.iloc[0] == 0 and w.end_sec.iloc[-1] == dur
    assert (w.start_sec.iloc[1:].to_numpy() == w.end_sec.iloc[:-1].to_numpy()).all()


def runts_loop(scenes, least):
    """Short scenes join the one before; then, while the first is short, it joins the next."""
    out = []
    for a, b, c in scenes:
        if out and b - a < least:
            out[-1] = [out[-1][0], b, c, out[-1][3] + 1]
        else:
            out.append([a, b, c, 0])
    while len(out) > 1 and out[0][1] - out[0][0] < least:
        first = out.pop(0)
        out[0][0], out[0][3] = first[0], out[0][3] + first[3] + 1
    return [tuple(x) for x in out]


def test_runts_equal_the_loop(spark):
    rng = np.random.default_rng(7)
    lists = [[0.5, 0.6, 3.0], [0.5, 0.4, 3.0], [0.5], [0.5, 0.2], [2.0, 0.1, 0.1]] + [list(rng.choice([0.3, 0.5, 0.9, 1.5, 2.0], rng.integers(1, 12))) for _ in range(80)]
    rows, want = [], {}
    for k, lens in enumerate(lists):
        ends = np.cumsum(lens)
        scenes = [(float(e - n), float(e), i / 10) for i, (e, n) in enumerate(zip(ends, lens))]
        rows += [(k, *x) for x in scenes]
        want[k] = runts_loop(scenes, 1.0)
    assert len(want[0]) == 2 and len(want[1]) == 1
    got = {}
    for r in G.merge_runts(spark.createDataFrame(rows, "k int, start_sec double, end_sec double, cut_confidence double"), ["k"], 1.0).orderBy("k", "start_sec").collect():
        got.setdefault(r.k, []).append((r.start_sec, r.end_sec, r.cut_confidence, r.merged_runts))
    assert got == want


def test_subdivision_has_a_tolerance(spark):
    df = spark.createDataFrame([(0.0, 10.0000000000002, 0.5), (0.0, 10.1, 0.5), (0.0, 25.0, 0.5)], "start_sec double, end_sec double, cut_confidence double")
    assert sorted(r.parts for r in G.subdivide_equal(df, 10.0).collect()) == [1, 2, 2, 3, 3, 3]


def test_boxes(spark):
    tall, wide = (0.0, 0.0, 10.0, 100.0), (40.0, 0.0, 140.0, 10.0)
    pairs = [(tall, wide), ((0.0, 0.0, 0.0, 5.0), (0.0, 0.0, 0.0, 5.0)), ((0.0, 0.0, 10.0, 10.0), (6.0, 0.0, 16.0, 10.0)), ((0.0, 0.0, 10.0, 10.0), (0.0, 0.0, 20.0, 20.1)), ((0.0, 0.0, 10.0, 10.0), (0.0, 0.0, 20.0, 20.0))]
    df = spark.createDataFrame([(i, *a, *b) for i, (a, b) in enumerate(pairs)], "i int, a0 double, a1 double, a2 double, a3 double, b0 double, b1 double, b2 double, b3 double")
    got = df.select("i", K.weak_match([F.col(f"a{k}") for k in range(4)], [F.col(f"b{k}") for k in range(4)]).alias("w")).orderBy("i").collect()
    assert [r.w for r in got] == [0.0, 0.0, 0.15, 0.0, 0.15]


def test_rank_test_exact_tail(spark):
    a, b = [1.0, 4.0, 6.0], [2.0, 3.0, 5.0, 7.0, 8.0]
    df = spark.createDataFrame([(1, v, True) for v in a] + [(1, v, False) for v in b], "k int, v double, ref boolean")
    got = H.mann_whitney(df, ["k"], "v", "ref").first()
    allv = sorted(a + b)
    u = lambda s: sum(allv.index(x) + 1 for x in s) - 6
    every = [u(s) for s in itertools.combinations(allv, 3)]
    m = max(u(a), 15 - u(a))
    assert got.u1 == u(a)
    assert got.p == pytest.approx(min(1, 2 * sum(x >= m for x in every) / len(every)))


def test_rank_test_is_exact_for_skewed_groups(spark):
    rows = [(1, float(v), v == 10_001) for v in range(10_002)] + [(2, float(v), v >= 8) for v in range(1308)]
    got = {r.k: r.p for r in H.mann_whitney(spark.createDataFrame(rows, "k int, v double, ref boolean"), ["k"], "v", "ref").collect()}
    assert got[1] == pytest.approx(2 / 10_002, rel=1e-9)
    assert got[2] == pytest.approx(2 / math.comb(1308, 8), rel=1e-9)


def test_normal_rank_test(spark):
    """More than eight on each side, with ties: normal with both corrections, restated."""
    rng = np.random.default_rng(12)
    x, y = rng.integers(0, 30, 20).astype(float), rng.integers(5, 35, 40).astype(float)
    both = np.concatenate((x, y))
    ranks = np.array([(both < v).sum() + ((both == v).sum() + 1) / 2 for v in both])
    u = ranks[:20].sum() - 210
    ties = np.unique(both, return_counts=True)[1]
    sd = math.sqrt(800 / 12 * (61 - (ties**3 - ties).sum() / (60 * 59)))
    df = spark.createDataFrame([(1, float(v), i < 20) for i, v in enumerate(both)], "k int, v double, ref boolean")
    got = H.mann_whitney(df, ["k"], "v", "ref").first()
    assert got.u1 == u and got.p == pytest.approx(math.erfc((max(u, 800 - u) - 400.5) / sd / math.sqrt(2)), rel=1e-10)


def test_erfc_and_correlation(spark):
    z = [0.0, 1e-9, 0.5, 1.0, 1.96, 2.8, 2.83, 3.0, 6.0, 12.0, 35.0]
    got = spark.createDataFrame([(x,) for x in z], "z double").select(Z.p_two_sided(F.col("z")).alias("p")).toPandas()["p"]
    np.testing.assert_allclose(got, [math.erfc(x / math.sqrt(2)) for x in z], rtol=1e-12)
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert flat.agg(P.correlation("x", "y").alias("c")).first().c is None


def test_von_mises_at_any_concentration(spark):
    k = [0.0, 0.1, 1.0, 10.0, 29.9, 30.1, 50.0, 100.0, 200.0, 700.0]
    got = spark.createDataFrame([(x,) for x in k], "k double").select(C.log_bessel_i0(F.col("k")).alias("l"), C.vmpdf(F.lit(0.3), F.lit(0.1), F.col("k")).alias("p")).toPandas()
    np.testing.assert_allclose(got.l, np.log(np.i0(k)), rtol=1e-12, atol=1e-14)
    np.testing.assert_allclose(got.p, np.exp(np.array(k) * np.cos(0.2)) / (2 * np.pi * np.i0(k)), rtol=1e-10)


def test_factorisation_and_regression(spark):
    rng = np.random.default_rng(13)
    m = rng.normal(size=(50, 4)) @ rng.normal(size=(4, 4))
    df = spark.createDataFrame([tuple(map(float, r)) for r in m], "a double, b double, c double, d double")
    s = np.linalg.svd((m - m.mean(0)) / m.std(0, ddof=1), compute_uv=False) ** 2
    assert [r.share for r in H.svd_variance(df, list("abcd")).orderBy("component").collect()] == pytest.approx(np.round(s / s.sum(), 2).tolist(), abs=0.0101)
    fit = H.poly2(df.withColumn("k", F.lit(1)), ["k"], "a", "b").first()
    np.testing.assert_allclose([fit.c2, fit.c1, fit.c0], np.polyfit(m[:, 0], m[:, 1], 2))


def test_scored_features():
    assert len(H.SCORED_FEATURES) == 38
    with pytest.raises(ValueError, match="are listed"):
        H.whitelist(None, [], H.SCORED_FEATURES[1:])


def test_whitelist_needs_every_feature(spark):
    df = spark.createDataFrame([tuple(map(float, range(38)))], ", ".join(f"{f} double" for f in H.SCORED_FEATURES)).withColumn("extra", F.lit(1))
    assert H.whitelist(df, []).columns == H.SCORED_FEATURES
    with pytest.raises(ValueError, match="1 of 38"):
        H.whitelist(df.drop("Wrist_meanent"), [])


def test_loose_json(spark):
    raws = ['{"a": true, "n": "3", "l": ["X ", "y", "X"]}', '{"a": "Yes", "n": "2.7", "l": "x"}', '{"a": 0, "n": 2.7}', '{"a": null, "n": -3}', "nothing"]
    v = spark.createDataFrame([(r,) for r in raws], "r string").withColumn("v", Z.extract_json_object(F.col("r")))
    got = v.select(Z.coerce_bool(*Z.kind_and_text(F.col("v"), "$.a")).alias("a"), Z.coerce_int(*Z.kind_and_text(F.col("v"), "$.n")).alias("n"), Z.closed_array(F.col("v"), "$.l", ["x"]).alias("l"), Z.key_present(F.col("v"), "$.l").alias("k")).collect()
    assert [r.a for r in got[:4]] == [True, True, False, False]
    assert [r.n for r in got[:4]] == [3, 0, 2, 0]
    assert [r.l for r in got[:2]] == [["x", "x"], []]
    odd = [('1e12', 10**12), ('"7\\n"', 7), ('"1_000"', 1000), ('1e300', 2**63 - 1), ('9007199254740993', 9007199254740993), ('"2_"', 0), ('true', 1), ('null', 0), ('[3]', 0)]
    v = spark.createDataFrame([(f'{{"n": {r}, "w": " Sitting\\n", "s": null, "o": [null, true, "x\\u00a0"]}}',) for r, _ in odd], "r string").withColumn("v", Z.extract_json_object(F.col("r")))
    out = v.select(Z.coerce_int(*Z.kind_and_text(F.col("v"), "$.n")).alias("n"), Z.closed_scalar(F.col("v"), "$.w", ["sitting"]).alias("w"), Z.closed_scalar(F.col("v"), "$.s", ["none"]).alias("s"), Z.objects_top(F.col("v"), "$.o").alias("o"), Z.closed_scalar(F.col("v"), "$.gone", ["none"]).alias("g")).collect()
    assert [r.n for r in out] == [n for _, n in odd]
    assert {(r.w, r.s, r.g, tuple(r.o)) for r in out} == {("sitting", "none", None, ("None", "True", "x"))}
    assert [r.k for r in got[:4]] == [True, True, False, False]


def test_tracks(spark):
    rows = [(1, f, p, 10.0 * p + f, 0.0, 10.0 * p + f + 8, 8.0) for f in range(6) for p in (0, 1) if not (f == 3 and p == 1)]
    df = spark.createDataFrame(rows, "video int, frame int, person int, x1 double, y1 double, x2 double, y2 double")
    t = K.link_tracks(df).toPandas()
    assert t.groupby("person").track.nunique().tolist() == [1, 1] and t.track.nunique() == 2
    people = spark.createDataFrame([(1, f, p, float(100 * p + f), 0.0, 10.0, 0.9 - 0.1 * p, 10) for f in range(5) for p in (0, 1)], "video int, frame int, person int, cx double, cy double, span double, mean_score double, n_good int")
    assert M.greedy_centroid_track(people).toPandas().person.tolist() == [0] * 5


def linked_loop(frames, least=0.3, max_gap=15):
    """Tracks of boxes by a plain loop: pairs by falling score, then later track, then later box."""

    def score(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        size = lambda x: (x[2] - x[0]) * (x[3] - x[1])
        common = max(w, 0) * max(h, 0)
        if common and common / (size(a) + size(b) - common) >= least:
            return common / (size(a) + size(b) - common)
        sides = [a[2] - a[0], a[3] - a[1], b[2] - b[0], b[3] - b[1]]
        if min(sides) <= 0 or max(size(a), size(b)) > 4 * min(size(a), size(b)):
            return 0
        apart = math.dist(((a[0] + a[2]) / 2, (a[1] + a[3]) / 2), ((b[0] + b[2]) / 2, (b[1] + b[3]) / 2))
        return 0.15 if apart < math.hypot(sides[0] + sides[2], sides[1] + sides[3]) / 4 else 0

    tracks, live, out = 0, [], {}
    for f, boxes in sorted(frames.items()):
        live = [t for t in live if f - t["at"] <= max_gap]
        done_t, done_b = set(), set()
        for v, i, j in sorted(((score(t["box"], b), i, j) for i, t in enumerate(live) for j, b in enumerate(boxes)), reverse=True):
            if v > 0 and i not in done_t and j not in done_b:
                done_t.add(i)
                done_b.add(j)
                live[i] |= {"at": f, "box": boxes[j]}
                out[f, j] = live[i]["id"]
        for j, b in enumerate(boxes):
            if j not in done_b:
                live.append({"id": tracks, "at": f, "box": b})
                out[f, j] = tracks
                tracks += 1
    return out


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_linking_is_the_loop(spark, seed):
    rng = np.random.default_rng(seed)
    frames = {}
    for f in sorted(rng.choice(120, 70, replace=False).tolist()):
        boxes = []
        for p in range(int(rng.integers(1, 5))):
            x, y, w, h = 60 * p + rng.normal(0, 25), rng.normal(0, 20), *rng.choice([0.0, 8.0, 20.0, 60.0], 2, p=[0.05, 0.25, 0.4, 0.3])
            boxes.append((float(x), float(y), float(x + w), float(y + h)))
        frames[f] = boxes
    df = spark.createDataFrame([(1, f, j, *b) for f, bs in frames.items() for j, b in enumerate(bs)], "video int, frame int, person int, x1 double, y1 double, x2 double, y2 double")
    assert {(r.frame, r.person): r.track for r in K.link_tracks(df).collect()} == linked_loop(frames)


@pytest.mark.parametrize("seed", [3, 4])
def test_following_is_the_loop(spark, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for f in range(60):
        for p in range(int(rng.integers(0, 4))):
            at, size = rng.normal(0, 30, 2), rng.choice([0.0, 30.0, 80.0])
            rows += [(1, f, p, k, float(at[0] + size * rng.random()), float(at[1] + size * rng.random()), float(s)) for k, s in enumerate(np.clip(rng.normal(rng.choice([0.1, 0.5]), 0.2, 17), 0, 1))]
    points = pd.DataFrame(rows, columns=["video", "frame", "person", "kp", "x", "y", "score"])
    want, centre, span = {}, None, None
    for f, people in points.groupby("frame"):
        able = []
        for p, g in people.groupby("person"):
            good = g[g.score >= 0.3]
            if g.score.mean() >= 0.15 and len(good) >= 4:
                able.append((p, g, (good.x.mean(), good.y.mean())))
        if not able:
            continue
        if centre is None:
            p, g, c = max(able, key=lambda t: t[1].score.mean())
        else:
            p, g, c = min(able, key=lambda t: math.dist(t[2], centre))
            if span and math.dist(c, centre) > 0.5 * span:
                continue
        centre, span, want[f] = c, math.hypot(g.x.max() - g.x.min(), g.y.max() - g.y.min()) or span, p
    got = M.greedy_centroid_track(M.track_candidates(spark.createDataFrame(points))).collect()
    assert {r.frame: r.person for r in got} == want


def test_cohort_manifest_and_summary(spark):
    kinds = "line int, model string, segmentation string, video_id string, segment_index int, parse_ok boolean, start_sec double, end_sec double, description string, audio_description string, walks boolean"
    rows = [
        (1, "b", None, "v", 0, True, 0.0, 10.0, "old", "", True),
        (2, "a", "", "v", 0, True, 0.0, 10.0, "other", "", True),
        (3, "b", "fixed", "v", 0, True, 0.0, 10.0, " new\n", "", True),
        (4, "c", "fixed", "v", 0, True, 0.0, 10.0, "no", "", False),
        (5, "b", "fixed", "v", 1, True, 10.0, 20.0, "new", "hum", False),
        (6, "b", "fixed", "v", 2, True, 20.0, 31.5, "", "hum", False),
        (7, "b", "fixed", "v", 3, True, 40.0, 50.0, "end", None, False),
        (8, "b", "fixed", "v", 4, False, 50.0, 60.0, "failed", "", True),
    ]
    df = spark.createDataFrame(rows, kinds)
    got = A.cohort_manifest(df, ["line"], F.col("walks"), 2).collect()
    assert [(r.segment_index, r.n_models_match, r.n_models_seen, r.models_match, r.models_seen, r.description) for r in got] == [(0, 2, 3, "a;b", "a;b;c", " new\n")]
    own = {r.model: r for r in A.video_summary(df, ["line"]).collect()}
    assert own["b"].timeline == "[00:00:00-00:00:20] new\n[00:00:40-00:00:50] end"
    assert own["b"].audio_timeline == "[00:00:10-00:00:31] hum" and own["a"].audio_timeline is None
    assert (own["b"].n_chunks, own["b"].span_sec, own["b"].covered_sec) == (4, 50.0, 41.5)


def test_dominant_frequency(spark):
    t = np.arange(100) / 25
    df = frame(spark, np.sin(2 * np.pi * 2.0 * t))
    r = M.dominant_frequency(df, ["video"], "frame", "x", "fps").first()
    assert r.freq == pytest.approx(2.0) and r.share > 0.99


def test_stream_keeps_state_between_batches(spark, tmp_path):
    from motionloom.streaming import streams as W

    kinds = "event_id long, ts timestamp, user_id long, event_type string, value double"
    at = datetime.datetime(2024, 1, 1)
    first = spark.createDataFrame([(1, at, 1, "a", 1.0), (2, at + datetime.timedelta(seconds=1), 1, "a", 1.0)], kinds).coalesce(1)
    second = spark.createDataFrame([(3, at + datetime.timedelta(seconds=2), 1, "a", 1.0), (4, at + datetime.timedelta(seconds=3), 1, "b", 1.0)], kinds).coalesce(1)
    path = str(tmp_path / "in")
    first.write.parquet(path)
    time.sleep(1.1)  # files are taken in order of their times
    second.write.mode("append").parquet(path)
    run = lambda: W.run_to_files(W.stream_collapse_text(W.event_stream(spark, path), "user_id", "event_type"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted(r.event_id for r in run().collect()) == [1, 4]
    time.sleep(1.1)
    third = spark.createDataFrame([(5, at + datetime.timedelta(days=40), 2, "z", 1.0)], kinds).coalesce(1)
    third.write.mode("append").parquet(path)
    run()
    time.sleep(1.1)
    spark.createDataFrame([(6, at + datetime.timedelta(days=41), 1, "b", 1.0)], kinds).coalesce(1).write.mode("append").parquet(path)
    assert sorted(r.event_id for r in run().collect()) == [1, 4, 5, 6]  # user 1 had been forgotten


def test_lines_keep_their_order_over_blocks(spark, tmp_path):
    from motionloom.sources import files as S

    (tmp_path / "a.tsv").write_text("".join(f"v{k % 50}\ttitle {k}\t{k}\tu\n" for k in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = S.scan_tsv_manifest(spark, str(tmp_path))
        assert {r.id: r.title for r in got.collect()} == {f"v{k}": f"title {4950 + k}" for k in range(50)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_operators_by_name(spark):
    from motionloom import engine

    df = spark.createDataFrame([(1, 0.0, 0.5, 0.1), (1, 0.5, 3.0, 0.2)], "k int, start_sec double, end_sec double, cut_confidence double")
    assert engine.op("merge_runts")(df, keys=["k"], min_len=1.0).count() == 1
    assert {"fixed_windows", "feature_table", "mann_whitney", "link_tracks", "interpolate", "video_summary"} <= set(engine.operators())
    with pytest.raises(KeyError, match="no operator"):
        engine.op("nothing")
