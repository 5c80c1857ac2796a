"""Aggregates of a user's own, and pose files read in pieces."""

import json
import math
import random

import pytest
from pyspark.errors import PySparkException

from motionloom.engine import op, register
from motionloom.operators.user_aggregates import Aggregate, define_aggregate
from motionloom.sources import files as S

SCHEMA = "k string, j double, x double, w double, extra string"


def sample():
    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b", None]), rng.choice([1.0, None, float("nan")]), rng.choice([rng.gauss(1e6, 3), None]), rng.random(), "e") for _ in range(3000)]
    return rows + [("empty", 1.0, None, 1.0, "e"), ("one", 1.0, 5.0, 0.0, "e")]


def plain(rows, f):
    groups = {}
    for k, j, x, w, _ in rows:
        groups.setdefault((k, "NaN" if j is not None and j != j else j), []).append((x, w))
    return {key: f([r for r in v if None not in r]) for key, v in groups.items()}


def sd(rows):
    if not rows:
        return None
    mean = math.fsum(x for x, _ in rows) / len(rows)
    return math.sqrt(math.fsum((x - mean) ** 2 for x, _ in rows) / len(rows))


def found(df):
    return {(r[0], "NaN" if r[1] is not None and r[1] != r[1] else r[1]): r[2] for r in df.collect()}


@pytest.mark.parametrize("parts,most", [(1, 50_000), (13, 50_000), (13, 1)])
def test_aggregate_of_a_frame(spark, parts, most):
    rows = sample()
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    got = op("user_aggregate")(df, ["k", "j"], "population_sd", ["x"], "sd", most=most)
    assert got.columns == ["k", "j", "sd"]
    want = plain(rows, sd)
    have = found(got)
    assert have.keys() == want.keys()
    assert all(have[k] == pytest.approx(v, rel=1e-8) if v is not None else have[k] is None for k, v in want.items())
    assert have[("empty", 1.0)] is None and have[("one", 1.0)] == 0


def test_aggregate_in_sql_and_of_a_user(spark):
    define_aggregate("longest", Aggregate(1, lambda x: [float(x.max()), float(x.min())], lambda a, b: [max(a[0], b[0]), min(a[1], b[1])], lambda s: s[0] - s[1]))
    register(spark)
    rows = sample()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for name, columns, f in (("longest", "x", lambda r: max(x for x, _ in r) - min(x for x, _ in r) if r else None), ("weighted_mean", "x, w", lambda r: (sum(x * w for x, w in r) / sum(w for _, w in r) if sum(w for _, w in r) else None) if r else None)):
        got = spark.sql(f"SELECT * FROM {name}_merged(TABLE(SELECT * FROM {name}_states(TABLE(SELECT k, j, {columns} FROM {{t}}))))", t=df)
        want, have = plain(rows, f), found(got)
        assert have.keys() == want.keys()
        assert all(have[k] == pytest.approx(v, rel=1e-9) if v is not None else have[k] is None for k, v in want.items())
    with pytest.raises(ValueError):
        define_aggregate("longest", Aggregate(1, None, None, None))


def test_aggregate_of_no_rows_and_wrong_names(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert op("user_aggregate")(empty, ["k"], "population_sd", ["x"], "sd").count() == 0
    with pytest.raises(KeyError):
        op("user_aggregate")(empty, ["k"], "no_such", ["x"], "sd")
    with pytest.raises(ValueError):
        op("user_aggregate")(empty, [], "population_sd", ["x"], "sd")


def frames(n):
    return [{"frame_id": k, "instances": [{"keypoints": [[k, p] for p in range(17)], "keypoint_scores": [0.5] * 17, "bbox": [[0, 0, 1, 1]], "bbox_score": 0.9, "name": 'a "} quote'}] * (k % 3)} for k in range(n)]


def same_rows(a, b):
    key = lambda r: (r.video, r.frame_id, r.instances)
    assert sorted(map(key, a.collect()), key=lambda t: t[:2]) == sorted(map(key, b.collect()), key=lambda t: t[:2])


@pytest.mark.parametrize("indent", [None, 1])
@pytest.mark.parametrize("wrap", [False, True])
def test_one_pose_file_is_many_tasks_work(spark, tmp_path, indent, wrap):
    folder = tmp_path / "baby" / "pred"
    folder.mkdir(parents=True)
    body = {"meta_info": {"dataset": "coco"}, "instance_info": frames(400)} if wrap else frames(400)
    (folder / "all.json").write_text(json.dumps(body, indent=indent))
    (tmp_path / "none" / "pred").mkdir(parents=True)
    (tmp_path / "none" / "pred" / "all.json").write_text("[]")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = S.scan_pose_frames(spark, str(tmp_path))
        assert got.rdd.getNumPartitions() > 10
        same_rows(got, S.scan_pose_json(spark, str(tmp_path)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got.count() == 400


@pytest.mark.parametrize("text", ['[{"instances": [], "frame_id": 0}, {"instances": [], "frame_id": 1}]', '[{"frame_id": 0, "instances": [{"keypoints": [[1, 2]', '[{"frame_id": 0, "x": {"frame_id": 3}, "instances": []}]'])
def test_pose_files_that_cannot_be_cut_are_errors(spark, tmp_path, text):
    folder = tmp_path / "baby" / "pred"
    folder.mkdir(parents=True)
    (folder / "all.json").write_text(text)
    with pytest.raises(PySparkException):
        S.scan_pose_frames(spark, str(tmp_path)).collect()
