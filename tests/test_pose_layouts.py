"""Pose files of all layouts: a layout is looked for once a file, not once a frame."""

import json

import pytest

from motionloom.sources import files as S


def frame(k, **more):
    return {"frame_id": k, "instances": [{"keypoints": [[k, 0.5]], "keypoint_scores": [0.5], "bbox": [[0, 0, 1, 1]], "bbox_score": 0.5}]} | more


def put(root, name, text):
    (root / name).parent.mkdir(parents=True, exist_ok=True)
    (root / name).write_text(text if isinstance(text, str) else json.dumps(text))


def ids(df, video):
    return sorted((r["frame_id"], r["instances"][0]["keypoints"][0][0]) for r in df.where(f"video = '{video}'").collect())


@pytest.mark.parametrize("layout", ["list", "wrapped"])
def test_layout_is_looked_for_below_the_frames(spark, tmp_path, layout):
    frames = [frame(k) for k in range(5)]
    put(tmp_path, "a/pred/x.json", frames if layout == "list" else {"meta_info": {}, "instance_info": frames})
    got = S.scan_pose_json(spark, str(tmp_path))
    assert ids(got, "a") == [(k, k) for k in range(5)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    above = [line for line in plan.split("Generate ")[0].splitlines() if "get_json_object" in line]
    assert "Generate " in plan and not above, above


def test_layouts_beside_each_other(spark, tmp_path):
    put(tmp_path, "list/pred/x.json", "\n\t " + json.dumps([frame(3), frame(4)]))
    put(tmp_path, "wrapped/pred/x.json", {"meta_info": {"n": [1]}, "instance_info": [frame(5), frame(6)]})
    for k, place in ((9, 0), (10, 1), (100, 2)):
        put(tmp_path, f"single/pred/frame_{k}.json", frame(k))
        put(tmp_path, f"nameless/pred/frame_{k}.json", {"instances": frame(k)["instances"]})
    got = S.scan_pose_json(spark, str(tmp_path))
    assert ids(got, "list") == [(3, 3), (4, 4)]
    assert ids(got, "wrapped") == [(5, 5), (6, 6)]
    assert ids(got, "single") == ids(got, "nameless") == [(0, 9), (1, 10), (2, 100)]
    assert dict(got.dtypes)["frame_id"] == "int"


FRAMES = [frame(k, note='a "frame_id", {x}') for k in range(40)]
TURNED = [{"instances": f["instances"], "frame_id": f["frame_id"]} for f in FRAMES]
LARGE = {
    "list": (json.dumps(FRAMES, indent=1), True),
    "wrapped": (json.dumps({"meta_info": {"n": [1]}, "instance_info": FRAMES, "after": {"n": [{}]}}), True),
    "empty people": (json.dumps([f | {"instances": []} for f in FRAMES[1:]] + [frame(41)]), True),
    "id last": (json.dumps(TURNED), False),
    "id first and last": (json.dumps([FRAMES[0], TURNED[1], FRAMES[2]]), False),
    "no id between": (json.dumps([FRAMES[0], {"instances": FRAMES[1]["instances"]}, FRAMES[2]]), False),
    "id inside": (json.dumps([f | {"more": {"frame_id": 7}} for f in FRAMES]), False),
    "id as a value": (json.dumps([f | {"key": "frame_id"} for f in FRAMES]), False),
    "other list": (json.dumps({"other": FRAMES, "instance_info": [{"instances": FRAMES[3]["instances"]}]}), False),
    "two lists": (json.dumps({"instance_info": FRAMES[:3], "other": FRAMES[3:]}), False),
    "ends early": (json.dumps(FRAMES)[:-40], False),
    "middle broken": (json.dumps(FRAMES).replace('"frame_id": 7, "instances": [{', '"frame_id": 7, "instances": [', 1), False),
    "single": (json.dumps(FRAMES[0]), False),
    "single without id": (json.dumps({"instances": FRAMES[0]["instances"]}), False),
    "no frames": ("[]" + " " * 200, False),
    "no json": ("x" * 200, False),
}


@pytest.mark.parametrize("kind", [*LARGE, None])
def test_large_files_give_what_whole_texts_give(spark, tmp_path, monkeypatch, kind):
    """Each large file alone, and all of them in one folder, whose names need escapes in a path."""
    for name, (text, _) in LARGE.items():
        if kind in (name, None):
            put(tmp_path, f"{name} [1]%20/pred/frame_1.json", text)
    rows = lambda: sorted(map(repr, S.scan_pose_json(spark, str(tmp_path)).collect()))
    whole = rows()
    monkeypatch.setattr(S, "CUT", 100)
    assert rows() == whole
    if kind and LARGE[kind][1]:
        assert len(whole) == 40
    _, odd = S._cut(S._texts(spark, str(tmp_path), "*.json", lineSep='"frame_id"'))
    if kind:
        assert len(odd) == (not LARGE[kind][1])


def test_a_large_list_is_many_tasks_work(spark, tmp_path, monkeypatch):
    put(tmp_path, "a/pred/x.json", [frame(k) for k in range(400)])
    monkeypatch.setattr(S, "CUT", 100)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = S.scan_pose_json(spark, str(tmp_path))
        assert got.rdd.getNumPartitions() > 4
        assert ids(got, "a") == [(k, k) for k in range(400)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
