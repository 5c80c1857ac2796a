"""Keypoint, segment and annotation views over the driver tables, in Spark and as DuckDB CTEs.

A 64-float embedding is read as one frame of a recording: its label is the recording, its place
among the label's vectors the frame; floats 0..33 are 17 points and floats 34..50 their scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .registry import table

#: The 17 keypoints in file order.
COCO = ["nose", "left_eye", "right_eye", "left_ear", "right_ear", "left_shoulder", "right_shoulder", "left_elbow", "right_elbow", "left_wrist", "right_wrist", "left_hip", "right_hip", "left_knee", "right_knee", "left_ankle", "right_ankle"]
#: The 18 parts of the long pose table, in order.
PARTS = ["Nose", "Neck", "RShoulder", "RElbow", "RWrist", "LShoulder", "LElbow", "LWrist", "RHip", "RKnee", "RAnkle", "LHip", "LKnee", "LAnkle", "REye", "LEye", "REar", "LEar"]


def part_of(name: str) -> str:
    """left_knee -> LKnee, nose -> Nose."""
    side, _, part = name.rpartition("_")
    return (side[:1].upper() if side else "") + part.capitalize()


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video, frame, e (floats as doubles), fps, pixel_x, pixel_y."""
    table(spark, sf_dir, "embeddings").createOrReplaceTempView("loom_embeddings")
    return spark.sql("""
        SELECT label AS video, cast(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS int) AS frame,
               transform(embedding, v -> cast(v AS double)) AS e, cast(25 + label % 3 * 5 AS int) AS fps, 640D AS pixel_x, 360D AS pixel_y
        FROM loom_embeddings""")


def pose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video, frame, kp, x, y, score, fps, pixel_x, pixel_y: one row a point."""
    return frames(spark, sf_dir).selectExpr("*", "array_max(transform(slice(e, 35, 17), v -> abs(v))) AS top", "explode(sequence(0, 16)) AS kp").selectExpr(
        "video", "frame", "kp", "e[2 * kp] * 100 + 320 AS x", "e[2 * kp + 1] * 100 + 180 AS y", "abs(e[34 + kp]) / top AS score", "fps", "pixel_x", "pixel_y"
    )


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video, frame, person (0: the frame's own points, 1: the next frame's), kp, x, y, score."""
    own = pose(spark, sf_dir)
    shifted = own.where("frame > 0").selectExpr("video", "frame - 1 AS frame", "1 AS person", "kp", "x", "y", "score")
    return own.selectExpr("video", "frame", "0 AS person", "kp", "x", "y", "score").unionByName(shifted)


CTE_FRAMES = """frames AS (
  SELECT label AS video, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::INT AS frame,
         list_transform(embedding, lambda v: v::DOUBLE) AS e, (25 + label % 3 * 5)::INT AS fps, 640::DOUBLE AS pixel_x, 360::DOUBLE AS pixel_y
  FROM embeddings)"""
CTE_POSE = (
    CTE_FRAMES
    + """, pose AS (
  SELECT video, frame, kp, e[2*kp+1]*100+320 AS x, e[2*kp+2]*100+180 AS y, abs(e[35+kp]) / list_max(list_transform(e[35:51], lambda v: abs(v))) AS score, fps, pixel_x, pixel_y
  FROM (SELECT *, unnest(range(0, 17))::INT AS kp FROM frames))"""
)
CTE_PERSONS = (
    CTE_POSE
    + """, persons AS (
  SELECT video, frame, 0 AS person, kp, x, y, score FROM pose
  UNION ALL SELECT video, frame - 1, 1, kp, x, y, score FROM pose WHERE frame > 0)"""
)
_NAMES = ", ".join(f"({i}, '{part_of(n)}')" for i, n in enumerate(COCO))
#: The long pose table with low scores masked, the neck made up, on the dense grid of parts.
CTE_LONG = (
    CTE_POSE
    + f""", names(kp, bp) AS (VALUES {_NAMES}),
masked AS (SELECT video, frame, bp, CASE WHEN score >= 0.3 THEN x END AS x, CASE WHEN score >= 0.3 THEN y END AS y FROM pose JOIN names USING (kp)),
necks AS (SELECT video, frame, 'Neck' AS bp,
    (max(CASE WHEN bp = 'LShoulder' THEN x END) + max(CASE WHEN bp = 'RShoulder' THEN x END)) / 2 AS x,
    (max(CASE WHEN bp = 'LShoulder' THEN y END) + max(CASE WHEN bp = 'RShoulder' THEN y END)) / 2 AS y FROM masked GROUP BY 1, 2),
long_pose AS (SELECT m.*, fps, pixel_x, pixel_y FROM (SELECT * FROM masked UNION ALL SELECT * FROM necks) m JOIN frames f USING (video, frame))"""
)
