"""Queries of the keypoint-to-feature operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cohort as H
from ..operators import pose as P
from ..operators import sequences as S
from . import fixtures as X
from .registry import query
from .shared import materialise


def sql_interpolate(src: str, dst: str, cols: list[str], keys: str, order: str) -> str:
    """DuckDB CTE: line between neighbours by position, trailing values held."""
    held = ", ".join(f"last_value({c} IGNORE NULLS) OVER a AS {c}_a, last_value(CASE WHEN {c} IS NOT NULL THEN {order} END IGNORE NULLS) OVER a AS {c}_i, first_value({c} IGNORE NULLS) OVER b AS {c}_b, first_value(CASE WHEN {c} IS NOT NULL THEN {order} END IGNORE NULLS) OVER b AS {c}_j" for c in cols)
    lines = ", ".join(f"CASE WHEN {c} IS NOT NULL THEN {c} WHEN {c}_b IS NULL THEN {c}_a ELSE {c}_a + ({c}_b - {c}_a) * ({order} - {c}_i) / nullif({c}_j - {c}_i, 0) END AS {c}" for c in cols)
    window = f"WINDOW a AS (PARTITION BY {keys} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY {keys} ORDER BY {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    return f"{dst} AS (SELECT * REPLACE ({lines}) FROM (SELECT *, {held} FROM {src} {window}))"


def sql_rolling(src: str, dst: str, cols: list[str], keys: str, order: str, width: str, how: str, centered: bool = True) -> str:
    frame = "0.500000001 PRECEDING AND 0.499999999 FOLLOWING" if centered else "0.999999999 PRECEDING AND CURRENT ROW"
    vals = ", ".join(f"CASE WHEN count({c}) OVER w = {width} THEN {how}({c}) OVER w END AS {c}" for c in cols)
    return f"{dst} AS (SELECT * REPLACE ({vals}) FROM {src} WINDOW w AS (PARTITION BY {keys} ORDER BY {order} / {width}::DOUBLE RANGE BETWEEN {frame}))"


GRID = f"""parts(part_idx, bp) AS (VALUES {", ".join(f"({i}, '{p}')" for i, p in enumerate(X.PARTS))}),
grid AS (SELECT g.video, g.frame, part_idx, bp, x, y, g.fps, g.pixel_x, g.pixel_y
  FROM (SELECT video, frame, fps, pixel_x, pixel_y FROM frames) g CROSS JOIN parts LEFT JOIN long_pose USING (video, frame, bp))"""
NORMAL = "normal AS (SELECT * REPLACE ((x - pixel_x / 2) / pixel_y AS x, (y - pixel_y / 2) / pixel_y AS y), floor(fps * 0.5)::INT AS w, floor(fps * 0.25)::INT AS wd FROM grid)"
SMOOTH = ", ".join(
    [
        X.CTE_LONG,
        GRID,
        NORMAL,
        sql_interpolate("normal", "filled", ["x", "y"], "video, bp", "frame"),
        sql_rolling("filled", "meds", ["x", "y"], "video, bp", "frame", "w", "median"),
        sql_rolling("meds", "smooth", ["x", "y"], "video, bp", "frame", "w", "avg"),
    ]
)
_AT = lambda bp, c: f"max(CASE WHEN bp = '{bp}' THEN {c} END)"
REFS = f"""refs AS (SELECT video, frame,
  atan2({_AT("RShoulder", "y")} - {_AT("LShoulder", "y")}, {_AT("RShoulder", "x")} - {_AT("LShoulder", "x")}) AS angle_u,
  atan2({_AT("RHip", "y")} - {_AT("LHip", "y")}, {_AT("RHip", "x")} - {_AT("LHip", "x")}) AS angle_l,
  ({_AT("LShoulder", "x")} + {_AT("RShoulder", "x")}) / 2 AS ref_ux, ({_AT("LShoulder", "y")} + {_AT("RShoulder", "y")}) / 2 AS ref_uy,
  ({_AT("LHip", "x")} + {_AT("RHip", "x")}) / 2 AS ref_lx, ({_AT("LHip", "y")} + {_AT("RHip", "y")}) / 2 AS ref_ly FROM smooth GROUP BY 1, 2),
trunks AS (SELECT *, sqrt((ref_ux - ref_lx) ** 2 + (ref_uy - ref_ly) ** 2) AS trunk FROM refs)"""


def sql_fold(a: str) -> str:
    """The three sequential foldings in one expression."""
    first = f"(CASE WHEN {a} < 0 THEN 2 * pi() + {a} ELSE {a} END)"
    second = f"(CASE WHEN {first} < pi() THEN pi() - {first} ELSE {first} END)"
    return f"(CASE WHEN {second} > pi() AND {second} < 2 * pi() THEN 3 * pi() - {second} ELSE {second} END)"


ROTATED = f"""turned AS (SELECT s.video, s.frame, bp, s.fps, s.wd, upper, s.x - CASE WHEN upper = 1 THEN ref_ux ELSE ref_lx END AS dx, s.y - CASE WHEN upper = 1 THEN ref_uy ELSE ref_ly END AS dy, {sql_fold("(CASE WHEN upper = 1 THEN angle_u ELSE angle_l END)")} AS a, nullif(trunk, 0) AS trunk
  FROM (SELECT *, CASE WHEN bp IN ('Nose', 'Neck') OR substr(bp, 2) IN ('Shoulder', 'Elbow', 'Wrist', 'Eye', 'Ear') THEN 1 ELSE 0 END AS upper FROM smooth) s JOIN trunks USING (video, frame)),
rotated AS (SELECT video, frame, bp, fps, wd, upper, (cos(a) * dx - sin(a) * dy) / trunk AS x, (sin(a) * dx + cos(a) * dy) / trunk + 1 - upper AS y FROM turned)"""


def sql_delta(c: str) -> str:
    return f"CASE WHEN row_number() OVER o = 1 THEN {c} * 0 ELSE {c} - lag({c}) OVER o END"


ORDER = "WINDOW o AS (PARTITION BY video, bp ORDER BY frame)"
DYNAMICS = ", ".join(
    [
        ROTATED,
        f"d1 AS (SELECT *, ({sql_delta('x')}) AS d_x, ({sql_delta('y')}) AS d_y FROM rotated {ORDER})",
        "d2 AS (SELECT *, d_x / (1.0::DOUBLE / fps) AS velocity_x, d_y / (1.0::DOUBLE / fps) AS velocity_y, sqrt(d_x ** 2 + d_y ** 2) / (1.0::DOUBLE / fps) AS speed FROM d1)",
        sql_interpolate("d2", "d3", ["velocity_x", "velocity_y", "speed"], "video, bp", "frame"),
        sql_rolling("d3", "d4", ["velocity_x", "velocity_y", "speed"], "video, bp", "frame", "wd", "avg", False),
        f"d5 AS (SELECT *, ({sql_delta('velocity_x')}) / (1.0::DOUBLE / fps) AS acceleration_x, ({sql_delta('velocity_y')}) / (1.0::DOUBLE / fps) AS acceleration_y FROM d4 {ORDER})",
        sql_interpolate("d5", "d6", ["acceleration_x", "acceleration_y"], "video, bp", "frame"),
        sql_rolling("d6", "dyn", ["acceleration_x", "acceleration_y"], "video, bp", "frame", "wd", "avg", False),
    ]
)
_TRIPLETS = ", ".join(f"('{j}', '{a}', '{b}', '{c}')" for j, a, b, c in P.JOINTS)
ANGLES = f"""joints(bp, pa, pb, pc) AS (VALUES {_TRIPLETS}), spots AS (SELECT video, frame, fps, bp, x, y FROM smooth WHERE x IS NOT NULL AND y IS NOT NULL),
raw_angles AS (SELECT a.video, a.frame, a.fps, j.bp, atan2((b.x-a.x)*(c.y-a.y)-(b.y-a.y)*(c.x-a.x), (b.x-a.x)*(c.x-a.x)+(b.y-a.y)*(c.y-a.y)) * 180 / pi() * CASE WHEN j.bp IN ('LShoulder', 'LHip') THEN -1 ELSE 1 END AS r
  FROM joints j JOIN spots a ON a.bp = pa JOIN spots b ON b.bp = pb AND b.video = a.video AND b.frame = a.frame JOIN spots c ON c.bp = pc AND c.video = a.video AND c.frame = a.frame),
angles AS (SELECT video, frame, fps, bp, CASE WHEN substr(bp, 2) IN ('Elbow', 'Knee') THEN abs(r) WHEN r < 0 THEN r + 360 ELSE r END AS angle FROM raw_angles)"""
ANGLE_DYNAMICS = ", ".join(
    [
        ANGLES,
        "e0 AS (SELECT *, angle - lag(angle) OVER o AS d, row_number() OVER o - 1 AS n, floor(fps * 0.25)::INT AS wd FROM angles WINDOW o AS (PARTITION BY video, bp ORDER BY frame))",
        "e1 AS (SELECT video, bp, n AS frame, fps, wd, angle, CASE WHEN n = 0 THEN 0 WHEN abs(d) <= abs(d + 360) AND abs(d) <= abs(d - 360) THEN d WHEN abs(d + 360) <= abs(d - 360) THEN d + 360 ELSE d - 360 END / (1.0::DOUBLE / fps) AS velocity FROM e0)",
        sql_interpolate("e1", "e2", ["velocity"], "video, bp", "frame"),
        sql_rolling("e2", "e3", ["velocity"], "video, bp", "frame", "wd", "avg", False),
        f"e4 AS (SELECT *, ({sql_delta('velocity')}) / (1.0::DOUBLE / fps) AS acceleration FROM e3 {ORDER})",
        sql_interpolate("e4", "e5", ["acceleration"], "video, bp", "frame"),
        sql_rolling("e5", "adyn", ["acceleration"], "video, bp", "frame", "wd", "avg", False),
    ]
)


def r(*cols: str, places: int = 5) -> list[Column]:
    """Columns rounded for comparison; no negative zeros."""
    return [(F.round(F.col(c), places) + 0.0).alias(c) for c in cols]


def rs(*cols: str, places: int = 5) -> str:
    return ", ".join(f"round({c}, {places}) + 0.0 AS {c}" for c in cols)


_INFO = ("fps", "pixel_x", "pixel_y")


def long_pose(spark: SparkSession, d: str) -> DataFrame:
    """Masked, named parts with the neck, and the recording's settings."""
    return P.with_neck(P.name_parts(P.mask_low_score(X.pose(spark, d)), X.COCO, X.part_of), _INFO)


def grid(spark: SparkSession, d: str) -> DataFrame:
    return P.dense_grid(long_pose(spark, d), X.PARTS, _INFO)


def smooth(spark: SparkSession, d: str) -> DataFrame:
    return P.smooth_pose(P.normalise_frame(grid(spark, d)))


def stored_rows(spark: SparkSession, d: str) -> DataFrame:
    """Frame rows of the smoothed pose, written once for all that is derived from them."""
    return materialise(P.frame_rows(smooth(spark, d).select("video", "frame", "bp", "x", "y", "fps")), "frame-rows")


def dynamics(spark: SparkSession, d: str) -> DataFrame:
    return P.dynamics_xy(P.rotate_scale_skeleton(smooth(spark, d).drop("w", "part_idx", "pixel_x", "pixel_y")))


def angle_dynamics(spark: SparkSession, d: str) -> DataFrame:
    return P.dynamics_angle(P.joint_angles(smooth(spark, d).select("video", "frame", "bp", "x", "y", "fps")))


@query("mask_low_score", f"WITH {X.CTE_POSE} SELECT video, frame, kp, round(CASE WHEN score >= 0.3 THEN x END, 5) AS x, round(CASE WHEN score >= 0.3 THEN y END, 5) AS y FROM pose")
def _mask(spark: SparkSession, d: str) -> DataFrame:
    return P.mask_low_score(X.pose(spark, d)).select("video", "frame", "kp", *[F.round(c, 5).alias(c) for c in ("x", "y")])


@query("zero_to_null", f"WITH {X.CTE_POSE} SELECT video, kp, count(nullif(CASE WHEN frame % 3 = 0 THEN 0.0 ELSE x END, 0)) AS n_x, count(nullif(y, 0)) AS n_y FROM pose GROUP BY 1, 2")
def _zero(spark: SparkSession, d: str) -> DataFrame:
    df = X.pose(spark, d).withColumn("x", F.expr("if(frame % 3 = 0, 0D, x)"))
    return P.zero_to_null(df).groupBy("video", "kp").agg(F.count("x").alias("n_x"), F.count("y").alias("n_y"))


@query("map_keypoint_names", f"WITH {X.CTE_LONG} SELECT kp, bp, count(*) AS n FROM pose JOIN names USING (kp) GROUP BY 1, 2")
def _names(spark: SparkSession, d: str) -> DataFrame:
    return P.name_parts(X.pose(spark, d), X.COCO, X.part_of).groupBy("kp", "bp").agg(F.count("*").alias("n"))


@query("synth_neck", f"WITH {X.CTE_LONG} SELECT video, frame, round(x, 5) AS x, round(y, 5) AS y FROM long_pose WHERE bp = 'Neck'")
def _neck(spark: SparkSession, d: str) -> DataFrame:
    return long_pose(spark, d).where("bp = 'Neck'").select("video", "frame", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


@query(
    "pick_instance",
    f"WITH {X.CTE_PERSONS} SELECT video, frame, person, n_conf, round(mean_score, 6) AS mean_score FROM (SELECT video, frame, person, count_if(score >= 0.3)::BIGINT AS n_conf, avg(score) AS mean_score FROM persons GROUP BY ALL) WHERE n_conf > 0 QUALIFY row_number() OVER (PARTITION BY video, frame ORDER BY n_conf DESC, mean_score DESC, person DESC) = 1",
)
def _pick(spark: SparkSession, d: str) -> DataFrame:
    return P.pick_instance(X.persons(spark, d)).withColumn("mean_score", F.round("mean_score", 6))


@query(
    "pick_person_legacy",
    f"WITH {X.CTE_PERSONS} SELECT video, frame, person, n_points FROM (SELECT video, frame, person, count(CASE WHEN score >= 0.3 THEN x END) AS n_points FROM persons GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY video, frame ORDER BY n_points DESC, person) = 1",
)
def _pick_legacy(spark: SparkSession, d: str) -> DataFrame:
    return P.pick_person_legacy(P.mask_low_score(X.persons(spark, d)))


@query(
    "join_best_person_semi",
    f"WITH {X.CTE_PERSONS}, best AS (SELECT video, frame, person FROM (SELECT video, frame, person, count(CASE WHEN score >= 0.3 THEN x END) AS n FROM persons GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY video, frame ORDER BY n DESC, person) = 1) SELECT video, frame, person, kp, round(x, 5) AS x FROM persons SEMI JOIN best USING (video, frame, person)",
)
def _semi(spark: SparkSession, d: str) -> DataFrame:
    people = X.persons(spark, d)
    best = P.pick_person_legacy(P.mask_low_score(people))
    return people.join(best, ["video", "frame", "person"], "left_semi").select("video", "frame", "person", "kp", F.round("x", 5).alias("x"))


@query("normalise_frame", f"WITH {X.CTE_POSE} SELECT video, frame, kp, {rs('x', 'y')} FROM (SELECT video, frame, kp, (x - pixel_x / 2) / pixel_y AS x, (y - pixel_y / 2) / pixel_y AS y FROM pose)")
def _normalise(spark: SparkSession, d: str) -> DataFrame:
    return P.normalise_frame(X.pose(spark, d)).select("video", "frame", "kp", *r("x", "y"))


_COUNTS = "SELECT video, bp, part_idx, count(*) AS n_rows, count(x) AS n_x FROM grid GROUP BY ALL"


@query("dense_grid", f"WITH {X.CTE_LONG}, {GRID} {_COUNTS}")
def _grid(spark: SparkSession, d: str) -> DataFrame:
    return grid(spark, d).groupBy("video", "bp", "part_idx").agg(F.count("*").alias("n_rows"), F.count("x").alias("n_x"))


@query("join_dense_grid", f"WITH {X.CTE_LONG}, {GRID} SELECT video, frame, bp, round(x, 4) AS x, round(y, 4) AS y FROM grid")
def _grid_data(spark: SparkSession, d: str) -> DataFrame:
    return grid(spark, d).select("video", "frame", "bp", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("join_video_info", f"WITH {X.CTE_FRAMES}, info AS (SELECT DISTINCT video, fps, pixel_x, pixel_y FROM frames WHERE video % 4 <> 3) SELECT f.video, count(*) AS n, max(info.fps) AS fps FROM frames f LEFT JOIN info USING (video) GROUP BY 1")
def _info(spark: SparkSession, d: str) -> DataFrame:
    f = X.frames(spark, d)
    info = f.where("video % 4 <> 3").select("video", "fps").distinct()
    return f.select("video").join(info, "video", "left").groupBy("video").agg(F.count("*").alias("n"), F.max("fps").alias("fps"))


@query("join_part_idx", f"WITH {X.CTE_LONG}, {GRID} SELECT bp, part_idx, count(*) AS n FROM long_pose JOIN parts USING (bp) GROUP BY ALL")
def _part_idx(spark: SparkSession, d: str) -> DataFrame:
    # 18 parts: a dimension of fixed size.
    parts = spark.createDataFrame(list(enumerate(X.PARTS)), "part_idx int, bp string")
    return long_pose(spark, d).join(F.broadcast(parts), "bp").groupBy("bp", "part_idx").agg(F.count("*").alias("n"))


@query("interp_linear_fwd", f"WITH {X.CTE_LONG}, {GRID}, {NORMAL}, {sql_interpolate('normal', 'filled', ['x', 'y'], 'video, bp', 'frame')} SELECT video, frame, bp, {rs('x', 'y')} FROM filled")
def _interp(spark: SparkSession, d: str) -> DataFrame:
    return S.interpolate(P.normalise_frame(grid(spark, d)), ["x", "y"], ["video", "bp"], "frame").select("video", "frame", "bp", *r("x", "y"))


_GAP = "CASE WHEN x IS NOT NULL THEN x WHEN j - i - 1 <= 3 THEN a + (b - a) * (frame - i) / (j - i) END"


@query(
    "interp_gap_limited",
    f"""WITH {X.CTE_LONG}, {GRID}, n AS (SELECT *, last_value(x IGNORE NULLS) OVER p AS a, last_value(CASE WHEN x IS NOT NULL THEN frame END IGNORE NULLS) OVER p AS i, first_value(x IGNORE NULLS) OVER q AS b, first_value(CASE WHEN x IS NOT NULL THEN frame END IGNORE NULLS) OVER q AS j FROM grid
      WINDOW p AS (PARTITION BY video, bp ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), q AS (PARTITION BY video, bp ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT video, frame, bp, round({_GAP}, 4) AS x FROM n""",
)
def _gap(spark: SparkSession, d: str) -> DataFrame:
    return S.interpolate(grid(spark, d), ["x"], ["video", "bp"], "frame", max_gap=3).select("video", "frame", "bp", F.round("x", 4).alias("x"))


@query("roll_med_centered", f"WITH {X.CTE_LONG}, {GRID}, {NORMAL}, {sql_interpolate('normal', 'filled', ['x', 'y'], 'video, bp', 'frame')}, {sql_rolling('filled', 'meds', ['x', 'y'], 'video, bp', 'frame', 'w', 'median')} SELECT video, frame, bp, {rs('x')} FROM meds")
def _med(spark: SparkSession, d: str) -> DataFrame:
    df = S.interpolate(P.normalise_frame(grid(spark, d)), ["x"], ["video", "bp"], "frame").withColumn("w", F.floor(F.col("fps") * 0.5).cast("int"))
    return S.rolling_centered(df, {"x": "x"}, ["video", "bp"], "frame", "w", "median").select("video", "frame", "bp", *r("x"))


@query("roll_mean_centered", f"WITH {SMOOTH} SELECT video, frame, bp, {rs('x', 'y')} FROM smooth")
def _smooth(spark: SparkSession, d: str) -> DataFrame:
    return smooth(spark, d).select("video", "frame", "bp", *r("x", "y"))


@query("roll_mean_trailing", f"WITH {X.CTE_LONG}, {GRID}, {NORMAL}, {sql_interpolate('normal', 'filled', ['x', 'y'], 'video, bp', 'frame')}, {sql_rolling('filled', 'tr', ['x', 'y'], 'video, bp', 'frame', 'wd', 'avg', False)} SELECT video, frame, bp, {rs('x')} FROM tr")
def _trailing(spark: SparkSession, d: str) -> DataFrame:
    df = S.interpolate(P.normalise_frame(grid(spark, d)), ["x"], ["video", "bp"], "frame").withColumn("wd", F.floor(F.col("fps") * 0.25).cast("int"))
    return S.rolling_trailing(df, {"x": "x"}, ["video", "bp"], "frame", "wd").select("video", "frame", "bp", *r("x"))


@query("delta_first_zero", f"WITH {SMOOTH} SELECT video, frame, bp, {rs('d_x')} FROM (SELECT *, {sql_delta('x')} AS d_x FROM smooth {ORDER})")
def _delta(spark: SparkSession, d: str) -> DataFrame:
    return smooth(spark, d).withColumn("d_x", S.delta("x", ["video", "bp"], "frame")).select("video", "frame", "bp", *r("d_x"))


@query("line_angle", f"WITH {SMOOTH}, {REFS} SELECT video, frame, {rs('angle_u', 'angle_l')} FROM trunks")
def _line(spark: SparkSession, d: str) -> DataFrame:
    return P.skeleton_refs(smooth(spark, d)).select("video", "frame", *r("angle_u", "angle_l"))


@query("center_joints", f"WITH {SMOOTH}, {REFS} SELECT video, frame, {rs('ref_ux', 'ref_uy', 'ref_lx', 'ref_ly')} FROM trunks")
def _center(spark: SparkSession, d: str) -> DataFrame:
    return P.skeleton_refs(smooth(spark, d)).select("video", "frame", *r("ref_ux", "ref_uy", "ref_lx", "ref_ly"))


@query("join_skeleton_refs", f"WITH {SMOOTH}, {REFS} SELECT s.video, s.frame, s.bp, {rs('trunk')} FROM smooth s JOIN trunks USING (video, frame)")
def _refs(spark: SparkSession, d: str) -> DataFrame:
    s = smooth(spark, d)
    return s.join(P.skeleton_refs(s), ["video", "frame"]).select("video", "frame", "bp", *r("trunk"))


@query("ref_angle_fold", f"WITH {SMOOTH}, {REFS} SELECT video, frame, round({sql_fold('angle_u')}, 5) AS folded FROM trunks")
def _fold(spark: SparkSession, d: str) -> DataFrame:
    return P.skeleton_refs(smooth(spark, d)).select("video", "frame", F.round(P.folded(F.col("angle_u")), 5).alias("folded"))


@query("upper_flag", f"WITH {SMOOTH}, {REFS}, {ROTATED} SELECT bp, max(upper) AS upper FROM rotated GROUP BY bp")
def _upper(spark: SparkSession, d: str) -> DataFrame:
    return P.rotate_scale_skeleton(smooth(spark, d)).groupBy("bp").agg(F.max("upper").alias("upper"))


@query("rotate_scale_skeleton", f"WITH {SMOOTH}, {REFS}, {ROTATED} SELECT video, frame, bp, {rs('x', 'y', places=4)} FROM rotated")
def _rotate(spark: SparkSession, d: str) -> DataFrame:
    return P.rotate_scale_skeleton(smooth(spark, d)).select("video", "frame", "bp", *r("x", "y", places=4))


@query("side_part_split", f"WITH {X.CTE_LONG}, {GRID} SELECT bp, substr(bp, 1, 1) AS side, substr(bp, 2) AS part FROM parts")
def _side(spark: SparkSession, d: str) -> DataFrame:
    return grid(spark, d).select("bp").distinct().select("bp", F.substring("bp", 1, 1).alias("side"), F.substring("bp", 2, 50).alias("part"))


@query("drop_null_x", f"WITH {SMOOTH} SELECT video, bp, count(*) AS n FROM smooth WHERE x IS NOT NULL GROUP BY 1, 2")
def _drop(spark: SparkSession, d: str) -> DataFrame:
    return smooth(spark, d).where("x IS NOT NULL").groupBy("video", "bp").agg(F.count("*").alias("n"))


@query("delta_t", f"WITH {X.CTE_FRAMES} SELECT DISTINCT video, round(1.0::DOUBLE / fps, 6) AS delta_t FROM frames")
def _dt(spark: SparkSession, d: str) -> DataFrame:
    return X.frames(spark, d).select("video", F.round(1 / F.col("fps"), 6).alias("delta_t")).distinct()


@query("joint_angle_signed", f"WITH {SMOOTH}, {ANGLES} SELECT video, frame, bp, {rs('angle', places=4)} FROM angles")
def _angles(spark: SparkSession, d: str) -> DataFrame:
    return P.joint_angles(smooth(spark, d)).select("video", "frame", "bp", *r("angle", places=4))


@query("join_angle_triplets", f"WITH {SMOOTH}, {ANGLES} SELECT bp, count(*) AS n, count(DISTINCT video) AS n_videos, min(frame)::INT AS first_frame FROM raw_angles GROUP BY 1")
def _triplets(spark: SparkSession, d: str) -> DataFrame:
    j = P.joint_angles(smooth(spark, d))
    return j.groupBy("bp").agg(F.count("*").alias("n"), F.countDistinct("video").alias("n_videos"), F.min("frame").cast("int").alias("first_frame"))


@query("angle_delta_shortest", f"WITH {SMOOTH}, {ANGLE_DYNAMICS} SELECT video, bp, frame::INT AS frame, round(velocity / fps, 4) + 0.0 AS displacement FROM e1")
def _turn(spark: SparkSession, d: str) -> DataFrame:
    return angle_dynamics(spark, d).select("video", "bp", F.col("frame").cast("int").alias("frame"), *r("displacement", places=4))


@query("velocity_chain", f"WITH {SMOOTH}, {REFS}, {DYNAMICS} SELECT video, frame, bp, {rs('velocity_x', 'velocity_y', 'speed', 'acceleration_x', 'acceleration_y', places=3)} FROM dyn")
def _velocity(spark: SparkSession, d: str) -> DataFrame:
    return dynamics(spark, d).select("video", "frame", "bp", *r("velocity_x", "velocity_y", "speed", "acceleration_x", "acceleration_y", places=3))


_IQR = lambda c: f"quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"


def sql_entropy(src: str, c: str, places: int, out: str) -> str:
    return f"{out} AS (SELECT video, bp, entropy(round_even({c} * {10**places}, 0) + 0.0) * ln(2) AS e FROM {src} WHERE {c} IS NOT NULL GROUP BY 1, 2)"


FEATURES_XY = f"""own AS (SELECT * FROM dyn WHERE substr(bp, 2) IN ('Ankle', 'Wrist')), {sql_entropy("own", "x", 2, "ex")}, {sql_entropy("own", "y", 2, "ey")},
fxy AS (SELECT video, bp, median(x) AS medianx, median(y) AS mediany, {_IQR("x")} AS IQRx, {_IQR("y")} AS IQRy, median(abs(velocity_x)) AS medianvelx, median(abs(velocity_y)) AS medianvely,
  {_IQR("velocity_x")} AS IQRvelx, {_IQR("velocity_y")} AS IQRvely, {_IQR("acceleration_x")} AS IQRaccx, {_IQR("acceleration_y")} AS IQRaccy, (any_value(ex.e) + any_value(ey.e)) / 2 AS meanent
  FROM own LEFT JOIN ex USING (video, bp) LEFT JOIN ey USING (video, bp) GROUP BY 1, 2)"""
FEATURES_ANGLE = f"""{sql_entropy("adyn", "angle", 0, "ea")}, fangle AS (SELECT video, bp, degrees(atan2(avg(sin(radians(angle))), avg(cos(radians(angle))))) AS mean_angle,
  sqrt(degrees(1 - sqrt(avg(sin(radians(angle))) ** 2 + avg(cos(radians(angle))) ** 2))) AS stdev_angle, any_value(ea.e) AS entropy_angle, median(abs(velocity)) AS median_vel_angle, {_IQR("velocity")} AS IQR_vel_angle, {_IQR("acceleration")} AS IQR_acc_angle
  FROM adyn LEFT JOIN ea USING (video, bp) GROUP BY 1, 2)"""
XY, ANGLE = P.XY, P.ANGLE


def sql_corr(src: str, c: str, dst: str) -> str:
    return f"""{dst}_r AS (SELECT video, substr(bp, 2) AS part, substr(bp, 1, 1) AS side, {c} AS v, row_number() OVER (PARTITION BY video, bp ORDER BY frame) AS rn FROM {src} WHERE substr(bp, 1, 1) IN ('L', 'R')),
{dst} AS (SELECT l.video, l.part, covar_pop(l.v, r.v) / nullif(stddev_pop(l.v) * stddev_pop(r.v), 0) AS c FROM {dst}_r l JOIN {dst}_r r ON l.video = r.video AND l.part = r.part AND l.rn = r.rn AND l.side = 'L' AND r.side = 'R' WHERE l.v IS NOT NULL AND r.v IS NOT NULL GROUP BY 1, 2)"""


@query("agg_median_iqr", f"WITH {SMOOTH}, {REFS}, {DYNAMICS}, {FEATURES_XY} SELECT video, bp, {rs('medianx', 'mediany', 'IQRx', 'IQRy', places=4)} FROM fxy")
def _iqr(spark: SparkSession, d: str) -> DataFrame:
    return P.features_xy(dynamics(spark, d)).select("video", "bp", *r("medianx", "mediany", "IQRx", "IQRy", places=4))


@query("agg_median_abs", f"WITH {SMOOTH}, {REFS}, {DYNAMICS}, {FEATURES_XY} SELECT video, bp, {rs('medianvelx', 'medianvely', places=4)} FROM fxy")
def _median_abs(spark: SparkSession, d: str) -> DataFrame:
    return P.features_xy(dynamics(spark, d)).select("video", "bp", *r("medianvelx", "medianvely", places=4))


@query("agg_entropy", f"WITH {SMOOTH}, {sql_entropy('smooth', 'x', 2, 'en')} SELECT video, bp, round(e, 5) AS entropy_x FROM en")
def _entropy(spark: SparkSession, d: str) -> DataFrame:
    return P.entropy(smooth(spark, d), ["video", "bp"], "x", 2, "entropy_x").withColumn("entropy_x", F.round("entropy_x", 5))


@query("agg_circ_mean", f"WITH {SMOOTH}, {ANGLE_DYNAMICS}, {FEATURES_ANGLE} SELECT video, bp, {rs('mean_angle', places=4)} FROM fangle")
def _circ_mean(spark: SparkSession, d: str) -> DataFrame:
    return P.features_angle(angle_dynamics(spark, d)).select("video", "bp", *r("mean_angle", places=4))


@query("agg_circ_stdev_feature", f"WITH {SMOOTH}, {ANGLE_DYNAMICS}, {FEATURES_ANGLE} SELECT video, bp, {rs('stdev_angle', places=4)} FROM fangle")
def _circ_sd(spark: SparkSession, d: str) -> DataFrame:
    return P.features_angle(angle_dynamics(spark, d)).select("video", "bp", *r("stdev_angle", places=4))


@query("agg_corr_lr", f"WITH {SMOOTH}, {ANGLES}, {sql_corr('angles', 'angle', 'ca')} SELECT video, part, round(c, 5) + 0.0 AS lr FROM ca")
def _corr(spark: SparkSession, d: str) -> DataFrame:
    return P.lr_correlation(P.joint_angles(smooth(spark, d)), "angle", "lr").withColumn("lr", F.round("lr", 5) + 0.0)


@query("pivot_corr", f"WITH {SMOOTH}, {ANGLES}, {sql_corr('angles', 'angle', 'ca')} SELECT video, " + ", ".join(f"round(max(CASE WHEN part = '{p}' THEN c END), 5) + 0.0 AS lrCorr_angle_{p}" for p in ("Elbow", "Knee", "Hip", "Shoulder")) + " FROM ca GROUP BY video")
def _pivot_corr(spark: SparkSession, d: str) -> DataFrame:
    c = P.lr_correlation(P.joint_angles(smooth(spark, d)), "angle", "lrCorr_angle")
    w = P.wide(c, "video", "part", ["lrCorr_angle"], ["Elbow", "Knee", "Hip", "Shoulder"])
    return w.select("video", *r(*w.columns[1:]))


def feature_table(spark: SparkSession, d: str) -> DataFrame:
    """One row a recording: 44 positional, 48 angular and 12 symmetry features."""
    return P.feature_table(stored_rows(spark, d))


def _sql_wide(src: str, key: str, values: list[str], among: list[str], dst: str) -> str:
    return f"{dst} AS (SELECT video, " + ", ".join(f"max(CASE WHEN {key} = '{n}' THEN {v} END) AS {v}_{n}" for v in values for n in among) + f" FROM {src} GROUP BY video)"


_WIDE = ", ".join(
    [
        SMOOTH, REFS, DYNAMICS, FEATURES_XY, ANGLE_DYNAMICS, FEATURES_ANGLE,
        "radial AS (SELECT *, sqrt(x ** 2 + y ** 2) AS radius FROM dyn)", sql_corr("radial", "radius", "cr"), sql_corr("angles", "angle", "ca"),
        "crn AS (SELECT video, part, c AS lrCorr_x FROM cr)", "can AS (SELECT video, part, c AS lrCorr_angle FROM ca)",
        _sql_wide("fxy", "bp", XY, ["LAnkle", "RAnkle", "LWrist", "RWrist"], "wxy"), _sql_wide("fangle", "bp", ANGLE, [j for j, *_ in P.JOINTS], "wangle"),
        _sql_wide("crn", "part", ["lrCorr_x"], ["Ankle", "Ear", "Elbow", "Eye", "Hip", "Knee", "Shoulder", "Wrist"], "wcx"), _sql_wide("can", "part", ["lrCorr_angle"], ["Elbow", "Knee", "Hip", "Shoulder"], "wca"),
    ]
)
_COLUMNS = P.FEATURES
_JOINED = "FROM wxy FULL JOIN wangle USING (video) FULL JOIN wcx USING (video) FULL JOIN wca USING (video)"


@query("feature_table", f"WITH {_WIDE} SELECT video, {rs(*_COLUMNS, places=3)} {_JOINED}")
def _features(spark: SparkSession, d: str) -> DataFrame:
    return feature_table(spark, d).select("video", *r(*_COLUMNS, places=3))


@query("join_features_outer", f"WITH {_WIDE} SELECT video, round(IQRx_LWrist, 3) + 0.0 AS IQRx_LWrist, round(mean_angle_LKnee, 3) + 0.0 AS mean_angle_LKnee, round(lrCorr_x_Ear, 3) + 0.0 AS lrCorr_x_Ear, round(lrCorr_angle_Hip, 3) + 0.0 AS lrCorr_angle_Hip FROM (SELECT video, IQRx_LWrist FROM wxy WHERE video % 4 > 0) FULL JOIN (SELECT video, mean_angle_LKnee FROM wangle WHERE video % 3 > 0) USING (video) FULL JOIN wcx USING (video) FULL JOIN wca USING (video)")
def _features_outer(spark: SparkSession, d: str) -> DataFrame:
    """Feature tables of unequal recordings side by side; what a table lacks is null.  The features are written once and read four times."""
    t = materialise(feature_table(spark, d).select("video", "IQRx_LWrist", "mean_angle_LKnee", "lrCorr_x_Ear", "lrCorr_angle_Hip"), "features")
    tables = [t.where("video % 4 > 0").select("video", "IQRx_LWrist"), t.where("video % 3 > 0").select("video", "mean_angle_LKnee"), t.select("video", "lrCorr_x_Ear"), t.select("video", "lrCorr_angle_Hip")]
    return P.join_features(tables, "video").select("video", *r("IQRx_LWrist", "mean_angle_LKnee", "lrCorr_x_Ear", "lrCorr_angle_Hip", places=3))


def _sided_mean(feature: str) -> str:
    """Mean of both sides of a scored feature, of those there are."""
    part, _, stat = feature.partition("_")
    if stat.startswith("lrCorr"):
        return f"{stat}_{part}"
    left, right = f"{stat}_L{part}", f"{stat}_R{part}"
    return f"coalesce(({left} + {right}) / 2, {left}, {right})"


@query("feature_whitelist", f"WITH {_WIDE}, every AS (SELECT * {_JOINED}), kept AS (SELECT video, {', '.join(f'round({_sided_mean(f)}, 3) + 0.0 AS {f}' for f in H.SCORED_FEATURES)} FROM every) SELECT * FROM kept")
def _whitelist(spark: SparkSession, d: str) -> DataFrame:
    """The 38 scored features of each recording: means of both sides, all others dropped."""
    t = H.whitelist(H.joint_table(feature_table(spark, d), ["video"], P.FEATURES), ["video"])
    return t.select("video", *r(*H.SCORED_FEATURES, places=3))


@query("pivot_features", f"WITH {_WIDE} SELECT video, {rs(*_COLUMNS[:44], places=3)} FROM wxy")
def _pivot_features(spark: SparkSession, d: str) -> DataFrame:
    w = P.wide(P.features_xy(dynamics(spark, d)), "video", "bp", XY, ["LAnkle", "RAnkle", "LWrist", "RWrist"])
    return w.select("video", *r(*_COLUMNS[:44], places=3))


@query("pivot_lr", f"WITH {SMOOTH} SELECT video, frame, round(max(CASE WHEN bp = 'LHip' THEN x END), 5) + 0.0 AS lhip_x, round(max(CASE WHEN bp = 'RHip' THEN x END), 5) + 0.0 AS rhip_x FROM smooth GROUP BY 1, 2")
def _pivot_lr(spark: SparkSession, d: str) -> DataFrame:
    at = lambda bp: F.round(F.max(F.when(F.col("bp") == bp, F.col("x"))), 5) + 0.0
    return smooth(spark, d).groupBy("video", "frame").agg(at("LHip").alias("lhip_x"), at("RHip").alias("rhip_x"))


@query("melt_features", f"WITH {SMOOTH}, {REFS}, {DYNAMICS}, {FEATURES_XY} UNPIVOT (SELECT video, bp, {rs('medianx', 'mediany', 'IQRx', places=3)} FROM fxy) ON medianx, mediany, IQRx INTO NAME feature VALUE val")
def _melt(spark: SparkSession, d: str) -> DataFrame:
    long = P.features_xy(dynamics(spark, d)).select("video", "bp", *r("medianx", "mediany", "IQRx", places=3)).unpivot(["video", "bp"], ["medianx", "mediany", "IQRx"], "feature", "val")
    return long.where("val IS NOT NULL")


@query("agg_longest_by_video", f"WITH {X.CTE_FRAMES} SELECT video, max(frame) AS last_frame, count(*) AS n_frames FROM frames GROUP BY 1")
def _longest(spark: SparkSession, d: str) -> DataFrame:
    return X.frames(spark, d).groupBy("video").agg(F.max("frame").alias("last_frame"), F.count("*").alias("n_frames"))
