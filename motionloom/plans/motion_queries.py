"""Queries of the motion and tracking operators, over embeddings read as keypoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import motion as M
from ..operators import pose as P
from ..operators import tracking as K
from ..operators.pose import mask_low_score, pick_instance
from ..operators.sequences import gradient
from . import fixtures as X
from .registry import query, table
from .shared import materialise

_MASKED = X.CTE_POSE + ", m AS (SELECT video, frame, kp, fps, score, CASE WHEN score >= 0.3 THEN x END AS x, CASE WHEN score >= 0.3 THEN y END AS y FROM pose)"


def _grad(c: str, src: str, dst: str, out: str, expr: str | None = None) -> str:
    value = f"CASE WHEN lag(1) OVER o IS NULL THEN (lead({c}) OVER o - {c}) * fps WHEN lead(1) OVER o IS NULL THEN ({c} - lag({c}) OVER o) * fps ELSE (lead({c}) OVER o - lag({c}) OVER o) * fps / 2 END"
    return f"{dst} AS (SELECT *, {(expr or '{}').format(value)} AS {out} FROM {src} WINDOW o AS (PARTITION BY video, kp ORDER BY frame))"


_SPEED = ", ".join([_MASKED.replace("m AS", "m0 AS"), "m AS (SELECT video, frame, kp, fps, score, x, y FROM pose)", _grad("x", "m", "g1", "vx"), _grad("y", "g1", "g2", "vy"), "g3 AS (SELECT *, sqrt(vx**2 + vy**2) AS speed FROM g2)", _grad("speed", "g3", "g4", "accel", "abs({})"), _grad("accel", "g4", "g5", "jerk", "abs({})")])


def _masked(spark: SparkSession, d: str) -> DataFrame:
    return mask_low_score(X.pose(spark, d))


def _speed(spark: SparkSession, d: str) -> DataFrame:
    return M.speed(X.pose(spark, d), 1 / F.col("fps"))


def _r(df: DataFrame, *cols: str, places: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, places) + 0.0 for c in cols})


@query("gradient_central", f"WITH {_SPEED} SELECT video, frame, kp, round(vx, 3) + 0.0 AS vx FROM g1")
def _gradient(spark: SparkSession, d: str) -> DataFrame:
    df = X.pose(spark, d)
    return _r(df.select("video", "frame", "kp", gradient("x", 1 / F.col("fps"), ["video", "kp"], "frame").alias("vx")), "vx", places=3)


_S5 = "round(avg(speed), 2) AS speed_mean, round(stddev_pop(speed), 2) AS speed_std, round(median(speed), 2) AS speed_median, round(quantile_cont(speed, 0.95), 2) AS speed_p95, round(max(speed), 2) AS speed_max"


@query("agg_stats5", f"WITH {_SPEED} SELECT video, kp, {_S5} FROM g3 GROUP BY 1, 2")
def _stats(spark: SparkSession, d: str) -> DataFrame:
    return _r(_speed(spark, d).groupBy("video", "kp").agg(*M.stats5("speed", "speed")), *[f"speed_{s}" for s in ("mean", "std", "median", "p95", "max")], places=2)


@query("agg_frac_moving", f"WITH {_SPEED} SELECT video, round(avg((speed > 1000)::INT), 5) AS frac FROM g3 GROUP BY 1")
def _moving(spark: SparkSession, d: str) -> DataFrame:
    return _r(_speed(spark, d).groupBy("video").agg(F.avg((F.col("speed") > 1000).cast("int")).alias("frac")), "frac", places=5)


@query("agg_path_per_sec", f"WITH {_SPEED} SELECT video, round(sum(speed / fps) / (count(speed) / max(fps)::DOUBLE), 2) AS path FROM g3 GROUP BY 1")
def _path(spark: SparkSession, d: str) -> DataFrame:
    return _r(_speed(spark, d).groupBy("video").agg(F.avg("speed").alias("path")), "path", places=2)


@query("jerk_chain", f"WITH {_SPEED} SELECT video, kp, round(avg(accel), 1) AS accel, round(avg(jerk) / 100, 1) AS jerk FROM g5 GROUP BY 1, 2")
def _jerk(spark: SparkSession, d: str) -> DataFrame:
    return _speed(spark, d).groupBy("video", "kp").agg(F.round(F.avg("accel"), 1).alias("accel"), F.round(F.avg("jerk") / 100, 1).alias("jerk"))


_AT = lambda k, c: f"max(CASE WHEN kp = {k} THEN {c} END)"


@query("agg_trunk_scale", f"WITH {_MASKED}, t AS (SELECT video, frame, " + ", ".join(f"({_AT(5, c)} + {_AT(6, c)}) / 2 - ({_AT(11, c)} + {_AT(12, c)}) / 2 AS {c}" for c in "xy") + " FROM m GROUP BY 1, 2) SELECT video, round(median(sqrt(x**2 + y**2)), 4) AS scale FROM t GROUP BY 1")
def _trunk(spark: SparkSession, d: str) -> DataFrame:
    return _r(M.trunk_scale(_masked(spark, d)), "scale")


@query("joint_angle_unsigned", f"WITH {_MASKED}, t AS (SELECT video, frame, " + ", ".join(f"{_AT(p, c)} - {_AT(7, c)} AS {n}{c}" for n, p in (("u", 5), ("w", 9)) for c in "xy") + " FROM m GROUP BY 1, 2) SELECT video, frame, round(CASE WHEN c IS NOT NULL THEN degrees(acos(greatest(-1, least(1, c)))) END, 3) AS angle FROM (SELECT *, (ux*wx + uy*wy) / nullif(sqrt(ux**2 + uy**2) * sqrt(wx**2 + wy**2), 0) AS c FROM t)")
def _unsigned(spark: SparkSession, d: str) -> DataFrame:
    return _r(M.joint_angle(_masked(spark, d), 5, 7, 9), "angle", places=3)


@query("agg_net_displacement", f"WITH {_MASKED}, c AS (SELECT video, frame, avg(x) AS cx, avg(y) AS cy FROM m GROUP BY 1, 2 HAVING avg(x) IS NOT NULL), e AS (SELECT video, arg_min(cx, frame) AS ax, arg_min(cy, frame) AS ay, arg_max(cx, frame) AS bx, arg_max(cy, frame) AS by_ FROM c GROUP BY 1) SELECT video, round(sqrt((bx-ax)**2 + (by_-ay)**2), 4) AS net FROM e")
def _net(spark: SparkSession, d: str) -> DataFrame:
    return _r(M.net_displacement(_masked(spark, d)), "net")


GROUPS = {"arms": [7, 8, 9, 10], "legs": [13, 14, 15, 16], "limbs": [9, 10, 15, 16]}


@query("agg_group_mean_of_joints", f"WITH {_SPEED}, gr(grp, kp) AS (VALUES " + ", ".join(f"('{g}', {k})" for g, ks in GROUPS.items() for k in ks) + ") SELECT video, frame, grp, round(avg(speed), 2) AS speed FROM g3 JOIN gr USING (kp) GROUP BY 1, 2, 3")
def _groups(spark: SparkSession, d: str) -> DataFrame:
    return _r(M.group_speed(_speed(spark, d), GROUPS), "speed", places=2)


# A frame is tracked if at least nine of its points are good.
_TRACKED = f"{_MASKED}, f AS (SELECT video, frame, count_if(score >= 0.5) >= 9 AS ok, avg(CASE WHEN score > 0 THEN score END) AS score FROM m GROUP BY 1, 2), t AS (SELECT video, count(*) AS n_frames, count_if(ok)::BIGINT AS n_tracked, avg(score) AS mean_score, max(frame) AS last FROM f GROUP BY 1), g AS (SELECT video, max(gap) AS gap, max(frame) AS fin FROM (SELECT video, frame, frame - coalesce(lag(frame) OVER (PARTITION BY video ORDER BY frame), -1) - 1 AS gap FROM f WHERE ok) GROUP BY 1)"


def _tracked(spark: SparkSession, d: str) -> DataFrame:
    return M.tracked_quality(X.pose(spark, d), F.count_if(F.col("score") >= 0.5) >= 9)


@query("agg_tracked_quality", f"WITH {_TRACKED} SELECT video, n_frames, n_tracked, round(n_tracked / n_frames::DOUBLE, 5) AS frac_tracked, round(mean_score, 5) AS mean_score FROM t")
def _quality(spark: SparkSession, d: str) -> DataFrame:
    return _r(_tracked(spark, d), "frac_tracked", "mean_score", places=5).drop("longest_gap")


@query("longest_gap", f"WITH {_TRACKED} SELECT video, greatest(coalesce(gap, 0), last - coalesce(fin, -1))::BIGINT AS longest_gap FROM t LEFT JOIN g USING (video)")
def _longest_gap(spark: SparkSession, d: str) -> DataFrame:
    return _tracked(spark, d).select("video", F.col("longest_gap").cast("long").alias("longest_gap"))


# Savitzky-Golay of degree 2 over 7 values in closed form: the values' weights in the polynomial at place v of
# the window are 1/7 + uv/28 + (u^2-4)(v^2-4)/84, u and v counted from its middle.
_SAVGOL = f"""{_MASKED}, r0 AS (SELECT video, kp, frame, x, sum(CASE WHEN x IS NULL OR px IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY video, kp ORDER BY frame) AS run FROM (SELECT *, lag(x) OVER (PARTITION BY video, kp ORDER BY frame) AS px FROM m)),
r1 AS (SELECT *, row_number() OVER (PARTITION BY video, kp, run ORDER BY frame) - 1 AS p, count(x) OVER (PARTITION BY video, kp, run) AS n FROM r0),
r2 AS (SELECT *, CASE WHEN p < 3 THEN p WHEN p >= n - 3 THEN p - (n - 7) ELSE 3 END AS at FROM r1 WHERE x IS NOT NULL AND n >= 7),
sv AS (SELECT a.video, a.kp, a.frame, sum(b.x * (1/7.0::DOUBLE + (b.p - a.p + a.at - 3) * (a.at - 3) / 28.0::DOUBLE + ((b.p - a.p + a.at - 3)**2 - 4) * ((a.at - 3)**2 - 4) / 84.0::DOUBLE)) AS s FROM r2 a JOIN r1 b ON a.video = b.video AND a.kp = b.kp AND a.run = b.run AND b.p BETWEEN a.p - a.at AND a.p - a.at + 6 GROUP BY 1, 2, 3)"""


@query("savgol_smooth", f"WITH {_SAVGOL} SELECT m.video, m.kp, m.frame, round(coalesce(s, x), 4) + 0.0 AS smooth FROM m LEFT JOIN sv USING (video, kp, frame)")
def _savgol(spark: SparkSession, d: str) -> DataFrame:
    return _r(M.savgol_smooth(_masked(spark, d).select("video", "kp", "frame", "x"), "x", "smooth", ["video", "kp"], "frame"), "smooth").drop("x")


@query("box_smooth", f"WITH {_MASKED}, b AS (SELECT video, kp, frame, coalesce(x, median(x) OVER (PARTITION BY video, kp)) AS v, row_number() OVER (PARTITION BY video, kp ORDER BY frame) AS p, count(*) OVER (PARTITION BY video, kp) AS n FROM m) SELECT a.video, a.kp, a.frame, round(avg(b.v), 4) + 0.0 AS smooth FROM b a CROSS JOIN (SELECT unnest([-2, -1, 0, 1, 2]) AS k) JOIN b ON b.video = a.video AND b.kp = a.kp AND b.p = greatest(1, least(a.n, a.p + k)) GROUP BY 1, 2, 3")
def _box(spark: SparkSession, d: str) -> DataFrame:
    return _r(M.box_smooth(_masked(spark, d).select("video", "kp", "frame", "x"), "x", "smooth", ["video", "kp"], "frame"), "smooth").select("video", "kp", "frame", "smooth")


_SPECTRUM = f"""{X.CTE_POSE}, s AS (SELECT video, kp, row_number() OVER (PARTITION BY video, kp ORDER BY frame) - 1 AS t, x - avg(x) OVER (PARTITION BY video, kp) AS v, fps / 5.0::DOUBLE AS rate, count(*) OVER (PARTITION BY video, kp) AS n FROM pose),
kk AS (SELECT DISTINCT n, unnest(range(0, n // 2 + 1)) AS k FROM s), pw AS (SELECT video, kp, k, any_value(rate) AS rate, any_value(s.n) AS n, sum(v * cos(2 * pi() * k * t / s.n))**2 + sum(v * sin(2 * pi() * k * t / s.n))**2 AS p FROM s JOIN kk ON s.n = kk.n GROUP BY 1, 2, 3),
tot AS (SELECT video, kp, sum(p) AS total, any_value(rate) AS rate, any_value(n) AS n FROM pw GROUP BY 1, 2), own AS (SELECT video, kp, arg_max(k, p) AS k, max(p) AS p FROM pw WHERE k * rate / n BETWEEN 0.1 AND 5 GROUP BY 1, 2)"""


@query("dominant_freq", f"WITH {_SPECTRUM} SELECT video, kp, round(CASE WHEN n >= 2 * rate THEN k * rate / n END, 6) AS freq, round(CASE WHEN n >= 2 * rate THEN p / total END, 6) AS share FROM tot LEFT JOIN own USING (video, kp)")
def _freq(spark: SparkSession, d: str) -> DataFrame:
    s = X.pose(spark, d).select("video", "kp", "frame", "x", (F.col("fps") / 5).alias("rate"))
    return _r(M.dominant_frequency(s, ["video", "kp"], "frame", "x", "rate", low=0.1), "freq", "share", places=6)


def _people(spark: SparkSession, d: str) -> DataFrame:
    return M.track_candidates(X.persons(spark, d))


# The walk as a recursion over the frames that have someone to follow: the person last taken, and the last extent there was.
_CANDIDATES = X.CTE_PERSONS + """, cand AS (SELECT video, frame, person, avg(CASE WHEN score >= 0.3 THEN x END) AS cx, avg(CASE WHEN score >= 0.3 THEN y END) AS cy, sqrt((max(x) - min(x))**2 + (max(y) - min(y))**2) AS span, avg(score) AS ms
  FROM persons GROUP BY 1, 2, 3 HAVING avg(score) >= 0.15 AND count_if(score >= 0.3) >= 4)"""
_CENTROID = f"""WITH RECURSIVE {_CANDIDATES}, steps AS (SELECT *, dense_rank() OVER (PARTITION BY video ORDER BY frame) AS n FROM cand),
walk AS (SELECT video, 1::BIGINT AS n, frame, person, cx, cy, span, true AS taken FROM steps WHERE n = 1 QUALIFY row_number() OVER (PARTITION BY video ORDER BY ms DESC, person) = 1
  UNION ALL SELECT video, n, CASE WHEN ok THEN frame ELSE of END, CASE WHEN ok THEN person ELSE op END, CASE WHEN ok THEN cx ELSE ox END, CASE WHEN ok THEN cy ELSE oy END, CASE WHEN ok THEN coalesce(nullif(span, 0), os) ELSE os END, ok
  FROM (SELECT s.*, w.frame AS of, w.person AS op, w.cx AS ox, w.cy AS oy, w.span AS os, coalesce(sqrt((s.cx - w.cx)**2 + (s.cy - w.cy)**2) <= 0.5 * nullif(w.span, 0), true) AS ok FROM walk w JOIN steps s ON s.video = w.video AND s.n = w.n + 1
    QUALIFY row_number() OVER (PARTITION BY s.video ORDER BY sqrt((s.cx - w.cx)**2 + (s.cy - w.cy)**2), s.person) = 1))
SELECT video, frame, person FROM walk WHERE taken"""


@query("greedy_centroid_track", _CENTROID)
def _centroid(spark: SparkSession, d: str) -> DataFrame:
    return M.greedy_centroid_track(_people(spark, d))


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    return X.persons(spark, d).where("score >= 0.3").groupBy("video", "frame", "person").agg(F.min("x").alias("x1"), F.min("y").alias("y1"), F.max("x").alias("x2"), F.max("y").alias("y2"), F.avg("score").alias("score"))


_BOXES = X.CTE_PERSONS + ", boxes AS (SELECT video, frame, person, min(x) AS x1, min(y) AS y1, max(x) AS x2, max(y) AS y2, avg(score) AS score FROM persons WHERE score >= 0.3 GROUP BY 1, 2, 3)"
_IOU = "greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"
_AREA = lambda t: f"(({t}.x2 - {t}.x1) * ({t}.y2 - {t}.y1))"


def _box_pairs(spark: SparkSession, d: str) -> DataFrame:
    b = _boxes(spark, d)
    a0 = b.where("person = 0").select("video", "frame", *[F.col(c).alias(f"a_{c}") for c in ("x1", "y1", "x2", "y2")])
    return a0.join(b.where("person = 1").select("video", "frame", *[F.col(c).alias(f"b_{c}") for c in ("x1", "y1", "x2", "y2")]), ["video", "frame"])


@query("iou", f"WITH {_BOXES} SELECT a.video, a.frame, round({_IOU} / nullif({_AREA('a')} + {_AREA('b')} - {_IOU}, 0), 5) AS iou FROM boxes a JOIN boxes b ON a.video = b.video AND a.frame = b.frame AND a.person = 0 AND b.person = 1")
def _iou(spark: SparkSession, d: str) -> DataFrame:
    side = lambda n: [F.col(f"{n}_{c}") for c in ("x1", "y1", "x2", "y2")]
    return _box_pairs(spark, d).select("video", "frame", F.round(K.iou(side("a"), side("b")), 5).alias("iou"))


# Boxes of every shape from an embedding's first floats: tall, wide, tiny, every tenth without width.
_SHAPES = "SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS e, vec_id % 10 = 0 AS flat FROM embeddings"
_SHAPE = ", ".join(f"e[{i + 1}] * 20 AS {n}x1, e[{i + 2}] * 20 AS {n}y1, e[{i + 1}] * 20 + CASE WHEN flat THEN 0 ELSE abs(e[{i + 3}]) * 100 END AS {n}x2, e[{i + 2}] * 20 + abs(e[{i + 4}]) * 100 AS {n}y2" for i, n in ((0, "a"), (4, "b")))


@query("weak_match", f"WITH s AS (SELECT vec_id, {_SHAPE} FROM ({_SHAPES})), w AS (SELECT *, ax2-ax1 AS wa, ay2-ay1 AS ha, bx2-bx1 AS wb, by2-by1 AS hb FROM s) SELECT vec_id, CASE WHEN least(wa, ha, wb, hb) <= 0 THEN 0 WHEN greatest(wa*ha, wb*hb) / greatest(1e-6, least(wa*ha, wb*hb)) > 4 THEN 0 WHEN sqrt(((ax1+ax2-bx1-bx2)/2)**2 + ((ay1+ay2-by1-by2)/2)**2) < 0.5 * sqrt(((wa+wb)/2)**2 + ((ha+hb)/2)**2) THEN 0.15::DOUBLE ELSE 0 END AS weak FROM w")
def _weak(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").selectExpr("vec_id", "transform(embedding, v -> cast(v AS double)) AS e", "vec_id % 10 = 0 AS flat")

    def side(i: int) -> list:
        at = lambda k: F.col("e")[i + k]
        return [at(0) * 20, at(1) * 20, at(0) * 20 + F.when(F.col("flat"), 0).otherwise(F.abs(at(2)) * 100), at(1) * 20 + F.abs(at(3)) * 100]

    return e.select("vec_id", K.weak_match(side(0), side(4)).alias("weak"))


@query("bbox_unwrap", "SELECT event_id, event_id::DOUBLE AS x1, event_id + 2.5::DOUBLE AS y2 FROM events")
def _unwrap(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").selectExpr("event_id", "if(event_id % 2 = 0, concat('[[', event_id, ', 1, 2, ', event_id + 2.5D, ']]'), concat('[', event_id, ', 1, 2, ', event_id + 2.5D, ', 9]')) AS box")
    b = e.withColumn("b", K.bbox_unwrap(F.col("box")))
    return b.select("event_id", F.col("b")[0].alias("x1"), F.col("b")[3].alias("y2"))


@query("hypot_dist", f"WITH {_MASKED} SELECT video, frame, round(sqrt(({_AT(5, 'x')} - {_AT(11, 'x')})**2 + ({_AT(5, 'y')} - {_AT(11, 'y')})**2), 4) AS dist FROM m GROUP BY 1, 2")
def _hypot(spark: SparkSession, d: str) -> DataFrame:
    at = lambda k, c: F.max(F.when(F.col("kp") == k, F.col(c)))
    return _masked(spark, d).groupBy("video", "frame").agg(F.round(F.hypot(at(5, "x") - at(11, "x"), at(5, "y") - at(11, "y")), 4).alias("dist"))


@query("mid_nullsafe", f"WITH {_MASKED} SELECT video, frame, round(({_AT(5, 'x')} + {_AT(6, 'x')}) / 2, 4) AS mid_x, round(({_AT(5, 'y')} + {_AT(6, 'y')}) / 2, 4) AS mid_y FROM m GROUP BY 1, 2")
def _middle(spark: SparkSession, d: str) -> DataFrame:
    at = lambda k, c: F.max(F.when(F.col("kp") == k, F.col(c)))
    return _masked(spark, d).groupBy("video", "frame").agg(*[F.round((at(5, c) + at(6, c)) / 2, 4).alias(f"mid_{c}") for c in "xy"])


_D = lambda i, j: f"sqrt((x{i} - x{j})**2 + (y{i} - y{j})**2)"
_TORSO = "sqrt(((x5+x6)/2 - (x11+x12)/2)**2 + ((y5+y6)/2 - (y11+y12)/2)**2)"


def _limb(a: tuple, b: tuple) -> str:
    one, two = (f"({_D(s[0], s[1])} + {_D(s[1], s[2])})" for s in (a, b))
    return f"coalesce(({one} + {two}) / 2, {one}, {two})"


_RATIOS = f"{X.CTE_PERSONS}, pm AS (SELECT video, frame, person, {', '.join(f'max(CASE WHEN kp = {k} AND score >= 0.3 THEN {c} END) AS {c}{k}' for k in range(17) for c in 'xy')} FROM persons GROUP BY 1, 2, 3), rt AS (SELECT video, frame, person, coalesce({_D(3, 4)}, 1.9 * {_D(1, 2)}) / {_TORSO} AS r_head, {_limb((5, 7, 9), (6, 8, 10))} / {_TORSO} AS r_arm, {_limb((11, 13, 15), (12, 14, 16))} / {_TORSO} AS r_leg FROM pm)"


def _ratios(spark: SparkSession, d: str) -> DataFrame:
    return K.body_ratios(mask_low_score(X.persons(spark, d)))


@query("body_ratios", f"WITH {_RATIOS} SELECT video, frame, person, round(r_head, 4) AS r_head, round(r_arm, 4) AS r_arm, round(r_leg, 4) AS r_leg FROM rt")
def _body(spark: SparkSession, d: str) -> DataFrame:
    return _r(_ratios(spark, d), *K.RATIOS)


_PRIOR = f"{_RATIOS}, ln AS (UNPIVOT (SELECT video, r_head, r_arm, r_leg FROM rt) ON r_head, r_arm, r_leg INTO NAME ratio VALUE value), pv AS (SELECT video, ratio, median(value) AS m FROM ln GROUP BY 1, 2 HAVING count(*) >= 3), prior AS (SELECT ratio, median(m) AS mean, greatest((quantile_cont(m, 0.75) - quantile_cont(m, 0.25)) / 1.349, 1e-3) AS sd, count(*) AS n_videos, quantile_cont(m, 0.05) AS p05, quantile_cont(m, 0.95) AS p95 FROM pv GROUP BY 1 HAVING count(*) >= 5)"


def _prior(spark: SparkSession, d: str) -> DataFrame:
    return K.calibrate_prior(_ratios(spark, d), least_frames=3)


def _costs(spark: SparkSession, d: str) -> DataFrame:
    """Profiles with their costs; the proportions are written once and read for profiles, frames and prior."""
    rt = materialise(_ratios(spark, d), "ratios")
    return K.prior_cost(_profiles_of(rt), K.calibrate_prior(rt, least_frames=3))


@query("agg_prior_calibrate", f"WITH {_PRIOR} SELECT ratio, round(mean, 4) AS mean, round(sd, 4) AS sd, n_videos, round(p05, 4) AS p05, round(p95, 4) AS p95 FROM prior")
def _calibrate(spark: SparkSession, d: str) -> DataFrame:
    return _r(_prior(spark, d), "mean", "sd", "p05", "p95")


# Tracks stand for persons here, so that profiles and choices can be stated in SQL.
_PROFILE = f"{_PRIOR}, pf AS (SELECT video, person AS track, median(r_head) AS r_head, median(r_arm) AS r_arm, median(r_leg) AS r_leg, count(DISTINCT frame) AS n FROM rt GROUP BY 1, 2), nf AS (SELECT video, count(DISTINCT frame) AS n_frames FROM rt GROUP BY 1), pr AS (SELECT *, n / greatest(1, n_frames)::DOUBLE AS presence FROM pf JOIN nf USING (video)), tl AS (UNPIVOT (SELECT video, track, r_head, r_arm, r_leg FROM pr) ON r_head, r_arm, r_leg INTO NAME ratio VALUE value), cs AS (SELECT video, track, avg(((value - mean) / sd) ** 2) AS cost, count(value) AS n_terms FROM tl JOIN prior USING (ratio) GROUP BY 1, 2)"


def _profiles_of(ratios: DataFrame) -> DataFrame:
    rt = ratios.withColumnRenamed("person", "track").withColumn("score", F.lit(1.0))
    return K.track_profiles(rt, rt.groupBy("video").agg(F.countDistinct("frame").alias("n_frames")))


@query("agg_track_profile", f"WITH {_PROFILE} SELECT video, track, round(r_head, 4) AS r_head, round(r_leg, 4) AS r_leg, n, round(presence, 4) AS presence FROM pr")
def _profile(spark: SparkSession, d: str) -> DataFrame:
    return _r(_profiles_of(_ratios(spark, d)), "r_head", "r_leg", "presence").select("video", "track", "r_head", "r_leg", "n", "presence")


@query("mean_sq_z_cost", f"WITH {_PROFILE} SELECT video, track, round(cost, 3) AS cost, n_terms FROM cs")
def _cost(spark: SparkSession, d: str) -> DataFrame:
    return _r(_costs(spark, d), "cost", places=3).select("video", "track", "cost", "n_terms")


_CHOICE = f"WITH {_PROFILE}, sel AS (SELECT video, track, cost, lead(cost) OVER w AS nxt, row_number() OVER w AS rn FROM cs JOIN pr USING (video, track) WHERE presence >= 0.2 AND n_terms >= 2 WINDOW w AS (PARTITION BY video ORDER BY cost, track)), ch AS (SELECT video, track, cost, (nxt - cost) / greatest(cost, 1e-6) AS margin FROM sel WHERE rn = 1)"


def _choice(spark: SparkSession, d: str) -> DataFrame:
    return K.select_track(_costs(spark, d), 0.2, 2, 1.0)


@query("select_margin", f"{_CHOICE} SELECT video, track, round(cost, 3) AS cost, round(margin, 2) AS margin, CASE WHEN cost > 1 THEN 'dropped' WHEN margin IS NULL THEN 'only' ELSE 'kept' END AS decision FROM ch")
def _select(spark: SparkSession, d: str) -> DataFrame:
    return _r(_r(_choice(spark, d), "cost", places=3), "margin", places=2)


@query("sort_review_queue", f"{_CHOICE} SELECT video, CASE WHEN cost > 1 THEN 0 ELSE 1 END AS first, round(coalesce(margin, -cost), 3) + 0.0 AS by_ FROM ch ORDER BY 2, 3, 1")
def _review(spark: SparkSession, d: str) -> DataFrame:
    c = _choice(spark, d).select("video", F.when(F.col("decision") == "dropped", 0).otherwise(1).alias("first"), F.coalesce("margin", -F.col("cost")).alias("by_"))
    return _r(c.orderBy("first", "by_", "video"), "by_", places=3)


def _overlap(a: str, b: str) -> str:
    """The linking score of two boxes [x1, y1, x2, y2] in SQL."""
    w, h = (lambda t: f"({t}[3] - {t}[1])"), (lambda t: f"({t}[4] - {t}[2])")
    common = f"(greatest(0, least({a}[3], {b}[3]) - greatest({a}[1], {b}[1])) * greatest(0, least({a}[4], {b}[4]) - greatest({a}[2], {b}[2])))"
    area = lambda t: f"({w(t)} * {h(t)})"
    own = f"coalesce({common} / nullif(greatest({area(a)} + {area(b)} - {common}, 0), 0), 0)"
    apart = f"sqrt((({a}[1] + {a}[3] - {b}[1] - {b}[3]) / 2)**2 + (({a}[2] + {a}[4] - {b}[2] - {b}[4]) / 2)**2)"
    near = f"least({w(a)}, {h(a)}, {w(b)}, {h(b)}) > 0 AND greatest({area(a)}, {area(b)}) <= 4 * greatest(least({area(a)}, {area(b)}), 1e-6) AND {apart} < 0.5 * sqrt((({w(a)} + {w(b)}) / 2)**2 + (({h(a)} + {h(b)}) / 2)**2)"
    return f"CASE WHEN {own} >= 0.3 THEN {own} WHEN {near} THEN 0.15 ELSE 0 END"


# Linking as a recursion over frames: live tracks (id, frame, box) in a list, pairs by falling score taken one by one.
LINKED = f"""WITH RECURSIVE {_BOXES}, det AS (SELECT video, frame, list(person ORDER BY person) AS ps, list([x1, y1, x2, y2] ORDER BY person) AS bs, row_number() OVER (PARTITION BY video ORDER BY frame) AS n FROM boxes GROUP BY 1, 2),
run AS (SELECT DISTINCT video, 0::BIGINT AS n, -1 AS frame, CAST([] AS INTEGER[]) AS ps, CAST([] AS STRUCT(t BIGINT, f INTEGER, b DOUBLE[])[]) AS live, 0::BIGINT AS made, CAST([] AS BIGINT[]) AS tracks FROM det
  UNION ALL SELECT video, n, frame, ps, list_concat(list_transform(old, lambda o, i: {{'t': o.t, 'f': CASE WHEN len(list_filter(own, lambda k: k = i)) > 0 THEN frame ELSE o.f END, 'b': CASE WHEN len(list_filter(own, lambda k: k = i)) > 0 THEN bs[list_position(own, i)] ELSE o.b END}}),
      list_transform(list_filter(range(1, len(bs) + 1), lambda j: own[j] = 0), lambda j: {{'t': tr[j], 'f': frame, 'b': bs[j]}})), made + len(list_filter(own, lambda k: k = 0)), tr
  FROM (SELECT *, list_transform(own, lambda k, j: CASE WHEN k > 0 THEN old[k].t ELSE made + len(list_filter(own[1:j], lambda z: z = 0)) - 1 END) AS tr
  FROM (SELECT *, list_transform(range(1, len(bs) + 1), lambda j: coalesce(list_filter(got, lambda p: p.j = j)[1].i, 0)) AS own
  FROM (SELECT *, CASE WHEN len(pairs) = 0 THEN CAST([] AS STRUCT(s DOUBLE, i BIGINT, j BIGINT)[]) ELSE list_reduce(list_transform(pairs, lambda p: [p]), lambda u, p: CASE WHEN len(list_filter(u, lambda z: z.i = p[1].i OR z.j = p[1].j)) > 0 THEN u ELSE list_concat(u, p) END) END AS got
  FROM (SELECT *, list_reverse_sort(list_filter(flatten(list_transform(range(1, len(old) + 1), lambda i: list_transform(range(1, len(bs) + 1), lambda j: {{'s': ({_overlap('old[i].b', 'bs[j]')})::DOUBLE, 'i': i, 'j': j}}))), lambda p: p.s > 0)) AS pairs
  FROM (SELECT d.video, d.n, d.frame, d.ps, d.bs, r.made, list_filter(r.live, lambda o: d.frame - o.f <= 15) AS old FROM run r JOIN det d ON d.video = r.video AND d.n = r.n + 1))))))
SELECT video, frame, unnest(ps) AS person, unnest(tracks)::INTEGER AS track FROM run WHERE n > 0"""


def linking_boxes(spark: SparkSession, d: str) -> DataFrame:
    return _boxes(spark, d).select("video", "frame", "person", "x1", "y1", "x2", "y2")


@query("greedy_iou_track", LINKED)
def _link(spark: SparkSession, d: str) -> DataFrame:
    return K.link_tracks(linking_boxes(spark, d))


@query("agg_count_concurrent", f"WITH {X.CTE_PERSONS}, k AS (SELECT video, frame, count(DISTINCT person) AS k FROM persons WHERE score >= 0.97 GROUP BY 1, 2), n AS (SELECT video, count(*) AS n_frames FROM frames GROUP BY 1) SELECT video, greatest(1, round_even(median(k), 0)::INT) AS n_people, round(count_if(k > 1) / max(n_frames)::DOUBLE, 5) AS frac_multi FROM k JOIN n USING (video) GROUP BY 1")
def _concurrent(spark: SparkSession, d: str) -> DataFrame:
    m = X.persons(spark, d).where("score >= 0.97").select("video", "frame", F.col("person").alias("track"))
    return _r(K.count_concurrent(m, X.frames(spark, d).groupBy("video").agg(F.count("*").alias("n_frames"))), "frac_multi", places=5)


@query("sort_count_verdict", f"WITH {X.CTE_FRAMES} SELECT video, CASE WHEN count(*) > 50 THEN 'single' ELSE 'several' END AS verdict FROM frames GROUP BY video ORDER BY 2 DESC, 1")
def _verdict(spark: SparkSession, d: str) -> DataFrame:
    c = X.frames(spark, d).groupBy("video").agg(F.when(F.count("*") > 50, "single").otherwise("several").alias("verdict"))
    return c.orderBy(F.col("verdict") != "single", "video")


@query("join_tracks_frames", f"WITH {X.CTE_PERSONS}, b AS (SELECT video, frame, person FROM (SELECT video, frame, person, count_if(score >= 0.5) AS n_conf, avg(score) AS ms FROM persons GROUP BY 1, 2, 3) WHERE n_conf > 9 QUALIFY row_number() OVER (PARTITION BY video, frame ORDER BY n_conf DESC, ms DESC, person DESC) = 1) SELECT f.video, f.frame, b.person FROM frames f LEFT JOIN b USING (video, frame)")
def _tracks_frames(spark: SparkSession, d: str) -> DataFrame:
    best = pick_instance(X.persons(spark, d), 0.5).where("n_conf > 9").select("video", "frame", "person")
    return X.frames(spark, d).select("video", "frame").join(best, ["video", "frame"], "left")


_GT = f"WITH {X.CTE_PERSONS}, g AS (SELECT video, frame, kp, x AS gx, y AS gy FROM persons WHERE person = 0 AND score >= 0.4), p AS (SELECT video, frame, kp, x AS px, y AS py FROM persons WHERE person = 1 AND score >= 0.4), j AS (SELECT * FROM g FULL JOIN p USING (video, frame, kp))"


def _gt(spark: SparkSession, d: str) -> DataFrame:
    people = X.persons(spark, d).where("score >= 0.4")
    g = people.where("person = 0").select("video", "frame", "kp", F.col("x").alias("gx"), F.col("y").alias("gy"))
    return g.join(people.where("person = 1").select("video", "frame", "kp", F.col("x").alias("px"), F.col("y").alias("py")), ["video", "frame", "kp"], "full_outer")


@query("join_gt_pred", f"{_GT} SELECT video, kp, count(*) AS n, count(gx) AS n_gt, count(px) AS n_pred FROM j GROUP BY 1, 2")
def _gt_pred(spark: SparkSession, d: str) -> DataFrame:
    return _gt(spark, d).groupBy("video", "kp").agg(F.count("*").alias("n"), F.count("gx").alias("n_gt"), F.count("px").alias("n_pred"))


@query("agg_precision_recall_rmse", f"{_GT} SELECT kp, round(count_if(gx IS NOT NULL AND px IS NOT NULL) / nullif(count(gx), 0)::DOUBLE, 5) AS recall, round(count_if(gx IS NOT NULL AND px IS NOT NULL) / nullif(count(px) - 1, 0)::DOUBLE, 5) AS precision, round(sqrt((sum((gx-px)**2) + sum((gy-py)**2)) / (count(gx-px) + count(gy-py))), 4) AS rmse FROM j GROUP BY 1")
def _prf(spark: SparkSession, d: str) -> DataFrame:
    both = F.count_if(F.col("gx").isNotNull() & F.col("px").isNotNull())
    dx, dy = F.col("gx") - F.col("px"), F.col("gy") - F.col("py")
    rmse = F.sqrt((F.sum(dx**2) + F.sum(dy**2)) / (F.count(dx) + F.count(dy)))
    return _r(_gt(spark, d).groupBy("kp").agg(F.round(both / F.nullif(F.count("gx"), F.lit(0)), 5).alias("recall"), F.round(both / F.nullif(F.count("px") - 1, F.lit(0)), 5).alias("precision"), rmse.alias("rmse")), "rmse")


@query("bbox_diag_norm_dist", f"{_GT}, bx AS (SELECT video, frame, sqrt((max(gx)-min(gx))**2 + (max(gy)-min(gy))**2) AS diag FROM j GROUP BY 1, 2) SELECT video, frame, kp, round(sqrt((gx-px)**2 + (gy-py)**2) / nullif(diag, 0), 4) AS dist FROM j JOIN bx USING (video, frame) WHERE gx IS NOT NULL AND px IS NOT NULL")
def _diag(spark: SparkSession, d: str) -> DataFrame:
    j = _gt(spark, d)
    box = j.groupBy("video", "frame").agg(F.hypot(F.max("gx") - F.min("gx"), F.max("gy") - F.min("gy")).alias("diag"))
    own = j.where("gx IS NOT NULL AND px IS NOT NULL").join(box, ["video", "frame"])
    dist = F.hypot(F.col("gx") - F.col("px"), F.col("gy") - F.col("py")) / F.nullif(F.col("diag"), F.lit(0.0))
    return _r(own.select("video", "frame", "kp", dist.alias("dist")), "dist")


_PEAKS = f"WITH {X.CTE_PERSONS}, pk AS (SELECT video, frame, person * 17 + kp AS id, x, score FROM persons WHERE score >= 0.5)"


def _peaks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Nested peaks and persons of each frame, as the old files hold them."""
    p = X.persons(spark, d)
    peaks = p.where("score >= 0.5").groupBy("video", "frame").agg(F.collect_list(F.expr("struct(x, y, score AS c, person * 17 + kp AS id)")).alias("peaks"))
    limbs = p.groupBy("video", "frame", "person").agg(F.sort_array(F.collect_list(F.struct("kp", F.expr("if(score >= 0.4, person * 17 + kp, -1)").alias("id")))).alias("subset"))
    return peaks, limbs


@query("join_peaks_to_persons", f"{_PEAKS} SELECT p.video, p.frame, p.person, p.kp::INT AS part, round(pk.x, 4) AS x FROM persons p LEFT JOIN pk ON pk.video = p.video AND pk.frame = p.frame AND pk.id = p.person * 17 + p.kp WHERE p.score >= 0.4")
def _peak_join(spark: SparkSession, d: str) -> DataFrame:
    """Every part that a person has, and its peak if there is one."""
    rows = P.decode_skeletons(*_peaks(spark, d))
    return rows.where("id >= 0").select("video", "frame", "person", "part", F.round("x", 4).alias("x"))


@query("legacy_skeleton_decode", f"{_PEAKS} SELECT p.video, p.frame, p.person, count(*) AS n_parts, count(pk.id) AS n_found, round(max(pk.score), 5) AS best FROM persons p LEFT JOIN pk ON pk.video = p.video AND pk.frame = p.frame AND pk.id = p.person * 17 + p.kp AND p.score >= 0.4 GROUP BY 1, 2, 3")
def _decode(spark: SparkSession, d: str) -> DataFrame:
    rows = P.decode_skeletons(*_peaks(spark, d))
    return rows.groupBy("video", "frame", "person").agg(F.count("*").alias("n_parts"), F.count("c").alias("n_found"), F.round(F.max("c"), 5).alias("best"))
