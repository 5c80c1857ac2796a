"""From keypoints to kinematic features: selection, grid, smoothing, skeleton, angles, dynamics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .sequences import angle_delta, delta, interpolate, rolling_centered, rolling_trailing

#: Joint, its own point, and the two points its angle lies between.
JOINTS = [
    ("RShoulder", "RShoulder", "Neck", "RElbow"),
    ("RElbow", "RElbow", "RShoulder", "RWrist"),
    ("RHip", "RHip", "LHip", "RKnee"),
    ("RKnee", "RKnee", "RHip", "RAnkle"),
    ("LShoulder", "LShoulder", "Neck", "LElbow"),
    ("LElbow", "LElbow", "LShoulder", "LWrist"),
    ("LHip", "LHip", "RHip", "LKnee"),
    ("LKnee", "LKnee", "LHip", "LAnkle"),
]
#: Parts that hang on the upper reference.
UPPER = ["Nose", "Neck", "Shoulder", "Elbow", "Wrist", "Eye", "Ear", "ose", "eck"]


def mask_low_score(df: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Points below the score become missing in both coordinates."""
    good = F.col("score") >= threshold
    return df.withColumns({"x": F.when(good, F.col("x")), "y": F.when(good, F.col("y"))})


def decode_skeletons(peaks: DataFrame, limbs: DataFrame) -> DataFrame:
    """Nested peaks (x, y, c, id) and persons' part lists of peak ids -> a row for each person and part.

    Parts that a person lacks have id -1 and no peak.
    """
    own = limbs.select("video", "frame", "person", F.posexplode("subset.id").alias("part", "id"))
    spots = peaks.select("video", "frame", F.explode("peaks").alias("p")).select("video", "frame", "p.id", "p.x", "p.y", "p.c")
    return own.join(spots, ["video", "frame", "id"], "left")


def zero_to_null(df: DataFrame) -> DataFrame:
    """Coordinates of exactly zero are missing, each on its own."""
    return df.withColumns({c: F.nullif(F.col(c), F.lit(0.0)) for c in ("x", "y")})


def name_parts(df: DataFrame, coco: list[str], part_of) -> DataFrame:  # noqa: ANN001
    """Keypoint numbers to part names, by a map of fixed size."""
    names = F.create_map(*[F.lit(v) for i, n in enumerate(coco) for v in (i, part_of(n))])
    return df.withColumn("bp", names[F.col("kp")])


def with_neck(df: DataFrame, constants: tuple[str, ...] = ()) -> DataFrame:
    """Add the midpoint of both shoulders of each frame as Neck (missing if either is), in one pass.

    ``constants`` are columns with one value a frame, which stay.
    """
    at = lambda bp, c: F.max(F.when(F.col("bp") == bp, F.col(c)))
    neck = F.struct(F.lit("Neck").alias("bp"), *[((at("LShoulder", c) + at("RShoulder", c)) / 2).alias(c) for c in ("x", "y")])
    per = df.groupBy("video", "frame").agg(*[F.first(c).alias(c) for c in constants], F.concat(F.collect_list(F.struct("bp", "x", "y")), F.array(neck)).alias("p"))
    return per.select("video", "frame", *constants, F.inline("p"))


def pick_instance(df: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Per frame the person with most confident points, then the larger mean score, then the last one."""
    per = df.groupBy("video", "frame", "person").agg(F.count_if(F.col("score") >= threshold).alias("n_conf"), F.avg("score").alias("mean_score")).where("n_conf > 0")
    w = Window.partitionBy("video", "frame").orderBy(F.desc("n_conf"), F.desc("mean_score"), F.desc("person"))
    return per.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def pick_person_legacy(df: DataFrame) -> DataFrame:
    """Per frame the person with most points present, the first on a tie."""
    per = df.groupBy("video", "frame", "person").agg(F.count("x").alias("n_points"))
    w = Window.partitionBy("video", "frame").orderBy(F.desc("n_points"), "person")
    return per.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def dense_grid(df: DataFrame, parts: list[str], constants: tuple[str, ...] = ()) -> DataFrame:
    """video x 0..last frame x part, with the data where there is some.

    A frame's row also stands for the frames missing up to the next one, so nothing is joined;
    ``constants`` are columns with one value a recording.
    """
    w = Window.partitionBy("video").orderBy("frame")
    rows = df.groupBy("video", "frame").agg(*[F.first(c).alias(c) for c in constants], F.map_from_entries(F.collect_list(F.struct("bp", F.struct("x", "y")))).alias("p"))
    start = F.when(F.lag("frame").over(w).isNull(), 0).otherwise(F.col("frame"))
    rows = rows.withColumns({"__loom_a": start, "__loom_b": F.coalesce(F.lead("frame").over(w) - 1, F.col("frame"))})
    spans = rows.select("*", F.explode(F.sequence("__loom_a", "__loom_b")).alias("f"))
    grid = spans.select("video", F.col("f").alias("frame"), *constants, F.when(F.col("f") == F.col("frame"), F.col("p")).alias("p"), F.posexplode(F.array(*map(F.lit, parts))).alias("part_idx", "bp"))
    point = F.try_element_at("p", F.col("bp"))
    return grid.select("video", "frame", "part_idx", "bp", *constants, point["x"].alias("x"), point["y"].alias("y"))


def normalise_frame(df: DataFrame) -> DataFrame:
    """Origin at the picture's middle, both axes in units of its height."""
    return df.withColumns({"x": (F.col("x") - F.col("pixel_x") / 2) / F.col("pixel_y"), "y": (F.col("y") - F.col("pixel_y") / 2) / F.col("pixel_y")})


def smooth_pose(df: DataFrame, seconds: float = 0.5) -> DataFrame:
    """Interpolate, then centred median and centred mean over ``int(seconds * fps)`` rows."""
    keys, both = ["video", "bp"], {"x": "x", "y": "y"}
    df = interpolate(df, ["x", "y"], keys, "frame").withColumn("w", F.floor(F.col("fps") * seconds).cast("int"))
    return rolling_centered(rolling_centered(df, both, keys, "frame", "w", "median"), both, keys, "frame", "w", "mean")


def folded(angle: Column) -> Column:
    """The reference angle after its three sequential foldings."""
    a = F.when(angle < 0, 2 * F.pi() + angle).otherwise(angle)
    a = F.when(a < F.pi(), F.pi() - a).otherwise(a)
    return F.when((a > F.pi()) & (a < 2 * F.pi()), 3 * F.pi() - a).otherwise(a)


def frame_rows(df: DataFrame) -> DataFrame:
    """One row a frame: p maps each part to its x, y and further columns.

    Reference angles, rotation and joint angles are all taken from such rows, without joins.
    """
    rest = [c for c in df.columns if c not in ("video", "frame", "bp")]
    return df.groupBy("video", "frame").agg(F.map_from_entries(F.collect_list(F.struct("bp", F.struct(*rest)))).alias("p"))


def with_refs(rows: DataFrame) -> DataFrame:
    """Add shoulder and hip angles and midpoints, and the trunk's length, to frame rows."""
    at = lambda bp, c: F.try_element_at("p", F.lit(bp))[c]
    out = {}
    for part, name in (("Shoulder", "u"), ("Hip", "l")):
        out[f"angle_{name}"] = F.atan2(at(f"R{part}", "y") - at(f"L{part}", "y"), at(f"R{part}", "x") - at(f"L{part}", "x"))
        out |= {f"ref_{name}{c}": (at(f"L{part}", c) + at(f"R{part}", c)) / 2 for c in ("x", "y")}
    rows = rows.withColumns(out)
    return rows.withColumn("trunk", F.hypot(F.col("ref_ux") - F.col("ref_lx"), F.col("ref_uy") - F.col("ref_ly")))


def skeleton_refs(df: DataFrame) -> DataFrame:
    """Per frame: shoulder and hip angles and midpoints, and the trunk's length."""
    return with_refs(frame_rows(df)).drop("p")


def rotated_parts(rows: DataFrame) -> DataFrame:
    """Frame rows to one row a part, turned and scaled as by ``rotate_scale_skeleton``."""
    parts = with_refs(rows).select("*", F.explode("p").alias("bp", "__loom_p")).drop("p").select("*", "__loom_p.*").drop("__loom_p")
    parts = parts.withColumn("upper", F.expr(f"if(bp IN ('Nose', 'Neck') OR substring(bp, 2) IN ({', '.join(repr(p) for p in UPPER)}), 1, 0)"))
    up = F.col("upper") == 1
    angle = folded(F.when(up, F.col("angle_u")).otherwise(F.col("angle_l")))
    dx = F.col("x") - F.when(up, F.col("ref_ux")).otherwise(F.col("ref_lx"))
    dy = F.col("y") - F.when(up, F.col("ref_uy")).otherwise(F.col("ref_ly"))
    length = F.nullif(F.col("trunk"), F.lit(0.0))
    return parts.withColumns({"x": (F.cos(angle) * dx - F.sin(angle) * dy) / length, "y": (F.sin(angle) * dx + F.cos(angle) * dy) / length + F.when(up, 0).otherwise(1)})


def rotate_scale_skeleton(df: DataFrame) -> DataFrame:
    """Turn each body half about its reference by the folded angle, in units of the trunk; legs shifted by 1."""
    return rotated_parts(frame_rows(df))


def joints_of(rows: DataFrame) -> DataFrame:
    """Frame rows to signed joint angles in degrees, one row per frame and joint with all three points present."""
    at = lambda q: F.try_element_at("p", F.lit(q))
    joints = F.array(*[F.struct(F.lit(j).alias("bp"), *[at(q).alias(n) for n, q in zip("abc", pts, strict=True)]) for j, *pts in JOINTS])
    spots = rows.select("video", "frame", F.inline(joints)).where(" AND ".join(f"{n}.{c} IS NOT NULL" for n in "abc" for c in "xy"))
    ux, uy, vx, vy = F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y"), F.col("c.x") - F.col("a.x"), F.col("c.y") - F.col("a.y")
    raw = F.atan2(ux * vy - uy * vx, ux * vx + uy * vy) * 180 / F.pi()
    raw = F.when(F.col("bp").isin("LShoulder", "LHip"), -raw).otherwise(raw)
    raw = F.when(F.substring("bp", 2, 9).isin("Elbow", "Knee"), F.abs(raw)).when(raw < 0, raw + 360).otherwise(raw)
    return spots.select("video", "frame", F.col("a.fps").alias("fps"), "bp", raw.alias("angle"))


def joint_angles(df: DataFrame) -> DataFrame:
    """Signed joint angles in degrees, one row per frame and joint with all three points present."""
    return joints_of(frame_rows(df))


def _smoothed(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Interpolated and trailing-smoothed copies (result: column), all in the same windows."""
    keys = ["video", "bp"]
    df = interpolate(df.withColumns({out: F.col(c) for out, c in columns.items()}), list(columns), keys, "frame")
    return rolling_trailing(df, {out: out for out in columns}, keys, "frame", "wd")


def dynamics_xy(df: DataFrame, seconds: float = 0.25) -> DataFrame:
    """Velocity and acceleration of x and y (smoothed, trailing), squared acceleration and speed."""
    keys, dt = ["video", "bp"], 1 / F.col("fps")
    df = df.withColumn("wd", F.floor(F.col("fps") * seconds).cast("int")).withColumns({f"d_{c}": delta(c, keys, "frame") for c in "xy"})
    df = df.withColumn("displacement", F.hypot("d_x", "d_y")).withColumns({f"velocity_{c}_raw": F.col(f"d_{c}") / dt for c in "xy"} | {"speed_raw": F.hypot("d_x", "d_y") / dt})
    df = _smoothed(df, {c: f"{c}_raw" for c in ("velocity_x", "velocity_y", "speed")})
    df = df.withColumns({f"delta_velocity_{c}": delta(f"velocity_{c}", keys, "frame") for c in "xy"})
    df = _smoothed(df.withColumns({f"acceleration_{c}_raw": F.col(f"delta_velocity_{c}") / dt for c in "xy"}), {f"acceleration_{c}": f"acceleration_{c}_raw" for c in "xy"})
    return df.withColumns({f"acceleration_{c}2": F.col(f"acceleration_{c}") ** 2 for c in "xy"})


def dynamics_angle(df: DataFrame, seconds: float = 0.25) -> DataFrame:
    """Angular displacement, velocity and acceleration (smoothed, trailing)."""
    keys, dt = ["video", "bp"], 1 / F.col("fps")
    w = Window.partitionBy(*keys).orderBy("frame")
    df = df.withColumn("wd", F.floor(F.col("fps") * seconds).cast("int")).withColumns({"displacement": angle_delta("angle", keys, "frame"), "__loom_place": F.row_number().over(w) - 1})
    df = df.withColumn("frame", F.col("__loom_place")).drop("__loom_place")
    df = _smoothed(df.withColumn("velocity_raw", F.col("displacement") / dt), {"velocity": "velocity_raw"})
    df = df.withColumn("delta_velocity", delta("velocity", keys, "frame"))
    df = _smoothed(df.withColumn("acceleration_raw", F.col("delta_velocity") / dt), {"acceleration": "acceleration_raw"})
    return df.withColumn("acceleration2", F.col("acceleration") ** 2)


def with_repeats(df: DataFrame, keys: list[str], columns: dict[str, tuple[str, int]]) -> DataFrame:
    """How often each row's half-even rounded value stands in its group (result: column, places); null for null."""
    counts = {}
    for out, (c, places) in columns.items():
        w = Window.partitionBy(*keys, F.rint(F.col(c) * 10**places) + 0.0)
        counts[out] = F.when(F.col(c).isNotNull(), F.count(F.lit(1)).over(w))
    return df.withColumns(counts)


def repeat_entropy(repeats: str) -> Column:
    """Shannon entropy (nats) from how often each row's value repeats: sum n ln n over values is sum ln n over rows."""
    return F.ln(F.count(repeats)) - F.avg(F.ln(repeats))


def entropy(df: DataFrame, keys: list[str], column: str, places: int, out: str) -> DataFrame:
    """Shannon entropy (nats) of half-even rounded values, missing values left out."""
    present = df.where(F.col(column).isNotNull())
    return with_repeats(present, keys, {"__loom_n": (column, places)}).groupBy(*keys).agg(repeat_entropy("__loom_n").alias(out))


def lr_correlation(df: DataFrame, column: str, out: str) -> DataFrame:
    """Pearson correlation of the left and right side, aligned by their order in (video, part)."""
    sided = df.where(F.substring("bp", 1, 1).isin("L", "R") & ~F.col("bp").isin("Nose", "Neck")).select("video", "frame", "bp", F.substring("bp", 1, 1).alias("side"), F.substring("bp", 2, 20).alias("part"), F.col(column).alias("v"))
    ranked = sided.withColumn("rn", F.row_number().over(Window.partitionBy("video", "bp").orderBy("frame")))
    pair = ranked.groupBy("video", "part", "rn").agg(F.max(F.when(F.col("side") == "L", F.col("v"))).alias("l"), F.max(F.when(F.col("side") == "R", F.col("v"))).alias("r")).where("l IS NOT NULL AND r IS NOT NULL")
    return pair.groupBy("video", "part").agg(correlation("l", "r").alias(out))


def correlation(x: str, y: str) -> Column:
    """Pearson correlation that is null, not an error, where a side does not vary."""
    return F.expr(f"try_divide(covar_pop({x}, {y}), stddev_pop({x}) * stddev_pop({y}))")


def quartiles(column: str) -> Column:
    return F.expr(f"percentile({column}, array(0.25D, 0.5D, 0.75D))")


def features_xy(df: DataFrame) -> DataFrame:
    """Positional features per (video, bp) of ankles and wrists, from ``dynamics_xy``; one aggregate."""
    own = with_repeats(df.where(F.substring("bp", 2, 9).isin("Ankle", "Wrist")), ["video", "bp"], {"__loom_nx": ("x", 2), "__loom_ny": ("y", 2)})
    per = own.groupBy("video", "bp").agg(
        *[quartiles(c).alias(f"q_{c}") for c in ("x", "y", "velocity_x", "velocity_y", "acceleration_x", "acceleration_y")],
        F.expr("percentile(abs(velocity_x), 0.5)").alias("medianvelx"),
        F.expr("percentile(abs(velocity_y), 0.5)").alias("medianvely"),
        ((repeat_entropy("__loom_nx") + repeat_entropy("__loom_ny")) / 2).alias("meanent"),
    )
    spread = lambda c: F.col(f"q_{c}")[2] - F.col(f"q_{c}")[0]
    return per.select(
        "video", "bp", F.col("q_x")[1].alias("medianx"), F.col("q_y")[1].alias("mediany"), spread("x").alias("IQRx"), spread("y").alias("IQRy"), "medianvelx", "medianvely",
        spread("velocity_x").alias("IQRvelx"), spread("velocity_y").alias("IQRvely"), spread("acceleration_x").alias("IQRaccx"), spread("acceleration_y").alias("IQRaccy"), "meanent",
    )


def features_angle(df: DataFrame) -> DataFrame:
    """Angular features per (video, bp), from ``dynamics_angle``; one aggregate."""
    s, c = F.avg(F.sin(F.radians("angle"))), F.avg(F.cos(F.radians("angle")))
    per = with_repeats(df, ["video", "bp"], {"__loom_n": ("angle", 0)}).groupBy("video", "bp").agg(
        F.degrees(F.atan2(s, c)).alias("mean_angle"), F.sqrt(F.degrees(1 - F.hypot(s, c))).alias("stdev_angle"), repeat_entropy("__loom_n").alias("entropy_angle"),
        F.expr("percentile(abs(velocity), 0.5)").alias("median_vel_angle"), quartiles("velocity").alias("qv"), quartiles("acceleration").alias("qa"),
    )
    return per.select("video", "bp", "mean_angle", "stdev_angle", "entropy_angle", "median_vel_angle", (F.col("qv")[2] - F.col("qv")[0]).alias("IQR_vel_angle"), (F.col("qa")[2] - F.col("qa")[0]).alias("IQR_acc_angle"))


XY = ["medianx", "mediany", "IQRx", "IQRy", "medianvelx", "medianvely", "IQRvelx", "IQRvely", "IQRaccx", "IQRaccy", "meanent"]
ANGLE = ["mean_angle", "stdev_angle", "entropy_angle", "median_vel_angle", "IQR_vel_angle", "IQR_acc_angle"]
#: The columns of the feature table: 44 positional, 48 angular and 12 symmetry features.
FEATURES = (
    [f"{v}_{n}" for v in XY for n in ("LAnkle", "RAnkle", "LWrist", "RWrist")]
    + [f"{v}_{j}" for v in ANGLE for j, *_ in JOINTS]
    + [f"lrCorr_x_{p}" for p in ("Ankle", "Ear", "Elbow", "Eye", "Hip", "Knee", "Shoulder", "Wrist")]
    + [f"lrCorr_angle_{p}" for p in ("Elbow", "Knee", "Hip", "Shoulder")]
)


def feature_table(rows: DataFrame) -> DataFrame:
    """One row a recording with all FEATURES, from stored frame rows of the smoothed pose.

    Every branch gives rows (video, feature, value), which one aggregate turns into columns; a
    recording that only some branches have keeps nulls for the others.
    """
    parts, joints = rotated_parts(rows), joints_of(rows)
    named = lambda df, part: df.select("video", F.concat("feature", F.lit("_"), part).alias("feature"), "value")
    long = [
        named(features_xy(dynamics_xy(parts)).unpivot(["video", "bp"], XY, "feature", "value"), "bp"),
        named(features_angle(dynamics_angle(joints)).unpivot(["video", "bp"], ANGLE, "feature", "value"), "bp"),
        named(lr_correlation(parts.withColumn("radius", F.hypot("x", "y")), "radius", "value").withColumn("feature", F.lit("lrCorr_x")), "part"),
        named(lr_correlation(joints, "angle", "value").withColumn("feature", F.lit("lrCorr_angle")), "part"),
    ]
    every = long[0].unionByName(long[1]).unionByName(long[2]).unionByName(long[3])
    return every.groupBy("video").agg(*[F.max(F.when(F.col("feature") == f, F.col("value"))).alias(f) for f in FEATURES])


def join_features(tables: list[DataFrame], key: str) -> DataFrame:
    """Feature tables side by side by full outer joins; what a table lacks is null."""
    joined = tables[0]
    for other in tables[1:]:
        joined = joined.join(other, key, "full_outer")
    return joined


def wide(df: DataFrame, key: str, names: str, values: list[str], among: list[str]) -> DataFrame:
    """One row per ``key``, columns ``<value>_<name>`` for the names given; one shuffle."""
    return df.groupBy(key).agg(*[F.avg(F.when(F.col(names) == n, F.col(v))).alias(f"{v}_{n}") for v in values for n in among])
