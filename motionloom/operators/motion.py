"""Motion of 17-point recordings: robust statistics, smoothing, joint angles, spectra, quality."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from .ordered import batched, frames_of, in_order
from .sequences import gradient, islands


def stats5(column: str, prefix: str) -> list[Column]:
    """Mean, population deviation, median, 95th percentile and maximum."""
    return [F.avg(column).alias(f"{prefix}_mean"), F.stddev_pop(column).alias(f"{prefix}_std"), F.expr(f"percentile({column}, 0.5)").alias(f"{prefix}_median"), F.expr(f"percentile({column}, 0.95)").alias(f"{prefix}_p95"), F.max(column).alias(f"{prefix}_max")]


def trunk_scale(df: DataFrame) -> DataFrame:
    """Median distance from the shoulders' to the hips' middle of each recording; tiny ones are null."""
    at = lambda k, c: F.max(F.when(F.col("kp") == k, F.col(c)))
    per = df.groupBy("video", "frame").agg(*[((at(5, c) + at(6, c)) / 2 - (at(11, c) + at(12, c)) / 2).alias(c) for c in "xy"])
    scale = per.groupBy("video").agg(F.percentile(F.hypot("x", "y"), F.lit(0.5)).alias("scale"))
    return scale.withColumn("scale", F.when(F.col("scale") > 1e-6, F.col("scale")))


def speed(df: DataFrame, dt: Column) -> DataFrame:
    """Speed of every point from central differences; acceleration and jerk of its absolute values."""
    keys = ["video", "kp"]
    df = df.withColumns({"vx": gradient("x", dt, keys, "frame"), "vy": gradient("y", dt, keys, "frame")})
    df = df.withColumn("speed", F.hypot("vx", "vy"))
    df = df.withColumn("accel", F.abs(gradient("speed", dt, keys, "frame")))
    return df.withColumn("jerk", F.abs(gradient("accel", dt, keys, "frame")))


def joint_angle(df: DataFrame, a: int, v: int, b: int) -> DataFrame:
    """Unsigned angle in degrees at point ``v`` between ``a`` and ``b`` of each frame."""
    at = lambda k, c: F.max(F.when(F.col("kp") == k, F.col(c)))
    per = df.groupBy("video", "frame").agg(*[(at(p, c) - at(v, c)).alias(f"{n}{c}") for n, p in (("u", a), ("w", b)) for c in "xy"])
    dot = F.col("ux") * F.col("wx") + F.col("uy") * F.col("wy")
    den = F.hypot("ux", "uy") * F.hypot("wx", "wy")
    cosine = dot / F.nullif(den, F.lit(0.0))
    return per.select("video", "frame", F.when(cosine.isNotNull(), F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))).alias("angle"))


def net_displacement(df: DataFrame) -> DataFrame:
    """Distance from the first to the last frame with a centre; needs two of them."""
    c = df.groupBy("video", "frame").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy")).where("cx IS NOT NULL AND cy IS NOT NULL")
    ends = c.groupBy("video").agg(F.min_by(F.struct("cx", "cy"), "frame").alias("a"), F.max_by(F.struct("cx", "cy"), "frame").alias("b"), F.count("*").alias("n"))
    return ends.select("video", F.when(F.col("n") >= 2, F.hypot(F.col("b.cx") - F.col("a.cx"), F.col("b.cy") - F.col("a.cy"))).alias("net"))


def group_speed(df: DataFrame, groups: dict[str, list[int]]) -> DataFrame:
    """Mean speed of the points of each group per frame; a point may be in many groups."""
    member = F.create_map(*[x for k in range(17) for x in (F.lit(k), F.array(*[F.lit(g) for g, ks in groups.items() if k in ks]).cast("array<string>"))])
    return df.withColumn("grp", F.explode(member[F.col("kp")])).groupBy("video", "frame", "grp").agg(F.avg("speed").alias("speed"))


def tracked_quality(df: DataFrame, tracked: Column) -> DataFrame:
    """Frames, tracked frames and share, mean positive score, longest gap (counted from both ends).

    ``tracked`` is an aggregate over a frame's points.
    """
    w = Window.partitionBy("video").orderBy("frame")
    own = df.groupBy("video", "frame").agg(tracked.alias("ok"), F.avg(F.when(F.col("score") > 0, F.col("score"))).alias("score"))
    totals = own.groupBy("video").agg(F.count("*").alias("n_frames"), F.count_if("ok").alias("n_tracked"), F.avg("score").alias("mean_score"), F.max("frame").alias("last"))
    gaps = own.where("ok").withColumn("gap", F.col("frame") - F.coalesce(F.lag("frame").over(w), F.lit(-1)) - 1).groupBy("video").agg(F.max("gap").alias("gap"), F.max("frame").alias("end"))
    j = totals.join(gaps, "video", "left")
    return j.select("video", "n_frames", "n_tracked", (F.col("n_tracked") / F.col("n_frames")).alias("frac_tracked"), "mean_score", F.greatest(F.coalesce("gap", F.lit(0)), F.col("last") - F.coalesce("end", F.lit(-1))).alias("longest_gap"))


def savgol_weights(width: int, at: int, degree: int = 2) -> list[float]:
    """Weights of a window's values in the least-squares polynomial's value at one place of it."""
    x = np.arange(width) - at
    return np.linalg.pinv(np.vander(x, degree + 1, increasing=True))[0].tolist()


def savgol_smooth(df: DataFrame, column: str, out: str, keys: list[str], order: str, width: int = 7) -> DataFrame:
    """Savitzky-Golay smoothing of every run of present values at least ``width`` long.

    Inner rows use the window around them; the first and last rows of a run are values of the
    polynomial through its first and last window.  Shorter runs stay as they are.
    """
    half = width // 2
    w = Window.partitionBy(*keys).orderBy(order)
    df = islands(df, keys, [order], F.col(column).isNull() | F.lag(column).over(w).isNull(), "__loom_run")
    run = Window.partitionBy(*keys, "__loom_run")
    place = F.row_number().over(run.orderBy(order)) - 1
    df = df.withColumns({"__loom_p": place, "__loom_n": F.count(column).over(run)})
    near = run.orderBy(order).rowsBetween(-(width - 1), width - 1)
    df = df.withColumn("__loom_w", F.collect_list(F.col(column)).over(near))
    p, n = F.col("__loom_p"), F.col("__loom_n")
    at = F.when(p < half, p).when(p >= n - half, p - (n - width)).otherwise(F.lit(half))  # place in the window used
    first = F.greatest(p - (width - 1), F.lit(0))  # place of the list's first value
    start = p - at - first
    value = F.lit(None).cast("double")
    for k in range(width):
        weights = F.array(*map(F.lit, savgol_weights(width, k)))
        own = F.aggregate(F.zip_with(F.slice("__loom_w", (start + 1).cast("int"), width), weights, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        value = F.when(at == k, own).otherwise(value)
    return df.withColumn(out, F.when(F.col(column).isNull() | (n < width), F.col(column)).otherwise(value)).drop("__loom_run", "__loom_p", "__loom_n", "__loom_w")


def box_smooth(df: DataFrame, column: str, out: str, keys: list[str], order: str, width: int = 5) -> DataFrame:
    """Moving mean with repeated edge values; missing values count as the series' median."""
    medians = df.groupBy(*keys).agg(F.percentile(column, F.lit(0.5)).alias("__loom_m"), F.count("*").alias("__loom_n"))
    df = df.join(medians, keys).withColumn("__loom_v", F.coalesce(column, "__loom_m"))
    half = width // 2
    w = Window.partitionBy(*keys).orderBy(order)
    p = F.row_number().over(w)
    terms = [F.when(p + k < 1, F.first("__loom_v").over(w)).when(p + k > F.col("__loom_n"), F.last("__loom_v").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).otherwise(F.lead("__loom_v", k).over(w) if k >= 0 else F.lag("__loom_v", -k).over(w)) for k in range(-half, half + 1)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return df.withColumn(out, total / width).drop("__loom_m", "__loom_n", "__loom_v")


def dominant_frequency(df: DataFrame, keys: list[str], order: str, column: str, fps: str, low: float = 0.3, high: float = 5.0) -> DataFrame:
    """Strongest frequency of each series in [low, high] Hz and its share of all power.

    Missing values are taken out first; a series needs two seconds.  One series is one group.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        x = pdf[column].dropna().to_numpy()
        rate = float(pdf[fps].iloc[0])
        freq = share = None
        if len(x) >= 2 * rate:
            power = np.abs(np.fft.rfft(x - x.mean())) ** 2
            hz = np.fft.rfftfreq(len(x), 1 / rate)
            own = (hz >= low) & (hz <= high)
            if own.any() and power.sum() > 0:
                k = np.flatnonzero(own)[np.argmax(power[own])]
                freq, share = float(hz[k]), float(power[k] / power.sum())
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "freq": [freq], "share": [share]})

    kinds = dict(df.dtypes)
    return df.select(*keys, order, column, fps).groupBy(*keys).applyInPandas(one, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", freq double, share double")


def track_candidates(points: DataFrame, threshold: float = 0.3) -> DataFrame:
    """What the centroid tracker needs of each person: centre of the good points, extent of all, scores."""
    good = F.col("score") >= threshold
    extent = F.hypot(F.max("x") - F.min("x"), F.max("y") - F.min("y"))
    return points.groupBy("video", "frame", "person").agg(F.avg(F.when(good, F.col("x"))).alias("cx"), F.avg(F.when(good, F.col("y"))).alias("cy"), extent.alias("span"), F.avg("score").alias("mean_score"), F.count_if(good).alias("n_good"))


def greedy_centroid_track(df: DataFrame, threshold: float = 0.3, max_jump: float = 0.5) -> DataFrame:
    """Follow one person: best mean score first, then the nearest centre that is not too far.

    Input: video, frame, person, cx, cy, span, mean_score, n_good.  Output: video, frame, person.  A recording
    is read in order; only the last centre and extent are held.
    """

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            of, last, reach = None, None, None
            for video, frame, people in frames_of(batches):
                if video != of:
                    of, last, reach = video, None, None
                if last is None:
                    person, cx, cy, span, _ = max(people, key=lambda p: p[4])
                else:
                    far = lambda p: math.hypot(p[1] - last[0], p[2] - last[1])  # noqa: B023, E731 - used at once
                    person, cx, cy, span, _ = near = min(people, key=far)
                    if reach and far(near) > max_jump * reach:
                        continue
                last, reach = (cx, cy), span or reach
                yield video, frame, person

        return batched(rows(), schema)

    usable = df.where((F.col("mean_score") >= threshold / 2) & (F.col("n_good") >= 4)).select("video", "frame", "person", "cx", "cy", "span", "mean_score")
    schema = to_arrow_schema(usable.select("video", "frame", "person").schema)
    kinds = dict(df.dtypes)
    return in_order(usable, "video", ["frame", "person"]).mapInArrow(follow, f"video {kinds['video']}, frame {kinds['frame']}, person {kinds['person']}")
