"""Timelines: fixed windows, scenes from frame scores, word attribution, sample bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .sequences import islands


def fixed_windows(df: DataFrame, duration: str, window: float = 10.0, min_tail: float = 2.0, cap: float | None = None) -> DataFrame:
    """segment_index, start_sec, end_sec covering [0, duration); a short rest joins the last window."""
    dur = F.col(duration).cast("double") if cap is None else F.least(F.col(duration).cast("double"), F.lit(cap))
    whole = F.floor(dur / window)
    rest = dur - whole * window
    n = F.greatest(whole + F.when((rest > 0) & ((rest >= min_tail) | (whole == 0)), 1).otherwise(0), F.lit(0)).cast("int")
    df = df.withColumns({"n_windows": n, "dur_sec": dur}).where("n_windows > 0")
    df = df.withColumn("segment_index", F.explode(F.sequence(F.lit(0), F.col("n_windows") - 1)))
    start = F.col("segment_index") * window
    return df.withColumns({"start_sec": start, "end_sec": F.when(F.col("segment_index") == F.col("n_windows") - 1, F.col("dur_sec")).otherwise(start + window)})


def shot_runs(df: DataFrame, keys: list[str], order: str, score: str, threshold: float) -> DataFrame:
    """Runs of frames between transitions: start_frame, end_frame (the first transition frame), by key.

    Frames with a score above the threshold are transitions; a run ends on the first of them.  If
    every frame is one, the whole series is one scene.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    df = df.withColumn("cut", F.col(score) > threshold)
    df = df.withColumn("was_cut", F.lag("cut").over(w))
    # A scene holds its shot frames and the first transition frame after them.
    runs = islands(df, keys, [order], ~F.col("cut") & F.col("was_cut"), "run").where("NOT cut OR NOT coalesce(was_cut, true)")
    own = runs.groupBy(*keys, "run").agg(F.min(order).alias("start_frame"), F.max(order).alias("end_frame"))
    whole = df.groupBy(*keys).agg(F.min(order).alias("start_frame"), F.max(order).alias("end_frame"), F.bool_and("cut").alias("every")).where("every").select(*keys, F.lit(1).cast("long").alias("run"), "start_frame", "end_frame")
    return own.select(*keys, F.col("run").cast("long").alias("run"), "start_frame", "end_frame").unionByName(whole)


def cut_confidence(scenes: DataFrame, scores: DataFrame, keys: list[str], order: str, score: str) -> DataFrame:
    """Largest score from a scene's last frame to the next one's first; null for the last scene."""
    w = Window.partitionBy(*keys).orderBy("start_frame")
    ahead = scenes.withColumn("next_start", F.lead("start_frame").over(w))
    span = ahead.where("next_start IS NOT NULL").select(*keys, "run", F.explode(F.sequence(F.col("end_frame").cast("long"), F.col("next_start").cast("long"))).alias(order))
    best = span.join(scores.select(*keys, F.col(order).cast("long").alias(order), score), [*keys, order]).groupBy(*keys, "run").agg(F.max(score).alias("cut_confidence"))
    return ahead.join(best, [*keys, "run"], "left").drop("next_start")


def merge_runts(df: DataFrame, keys: list[str], min_len: float) -> DataFrame:
    """Scenes shorter than ``min_len`` join the one before; a first one that is still short then joins the next."""
    short = F.col("end_sec") - F.col("start_sec") < min_len
    groups = islands(df, keys, ["start_sec"], ~short, "grp")
    # The second group begins with a long scene, so the first one is folded forwards once at most.
    every = Window.partitionBy(*keys)
    first = F.max(F.when(F.col("grp") == 1, F.col("end_sec"))).over(every) - F.min("start_sec").over(every)
    groups = groups.withColumn("grp", F.when((first < min_len) & (F.col("grp") == 2), 1).otherwise(F.col("grp")))
    return groups.groupBy(*keys, "grp").agg(F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec"), F.max_by("cut_confidence", "start_sec").alias("cut_confidence"), (F.count("*") - 1).alias("merged_runts"))


def merge_weak_cuts(df: DataFrame, keys: list[str], least: float) -> DataFrame:
    """Scenes behind a cut of less confidence than ``least`` join the one before."""
    w = Window.partitionBy(*keys).orderBy("start_sec")
    before = F.lag("cut_confidence").over(w)
    df = df.withColumn("strong", ~F.coalesce(before < least, F.lit(False)))
    groups = islands(df, keys, ["start_sec"], F.col("strong"), "grp")
    return groups.groupBy(*keys, "grp").agg(F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec"), F.max_by("cut_confidence", "start_sec").alias("cut_confidence"), (F.count("*") - 1).alias("low_conf_merges"))


def subdivide_equal(df: DataFrame, max_len: float) -> DataFrame:
    """Scenes longer than ``max_len`` (by more than 1e-6) in equal parts; only the last keeps the cut's confidence."""
    dur = F.col("end_sec") - F.col("start_sec")
    df = df.withColumn("parts", F.when(dur <= max_len + 1e-6, 1).otherwise(F.ceil(dur / max_len)).cast("int")).withColumn("step", dur / F.col("parts"))
    df = df.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    last = F.col("part") == F.col("parts") - 1
    start = F.col("start_sec")
    return df.withColumns({"end_sec": F.when(last, F.col("end_sec")).otherwise(start + (F.col("part") + 1) * F.col("step")), "start_sec": start + F.col("part") * F.col("step"), "cut_confidence": F.when(last, F.col("cut_confidence")), "subdivided": F.col("parts") > 1}).drop("step")


def scene_chunks(df: DataFrame, length: float, whole: float) -> DataFrame:
    """Scenes longer than ``whole`` in parts of ``length``, the last one shorter; only it keeps the cut's confidence."""
    dur = F.col("end_sec") - F.col("start_sec")
    df = df.withColumn("parts", F.when(dur <= whole, 1).otherwise(F.ceil(dur / length)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    last, start = F.col("part") == F.col("parts") - 1, F.col("start_sec")
    return df.withColumns({"end_sec": F.when(last, F.col("end_sec")).otherwise(start + (F.col("part") + 1) * length), "start_sec": start + F.col("part") * length, "cut_confidence": F.when(last, F.col("cut_confidence"))})


def frames_to_seconds(a: Column, b: Column, num: Column, den: Column, duration: Column) -> tuple[Column, Column]:
    """Seconds of frames a..b at num/den frames a second, not past the duration."""
    return F.least(a * den / num, duration), F.least((b + 1) * den / num, duration)


def words_in_windows(words: DataFrame, windows: DataFrame, keys: list[str], width: float) -> DataFrame:
    """Words with their middle in [start, end) of a window; joined on buckets of ``width`` seconds."""
    mid = (F.col("word_start") + F.col("word_end")) / 2
    w = words.withColumn("mid", mid).withColumn("bucket", F.floor(F.col("mid") / width))
    spans = windows.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start_sec") / width), F.floor(F.col("end_sec") / width))))
    return w.join(spans, [*keys, "bucket"]).where("start_sec <= mid AND mid < end_sec").drop("bucket")


def word_frame_index(mid: Column, start: Column, step: Column, n: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.floor((mid - start) / step).cast("int"), n - 1))


def window_geometry(start: Column, end: Column, fps: Column, max_frames: int, limit: Column) -> Column:
    """Frames and step of a window clamped to its track: struct(n, step); null if nothing is left."""
    e = F.least(end, limit - 0.001)
    n = F.greatest(F.lit(1), F.least(F.rint((e - start) * fps).cast("int"), F.lit(max_frames)))
    return F.when(e > start, F.struct(n.alias("n"), ((e - start) / n).alias("step")))


def frame_stamps(start: Column, n: Column, step: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: start + (i + 0.5) * step)


def sample_bins(samples: Column, start: Column, n: Column, step: Column, rate: int) -> Column:
    """n arrays of equal width from round((start + i step) rate) on, padded with zeros."""
    width = F.rint(step * rate).cast("int")

    def one(i: Column) -> Column:
        a = F.rint((start + i * step) * rate).cast("int")
        own = F.slice(samples, a + 1, F.greatest(width, F.lit(0)))
        return F.concat(own, F.array_repeat(F.lit(0.0), width - F.size(own)))

    return F.transform(F.sequence(F.lit(0), n - 1), one)


def bins_of_chunks(chunks: DataFrame, bins: DataFrame, keys: list[str], block: int = 16_000) -> DataFrame:
    """Samples of bins out of a recording that is kept as chunks: the bins with ``own``, padded with zeros.

    ``chunks``: keys, ``offset`` (number of the first sample) and ``samples``; ``bins``: keys, ``i``, ``first`` and
    ``width`` in samples.  Chunks of any length meet bins by blocks of ``block`` samples, and each pair in the
    first block they share, so no recording is ever one value; a bin's parts are joined in order.  Bins past the end
    are all zeros.
    """
    span = lambda first, n: F.sequence(F.floor(first / block), F.floor(F.greatest(first + n - 1, first) / block))
    c = chunks.where(F.size("samples") > 0).withColumns({"__loom_end": F.col("offset") + F.size("samples"), "__loom_block": F.explode(span(F.col("offset"), F.size("samples")))})
    b = bins.withColumn("__loom_block", F.explode(span(F.col("first"), F.col("width"))))
    start, end = F.greatest("first", "offset"), F.least(F.col("first") + F.col("width"), F.col("__loom_end"))
    met = b.join(c, [*keys, "__loom_block"]).where((start < end) & (F.floor(start / block) == F.col("__loom_block")))
    parts = met.select(*keys, "i", start.alias("at"), F.slice("samples", (start - F.col("offset") + 1).cast("int"), (end - start).cast("int")).alias("part"))
    found = parts.groupBy(*keys, "i").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "part"))), lambda p: p["part"])).alias("__loom_own"))
    out = bins.join(found, [*keys, "i"], "left")
    own = F.coalesce("__loom_own", F.array().cast("array<double>"))
    return out.withColumn("own", F.concat(own, F.array_repeat(F.lit(0.0), (F.col("width") - F.size(own)).cast("int")))).drop("__loom_own")


def sample_window(samples: Column, start: Column, end: Column, rate: int) -> Column:
    a = F.greatest(F.rint(start * rate), F.lit(0)).cast("int")
    return F.slice(samples, a + 1, F.greatest(F.rint(end * rate).cast("int") - a, F.lit(0)))


def context_windows(df: DataFrame, keys: list[str], frames: str, size: int = 100, keep: int = 50) -> DataFrame:
    """Overlapping windows of ``size`` frames, padded by the first and last frame, ``keep`` apart."""
    pad = (size - keep) // 2
    df = df.withColumn("w", F.explode(F.sequence(F.lit(0), F.ceil(F.size(frames) / keep).cast("int") - 1)))
    at = lambda i: F.element_at(F.col(frames), F.greatest(F.lit(1), F.least(F.col("w") * keep - pad + i + 1, F.size(frames))))
    return df.withColumn("window", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), at))
