"""Tracks of several people: overlap linking, body proportions, priors, selection and counting."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from .order_statistics import exact_quantiles
from .ordered import batched, frames_of, in_order

#: The three body proportions.
RATIOS = ["r_head", "r_arm", "r_leg"]


def iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of two boxes (x1, y1, x2, y2)."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    return F.coalesce(w * h / F.nullif(area(a) + area(b) - w * h, F.lit(0.0)), F.lit(0.0))


def weak_match(a: list[Column], b: list[Column]) -> Column:
    """0.15 for boxes of like size whose centres lie within half the mean box's diagonal, else 0."""
    wa, ha, wb, hb = a[2] - a[0], a[3] - a[1], b[2] - b[0], b[3] - b[1]
    apart = F.hypot((a[0] + a[2]) / 2 - (b[0] + b[2]) / 2, (a[1] + a[3]) / 2 - (b[1] + b[3]) / 2)
    like = F.greatest(wa * ha, wb * hb) <= 4 * F.greatest(F.least(wa * ha, wb * hb), F.lit(1e-6))
    return F.when((F.least(wa, ha, wb, hb) > 0) & like & (apart < 0.5 * F.hypot((wa + wb) / 2, (ha + hb) / 2)), 0.15).otherwise(0.0)


def bbox_unwrap(box: Column) -> Column:
    """The first four numbers of [[...]] or [...], from JSON text."""
    inner = F.regexp_replace(box, r"[\[\]\s]", "")
    return F.slice(F.transform(F.split(inner, ","), lambda x: x.try_cast("double")), 1, 4)


def body_ratios(df: DataFrame) -> DataFrame:
    """Head, arm and leg over torso length per person and frame; null where points are missing.

    Head: ear span, else 1.9 eye spans.  Limbs: both segments, averaged over the sides there are.
    """
    at = lambda k: F.max(F.when((F.col("kp") == k) & F.col("x").isNotNull() & F.col("y").isNotNull(), F.struct("x", "y")))
    p = df.groupBy("video", "frame", "person").agg(*[at(k).alias(f"p{k}") for k in range(17)])
    dist = lambda i, j: F.hypot(F.col(f"p{i}.x") - F.col(f"p{j}.x"), F.col(f"p{i}.y") - F.col(f"p{j}.y"))
    mid = lambda i, j, c: (F.col(f"p{i}.{c}") + F.col(f"p{j}.{c}")) / 2
    torso = F.hypot(mid(5, 6, "x") - mid(11, 12, "x"), mid(5, 6, "y") - mid(11, 12, "y"))
    torso = F.when(torso > 1e-6, torso)
    head = F.coalesce(dist(3, 4), 1.9 * dist(1, 2))

    def limb(sides: list[tuple[int, int, int]]) -> Column:
        lens = F.filter(F.array(*[dist(a, b) + dist(b, c) for a, b, c in sides]), lambda x: x.isNotNull())
        return F.when(F.size(lens) > 0, F.aggregate(lens, F.lit(0.0), lambda s, x: s + x) / F.size(lens))

    return p.select("video", "frame", "person", (head / torso).alias("r_head"), (limb([(5, 7, 9), (6, 8, 10)]) / torso).alias("r_arm"), (limb([(11, 13, 15), (12, 14, 16)]) / torso).alias("r_leg"))


Box = tuple[float, float, float, float]


def overlap(a: Box | None, b: Box | None, threshold: float) -> float:
    """Intersection over union from ``threshold`` on; below it 0.15 for boxes of like size nearby, else 0."""
    if a is None or b is None:
        return 0.0
    wa, ha, wb, hb = a[2] - a[0], a[3] - a[1], b[2] - b[0], b[3] - b[1]
    common = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    either = wa * ha + wb * hb - common
    own = common / either if common > 0 and either > 0 else 0.0
    if own >= threshold:
        return own
    if min(wa, ha, wb, hb) <= 0 or max(wa * ha, wb * hb) > 4 * max(min(wa * ha, wb * hb), 1e-6):
        return 0.0
    apart = math.hypot((a[0] + a[2] - b[0] - b[2]) / 2, (a[1] + a[3] - b[1] - b[3]) / 2)
    return 0.15 if apart < 0.5 * math.hypot((wa + wb) / 2, (ha + hb) / 2) else 0.0


class Linker:
    """The live tracks of one recording, frame after frame; tracks that ended are not held.

    ``live`` is (track, last frame, last box) of each live track and ``made`` the number of tracks so far:
    all that a stream must keep.
    """

    def __init__(self, threshold: float = 0.3, max_gap: int = 15, live: Iterable[tuple[int, int, Box | None]] = (), made: int = 0):
        self.threshold, self.max_gap, self.live, self.made = threshold, max_gap, list(live), made

    def step(self, frame: int, boxes: list[Box | None]) -> list[int]:
        """The track of each box of a frame: best overlaps first, boxes left over start tracks."""
        self.live = [t for t in self.live if frame - t[1] <= self.max_gap]
        pairs = sorted(((overlap(t[2], b, self.threshold), i, j) for i, t in enumerate(self.live) for j, b in enumerate(boxes)), reverse=True)
        of_box: dict[int, int] = {}
        used: set[int] = set()
        for s, i, j in pairs:
            if s > 0 and j not in of_box and i not in used:
                of_box[j] = i
                used.add(i)
        out = []
        for j, box in enumerate(boxes):
            if j in of_box:
                track = self.live[of_box[j]][0]
                self.live[of_box[j]] = (track, frame, box)
            else:
                track, self.made = self.made, self.made + 1
                self.live.append((track, frame, box))
            out.append(track)
        return out


def box_of(corners: Iterable[float | None]) -> Box | None:
    """Four corners as a box; none if one is missing."""
    box = tuple(corners)
    return None if any(c is None for c in box) else box


def link_tracks(df: DataFrame, threshold: float = 0.3, max_gap: int = 15) -> DataFrame:
    """Link boxes over frames: best overlaps first, unmatched boxes start tracks, idle tracks end.

    Input: video, frame, person, x1, y1, x2, y2.  Output: video, frame, person, track.  Linking is
    sequential, so a recording is one task's work; its rows are read in order and only live tracks are held.
    """

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            linker, of = Linker(threshold, max_gap), None
            for video, frame, people in frames_of(batches):
                if video != of:
                    linker, of = Linker(threshold, max_gap), video
                for (person, *_), track in zip(people, linker.step(frame, [box_of(p[1:]) for p in people]), strict=True):
                    yield video, frame, person, track

        return batched(rows(), schema)

    kept = in_order(df.select("video", "frame", "person", "x1", "y1", "x2", "y2"), "video", ["frame", "person"])
    schema = to_arrow_schema(kept.select("video", "frame", "person").withColumn("track", F.lit(0)).schema)
    kinds = dict(df.dtypes)
    return kept.mapInArrow(link, f"video {kinds['video']}, frame {kinds['frame']}, person {kinds['person']}, track int")


def track_profiles(df: DataFrame, n_frames: DataFrame) -> DataFrame:
    """Median proportions, frames, presence and confidence of each track."""
    per = df.groupBy("video", "track").agg(*[F.percentile(r, F.lit(0.5)).alias(r) for r in RATIOS], F.countDistinct("frame").alias("n"), F.avg("score").alias("mean_conf"))
    return per.join(n_frames, "video").withColumn("presence", F.col("n") / F.greatest(F.lit(1), F.col("n_frames")))


def calibrate_prior(df: DataFrame, least_frames: int = 30, least_videos: int = 5) -> DataFrame:
    """Median over recordings of their medians, and a robust deviation, of each proportion."""
    long = df.unpivot(["video"], RATIOS, "ratio", "value").where("value IS NOT NULL")
    per = long.groupBy("video", "ratio").agg(F.percentile("value", F.lit(0.5)).alias("m"), F.count("*").alias("n")).where(F.col("n") >= least_frames)
    q = exact_quantiles(per, ["ratio"], "m", {"p05": 0.05, "p25": 0.25, "mean": 0.5, "p75": 0.75, "p95": 0.95}).where(F.col("n") >= least_videos)
    return q.select("ratio", "mean", F.greatest((F.col("p75") - F.col("p25")) / 1.349, F.lit(1e-3)).alias("sd"), F.col("n").alias("n_videos"), "p05", "p95")


def prior_cost(profiles: DataFrame, prior: DataFrame) -> DataFrame:
    """Mean squared deviation from the prior over the proportions there are; null without any."""
    long = profiles.unpivot(["video", "track"], RATIOS, "ratio", "value")
    # Three rows of prior.
    costs = long.join(F.broadcast(prior.select("ratio", "mean", "sd")), "ratio").groupBy("video", "track").agg(F.avg(((F.col("value") - F.col("mean")) / F.col("sd")) ** 2).alias("cost"), F.count("value").alias("n_terms"))
    return profiles.join(costs, ["video", "track"], "left")


def select_track(costed: DataFrame, min_presence: float, min_ratios: int, max_cost: float) -> DataFrame:
    """The track of least cost in each recording, its margin to the next, and the decision."""
    w = Window.partitionBy("video").orderBy("cost", "track")
    ok = costed.where((F.col("presence") >= min_presence) & (F.col("n_terms") >= min_ratios) & F.col("cost").isNotNull())
    best = ok.withColumns({"rn": F.row_number().over(w), "second": F.lead("cost").over(w)}).where("rn = 1")
    margin = (F.col("second") - F.col("cost")) / F.greatest(F.col("cost"), F.lit(1e-6))
    return best.select("video", "track", "cost", margin.alias("margin"), F.when(F.col("cost") > max_cost, "dropped").when(margin.isNull(), "only").otherwise("kept").alias("decision"))


def count_concurrent(members: DataFrame, n_frames: DataFrame) -> DataFrame:
    """Typical number of plausible tracks at once (half-even median, at least 1) and how often more than one."""
    per = members.groupBy("video", "frame").agg(F.countDistinct("track").alias("k"))
    out = per.groupBy("video").agg(F.percentile("k", F.lit(0.5)).alias("m"), F.count_if(F.col("k") > 1).alias("many"))
    return out.join(n_frames, "video").select("video", F.greatest(F.lit(1), F.rint("m").cast("int")).alias("n_people"), (F.col("many") / F.col("n_frames")).alias("frac_multi"))
