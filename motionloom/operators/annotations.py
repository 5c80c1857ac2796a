"""Annotation corpora: parsing loosely typed answers, latest records, agreement, votes, timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as Z
from .sequences import islands

#: Closed vocabularies of annotation fields.
VISIBILITY = ["full_body", "partial_body", "not_visible"]
PARTS = ["head", "face", "torso", "arms", "hands", "legs", "feet"]
ACTIONS = ["touches_object", "holds_object", "touches_face", "hand_or_object_to_mouth", "claps_hands", "crawls", "walks", "points", "pulls_to_stand", "sits_down_from_standing", "pushes_up_from_belly", "rolls_over"]
CHILD_ACTIONS = ["walks", "stands"]
POSTURES = ["sitting", "standing", "prone", "supine", "all_fours", "other", "not_visible"]
SCENE = {
    "location": ["indoor", "outdoor", "vehicle"],
    "surface": ["floor", "rug_or_mat", "bed", "sofa", "crib", "highchair", "held_by_person", "grass", "other", "not_visible"],
    "camera_distance": ["close_up", "medium", "wide"],
    "lighting": ["bright", "normal", "dim"],
    "infant_clothing": ["fully_clothed", "partially_clothed", "diaper_only", "unclothed", "not_visible"],
    "background_complexity": ["minimal", "moderate", "cluttered"],
    "camera_motion": ["static", "shaky", "panning", "moving"],
    "image_quality": ["good", "fair", "poor"],
}
AUDIO_EVENTS = ["infant_vocalisation", "infant_crying", "infant_laughing", "adult_speech", "child_speech", "singing", "music", "tv_or_device", "household_noise", "outdoor_noise", "silence"]
AUDIO_SOURCES = ["live", "overlay", "mixed", "none"]
INFANT_SOUNDS = ["infant_vocalisation", "infant_crying", "infant_laughing"]
SPEECH_SOUNDS = ["adult_speech", "child_speech"]


def parse_annotation(df: DataFrame, raw: str, audio: bool = False) -> DataFrame:
    """parse_ok and the typed fields of a raw answer; a failed parse keeps the raw text only.

    The fields about sound exist only with ``audio``.
    """
    df = df.withColumn("__loom_v", Z.extract_json_object(F.col(raw))).withColumn("parse_ok", F.col("__loom_v").isNotNull())
    v = F.col("__loom_v")
    booleans = ["has_infant", "has_adult", *(["infant_vocalising", "speech_present"] if audio else [])]
    whole, texts = ["num_infants", "num_children", "num_adults", "num_humans_total"], ["description", *(["audio_description"] if audio else [])]
    # Types and texts are columns of their own: several branches of a rule read them.
    df = df.withColumns({f"__loom_{n}_{c}": x for c in (*booleans, *whole, *texts) for n, x in zip("kt", Z.kind_and_text(v, f"$.{c}"), strict=True)})
    loose = lambda c: (F.col(f"__loom_k_{c}"), F.col(f"__loom_t_{c}"))
    fields = {c: Z.coerce_bool(*loose(c)) for c in booleans} | {c: Z.coerce_int(*loose(c)) for c in whole} | {c: F.coalesce(Z.loose_text(*loose(c)), F.lit("")) for c in texts}
    fields |= {c: Z.closed_scalar(v, f"$.{c}", words) for c, words in ({"infant_visibility": VISIBILITY, "infant_posture": POSTURES} | SCENE).items()}
    fields |= {c: Z.closed_array(v, f"$.{c}", words) for c, words in {"visible_infant_parts": PARTS, "infant_actions": ACTIONS, "child_actions": CHILD_ACTIONS}.items()}
    fields |= {"objects": Z.objects_top(v, "$.objects")}
    flags = {"inconsistent": flag_inconsistent()}
    if audio:
        fields |= {"audio_events": Z.closed_array(v, "$.audio_events", AUDIO_EVENTS), "audio_source": Z.closed_scalar(v, "$.audio_source", AUDIO_SOURCES)}
        flags |= {"audio_inconsistent": flag_audio_inconsistent()}
    ok = lambda c: F.when(F.col("parse_ok"), c)
    df = df.withColumns({k: ok(c) for k, c in fields.items()})
    return df.withColumns({k: ok(c) for k, c in flags.items()}).drop("__loom_v", *(f"__loom_{n}_{c}" for n in "kt" for c in (*booleans, *whole, *texts)))


def flag_inconsistent() -> Column:
    """Whether counts, flags and lists contradict each other; flags, never repairs."""
    has = F.col("has_infant")
    some = lambda c: F.size(c) > 0
    return (
        (has != (F.col("num_infants") > 0))
        | (F.col("has_adult") != (F.col("num_adults") > 0))
        | (~has & some("visible_infant_parts"))
        | (~has & some("infant_actions"))
        | ((F.col("num_children") == 0) & some("child_actions"))
        | (~has & ~F.col("infant_posture").eqNullSafe("not_visible"))
        | (F.col("num_humans_total") != F.col("num_infants") + F.col("num_children") + F.col("num_adults"))
    )


def flag_audio_inconsistent() -> Column:
    """Whether the fields about sound contradict each other."""
    events, source = F.col("audio_events"), F.coalesce(F.col("audio_source"), F.lit(""))
    among = lambda words: F.arrays_overlap(events, F.array(*map(F.lit, words)))
    only_silence = events == F.array(F.lit("silence"))
    return (
        (F.array_contains(events, "silence") & (F.size(events) > 1))
        | (F.col("infant_vocalising") & ~among(INFANT_SOUNDS))
        | (F.col("speech_present") & ~among(SPEECH_SOUNDS))
        | ((source == "none") & (F.size(events) > 0) & ~only_silence)
        | (source.isin("live", "overlay", "mixed") & only_silence)
    )


def pairwise_agreement(df: DataFrame, models: str, segment: str, field: str) -> DataFrame:
    """Share of segments on which two models say the same (nulls equal), for every pair of models."""
    own = df.where("parse_ok").select(segment, F.col(models).alias("model_a"), F.col(field).alias("fa"))
    other = df.where("parse_ok").select(segment, F.col(models).alias("model_b"), F.col(field).alias("fb"))
    pairs = own.join(other, segment).where("model_a < model_b")
    return pairs.groupBy("model_a", "model_b").agg(F.count_if(F.col("fa").eqNullSafe(F.col("fb"))).alias("same"), F.count("*").alias("n")).withColumn("agreement", 100 * F.col("same") / F.col("n"))


def cohort_votes(df: DataFrame, keys: list[str], model: str, matched: Column, min_models: int) -> DataFrame:
    """Models that saw and that matched each key, the matching names, where enough of them did."""
    per = df.groupBy(*keys).agg(F.countDistinct(model).alias("n_seen"), F.countDistinct(F.when(matched, F.col(model))).alias("n_matched"), F.array_join(F.sort_array(F.collect_set(F.when(matched, F.col(model).cast("string")))), ";").alias("models"))
    return per.where(F.col("n_matched") >= min_models)


def mode_vote(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The most common value of each key; on a tie the one seen first."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("votes"), F.min(order).alias("seen"))
    w = Window.partitionBy(*keys).orderBy(F.desc("votes"), "seen")
    return counts.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn", "seen")


def filter_only(df: DataFrame, column: str, values: list) -> DataFrame:
    """Rows whose column is one of the named values; all rows if none are named."""
    return df.where(F.col(column).isin(values)) if values else df


def resume(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work whose key has not been done yet."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


RECORD_KEYS = ["model", "segmentation", "video_id", "segment_index"]


def parsed_records(records: DataFrame, order: list[str]) -> DataFrame:
    """The latest parsed record of each model and segment, and ``seen``: where its key first stood.

    Records without a model are of model ?, those without a segmentation are fixed.  ``order`` are the
    columns that say where a record stands in its files.
    """
    named = records.where("parse_ok").withColumns({"model": F.coalesce(F.nullif(F.col("model"), F.lit("")), F.lit("?")), "segmentation": F.coalesce(F.nullif(F.col("segmentation"), F.lit("")), F.lit("fixed"))})
    place, rest = F.struct(*order), [c for c in named.columns if c not in RECORD_KEYS]
    best = named.groupBy(*RECORD_KEYS).agg(F.max_by(F.struct(*rest), place).alias("r"), F.min(place).alias("seen"))
    return best.select(*RECORD_KEYS, "r.*", "seen")


def cohort_manifest(records: DataFrame, order: list[str], predicate: Column, min_models: int = 1) -> DataFrame:
    """One row for each segment that enough models' records match, with who saw and who matched it.

    The fields are those of the matching model whose key was seen first, as its latest record has them.
    """
    best = parsed_records(records, order).withColumn("hit", F.coalesce(predicate, F.lit(False)))
    rest = [c for c in best.columns if c not in (*RECORD_KEYS, *order, "parse_ok", "seen", "hit")]
    names = lambda c: F.array_join(F.array_sort(F.collect_list(c)), ";")  # noqa: E731 - one name a model
    matched = F.when(F.col("hit"), F.col("model"))
    per = best.groupBy("segmentation", "video_id", "segment_index").agg(
        F.count(matched).alias("n_models_match"),
        F.count("*").alias("n_models_seen"),
        names(matched).alias("models_match"),
        names(F.col("model")).alias("models_seen"),
        F.min_by(F.struct(*rest), F.when(F.col("hit"), F.col("seen"))).alias("r"),
    )
    return per.where(F.col("n_models_match") >= F.greatest(F.lit(1), F.lit(min_models))).select("segmentation", "video_id", "segment_index", "n_models_match", "n_models_seen", "models_match", "models_seen", "r.*")


def timeline(chunks: DataFrame, keys: list[str], text: str, out: str) -> DataFrame:
    """[start-end] text, a line for each run of equal texts of a recording, in time order.

    Empty texts are left out before runs are made; a line ends where its run's last chunk ends.
    """
    w = Window.partitionBy(*keys).orderBy("start_sec", "segment_index")
    said = chunks.withColumn("__loom_t", Z.strip(F.col(text))).where("__loom_t <> ''").withColumn("__loom_old", F.lag("__loom_t").over(w))
    runs = islands(said, keys, ["start_sec", "segment_index"], ~F.col("__loom_t").eqNullSafe(F.col("__loom_old")), "__loom_run")
    at = F.struct("start_sec", "segment_index")
    lines = runs.groupBy(*keys, "__loom_run", "__loom_t").agg(F.min("start_sec").alias("a"), F.max_by("end_sec", at).alias("b"))
    line = F.concat(F.lit("["), Z.hhmmss(F.col("a")), F.lit("-"), Z.hhmmss(F.col("b")), F.lit("] "), F.col("__loom_t"))
    listed = lines.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("__loom_run", line.alias("line")))).alias("lines"))
    return listed.select(*keys, F.array_join("lines.line", "\n").alias(out))


def video_summary(records: DataFrame, order: list[str]) -> DataFrame:
    """One row for each model, segmentation and recording: chunks, span, covered time and both timelines.

    Works on the latest parsed records; a recording without any text is left out, and one without
    sound texts has a null for their timeline.  A timeline is as long as one recording's notes.
    """
    keys = ["model", "segmentation", "video_id"]
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    chunks = parsed_records(records, order).withColumns({"start_sec": zero("start_sec"), "end_sec": zero("end_sec")})
    totals = chunks.groupBy(*keys).agg(F.count("*").alias("n_chunks"), F.round(F.max("end_sec") - F.min("start_sec"), 2).alias("span_sec"), F.round(F.sum(F.col("end_sec") - F.col("start_sec")), 2).alias("covered_sec"))
    seen, heard = timeline(chunks, keys, "description", "timeline"), timeline(chunks, keys, "audio_description", "audio_timeline")
    both = totals.join(seen, keys, "left").join(heard, keys, "left").where("timeline IS NOT NULL OR audio_timeline IS NOT NULL")
    return both.withColumn("timeline", F.coalesce("timeline", F.lit("")))
