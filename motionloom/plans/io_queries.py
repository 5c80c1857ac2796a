"""Queries of sources, sinks and streams: files are written to the shared folder and read back."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.motion import speed
from ..sources import files as S
from ..sources import sinks as K
from ..streaming import resume as R
from ..streaming import streams as W
from ..streaming import upserts as U
from . import fixtures as X
from .motion_queries import LINKED, linking_boxes
from .registry import query, table
from .shared import materialise, place


_PTS = "array_join(transform(sequence(0, 16), k -> concat('[', e[2 * k], ',', e[2 * k + 1], ']')), ',')"


def _pose_json(spark: SparkSession, d: str, wrapped: bool) -> DataFrame:
    """Lines of one list a recording, a frame each, in order: written as they come, no recording is held as a whole."""
    inst = f"concat('{{\"frame_id\":', frame, ',\"instances\":[{{\"keypoints\":[', {_PTS}, '],\"keypoint_scores\":[', array_join(slice(e, 35, 17), ','), '],\"bbox\":[[0,0,1,1]],\"bbox_score\":0.9}}]}}')"
    last = F.lead("frame").over(Window.partitionBy("video").orderBy("frame")).isNull()
    per = X.frames(spark, d).select(F.col("video").cast("string").alias("v"), "frame", F.expr(inst).alias("j"), last.alias("last"))
    start, end = ('{"meta_info":{},"instance_info":[', "]}") if wrapped else ("[", "]")
    text = F.concat(F.when(F.col("frame") == 0, start).otherwise(","), "j", F.when(F.col("last"), end).otherwise(""))
    return per.repartition("v").sortWithinPartitions("v", "frame").select("v", text.alias("value"))


def _scan(spark: SparkSession, d: str, wrapped: bool) -> DataFrame:
    path = place(spark, "pose")
    _pose_json(spark, d, wrapped).write.partitionBy("v").text(path)
    return _points(spark, path)


def _points(spark: SparkSession, path: str, scan: Callable[..., DataFrame] = S.scan_pose_json) -> DataFrame:
    rows = scan(spark, path, video=r"/v=(\d+)/[^/]+$", glob="*.txt")
    return S.instance_points(rows).groupBy(F.col("video").cast("int").alias("video"), "kp").agg(F.count("*").alias("n"), F.round(F.sum("x"), 3).alias("sx"), F.max("frame_id").alias("last"))


_SCAN = f"WITH {X.CTE_FRAMES} SELECT video, k::INT AS kp, count(*) AS n, round(sum(e[2*k+1]), 3) AS sx, max(frame)::INT AS last FROM (SELECT *, unnest(range(0, 17)) AS k FROM frames) GROUP BY 1, 2"


@query("scan_pose_json", _SCAN)
def _pose_list(spark: SparkSession, d: str) -> DataFrame:
    return _scan(spark, d, False)


@query("scan_pose_json_wrapped", _SCAN)
def _pose_wrapped(spark: SparkSession, d: str) -> DataFrame:
    return _scan(spark, d, True)


@query("scan_pose_frames", _SCAN)
def _pose_frames(spark: SparkSession, d: str) -> DataFrame:
    """Every recording as one wrapped list, read in pieces."""
    path = place(spark, "pose")
    _pose_json(spark, d, True).write.partitionBy("v").text(path)
    return _points(spark, path, S.scan_pose_frames)


@query("scan_pose_segments", f"WITH {X.CTE_FRAMES}, n AS (SELECT video, count(*) AS n FROM frames GROUP BY 1) SELECT video, n AS n_rows, n AS n_ids, n - 1 AS last FROM n")
def _pose_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every recording as two files whose ids both start at 0."""
    path = place(spark, "segments")
    f = X.frames(spark, d)
    half = f.groupBy("video").agg(F.floor(F.count("*") / 2).alias("half"))
    cut = f.join(half, "video").selectExpr("video", "if(frame < half, 0, 1) AS seg", "if(frame < half, frame, frame - half) AS id")
    js = cut.groupBy("video", "seg").agg(F.array_join(F.transform(F.sort_array(F.collect_list("id")), lambda i: F.concat(F.lit('{"frame_id":'), i.cast("string"), F.lit(',"instances":[]}'))), ",").alias("js"))
    js.select(F.col("video").cast("string").alias("v"), F.concat(F.lit("results_seg_"), "seg").alias("s"), F.concat(F.lit("["), "js", F.lit("]")).alias("value")).write.partitionBy("v", "s").text(path)
    rows = S.scan_pose_segments(spark, path, video=r"/v=(\d+)/[^/]+/[^/]+$", glob="*.txt")
    return rows.groupBy(F.col("video").cast("int").alias("video")).agg(F.count("*").alias("n_rows"), F.countDistinct("frame_id").alias("n_ids"), F.max("frame_id").cast("long").alias("last"))


@query("scan_jsonl_tolerant", "SELECT event_id, user_id FROM events WHERE event_id % 7 > 0")
def _jsonl(spark: SparkSession, d: str) -> DataFrame:
    path = place(spark, "jsonl")
    e = table(spark, d, "events")
    e.select(F.expr("if(event_id % 7 = 0, if(event_id % 2 = 0, '', '{\"event_id\": 1'), concat('{\"event_id\": ', event_id, ', \"user_id\": ', user_id, '}'))").alias("value")).write.text(path)
    got = S.scan_jsonl_tolerant(spark, path, glob="*.txt")
    return got.selectExpr("variant_get(v, '$.event_id', 'bigint') AS event_id", "variant_get(v, '$.user_id', 'bigint') AS user_id")


_LABELS = "SELECT page_id::VARCHAR AS video_number, left(md5(page_id::VARCHAR), 11) AS id, (page_id % 9) * 60.0::DOUBLE + 1.5 AS start_sec, CASE WHEN page_id % 5 > 0 THEN (page_id % 9) * 60.0::DOUBLE + page_id % 3 END AS end_sec FROM pages WHERE page_id % 4 > 0"


def _label_files(spark: SparkSession, d: str) -> str:
    path = place(spark, "labels")
    p = table(spark, d, "pages")
    rows = p.selectExpr("page_id AS video_number", "if(page_id % 4 > 0, concat('https://v.example/watch?v=', left(md5(string(page_id)), 11)), 'none') AS url", "page_id % 9 AS start_min", "1.5 AS start_sec", "page_id % 9 AS end_min", "if(page_id % 5 > 0, string(page_id % 3), 'x') AS end_sec")
    rows.write.csv(path, header=True)
    return path


@query("scan_csv_labels", _LABELS)
def _csv(spark: SparkSession, d: str) -> DataFrame:
    return S.scan_csv_labels(spark, _label_files(spark, d))


@query("scan_windows_csv", f"SELECT * FROM ({_LABELS}) WHERE end_sec > start_sec")
def _windows(spark: SparkSession, d: str) -> DataFrame:
    return S.scan_windows_csv(spark, _label_files(spark, d))


@query("scan_tsv_manifest", "SELECT page_id::VARCHAR AS id, 'title ' || page_id AS title, CASE WHEN page_id % 3 > 0 THEN page_id * 1.5::DOUBLE END AS duration, url FROM pages WHERE page_id % 6 > 0")
def _tsv(spark: SparkSession, d: str) -> DataFrame:
    path = place(spark, "manifest")
    table(spark, d, "pages").select(F.expr("if(page_id % 6 = 0, concat(page_id, '\t', url), concat_ws('\t', string(page_id), concat('title ', page_id), if(page_id % 3 > 0, string(page_id * 1.5D), 'NA'), url))").alias("value")).write.text(path)
    return S.scan_tsv_manifest(spark, path, glob="*.txt")


@query("scan_scenes_tree", "SELECT (page_id % 5)::VARCHAR AS video_id, count(*) AS n, round(sum(page_id * 0.5), 3) AS total FROM pages GROUP BY 1")
def _scenes(spark: SparkSession, d: str) -> DataFrame:
    path = place(spark, "scenes")
    p = table(spark, d, "pages").selectExpr("string(page_id % 5) AS v", "string(page_id) AS split", "page_id * 0.5D AS start", "page_id * 0.5D + 1 AS end", "1D AS duration", "0.5D AS cut_confidence")
    p.write.partitionBy("v").csv(path, header=True)
    got = S.scan_scenes_tree(spark, path, glob="*.csv", video=r"/v=([^/]+)/[^/]+$")
    return got.groupBy("video_id").agg(F.count("*").alias("n"), F.round(F.sum("start"), 3).alias("total"))


@query("scan_scenes_missing", "SELECT DISTINCT (page_id % 5)::VARCHAR AS video_id FROM pages WHERE page_id % 5 IN (1, 3)")
def _scenes_missing(spark: SparkSession, d: str) -> DataFrame:
    """Two of five folders hold another file instead of their scenes."""
    path = place(spark, "scenes")
    p = table(spark, d, "pages").selectExpr("string(page_id % 5) AS v", "string(page_id) AS split")
    p.where("v NOT IN ('1', '3')").write.partitionBy("v").csv(path)
    p.where("v IN ('1', '3')").write.mode("append").partitionBy("v").json(path)
    return S.scenes_missing(spark, path, "*.csv").select(F.regexp_extract("video_id", "^v=(.+)$", 1).alias("video_id")).where("video_id != ''")


@query("scan_legacy_peaks", f"WITH {X.CTE_FRAMES} SELECT video, frame, round(e[1], 4) AS x, round(e[2], 4) AS y, 0.5::DOUBLE AS c, 1 AS id FROM frames")
def _peaks(spark: SparkSession, d: str) -> DataFrame:
    path = place(spark, "peaks")
    X.frames(spark, d).selectExpr("video", "frame", "array(array(struct(e[0] AS x, e[1] AS y, 0.5D AS c, 1 AS id))) AS peaks").write.parquet(path)
    peaks = S.scan_legacy_peaks(spark, path).select("video", "frame", F.explode(F.flatten("peaks")).alias("p")).select("video", "frame", "p.*")
    return peaks.withColumns({"x": F.round("x", 4), "y": F.round("y", 4)})


@query("status_registry", "SELECT n_name AS name, n_nationkey::VARCHAR AS size, r_name AS source FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 4 > 0")
def _status(spark: SparkSession, d: str) -> DataFrame:
    """A registry of nations; every fourth line is no entry."""
    path = place(spark, "registry")
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.expr("n_regionkey = r_regionkey"))
    n.selectExpr("if(n_nationkey % 4 > 0, concat(n_name, ' | ', n_nationkey, '|', r_name, ' '), concat('# ', n_name))").write.text(path)
    return S.status_registry(spark, path)


@query("sink_features", f"WITH {X.CTE_FRAMES} SELECT video, count(*) AS n, round(sum(e[1]), 4) AS s FROM frames GROUP BY 1")
def _features(spark: SparkSession, d: str) -> DataFrame:
    path = place(spark, "features")
    K.sink_features(X.frames(spark, d).select("video", "frame", F.col("e")[0].alias("f")), path)
    return spark.read.parquet(f"{path}/parquet").groupBy("video").agg(F.count("*").alias("n"), F.round(F.sum("f"), 4).alias("s"))


@query("sink_jsonl_append", "SELECT event_type, 2 * count(*) AS n FROM events GROUP BY 1")
def _append(spark: SparkSession, d: str) -> DataFrame:
    path = place(spark, "append")
    e = table(spark, d, "events").select("event_id", "event_type")
    K.sink_jsonl_append(e, path)
    K.sink_jsonl_append(e, path)
    return spark.read.schema("event_id long, event_type string").json(path).groupBy("event_type").agg(F.count("*").alias("n"))


@query("sink_flat_csv", "SELECT count(*) AS n, count(a) AS n_a, count(b) AS n_b FROM (SELECT c_name AS a, NULL AS b FROM customer UNION ALL SELECT NULL, s_name FROM supplier)")
def _flat(spark: SparkSession, d: str) -> DataFrame:
    path = place(spark, "flat")
    K.sink_flat_csv([table(spark, d, "customer").selectExpr("c_custkey AS video_id", "c_name AS a"), table(spark, d, "supplier").selectExpr("s_suppkey AS video_id", "s_name AS b")], path)
    return spark.read.csv(path, header=True).agg(F.count("*").alias("n"), F.count("a").alias("n_a"), F.count("b").alias("n_b"))


@query("sink_wide_timeseries", f"WITH {X.CTE_POSE} SELECT video, frame, round(max(CASE WHEN kp = 3 THEN x END), 4) AS x_3, round(max(CASE WHEN kp = 3 THEN score END), 4) AS score_3 FROM pose GROUP BY 1, 2")
def _wide(spark: SparkSession, d: str) -> DataFrame:
    path = place(spark, "wide")
    K.sink_wide_timeseries(speed(X.pose(spark, d), 1 / F.col("fps")), path)
    return spark.read.csv(path, header=True).selectExpr("int(video) AS video", "int(frame) AS frame", "double(x_3) AS x_3", "double(score_3) AS score_3")


@query("sink_manifest", "SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'yes' ELSE 'no' END AS downloaded FROM documents")
def _manifest(spark: SparkSession, d: str) -> DataFrame:
    path = place(spark, "manifest")
    K.sink_manifest(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id", path)
    return spark.read.csv(path, header=True).selectExpr("bigint(doc_id) AS doc_id", "downloaded")


@query("sink_atomic_cache", "SELECT count(*) AS n FROM events")
def _cache(spark: SparkSession, d: str) -> DataFrame:
    path = place(spark, "cache")
    table(spark, d, "events").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).agg(F.count("*").alias("n"))


def _parts(spark: SparkSession, d: str, closed: bool = False) -> str:
    """Events in time order as four files; ``closed`` adds a heartbeat that ends all windows."""
    path = place(spark, "events")
    events = table(spark, d, "events")
    events.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(path)
    if closed:
        W.heartbeat(events, path)
    return path


def _to_files(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    return W.run_to_files(df, place(spark, name), place(spark, f"{name}-state"))


@query("stream_fixed_windows", "SELECT epoch_us(time_bucket(INTERVAL 10 SECOND, ts)) AS start_us, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _s_windows(spark: SparkSession, d: str) -> DataFrame:
    got = _to_files(spark, W.stream_fixed_windows(W.event_stream(spark, _parts(spark, d, True), 10)), "windows")
    return got.withColumn("total", F.round("total", 4))


@query("stream_quality_feed", "SELECT epoch_us(date_trunc('hour', ts)) AS start_us, count(*) AS n, count_if(value < 5)::BIGINT AS failures, round(avg(value), 4) AS mean_value FROM events GROUP BY 1")
def _s_quality(spark: SparkSession, d: str) -> DataFrame:
    got = _to_files(spark, W.stream_quality_feed(W.event_stream(spark, _parts(spark, d, True), 10)), "quality")
    return got.withColumn("mean_value", F.round("mean_value", 4))


@query("stream_sessions", "WITH s AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER w + INTERVAL 15 MINUTE OR lag(ts) OVER w IS NULL OR ts = lag(ts) OVER w + INTERVAL 15 MINUTE THEN 1 ELSE 0 END AS st FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY ts) AS grp FROM s) SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM g GROUP BY user_id, grp")
def _s_gap(spark: SparkSession, d: str) -> DataFrame:
    return _to_files(spark, W.stream_sessions(W.event_stream(spark, _parts(spark, d, True), 10)), "sessions")


@query("stream_track_gap", LINKED)
def _s_tracks(spark: SparkSession, d: str) -> DataFrame:
    """Boxes come in six waves, a frame a second; each wave has frames that belong between those of its neighbours."""
    path = place(spark, "boxes")
    boxes = materialise(linking_boxes(spark, d).withColumn("ts", F.timestamp_seconds(F.col("frame") + 1_000_000_000)), "boxes-all")
    wave = (boxes.agg(F.max("frame")).first()[0] or 0) // 6 + 2
    for k in range(6):
        boxes.where(F.floor((F.col("frame") + F.pmod(F.col("frame") * 7, F.lit(4)) * 2) / wave) == k).write.mode("append").parquet(path)
    W.heartbeat(boxes, path)
    return _to_files(spark, W.stream_track_gap(W.event_stream(spark, path, 4), late=f"{wave + 12} seconds"), "tracks")


@query("stream_first_keys", "SELECT DISTINCT user_id, event_type FROM events")
def _s_first(spark: SparkSession, d: str) -> DataFrame:
    out = place(spark, "first")
    W.run_batches(W.event_stream(spark, _parts(spark, d)), U.first_seen(out, ["user_id", "event_type"]), place(spark, "first-state"))
    return spark.read.parquet(f"{out}/new").select("user_id", "event_type")


# A request passes unless its key has an answer or another request since its last failure.
_RESUME = """WITH e AS (SELECT user_id, event_id % 5 AS item, event_id, ts, CASE WHEN event_id % 3 > 0 THEN value >= 5 END AS ok FROM events),
s AS (SELECT *, max(coalesce(ok, false)::INT) OVER w AS done, count(*) OVER w AS rows_before, last_value(ok IS NULL) OVER w AS asked FROM e WINDOW w AS (PARTITION BY user_id, item ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT user_id, item::INTEGER AS item, event_id FROM s WHERE ok IS NULL AND (rows_before = 0 OR done = 0 AND NOT asked)"""


@query("stream_resume_keys", _RESUME)
def _s_resume(spark: SparkSession, d: str) -> DataFrame:
    """Two thirds of the events are answers; they come in three waves, after each of which the stream is started anew."""
    path, out, held = place(spark, "requests"), place(spark, "resume"), place(spark, "resume-state")
    e = table(spark, d, "events").selectExpr("user_id", "int(event_id % 5) AS item", "event_id", "ts", "if(event_id % 3 > 0, value >= 5, null) AS ok")
    bounds = e.agg(F.expr("percentile_approx(unix_micros(timestamp(ts)), array(0.34, 0.67))")).first()[0] or [0, 0]
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    got = None
    for wave in (us <= bounds[0], (us > bounds[0]) & (us <= bounds[1]), us > bounds[1]):
        e.where(wave).write.mode("append").parquet(path)
        events = W.event_stream(spark, path, 1000)
        got = W.run_to_files(R.stream_resume(events, ["user_id", "item"], "ok", "event_id", patience=timedelta(days=3650), keep=timedelta(days=3650)), out, held)
    return got.select("user_id", "item", "event_id")


_COLLAPSED = "SELECT user_id, event_id, event_type FROM events QUALIFY event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id)"


@query("stream_collapse_late", _COLLAPSED)
def _s_collapse_late(spark: SparkSession, d: str) -> DataFrame:
    """Events come in three waves, each with those of every third place in time; the watermark waits for all of them."""
    path = place(spark, "late")
    events = table(spark, d, "events")
    for wave in range(3):
        events.where(F.pmod(F.col("event_id"), F.lit(3)) == wave).write.mode("append").parquet(path)
    span = events.agg(F.expr("max(unix_seconds(timestamp(ts))) - min(unix_seconds(timestamp(ts)))")).first()[0] or 0
    W.heartbeat(events, path, f"{span + 3600} seconds")
    return _to_files(spark, W.stream_collapse_in_order(W.event_stream(spark, path, 8), "user_id", "event_type", late=f"{span + 60} seconds"), "collapsed-late")


@query("stream_collapse_text", _COLLAPSED)
def _s_collapse(spark: SparkSession, d: str) -> DataFrame:
    return _to_files(spark, W.stream_collapse_text(W.event_stream(spark, _parts(spark, d), 10), "user_id", "event_type"), "collapsed")


@query("stream_latest_wins", "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def _s_latest(spark: SparkSession, d: str) -> DataFrame:
    out = place(spark, "latest")
    W.run_batches(W.event_stream(spark, _parts(spark, d)), U.upsert_latest(out, ["user_id", "event_type"], ["ts", "event_id"], 3), place(spark, "latest-state"))
    return U.latest_of(spark, out).select("user_id", "event_type", "event_id")
