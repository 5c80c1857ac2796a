"""Queries of the timeline operators, over events, documents and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..engine import register
from ..functions import scalars as Z
from ..operators import segments as G
from ..operators import sequences as S
from .registry import query, table

_DOCS = "SELECT doc_id, n_chars / 37.0::DOUBLE AS dur FROM documents"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").selectExpr("doc_id", "n_chars / 37D AS dur", "n_chars", "text")


def _windows_sql(dur: str) -> str:
    return f"""w AS (SELECT doc_id, dur, (floor(dur / 10) + CASE WHEN dur - floor(dur / 10) * 10 > 0 AND (dur - floor(dur / 10) * 10 >= 2 OR floor(dur / 10) = 0) THEN 1 ELSE 0 END)::INT AS n FROM (SELECT doc_id, {dur} AS dur FROM ({_DOCS}))),
s AS (SELECT doc_id, dur, n, unnest(range(0, n))::INT AS segment_index FROM w),
win AS (SELECT doc_id, segment_index, segment_index * 10.0::DOUBLE AS start_sec, CASE WHEN segment_index = n - 1 THEN dur ELSE segment_index * 10.0::DOUBLE + 10 END AS end_sec FROM s)"""


_WIN = "SELECT doc_id, segment_index, round(start_sec, 4) AS start_sec, round(end_sec, 4) AS end_sec FROM win"


@query("fixed_windows", f"WITH {_windows_sql('dur')} {_WIN}")
def _fixed(spark: SparkSession, d: str) -> DataFrame:
    return G.fixed_windows(_docs(spark, d), "dur").select("doc_id", "segment_index", F.round("start_sec", 4).alias("start_sec"), F.round("end_sec", 4).alias("end_sec"))


@query("udtf_fixed_windows", f"WITH {_windows_sql('dur')} {_WIN}")
def _windows_function(spark: SparkSession, d: str) -> DataFrame:
    register(spark)
    _docs(spark, d).createOrReplaceTempView("loom_durations")
    rows = spark.sql("SELECT doc_id, w.* FROM loom_durations, LATERAL fixed_windows(dur, 10D, 2D) w")
    return rows.select("doc_id", "segment_index", F.round("start_sec", 4).alias("start_sec"), F.round("end_sec", 4).alias("end_sec"))


@query("fixed_windows_capped", f"WITH {_windows_sql('least(dur, 25)')} {_WIN}")
def _capped(spark: SparkSession, d: str) -> DataFrame:
    return G.fixed_windows(_docs(spark, d), "dur", cap=25.0).select("doc_id", "segment_index", F.round("start_sec", 4).alias("start_sec"), F.round("end_sec", 4).alias("end_sec"))


_SCORES = "sc AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS frame, (value % 10) / 10 AS score FROM events)"


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").selectExpr("user_id", "row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS frame", "(value % 10) / 10 AS score")


_RUNS = """cuts AS (SELECT *, score > 0.7 AS cut, lag(score > 0.7) OVER (PARTITION BY user_id ORDER BY frame) AS was FROM sc),
rn AS (SELECT *, sum(CASE WHEN row_number = 1 OR (NOT cut AND was) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY frame) AS run FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY frame) AS row_number FROM cuts)),
runs AS (SELECT user_id, run::BIGINT AS run, min(frame) AS start_frame, max(frame) AS end_frame FROM rn WHERE NOT cut OR NOT coalesce(was, true) GROUP BY 1, 2
  UNION ALL SELECT user_id, 1, min(frame), max(frame) FROM cuts GROUP BY 1 HAVING bool_and(cut))"""


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return G.shot_runs(_scores(spark, d), ["user_id"], "frame", "score", 0.7)


@query("runs_below_threshold", f"WITH {_SCORES}, {_RUNS} SELECT user_id, run, start_frame, end_frame FROM runs")
def _below(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d).select("user_id", "run", F.col("start_frame").cast("long").alias("start_frame"), F.col("end_frame").cast("long").alias("end_frame"))


_CONF = f"WITH {_SCORES}, {_RUNS}, nx AS (SELECT *, lead(start_frame) OVER (PARTITION BY user_id ORDER BY start_frame) AS nxt FROM runs), conf AS (SELECT n.user_id, n.run, any_value(n.start_frame) AS start_frame, any_value(n.end_frame) AS end_frame, max(score) AS cut_confidence FROM nx n LEFT JOIN sc s ON s.user_id = n.user_id AND s.frame BETWEEN n.end_frame AND n.nxt GROUP BY 1, 2)"


def _scenes(spark: SparkSession, d: str) -> DataFrame:
    """Scenes in seconds at 4 frames a second, with the confidence of their cuts."""
    conf = G.cut_confidence(_runs(spark, d), _scores(spark, d), ["user_id"], "frame", "score")
    return conf.selectExpr("user_id", "run", "start_frame / 4D AS start_sec", "(end_frame + 1) / 4D AS end_sec", "cut_confidence")


_SECONDS = _CONF + ", scenes AS (SELECT user_id, run, start_frame / 4.0::DOUBLE AS start_sec, (end_frame + 1) / 4.0::DOUBLE AS end_sec, cut_confidence FROM conf)"


@query("scene_cut_conf", f"{_CONF} SELECT user_id, run, round(cut_confidence, 6) AS cut_confidence FROM conf")
def _cut(spark: SparkSession, d: str) -> DataFrame:
    return _scenes(spark, d).select("user_id", "run", F.round("cut_confidence", 6).alias("cut_confidence"))


@query("frames_to_seconds", f"{_CONF} SELECT user_id, run, round(least(start_frame * 1001.0::DOUBLE / 30000, 1.5), 6) AS start_sec, round(least((end_frame + 1) * 1001.0::DOUBLE / 30000, 1.5), 6) AS end_sec FROM conf")
def _seconds(spark: SparkSession, d: str) -> DataFrame:
    s, e = G.frames_to_seconds(F.col("start_frame"), F.col("end_frame"), F.lit(30000.0), F.lit(1001.0), F.lit(1.5))
    return _runs(spark, d).select("user_id", "run", F.round(s, 6).alias("start_sec"), F.round(e, 6).alias("end_sec"))


# Least length 1.1 s: many first scenes are short alone and long enough with what joins them.
@query(
    "merge_runts",
    f"""{_SECONDS}, g AS (SELECT *, end_sec - start_sec < 1.1 AS short, row_number() OVER (PARTITION BY user_id ORDER BY start_sec) AS rn FROM scenes), h AS (SELECT *, sum(CASE WHEN rn = 1 OR NOT short THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY start_sec) AS grp FROM g),
    m AS (SELECT user_id, grp, min(start_sec) AS s, max(end_sec) AS e FROM h GROUP BY 1, 2), f AS (SELECT user_id, e - s < 1.1 AS fold FROM m WHERE grp = 1)
    SELECT user_id, round(min(start_sec), 4) AS start_sec, round(max(end_sec), 4) AS end_sec, round(arg_max_null(cut_confidence, start_sec), 6) AS cut_confidence, count(*) - 1 AS merged_runts FROM (SELECT h.* REPLACE (CASE WHEN fold AND grp = 2 THEN 1 ELSE grp END AS grp) FROM h JOIN f USING (user_id)) GROUP BY user_id, grp""",
)
def _runts(spark: SparkSession, d: str) -> DataFrame:
    m = G.merge_runts(_scenes(spark, d), ["user_id"], 1.1)
    return m.select("user_id", F.round("start_sec", 4).alias("start_sec"), F.round("end_sec", 4).alias("end_sec"), F.round("cut_confidence", 6).alias("cut_confidence"), "merged_runts")


@query(
    "merge_weak_cuts",
    f"""{_SECONDS}, g AS (SELECT *, NOT coalesce(lag(cut_confidence) OVER (PARTITION BY user_id ORDER BY start_sec) < 0.85, false) AS strong, row_number() OVER (PARTITION BY user_id ORDER BY start_sec) AS rn FROM scenes), h AS (SELECT *, sum(CASE WHEN rn = 1 OR strong THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY start_sec) AS grp FROM g)
    SELECT user_id, round(min(start_sec), 4) AS start_sec, round(max(end_sec), 4) AS end_sec, count(*) - 1 AS low_conf_merges FROM h GROUP BY user_id, grp""",
)
def _weak(spark: SparkSession, d: str) -> DataFrame:
    return G.merge_weak_cuts(_scenes(spark, d), ["user_id"], 0.85).select("user_id", F.round("start_sec", 4).alias("start_sec"), F.round("end_sec", 4).alias("end_sec"), "low_conf_merges")


# Scenes of exactly 1.25 s, and some longer by less than the tolerance.
@query(
    "subdivide_equal",
    f"{_SECONDS}, o AS (SELECT * REPLACE (end_sec + CASE WHEN user_id % 2 = 0 THEN 4e-7::DOUBLE ELSE 0 END AS end_sec) FROM scenes), n AS (SELECT *, CASE WHEN end_sec - start_sec <= 1.25 + 1e-6 THEN 1 ELSE ceil((end_sec - start_sec) / 1.25) END::INT AS parts FROM o), p AS (SELECT *, unnest(range(0, parts))::INT AS part FROM n) SELECT user_id, run, part, parts, round(start_sec + part * ((end_sec - start_sec) / parts), 5) AS start_sec, round(CASE WHEN part = parts - 1 THEN end_sec ELSE start_sec + (part + 1) * ((end_sec - start_sec) / parts) END, 5) AS end_sec, round(CASE WHEN part = parts - 1 THEN cut_confidence END, 6) AS cut_confidence, parts > 1 AS subdivided FROM p",
)
def _sub(spark: SparkSession, d: str) -> DataFrame:
    s = G.subdivide_equal(_scenes(spark, d).withColumn("end_sec", F.expr("end_sec + if(user_id % 2 = 0, 4e-7D, 0D)")), 1.25)
    return s.select("user_id", "run", "part", "parts", F.round("start_sec", 5).alias("start_sec"), F.round("end_sec", 5).alias("end_sec"), F.round("cut_confidence", 6).alias("cut_confidence"), "subdivided")


@query(
    "scene_chunks",
    f"{_SECONDS}, n AS (SELECT *, CASE WHEN end_sec - start_sec <= 1.5 THEN 1 ELSE ceil((end_sec - start_sec) / 1.0)::INT END AS parts FROM scenes), p AS (SELECT *, unnest(range(0, parts))::INT AS part FROM n) SELECT user_id, run * 100 + part AS segment_key, round(start_sec + part, 4) AS start_sec, round(CASE WHEN part = parts - 1 THEN end_sec ELSE start_sec + part + 1 END, 4) AS end_sec, round(CASE WHEN part = parts - 1 THEN cut_confidence END, 6) AS cut_confidence FROM p",
)
def _chunks(spark: SparkSession, d: str) -> DataFrame:
    s = G.scene_chunks(_scenes(spark, d), 1.0, 1.5)
    return s.select("user_id", Z.segment_key(F.col("run"), F.col("part")).alias("segment_key"), F.round("start_sec", 4).alias("start_sec"), F.round("end_sec", 4).alias("end_sec"), F.round("cut_confidence", 6).alias("cut_confidence"))


@query("scene_start_cap", f"{_SECONDS} SELECT user_id, run FROM scenes WHERE start_sec < 5")
def _cap(spark: SparkSession, d: str) -> DataFrame:
    return _scenes(spark, d).where("start_sec < 5").select("user_id", "run")


@query("agg_split_stats", f"{_SECONDS}, l AS (SELECT user_id, list_sort(list(end_sec - start_sec)) AS s FROM scenes GROUP BY 1) SELECT user_id, len(s) AS n, round(s[1], 4) AS least, round(s[len(s)], 4) AS most, round(s[len(s) // 2 + 1], 4) AS upper_median FROM l")
def _split_stats(spark: SparkSession, d: str) -> DataFrame:
    # Upper median by rank, without gathering a group in one array.
    s = _scenes(spark, d).withColumn("v", F.col("end_sec") - F.col("start_sec"))
    ranked = s.select("user_id", "v", F.row_number().over(Window.partitionBy("user_id").orderBy("v")).alias("rn"), F.count("*").over(Window.partitionBy("user_id")).alias("n"))
    return ranked.groupBy("user_id").agg(F.max("n").alias("n"), F.round(F.min("v"), 4).alias("least"), F.round(F.max("v"), 4).alias("most"), F.round(F.max(F.expr("if(rn = n div 2 + 1, v, null)")), 4).alias("upper_median"))


_WORDS = "ww AS (SELECT doc_id, unnest(range(0, 12)) AS i, n_chars FROM documents), words AS (SELECT doc_id, i, i * (n_chars % 17 + 3) / 4.0::DOUBLE AS word_start, i * (n_chars % 17 + 3) / 4.0::DOUBLE + (i % 3) AS word_end FROM ww)"


def _words(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).selectExpr("doc_id", "n_chars", "explode(sequence(0L, 11L)) AS i").selectExpr("doc_id", "i", "i * (n_chars % 17 + 3) / 4D AS word_start", "i * (n_chars % 17 + 3) / 4D + (i % 3) AS word_end")


@query("join_words_midpoint", f"WITH {_windows_sql('dur')}, {_WORDS} SELECT w.doc_id, segment_index, i FROM words w JOIN win v ON w.doc_id = v.doc_id AND start_sec <= (word_start + word_end) / 2 AND (word_start + word_end) / 2 < end_sec")
def _mid(spark: SparkSession, d: str) -> DataFrame:
    return G.words_in_windows(_words(spark, d), G.fixed_windows(_docs(spark, d), "dur"), ["doc_id"], 10.0).select("doc_id", "segment_index", "i")


@query("word_frame_index", f"WITH {_WORDS} SELECT doc_id, i, greatest(0, least(floor(((word_start + word_end) / 2 - 1) / 0.5)::INT, 19)) AS frame FROM words")
def _frame_index(spark: SparkSession, d: str) -> DataFrame:
    mid = (F.col("word_start") + F.col("word_end")) / 2
    return _words(spark, d).select("doc_id", "i", G.word_frame_index(mid, F.lit(1.0), F.lit(0.5), F.lit(20)).alias("frame"))


_GEO = "SELECT doc_id, 1.5::DOUBLE AS s, least(dur / 2, dur - 0.001) AS e FROM (" + _DOCS + ")"


@query("window_geometry", f"SELECT doc_id, CASE WHEN e > s THEN greatest(1, least(round_even((e - s) * 2, 0)::INT, 64)) END AS n, round(CASE WHEN e > s THEN (e - s) / greatest(1, least(round_even((e - s) * 2, 0)::INT, 64)) END, 6) AS step FROM ({_GEO})")
def _geometry(spark: SparkSession, d: str) -> DataFrame:
    g = G.window_geometry(F.lit(1.5), F.col("dur") / 2, F.lit(2.0), 64, F.col("dur"))
    return _docs(spark, d).withColumn("g", g).select("doc_id", "g.n", F.round("g.step", 6).alias("step"))


@query("frame_stamps", f"WITH g AS (SELECT doc_id, e - s AS len FROM ({_GEO}) WHERE e > s) SELECT doc_id, unnest(range(0, 4))::INT AS i, round(1.5 + (unnest(range(0, 4)) + 0.5) * (len / 4), 5) AS stamp FROM g")
def _stamps(spark: SparkSession, d: str) -> DataFrame:
    e = F.least(F.col("dur") / 2, F.col("dur") - 0.001)
    df = _docs(spark, d).withColumn("len", e - 1.5).where("len > 0").withColumn("s", G.frame_stamps(F.lit(1.5), F.lit(4), F.col("len") / 4))
    return df.select("doc_id", F.posexplode("s").alias("i", "stamp")).withColumn("stamp", F.round("stamp", 5))


_EMB = "SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS s FROM embeddings"


def _emb(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").selectExpr("vec_id", "transform(embedding, v -> cast(v AS double)) AS s")


_BIN = "WITH b AS (SELECT vec_id, s, unnest(range(0, 5))::INT AS i FROM (" + _EMB + ")), c AS (SELECT vec_id, i, list_slice(s, round_even((0.5 + i * 1.1) * 10, 0)::INT + 1, round_even((0.5 + i * 1.1) * 10, 0)::INT + 11) AS own FROM b)"


@query("audio_bins", f"{_BIN} SELECT vec_id, i, 11 AS width, round(list_sum(own), 5) AS total FROM c")
def _bins(spark: SparkSession, d: str) -> DataFrame:
    b = _emb(spark, d).withColumn("b", G.sample_bins(F.col("s"), F.lit(0.5), F.lit(5), F.lit(1.1), 10)).select("vec_id", F.posexplode("b").alias("i", "own"))
    return b.select("vec_id", "i", F.size("own").alias("width"), F.round(F.aggregate("own", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query("join_frames_bins", f"{_BIN} SELECT vec_id, i, round(0.5 + (i + 0.5) * 1.1, 4) AS stamp, round(own[1], 5) AS first, len(own)::INT AS n FROM c")
def _frames_bins(spark: SparkSession, d: str) -> DataFrame:
    """Each frame stamp beside the samples of its own bin, zipped by place."""
    stamps, bins = G.frame_stamps(F.lit(0.5), F.lit(5), F.lit(1.1)), G.sample_bins(F.col("s"), F.lit(0.5), F.lit(5), F.lit(1.1), 10)
    b = _emb(spark, d).select("vec_id", F.posexplode(F.arrays_zip(stamps.alias("stamp"), bins.alias("own"))).alias("i", "z"))
    return b.select("vec_id", "i", F.round("z.stamp", 4).alias("stamp"), F.round(F.get("z.own", 0), 5).alias("first"), F.size("z.own").alias("n"))


def _chunk_bins(spark: SparkSession, d: str) -> DataFrame:
    """The bins of ``audio_bins`` out of recordings kept as chunks of 7 samples, blocks of 16."""
    e = _emb(spark, d)
    chunks = e.select("vec_id", F.explode(F.sequence(F.lit(0), F.size("s") - 1, F.lit(7))).alias("offset"), "s").select("vec_id", "offset", F.slice("s", F.col("offset") + 1, 7).alias("samples"))
    bins = e.select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i")).withColumns({"first": F.rint((0.5 + F.col("i") * 1.1) * 10).cast("int"), "width": F.lit(11)})
    return G.bins_of_chunks(chunks, bins, ["vec_id"], 16)


@query("audio_bins_chunked", f"{_BIN} SELECT vec_id, i, 11 AS width, round(list_sum(own), 5) AS total FROM c")
def _bins_chunked(spark: SparkSession, d: str) -> DataFrame:
    return _chunk_bins(spark, d).select("vec_id", "i", F.size("own").alias("width"), F.round(F.aggregate("own", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query("join_frames_bins_chunked", f"{_BIN} SELECT vec_id, i, round(0.5 + (i + 0.5) * 1.1, 4) AS stamp, round(own[1], 5) AS first, round(own[11], 5) AS last FROM c")
def _frames_chunked(spark: SparkSession, d: str) -> DataFrame:
    b = _chunk_bins(spark, d)
    return b.select("vec_id", "i", F.round(0.5 + (F.col("i") + 0.5) * 1.1, 4).alias("stamp"), F.round(F.get("own", 0), 5).alias("first"), F.round(F.get("own", 10), 5).alias("last"))


@query("agg_rms", f"{_BIN}, r AS (SELECT vec_id, i, sqrt(list_sum(list_transform(own, lambda v: v * v)) / 11) AS rms FROM c) SELECT vec_id, round(avg(rms), 6) AS rms_mean, round(stddev_pop(rms), 6) AS rms_std FROM r GROUP BY 1")
def _rms(spark: SparkSession, d: str) -> DataFrame:
    b = _emb(spark, d).withColumn("b", G.sample_bins(F.col("s"), F.lit(0.5), F.lit(5), F.lit(1.1), 10)).select("vec_id", F.explode("b").alias("own"))
    r = b.select("vec_id", F.sqrt(F.aggregate("own", F.lit(0.0), lambda a, x: a + x * x) / F.size("own")).alias("rms"))
    return r.groupBy("vec_id").agg(F.round(F.avg("rms"), 6).alias("rms_mean"), F.round(F.stddev_pop("rms"), 6).alias("rms_std"))


@query("audio_window", f"SELECT vec_id, round(list_sum(list_slice(s, 13, 47)), 5) AS total FROM ({_EMB})")
def _audio(spark: SparkSession, d: str) -> DataFrame:
    return _emb(spark, d).select("vec_id", F.round(F.aggregate(G.sample_window(F.col("s"), F.lit(1.2), F.lit(4.7), 10), F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query("context_windows", f"WITH c AS (SELECT vec_id, unnest(range(0, 4))::INT AS w, s FROM ({_EMB})) SELECT vec_id, w, round(list_sum(list_transform(range(0, 32), lambda i: s[greatest(1, least(w * 16 - 8 + i + 1, 64))])), 5) AS total FROM c")
def _context(spark: SparkSession, d: str) -> DataFrame:
    return G.context_windows(_emb(spark, d), ["vec_id"], "s", 32, 16).select("vec_id", "w", F.round(F.aggregate("window", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query("short_clip_filter", f"SELECT doc_id FROM ({_DOCS}) WHERE NOT (dur > 0 AND dur - 5 < 20)")
def _short(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where("NOT (dur > 0 AND dur - 5 < 20)").select("doc_id")


@query("hhmmss", f"SELECT doc_id, printf('%02d:%02d:%02d', (floor(dur)::BIGINT // 3600), (floor(dur)::BIGINT % 3600) // 60, floor(dur)::BIGINT % 60) AS t FROM (SELECT doc_id, dur * 9 AS dur FROM ({_DOCS}))")
def _hhmmss(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", Z.hhmmss(F.col("dur") * 9).alias("t"))


@query("hms_ms", "SELECT doc_id, printf('%02d:%02d:%06.3f', q // 60 // 60, q // 60 % 60, n_chars / 8.0::DOUBLE - (q // 60) * 60) AS t FROM (SELECT doc_id, n_chars, floor(n_chars / 8.0::DOUBLE)::BIGINT AS q FROM documents)")
def _hms(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", Z.hms_ms(F.col("n_chars") / 8.0).alias("t"))


@query("url_at", "SELECT page_id, CASE WHEN page_id % 5 > 0 THEN url || '&t=' || (page_id * 7 // 2)::VARCHAR || 's' END AS t FROM pages")
def _url_at(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").withColumn("u", F.expr("if(page_id % 5 > 0, url, null)"))
    return p.select("page_id", Z.url_at(F.col("u"), F.col("page_id") * 3.5).alias("t"))


@query("safe_token", "SELECT page_id, regexp_replace(url, '[^0-9A-Za-z._-]+', '_', 'g') AS t FROM pages")
def _safe(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", Z.safe_token(F.col("url")).alias("t"))


@query("yt_id_extract", "SELECT page_id, CASE WHEN page_id % 3 < 2 THEN left(md5(page_id::VARCHAR), 11) END AS id FROM pages")
def _yt(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").selectExpr("page_id", "CASE page_id % 3 WHEN 0 THEN concat('https://video.example/watch?v=', left(md5(cast(page_id AS string)), 11), '&t=3s') WHEN 1 THEN concat('https://v.example/', left(md5(cast(page_id AS string)), 11)) ELSE 'https://video.example/none' END AS u")
    return p.select("page_id", Z.short_id(F.col("u")).alias("id"))




@query(
    "collapse_consecutive_text",
    f"WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 4 >= 2 THEN 'same' ELSE role END AS said FROM conversations), s AS (SELECT *, CASE WHEN said IS DISTINCT FROM lag(said) OVER (PARTITION BY conv_id ORDER BY turn) THEN 1 ELSE 0 END AS st FROM t), g AS (SELECT *, sum(st) OVER (PARTITION BY conv_id ORDER BY turn) AS grp FROM s) SELECT conv_id, grp::BIGINT AS grp, any_value(said) AS said, min(turn) AS first_turn, max(turn) AS last_turn FROM g GROUP BY 1, 2",
)
def _collapse(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "conversations").selectExpr("conv_id", "turn", "if(turn % 4 >= 2, 'same', role) AS said")
    w = Window.partitionBy("conv_id").orderBy("turn")
    g = S.islands(t.withColumn("old", F.lag("said").over(w)), ["conv_id"], ["turn"], ~F.col("said").eqNullSafe(F.col("old")), "grp")
    return g.groupBy("conv_id", "grp").agg(F.first("said").alias("said"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))


@query("sort_time", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place FROM conversations")
def _sort_time(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))).select("conv_id", "turn", "place")


@query("agg_span_covered", "SELECT user_id, round(max(e) - min(s), 2) AS span, round(sum(e - s), 2) AS covered FROM (SELECT user_id, epoch_us(ts) / 1000000 AS s, epoch_us(ts) / 1000000 + value / 10 AS e FROM events) GROUP BY 1")
def _span(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").selectExpr("user_id", "unix_micros(cast(ts AS timestamp)) / 1000000 AS s", "value")
    e = e.withColumn("e", F.col("s") + F.col("value") / 10)
    return e.groupBy("user_id").agg(F.round(F.max("e") - F.min("s"), 2).alias("span"), F.round(F.sum(F.col("e") - F.col("s")), 2).alias("covered"))
