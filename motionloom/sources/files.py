"""File sources: pose predictions, annotations, labels, manifests, scenes, through Spark's readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as Z
from ..work import Folder

INSTANCE = "struct<keypoints:array<array<double>>,keypoint_scores:array<double>,bbox:array<array<double>>,bbox_score:double>"
FRAME = f"struct<frame_id:int,instances:array<{INSTANCE}>>"
_LIST = f"array<{FRAME}>"
#: Bytes from which a pose file is read in pieces.
CUT = 8 << 20


def _texts(spark: SparkSession, path: str, glob: str, **how: bool | str) -> DataFrame:
    """Text of all files with their path and size; a condition on these leaves out files before they are read."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, **how)
    return raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"))


def _lines(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """Lines of all files with their place: file, block (offset of the part of the file) and place (rising within it).

    Files are split as Spark splits them, so a file of any size is many tasks' work.
    """
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), F.col("value").alias("text"))


def frame_number(file: Column, last_run: bool = False) -> Column:
    """All digits of a file's name as a number, or its last run of digits."""
    name = F.element_at(F.split(file, "/"), -1)
    digits = F.regexp_extract(name, r"(\d+)\D*$", 1) if last_run else F.regexp_replace(name, r"\D", "")
    return digits.try_cast("long")


def _layout(text: Column) -> tuple[Column, Column]:
    """Of a whole text: whether it is one frame, and its list of frames as text."""
    in_object = lambda key: F.when(~F.ltrim(text, F.lit(" \t\r\n")).startswith("["), F.get_json_object(text, key))
    single = in_object("$.instances").isNotNull()
    return single, F.coalesce(in_object("$.instance_info"), F.when(single, F.concat(F.lit("["), text, F.lit("]"))).otherwise(text))


def _cut(pieces: DataFrame) -> tuple[DataFrame, list[str]]:
    """Frames of files that were cut at the ids, and the files to which that does not do justice.

    A piece of a list is a frame and the brace that opens the next; the last one closes the list.  The text before the
    first id and the last piece are a file of one frame: if that reads as a list, and each other piece is one
    frame, the frames are those of the whole file.  Ids elsewhere, or not a frame's first key, break this.
    """
    opens = r",\s*\{\s*$"
    begins, more = F.col("value").rlike(r"^\s*:"), F.col("value").rlike(opens)
    body = F.concat(F.lit('[{"frame_id"'), F.regexp_replace("value", opens, ""), F.when(more, "]").otherwise(""))
    rows = pieces.select("file", "size", "value", begins.alias("begins"), (begins & ~more).alias("last"), F.when(begins, F.from_json(body, _LIST)).alias("f"))
    ends = rows.select(
        "file", "begins", "last", (~F.col("begins") | F.coalesce(F.size("f") == 1, F.lit(False))).alias("one"),
        F.when(~F.col("begins"), F.col("value")).alias("head"), F.when(F.col("last"), F.col("value")).alias("tail"), F.when(F.col("last"), F.col("f")).alias("f"),
    )
    files = ends.groupBy("file").agg(F.min("one").alias("one"), F.count_if(~F.col("begins")).alias("heads"), F.count_if("last").alias("tails"), F.max("head").alias("head"), F.max("tail").alias("tail"), F.max_by("f", F.col("last").cast("int")).alias("f"))
    single, listed = _layout(F.concat("head", F.lit('"frame_id"'), "tail"))
    fits = F.col("one") & (F.col("heads") == 1) & (F.col("tails") == 1) & ~single & (F.from_json(listed, _LIST) == F.col("f"))
    odd = [r["file"] for r in files.where(~F.coalesce(fits, F.lit(False))).select("file").collect()]
    return rows.where("begins").select("file", F.col("f")[0].alias("f")), odd


def scan_pose_json(spark: SparkSession, path: str, video: str = r"/([^/]+)/pred/[^/]+$", glob: str = "*.json") -> DataFrame:
    """video, file, frame_id, instances from a whole-file list, a wrapped dict or one file per frame.

    Frames of per-frame files are numbered 0.. by the number in the file's name.  Lists of more than ``CUT`` bytes are cut
    at the frames' ids and are many tasks' work, whatever their size; where that does not give what the whole text
    gives, and for other files, a file is one text of at most 2 GB.  Large files are looked at when this is called.
    """
    name = F.regexp_extract("file", video, 1).alias("video")
    cut, odd = _cut(_texts(spark, path, glob, lineSep='"frame_id"').where(F.col("size") > CUT))
    listed = cut.where(~F.col("file").isin(odd)).select(name, "file", "f.*")
    whole = _texts(spark, path, glob, wholetext=True).where((F.col("size") <= CUT) | F.col("file").isin(odd))
    # The layout is a column of the file, below the explode: beside it, it would be looked for in the whole text again for every frame.
    single, listing = _layout(F.col("value"))
    rows = whole.select(name, "file", single.alias("single"), listing.alias("text")).select("video", "file", "single", F.posexplode(F.from_json("text", _LIST)).alias("pos", "f"))
    place = F.row_number().over(Window.partitionBy("video").orderBy(frame_number(F.col("file")), "pos")) - 1
    numbered = rows.where("single").select("video", "file", place.alias("frame_id"), "f.instances")
    return listed.unionByName(rows.where(~F.col("single")).select("video", "file", "f.*")).unionByName(numbered)


def scan_pose_frames(spark: SparkSession, path: str, video: str = r"/([^/]+)/pred/[^/]+$", glob: str = "*.json") -> DataFrame:
    """video, file, frame_id, instances of files that are one list of frames, bare or wrapped, of any size.

    Files are cut where a frame's id begins, as others are at line ends: Spark splits a file by bytes into
    as many tasks as it likes, and a task holds one frame at a time.  The id must be a frame's first key, as
    pose tools write it, and stand nowhere else; a file written otherwise is an error, and so is a cut frame.
    """
    pieces = _texts(spark, path, glob, lineSep='"frame_id"')
    kind = FRAME.replace("struct<", "struct<broken:string,", 1)
    frame = F.from_json(F.concat(F.lit('{"frame_id"'), "value"), kind, {"columnNameOfCorruptRecord": "broken"})
    begins = F.col("value").rlike(r"^\s*:")
    wrong = lambda why: F.raise_error(F.concat(F.lit(f"{why} in "), "file"))
    read = F.when(begins, frame).when(F.col("value").contains('"instances"'), wrong("frames that do not begin with their id").cast(kind))
    rows = pieces.where(begins | F.col("value").contains('"instances"')).select(F.regexp_extract("file", video, 1).alias("video"), "file", read.alias("f"))
    whole = F.when(F.col("f.broken").isNotNull(), wrong("a frame that ends early").cast("int")).otherwise(F.col("f.frame_id"))
    return rows.select("video", "file", whole.alias("frame_id"), "f.instances")


def scan_pose_segments(spark: SparkSession, path: str, **where: str) -> DataFrame:
    """Segment files of each recording one after the other; ids that restart continue from the last."""
    rows = scan_pose_json(spark, path, **where)
    files = rows.groupBy("video", "file").agg(F.min("frame_id").alias("lo"), F.max("frame_id").alias("hi"))
    folded = files.groupBy("video").agg(F.sort_array(F.collect_list(F.struct("file", "lo", "hi"))).alias("s"))  # some hundred files
    state = "named_struct('top', cast(-1 AS long), 'out', cast(array() AS array<struct<file:string,shift:bigint>>))"
    shift = "if(x.lo <= a.top, a.top + 1 - x.lo, 0L)"
    step = f"aggregate(s, {state}, (a, x) -> named_struct('top', x.hi + {shift}, 'out', array_append(a.out, named_struct('file', x.file, 'shift', {shift}))), a -> a.out)"
    shifts = folded.select("video", F.expr(f"inline({step})"))
    return rows.join(shifts, ["video", "file"]).select("video", (F.col("frame_id") + F.col("shift")).alias("frame_id"), "instances")


def instance_points(instances: DataFrame) -> DataFrame:
    """video, frame_id, person, kp, x, y, score: one row a point; people with fewer than 17 are left out."""
    people = instances.select("video", "frame_id", F.posexplode("instances").alias("person", "i")).where("size(i.keypoints) >= 17")
    points = people.select("video", "frame_id", "person", F.posexplode(F.arrays_zip("i.keypoints", "i.keypoint_scores")).alias("kp", "p")).where("kp < 17")
    return points.select("video", "frame_id", "person", "kp", F.get("p.keypoints", 0).alias("x"), F.get("p.keypoints", 1).alias("y"), F.coalesce(F.col("p.keypoint_scores"), F.get("p.keypoints", 2), F.lit(1.0)).alias("score"))


def scan_jsonl_tolerant(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    """file, block, place, v (variant): blank and malformed lines are skipped; (file, block, place) is the lines' order."""
    return _lines(spark, path, glob).withColumn("v", F.try_parse_json("text")).where("v IS NOT NULL").drop("text")


def quarantine(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    """The malformed lines that ``scan_jsonl_tolerant`` skips, with their place."""
    return _lines(spark, path, glob).where((Z.strip(F.col("text")) != "") & F.try_parse_json("text").isNull())


def scan_csv_labels(spark: SparkSession, path: str) -> DataFrame:
    """Label windows in seconds; rows without a video id are dropped (see ``labels_without_id``)."""
    raw = spark.read.csv(path, header=True).withColumn("id", Z.short_id(F.col("url")))
    sec = lambda a: F.col(f"{a}_min").try_cast("double") * 60 + F.col(f"{a}_sec").try_cast("double")
    return raw.where("id IS NOT NULL").select("video_number", "id", sec("start").alias("start_sec"), sec("end").alias("end_sec"))


def labels_without_id(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True).where(Z.short_id(F.col("url")).isNull())


def scan_windows_csv(spark: SparkSession, path: str) -> DataFrame:
    """Label windows with both times numeric and end after start."""
    return scan_csv_labels(spark, path).where("start_sec IS NOT NULL AND end_sec > start_sec")


def scan_tsv_manifest(spark: SparkSession, path: str, glob: str = "*.tsv") -> DataFrame:
    """id, title, duration (NA: null), url; short rows skipped, the last row of an id wins."""
    cells = _lines(spark, path, glob).withColumn("c", F.split("text", "\t")).where("size(c) >= 4")
    rows = cells.select("file", "block", "place", F.col("c")[0].alias("id"), F.col("c")[1].alias("title"), F.col("c")[2].try_cast("double").alias("duration"), F.col("c")[3].alias("url"))
    return rows.groupBy("id").agg(F.max_by(F.struct("title", "duration", "url"), F.struct("file", "block", "place")).alias("r")).select("id", "r.*")


def scan_scenes_tree(spark: SparkSession, path: str, glob: str = "scenes.csv", video: str = r"/([^/]+)/scenes\.csv$") -> DataFrame:
    """Scene rows of every <video>/scenes.csv, with the video from the folder's name."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).csv(path, header=True, schema="split string, start double, end double, duration double, cut_confidence double")
    return df.withColumn("video_id", F.regexp_extract(F.col("_metadata.file_path"), video, 1))


def scan_legacy_peaks(spark: SparkSession, path: str) -> DataFrame:
    """Nested peak tables, kept as Parquet files."""
    return spark.read.parquet(path)


def scenes_missing(spark: SparkSession, path: str, glob: str = "scenes.csv") -> DataFrame:
    """video_id of every folder below ``path`` that no scene file was found in."""
    folders = spark.createDataFrame([(n,) for n in Folder(spark, path).folders()], "video_id string")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select(F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1).alias("video_id"))
    return folders.join(files, "video_id", "left_anti")


def status_registry(spark: SparkSession, path: str) -> DataFrame:
    """name, size and source of the lines ``name | size | source`` of text files; other lines are no entries."""
    cells = F.transform(F.split("value", r"\|"), Z.strip)
    return spark.read.text(path).select(cells.alias("c")).where(F.size("c") == 3).select(*[F.col("c")[k].alias(n) for k, n in enumerate(("name", "size", "source"))])
