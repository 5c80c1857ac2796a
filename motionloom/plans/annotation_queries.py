"""Queries of the annotation operators: JSON assembled from events, models from lineitem, turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as Z
from ..operators import annotations as A
from ..operators import sequences as S
from .registry import query, table

# The same answers in both engines: fenced, truncated, odd types, white space, vocabulary words and strangers.
def _chosen(key: str, words: list[str], step: int) -> str:
    """A vocabulary word, odd case and white space in turn, a stranger, or a null."""
    cases = " ".join(f"WHEN {i} THEN '\"{w.upper() if i % 3 == 0 else w}' || CASE WHEN event_id % 2 = 0 THEN chr(92) || 'n\"' ELSE ' \"' END" for i, w in enumerate(words))
    return f"""', "{key}": ', CASE (event_id div {step}) % {len(words) + 2} {cases} WHEN {len(words)} THEN 'null' ELSE '"stranger"' END"""


SCALARS = {"infant_visibility": A.VISIBILITY, "infant_posture": A.POSTURES} | A.SCENE | {"audio_source": A.AUDIO_SOURCES}
LISTS = {"infant_actions": A.ACTIONS, "visible_infant_parts": A.PARTS, "child_actions": A.CHILD_ACTIONS, "audio_events": A.AUDIO_EVENTS}
RAW = f"""concat(CASE event_id % 3 WHEN 0 THEN '```json\n' WHEN 1 THEN 'Answer: ' ELSE '' END, '{{{{"has_infant": ',
  CASE event_id % 5 WHEN 0 THEN 'true' WHEN 1 THEN '"yes' || chr(92) || 't"' WHEN 2 THEN '0' WHEN 3 THEN '"false"' ELSE 'null' END, ', "num_infants": ',
  CASE event_id % 10 WHEN 0 THEN '1' WHEN 1 THEN '"2"' WHEN 2 THEN '-3' WHEN 3 THEN '2.7' WHEN 4 THEN '"2.7"' WHEN 5 THEN '1e12' WHEN 6 THEN '"+1_000' || chr(92) || 'n"' WHEN 7 THEN '"x"' WHEN 8 THEN '[1]' ELSE 'true' END,
  ', "has_adult": ', CASE event_id % 2 WHEN 0 THEN 'false' ELSE '1' END, ', "num_adults": ', cast(event_id % 3 AS {{text}}), ', "num_children": ', cast(event_id % 2 AS {{text}}), ', "num_humans_total": ', cast(event_id % 4 AS {{text}}),
  {", ".join(_chosen(k, words, n + 1) for n, (k, words) in enumerate(SCALARS.items()))}, ', "infant_actions": ', CASE event_id % 7 WHEN 0 THEN '"walks"' WHEN 1 THEN '["Walks","walks","sings",null]' WHEN 2 THEN '["crawls' || chr(92) || 'n"]' ELSE '[]' END,
  ', "visible_infant_parts": ', CASE event_id % 5 WHEN 0 THEN '["Head","wing"]' ELSE '[]' END, ', "child_actions": ', CASE event_id % 9 WHEN 0 THEN '["stands"]' ELSE '[]' END,
  ', "audio_events": ', CASE event_id % 6 WHEN 0 THEN '["silence"]' WHEN 1 THEN '["Music","silence"]' WHEN 2 THEN '["infant_crying"]' WHEN 3 THEN '["adult_speech"]' ELSE '[]' END, ', "infant_vocalising": ', CASE event_id % 4 WHEN 0 THEN 'true' ELSE 'false' END, ', "speech_present": ', CASE event_id % 8 WHEN 3 THEN '1' ELSE 'null' END,
  CASE event_id % 4 WHEN 0 THEN ', "description": "  a  child' || chr(92) || 'n"' WHEN 1 THEN ', "description": null' WHEN 2 THEN ', "audio_description": " hum "' ELSE ', "audio_description": true' END,
  CASE event_id % 4 WHEN 0 THEN ', "objects": ["a"," ","b",null,"d","e","f"]' WHEN 1 THEN ', "objects": null' ELSE '' END, CASE WHEN event_id % 11 = 0 THEN '' ELSE '}}}}' END, CASE event_id % 3 WHEN 0 THEN '\n```' ELSE '' END)"""
RAW_SPARK = RAW.replace("{{", "{").replace("}}", "}").replace("{text}", "string")
RAW_DUCK = RAW.replace("{{", "{").replace("}}", "}").replace("{text}", "VARCHAR").replace(" div ", " // ")
_WHITE = "chr(" + ") || chr(".join(str(ord(c)) for c in Z.WHITE) + ")"
_S = "json_extract_string(j, '$.{k}')"


def _strip(x: str) -> str:
    return f"trim({x}, {_WHITE})"


def _bool(k: str) -> str:
    t, s = f"json_type(j, '$.{k}')", _S.format(k=k)
    return f"CASE WHEN {t} IS NULL OR {t} = 'NULL' THEN false WHEN {t} = 'BOOLEAN' THEN {s} = 'true' WHEN {t} = 'VARCHAR' THEN lower({_strip(s)}) IN ('true', 'yes', '1') ELSE TRY_CAST({s} AS DOUBLE) <> 0 END"


def _int(k: str) -> str:
    t, s = f"json_type(j, '$.{k}')", _S.format(k=k)
    return f"greatest(0, coalesce(CASE WHEN {t} = 'VARCHAR' THEN CASE WHEN regexp_full_match({_strip(s)}, '[+-]?[0-9]+(_[0-9]+)*') THEN replace({_strip(s)}, '_', '')::BIGINT END WHEN {t} = 'BOOLEAN' THEN ({s} = 'true')::BIGINT ELSE trunc(TRY_CAST({s} AS DOUBLE))::BIGINT END, 0))"


def _text(x: str, kind: str) -> str:
    """A value as stripped text; a null is None."""
    return f"CASE {kind} WHEN 'NULL' THEN 'None' WHEN 'BOOLEAN' THEN CASE {x} WHEN 'true' THEN 'True' ELSE 'False' END ELSE {_strip(x)} END"


def _items(k: str) -> str:
    return f"CASE WHEN json_type(j, '$.{k}') = 'ARRAY' THEN list_transform(json_extract_string(j, '$.{k}[*]'), lambda x: coalesce({_strip('x')}, 'None')) ELSE [] END"


def _words(k: str, words: list[str]) -> str:
    return f"CASE WHEN j IS NOT NULL THEN list_filter(list_transform({_items(k)}, lambda x: lower(x)), lambda x: x IN ({', '.join(repr(w) for w in words)})) END"


def _word(k: str, words: list[str]) -> str:
    s = f"lower({_text(_S.format(k=k), f'''json_type(j, '$.{k}')''')})"
    return f"CASE WHEN {s} IN ({', '.join(repr(w) for w in words)}) THEN {s} END"


_TYPED = [(c, _bool(c)) for c in ("has_infant", "has_adult", "infant_vocalising", "speech_present")] + [(c, _int(c)) for c in ("num_infants", "num_children", "num_adults", "num_humans_total")]
_TYPED += [(c, f"coalesce({_text(_S.format(k=c), f'''json_type(j, '$.{c}')''')}, '')") for c in ("description", "audio_description")]
_ALIAS = {"visible_infant_parts": "parts", "audio_events": "ev"}
PARSED = f"""raws AS (SELECT event_id, {RAW_DUCK} AS raw FROM events),
tried AS (SELECT event_id, raw, TRY_CAST(nullif(regexp_extract(raw, '(?s)\\{{.*\\}}'), '') AS JSON) AS j FROM raws),
parsed AS (SELECT event_id, raw, j IS NOT NULL AS parse_ok, {", ".join(f"CASE WHEN j IS NOT NULL THEN {e} END AS {c}" for c, e in _TYPED)},
  {", ".join(f"{_word(k, words)} AS {k}" for k, words in SCALARS.items())}, {", ".join(f"{_words(k, words)} AS {_ALIAS.get(k, k)}" for k, words in LISTS.items())},
  CASE WHEN j IS NOT NULL THEN list_filter({_items("objects")}, lambda x: x <> '')[1:5] END AS objects FROM tried),
flagged AS (SELECT *, CASE WHEN parse_ok THEN has_infant <> (num_infants > 0) OR has_adult <> (num_adults > 0) OR (NOT has_infant AND (len(parts) > 0 OR len(infant_actions) > 0 OR infant_posture IS DISTINCT FROM 'not_visible')) OR (num_children = 0 AND len(child_actions) > 0) OR num_humans_total <> num_infants + num_children + num_adults END AS inconsistent,
  CASE WHEN parse_ok THEN (list_contains(ev, 'silence') AND len(ev) > 1) OR (infant_vocalising AND NOT list_has_any(ev, ['infant_vocalisation', 'infant_crying', 'infant_laughing'])) OR (speech_present AND NOT list_has_any(ev, ['adult_speech', 'child_speech']))
    OR (coalesce(audio_source, '') = 'none' AND len(ev) > 0 AND ev <> ['silence']) OR (coalesce(audio_source, '') IN ('live', 'overlay', 'mixed') AND ev = ['silence']) END AS audio_inconsistent FROM parsed)"""


def parsed(spark: SparkSession, d: str) -> DataFrame:
    return A.parse_annotation(table(spark, d, "events").selectExpr("event_id", RAW_SPARK + " AS raw"), "raw", audio=True)


@query("extract_json_object", f"WITH {PARSED} SELECT event_id, parse_ok FROM parsed")
def _extract(spark: SparkSession, d: str) -> DataFrame:
    return parsed(spark, d).select("event_id", "parse_ok")


@query("coerce_bool", f"WITH {PARSED} SELECT event_id, has_infant, has_adult FROM parsed")
def _bools(spark: SparkSession, d: str) -> DataFrame:
    return parsed(spark, d).select("event_id", "has_infant", "has_adult")


@query("coerce_int", f"WITH {PARSED} SELECT event_id, num_infants, num_adults FROM parsed")
def _ints(spark: SparkSession, d: str) -> DataFrame:
    return parsed(spark, d).select("event_id", "num_infants", "num_adults")


@query("closed_vocab_scalar", f"WITH {PARSED} SELECT event_id, infant_posture FROM parsed")
def _scalar(spark: SparkSession, d: str) -> DataFrame:
    return parsed(spark, d).select("event_id", "infant_posture")


@query("closed_vocab_array", f"WITH {PARSED} SELECT event_id, array_to_string(infant_actions, ',') AS actions FROM parsed")
def _array(spark: SparkSession, d: str) -> DataFrame:
    return parsed(spark, d).select("event_id", F.array_join("infant_actions", ",").alias("actions"))


@query("objects_top5", f"WITH {PARSED} SELECT event_id, len(objects)::INT AS n, objects[1] AS first, objects[-1] AS last FROM parsed")
def _top5(spark: SparkSession, d: str) -> DataFrame:
    return parsed(spark, d).select("event_id", F.expr("if(objects IS NULL, NULL, size(objects))").alias("n"), F.get("objects", F.lit(0)).alias("first"), F.try_element_at("objects", F.lit(-1)).alias("last"))


@query("join_list_cell", f"WITH {PARSED} SELECT event_id, array_to_string(objects, ',') AS objects FROM parsed")
def _objects(spark: SparkSession, d: str) -> DataFrame:
    return parsed(spark, d).select("event_id", F.array_join("objects", ",").alias("objects"))


@query("flag_inconsistent", f"WITH {PARSED} SELECT event_id, inconsistent FROM flagged")
def _flag(spark: SparkSession, d: str) -> DataFrame:
    return parsed(spark, d).select("event_id", "inconsistent")


@query("flag_audio_inconsistent", f"WITH {PARSED} SELECT event_id, audio_inconsistent FROM flagged")
def _audio(spark: SparkSession, d: str) -> DataFrame:
    return parsed(spark, d).select("event_id", "audio_inconsistent")


_LISTED = [*LISTS, "objects"]
_PLAIN = ["parse_ok", *(c for c, _ in _TYPED), *SCALARS, "inconsistent", "audio_inconsistent"]


@query("parse_annotation", f"WITH {PARSED} SELECT event_id, {', '.join(_PLAIN)}, {', '.join(f'''array_to_string({_ALIAS.get(k, k)}, ',') AS {k}''' for k in _LISTED)} FROM flagged")
def _parse(spark: SparkSession, d: str) -> DataFrame:
    return parsed(spark, d).select("event_id", *_PLAIN, *[F.array_join(k, ",").alias(k) for k in _LISTED])


_HAS = "(json_exists(j, '$.objects'))"


@query("key_presence", f"WITH {PARSED} SELECT event_id, CASE WHEN j IS NULL THEN false ELSE {_HAS} END AS present FROM tried")
def _present(spark: SparkSession, d: str) -> DataFrame:
    v = Z.extract_json_object(F.expr(RAW_SPARK))
    return table(spark, d, "events").select("event_id", Z.key_present(v, "$.objects").alias("present"))


@query("agg_key_presence", f"WITH {PARSED} SELECT count_if(j IS NOT NULL AND {_HAS})::BIGINT AS n_present, count_if(json_type(j, '$.objects') = 'ARRAY')::BIGINT AS n_truthy FROM tried")
def _agg_present(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(Z.extract_json_object(F.expr(RAW_SPARK)).alias("v"))
    return e.agg(F.count_if(Z.key_present(F.col("v"), "$.objects")).alias("n_present"), F.count_if(F.size(Z.objects_top(F.col("v"), "$.objects")) > 0).alias("n_truthy"))


@query("set_intersect_flags", f"WITH {PARSED} SELECT event_id, coalesce(list_has_any(infant_actions, ['walks', 'crawls']), false) AS moves FROM parsed")
def _flags(spark: SparkSession, d: str) -> DataFrame:
    return parsed(spark, d).select("event_id", F.coalesce(F.arrays_overlap("infant_actions", F.array(F.lit("walks"), F.lit("crawls"))), F.lit(False)).alias("moves"))


@query("agg_model_health", f"WITH {PARSED} SELECT event_id % 4 AS model, count(*) AS n, count_if(NOT parse_ok)::BIGINT AS failures, count_if(inconsistent)::BIGINT AS inconsistent FROM flagged GROUP BY 1")
def _health(spark: SparkSession, d: str) -> DataFrame:
    return parsed(spark, d).groupBy((F.col("event_id") % 4).alias("model")).agg(F.count("*").alias("n"), F.count_if(~F.col("parse_ok")).alias("failures"), F.count_if("inconsistent").alias("inconsistent"))


_SAME = "CASE event_id % 5 WHEN 0 THEN repeat('a', 50) WHEN 1 THEN concat(chr(10), repeat('b', 30 + event_id % 20), chr(9)) WHEN 2 THEN repeat('xy', 60) WHEN 3 THEN props ELSE '   ' END"


@query("is_degenerate", f"SELECT event_id, len(list_distinct(string_split({_strip('t')}, ''))) = 1 AND length({_strip('t')}) >= 40 AS degenerate FROM (SELECT event_id, {_SAME} AS t FROM events)")
def _degenerate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", Z.is_degenerate(F.expr(_SAME)).alias("degenerate"))


@query("failure_class", f"SELECT event_id, CASE WHEN event_id % 5 = 3 THEN CASE WHEN event_id % 2 = 0 THEN 'INCONSISTENT' ELSE 'ok' END WHEN event_id % 5 = 0 OR event_id % 5 = 1 AND event_id % 20 >= 10 THEN 'DEGENERATE' WHEN length(t) >= 100 THEN 'TRUNCATED' ELSE 'PARSE FAILED' END AS c FROM (SELECT event_id, {_SAME} AS t FROM events)")
def _failure(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", Z.failure_class(F.expr(_SAME), F.expr("event_id % 5 = 3"), F.expr("event_id % 2 = 0"), 100).alias("c"))


@query("text_strip_lower", f"SELECT doc_id, lower({_strip('text')}) AS l FROM documents")
def _lower(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.lower(Z.strip(F.col("text"))).alias("l"))


@query("text_truncate", f"SELECT doc_id, left({_strip('text')}, 90) AS t FROM documents")
def _truncate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.substring(Z.strip(F.col("text")), 1, 90).alias("t"))


@query("prompt_hash8", "SELECT doc_id, left(sha256(text), 8) AS h FROM documents")
def _hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", Z.prompt_hash8(F.col("text")).alias("h"))


@query("split_name", "SELECT page_id, 'split_' || lpad(page_id::VARCHAR, 3, '0') AS s FROM pages")
def _split_name(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", Z.split_name(F.col("page_id"), F.lit(250)).alias("s"))


@query("chunk_name", "SELECT page_id, printf('split_%02d_chunk_%02d', page_id % 90, page_id % 7) AS c FROM pages")
def _chunk_name(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", Z.chunk_name(F.col("page_id") % 90, F.col("page_id") % 7).alias("c"))


@query("segment_key", "SELECT page_id, page_id * 100 + page_id % 7 AS k FROM pages")
def _segment_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", Z.segment_key(F.col("page_id"), F.col("page_id") % 7).alias("k"))


@query("fmt_cell", "SELECT doc_id, CASE WHEN q IS NULL THEN '-' WHEN q = 0 THEN 'PARSE_FAIL' ELSE lower((doc_id % 2 = 0)::VARCHAR) END AS cell FROM (SELECT d.doc_id, l.quality AS q FROM documents d LEFT JOIN labels l USING (doc_id))")
def _fmt(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return j.select("doc_id", Z.fmt_cell(F.col("doc_id") % 2 == 0, F.col("quality") != 0).alias("cell"))


# Models over segments: the last record of (model, segment) in a total order.
_REC = "rec AS (SELECT l_suppkey % 3 AS model, l_orderkey AS seg, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS field, l_linenumber % 5 > 0 AS parse_ok, l_linenumber, l_partkey, l_extendedprice, l_quantity FROM lineitem), lat AS (SELECT * FROM rec QUALIFY row_number() OVER (PARTITION BY model, seg ORDER BY l_linenumber DESC, l_partkey DESC, l_extendedprice DESC, l_quantity DESC) = 1)"


def _rec(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr("l_suppkey % 3 AS model", "l_orderkey AS seg", "nullif(l_returnflag, 'N') AS field", "l_linenumber % 5 > 0 AS parse_ok", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")


def _latest(spark: SparkSession, d: str) -> DataFrame:
    return S.latest(_rec(spark, d), ["model", "seg"], [F.col(c) for c in ("l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")])


@query("latest_record", f"WITH {_REC} SELECT model, seg, field, parse_ok FROM lat")
def _last(spark: SparkSession, d: str) -> DataFrame:
    return _latest(spark, d).select("model", "seg", "field", "parse_ok")


_AGREE = "ag AS (SELECT a.model AS model_a, b.model AS model_b, count_if(a.field IS NOT DISTINCT FROM b.field)::BIGINT AS same, count(*) AS n FROM lat a JOIN lat b ON a.seg = b.seg AND a.model < b.model WHERE a.parse_ok AND b.parse_ok GROUP BY 1, 2)"


@query("join_pairwise_agreement", f"WITH {_REC}, {_AGREE} SELECT *, round(100.0::DOUBLE * same / n, 4) AS agreement FROM ag")
def _agree(spark: SparkSession, d: str) -> DataFrame:
    return A.pairwise_agreement(_latest(spark, d), "model", "seg", "field").withColumn("agreement", F.round("agreement", 4))


@query("agg_agreement_summary", f"WITH {_REC}, {_AGREE} SELECT round(avg(100.0::DOUBLE * same / n), 4) AS mean_pct, round(min(100.0::DOUBLE * same / n), 4) AS min_pct FROM ag")
def _summary(spark: SparkSession, d: str) -> DataFrame:
    return A.pairwise_agreement(_latest(spark, d), "model", "seg", "field").agg(F.round(F.avg("agreement"), 4).alias("mean_pct"), F.round(F.min("agreement"), 4).alias("min_pct"))


_CELLS = "max(CASE WHEN model = {m} THEN CASE WHEN parse_ok THEN coalesce(field, '-') ELSE 'PARSE_FAIL' END END)"


@query("join_models_union_segments", f"WITH {_REC}, every AS (SELECT DISTINCT seg FROM lat), ms AS (SELECT DISTINCT model FROM lat) SELECT e.seg, m.model, l.model IS NOT NULL AS seen, coalesce(l.parse_ok, false) AS ok FROM every e CROSS JOIN ms m LEFT JOIN lat l ON l.seg = e.seg AND l.model = m.model")
def _union_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every segment that any model has, with each model's record where there is one."""
    lat = _latest(spark, d).select("seg", "model", "parse_ok")
    held = lat.groupBy("seg").agg(F.map_from_entries(F.collect_list(F.struct("model", "parse_ok"))).alias("ok"))  # a few models
    models = lat.select("model").distinct().agg(F.collect_set("model").alias("models"))
    every = held.join(F.broadcast(models), F.lit(True)).select("seg", "ok", F.explode("models").alias("model"))
    return every.select("seg", "model", F.map_contains_key("ok", F.col("model")).alias("seen"), F.coalesce(F.try_element_at("ok", F.col("model")), F.lit(False)).alias("ok"))


@query("table_wide_models", f"WITH {_REC} SELECT seg, " + ", ".join(f"coalesce({_CELLS.format(m=m)}, '-') AS m{m}" for m in range(3)) + ", count(DISTINCT CASE WHEN parse_ok THEN coalesce(field, '?') END) <= 1 AS agree FROM lat GROUP BY seg")
def _wide(spark: SparkSession, d: str) -> DataFrame:
    lat = _latest(spark, d).withColumn("cell", Z.fmt_cell(F.col("field"), F.col("parse_ok")))
    cells = [F.coalesce(F.max(F.when(F.col("model") == m, F.col("cell"))), F.lit("-")).alias(f"m{m}") for m in range(3)]
    return lat.groupBy("seg").agg(*cells, (F.countDistinct(F.when(F.col("parse_ok"), F.coalesce("field", F.lit("?")))) <= 1).alias("agree"))


@query("table_long_models", f"WITH {_REC} SELECT seg, model, CASE WHEN parse_ok THEN field END AS field, CASE model WHEN 0 THEN 'native' WHEN 1 THEN 'transcript' ELSE 'none' END AS audio_mode FROM lat")
def _long(spark: SparkSession, d: str) -> DataFrame:
    mode = F.when(F.col("model") == 0, "native").when(F.col("model") == 1, "transcript").otherwise("none")
    return _latest(spark, d).select("seg", "model", F.when(F.col("parse_ok"), F.col("field")).alias("field"), mode.alias("audio_mode"))


@query("topk_disagreements", f"WITH {_REC} SELECT seg FROM lat GROUP BY seg HAVING count(DISTINCT CASE WHEN parse_ok THEN coalesce(field, '?') END) > 1 ORDER BY seg LIMIT 20")
def _topk(spark: SparkSession, d: str) -> DataFrame:
    per = _latest(spark, d).groupBy("seg").agg(F.countDistinct(F.when(F.col("parse_ok"), F.coalesce("field", F.lit("?")))).alias("n"))
    return per.where("n > 1").orderBy("seg").limit(20).select("seg")


@query("agg_cohort_votes", f"WITH {_REC} SELECT seg, count(DISTINCT model) AS n_seen, count(DISTINCT CASE WHEN field = 'R' THEN model END) AS n_matched, array_to_string(list_sort(list_distinct(list(CASE WHEN field = 'R' THEN model::VARCHAR END))), ';') AS models FROM lat GROUP BY seg HAVING count(DISTINCT CASE WHEN field = 'R' THEN model END) >= 2")
def _votes(spark: SparkSession, d: str) -> DataFrame:
    return A.cohort_votes(_latest(spark, d), ["seg"], "model", F.col("field") == "R", 2)


@query("agg_mode_vote", f"WITH {_REC}, c AS (SELECT model, coalesce(field, '-') AS value, count(*) AS votes, min(seg) AS seen FROM lat GROUP BY 1, 2) SELECT model, value, votes FROM c QUALIFY row_number() OVER (PARTITION BY model ORDER BY votes DESC, seen) = 1")
def _mode(spark: SparkSession, d: str) -> DataFrame:
    return A.mode_vote(_latest(spark, d).withColumn("value", F.coalesce("field", F.lit("-"))), ["model"], "value", "seg")


@query("agg_best_coverage", f"WITH {_REC}, c AS (SELECT seg % 100 AS grp, seg, count(DISTINCT model) AS n FROM lat GROUP BY 1, 2) SELECT grp, seg, n FROM c QUALIFY row_number() OVER (PARTITION BY grp ORDER BY n DESC, seg) = 1")
def _best(spark: SparkSession, d: str) -> DataFrame:
    c = _latest(spark, d).groupBy((F.col("seg") % 100).alias("grp"), "seg").agg(F.countDistinct("model").alias("n"))
    return c.withColumn("rn", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("n"), "seg"))).where("rn = 1").select("grp", "seg", "n")


@query("join_resume_anti", "SELECT doc_id FROM documents ANTI JOIN (SELECT doc_id FROM labels WHERE quality = 1) USING (doc_id)")
def _resume(spark: SparkSession, d: str) -> DataFrame:
    return A.resume(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").where("quality = 1"), ["doc_id"])


@query("set_except_missing", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels WHERE toxic = 1")
def _except(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id").subtract(table(spark, d, "labels").where("toxic = 1").select("doc_id"))


@query("join_missing_report", "SELECT d.lang, count(*) AS n, count_if(l.doc_id IS NULL)::BIGINT AS n_missing, min(CASE WHEN l.doc_id IS NULL THEN d.doc_id END) AS first_missing FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY 1")
def _missing(spark: SparkSession, d: str) -> DataFrame:
    there = table(spark, d, "labels").select("doc_id", F.lit(True).alias("there")).distinct()
    gone = F.col("there").isNull()
    return table(spark, d, "documents").select("doc_id", "lang").join(there, "doc_id", "left").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(gone).alias("n_missing"), F.min(F.when(gone, F.col("doc_id"))).alias("first_missing"))


@query("set_union_ids", "SELECT doc_id AS id FROM documents UNION SELECT page_id FROM pages UNION SELECT doc_id FROM labels")
def _union(spark: SparkSession, d: str) -> DataFrame:
    ids = [table(spark, d, t).select(F.col(c).alias("id")) for t, c in (("documents", "doc_id"), ("pages", "page_id"), ("labels", "doc_id"))]
    return ids[0].union(ids[1]).union(ids[2]).distinct()


@query("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def _distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").dropDuplicates()


@query("distinct_ordered", "SELECT event_type, min(event_id) AS first_at FROM events GROUP BY 1")
def _ordered(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.min("event_id").alias("first_at"))


@query("filter_limit_videos", "WITH f AS (SELECT user_id, min(event_id) AS f FROM events GROUP BY 1 ORDER BY f LIMIT 5) SELECT event_id FROM events SEMI JOIN f USING (user_id)")
def _limit_videos(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    first = e.groupBy("user_id").agg(F.min("event_id").alias("f")).orderBy("f").limit(5).select("user_id")
    return e.join(first, "user_id", "left_semi").select("event_id")


@query("filter_only", "SELECT event_id FROM events WHERE event_type IN ('click', 'view')")
def _only(spark: SparkSession, d: str) -> DataFrame:
    return A.filter_only(table(spark, d, "events"), "event_type", ["click", "view"]).select("event_id")


@query("filter_models", f"WITH {_REC} SELECT model, seg FROM lat WHERE model IN (0, 2)")
def _models(spark: SparkSession, d: str) -> DataFrame:
    return A.filter_only(_latest(spark, d), "model", [0, 2]).select("model", "seg")


@query("filter_segmentation", "SELECT doc_id FROM (SELECT d.doc_id, coalesce(CASE l.quality WHEN 0 THEN 'scenes' WHEN 1 THEN 'fixed' END, 'fixed') AS s FROM documents d LEFT JOIN labels l USING (doc_id)) WHERE s = 'fixed'")
def _segmentation(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return j.where("coalesce(CASE quality WHEN 0 THEN 'scenes' WHEN 1 THEN 'fixed' END, 'fixed') = 'fixed'").select("doc_id")


@query("filter_scoped_tokens", "WITH t(scope, tok) AS (VALUES (NULL, 1), (7, 2)) SELECT DISTINCT conv_id, turn FROM conversations JOIN t ON turn = tok AND (scope IS NULL OR conv_id = scope)")
def _scoped(spark: SparkSession, d: str) -> DataFrame:
    tokens = spark.createDataFrame([(None, 1), (7, 2)], "scope long, tok long")  # the caller's list
    c = table(spark, d, "conversations")
    return c.join(F.broadcast(tokens), F.expr("turn = tok AND (scope IS NULL OR conv_id = scope)")).select("conv_id", "turn").distinct()


@query("limit_rows", "SELECT event_id FROM events ORDER BY event_id LIMIT 25")
def _limit(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").orderBy("event_id").limit(25).select("event_id")


@query("sample_every_kth", "WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, event_id FROM r WHERE (rn - 1) % greatest(1, n // 6) = 0 AND (rn - 1) // greatest(1, n // 6) < 6")
def _kth(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "events").selectExpr("user_id", "event_id", "row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn", "count(*) OVER (PARTITION BY user_id) AS n")
    return r.where("(rn - 1) % greatest(1, n div 6) = 0 AND (rn - 1) div greatest(1, n div 6) < 6").select("user_id", "event_id")


@query("strided_assignment", "SELECT event_id, (event_id % 8)::INT AS worker FROM events")
def _strided(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.expr("int(pmod(event_id, 8))").alias("worker"))


@query("natural_sort", "SELECT 'frame2_' || page_id || '.json' AS name, page_id AS number FROM pages ORDER BY 2")
def _natural(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select(F.concat(F.lit("frame2_"), F.col("page_id"), F.lit(".json")).alias("name"))
    return p.withColumn("number", F.regexp_extract("name", r"(\d+)\D*$", 1).cast("long")).orderBy("number")


@query("round_half_even", "SELECT DISTINCT l_quantity, round_even(l_quantity / 2, 0) AS r0, round_even(l_quantity / 4, 0) AS r1 FROM lineitem")
def _half_even(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").select("l_quantity", Z.round_half_even(q / 2).alias("r0"), Z.round_half_even(q / 4).alias("r1")).distinct()


@query("to_json_record", "SELECT conv_id, '{\"conv\":' || conv_id || ',\"turns\":[' || string_agg(turn::VARCHAR, ',' ORDER BY turn) || ']}' AS js FROM (SELECT DISTINCT conv_id, turn FROM conversations) GROUP BY conv_id")
def _json(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select("conv_id", "turn").distinct().groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return c.select("conv_id", F.to_json(F.struct(F.col("conv_id").alias("conv"), "turns")).alias("js"))


@query("generic_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def _rollup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


_LINES = "rec AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey % 3, l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice, l_quantity) AS rn, count(*) OVER (PARTITION BY l_suppkey % 3, l_orderkey) AS n, l_suppkey % 3 AS m FROM lineitem WHERE l_linenumber % 5 > 0), best AS (SELECT a.m, a.l_orderkey AS seg, a.l_returnflag AS field, round(a.l_extendedprice, 2) AS price, f.l_linenumber AS s1, f.l_partkey AS s2, f.l_extendedprice AS s3, f.l_quantity AS s4 FROM rec a JOIN rec f ON a.m = f.m AND a.l_orderkey = f.l_orderkey AND f.rn = 1 WHERE a.rn = a.n)"


@query(
    "cohort_manifest",
    f"WITH {_LINES}, hits AS (SELECT * FROM best WHERE field = 'R') SELECT 'fixed' AS segmentation, seg AS segment_index, (SELECT count(*) FROM hits h WHERE h.seg = b.seg) AS n_models_match, count(*) AS n_models_seen, (SELECT string_agg('m' || m, ';' ORDER BY 'm' || m) FROM hits h WHERE h.seg = b.seg) AS models_match, string_agg('m' || m, ';' ORDER BY 'm' || m) AS models_seen, (SELECT price FROM hits h WHERE h.seg = b.seg ORDER BY s1, s2, s3, s4 LIMIT 1) AS price FROM best b GROUP BY seg HAVING n_models_match >= 2",
)
def _manifest(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "lineitem").selectExpr("concat('m', l_suppkey % 3) AS model", "'' AS segmentation", "'v' AS video_id", "l_orderkey AS segment_index", "l_linenumber % 5 > 0 AS parse_ok", "l_returnflag AS field", "round(l_extendedprice, 2) AS price", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    return A.cohort_manifest(r, ["l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"], F.col("field") == "R", 2).drop("video_id", "field")


_TURNS = "chunks AS (SELECT conv_id, turn, turn * 7.5::DOUBLE AS a, turn * 7.5::DOUBLE + 7 AS b, CASE WHEN turn % 4 >= 2 THEN 'same' WHEN turn = 1 THEN '' ELSE role END AS said, CASE WHEN conv_id % 3 = 0 AND turn % 3 > 0 THEN 'hum' ELSE '' END AS heard FROM (SELECT conv_id, turn, max(role) AS role FROM conversations GROUP BY 1, 2))"


def _turn_lines(c: str, out: str) -> str:
    hms = lambda x: f"printf('%02d:%02d:%02d', floor({x})::BIGINT // 3600, floor({x})::BIGINT % 3600 // 60, floor({x})::BIGINT % 60)"
    return f"""{out}0 AS (SELECT *, CASE WHEN {c} IS DISTINCT FROM lag({c}) OVER (PARTITION BY conv_id ORDER BY turn) THEN 1 ELSE 0 END AS st FROM chunks WHERE {c} <> ''),
{out}1 AS (SELECT *, sum(st) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM {out}0), {out}2 AS (SELECT conv_id, run, '[' || {hms("min(a)")} || '-' || {hms("max(b)")} || '] ' || any_value({c}) AS line FROM {out}1 GROUP BY 1, 2),
{out} AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY run) AS {out} FROM {out}2 GROUP BY 1)"""


@query("video_summary", f"WITH {_TURNS}, {_turn_lines('said', 'timeline')}, {_turn_lines('heard', 'audio_timeline')}, t AS (SELECT conv_id, count(*) AS n_chunks, round(max(b) - min(a), 2) AS span_sec, round(sum(b - a), 2) AS covered_sec FROM chunks GROUP BY 1) SELECT conv_id, n_chunks, span_sec, covered_sec, coalesce(timeline, '') AS timeline, audio_timeline FROM t LEFT JOIN timeline USING (conv_id) LEFT JOIN audio_timeline USING (conv_id) WHERE timeline IS NOT NULL OR audio_timeline IS NOT NULL")
def _video_summary(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").selectExpr("'m' AS model", "'scenes' AS segmentation", "conv_id AS video_id", "turn AS segment_index", "true AS parse_ok", "turn * 7.5D AS start_sec", "turn * 7.5D + 7 AS end_sec", "CASE WHEN turn % 4 >= 2 THEN concat(' same', chr(10)) WHEN turn = 1 THEN '  ' ELSE role END AS description", "if(conv_id % 3 = 0 AND turn % 3 > 0, 'hum', '') AS audio_description", "role")
    return A.video_summary(c, ["role"]).select(F.col("video_id").alias("conv_id"), "n_chunks", "span_sec", "covered_sec", "timeline", "audio_timeline")
