"""The registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .best_fit import cut_pieces, pack_pieces
from .common import fold_of, table
from .conversation_repair import damage, repair
from .decontaminate import find_benchmark
from .fill_middle import fill_middle, restored
from .html_text import extract_text
from .near_dup import near_duplicates
from .ngram_lm import score_texts, training_fold
from .piece_codec import encode_pieces
from .quality_model import score_quality
from .quality_rules import STOP_WORDS, quality_counts
from .shard_ring import shard_rows
from .token_binary import read_tokens, write_tokens
from .token_count import count_tokens


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_counts(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = fold_of("doc_id", 5)
    scored = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold != 0)
    return scored.select("doc_id", (fold == 0).alias("held_out"), "score", "predicted")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items_sha256", "contaminated")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_texts(table(spark, sf_dir, "documents"), training_fold())
    return scored.select("doc_id", (~training_fold()).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle(table(spark, sf_dir, "documents"))
    back = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = cut_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    packed = pack_pieces(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damage(table(spark, sf_dir, "conversations")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_token_binary, op3_sentencepiece, op4_quality_rules, op5_html_extraction, op6_quality_classifier, op7_decontamination, op8_near_duplicates, op9_lm_scoring, op10_sharding, op11_fill_middle, op12_best_fit_packing, op13_conversation_repair)}


_SPACE = r"[^\x20\x09-\x0D]"
_STOPS = ", ".join("'" + w + "'" for w in sorted({w for ws in STOP_WORDS.values() for w in ws}))
_BASE = "(n_words < 50 OR 100 * n_repeat_words > 50 * n_words)"
_OP4 = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '{_SPACE}+') AS ws, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{_SPACE}')) AS ls FROM d),
tri AS (SELECT r, i, ws[i] || chr(1) || ws[i + 1] || chr(1) || ws[i + 2] AS k FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM tri QUALIFY count(*) OVER (PARTITION BY r, k) > 1) GROUP BY r),
c AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(list_filter(ws, lambda x: lower(x) IN ({_STOPS}))) AS n_stop, len(ls) AS n_lines, len(list_filter(ls, lambda l: l LIKE '%...' OR l LIKE '%…')) AS n_ell FROM w LEFT JOIN rep USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {_BASE} AS base_failed,
  NOT {_BASE} AND word_chars / n_words BETWEEN 2 AND 12 AND n_symbols / n_words <= 0.25 AND n_stop / n_words >= 0.06 AND n_dup_lines / n_lines <= 0.5 AND n_ell / n_lines <= 0.5 AS kept FROM c"""
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_OP7 = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOW}, '{_WORD}') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOW}, '{_WORD}') AS ws FROM benchmark),
bw AS (SELECT item_id, least(10, len(ws)) AS n, array_to_string(ws[i:i + 9], chr(1)) AS k FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
dw AS (SELECT r, i, n, array_to_string(ws[i:i + n - 1], chr(1)) AS k FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw))),
m AS (SELECT r, i, n, item_id FROM dw JOIN bw USING (n, k)),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM m) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT r, item_id::VARCHAR AS s FROM m) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (r) LEFT JOIN it USING (r)"""

# Code points are cut by substring; the draws are the hash's first groups read as hexadecimal numbers.
_OP11 = """WITH h AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
g AS (SELECT *, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM h),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (SELECT *, substring(t, 1, a) AS pre, substring(t, a + 1, b - a) AS mid, substring(t, b + 1) AS suf FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""
# The plain dynamic programme over whole audits: every state's cheapest and least audit, row by row.
_OP13 = r"""WITH RECURSIVE tb AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tb FROM (SELECT unnest(range(0, 256)) AS i)),
raw AS (SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS ck, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
dr AS (SELECT raw.*, xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(key) + 1), lambda i: ord(key[i])::BIGINT)), lambda c, b: xor(c >> 8, tb[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS d FROM raw, tb),
dm AS (SELECT ck, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN d = 3 THEN [0, 1] ELSE [0] END) AS copy FROM dr WHERE d > 0),
ps AS (SELECT *, row_number() OVER (PARTITION BY ck ORDER BY turn NULLS FIRST, role, text) AS pos, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'x' END AS ini FROM dm),
cd AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY ck, role, text ORDER BY pos) > 1 THEN 'd' WHEN regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN ini ELSE upper(ini) END AS code, lag(ini) OVER (PARTITION BY ck ORDER BY pos) || ini AS two FROM ps),
nx(q, t, w, line) AS (VALUES (0, 2, 'u', 'user:'), (1, 2, 'u', 'user:'), (2, 3, 'a', 'assistant:'), (3, 2, 'u', 'user:')),
ins AS (SELECT q, q AS r, 0 AS c, '' AS m, '' AS l FROM nx UNION ALL SELECT q, t, 3, 'I', chr(10) || line FROM nx UNION ALL SELECT a.q, b.t, 6, 'II', chr(10) || a.line || chr(10) || b.line FROM nx a JOIN nx b ON b.q = a.t),
al AS (SELECT unnest(['s', 'u', 'a', 'x', 'S', 'U', 'A', 'X', 'b', 'd']) AS code),
op AS (SELECT code, q, r AS t, c + 4 AS c, m || 'D' AS m, l, '-' AS how FROM ins, al
  UNION ALL SELECT code, ins.q, nx.t, c + 3 + CASE WHEN code = upper(code) THEN 3 ELSE 0 END, m || 'R', l, line FROM ins JOIN nx ON nx.q = r, al WHERE code NOT IN ('b', 'd')
  UNION ALL SELECT code, ins.q, nx.t, c + CASE WHEN code = upper(code) THEN 3 ELSE 0 END, m || 'K', l, '' FROM ins JOIN nx ON nx.q = r JOIN al ON lower(code) = w
  UNION ALL SELECT code, q, 1, c + CASE WHEN code = upper(code) THEN 3 ELSE 0 END, m || 'K', l, '' FROM ins, al WHERE r = 0 AND lower(code) = 's'),
walk AS (SELECT DISTINCT ck, 0::BIGINT AS pos, 0 AS q, {'c': 0, 'a': '', 'l': ''} AS best FROM raw
  UNION ALL SELECT w.ck, w.pos + 1, op.t, min({'c': w.best.c + op.c, 'a': w.best.a || op.m, 'l': w.best.l || op.l || CASE op.how WHEN '-' THEN '' WHEN '' THEN chr(10) || cd.role || ':' || cd.text ELSE chr(10) || op.how || cd.text END}) FROM walk w JOIN cd ON cd.ck = w.ck AND cd.pos = w.pos + 1 JOIN op ON op.code = cd.code AND op.q = w.q GROUP BY 1, 2, 3),
ends(q, c, a, l) AS (VALUES (0, 0, '', ''), (1, 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (2, 3, 'I', chr(10) || 'assistant:'), (3, 0, '', '')),
fin AS (SELECT ck, min({'c': best.c + e.c, 'a': best.a || e.a, 'l': best.l || e.l}) AS f FROM walk JOIN ends e USING (q) WHERE pos = (SELECT coalesce(max(cd.pos), 0) FROM cd WHERE cd.ck = walk.ck) GROUP BY 1),
st AS (SELECT ck, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(code = 'b') AS blank, count_if(code = 'd') AS duplicate, count_if(code IN ('S', 'U', 'A', 'X')) AS truncated, count_if(two NOT IN ('su', 'ua', 'au')) AS illegal FROM cd GROUP BY 1)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, f.c::BIGINT AS cost, f.a AS audit, sha256(substring(f.l, 2)) AS repaired_sha256
FROM (SELECT DISTINCT ck, conv_id FROM raw) JOIN fin USING (ck) LEFT JOIN st USING (ck)"""


def oracle_sql() -> dict[str, str]:
    """Only what SQL can express; tests hold the other queries against brute force or round trips."""
    return {"op4_quality_rules": _OP4, "op7_decontamination": _OP7, "op11_fill_middle": _OP11, "op13_conversation_repair": _OP13}
