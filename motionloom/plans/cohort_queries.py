"""Queries of the cohort statistics, over customers and their orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..engine import op, register
from ..functions import scalars as Z
from ..operators import cohort as H
from ..operators.order_statistics import exact_quantiles, rank_avg
from ..operators.pose import correlation
from .registry import query, table

FEATURES = ["medianx_LAnkle", "medianx_RAnkle", "IQRx_LWrist", "IQRx_RWrist", "mean_angle_RKnee", "lrCorr_x_Wrist"]
WIDE = """wide AS (SELECT c_custkey AS subject, 'sub_' || c_custkey || '-x' AS name, c_nationkey % 4 AS risk, c_acctbal / 500 AS age, CASE WHEN c_acctbal / 500 > 10 THEN 1 ELSE 0 END AS age_bracket, c_mktsegment AS seg,
  avg(o_totalprice) / 7e4::DOUBLE AS medianx_LAnkle, max(o_totalprice) / 7e4::DOUBLE AS medianx_RAnkle, min(o_totalprice) / 7e4::DOUBLE AS IQRx_LWrist, CASE WHEN c_custkey % 5 > 0 THEN sum(o_totalprice) / 7e5::DOUBLE END AS IQRx_RWrist,
  count(*)::DOUBLE AS mean_angle_RKnee, stddev_pop(o_totalprice) / 7e4::DOUBLE AS lrCorr_x_Wrist FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey, c_nationkey, c_acctbal, c_mktsegment)"""
LONG = (
    WIDE
    + """, long0 AS (UNPIVOT wide ON medianx_LAnkle, medianx_RAnkle, IQRx_LWrist, IQRx_RWrist, mean_angle_RKnee, lrCorr_x_Wrist INTO NAME feature VALUE value),
long AS (SELECT *, string_split(feature, '_') AS q FROM long0),
named AS (SELECT subject, risk, age_bracket, feature, array_to_string(q[:-2], '_') AS stat, CASE WHEN feature LIKE 'lrCorr%' THEN '' ELSE left(q[-1], 1) END AS side, CASE WHEN feature LIKE 'lrCorr%' THEN q[-1] ELSE substr(q[-1], 2) END AS part, value FROM long),
lr AS (SELECT subject, risk, age_bracket, part, stat, avg(value) AS value, count(value) AS n_sides FROM named GROUP BY ALL)"""
)
FIT = LONG + ", fit AS (SELECT part, stat, avg(value) AS mu, stddev_pop(value) AS sigma, count(value) AS n_ref, sum(value) AS s1, sum(value ** 2) AS s2 FROM lr WHERE risk = 0 GROUP BY 1, 2 HAVING count(value) >= 3 AND stddev_pop(value) > 0)"
FIT_AGE = LONG + ", fit AS (SELECT part, stat, age_bracket, avg(value) AS mu, stddev_pop(value) AS sigma, count(value) AS n_ref, sum(value) AS s1, sum(value ** 2) AS s2 FROM lr WHERE risk = 0 GROUP BY 1, 2, 3 HAVING count(value) >= 3 AND stddev_pop(value) > 0)"
_LL = "-(0.5 * ln(2 * pi() * {v}) + (value - {m}) ** 2 / (2 * {v}))"
_LOO = "CASE WHEN risk = 0 AND n_ref - 1 >= 3 AND (s2 - value**2) / (n_ref - 1) - ((s1 - value) / (n_ref - 1))**2 > 0 THEN " + _LL.format(m="((s1 - value) / (n_ref - 1))", v="((s2 - value**2) / (n_ref - 1) - ((s1 - value) / (n_ref - 1))**2)") + " ELSE " + _LL.format(m="mu", v="(sigma ** 2)") + " END"


def scored(fit: str, keys: str) -> str:
    return f"{fit}, ll AS (SELECT subject, risk, {_LL.format(m='mu', v='(sigma ** 2)')} AS loglik, {_LOO} AS loglik_loo FROM lr JOIN fit USING ({keys})), per AS (SELECT subject, risk, sum(loglik) AS loglik, sum(loglik_loo) AS loglik_loo, count(loglik) AS n_features FROM ll GROUP BY 1, 2), ref AS (SELECT avg(loglik) AS m, stddev_samp(loglik) AS s, avg(loglik_loo) AS ml, stddev_samp(loglik_loo) AS sl FROM per WHERE risk = 0), z AS (SELECT per.*, (loglik - m) / s AS z, (loglik_loo - ml) / sl AS z_loo FROM per, ref)"


def p_sql(z: str) -> str:
    """Two-sided p by the series of the error function, its terms by logarithms."""
    x = f"greatest(abs({z}) / sqrt(2.0::DOUBLE), 1e-300)"
    return f"CASE WHEN abs({z}) > 8 THEN 0 ELSE greatest(0, 1 - 2 / sqrt(pi()) * exp(-({z}) * ({z}) / 2) * list_sum(list_transform(range(0, 200), lambda n: exp(2 * n * ln(2) + (2 * n + 1) * ln({x}) - lgamma(2 * n + 2) + lgamma(n + 1))))) END"


P_SQL = p_sql("z")


def wide(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "orders").join(table(spark, d, "customer"), F.expr("o_custkey = c_custkey"))
    p = F.col("o_totalprice")
    out = j.groupBy("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment").agg((F.avg(p) / 7e4).alias("medianx_LAnkle"), (F.max(p) / 7e4).alias("medianx_RAnkle"), (F.min(p) / 7e4).alias("IQRx_LWrist"), (F.sum(p) / 7e5).alias("IQRx_RWrist"), F.count("*").cast("double").alias("mean_angle_RKnee"), (F.stddev_pop(p) / 7e4).alias("lrCorr_x_Wrist"))
    return out.selectExpr("c_custkey AS subject", "concat('sub_', c_custkey, '-x') AS name", "c_nationkey % 4 AS risk", "c_acctbal / 500 AS age", "int(c_acctbal / 500 > 10) AS age_bracket", "c_mktsegment AS seg", "medianx_LAnkle", "medianx_RAnkle", "IQRx_LWrist", "if(c_custkey % 5 > 0, IQRx_RWrist, null) AS IQRx_RWrist", "mean_angle_RKnee", "lrCorr_x_Wrist")


def lr(spark: SparkSession, d: str) -> DataFrame:
    return H.lr_mean(H.melt(wide(spark, d), ["subject", "risk", "age_bracket"], FEATURES), ["subject", "risk", "age_bracket"]).where("value IS NOT NULL")


def scores(spark: SparkSession, d: str, keys: list[str]) -> DataFrame:
    long = lr(spark, d)
    return H.logliks(long, H.fit_reference(long.where("risk = 0"), keys), keys, F.col("risk") == 0)


def _r(df: DataFrame, *cols: str, places: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, places) + 0.0 for c in cols})


@query("feature_name_split", f"WITH {LONG} SELECT DISTINCT feature, stat, side, part FROM named")
def _split(spark: SparkSession, d: str) -> DataFrame:
    return H.melt(wide(spark, d), ["subject"], FEATURES).select("feature", "stat", "side", "part").distinct()


@query("rename_sided", f"WITH {LONG} SELECT DISTINCT feature, CASE WHEN side = '' THEN part || '_' || stat ELSE part || '_' || stat END AS joint_name FROM named")
def _rename(spark: SparkSession, d: str) -> DataFrame:
    return H.melt(wide(spark, d), ["subject"], FEATURES).select("feature", F.concat("part", F.lit("_"), "stat").alias("joint_name")).distinct()


@query("agg_lr_mean", f"WITH {LONG} SELECT subject, part, stat, round(value, 5) AS value, n_sides FROM lr")
def _lr(spark: SparkSession, d: str) -> DataFrame:
    return _r(lr(spark, d), "value", places=5).select("subject", "part", "stat", "value", "n_sides")


@query("infant_id_parse", "SELECT c_custkey, c_custkey::VARCHAR AS subject FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'sub_x' || c_custkey FROM customer WHERE c_custkey % 2 = 1")
def _subject(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "customer").selectExpr("c_custkey", "if(c_custkey % 2 = 0, concat('a-', c_custkey, '_1_X'), concat('sub_x', c_custkey)) AS name")
    return n.select("c_custkey", Z.subject_of(F.col("name")).alias("subject"))




@query("agg_collapse_windows", "SELECT 'v' || o_custkey || '_a' AS name, round(avg(o_totalprice / 7), 3) AS v FROM orders GROUP BY 1")
def _collapse(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").selectExpr("concat('v', o_custkey, '_a_', o_orderkey % 50, '-', o_orderkey % 50 + 9, 's') AS name", "o_totalprice / 7 AS v")
    return _r(H.collapse_windows(o, "name", ["v"]), "v", places=3)


@query("infer_pattern_group", "SELECT o_orderkey, 'v' || o_custkey AS id, (o_orderkey % 50)::INT AS start_s, (o_orderkey % 50 + 9)::INT AS end_s FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, NULL, NULL, NULL FROM orders WHERE o_orderkey % 2 = 1")
def _infer(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").selectExpr("o_orderkey", "if(o_orderkey % 2 = 0, concat('v', o_custkey, '_', o_orderkey % 50, '-', o_orderkey % 50 + 9, 's'), 'plain') AS name")
    return o.withColumn("w", Z.window_name(F.col("name"))).select("o_orderkey", "w.id", F.col("w.start").alias("start_s"), F.col("w.end").alias("end_s"))


@query("agg_collapse_infant", f"WITH {WIDE} SELECT risk, round(avg(medianx_LAnkle), 5) AS a, round(avg(IQRx_RWrist), 5) AS b FROM wide GROUP BY 1")
def _infant(spark: SparkSession, d: str) -> DataFrame:
    return _r(wide(spark, d).groupBy("risk").agg(F.avg("medianx_LAnkle").alias("a"), F.avg("IQRx_RWrist").alias("b")), "a", "b", places=5)


@query("agg_ref_gauss", f"WITH {FIT} SELECT part, stat, round(mu, 5) AS mu, round(sigma, 5) AS sigma, n_ref FROM fit")
def _gauss(spark: SparkSession, d: str) -> DataFrame:
    return _r(H.fit_reference(lr(spark, d).where("risk = 0"), ["part", "stat"]), "mu", "sigma", places=5).select("part", "stat", "mu", "sigma", "n_ref")


@query("join_ref_stats", f"WITH {FIT} SELECT subject, part, stat, round((value - mu) / sigma, 4) + 0.0 AS dev FROM lr JOIN fit USING (part, stat)")
def _ref(spark: SparkSession, d: str) -> DataFrame:
    long = lr(spark, d)
    j = long.join(H.fit_reference(long.where("risk = 0"), ["part", "stat"]), ["part", "stat"])
    return _r(j.withColumn("dev", (F.col("value") - F.col("mu")) / F.col("sigma")), "dev").select("subject", "part", "stat", "dev")


@query("gauss_loglik", f"WITH {scored(FIT, 'part, stat')} SELECT subject, round(loglik, 4) AS loglik FROM per")
def _ll(spark: SparkSession, d: str) -> DataFrame:
    return _r(scores(spark, d, ["part", "stat"]).groupBy("subject").agg(F.sum("loglik").alias("loglik")), "loglik")


@query("agg_loglik_sum", f"WITH {scored(FIT, 'part, stat')} SELECT subject, round(loglik, 4) AS loglik, n_features, round(loglik / n_features, 4) AS per_feature FROM per")
def _sum(spark: SparkSession, d: str) -> DataFrame:
    return _r(H.surprise(scores(spark, d, ["part", "stat"]), ["subject", "risk"], F.col("risk") == 0), "loglik", "per_feature").select("subject", "loglik", "n_features", "per_feature")


@query("loo_gauss", f"WITH {scored(FIT, 'part, stat')} SELECT subject, round(loglik_loo, 4) AS loglik_loo FROM per")
def _loo(spark: SparkSession, d: str) -> DataFrame:
    return _r(scores(spark, d, ["part", "stat"]).groupBy("subject").agg(F.sum("loglik_loo").alias("loglik_loo")), "loglik_loo")


def _surprise(spark: SparkSession, d: str, keys: list[str]) -> DataFrame:
    return H.surprise(scores(spark, d, keys), ["subject", "risk"], F.col("risk") == 0, low=4)


@query("surprise_simple", f"WITH {scored(FIT, 'part, stat')} SELECT subject, risk, round(z, 4) + 0.0 AS z, n_features, n_features < 4 AS low_coverage, round({P_SQL}, 3) AS p FROM z")
def _simple(spark: SparkSession, d: str) -> DataFrame:
    s = _surprise(spark, d, ["part", "stat"]).withColumn("p", F.round(Z.p_two_sided(F.col("z")), 3))
    return _r(s, "z").select("subject", "risk", "z", "n_features", "low_coverage", "p")


@query("surprise_bracketed", f"WITH {scored(FIT_AGE, 'part, stat, age_bracket')} SELECT subject, risk, round(z, 4) + 0.0 AS z, round(z_loo, 4) + 0.0 AS z_loo, n_features FROM z")
def _bracketed(spark: SparkSession, d: str) -> DataFrame:
    return _r(_surprise(spark, d, ["part", "stat", "age_bracket"]), "z", "z_loo").select("subject", "risk", "z", "z_loo", "n_features")


@query("surprise_legacy", f"WITH {scored(FIT, 'part, stat')} SELECT risk, round(avg(loglik), 4) AS mean_loglik, count(*) AS n FROM per GROUP BY 1")
def _legacy(spark: SparkSession, d: str) -> DataFrame:
    return _r(_surprise(spark, d, ["part", "stat"]).groupBy("risk").agg(F.avg("loglik").alias("mean_loglik"), F.count("*").alias("n")), "mean_loglik")


@query("agg_zscore_vs_ref", f"WITH {scored(FIT, 'part, stat')} SELECT subject, round(z, 4) + 0.0 AS z, round(z_loo, 4) + 0.0 AS z_loo FROM z")
def _z(spark: SparkSession, d: str) -> DataFrame:
    return _r(_surprise(spark, d, ["part", "stat"]).select("subject", "z", "z_loo"), "z", "z_loo")


@query("sort_most_atypical", f"WITH {scored(FIT, 'part, stat')} SELECT subject, risk, round(z, 4) + 0.0 AS z FROM z ORDER BY z.z, subject")
def _atypical(spark: SparkSession, d: str) -> DataFrame:
    return _r(_surprise(spark, d, ["part", "stat"]).orderBy("z", "subject").select("subject", "risk", "z"), "z")


_TESTS = """z2 AS (SELECT risk, 'loglik' AS score, loglik AS value, z AS zz FROM z UNION ALL SELECT risk, 'loglik_loo', loglik_loo, z_loo FROM z),
gr AS (SELECT DISTINCT risk AS against FROM z WHERE risk <> 0 UNION ALL SELECT NULL), t AS (SELECT against::VARCHAR AS against, score, risk = 0 AS in_ref, value, zz FROM z2, gr WHERE risk = 0 OR against IS NULL OR risk = against),
rk AS (SELECT *, rank() OVER (PARTITION BY against, score ORDER BY value) + (count(*) OVER (PARTITION BY against, score, value) - 1) / 2.0::DOUBLE AS rank_avg FROM t),
u AS (SELECT against, score, count_if(in_ref)::DOUBLE AS n1, count_if(NOT in_ref)::DOUBLE AS n2, sum(CASE WHEN in_ref THEN rank_avg END) AS r1, avg(CASE WHEN NOT in_ref THEN zz END) AS mean_z FROM rk GROUP BY 1, 2),
v AS (SELECT *, (greatest(r1 - n1 * (n1 + 1) / 2, n1 * n2 - r1 + n1 * (n1 + 1) / 2) - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1)) AS s FROM u)"""


@query("group_rank_tests", f"WITH {scored(FIT, 'part, stat')}, {_TESTS} SELECT against, score, n2::BIGINT AS n, round(mean_z, 4) + 0.0 AS mean_z, round(least(1, {p_sql('greatest(s, 0)')}), 5) AS p FROM v")
def _group_tests(spark: SparkSession, d: str) -> DataFrame:
    tests = H.group_tests(_surprise(spark, d, ["part", "stat"]), "risk", {"loglik": "z", "loglik_loo": "z_loo"})
    return _r(_r(tests, "mean_z"), "p", places=5).select("against", "score", "n", "mean_z", "p")


@query("p_two_sided", f"WITH {scored(FIT, 'part, stat')} SELECT subject, round({P_SQL}, 4) AS p FROM z")
def _p(spark: SparkSession, d: str) -> DataFrame:
    return _surprise(spark, d, ["part", "stat"]).select("subject", F.round(Z.p_two_sided(F.col("z")), 4).alias("p"))


_BAND = "CASE WHEN z <= -1.96 THEN 'high' WHEN z <= -1 THEN 'moderate' ELSE 'low' END"


@query("z_bands", f"WITH {scored(FIT, 'part, stat')} SELECT {_BAND} AS band, count(*) AS n FROM z GROUP BY 1")
def _bands(spark: SparkSession, d: str) -> DataFrame:
    return _surprise(spark, d, ["part", "stat"]).groupBy(H.z_bands(F.col("z")).alias("band")).agg(F.count("*").alias("n"))


@query("mark_low_coverage", f"WITH {scored(FIT, 'part, stat')} SELECT subject, n_features < 4 AS low_coverage FROM per")
def _low(spark: SparkSession, d: str) -> DataFrame:
    return _surprise(spark, d, ["part", "stat"]).select("subject", "low_coverage")


@query("agg_risk_group", f"WITH {scored(FIT, 'part, stat')} SELECT risk, count(*) AS n, count(DISTINCT subject) AS n_subjects, round(avg(z), 4) + 0.0 AS mean_z, round(median(z), 4) + 0.0 AS median_z, round(min(z), 4) + 0.0 AS min_z FROM z GROUP BY 1")
def _risk(spark: SparkSession, d: str) -> DataFrame:
    g = _surprise(spark, d, ["part", "stat"]).groupBy("risk").agg(F.count("*").alias("n"), F.countDistinct("subject").alias("n_subjects"), F.avg("z").alias("mean_z"), F.expr("percentile(z, 0.5)").alias("median_z"), F.min("z").alias("min_z"))
    return _r(g, "mean_z", "median_z", "min_z")


@query("agg_group_mean_sd", f"WITH {scored(FIT, 'part, stat')} SELECT risk, round(avg(z), 4) + 0.0 AS mean_z, round(stddev_samp(z), 4) AS sd_z FROM z GROUP BY 1")
def _mean_sd(spark: SparkSession, d: str) -> DataFrame:
    return _r(_surprise(spark, d, ["part", "stat"]).groupBy("risk").agg(F.avg("z").alias("mean_z"), F.stddev_samp("z").alias("sd_z")), "mean_z", "sd_z")


@query("agg_exact_quantiles", "SELECT c_mktsegment AS seg, count(*) AS n, round(quantile_cont(c_acctbal, 0.1), 4) AS low, round(median(c_acctbal), 4) AS mid, round(quantile_cont(c_acctbal, 0.97), 4) AS high FROM customer GROUP BY 1")
def _quantiles(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").selectExpr("c_mktsegment AS seg", "c_acctbal AS v")
    return _r(exact_quantiles(c, ["seg"], "v", {"low": 0.1, "mid": 0.5, "high": 0.97}), "low", "mid", "high")


_RANK = "r AS (SELECT c_nationkey, c_mktsegment = 'BUILDING' AS in_ref, round(c_acctbal / 200, 0) + 0.0 AS v FROM customer), k AS (SELECT *, rank() OVER (PARTITION BY c_nationkey ORDER BY v) + (count(*) OVER (PARTITION BY c_nationkey, v) - 1) / 2.0::DOUBLE AS rank_avg, count(*) OVER (PARTITION BY c_nationkey, v) AS t FROM r)"


def _ranks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").selectExpr("c_custkey", "c_nationkey", "c_mktsegment = 'BUILDING' AS in_ref", "round(c_acctbal / 200, 0) + 0.0 AS v")


@query("rank_avg", f"WITH {_RANK} SELECT c_nationkey, v, max(rank_avg) AS rank_avg, count(*) AS n FROM k GROUP BY 1, 2")
def _rank(spark: SparkSession, d: str) -> DataFrame:
    return rank_avg(_ranks(spark, d), ["c_nationkey"], "v").groupBy("c_nationkey", "v").agg(F.max("rank_avg").alias("rank_avg"), F.count("*").alias("n"))


@query("mann_whitney_u", f"WITH {_RANK}, u AS (SELECT c_nationkey, count_if(in_ref)::DOUBLE AS n1, count_if(NOT in_ref)::DOUBLE AS n2, sum(CASE WHEN in_ref THEN rank_avg END) AS r1, sum(t * t - 1) AS t3 FROM k GROUP BY 1) SELECT c_nationkey, n1, n2, round(r1 - n1 * (n1 + 1) / 2, 3) AS u1, t3::DOUBLE AS t3 FROM u")
def _u(spark: SparkSession, d: str) -> DataFrame:
    m = H.mann_whitney(_ranks(spark, d), ["c_nationkey"], "v", "in_ref")
    return m.select("c_nationkey", F.col("n1").cast("double").alias("n1"), F.col("n2").cast("double").alias("n2"), F.round("u1", 3).alias("u1"), F.col("t3").cast("double").alias("t3"))


@query("mann_whitney", f"WITH {_RANK}, u AS (SELECT c_nationkey, count_if(in_ref)::DOUBLE AS n1, count_if(NOT in_ref)::DOUBLE AS n2, sum(CASE WHEN in_ref THEN rank_avg END) AS r1, sum(t * t - 1)::DOUBLE AS t3 FROM k GROUP BY 1), s AS (SELECT *, (greatest(r1 - n1 * (n1 + 1) / 2, n1 * n2 - r1 + n1 * (n1 + 1) / 2) - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - t3 / ((n1 + n2) * (n1 + n2 - 1)))) AS s FROM u) SELECT c_nationkey, n1::BIGINT AS n1, n2::BIGINT AS n2, round(least(1, {p_sql('greatest(s, 0)')}), 5) AS p FROM s")
def _mw(spark: SparkSession, d: str) -> DataFrame:
    return H.mann_whitney(_ranks(spark, d), ["c_nationkey"], "v", "in_ref").select("c_nationkey", "n1", "n2", F.round("p", 5).alias("p"))


@query("poly_regression", f"WITH {WIDE} SELECT risk, round(regr_slope(medianx_LAnkle, age), 6) + 0.0 AS slope, round(regr_intercept(medianx_LAnkle, age), 5) + 0.0 AS intercept FROM wide GROUP BY 1")
def _poly(spark: SparkSession, d: str) -> DataFrame:
    g = wide(spark, d).groupBy("risk").agg(F.regr_slope("medianx_LAnkle", "age").alias("slope"), F.regr_intercept("medianx_LAnkle", "age").alias("intercept"))
    return _r(_r(g, "slope", places=6), "intercept", places=5)


# The square's part that is not linear in age gives the last coefficient; the others follow from what it leaves.
_POLY2 = f"{WIDE}, l AS (SELECT risk, regr_slope(age * age, age) AS b, regr_intercept(age * age, age) AS a FROM wide GROUP BY 1), q AS (SELECT risk, age, medianx_LAnkle AS y, age * age - a - b * age AS q FROM wide JOIN l USING (risk)), c2 AS (SELECT risk, regr_slope(y, q) AS c2 FROM q GROUP BY 1)"


@query("poly_regression_2", f"WITH {_POLY2} SELECT risk, round(regr_intercept(y - c2 * age * age, age), 5) + 0.0 AS c0, round(regr_slope(y - c2 * age * age, age), 6) + 0.0 AS c1, round(any_value(c2), 7) + 0.0 AS c2 FROM q JOIN c2 USING (risk) GROUP BY risk")
def _poly2(spark: SparkSession, d: str) -> DataFrame:
    p = H.poly2(wide(spark, d), ["risk"], "age", "medianx_LAnkle")
    return _r(_r(_r(p, "c0", places=5), "c1", places=6), "c2", places=7)


_SVD = ["medianx_LAnkle", "medianx_RAnkle", "IQRx_LWrist", "mean_angle_RKnee"]
_CELLS = lambda e: f"list_transform(range(1, 5), lambda i: list_transform(range(1, 5), lambda j: {e}))"
_TRACE = lambda m: f"list_sum(list_transform(range(1, 5), lambda k: {m}))"
# Power iteration by squaring: a matrix multiplied by itself 30 times is the projection on its first vector; taken off, the next follows.
_EIGEN = f"""WITH RECURSIVE {WIDE}, zs AS (SELECT subject, risk, [{", ".join(f"coalesce(({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER (), 0)" for c in _SVD)}] AS z FROM wide),
g AS (SELECT {_CELLS("0.0::DOUBLE").replace("0.0::DOUBLE", "cells[(i - 1) * 4 + j]")} AS g FROM (SELECT [{", ".join(f"sum(z[{i}] * z[{j}])" for i in range(1, 5) for j in range(1, 5))}] AS cells FROM zs)),
it AS (SELECT 1 AS comp, 0 AS step, g, {_CELLS("g[i][j] / " + _TRACE("g[k][k]"))} AS p FROM g
  UNION ALL SELECT CASE WHEN step = 30 THEN comp + 1 ELSE comp END, CASE WHEN step = 30 THEN 0 ELSE step + 1 END, g, {_CELLS("q[i][j] / nullif(" + _TRACE("q[k][k]") + ", 0)")}
  FROM (SELECT comp, step, CASE WHEN step = 30 THEN r ELSE g END AS g, CASE WHEN step = 30 THEN r ELSE {_CELLS(_TRACE("p[i][k] * p[k][j]"))} END AS q
  FROM (SELECT *, {_CELLS("g[i][j] - lambda_ * p[i][j]")} AS r FROM (SELECT *, list_sum(list_transform(range(1, 5), lambda i: list_sum(list_transform(range(1, 5), lambda j: g[i][j] * p[i][j])))) AS lambda_ FROM it WHERE comp < 5)))),
top AS (SELECT comp, lambda_, list_transform(p[best], lambda x: x / sqrt(p[best][best])) AS v FROM (SELECT *, list_position(list_transform(range(1, 5), lambda k: p[k][k]), list_max(list_transform(range(1, 5), lambda k: p[k][k]))) AS best,
  list_sum(list_transform(range(1, 5), lambda i: list_sum(list_transform(range(1, 5), lambda j: g[i][j] * p[i][j])))) AS lambda_ FROM it WHERE step = 30 AND comp < 5))"""


@query("svd_cohort", f"{_EIGEN} SELECT comp AS component, round(lambda_ / sum(lambda_) OVER (), 2) AS share FROM top")
def _svd(spark: SparkSession, d: str) -> DataFrame:
    return H.svd_variance(wide(spark, d), _SVD)


@query("svd_left_by_risk", f"{_EIGEN}, u AS (SELECT subject, risk, comp, list_sum(list_transform(range(1, 5), lambda k: z[k] * v[k])) / sqrt(lambda_) AS u FROM zs, top WHERE comp < 4), c AS (SELECT risk, comp, abs(u - avg(u) OVER (PARTITION BY comp)) AS a FROM u) SELECT risk, " + ", ".join(f"round(avg(CASE WHEN comp = {k} THEN a END), 6) AS sv{k}" for k in (1, 2, 3)) + " FROM c GROUP BY 1")
def _svd_left(spark: SparkSession, d: str) -> DataFrame:
    left = H.svd_left(wide(spark, d), _SVD)
    return left.groupBy("risk").agg(*[F.round(F.avg(f"sv{k}"), 6).alias(f"sv{k}") for k in (1, 2, 3)])


@query("axis_range", f"WITH {WIDE} SELECT round(min(age) - 0.1 * CASE WHEN max(age) = min(age) THEN 1 ELSE max(age) - min(age) END, 4) AS lo, round(max(age) + 0.1 * CASE WHEN max(age) = min(age) THEN 1 ELSE max(age) - min(age) END, 4) AS hi FROM wide")
def _axis(spark: SparkSession, d: str) -> DataFrame:
    span = F.when(F.max("age") == F.min("age"), 1.0).otherwise(F.max("age") - F.min("age"))
    return wide(spark, d).agg(F.round(F.min("age") - 0.1 * span, 4).alias("lo"), F.round(F.max("age") + 0.1 * span, 4).alias("hi"))


@query("z_norm_group", f"WITH {WIDE} SELECT subject, round((medianx_LAnkle - avg(medianx_LAnkle) OVER w) / stddev_samp(medianx_LAnkle) OVER w, 4) + 0.0 AS z FROM wide WINDOW w AS (PARTITION BY seg)")
def _znorm(spark: SparkSession, d: str) -> DataFrame:
    # Statistics of each group are aggregated and joined back: a large group is not sorted in one task.
    df = wide(spark, d)
    stats = df.groupBy("seg").agg(F.avg("medianx_LAnkle").alias("m"), F.stddev_samp("medianx_LAnkle").alias("s"))
    return _r(df.join(stats, "seg").select("subject", ((F.col("medianx_LAnkle") - F.col("m")) / F.col("s")).alias("z")), "z")


@query("pivot_svd_matrix", f"WITH {LONG} SELECT subject, risk, round(max(CASE WHEN part = 'Ankle' THEN value END), 5) AS Ankle_medianx, round(max(CASE WHEN part = 'Wrist' AND stat = 'IQRx' THEN value END), 5) AS Wrist_IQRx FROM lr GROUP BY 1, 2")
def _pivot(spark: SparkSession, d: str) -> DataFrame:
    p = lr(spark, d).withColumn("k", F.concat("part", F.lit("_"), "stat")).groupBy("subject", "risk").pivot("k", ["Ankle_medianx", "Wrist_IQRx"]).agg(F.first("value"))
    return _r(p, "Ankle_medianx", "Wrist_IQRx", places=5)


@query("age_weeks", "SELECT c_custkey, round((c_custkey % 20) * 4.345 + (c_custkey % 30) / 7.0::DOUBLE, 5) AS weeks, round((c_custkey % 20) * 4 + (c_custkey % 30) / 7.0::DOUBLE, 5) AS weeks_legacy FROM customer")
def _age(spark: SparkSession, d: str) -> DataFrame:
    m, dy = F.col("c_custkey") % 20, F.col("c_custkey") % 30
    return table(spark, d, "customer").select("c_custkey", F.round(Z.age_weeks(m, dy), 5).alias("weeks"), F.round(Z.age_weeks(m, dy, 4.0), 5).alias("weeks_legacy"))


@query("age_bracket", "SELECT c_custkey, (c_acctbal / 500 > 10)::INT AS bracket FROM customer")
def _bracket(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").selectExpr("c_custkey", "int(c_acctbal / 500 > 10) AS bracket")


@query("risk_shift", "SELECT c_custkey, coalesce(TRY_CAST(CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN 'x' ELSE (c_custkey % 3)::VARCHAR END AS DOUBLE) + 1, (c_custkey % 2) + 1)::DOUBLE AS risk FROM customer")
def _shift(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").selectExpr("c_custkey", "CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN 'x' ELSE string(c_custkey % 3) END AS corrected", "c_custkey % 2 AS chron")
    return c.select("c_custkey", F.coalesce(F.col("corrected").try_cast("double") + 1, (F.col("chron") + 1).cast("double")).alias("risk"))


@query("risk_name_normalise", "SELECT c_custkey, CASE c_nationkey % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'moderate' WHEN 2 THEN 'high' ELSE 'odd one' END AS risk FROM customer")
def _risk_names(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "customer").selectExpr("c_custkey", "CASE c_nationkey % 4 WHEN 0 THEN ' 0 ' WHEN 1 THEN 'Moderate' WHEN 2 THEN '2' ELSE concat('Odd One', chr(10)) END AS raw")
    return raw.select("c_custkey", Z.risk_name(F.col("raw")).alias("risk"))


@query("join_labels_dedup", "SELECT doc_id, q AS quality, t AS toxic FROM documents d LEFT JOIN (SELECT doc_id, quality AS q, toxic AS t FROM labels QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY quality, toxic) = 1) l USING (doc_id)")
def _labels_dedup(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "labels").groupBy("doc_id").agg(F.min(F.struct("quality", "toxic")).alias("l"))
    return table(spark, d, "documents").select("doc_id").join(own, "doc_id", "left").select("doc_id", "l.quality", "l.toxic")


@query("join_age_bridge", "SELECT o_orderkey, n_name, round(c_acctbal / 500, 4) AS age FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def _bridge(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.expr("c_nationkey = n_nationkey"))
    return table(spark, d, "orders").join(c, F.expr("o_custkey = c_custkey")).select("o_orderkey", "n_name", F.round(F.col("c_acctbal") / 500, 4).alias("age"))


@query("join_clinical_meta", "SELECT (SELECT count(*) FROM documents SEMI JOIN labels USING (doc_id)) AS matched, (SELECT count(*) FROM documents ANTI JOIN labels USING (doc_id)) AS unmatched")
def _clinical(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "labels").select("doc_id", F.lit(1).alias("there")).distinct()
    j = table(spark, d, "documents").select("doc_id").join(ids, "doc_id", "left")
    return j.agg(F.count("there").alias("matched"), F.count_if(F.col("there").isNull()).alias("unmatched"))


@query("agg_age_range", f"WITH {WIDE} SELECT seg, round(min(age), 4) AS youngest, round(max(age), 4) AS oldest, count(DISTINCT subject) AS n FROM wide GROUP BY 1")
def _range(spark: SparkSession, d: str) -> DataFrame:
    return _r(wide(spark, d).groupBy("seg").agg(F.min("age").alias("youngest"), F.max("age").alias("oldest"), F.countDistinct("subject").alias("n")), "youngest", "oldest")


@query("point_numbers", f"WITH {WIDE} SELECT subject, row_number() OVER (ORDER BY risk, subject) AS number FROM wide")
def _points(spark: SparkSession, d: str) -> DataFrame:
    # Numbers over all rows: counts of each risk and range of subjects, then ranks inside it.
    df = wide(spark, d).select("subject", "risk").withColumn("cell", F.floor(F.col("subject") / 1000))
    sizes = df.groupBy("risk", "cell").agg(F.count("*").alias("n"))
    starts = sizes.withColumn("start", F.coalesce(F.sum("n").over(Window.orderBy("risk", "cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = df.withColumn("rn", F.row_number().over(Window.partitionBy("risk", "cell").orderBy("subject")))
    return ranked.join(starts, ["risk", "cell"]).select("subject", (F.col("start") + F.col("rn")).alias("number"))


@query("union_all_cohorts", "SELECT 'a' AS cohort, c_custkey AS k, c_acctbal AS v, NULL::VARCHAR AS note FROM customer UNION ALL SELECT 'b', s_suppkey, s_acctbal, s_name FROM supplier")
def _union(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").selectExpr("'a' AS cohort", "c_custkey AS k", "c_acctbal AS v")
    return a.unionByName(table(spark, d, "supplier").selectExpr("'b' AS cohort", "s_suppkey AS k", "s_acctbal AS v", "s_name AS note"), allowMissingColumns=True)


@query("agg_corr_valid", "SELECT user_id, CASE WHEN count(*) > 12 THEN round(covar_pop(value, h) / nullif(stddev_pop(value) * stddev_pop(h), 0), 5) END AS c FROM (SELECT user_id, value, hour(ts)::DOUBLE AS h FROM events WHERE value > 5) GROUP BY 1")
def _valid(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("value > 5").selectExpr("user_id", "value", "double(hour(ts)) AS h")
    return e.groupBy("user_id").agg(F.round(F.when(F.count("*") > 12, correlation("value", "h")), 5).alias("c"))


@query("user_aggregate", "SELECT l_suppkey, l_returnflag, round(stddev_pop(l_extendedprice::DOUBLE), 4) AS sd FROM lineitem GROUP BY 1, 2")
def _own_aggregate(spark: SparkSession, d: str) -> DataFrame:
    got = op("user_aggregate")(table(spark, d, "lineitem"), ["l_suppkey", "l_returnflag"], "population_sd", ["l_extendedprice"], "sd")
    return got.withColumn("sd", F.round("sd", 4))


@query("user_aggregate_sql", "SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice::DOUBLE * l_quantity::DOUBLE) / sum(l_quantity::DOUBLE), 4) AS mean FROM lineitem GROUP BY 1, 2")
def _own_aggregate_sql(spark: SparkSession, d: str) -> DataFrame:
    register(spark)
    rows = "SELECT l_returnflag, l_linestatus, l_extendedprice, l_quantity FROM {lines}"
    states = f"SELECT * FROM weighted_mean_states(TABLE({rows}))"
    return spark.sql(f"SELECT l_returnflag, l_linestatus, round(value, 4) AS mean FROM weighted_mean_merged(TABLE({states}))", lines=table(spark, d, "lineitem"))
