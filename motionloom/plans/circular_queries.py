"""Queries of the circular statistics library, over keypoint angles and prices read as degrees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import circular as C
from .registry import query, table

# Angles in radians per shipping mode group: prices as degrees; every 13th is missing.
_A = "a AS (SELECT l_returnflag AS g, CASE WHEN l_orderkey % 13 <> 0 THEN radians(l_extendedprice % 360) END AS x, radians((l_quantity * 7) % 360) AS y, l_quantity AS w FROM lineitem)"


def _a(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr("l_returnflag AS g", "CASE WHEN l_orderkey % 13 <> 0 THEN radians(l_extendedprice % 360) END AS x", "radians((l_quantity * 7) % 360) AS y", "l_quantity AS w")


_R = "sqrt(sum({w}cos(x))**2 + sum({w}sin(x))**2) / sum(CASE WHEN x IS NOT NULL THEN {v} END)"
_R1 = _R.format(w="", v="1")


def _agg(name: str, value: str, make, places: int = 5) -> None:  # noqa: ANN001
    @query(name, f"WITH {_A} SELECT g, round({value}, {places}) AS v FROM a GROUP BY g")
    def _q(spark: SparkSession, d: str) -> DataFrame:
        return _a(spark, d).groupBy("g").agg(F.round(make(), places).alias("v"))


_agg("circ_mean", "atan2(sum(sin(x)), sum(cos(x)))", lambda: C.mean(F.col("x")))
_agg("circ_mean_weighted", "atan2(sum(w*sin(x)), sum(w*cos(x)))", lambda: C.mean(F.col("x"), F.col("w")))
_agg("circ_resvec", _R1, lambda: C.resvec(F.col("x")))
_agg("circ_resvec_corrected", f"{_R1} * 0.05::DOUBLE / sin(0.05::DOUBLE)", lambda: C.resvec(F.col("x"), d=0.1))
_agg("circ_var", f"1 - {_R1}", lambda: C.var(F.col("x")))
_agg("circ_var_angular", f"2 * (1 - {_R1})", lambda: C.var(F.col("x"), angvar=True))
_agg("circ_std", f"sqrt(-2 * ln({_R1}))", lambda: C.std(F.col("x")))
_agg("circ_std_root", f"degrees(sqrt(1 - {_R1}))", lambda: C.std(F.degrees("x"), deg=True, varroot=True), 4)
_agg(
    "circ_kappa",
    f"CASE WHEN {_R1} < 0.53 THEN 2*{_R1} + ({_R1})**3 + 5*({_R1})**5/6 WHEN {_R1} < 0.85 THEN -0.4 + 1.39*{_R1} + 0.43/(1-{_R1}) ELSE 1/(({_R1})**3 - 4*({_R1})**2 + 3*{_R1}) END",
    lambda: C.kappa(F.col("x")),
)
_agg(
    "circ_corrcc",
    "4*(sum(cos(x)*cos(y))*sum(sin(x)*sin(y)) - sum(cos(x)*sin(y))*sum(sin(x)*cos(y))) / sqrt((count(*)::DOUBLE**2 - sum(cos(2*x))**2 - sum(sin(2*x))**2) * (count(*)::DOUBLE**2 - sum(cos(2*y))**2 - sum(sin(2*y))**2))",
    lambda: C.corrcc(F.col("x"), F.col("y")),
)


@query("circ_csr", f"WITH {_A} SELECT g, round(avg(cos(x)), 6) AS c, round(avg(sin(x)), 6) AS s, round({_R1}, 6) AS r FROM a GROUP BY g")
def _csr(spark: SparkSession, d: str) -> DataFrame:
    got = _a(spark, d).groupBy("g").agg(C.csr(F.col("x")).alias("z"))
    return got.select("g", *[F.round(f"z.{k}", 6).alias(k) for k in "csr"])


#: Quantiles of chi-square with one degree of freedom.
_CHI2 = {0.9: 2.705543454095404, 0.95: 3.841458820694124, 0.99: 6.634896601021213}


def _half(ci: float) -> str:
    """Subject, mean and half width of its confidence interval in SQL, over angles a sixth as wide."""
    c2 = f"{_CHI2[ci]!r}::DOUBLE"
    return f"""WITH {_A}, n AS (SELECT q, atan2(sum(sin(x)), sum(cos(x))) AS m, count(x)::DOUBLE AS n, sqrt(sum(cos(x))**2 + sum(sin(x))**2) / count(x) AS r FROM (SELECT x / 6 AS x, g AS q FROM a) GROUP BY q),
    h AS (SELECT q AS g, m, acos(CASE WHEN r < 0.9 AND r > sqrt({c2}/2/n) THEN sqrt(2*n*(2*(n*r)**2 - n*{c2})/(4*n-{c2})) WHEN r >= 0.9 THEN sqrt(n**2 - (n**2 - (n*r)**2)*exp({c2}/n)) END / (n*r)) AS h FROM n)"""


def _narrow(spark: SparkSession, d: str) -> DataFrame:
    return _a(spark, d).withColumn("x", F.col("x") / 6)


@query("circ_confmean", f"{_half(0.95)} SELECT g, round(h, 6) AS v FROM h")
def _conf(spark: SparkSession, d: str) -> DataFrame:
    return _narrow(spark, d).groupBy("g").agg(F.round(C.confmean(F.col("x")), 6).alias("v"))


@query("circ_confmean_90", f"{_half(0.9)} SELECT g, round(h, 6) AS v FROM h")
def _conf_90(spark: SparkSession, d: str) -> DataFrame:
    return _narrow(spark, d).groupBy("g").agg(F.round(C.confmean(F.col("x"), ci=0.9), 6).alias("v"))


@query("circ_mean_bounds_99", f"{_half(0.99)} SELECT g, round(m, 6) AS mean, round(m + h, 6) AS upper, round(m - h, 6) AS lower FROM h")
def _bounds(spark: SparkSession, d: str) -> DataFrame:
    b = _narrow(spark, d).groupBy("g").agg(C.mean_bounds(F.col("x"), ci=0.99).alias("b"))
    return b.select("g", *[F.round(f"b.{c}", 6).alias(c) for c in ("mean", "upper", "lower")])


@query("circ_vmpar", f"WITH {_A} SELECT g, round(atan2(sum(sin(x)), sum(cos(x))), 5) AS mean, round(2*{_R1} + ({_R1})**3 + 5*({_R1})**5/6, 5) AS kappa FROM a GROUP BY g")
def _vmpar(spark: SparkSession, d: str) -> DataFrame:
    got = _a(spark, d).groupBy("g").agg(C.vmpar(F.col("x")).alias("z"))
    return got.select("g", F.round("z.mean", 5).alias("mean"), F.round("z.kappa", 5).alias("kappa"))


# ln I0 by its series in logarithms, which holds at any concentration.
_LN_I0 = "(SELECT max(t) + ln(sum(exp(t - m))) FROM (SELECT t, max(t) OVER () AS m FROM (SELECT 2 * i * ln({k} / 2) - 2 * lgamma(i + 1) AS t FROM range(0, 900) r(i))))"


@query("circ_vmlogpdf", f"WITH {_A}, i0 AS (SELECT w, {_LN_I0.format(k='(w * 8::DOUBLE)')} AS ln_i0 FROM (SELECT DISTINCT w FROM a)) SELECT g, round(avg(-ln(2*pi()) - ln_i0 + w * 8 * cos(x)), 4) AS v FROM a JOIN i0 USING (w) GROUP BY g")
def _vmlog(spark: SparkSession, d: str) -> DataFrame:
    return _a(spark, d).groupBy("g").agg(F.round(F.avg(C.vmlogpdf(F.col("x"), 0.0, F.col("w") * 8)), 4).alias("v"))


@query("circ_vmpdf", f"WITH {_A} SELECT g, round(avg(exp(-ln(2*pi()) - {_LN_I0.format(k='2.5::DOUBLE')} + 2.5*cos(x - 0.5))), 6) AS v, round(avg(exp(-ln(2*pi()) - {_LN_I0.format(k='120::DOUBLE')} + 120*cos(x - 0.5))), 6) AS sharp FROM a GROUP BY g")
def _vmpdf(spark: SparkSession, d: str) -> DataFrame:
    return _a(spark, d).groupBy("g").agg(F.round(F.avg(C.vmpdf(F.col("x"), 0.5, 2.5)), 6).alias("v"), F.round(F.avg(C.vmpdf(F.col("x"), 0.5, 120.0)), 6).alias("sharp"))


_ROW = f"WITH {_A}, s AS (SELECT DISTINCT x, y FROM a WHERE x IS NOT NULL)"


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return _a(spark, d).where("x IS NOT NULL").select("x", "y").distinct()


@query("circ_difference", f"{_ROW} SELECT round(x, 6) AS x, round(y, 6) AS y, round(CASE WHEN abs(x-y) > pi() THEN x-y - sign(x-y)*2*pi() ELSE x-y END, 5) + 0.0 AS v FROM s")
def _diff(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).withColumn("v", F.round(C.difference(F.col("x"), F.col("y")), 5) + 0.0).withColumns({c: F.round(c, 6) for c in "xy"})


@query("circ_wrapdiff", f"{_ROW} SELECT round(x, 6) AS x, round(y, 6) AS y, round(CASE WHEN abs(degrees(x-2*y)) > 180 THEN degrees(x-2*y) - sign(x-2*y)*360 ELSE degrees(x-2*y) END, 4) + 0.0 AS v FROM s")
def _wrap(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).withColumn("v", F.round(C.wrapdiff(F.degrees(F.col("x") - 2 * F.col("y")), deg=True), 4) + 0.0).withColumns({c: F.round(c, 6) for c in "xy"})


@query("circ_normalize", f"{_ROW} SELECT round(x, 6) AS x, round(y, 6) AS y, round(CASE WHEN (x-y) % (2*pi()) < 0 THEN (x-y) % (2*pi()) + 2*pi() ELSE (x-y) % (2*pi()) END, 5) + 0.0 AS v FROM s")
def _norm(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).withColumn("v", F.round(C.normalize(F.col("x") - F.col("y")), 5) + 0.0).withColumns({c: F.round(c, 6) for c in "xy"})


@query("circ_to_complex", f"{_ROW} SELECT round(x, 6) AS x, round(y, 6) AS y, round(cos(x), 6) + 0.0 AS re, round(sin(x), 6) + 0.0 AS im FROM s")
def _complex(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).withColumn("z", C.to_complex(F.col("x"))).select(F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), *[(F.round(f"z.{k}", 6) + 0.0).alias(k) for k in ("re", "im")])


@query("circ_to_real", f"{_ROW} SELECT round(x, 6) AS x, round(y, 6) AS y, round(atan2(sin(x), cos(x)), 5) + 0.0 AS v FROM s")
def _real(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).withColumn("v", F.round(C.to_real(C.to_complex(F.col("x"))), 5) + 0.0).withColumns({c: F.round(c, 6) for c in "xy"})
