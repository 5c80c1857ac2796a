"""Left singular vectors, quantiles of distributions and confidence bounds against numpy and the standard library."""

import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from motionloom.functions import circular as C
from motionloom.functions import scalars as Z
from motionloom.operators import cohort as H


def test_left_vectors(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(60, 4)) @ rng.normal(size=(4, 4)) + 5
    df = spark.createDataFrame([(k, k % 3, *map(float, r)) for k, r in enumerate(m)], "id int, risk int, a double, b double, c double, d double")
    u = np.linalg.svd((m - m.mean(0)) / m.std(0, ddof=1), full_matrices=False)[0][:, :3]
    got = H.svd_left(df, list("abcd")).orderBy("id").collect()
    assert np.allclose([[r.sv1, r.sv2, r.sv3] for r in got], np.abs(u - u.mean(0))) and got[0].asDict().keys() == {"id", "risk", "sv1", "sv2", "sv3"}
    flat = H.svd_left(df.withColumns({"b": F.col("a"), "c": F.lit(1.0), "d": F.lit(None).cast("double")}), list("abcd")).first()
    assert flat.sv1 is not None and flat.sv2 is None and flat.sv3 is None


def test_normal_and_chi_square_quantiles(spark):
    ps = [1e-12, 1e-6, 0.001, 0.02, 0.3, 0.4999, 0.5, 0.5001, 0.9, 0.95, 0.975, 0.995, 0.9999]
    got = spark.createDataFrame([(p,) for p in [*ps, 0.0, 1.0, None]], "p double").select("p", Z.normal_quantile(F.col("p")).alias("z"), Z.chi2_quantile(F.col("p")).alias("c")).collect()
    for r in got[: len(ps)]:
        assert r.z == pytest.approx(statistics.NormalDist().inv_cdf(r.p), abs=1e-9, rel=1e-9)
        assert r.c == pytest.approx(statistics.NormalDist().inv_cdf((1 + r.p) / 2) ** 2, abs=1e-9, rel=1e-8)
    assert [r.z for r in got[len(ps) :]] == [None, None, None]


@pytest.mark.parametrize("ci,c2", [(0.9, 2.705543454095404), (0.95, 3.841458820694124), (0.99, 6.634896601021213)])
def test_bounds_of_any_level(spark, ci, c2):
    rng = np.random.default_rng(1)
    for spread, n in ((0.2, 30), (0.9, 50), (3.0, 8)):
        x = rng.normal(1.0, spread, n)
        big = abs(np.exp(1j * x).sum())
        r = big / n
        half = math.acos(math.sqrt(2 * n * (2 * big**2 - n * c2) / (4 * n - c2)) / big) if math.sqrt(c2 / 2 / n) < r < 0.9 else math.acos(math.sqrt(n**2 - (n**2 - big**2) * math.exp(c2 / n)) / big) if r >= 0.9 else None
        got = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double").agg(C.mean_bounds(F.col("x"), ci=ci).alias("b")).first().b
        assert got.mean == pytest.approx(np.angle(np.exp(1j * x).sum()))
        if half is None:
            assert got.upper is None and got.lower is None
        else:
            assert (got.upper, got.lower) == pytest.approx((got.mean + half, got.mean - half))
