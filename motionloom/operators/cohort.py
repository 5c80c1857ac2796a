"""Cohort statistics: feature naming, reference fits, log-likelihood scores, rank tests, regression."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as Z
from .order_statistics import placed_counts


#: The scored features, part first: those of points, then those of joints.
SCORED_FEATURES = [f"{part}_{stat}" for stat in "medianx mediany IQRx IQRy medianvelx medianvely IQRvelx IQRvely IQRaccx IQRaccy meanent lrCorr_x".split() for part in ("Ankle", "Wrist")] + [
    f"{part}_{stat}" for stat in "mean_angle stdev_angle median_vel_angle IQR_vel_angle IQR_acc_angle entropy_angle lrCorr_angle".split() for part in ("Knee", "Elbow")
]


def whitelist(df: DataFrame, ids: list[str], features: list[str] = SCORED_FEATURES, expected: int = 38) -> DataFrame:
    """Only the scored features beside the ids; an error if the list or the table is not complete."""
    if len(set(features)) != expected:
        raise ValueError(f"{len(set(features))} features are listed, {expected} are scored")
    missing = [f for f in features if f not in df.columns]
    if missing:
        raise ValueError(f"{len(missing)} of {expected} scored features are missing, such as {', '.join(missing[:5])}")
    return df.select(*ids, *features)


def melt(df: DataFrame, ids: list[str], features: list[str]) -> DataFrame:
    """Wide features to rows (ids, stat, side, part, value)."""
    long = df.unpivot(ids, features, "feature", "value")
    return long.withColumn("f", Z.split_feature(F.col("feature"))).select(*ids, "feature", "f.stat", "f.side", "f.part", "value")


def lr_mean(long: DataFrame, ids: list[str]) -> DataFrame:
    """Mean of left and right of each feature; one-sided values stay, and the sides are counted."""
    return long.groupBy(*ids, "part", "stat").agg(F.avg("value").alias("value"), F.count("value").alias("n_sides"))


def joint_table(df: DataFrame, ids: list[str], features: list[str]) -> DataFrame:
    """Wide sided features to wide <part>_<stat>, the mean of the sides there are."""
    name = lambda f: f.rpartition("_")
    names = list(dict.fromkeys(f"{last if stat.startswith('lrCorr') else last[1:]}_{stat}" for stat, _, last in map(name, features)))
    means = lr_mean(melt(df, ids, features), ids).withColumn("feature", F.concat("part", F.lit("_"), "stat"))
    return means.groupBy(*ids).pivot("feature", names).agg(F.first("value"))


def collapse_windows(df: DataFrame, name: str, values: list[str]) -> DataFrame:
    """Rows named id_start-ends to the unweighted mean of each id; all names must parse, or none."""
    df = df.withColumn("w", Z.window_name(F.col(name)))
    state = df.agg(F.count_if(F.col("w.id").isNotNull()).alias("n"), F.count("*").alias("total"))
    checked = state.select(F.when((F.col("n") > 0) & (F.col("n") < F.col("total")), F.raise_error(F.lit("some names are windowed, some are not"))).otherwise(F.col("n")).alias("n_windowed"))
    means = df.groupBy(F.coalesce("w.id", name).alias(name)).agg(*[F.avg(v).alias(v) for v in values])
    return means.join(F.broadcast(checked), F.col("n_windowed") >= 0).drop("n_windowed")  # one row of a check


def fit_reference(long: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """Mean, population deviation and count of each feature; thin or constant ones are left out."""
    fit = long.groupBy(*keys).agg(F.avg("value").alias("mu"), F.stddev_pop("value").alias("sigma"), F.count("value").alias("n_ref"), F.sum("value").alias("s1"), F.sum(F.col("value") ** 2).alias("s2"))
    return fit.where((F.col("n_ref") >= least) & (F.col("sigma") > 0))


def logliks(long: DataFrame, fit: DataFrame, keys: list[str], is_ref: Column) -> DataFrame:
    """Log-likelihood of every value, in sample and with the own value left out of the reference."""
    # The fit has one row a feature: whatever the cohort, it is small; AQE picks the join.
    j = long.where(F.col("value").isNotNull()).join(fit, keys)
    rest = F.col("n_ref") - 1
    m = (F.col("s1") - F.col("value")) / F.nullif(rest, F.lit(0))
    v = (F.col("s2") - F.col("value") ** 2) / F.nullif(rest, F.lit(0)) - m**2
    own = Z.gauss_loglik(F.col("value"), F.col("mu"), F.col("sigma") ** 2)
    left_out = F.when(is_ref & (rest >= 3) & (v > 0), Z.gauss_loglik(F.col("value"), m, v)).otherwise(own)
    return j.withColumns({"loglik": own, "loglik_loo": left_out})


def surprise(scores: DataFrame, ids: list[str], is_ref: Column, low: int = 19) -> DataFrame:
    """Sum, count, z against the reference group (sample deviation), p and coverage of each subject."""
    per = scores.groupBy(*ids).agg(F.sum("loglik").alias("loglik"), F.sum("loglik_loo").alias("loglik_loo"), F.count("loglik").alias("n_features"))
    ref = per.where(is_ref).agg(*[f(c).alias(f"{n}_{c}") for c in ("loglik", "loglik_loo") for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    z = lambda c: (F.col(c) - F.col(f"m_{c}")) / F.nullif(F.col(f"s_{c}"), F.lit(0.0))
    out = per.join(F.broadcast(ref), F.lit(True), "left")  # one aggregate row
    out = out.withColumns({"z": z("loglik"), "z_loo": z("loglik_loo"), "per_feature": F.col("loglik") / F.col("n_features"), "low_coverage": F.col("n_features") < low})
    return out.withColumn("p", F.round(Z.p_two_sided(F.col("z")), 4)).drop(*[f"{n}_{c}" for c in ("loglik", "loglik_loo") for n in "ms"])


def z_bands(z: Column) -> Column:
    return F.when(z <= -1.96, "high").when(z <= -1, "moderate").otherwise("low")


def _exact_p(u: float, n1: int, n2: int) -> float:
    """Exact two-sided p of a rank sum without ties, by counting arrangements in whole numbers.

    The arrangements of each u are the coefficients of the Gaussian binomial, built up over the
    smaller group; only those of the lower tail are needed.
    """
    m, n = sorted((n1, n2))
    every = math.comb(n + m, m)
    ways = np.zeros(int(min(u, n1 * n2 - u)) + 1, np.int64 if every < 1 << 62 else object)
    ways[0] = 1
    for i in range(1, m + 1):  # times 1 - q^(n+i), divided by 1 - q^i
        if len(ways) > n + i:
            ways[n + i :] = ways[n + i :] - ways[: -n - i]
        for r in range(min(i, len(ways))):
            ways[r::i] = np.cumsum(ways[r::i])
    return min(1.0, 2 * int(ways.sum()) / every)


def mann_whitney(df: DataFrame, keys: list[str], value: str, in_ref: str, small: int = 8) -> DataFrame:
    """Two-sided rank test of the reference against the rest: exact where a group has at most ``small``
    values and none are tied, otherwise normal with tie and continuity corrections."""
    counts = placed_counts(df, keys, value, {"own": F.count_if(F.col(in_ref)), "others": F.count_if(~F.col(in_ref))})
    rank = F.col("before") + (F.col("ties") + 1) / 2
    t = F.col("ties").cast("double")
    per = counts.groupBy(*keys).agg(F.sum("own").alias("n1"), F.sum("others").alias("n2"), F.sum(F.when(F.col("own") > 0, F.col("own") * rank)).alias("r1"), F.sum(t * (t * t - 1)).alias("t3"))
    n1, n2 = F.col("n1"), F.col("n2")
    n = n1 + n2
    per = per.withColumn("u1", F.col("r1") - n1 * (n1 + 1) / 2)
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("t3") / F.nullif(n * (n - 1), F.lit(0))))
    z = (F.greatest(F.col("u1"), n1 * n2 - F.col("u1")) - n1 * n2 / 2 - 0.5) / F.nullif(sd, F.lit(0.0))
    per = per.withColumn("p", F.least(F.lit(1.0), Z.p_two_sided(F.greatest(z, F.lit(0.0)))))

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i, row in pdf.iterrows():
                if row.t3 == 0 and 0 < row.n1 and 0 < row.n2 and min(row.n1, row.n2) <= small:
                    pdf.loc[i, "p"] = _exact_p(row.u1, int(row.n1), int(row.n2))
            yield pdf

    return per.mapInPandas(exact, per.schema)


def group_tests(scored: DataFrame, group: str, scores: dict[str, str], reference: int = 0) -> DataFrame:
    """Each group, and all others together (null), against the reference: n, mean z and rank-test p.

    ``scores`` maps each score to its z column; every score gives a row of its own.  The reference is
    repeated once for each group it is held against, so rows grow with the number of groups only.
    """
    others = scored.where(F.col(group) != reference).select(group).distinct().agg(F.collect_set(group).alias("__loom_g"))  # a few groups
    own = scored.where(F.col(group).isNotNull())
    in_ref = F.col(group) == reference
    dealt = own.join(F.broadcast(others), F.lit(True))
    dealt = dealt.withColumn("against", F.explode(F.when(in_ref, F.concat("__loom_g", F.array(F.lit(None).cast(dict(own.dtypes)[group])))).otherwise(F.array(F.col(group), F.lit(None)))))
    long = dealt.select("against", in_ref.alias("in_ref"), F.explode(F.array(*[F.struct(F.lit(s).alias("score"), F.col(s).cast("double").alias("value"), F.col(z).cast("double").alias("z")) for s, z in scores.items()])).alias("s")).select("against", "in_ref", "s.*")
    means = long.where("NOT in_ref").groupBy("against", "score").agg(F.count("*").alias("n"), F.avg("z").alias("mean_z"))
    tests = mann_whitney(long.withColumn("against", F.coalesce(F.col("against").cast("string"), F.lit(""))), ["against", "score"], "value", "in_ref").select("against", "score", "p")
    keyed = means.withColumn("k", F.coalesce(F.col("against").cast("string"), F.lit(""))).drop("against")
    return keyed.join(tests.withColumnRenamed("against", "k"), ["k", "score"]).select(F.nullif("k", F.lit("")).alias("against"), "score", "n", "mean_z", "p")


def _standardised(df: DataFrame, columns: list[str]) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """The columns as z-scores (missing ones 0) beside all others, their cross products and their means.

    Only these leave the executors: a matrix of fixed size whatever the rows.
    """
    stats = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    z = df.withColumns({c: F.coalesce((F.col(c) - stats[f"m_{c}"]) / (stats[f"s_{c}"] or 1.0), F.lit(0.0)) for c in columns})
    pairs = [F.sum(F.col(a) * F.col(b)).alias(f"{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if i <= j]
    got = z.agg(*pairs, *[F.avg(c).alias(f"mean_{i}") for i, c in enumerate(columns)]).first()
    k = len(columns)
    return z, np.array([[got[f"{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)]), np.array([got[f"mean_{i}"] or 0.0 for i in range(k)])


def svd_variance(df: DataFrame, columns: list[str]) -> DataFrame:
    """Share of variance of each singular value of the z-scored columns, to two places."""
    _, products, _ = _standardised(df, columns)
    s2 = np.clip(np.linalg.eigvalsh(products)[::-1], 0, None)
    total = s2.sum() or 1.0
    return df.sparkSession.createDataFrame([(k + 1, float(np.round(x / total, 2))) for k, x in enumerate(s2)], "component int, share double")


def svd_left(df: DataFrame, columns: list[str], n: int = 3) -> DataFrame:
    """The rows with sv1, sv2, ...: how far each lies from the mean of the first ``n`` left singular vectors.

    Rows are projected on the eigenvectors of the columns' cross products where they are; the distance does
    not depend on the vectors' signs.  A vector of no variance is null.
    """
    z, products, means = _standardised(df, columns)
    values, vectors = np.linalg.eigh(products)
    out = {}
    for k in range(n):
        value, vector = values[-1 - k], vectors[:, -1 - k]
        if value <= 1e-12 * max(values[-1], 1e-300):
            out[f"sv{k + 1}"] = F.lit(None).cast("double")
            continue
        weights = vector / math.sqrt(value)
        along = sum((F.col(c) * float(w) for c, w in zip(columns, weights, strict=True)), F.lit(0.0))
        out[f"sv{k + 1}"] = F.abs(along - float(means @ weights))
    return z.withColumns(out).drop(*columns)


def poly2(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Quadratic least squares of each group by its normal equations (Cramer's rule)."""
    s = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys).agg(*[F.sum(F.col(x) ** k).alias(f"s{k}") for k in range(5)], *[F.sum(F.col(y) * F.col(x) ** k).alias(f"t{k}") for k in range(3)])
    det = lambda m: m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0]) + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])
    base = [[F.col(f"s{i + j}") for j in range(3)] for i in range(3)]
    whole = det(base)
    out = []
    for k in range(3):
        m = [[F.col(f"t{i}") if j == k else base[i][j] for j in range(3)] for i in range(3)]
        out.append((det(m) / F.nullif(whole, F.lit(0.0))).alias(f"c{k}"))
    return s.select(*keys, *out)
