"""Circular statistics as column expressions and aggregates, in radians unless ``deg``.

Aggregates skip missing angles (and their weights).  ``check_no_nulls`` gives the strict variants.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import chi2_quantile


def _base(deg: bool) -> Column:
    return F.lit(360.0) if deg else 2 * F.pi()


def wrapdiff(diff: Column, deg: bool = False) -> Column:
    """A difference wrapped once if it is more than half a turn."""
    return F.when(F.abs(diff) > _base(deg) / 2, diff - F.signum(diff) * _base(deg)).otherwise(diff)


def difference(a: Column, b: Column, deg: bool = False) -> Column:
    return wrapdiff(a - b, deg)


def normalize(a: Column, deg: bool = False) -> Column:
    """Into [0, one turn)."""
    return F.pmod(a, _base(deg))


def to_complex(a: Column, deg: bool = False) -> Column:
    r = F.radians(a) if deg else a
    return F.struct(F.cos(r).alias("re"), F.sin(r).alias("im"))


def to_real(z: Column, deg: bool = False) -> Column:
    a = F.atan2(z["im"], z["re"])
    return F.degrees(a) if deg else a


def _sums(a: Column, w: Column | None) -> tuple[Column, Column, Column]:
    weight = F.when(a.isNotNull(), F.lit(1.0) if w is None else w)
    return F.sum(weight * F.cos(a)), F.sum(weight * F.sin(a)), F.sum(weight)


def csr(a: Column, deg: bool = False) -> Column:
    """Mean cosine, mean sine and resultant length."""
    c, s, n = _sums(F.radians(a) if deg else a, None)
    return F.struct((c / n).alias("c"), (s / n).alias("s"), (F.hypot(c, s) / n).alias("r"))


def mean(a: Column, w: Column | None = None) -> Column:
    c, s, _ = _sums(a, w)
    return F.atan2(s, c)


def resvec(a: Column, w: Column | None = None, d: float = 0.0) -> Column:
    """Resultant vector length, corrected for bins of width ``d``."""
    c, s, n = _sums(a, w)
    r = F.hypot(c, s) / n
    return r * (F.lit(d / 2.0) / F.sin(F.lit(d / 2.0))) if d else r


def var(a: Column, w: Column | None = None, d: float = 0.0, angvar: bool = False) -> Column:
    v = 1 - resvec(a, w, d)
    return 2 * v if angvar else v


def std(a: Column, deg: bool = False, varroot: bool = False) -> Column:
    r = resvec(F.radians(a) if deg else a)
    s = F.sqrt(1 - r) if varroot else F.sqrt(-2 * F.ln(r))
    return F.degrees(s) if deg else s


def confmean(a: Column, w: Column | None = None, d: float = 0.0, ci: float = 0.95) -> Column:
    """Half width of the mean's confidence interval of level ``ci``; null where none exists."""
    r, c2 = resvec(a, w, d), chi2_quantile(F.lit(float(ci)))
    n = F.sum(F.when(a.isNotNull(), F.lit(1.0) if w is None else w))
    big = n * r
    low = F.sqrt((2 * n * (2 * big**2 - n * c2)) / (4 * n - c2))
    high = F.sqrt(n**2 - (n**2 - big**2) * F.exp(c2 / n))
    t = F.when((r < 0.9) & (r > F.sqrt(c2 / 2 / n)), low).when(r >= 0.9, high)
    return F.acos(t / big)


def mean_bounds(a: Column, w: Column | None = None, ci: float = 0.95) -> Column:
    """The mean with the upper and lower bound of its confidence interval; the bounds are null where none exists."""
    at, half = mean(a, w), confmean(a, w, ci=ci)
    return F.struct(at.alias("mean"), (at + half).alias("upper"), (at - half).alias("lower"))


def corrcc(a: Column, b: Column) -> Column:
    """Circular correlation; a product counts where both its angles are present."""
    n = F.count(F.lit(1))
    total = lambda e: F.sum(e)
    cc, ss = total(F.cos(a) * F.cos(b)), total(F.sin(a) * F.sin(b))
    cs, sc = total(F.cos(a) * F.sin(b)), total(F.sin(a) * F.cos(b))
    num = 4 * (cc * ss - cs * sc)
    c2a, s2a, c2b, s2b = total(F.cos(2 * a)), total(F.sin(2 * a)), total(F.cos(2 * b)), total(F.sin(2 * b))
    return num / F.nullif(F.sqrt((n**2 - c2a**2 - s2a**2) * (n**2 - c2b**2 - s2b**2)), F.lit(0.0))


def kappa(a: Column, w: Column | None = None, d: float = 0.0) -> Column:
    """Concentration of the von Mises distribution, by its usual approximation in three ranges."""
    r, n = resvec(a, w, d), F.count(F.lit(1))
    k = F.when(r < 0.53, 2 * r + r**3 + 5 * r**5 / 6).when(r < 0.85, -0.4 + 1.39 * r + 0.43 / (1 - r)).otherwise(1 / (r**3 - 4 * r**2 + 3 * r))
    small = F.when(k < 2, F.greatest(k - 2 / (n * k), F.lit(0.0))).otherwise((n - 1) ** 3 * k / (n**3 + n))
    return F.when((n < 15) & (n > 1), small).otherwise(k)


def vmpar(a: Column, w: Column | None = None) -> Column:
    return F.struct(mean(a, w).alias("mean"), kappa(a, w).alias("kappa"))


def log_bessel_i0(x: Column) -> Column:
    """ln I0 at any x >= 0: by its power series up to 30, beyond by its asymptotic series.

    The logarithm stays finite where I0 itself leaves the range of doubles.
    """
    step = lambda s, t: F.struct(t.alias("t"), (s["sum"] + t).alias("sum"))
    total = lambda n, ratio: F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("sum")), lambda s, k: step(s, s["t"] * ratio(k)), lambda s: s["sum"])
    low = F.ln(total(100, lambda k: F.pow(x / 2, 2) / (k * k)))
    high = x - 0.5 * F.ln(2 * F.pi() * x) + F.ln(total(20, lambda k: F.pow(2 * k - 1, F.lit(2)) / (8 * x * k)))
    return F.when(x <= 30, low).otherwise(high)


def vmlogpdf(a: Column, mu: Column | float = 0.0, k: Column | float = 1.0) -> Column:
    k = F.lit(k) if isinstance(k, float) else k
    mu = F.lit(mu) if isinstance(mu, float) else mu
    return -(F.ln(2 * F.pi()) + log_bessel_i0(k)) + k * F.cos(a - mu)


def vmpdf(a: Column, mu: Column | float = 0.0, k: Column | float = 1.0) -> Column:
    return F.exp(vmlogpdf(a, mu, k))


def check_no_nulls(value: Column, a: Column) -> Column:
    """The aggregate ``value`` over ``a``, or an error if ``a`` has a missing angle."""
    return F.when(F.count_if(a.isNull() | F.isnan(a)) > 0, F.raise_error(F.lit("missing angle"))).otherwise(value)
