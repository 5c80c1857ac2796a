"""Scalar functions: numbers, names, times and loosely typed annotation values."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


#: All characters that count as white space around a text.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """The text without white space of any kind at both ends."""
    return F.trim(c, F.lit(WHITE))


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def round_half_even(c: Column, places: int = 0) -> Column:
    return F.rint(c * 10**places) / 10**places


def erfc(x: Column) -> Column:
    """Complementary error function of x >= 0, to about 13 digits at any size.

    Below 2 by the series of exp(x^2) erf(x), whose terms are all positive; from 2 on by its
    continued fraction, so that the tail keeps its digits.
    """
    term = lambda s, n: s["t"] * 2 * x * x / (2 * n + 1)
    step = lambda s, n: F.struct(term(s, n).alias("t"), (s["sum"] + term(s, n)).alias("sum"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(x.cast("double").alias("t"), x.cast("double").alias("sum")), step, lambda s: s["sum"])
    scale = F.exp(-x * x) / F.sqrt(F.pi())
    fraction = F.aggregate(F.sequence(F.lit(120), F.lit(1), F.lit(-1)), F.lit(0.0), lambda t, k: k / 2 / (x + t))
    return F.when(x < 2, 1 - 2 * scale * series).otherwise(scale / (x + fraction))


def p_two_sided(z: Column) -> Column:
    """Two-sided p of a standard normal deviate."""
    return erfc(F.abs(z) / F.sqrt(F.lit(2.0)))


def normal_quantile(p: Column) -> Column:
    """The deviate below which a standard normal value lies with probability p; null outside (0, 1).

    A rational start (to three places), then Newton steps with their second-order term on the tail of erfc.
    """
    tail = F.least(p, 1 - p)
    t = F.sqrt(-2 * F.ln(tail))
    # The coefficients of the usual rational start.
    z = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t)

    def closer(z: Column) -> Column:
        z = F.greatest(z, F.lit(0.0))
        off = (erfc(z / F.sqrt(F.lit(2.0))) / 2 - tail) * F.sqrt(2 * F.pi()) * F.exp(z * z / 2)
        return z + off / (1 - z * off / 2)

    # One step after the other, each on the value before it.
    z = F.aggregate(F.sequence(F.lit(1), F.lit(3)), z, lambda at, _: closer(at))
    return F.when((p > 0) & (p < 1), F.when(p == 0.5, 0.0).otherwise(F.signum(p - 0.5) * z))


def chi2_quantile(p: Column) -> Column:
    """The value below which chi-square with one degree of freedom lies with probability p."""
    return F.pow(normal_quantile((1 + p) / 2), F.lit(2.0))


def gauss_loglik(x: Column, mu: Column, var: Column) -> Column:
    """Log density of a normal distribution (higher is more typical)."""
    return -(0.5 * F.ln(2 * F.pi() * var) + F.pow(x - mu, 2) / (2 * var))


def risk_name(raw: Column) -> Column:
    """0, 1, 2 as low, moderate, high; any other text stripped and lower-cased."""
    clean = F.lower(strip(raw))
    return F.when(clean == "0", "low").when(clean == "1", "moderate").when(clean == "2", "high").otherwise(clean)


def age_weeks(months: Column, days: Column, per_month: float = 4.345) -> Column:
    return months * per_month + days / 7


def hhmmss(seconds: Column) -> Column:
    s = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60)


def hms_ms(seconds: Column) -> Column:
    whole = F.floor(seconds / 60).cast("long")
    return F.format_string("%02d:%02d:%06.3f", F.floor(whole / 60).cast("long"), whole % 60, seconds - whole * 60)


def url_at(url: Column, seconds: Column) -> Column:
    return F.when(url.isNotNull(), F.concat(url, F.lit("&t="), F.floor(seconds).cast("long").cast("string"), F.lit("s")))


def safe_token(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9A-Za-z._-]+", "_")


def short_id(c: Column) -> Column:
    """The 11-character id of a video address of any of its shapes; null without one."""
    return F.nullif(F.regexp_extract(c, r"(?:v=|/)([0-9A-Za-z_-]{11})(?:[?&#/]|$)", 1), F.lit(""))


def subject_of(name: Column) -> Column:
    """Second part of a name cut at - and _, if it is digits; else the name."""
    part = F.try_element_at(F.split(F.replace(name, F.lit("-"), F.lit("_")), "_"), F.lit(2))
    return F.when(part.rlike("^[0-9]+$"), part).otherwise(name)


def split_feature(name: Column) -> Column:
    """stat_LJoint -> (stat, L, Joint); lrCorr_axis_Joint -> (lrCorr_axis, '', Joint)."""
    parts = F.split(name, "_")
    last = F.element_at(parts, -1)
    head = F.array_join(F.slice(parts, 1, F.size(parts) - 1), "_")
    sided = name.startswith("lrCorr")
    return F.struct(head.alias("stat"), F.when(sided, "").otherwise(F.substring(last, 1, 1)).alias("side"), F.when(sided, last).otherwise(F.substring(last, 2, 100)).alias("part"))


def window_name(name: Column) -> Column:
    """id_start-ends -> struct of its parts, or null parts."""
    get = lambda k: F.nullif(F.regexp_extract(name, r"^(.+)_(\d+)-(\d+)s$", k), F.lit(""))
    return F.struct(get(1).alias("id"), get(2).cast("int").alias("start"), get(3).cast("int").alias("end"))


def prompt_hash8(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 8)


def prompt_hash8_of(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:8]


def is_degenerate(c: Column, least: int = 40) -> Column:
    """At least ``least`` characters after trimming, all the same."""
    t = strip(c)
    return F.coalesce((F.length(t) >= least) & (F.length(F.replace(t, F.substring(t, 1, 1), F.lit(""))) == 0), F.lit(False))


def failure_class(raw: Column, ok: Column, inconsistent: Column, cap: int) -> Column:
    return F.when(ok, F.when(inconsistent, "INCONSISTENT").otherwise("ok")).when(is_degenerate(raw), "DEGENERATE").when(F.length(raw) >= cap, "TRUNCATED").otherwise("PARSE FAILED")


def fmt_cell(value: Column, ok: Column) -> Column:
    return F.when(ok.isNull(), "-").when(~ok, "PARSE_FAIL").otherwise(F.coalesce(value.cast("string"), F.lit("-")))


def split_name(index: Column, total: Column) -> Column:
    return F.concat(F.lit("split_"), F.lpad(index.cast("string"), F.greatest(F.lit(2), F.length(total.cast("string"))), F.lit("0")))


def chunk_name(split: Column, part: Column) -> Column:
    return F.format_string("split_%02d_chunk_%02d", split.cast("int"), part.cast("int"))


def segment_key(index: Column, part: Column) -> Column:
    return index * 100 + part


def extract_json_object(raw: Column) -> Column:
    """From the first { to the last }, across lines, as a variant; null if it does not parse."""
    return F.try_parse_json(F.nullif(F.regexp_extract(raw, r"(?s)\{.*\}", 0), F.lit("")))


def kind_and_text(v: Column, path: str) -> tuple[Column, Column]:
    """The type of a value (VOID for null) and the value as text; both null where the key is missing."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.try_variant_get(v, path, "string")


def loose_text(kind: Column, text: Column) -> Column:
    """Any value as stripped text: null is None, booleans True and False; a missing key is null.

    Lists and objects are their JSON text.
    """
    return strip(F.when(kind == "VOID", "None").when(kind == "BOOLEAN", F.initcap(text)).otherwise(text))


def coerce_bool(kind: Column, text: Column) -> Column:
    """Booleans as they are; strings true/yes/1; otherwise whether the value counts as something."""
    some = F.when(kind.isNull() | (kind == "VOID"), False).when(kind == "BOOLEAN", text == "true").when(kind == "STRING", F.lower(strip(text)).isin("true", "yes", "1"))
    return some.when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), ~text.isin("[]", "{}")).otherwise(F.coalesce(text.try_cast("double") != 0, F.lit(False)))


def coerce_int(kind: Column, text: Column) -> Column:
    """max(0, whole part) as a long; strings only if they are whole numbers; anything else 0.

    Numbers beyond a long are the largest long.
    """
    whole = F.when(strip(text).rlike("^[+-]?[0-9]+(_[0-9]+)*$"), F.replace(strip(text), F.lit("_"), F.lit("")))
    long = lambda exact, near: F.when(near >= 2.0**63, F.lit((1 << 63) - 1)).otherwise(F.coalesce(exact, near.try_cast("long")))
    number = F.when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), None).otherwise(text.try_cast("double"))
    value = F.when(kind == "STRING", long(whole.try_cast("long"), whole.try_cast("double"))).when(kind == "BOOLEAN", (text == "true").cast("long")).otherwise(long(F.when(text.rlike("^-?[0-9]+$"), text.try_cast("long")), number))
    return F.greatest(F.lit(0).cast("long"), F.coalesce(value, F.lit(0).cast("long")))


def closed_scalar(v: Column, path: str, words: list[str]) -> Column:
    """The lower-cased text if it is one of the vocabulary (a null reads as none), else null."""
    low = F.lower(strip(F.try_variant_get(v, path, "string")))
    if "none" in words:
        low = F.when(F.is_variant_null(F.try_variant_get(v, path, "variant")), "none").otherwise(low)
    return F.when(low.isin(words), low)


def _items(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def closed_array(v: Column, path: str, words: list[str]) -> Column:
    """Lower-cased members of the vocabulary, order and repeats kept; [] for anything but a list."""
    return F.filter(F.transform(_items(v, path), lambda x: F.lower(strip(F.try_variant_get(x, "$", "string")))), lambda x: x.isin(words))


def objects_top(v: Column, path: str, n: int = 5) -> Column:
    """The first ``n`` items of a list as stripped texts, empty ones left out."""
    texts = F.transform(_items(v, path), lambda x: F.coalesce(loose_text(*kind_and_text(x, "$")), F.lit("None")))  # a null inside a list is no variant
    return F.slice(F.filter(texts, lambda x: x != ""), 1, n)


def key_present(v: Column, path: str) -> Column:
    """Whether the key is there at all, even with a null."""
    return F.try_variant_get(v, path, "variant").isNotNull()
