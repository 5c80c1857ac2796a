"""Ranks and exact quantiles of groups of any size.

A group's distinct values are counted first, then dealt by ranges of (group, value); each part counts
on from what the parts before it hold.  So no window, sort or percentile has a whole group in one task, and
a value that is repeated a lot is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..work import materialise

_PART, _START, _WHOLE = "__loom_part", "__loom_start", "__loom_whole"


def placed_counts(df: DataFrame, keys: list[str], value: str, extra: dict[str, Column] | None = None) -> DataFrame:
    """Distinct values of each group: keys, value, ties, ``extra`` aggregates, ``before`` (rows with less) and ``n`` (rows of the group).

    Null values are left out; NaN is the largest value.  Written to the shared folder, as parts are numbered.
    """
    extra = extra or {}
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("ties"), *[c.alias(name) for name, c in extra.items()])
    parts = materialise(counts.repartitionByRange(*keys, value).withColumn(_PART, F.spark_partition_id()), "placed-counts")
    # One row for each group and part; a group has no more of them than there are parts.
    sums = parts.groupBy(*keys, _PART).agg(F.sum("ties").alias(_START))
    earlier = Window.partitionBy(*keys).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, _PART, F.coalesce(F.sum(_START).over(earlier), F.lit(0)).alias(_START), F.sum(_START).over(Window.partitionBy(*keys)).alias(_WHOLE))
    within = Window.partitionBy(*keys, _PART).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = parts.withColumn("before", F.coalesce(F.sum("ties").over(within), F.lit(0)))
    same = [local[c].eqNullSafe(starts[c]) for c in [*keys, _PART]]
    joined = local.join(starts, same)
    return joined.select(*[local[c] for c in keys], local[value], "ties", *extra, (F.col("before") + F.col(_START)).alias("before"), F.col(_WHOLE).alias("n"))


def rank_avg(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Ranks with ties at their middle, and the number of rows tied; rows without a key or value are left out."""
    ranks = placed_counts(df, keys, value).select(*keys, value, "ties", (F.col("before") + (F.col("ties") + 1) / 2).alias("rank_avg"))
    return df.join(ranks, [*keys, value])


def exact_quantiles(df: DataFrame, keys: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """Quantiles of each group by linear interpolation, as ``at`` names them, and ``n``."""
    counts = placed_counts(df, keys, value)
    holds = lambda place: (F.col("before") <= place) & (place < F.col("before") + F.col("ties"))
    found, out = [F.max("n").alias("n")], []
    for name, q in at.items():
        place = (F.col("n") - 1) * F.lit(q)
        found += [F.max(F.when(holds(f(place)), F.col(value).cast("double"))).alias(f"{name}_{side}") for side, f in (("lo", F.floor), ("hi", F.ceil))]
        part = place - F.floor(place)
        out.append((F.col(f"{name}_lo") * (1 - part) + F.col(f"{name}_hi") * part).alias(name))
    return counts.groupBy(*keys).agg(*found).select(*keys, "n", *out)
