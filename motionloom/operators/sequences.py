"""Window operators on ordered series: interpolation, rolling statistics, differences, islands.

Every operator partitions by the series' key and orders by its position, so chained operators
share one shuffle.  Looking ahead is done by a descending order with a running frame, which
Spark evaluates in one pass (a frame up to the unbounded end is evaluated again for every row).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

T = "__loom_"


def _over(keys: list[str], order: str, descending: bool = False):  # noqa: ANN202 - a WindowSpec
    by = F.col(order).desc() if descending else F.col(order)
    return Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def interpolate(df: DataFrame, columns: list[str], keys: list[str], order: str, max_gap: int | None = None) -> DataFrame:
    """Fill missing values on a line between their neighbours, by position.

    Without ``max_gap``: leading gaps stay, trailing gaps hold the last value.  With it: only inner
    gaps of at most that many rows are filled, and nothing is extrapolated.
    """
    ahead, behind, at = _over(keys, order), _over(keys, order, True), {}
    # All columns' neighbours together, so that Spark evaluates each direction in one window.
    for k, c in enumerate(columns):
        place = F.when(F.col(c).isNotNull(), F.col(order))
        at |= {f"{T}a{k}": F.last(c, True).over(ahead), f"{T}i{k}": F.last(place, True).over(ahead), f"{T}b{k}": F.last(c, True).over(behind), f"{T}j{k}": F.last(place, True).over(behind)}
    df, filled = df.withColumns(at), {}
    for k, c in enumerate(columns):
        a, i, b, j = (F.col(f"{T}{x}{k}") for x in "aibj")
        line = a + (b - a) * (F.col(order) - i) / F.nullif(j - i, F.lit(0))
        if max_gap is None:
            filled[c] = F.when(F.col(c).isNotNull(), F.col(c)).when(b.isNull(), a).otherwise(line)
        else:
            filled[c] = F.when(F.col(c).isNotNull(), F.col(c)).when(j - i - 1 <= max_gap, line)
    return df.withColumns(filled).drop(*at)


def _range(keys: list[str], order: str, width: str, before: str, after: str) -> str:
    return f"OVER (PARTITION BY {', '.join(keys)} ORDER BY {order} / CAST({width} AS double) RANGE BETWEEN {before} AND {after})"


def _rolled(df: DataFrame, columns: dict[str, str], over: str, width: str, how: str) -> DataFrame:
    value = "percentile({c}, 0.5)" if how == "median" else "avg({c})"
    return df.withColumns({out: F.expr(f"CASE WHEN count({c}) {over} = {width} THEN {value.format(c=c)} {over} END") for out, c in columns.items()})


def rolling_centered(df: DataFrame, columns: dict[str, str], keys: list[str], order: str, width: str, how: str) -> DataFrame:
    """Median or mean of the ``width`` rows around each row; null unless all of them have a value.

    ``columns`` maps each result to its column; a result may replace its column.  The width is a
    column.  An even width leans to earlier rows.
    """
    return _rolled(df, columns, _range(keys, order, width, "0.500000001D PRECEDING", "0.499999999D FOLLOWING"), width, how)


def rolling_trailing(df: DataFrame, columns: dict[str, str], keys: list[str], order: str, width: str) -> DataFrame:
    """Mean of each row and the ``width`` - 1 rows before it; null unless all have a value."""
    return _rolled(df, columns, _range(keys, order, width, "0.999999999D PRECEDING", "CURRENT ROW"), width, "mean")


def delta(column: str, keys: list[str], order: str) -> Column:
    """Difference to the row before; 0 in the first row, null where the value is null."""
    w = Window.partitionBy(*keys).orderBy(order)
    return F.when(F.row_number().over(w) == 1, F.col(column) * 0).otherwise(F.col(column) - F.lag(column).over(w))


def angle_delta(column: str, keys: list[str], order: str) -> Column:
    """Shortest signed turn from the row before, in degrees; 0 in the first row."""
    w = Window.partitionBy(*keys).orderBy(order)
    d = F.col(column) - F.lag(column).over(w)
    near = F.when((F.abs(d) <= F.abs(d + 360)) & (F.abs(d) <= F.abs(d - 360)), d).when(F.abs(d + 360) <= F.abs(d - 360), d + 360).otherwise(d - 360)
    return F.when(F.row_number().over(w) == 1, F.col(column) * 0).otherwise(near)


def gradient(column: str, dt: Column, keys: list[str], order: str) -> Column:
    """Central differences, one-sided at the ends; missing values spread."""
    w = Window.partitionBy(*keys).orderBy(order)
    before, after, x = F.lag(column).over(w), F.lead(column).over(w), F.col(column)
    first, last = F.row_number().over(w) == 1, F.lead(F.lit(1)).over(w).isNull()
    return F.when(first, (after - x) / dt).when(last, (x - before) / dt).otherwise((after - before) / (2 * dt))


def islands(df: DataFrame, keys: list[str], order: list[str], starts: Column, out: str) -> DataFrame:
    """Number the runs of each series; a run starts where ``starts`` holds (and at the first row)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.sum(F.when((F.row_number().over(w) == 1) | starts, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last record of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return df.withColumn(f"{T}n", F.row_number().over(w)).where(f"{T}n = 1").drop(f"{T}n")
