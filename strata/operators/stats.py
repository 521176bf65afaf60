"""Sufficient statistics: count, sum, sum of squares, least and greatest of each measure.

They are partial aggregates: any grouping of the same rows merges to the same cells.
A cell without values has sums of 0.0 and no extremes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTS = ("count", "sum", "sumsq", "min", "max")


def names(measure: str) -> list[str]:
    return [f"{measure}_{part}" for part in PARTS]


def cells(measures: list[str]) -> list[Column]:
    """Aggregates of raw rows."""
    out = []
    for m in measures:
        value = F.col(f"`{m}`").cast("double")
        out += [F.count(value).alias(f"{m}_count"), F.coalesce(F.sum(value), F.lit(0.0)).alias(f"{m}_sum"), F.coalesce(F.sum(value * value), F.lit(0.0)).alias(f"{m}_sumsq"), F.min(value).alias(f"{m}_min"), F.max(value).alias(f"{m}_max")]
    return out


def merged(measures: list[str]) -> list[Column]:
    """Aggregates of cells; a cell from before its measure was added counts as one without values."""
    zero = {"count": F.lit(0).cast("long"), "sum": F.lit(0.0), "sumsq": F.lit(0.0)}
    how = {"min": F.min, "max": F.max}
    return [(F.coalesce(F.sum(f"`{m}_{part}`"), zero[part]) if part in zero else how[part](f"`{m}_{part}`")).alias(f"{m}_{part}") for m in measures for part in PARTS]


def average(measure: str) -> Column:
    return F.col(f"`{measure}_sum`") / F.nullif(F.col(f"`{measure}_count`"), F.lit(0))


def variance(measure: str) -> Column:
    """Population variance from a cell; never below zero."""
    n = F.nullif(F.col(f"`{measure}_count`"), F.lit(0))
    s = F.col(f"`{measure}_sum`")
    return F.greatest((F.col(f"`{measure}_sumsq`") - s * s / n) / n, F.lit(0.0))


def deviation(measure: str) -> Column:
    return F.sqrt(variance(measure))


def by_series(rows: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Cells for each series; a null is a key like any other."""
    if not measures:
        return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    return rows.groupBy(*keys).agg(*cells(measures))
