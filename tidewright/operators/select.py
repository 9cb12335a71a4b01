"""Selection: boxes, spheres and times as predicates that reach the scan."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mask_box(columns: Sequence[str], lower: Sequence[float], upper: Sequence[float]) -> Column:
    """Inside the closed box; null where a coordinate is null."""
    if not columns or not len(columns) == len(lower) == len(upper):
        raise ValueError("one lower and one upper bound per coordinate are needed")
    return reduce(lambda a, b: a & b, [F.col(c).between(lo, hi) for c, lo, hi in zip(columns, lower, upper, strict=True)])


def mask_sphere(columns: Sequence[str], center: Sequence[float], radius: float) -> Column:
    """Inside the closed sphere. The box around it comes first: a scan can skip row groups by it."""
    if not columns or len(columns) != len(center):
        raise ValueError("one centre coordinate per coordinate is needed")
    box = mask_box(columns, [c - radius for c in center], [c + radius for c in center])
    r2 = reduce(lambda a, b: a + b, [(F.col(c) - x) * (F.col(c) - x) for c, x in zip(columns, center, strict=True)])
    return box & (F.sqrt(r2) <= radius)


def time_range(df: DataFrame, column: str, start: float | None = None, stop: float | None = None) -> DataFrame:
    """Rows with start <= time < stop; a time kept as text is compared as number."""
    t = F.col(column).try_cast("double") if dict(df.dtypes)[column] == "string" else F.col(column)
    if start is not None:
        df = df.where(t >= start)
    return df if stop is None else df.where(t < stop)


def every(df: DataFrame, columns: Sequence[str], n: int) -> DataFrame:
    """Each n-th row of a grid along every index column."""
    return df.where(reduce(lambda a, b: a & b, [F.col(c) % n == 0 for c in columns]))


def temporal(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean and sample standard deviation over time per point."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
