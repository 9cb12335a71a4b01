"""Repair of outliers per row over time, by the interquartile range."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewright.operators.quantiles import exact_quantiles
from tidewright.session import STRETCH, positions, with_neighbours


def lower_median(values: Column) -> Column:
    """The smaller of the two middle values of an array column."""
    return F.element_at(F.array_sort(values), ((F.size(values) + 1) / 2).cast("int"))


def iqr_outliers(df: DataFrame, key: str, order: str, value: str, k: float = 1.5, nb: int = 3, replace: Callable[[Column], Column] = lower_median, block: int = STRETCH) -> DataFrame:
    """key, order, value, ``outlier`` and ``repaired``.

    Quartiles interpolate linearly. A value is an outlier if it lies more than ``k`` interquartile ranges
    beyond a quartile; it is replaced by ``replace`` of the original values from ``nb`` before it to ``nb``
    - 1 after it. Null values are neither counted nor replaced, nor are values that are not finite. Quartiles are exact
    (``quantiles.exact_quantiles``) and neighbours come from overlapping blocks, so no task holds a whole series.
    """
    df = df.select(key, order, value)
    finite = ~F.isnan(F.col(value).cast("double")) & (F.abs(value) < float("inf"))
    q = exact_quantiles(df.where(finite), key, value, [0.25, 0.75]).withColumnRenamed(key, "_key")
    x = with_neighbours(positions(df, [key], [order], target=block), "_pos", before=nb, after=max(0, nb - 1), block=max(block, nb + 1))
    near = W.partitionBy(key, "_block").orderBy("_pos").rowsBetween(-nb, nb - 1)
    x = x.withColumn("_near", F.collect_list(value).over(near)).where("_own")
    x = x.join(q, F.col(key).eqNullSafe(F.col("_key")), "left")
    iqr = F.col("q1") - F.col("q0")
    out = (F.col(value) < F.col("q0") - k * iqr) | (F.col(value) > F.col("q1") + k * iqr)
    x = x.withColumn("outlier", F.coalesce(out & finite, F.lit(False)))
    return x.select(key, order, value, "outlier", F.when(F.col("outlier"), replace(F.col("_near"))).otherwise(F.col(value)).alias("repaired"))
