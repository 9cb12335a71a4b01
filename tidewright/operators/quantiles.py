"""Exact quantiles per key, for keys of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bins per octave, and a number beyond that of any bin of a double.
FINE, FAR = 64, 100_000


def bin_of(v: Column) -> Column:
    """A bin that grows with the value: so many per octave on either side of zero, of which a key has at most some
    thousand whatever its size."""
    return F.when(v > 0, F.floor(F.log2(v) * FINE).cast("int") + FAR).when(v < 0, -(F.floor(F.log2(-v) * FINE).cast("int") + FAR)).otherwise(F.lit(0))


def exact_quantiles(df: DataFrame, key: str, value: str, shares: Sequence[float]) -> DataFrame:
    """key and q0, q1, ...: the quantiles of a finite column, linear between the two values at the place (n - 1) * share.

    Two passes: the counts of the bins tell which of them hold the values asked for; the distinct values of only
    those bins are then counted and ranked, within (key, bin) by pieces of the bin. Nulls do not count; null keys are a key.
    """
    # 2^-11 of a bin's width: what one task ranks of a crowded bin.
    x = df.where(F.col(value).isNotNull()).select(F.struct(key).alias("_key"), F.col(value).cast("double").alias("_v"), bin_of(F.col(value)).alias("_b"))
    counts = x.groupBy("_key", "_b").agg(F.count("*").alias("_c"))
    run = W.partitionBy("_key").orderBy("_b")
    c = counts.withColumn("_end", F.sum("_c").over(run)).withColumn("_n", F.sum("_c").over(W.partitionBy("_key")))
    places = [((F.col("_n") - 1) * s, i) for i, s in enumerate(shares)]
    wanted = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(up).alias("up"), (F.ceil(p) if up else F.floor(p)).alias("at"), (p - F.floor(p)).alias("part")) for p, i in places for up in (False, True)))
    inside = F.filter(wanted, lambda w: (w["at"] >= F.col("_end") - F.col("_c")) & (w["at"] < F.col("_end")))
    mid = c.select("_key", "_b", (F.col("_end") - F.col("_c")).alias("_start"), inside.alias("_w")).where(F.size("_w") > 0)
    v = x.join(mid.select("_key", "_b"), ["_key", "_b"], "left_semi").groupBy("_key", "_b", "_v").agg(F.count("*").alias("_c"))
    v = v.withColumn("_p", F.floor((F.log2(F.abs("_v")) * FINE - F.floor(F.log2(F.abs("_v")) * FINE)) * 2048 * F.signum("_v")))
    pieces = v.groupBy("_key", "_b", "_p").agg(F.sum("_c").alias("_s"))
    earlier = F.sum("_s").over(W.partitionBy("_key", "_b").orderBy("_p").rowsBetween(W.unboundedPreceding, -1))
    pieces = pieces.select("_key", "_b", F.coalesce("_p", F.lit(0)).alias("_p"), F.coalesce(earlier, F.lit(0)).alias("_before"))
    own = F.sum("_c").over(W.partitionBy("_key", "_b", "_p").orderBy("_v"))
    v = v.withColumn("_p", F.coalesce("_p", F.lit(0))).withColumn("_own", own).join(pieces, ["_key", "_b", "_p"])
    v = v.join(mid, ["_key", "_b"]).withColumn("_end", F.col("_start") + F.col("_before") + F.col("_own"))
    hit = v.withColumn("_w", F.explode("_w")).where((F.col("_w.at") < F.col("_end")) & (F.col("_w.at") >= F.col("_end") - F.col("_c")))
    at = lambda i, up: F.max(F.when((F.col("_w.i") == i) & (F.col("_w.up") == up), F.col("_v")))
    part = lambda i: F.max(F.when(F.col("_w.i") == i, F.col("_w.part")))
    q = hit.groupBy("_key").agg(*((at(i, False) + (at(i, True) - at(i, False)) * part(i)).alias(f"q{i}") for i in range(len(shares))))
    return q.select(F.col(f"_key.{key}").alias(key), *(f"q{i}" for i in range(len(shares))))


def exact_median(df: DataFrame, key: str, value: str) -> DataFrame:
    """key and median: the middle value, or the mean of the two middle ones."""
    return exact_quantiles(df, key, value, [0.5]).select(key, F.col("q0").alias("median"))
