"""Irregular readings of a series on its regular grid.

Interval representation: every usable reading holds from its time to the next reading's, at most for
``hold`` periods. The intervals are cut at the edges of the grid cells (a cell is what lies nearer to its
slot's time than to any other slot's); a cell's value is the time-weighted average of the pieces in it and
its coverage is the part of it that they fill.

Defined results
---------------
* a reading belongs to the nearest slot; of two equally near slots to the earlier one; readings nearest to
  a slot that the grid lacks belong to none;
* unusable readings (null, NaN; time that is no decimal number; unknown or null series) take no part;
* a cell in which no interval begins is ``filled`` if an interval reaches into it, else ``missing``;
* readings of one time are averaged; repeated rows count once, readings without an id one by one; grids
  without slots or without a series give no rows; a grid whose step is null, zero or negative has no cells
  and gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewright.session import once

#: A cell's readings are ordered in this many parts, so that no task orders all readings of a crowded cell.
PARTS = 64
#: A folder name that is a time.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def as_time(text: Column) -> Column:
    """A write time as number, null where the text is none."""
    return F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))


def nearest_slot(t: Column, start: Column, step: Column) -> Column:
    """The slot whose time start + slot * step is nearest to t."""
    s = F.floor((t - start) / step)
    return F.when(F.abs(t - (start + s * step)) <= F.abs(t - (start + (s + 1) * step)), s).otherwise(s + 1).cast("bigint")


def usable(readings: DataFrame) -> DataFrame:
    """series_id, t and value of the readings that count."""
    r = once(readings, "reading_id").where(F.col("reading").isNotNull() & ~F.isnan("reading"))
    return r.select("series_id", as_time(F.col("write_time")).alias("t"), F.col("reading").alias("value")).where(F.col("t").isNotNull())


def placed(readings: DataFrame, grids: DataFrame) -> DataFrame:
    """The usable readings with their slot; one row per time of a series."""
    g = once(grids, "series_id").where("delta_t > 0 and n_slots > 0").select("series_id", "t_start", "delta_t", "n_slots")
    # Readings of one time are averaged before the join, so no slot holds two rows of a time.
    one = usable(readings).groupBy("series_id", "t").agg(F.avg("value").alias("value"), F.count("*").alias("n"))
    slot = nearest_slot(F.col("t"), F.col("t_start"), F.col("delta_t"))
    return one.join(g, "series_id").withColumn("slot", slot).where("slot >= 0 and slot < n_slots")


def slots(grids: DataFrame) -> DataFrame:
    """One row per slot of every grid."""
    g = once(grids, "series_id").where("delta_t > 0 and n_slots > 0")
    return g.select("series_id", "t_start", "delta_t", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_slots").cast("bigint") - 1)).alias("slot"))


def regular(readings: DataFrame, grids: DataFrame, hold: float = 2.0, block: int = 1024) -> DataFrame:
    """One row per slot of every series: number of readings, value, coverage and how the value came about.

    Within a cell the intervals are ordered by windows over parts of it, so neither a long series nor a
    crowded cell is one task's work. What reaches in from earlier cells is the last reading before: it is carried first within
    blocks of ``block`` slots, then between blocks, of which there is one row each.
    """
    lo, hi = F.col("t_start") + (F.col("slot") - 0.5) * F.col("delta_t"), F.col("t_start") + (F.col("slot") + 0.5) * F.col("delta_t")
    # A part of a cell is one row with its readings in order; the next reading after its last is the next part's first.
    p = placed(readings, grids).withColumn("part", F.floor((F.col("t") - lo) / F.col("delta_t") * PARTS))
    p = p.groupBy("series_id", "slot", "part", "t_start", "delta_t").agg(F.array_sort(F.collect_list(F.struct("t", "value", "n"))).alias("r"))
    p = p.withColumn("next_t", F.coalesce(F.lead(F.col("r")[0]["t"]).over(W.partitionBy("series_id", "slot").orderBy("part")), hi))
    ends = F.concat(F.transform(F.slice("r", 2, F.size("r")), lambda x: x["t"]), F.array("next_t"))
    span = lambda x, e: F.greatest(F.least(e, x["t"] + hold * F.col("delta_t"), hi) - x["t"], F.lit(0.0))
    p = p.withColumn("spans", F.zip_with("r", ends, lambda x, e: F.struct(span(x, e).alias("s"), (span(x, e) * x["value"]).alias("a"))))
    total = lambda column, get: F.aggregate(F.transform(column, get), F.lit(0.0), lambda u, v: u + v)
    own = p.groupBy("series_id", "slot").agg(
        F.sum(F.aggregate("r", F.lit(0).cast("bigint"), lambda u, x: u + x["n"])).alias("n_readings"),
        F.sum(total("spans", lambda x: x["s"])).alias("own_span"),
        F.sum(total("spans", lambda x: x["a"])).alias("own_area"),
        (F.sum(total("r", lambda x: x["value"])) / F.sum(F.size("r"))).alias("own_mean"),
        F.min(F.col("r")[0]["t"]).alias("first_t"),
        F.max(F.transform(F.slice("r", -1, 1), lambda x: F.struct(x["t"].alias("t"), x["value"].alias("value")))[0]).alias("last"),
    )
    s = slots(grids).join(own, ["series_id", "slot"], "left").withColumn("block", F.floor(F.col("slot") / block))
    inner = W.partitionBy("series_id", "block").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    ends = s.groupBy("series_id", "block").agg(F.max_by("last", F.when(F.col("last").isNotNull(), F.col("slot"))).alias("end"))
    outer = W.partitionBy("series_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select("series_id", "block", F.last("end", ignorenulls=True).over(outer).alias("carry"))
    s = s.withColumn("prior", F.last("last", ignorenulls=True).over(inner)).join(carried, ["series_id", "block"]).withColumn("prior", F.coalesce("prior", "carry"))
    reach = F.greatest(F.least(F.coalesce("first_t", hi), F.col("prior.t") + hold * F.col("delta_t"), hi) - lo, F.lit(0.0))
    s = s.withColumn("in_span", F.coalesce(F.when(F.col("prior").isNotNull(), reach), F.lit(0.0)))
    total = F.coalesce("own_span", F.lit(0.0)) + F.col("in_span")
    area = F.coalesce("own_area", F.lit(0.0)) + F.when(F.col("in_span") > 0, F.col("in_span") * F.col("prior.value")).otherwise(0.0)
    return s.select(
        "series_id",
        "slot",
        (F.col("t_start") + F.col("slot") * F.col("delta_t")).alias("t"),
        F.coalesce("n_readings", F.lit(0)).cast("bigint").alias("n_readings"),
        F.when(total > 0, area / total).otherwise(F.col("own_mean")).alias("value"),
        F.least(total / F.col("delta_t"), F.lit(1.0)).alias("coverage"),
        # An interval that begins at the very end of its cell covers none of it, but is the cell's own.
        F.when(F.col("own_span") >= 0, "read").when(total > 0, "filled").otherwise("missing").alias("status"),
    )


def empty_slots(readings: DataFrame, grids: DataFrame) -> DataFrame:
    """series_id and slot of the cells that are filled from elsewhere or missing: no usable reading's interval begins in them."""
    return regular(readings, grids).where(F.col("status").isin("filled", "missing")).select("series_id", "slot")
