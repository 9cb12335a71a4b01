"""Windows over time: shifted pairs, delays, supervised pairs, runs and transitions between labels.

A key's rows get positions by stretches of their order (``session.positions``) and are cut into blocks that overlap
by what a window reaches (``session.with_neighbours``), so no task holds a whole key.

Only the named columns take part. Rows of equal order count in any order, so the order should be unique per
key; null keys are a key of their own. Supervised pairs leave out windows with a null value, delays and
shifted pairs keep nulls; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewright.session import STRETCH, positions, ranked, with_neighbours


def _ahead(df: DataFrame, keys: Sequence[str], order: str, reach: int, block: int) -> tuple[DataFrame, W]:
    """Blocks of rows with the ``reach`` rows after them, and the window over a key's block."""
    x = with_neighbours(positions(df, list(keys), [order], target=block), "_pos", after=reach, block=max(block, reach + 1))
    return x, W.partitionBy(*keys, "_block").orderBy("_pos")


def shift_pairs(df: DataFrame, keys: Sequence[str], order: str, value: str, block: int = STRETCH) -> DataFrame:
    """Each value with the next of its key: columns keys, order, x, y."""
    x, w = _ahead(df.select(*keys, order, value), keys, order, 1, block)
    x = x.withColumn("y", F.lead(value).over(w)).withColumn("_n", F.lead("_pos").over(w))
    return x.where(F.col("_n").isNotNull() & F.col("_own")).select(*keys, order, F.col(value).alias("x"), "y")


def delay_embedding(df: DataFrame, keys: Sequence[str], order: str, value: str, delay: int, block: int = STRETCH) -> DataFrame:
    """``delay`` consecutive values from each time on, where there are as many: keys, order, lag, value."""
    if delay < 1:
        raise ValueError("the delay must be at least 1")
    x, w = _ahead(df.select(*keys, order, value), keys, order, delay - 1, block)
    x = x.withColumn("_w", F.collect_list(F.struct(F.col(value).alias("v"))).over(w.rowsBetween(0, delay - 1))).where((F.size("_w") == delay) & F.col("_own"))
    return x.select(*keys, order, F.posexplode("_w").alias("lag", "_v")).select(*keys, order, "lag", F.col("_v.v").alias(value))


def sequence_pairs(df: DataFrame, keys: Sequence[str], order: str, value: str, delays: int = 1, horizon: int = 1, block: int = STRETCH) -> DataFrame:
    """Feature (``delays`` values) and label (the ``horizon`` values after them) from each time on."""
    delays, horizon = max(1, delays), max(1, horizon)
    x, w = _ahead(df.select(*keys, order, value), keys, order, delays + horizon - 1, block)
    a, b = w.rowsBetween(0, delays - 1), w.rowsBetween(delays, delays + horizon - 1)
    x = x.withColumn("feature", F.collect_list(value).over(a)).withColumn("label", F.collect_list(value).over(b))
    return x.where((F.size("feature") == delays) & (F.size("label") == horizon) & F.col("_own")).select(*keys, order, "feature", "label")


def trajectory_split(df: DataFrame, key: str, order: str, train: float = 0.75, test: float = 0.25, horizon: int = 1, shift: int = 1, forward_backward: bool = False, shuffle: bool = False, seed: int = 0, block: int = STRETCH) -> DataFrame:
    """Pairs (start, ..., start + horizon) every ``shift`` times of a trajectory, split into train and test.

    Columns key, pair, start, stop, direction, part. The split is chronological over all pairs (by
    trajectory and start), or random by a seeded order; a single pair goes to train. Backward pairs run
    from stop to start and follow the forward ones. A pair's number follows from its start and from how many
    pairs the trajectories before its own have, one row each.
    """
    x = positions(df.select(key, order), [key], [order], "start", block)
    length = df.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n"))
    forward = F.greatest(F.floor((F.col("_n") - horizon - 1) / shift) + 1, F.lit(0))
    sides = 2 if forward_backward else 1
    size = length.select("_key", "_n", forward.alias("_f"), (forward * sides).alias("_c"))
    before = size.select("_key", "_n", "_f", (F.sum("_c").over(W.orderBy("_key")) - F.col("_c")).alias("_before"), F.sum("_c").over(W.partitionBy()).alias("_all"))
    x = x.where(F.col("start") % shift == 0).join(before, F.col(key).eqNullSafe(F.col("_key"))).where(F.col("start") + horizon < F.col("_n"))
    number = F.col("_before") + (F.col("start") / shift).cast("bigint")
    pairs = x.select(key, "start", (F.col("start") + horizon).alias("stop"), F.lit("forward").alias("direction"), number.alias("pair"), "_all", "_f")
    if forward_backward:
        pairs = pairs.union(pairs.select(key, F.col("stop"), F.col("start"), F.lit("backward").alias("direction"), (F.col("pair") + F.col("_f")).alias("pair"), "_all", "_f"))
    n_train = F.when(F.col("_all") == 1, F.lit(1)).otherwise(F.floor(F.col("_all") * train / (train + test)))
    if shuffle:
        # Positions in the order of the hash, counted in stretches of it, so that no task orders all pairs.
        h = F.xxhash64(F.col(key), F.col("start"), F.col("direction"), F.lit(seed))
        pairs = ranked(pairs.withColumn("_h", h).withColumn("_b", F.shiftright(h, 52)).withColumn("_k", F.lit(0)), ["_k"], ["_h", key, "start", "direction"], "_b", "_place")
    place = F.col("_place") if shuffle else F.col("pair")
    return pairs.withColumn("part", F.when(place < n_train, "train").otherwise("test")).select(key, "pair", "start", "stop", "direction", "part")


def run_dedupe(df: DataFrame, keys: Sequence[str], order: Sequence[str], label: str, block: int = STRETCH) -> DataFrame:
    """The first row of each run of equal labels, with its number ``run`` and length ``length``.

    Runs are numbered within blocks; how many begin in the blocks before is summed up over blocks, one row each.
    """
    x = with_neighbours(positions(df.select(*keys, *order, label), list(keys), list(order), target=block), "_pos", before=1, block=max(block, 2))
    w = W.partitionBy(*keys, "_block").orderBy("_pos")
    new = F.when(F.lag(label).over(w).eqNullSafe(F.col(label)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    x = x.withColumn("_new", new).where("_own").withColumn("_r", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    safe = [F.struct(k).alias(f"_s{i}") for i, k in enumerate(keys)]  # a struct of a null is no null: keys join
    x = x.select("*", *safe)
    names = [f"_s{i}" for i in range(len(keys))]
    starts = x.groupBy(*names, "_block").agg(F.sum("_new").alias("_c"))
    earlier = F.sum("_c").over(W.partitionBy(*names).orderBy("_block").rowsBetween(W.unboundedPreceding, -1))
    starts = starts.select(*names, "_block", F.coalesce(earlier, F.lit(0)).alias("_before"))
    x = x.join(starts, [*names, "_block"]).withColumn("run", F.col("_before") + F.col("_r"))
    runs = x.groupBy(*keys, "run").agg(F.first(label).alias(label), F.count("*").alias("length"), *(F.min(o).alias(o) for o in order[:1]))
    return runs.select(*keys, "run", order[0], label, "length")


def transitions(df: DataFrame, keys: Sequence[str], order: Sequence[str], label: str, model_order: int = 1, dt: float = 1.0, block: int = STRETCH) -> DataFrame:
    """Per history of ``model_order`` labels and next label: count, probability and mean transition time.

    Runs of equal labels count once. The time of a transition is half of the last run of the history and
    half of the next run, in units of ``dt``. The history is an array of labels, so labels 1 and 11 differ.
    """
    r = run_dedupe(df, keys, order, label, block).withColumn("_at", F.col("run") - 1)
    r = with_neighbours(r, "_at", before=model_order - 1, after=1, block=max(block, model_order + 1))
    w = W.partitionBy(*keys, "_block").orderBy("run")
    hist = F.collect_list(label).over(w.rowsBetween(-(model_order - 1), 0))
    x = r.select(*keys, "run", "_own", hist.alias("history"), F.lead(label).over(w).alias("next"), "length", F.lead("length").over(w).alias("_len"))
    x = x.where(F.col("_len").isNotNull() & (F.size("history") == model_order) & F.col("_own"))
    agg = x.groupBy("history", "next").agg(F.count("*").alias("n"), F.avg(0.5 * dt * (F.col("length") + F.col("_len"))).alias("dt"))
    return agg.withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy("history"))).select("history", "next", "n", "p", "dt")
