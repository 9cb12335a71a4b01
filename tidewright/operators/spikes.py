"""Faulty readings: spikes, stuck runs and impossible values, against what is normal for their source.

The readings of a source, in order, are laid out as profiles, and robust principal components separate each
block's profile matrix into a low-rank part, which is what is normal for the source, and a sparse part. Spikes
are sought in the sparse part. What it passes on is tested exactly: against the level (the median of a
reading and its neighbours) and the source's scatter about it. A reading that the sparse part does not hold
is passed on as well where its distance from the level cannot be bounded by the unsuspected readings around it,
so no spike is lost to the separation, not even one that a source repeats. Runs of equal values and the range
are tested separately.

Defined results
---------------
* null readings are left out; values that are not finite or leave [low, high] are impossible and take no
  part in the rest; a scatter of 0 (or a source without readings) gives no spikes and no stuck runs;
* repeated rows count once, readings without an id one by one (with a null sample_id); a null source_id is a source of its own; rows with a null order come first;
* a block of fewer than ``LEAST`` profiles is too small to be separated: all of its readings are tested;
* further columns do not take part; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewright.operators.quantiles import exact_median
from tidewright.session import cut, once, parts, ranked

SIDE, RUN, FACTOR, SCALE = 10, 8, 8.0, 1.4826
BLOCK = 8192
#: Readings of a profile, fewest profiles of a matrix, and the residual, in scatters of the residual, beyond which a
#: sparse entry is passed on to the exact test.
WIDTH, LEAST, SUSPECT = 24, 8, 2.0
#: Stands for a null source_id or sample_id: with nulls, whole numbers would become floats in pandas.
NO_SOURCE = -(2**63)


def _id() -> Column:
    return F.nullif("sample_id", F.lit(NO_SOURCE))


def levels(x: np.ndarray, side: int = SIDE) -> np.ndarray:
    """Median of each value with its ``side`` neighbours on either side, fewer at the ends."""
    n, w = len(x), 2 * side + 1
    out = np.empty(n)
    if n >= w:
        out[side : n - side] = np.median(np.lib.stride_tricks.sliding_window_view(x, w), axis=1)
    for i in {*range(min(side, n)), *range(max(n - side, 0), n)}:
        out[i] = np.median(x[max(0, i - side) : i + side + 1])
    return out


def in_runs(x: np.ndarray, run: int = RUN) -> np.ndarray:
    """Which values stand in a run of at least ``run`` equal ones."""
    if len(x) == 0:
        return np.zeros(0, bool)
    new = np.r_[True, x[1:] != x[:-1]]
    group = np.cumsum(new) - 1
    return np.bincount(group)[group] >= run


def robust_pca(m: np.ndarray, steps: int = 200, tol: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Low-rank and sparse part of ``m`` (principal component pursuit by augmented Lagrangian).

    Singular values are shrunk through the eigenvectors of the small Gram matrix of the columns.
    """
    lam = 1 / np.sqrt(max(m.shape))
    norm = np.linalg.norm(m)
    if norm == 0:
        return m.copy(), np.zeros_like(m)
    top = np.linalg.norm(m, 2)
    mu = 1.25 / top
    y = m / max(top, np.abs(m).max() / lam)
    s = np.zeros_like(m)
    for _ in range(steps):
        a = m - s + y / mu
        val, vec = np.linalg.eigh(a.T @ a)
        keep = np.maximum(1 - 1 / (mu * np.sqrt(np.maximum(val, np.finfo(float).tiny))), 0)
        low = a @ ((vec * keep) @ vec.T)
        r = m - low + y / mu
        s = np.sign(r) * np.maximum(np.abs(r) - lam / mu, 0)
        gap = m - low - s
        y = y + mu * gap
        mu = min(mu * 1.5, 1e7)
        if np.linalg.norm(gap) <= tol * norm:
            break
    return low, s


def separate(x: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Low-rank and sparse part of readings in order, laid out as profiles of ``width``; short series take narrower ones."""
    n = len(x)
    width = max(1, min(width, int(np.sqrt(n))))
    centre = np.median(x)
    full = np.append(x, np.full(-n % width, centre)).reshape(-1, width) - centre
    low, sparse = robust_pca(full)
    return low.reshape(-1)[:n] + centre, sparse.reshape(-1)[:n]


def suspects(x: np.ndarray, low: np.ndarray, sparse: np.ndarray) -> np.ndarray:
    """Entries of the sparse part that stand out of the residual."""
    if len(x) < LEAST * LEAST:
        return np.ones(len(x), bool)
    rest = np.abs(x - low)
    return (sparse != 0) & (rest > SUSPECT * SCALE * np.median(rest))


def reach(x: np.ndarray, suspect: np.ndarray, side: int = SIDE) -> np.ndarray:
    """A bound of each value's distance from its level: where less than half of the values around it are suspects,
    their median lies between the smallest and the largest of the others."""
    n, w = len(x), 2 * side + 1
    pad = lambda v, fill: np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(side, fill), v, np.full(side, fill)]), w)
    high, low = pad(np.where(suspect, -np.inf, x), -np.inf).max(axis=1), pad(np.where(suspect, np.inf, x), np.inf).min(axis=1)
    there = np.minimum(np.arange(n), side) + np.minimum(np.arange(n)[::-1], side) + 1
    others = pad((~suspect).astype(float), 0.0).sum(axis=1)
    bound = np.full(n, np.inf)
    known = 2 * others > there
    bound[known] = np.maximum(high[known] - x[known], x[known] - low[known])
    return bound


def scan(side: int, run: int):
    """Separation, distance from the level and run flag, for partitions sorted by (source, block, position)."""

    def emit(p: pd.DataFrame) -> pd.DataFrame:
        x = p["value"].to_numpy()
        own = p["own"].to_numpy()
        low, sparse = separate(x)
        suspect = suspects(x, low, sparse)
        out = {"sample_id": p["sample_id"].to_numpy(), "source": p["source"].to_numpy(), "dev": np.abs(x - levels(x, side)), "stuck": in_runs(x, run), "suspect": suspect, "reach": reach(x, suspect, side), "normal": low, "sparse": sparse}
        return pd.DataFrame({k: v[own] for k, v in out.items()})

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for b in batches:
            if len(b) == 0:
                continue
            b = pd.concat([*held, b], ignore_index=True) if held else b
            key = (b["source"].to_numpy()[1:] != b["source"].to_numpy()[:-1]) | (b["block"].to_numpy()[1:] != b["block"].to_numpy()[:-1])
            at = [0, *(np.flatnonzero(key) + 1), len(b)]
            done = [emit(b.iloc[i:j]) for i, j in zip(at[:-2], at[1:-1], strict=True)]
            if done:
                yield pd.concat(done, ignore_index=True)
            held = [b.iloc[at[-2] :]]
        if held:
            yield emit(held[0])

    return go


SCANNED = "sample_id bigint, source bigint, dev double, stuck boolean, suspect boolean, reach double, normal double, sparse double"


def deviations(samples: DataFrame, side: int = SIDE, run: int = RUN, block: int = BLOCK) -> DataFrame:
    """Of every reading that is possible: its normal and its sparse part, whether it is suspected, its distance from
    its level and a bound of it, and whether it stands in a long run.

    A source is cut into blocks of ``block`` readings; each block also receives the readings just before and
    after it that its medians and runs need, so no task holds a whole source.
    """
    halo = max(side, run - 1)
    # Positions are counted in stretches of t_idx, which is unique within a source, so a stretch is bounded.
    x = samples.withColumn("stretch", F.floor(F.coalesce("t_idx", F.lit(-1)) / block))
    x = ranked(x, ["source"], ["t_idx", "sample_id", "value"], "stretch", "pos").select("sample_id", "source", "value", "pos")
    b = F.floor(F.col("pos") / block)
    at = F.pmod("pos", F.lit(block))
    places = F.array_compact(F.array(F.struct(b.alias("block"), F.lit(True).alias("own")), F.when((at < halo) & (b > 0), F.struct((b - 1).alias("block"), F.lit(False).alias("own"))), F.when(at >= block - halo, F.struct((b + 1).alias("block"), F.lit(False).alias("own")))))
    x = x.withColumn("place", F.explode(places)).select("sample_id", "source", "value", "pos", "place.block", "place.own")
    # A block that holds nothing of its own only received neighbours of the last block: it emits nothing.
    return x.repartition(parts(x), "source", "block").sortWithinPartitions("source", "block", "pos").mapInPandas(scan(side, run), SCANNED)


def readings(samples: DataFrame) -> DataFrame:
    """sample_id, source, t_idx and value of the readings that are not null; repeated rows once."""
    value = F.when(F.col("loader") == "psp", F.col("weight")).when(F.col("loader") == "csv", F.col("isvalid")).otherwise(F.coalesce("weight", "isvalid"))
    return once(samples, "sample_id").select(F.coalesce("sample_id", F.lit(NO_SOURCE)).alias("sample_id"), F.coalesce("source_id", F.lit(NO_SOURCE)).alias("source"), "t_idx", value.alias("value")).where(F.col("value").isNotNull())


def _wild(low: float, high: float) -> Column:
    return F.isnan("value") | (F.col("value") < low) | (F.col("value") > high)


class Faults:
    """The readings of a table, separated once, and what follows from the separation."""

    def __init__(self, samples: DataFrame, low: float = 0.0, high: float = 1.0, factor: float = FACTOR):
        x = readings(samples)
        self.impossible = x.where(_wild(low, high)).select("sample_id", "source")
        self.scanned = cut(deviations(x.where(~_wild(low, high))).drop("normal", "sparse"))
        self.scatter = exact_median(self.scanned, "source", "dev").select("source", (F.col("median") * SCALE).alias("scatter"))
        limit = factor * F.col("scatter")
        passed = self.scanned.join(self.scatter.where("scatter > 0"), "source").where(F.col("suspect") | (F.col("reach") > limit) | F.col("stuck"))
        spike = F.col("dev") > limit
        #: sample_id, source and reason of the readings that the exact test confirms.
        self.found = passed.where(spike | F.col("stuck")).select("sample_id", "source", F.when(spike, "spike").otherwise("stuck").alias("reason"))


def faulty(samples: DataFrame, low: float = 0.0, high: float = 1.0, factor: float = FACTOR) -> DataFrame:
    """sample_id and reason (impossible, spike, stuck) of the faulty readings; a spike in a run is ``spike``."""
    f = Faults(samples, low, high, factor)
    return f.impossible.select("sample_id", F.lit("impossible").alias("reason")).union(f.found.select("sample_id", "reason")).withColumn("sample_id", _id())


def source_profiles(samples: DataFrame, low: float = 0.0, high: float = 1.0, factor: float = FACTOR) -> DataFrame:
    """Per source: possible readings, its scatter about its level, and its impossible, spiking and stuck readings."""
    f = Faults(samples, low, high, factor)
    possible = f.scanned.groupBy("source").agg(F.count("*").alias("readings")).join(f.scatter, "source")
    bad = f.impossible.select("source", F.lit("impossible").alias("reason")).union(f.found.select("source", "reason"))
    counts = bad.groupBy("source").agg(*(F.count(F.when(F.col("reason") == r, 1)).alias(r) for r in ("impossible", "spike", "stuck")))
    out = possible.join(counts, "source", "full")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return out.select(F.nullif("source", F.lit(NO_SOURCE)).alias("source_id"), zero("readings"), "scatter", zero("impossible"), zero("spike"), zero("stuck"))


def profile_outliers(samples: DataFrame, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """The separation itself: sample_id, source_id, normal and sparse part of every possible reading, and whether the
    sparse part stands out (``spike``)."""
    d = deviations(readings(samples).where(~_wild(low, high)))
    return d.select(_id().alias("sample_id"), F.nullif("source", F.lit(NO_SOURCE)).alias("source_id"), "normal", "sparse", F.col("suspect").alias("spike"))
