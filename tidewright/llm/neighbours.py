"""The k most similar vectors of every vector, by cross-polytope hashing with exact multiprobe.

A node of the index lifts a vector to the unit sphere (inverse stereographic projection about the node's
centre, at the node's scale), rotates it by a fast pseudo-rotation (three rounds of random signs and a
Hadamard transform) and hashes it to the nearest signed axis. Nodes that still hold many vectors hash again
about their own centre, so the buckets follow the density. The index is fitted on a bounded sample
(``sample`` rows); every row is put into it.

Candidates come from a vector's own bucket first, ranked by exact distances. The k-th distance found bounds
the ball that can hold anything nearer, and the margins between the signed axes tell which further buckets
that ball can touch (the lift stretches distances by at most 2 / scale). Exactly these are probed, and the
lists are merged: the result is the true one, whatever the hashes, and its cost follows the margins.

The buckets are joined by ``operators.nearest``: those with many rows are hashed again by the task that holds
them, on all of their rows, so that the work per vector does not grow with them, and those with more rows than a
task should hold are cut into parts. A pseudo-rotation acts on few coordinates here, so its images of the signed
axes are formed once per node and a vector is compared with those that are in use.

Defined results
---------------
* vectors with a null, NaN or infinite component and null ids take no part; rows of one id count once;
* of equally near vectors the smaller id comes first; equal vectors are one place in the index, so copies
  in any number meet no bound and no quadratic work: a copy's neighbours are the smallest other ids there;
* fewer than k + 1 vectors give the pairs that exist; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewright.operators.nearest import LEAF, SAMPLE, exact_knn
from tidewright.session import cut


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform along the last axis, orthonormal."""
    n = x.shape[-1]
    h = 1
    while h < n:
        y = x.reshape(*x.shape[:-1], n // (2 * h), 2, h)
        x = np.stack([y[..., 0, :] + y[..., 1, :], y[..., 0, :] - y[..., 1, :]], axis=-2).reshape(x.shape)
        h *= 2
    return x / np.sqrt(n)


class Node:
    """One hash: centre and scale of the lift, the rotation's directions, and the children per signed axis."""

    __slots__ = ("apart", "axes", "centre", "child", "directions", "scale")


class CrossPolytopes:
    """A tree of cross-polytope hashes; leaves are buckets."""

    def __init__(self, x: np.ndarray, n: int, leaf: int = LEAF, least: int = 8, seed: int = 7):
        self.dims = x.shape[1]
        self.width = max(16, 1 << int(np.ceil(np.log2(self.dims + 1))))
        self.rng = np.random.default_rng(seed)
        self.leaves = 0
        self.weight, self.leaf, self.least = n / max(len(x), 1), leaf, least
        self.root = self._fit(x, 0)

    def lift(self, node: Node, x: np.ndarray) -> np.ndarray:
        v = (x - node.centre) / node.scale
        q = (v * v).sum(axis=1, keepdims=True)
        return np.concatenate([2 * v, 1 - q], axis=1) / (1 + q)

    def _fit(self, x: np.ndarray, depth: int) -> Node | int:
        if len(x) * self.weight > self.leaf and len(x) >= 2 * self.least and depth < 24:
            node = Node()
            node.centre = x.mean(axis=0)
            node.scale = float(np.sqrt(((x - node.centre) ** 2).sum(axis=1).mean()))
            if node.scale > 0:
                signs = self.rng.choice([-1.0, 1.0], (3, self.width))
                eye = np.zeros((self.dims + 1, self.width))
                eye[np.arange(self.dims + 1), np.arange(self.dims + 1)] = 1
                for s in signs:
                    eye = hadamard(eye * s)
                both = np.concatenate([eye.T, -eye.T])  # one row per signed axis
                # Signed axes that take fewer than ``least`` of the sample leave their share to the others.
                near = np.argmax(self.lift(node, x) @ both.T, axis=1)
                while True:
                    used, count = np.unique(near, return_counts=True)
                    good = used[count >= self.least]
                    if len(good) == len(used):
                        break
                    if len(good) == 0:
                        break
                    near = good[np.argmax(self.lift(node, x) @ both[good].T, axis=1)]
                if len(good) > 1:
                    node.axes, node.directions = good, both[good]
                    node.apart = np.sqrt(((node.directions[:, None] - node.directions[None]) ** 2).sum(axis=2))
                    node.child = [self._fit(x[near == a], depth + 1) for a in good]
                    return node
        self.leaves += 1
        return self.leaves - 1

    def bucket(self, x: np.ndarray) -> np.ndarray:
        """The bucket of each vector."""
        out = np.zeros(len(x), np.int64)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if len(rows) == 0:
                continue
            if not isinstance(node, Node):
                out[rows] = node
                continue
            near = np.argmax(self.lift(node, x[rows]) @ node.directions.T, axis=1)
            todo += [(c, rows[near == k]) for k, c in enumerate(node.child)]
        return out

    def probes(self, x: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and all buckets that can hold a vector within the row's radius."""
        out = []
        radius = np.minimum(radius, 1e300)  # an endless radius opens every axis, without 0 * inf
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if len(rows) == 0:
                continue
            if not isinstance(node, Node):
                out.append((rows, np.full(len(rows), node)))
                continue
            value = self.lift(node, x[rows]) @ node.directions.T
            best = np.argmax(value, axis=1)
            behind = value[np.arange(len(rows)), best][:, None] - value
            # A vector within the radius changes the difference of two axes by at most apart * 2 * radius / scale
            # (and the allowance for rounding).
            open_ = behind <= node.apart[best] * (2 * radius[rows] / node.scale)[:, None] + 1e-9
            todo += [(c, rows[open_[:, k]]) for k, c in enumerate(node.child)]
        return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int))


def knn(places: DataFrame, k: int = 5, sample: int = SAMPLE, leaf: int = LEAF, **options: int) -> DataFrame:
    """place and near: its k nearest other places as (d2, id), nearest first. ``places``: place, vec; distinct vectors."""
    return exact_knn(places, k, CrossPolytopes, sample, leaf, **options)


def neighbour_lists(members: DataFrame, k: int = 5, **options: int) -> DataFrame:
    """a and b: b is among the k nearest other members of a. ``members``: member, vec; each id once."""
    members = cut(members.select("member", "vec"))
    # The k + 1 smallest ids of a place are all that anyone can have as neighbours there.
    rn = F.row_number().over(W.partitionBy("vec").orderBy("member"))
    first = members.withColumn("rn", rn).where(F.col("rn") <= k + 1).groupBy("vec").agg(F.array_sort(F.collect_list("member")).alias("own"))
    places = cut(first.select(F.col("own")[0].alias("place"), "vec", "own"))
    lists = knn(places, k, **options)
    # Of the k nearest places, all ids (at most k each) in order of distance and id.
    flat = lists.select("place", F.explode("near").alias("n")).join(places.select(F.col("place").alias("_id"), F.col("own").alias("_own")), F.col("n.id") == F.col("_id"))
    others = flat.groupBy("place").agg(F.slice(F.array_sort(F.flatten(F.collect_list(F.transform("_own", lambda m: F.struct(F.col("n.d2").alias("d2"), m.alias("id")))))), 1, k).alias("others"))
    full = places.join(others, "place", "left").withColumn("others", F.coalesce(F.transform("others", lambda s: s["id"]), F.array().cast("array<bigint>")))
    near = full.select(F.explode("own").alias("a"), "own", "others").select("a", F.explode(F.slice(F.concat(F.array_except("own", F.array("a")), "others"), 1, k)).alias("b"))
    crowded = places.where(F.size("own") > k).select("vec", "own")
    rest = members.join(crowded, "vec").where(~F.array_contains("own", F.col("member"))).select(F.col("member").alias("a"), F.explode(F.slice("own", 1, k)).alias("b"))
    return near.union(rest)


def neighbour_pairs(members: DataFrame, k: int = 5, **options: int) -> DataFrame:
    """point_a < point_b: at least one is among the k nearest of the other; each pair once."""
    p = neighbour_lists(members, k, **options)
    return p.select(F.least("a", "b").alias("point_a"), F.greatest("a", "b").alias("point_b")).distinct()
