"""Mesh geometry by joins, and quadrature weights of point clouds by nearest neighbours."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.hull import hull_points, hull_volume
from tidewright.operators.nearest import exact_knn
from tidewright.session import cut


def _cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def _xyz(prefix: str) -> list[Column]:
    return [F.col(f"{prefix}{c}") for c in "xyz"]


def _field(name: str):
    return lambda p: p[name]


def face_geometry(points: DataFrame, faces: DataFrame) -> DataFrame:
    """Centre and area vector of each face: fid, cx, cy, cz, sx, sy, sz.

    ``points`` (pid, x, y, z), ``faces`` (fid, pids array). A face is a fan of triangles about the mean of its
    corners; its centre is the mean of the triangles' centres by area, its area vector their sum.
    """
    corner = faces.select("fid", F.posexplode("pids").alias("k", "pid")).join(points, "pid")
    ring = corner.groupBy("fid").agg(F.array_sort(F.collect_list(F.struct("k", "x", "y", "z"))).alias("c"))
    mean = [F.aggregate(F.transform("c", _field(c)), F.lit(0.0), lambda s, v: s + v) / F.size("c") for c in "xyz"]
    m = ring.select("fid", "c", *(v.alias(f"m{c}") for v, c in zip(mean, "xyz", strict=True)))
    nxt = F.concat(F.slice("c", 2, F.size("c")), F.slice("c", 1, 1))
    tri = m.select("fid", "mx", "my", "mz", F.explode(F.arrays_zip(F.col("c").alias("p"), nxt.alias("q"))).alias("t")).select("fid", "mx", "my", "mz", *(F.col(f"t.p.{c}").alias(f"p{c}") for c in "xyz"), *(F.col(f"t.q.{c}").alias(f"q{c}") for c in "xyz"))
    p, q, c = _xyz("p"), _xyz("q"), _xyz("m")
    n = _cross([b - a for a, b in zip(p, q, strict=True)], [b - a for a, b in zip(p, c, strict=True)])
    a = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])
    tri = tri.select("fid", "mx", "my", "mz", a.alias("a"), *(v.alias(f"n{k}") for v, k in zip(n, "xyz", strict=True)), *((x + y + z).alias(f"t{k}") for x, y, z, k in zip(p, q, c, "xyz", strict=True)))
    agg = tri.groupBy("fid").agg(F.sum("a").alias("area"), *(F.sum(F.col("a") * F.col(f"t{k}")).alias(f"w{k}") for k in "xyz"), *((0.5 * F.sum(f"n{k}")).alias(f"s{k}") for k in "xyz"), *(F.first(f"m{k}").alias(f"m{k}") for k in "xyz"))
    return agg.select("fid", *(F.when(F.col("area") > 0, F.col(f"w{k}") / (3 * F.col("area"))).otherwise(F.col(f"m{k}")).alias(f"c{k}") for k in "xyz"), "sx", "sy", "sz")


def cell_geometry(face: DataFrame, owner: DataFrame, neighbour: DataFrame) -> DataFrame:
    """Centre and volume of each cell: cid, x, y, z, volume.

    ``face`` as from :func:`face_geometry`; ``owner`` and ``neighbour`` (fid, cid). A cell is a set of pyramids
    from the mean of its face centres to its faces; area vectors point out of the owner.
    """
    sides = owner.select("fid", "cid", F.lit(1.0).alias("sign")).union(neighbour.select("fid", "cid", F.lit(-1.0).alias("sign"))).join(face, "fid")
    guess = sides.groupBy("cid").agg(*(F.avg(f"c{k}").alias(f"g{k}") for k in "xyz"))
    x = sides.join(guess, "cid")
    v3 = F.col("sign") * sum((F.col(f"s{k}") * (F.col(f"c{k}") - F.col(f"g{k}")) for k in "xyz"), F.lit(0.0))
    x = x.withColumn("v3", v3)
    agg = x.groupBy("cid").agg(F.sum("v3").alias("v3"), *(F.sum(F.col("v3") * (0.75 * F.col(f"c{k}") + 0.25 * F.col(f"g{k}"))).alias(f"w{k}") for k in "xyz"), *(F.first(f"g{k}").alias(f"g{k}") for k in "xyz"))
    return agg.select("cid", *(F.when(F.col("v3") != 0, F.col(f"w{k}") / F.col("v3")).otherwise(F.col(f"g{k}")).alias(k) for k in "xyz"), (F.col("v3") / 3).alias("volume"))


def topology(faces: DataFrame, owner: DataFrame, neighbour: DataFrame) -> DataFrame:
    """Mixed topology stream per cell: 16, number of faces, then per face its number of points and the points."""
    sides = owner.select("fid", "cid", F.lit(0).alias("side")).union(neighbour.select("fid", "cid", F.lit(1).alias("side"))).join(faces, "fid")
    one = sides.groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("side", "fid", F.concat(F.array(F.size("pids").cast("bigint")), F.col("pids").cast("array<bigint>")).alias("stream")))).alias("f"))
    return one.select("cid", F.concat(F.array(F.lit(16).cast("bigint"), F.size("f").cast("bigint")), F.flatten(F.transform("f", lambda s: s["stream"]))).alias("stream"))


def box_mesh(spark, n: int, size: float = 1.0) -> dict[str, DataFrame]:
    """Points, faces, owner and neighbour of a regular box of n x n x n cells, made by the cluster."""
    h = size / n
    pid = lambda i, j, k: i + (n + 1) * (j + (n + 1) * k)
    cell = lambda i, j, k: i + n * (j + n * k)
    points = spark.range((n + 1) ** 3).select(F.col("id").alias("pid"), ((F.col("id") % (n + 1)) * h).alias("x"), ((F.floor(F.col("id") / (n + 1)) % (n + 1)) * h).alias("y"), (F.floor(F.col("id") / (n + 1) ** 2) * h).alias("z"))
    per = (n + 1) * n * n
    base = spark.range(3 * per).select("id", F.floor(F.col("id") / per).alias("d"), (F.col("id") % per).alias("r"))
    base = base.select("id", "d", (F.col("r") % (n + 1)).alias("a"), (F.floor(F.col("r") / (n + 1)) % n).alias("b"), F.floor(F.col("r") / ((n + 1) * n)).alias("c"))
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    # Corners so that the area vector points along the axis; at the low side of the box it must point out.
    quads = [[pid(a, b, c), pid(a, b + 1, c), pid(a, b + 1, c + 1), pid(a, b, c + 1)], [pid(c, a, b), pid(c, a, b + 1), pid(c + 1, a, b + 1), pid(c + 1, a, b)], [pid(b, c, a), pid(b + 1, c, a), pid(b + 1, c + 1, a), pid(b, c + 1, a)]]
    corner = F.when(F.col("d") == 0, F.array(*quads[0])).when(F.col("d") == 1, F.array(*quads[1])).otherwise(F.array(*quads[2]))
    pids = F.when(a == 0, F.reverse(corner)).otherwise(corner)
    faces = base.select(F.col("id").alias("fid"), pids.cast("array<bigint>").alias("pids"))
    at = lambda s: F.when(F.col("d") == 0, cell(s, b, c)).when(F.col("d") == 1, cell(c, s, b)).otherwise(cell(b, c, s))
    low, high = at(a - 1), at(a)
    owner = base.select(F.col("id").alias("fid"), F.when(a == 0, high).otherwise(low).cast("bigint").alias("cid"))
    neighbour = base.where((a > 0) & (a < n)).select(F.col("id").alias("fid"), high.cast("bigint").alias("cid"))
    return {"points": points, "faces": faces, "owner": owner, "neighbour": neighbour}


def _mean_distance(places: DataFrame, k: int) -> DataFrame:
    """place and dist: the mean distance of the k nearest points, of which each place holds ``copies``."""
    near = exact_knn(places.select("place", "vec"), max(1, k - 1)).select("place", F.explode("near").alias("n"))
    # Of a place's own copies and of those of its k - 1 nearest places, the k nearest points.
    other = near.select("place", F.col("n.id").alias("_id"), F.sqrt("n.d2").alias("d")).join(places.select(F.col("place").alias("_id"), "copies"), "_id").select("place", "d", "copies")
    every = places.select("place", F.lit(0.0).alias("d"), "copies").union(other)
    dists = F.flatten(F.collect_list(F.array_repeat("d", F.least("copies", F.lit(k)).cast("int"))))
    one = every.groupBy("place").agg(F.slice(F.array_sort(dists), 1, k).alias("d"))
    return one.select("place", (F.aggregate("d", F.lit(0.0), lambda s, v: s + v) / F.size("d")).alias("dist"))


def knn_weights(points: DataFrame, key: str, columns: list[str], volume: float, normalize: bool = True, k: int | None = None) -> DataFrame:
    """Weight of each point from the mean distance to its k nearest points, itself among them (distance 0).

    The neighbours are exact at any distance and density; points of equal coordinates are one place of the
    search. Only with fewer than k points in all are there fewer neighbours. Points with a coordinate that is
    null or not finite have no weight. ``volume`` is that of the hull, over which the weights are spread. k
    defaults to 8 with three coordinates that vary, else 4; the exponent is the number of coordinates.
    """
    d = len(columns)
    if k is None:
        flat = points.agg(*((F.max(c) - F.min(c)).alias(c) for c in columns)).first()
        k = 8 if sum((flat[c] or 0) > 0 for c in columns) == 3 else 4
    p = points.select(F.col(key).alias("id"), F.array(*(F.col(c).cast("double") + F.lit(0.0) for c in columns)).alias("vec"))  # no negative zero
    p = cut(p.where(F.forall("vec", lambda v: v.isNotNull() & (F.abs(v) < float("inf")))))
    places = cut(p.groupBy("vec").agg(F.count("*").alias("copies")).withColumn("place", F.monotonically_increasing_id()))
    dist = places.join(_mean_distance(places, k), "place").select("vec", "copies", F.pow("dist", F.lit(float(d))).alias("d"))
    dist = cut(dist)
    total, most = dist.agg(F.sum(F.col("d") * F.col("copies")), F.max("d")).first() or (None, None)
    w = p.join(dist, "vec").select(F.col("id").alias(key), (F.lit(float(volume)) * F.col("d") / F.lit(total)).alias("w"))
    # The largest root belongs to the largest distance.
    return w if not normalize else w.select(key, (F.sqrt("w") / F.sqrt(F.lit(float(volume)) * F.lit(most) / F.lit(total))).alias("w"))


def max_normalized(rows: DataFrame, key: str, weight: str) -> DataFrame:
    """``rows`` with ``w``: the weight divided by the largest of its key (null keys are one)."""
    most = rows.groupBy(F.col(key).alias("_key")).agg(F.max(weight).alias("_most"))
    return rows.join(most, F.col(key).eqNullSafe(F.col("_key"))).withColumn("w", F.col(weight) / F.col("_most")).drop("_key", "_most")


def hull_size(points: DataFrame, columns: list[str]) -> float:
    """Length, area or volume of the points' convex hull over the coordinates that vary.

    Every partition sends only the corners of its own hull; the hull of those is the whole one.
    """
    span = points.agg(*((F.max(c) - F.min(c)).alias(c) for c in columns)).first()
    used = [c for c in columns if span[c]]
    if not used:
        return 0.0

    def corners(batches):
        kept = np.zeros((0, len(used)))
        for p in batches:
            kept = hull_points(np.concatenate([kept, p[used].to_numpy(np.float64)]))
        yield pd.DataFrame(kept, columns=used)

    rows = points.select(*(F.col(c).cast("double").alias(c) for c in used)).mapInPandas(corners, ", ".join(f"{c} double" for c in used))
    return hull_volume(rows.toPandas().to_numpy(np.float64))


class PointWeights:
    """Weights of a point cloud: the k nearest neighbours' mean distance, spread over the hull's volume."""

    def __init__(self, points: DataFrame, key: str, columns: list[str], normalize: bool = True, k: int | None = None):
        self.points, self.key, self.columns, self.normalize, self.k = points, key, columns, normalize, k
        self.volume = hull_size(points, columns)

    @property
    def raw(self) -> DataFrame:
        """key and w = alpha * d; they add up to the hull's volume."""
        return knn_weights(self.points, self.key, self.columns, self.volume, False, self.k)

    @property
    def weights(self) -> DataFrame:
        return knn_weights(self.points, self.key, self.columns, self.volume, self.normalize, self.k)

    @property
    def max_sqrt(self) -> float:
        """The root by which normalized weights are divided."""
        return self.raw.agg(F.max(F.sqrt("w"))).first()[0]
