"""Zoned image series (iPSP) and refined grids (S-cube).

Both come as HDF5 files, which need a package that may be absent; it is imported on demand by ``ingest``.
The engine's own form is a folder of Parquet tables with the same groups, from which everything is read.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators.select import temporal
from tidewright.sources.base import Source


def _h5py():
    try:
        import h5py
    except ImportError as e:
        raise ImportError("reading HDF5 needs the package h5py; store the data as Parquet tables instead") from e
    return h5py


def time_index(time: Column, frequency: float) -> Column:
    """The image of a write time, rounded half to even; null where the text is no number."""
    return F.rint(time.try_cast("double") * frequency).cast("bigint")


class PspSource(Source):
    """Tables below ``path``: ``zones`` (zone, key, value, description), ``images`` (zone, t_idx, i, j, cp),
    ``coordinates`` (zone, i, j, x, y, z), ``masks`` (zone, mask, i, j, w). Zone and mask are arguments."""

    FREQUENCY = "SamplingFrequency"

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark)
        if not Path(path).exists():
            raise FileNotFoundError(path)
        self.path = path

    @classmethod
    def ingest(cls, spark: SparkSession, hdf5: str, path: str) -> PspSource:
        """Copy an HDF5 file into the tables, one time step at a time."""
        import numpy as np
        import pandas as pd

        with _h5py().File(hdf5, "r") as f:
            for zone in (k for k in f if k.startswith("Zone")):
                g = f[zone]
                zones = [(zone, k, str(v), "") for k, v in g.attrs.items()]
                spark.createDataFrame(zones, "zone string, key string, value string, description string").write.mode("append").parquet(f"{path}/zones")
                xyz = [np.asarray(g[f"Coordinate{c}"]) for c in "XYZ"]
                i, j = np.indices(xyz[0].shape)
                spark.createDataFrame(pd.DataFrame({"zone": zone, "i": i.ravel(), "j": j.ravel(), **{c: v.ravel() for c, v in zip("xyz", xyz, strict=True)}})).write.mode("append").parquet(f"{path}/coordinates")
                for mask in (k for k in g if k.startswith("Mask")):
                    spark.createDataFrame(pd.DataFrame({"zone": zone, "mask": mask, "i": i.ravel(), "j": j.ravel(), "w": np.asarray(g[mask]).ravel().astype(float)})).write.mode("append").parquet(f"{path}/masks")
                for t in range(g["Images"].shape[2]):
                    spark.createDataFrame(pd.DataFrame({"zone": zone, "t_idx": t, "i": i.ravel(), "j": j.ravel(), "cp": g["Images"][:, :, t].ravel().astype(float)})).write.mode("append").parquet(f"{path}/images")
        return cls(spark, path)

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    @property
    def zone_names(self) -> list[str]:
        return sorted(r[0] for r in self._table("zones").select("zone").distinct().collect())

    def mask_names(self, zone: str) -> list[str]:
        return sorted(r[0] for r in self._table("masks").where(F.col("zone") == zone).select("mask").distinct().collect())

    def zone_info(self, zone: str) -> dict[str, tuple[str, str]]:
        return {r["key"]: (r["value"], r["description"]) for r in self._table("zones").where(F.col("zone") == zone).collect()}

    def frequency(self, zone: str) -> float:
        return float(self.zone_info(zone)[self.FREQUENCY][0])

    def times(self, zone: str) -> list[str]:
        n = self._table("images").where(F.col("zone") == zone).agg(F.max("t_idx")).first()[0]
        f = self.frequency(zone)
        return [str(round(k / f, 8)) for k in range(n + 1)]

    @property
    def write_times(self) -> list[str]:
        return self.times(self.zone_names[0])

    @property
    def field_names(self) -> dict[str, list[str]]:
        return {self.write_times[0]: ["Cp"]}

    def index(self, time: str, zone: str) -> int:
        return round(float(time) * self.frequency(zone))

    def images(self, zone: str, times: list[str] | None = None, mask: str | None = None, every: int = 1) -> DataFrame:
        """t_idx, i, j, cp of a zone; multiplied by a mask if given; each ``every``-th pixel."""
        x = self._table("images").where(F.col("zone") == zone)
        if times is not None:
            x = x.where(F.col("t_idx").isin([self.index(t, zone) for t in times]))
        if every > 1:
            x = x.where((F.col("i") % every == 0) & (F.col("j") % every == 0))
        if mask is not None:
            m = self._table("masks").where((F.col("zone") == zone) & (F.col("mask") == mask)).select("i", "j", "w")
            x = x.join(m, ["i", "j"]).withColumn("cp", F.col("cp") * F.col("w"))
        return x.select("t_idx", "i", "j", "cp")

    def statistics(self, zone: str, times: list[str] | None = None, mask: str | None = None) -> DataFrame:
        """Mean and sample standard deviation over time per pixel."""
        return temporal(self.images(zone, times, mask), ["i", "j"], "cp")

    def aspect_ratio(self, zone: str) -> dict[str, float | None]:
        """Extent along each axis relative to x; None where the zone has no extent along x."""
        c = self._table("coordinates").where(F.col("zone") == zone)
        r = c.agg(*((F.max(k) - F.min(k)).alias(k) for k in "xyz")).first()
        return {k: r[k] / r["x"] if r["x"] else None for k in "xyz"}

    @property
    def vertices(self) -> DataFrame:
        return self._table("coordinates")

    @property
    def weights(self) -> DataFrame:
        return self._table("masks")


class SCubeSource(Source):
    """Tables below ``path``: ``cells`` (cell_id, x, y, z, level), ``nodes``, ``faces``, ``variable`` (time, name, cell_id,
    value) with names like p_center, and ``size`` (size0, dims). Snapshots always keep their time."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark)
        self.path = path

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    @property
    def write_times(self) -> list[str]:
        return sorted((r[0] for r in self._table("variable").select("time").distinct().collect()), key=float)

    @property
    def field_names(self) -> dict[str, list[str]]:
        x = self._table("variable").where(F.col("name").endswith("center")).select("time", F.split("name", "_")[0].alias("f")).distinct()
        out: dict[str, list[str]] = {}
        for r in x.collect():
            out.setdefault(r["time"], []).append(r["f"])
        return {t: sorted(f) for t, f in out.items()}

    def load_snapshot(self, field_name: str | list[str], time: str | list[str] | None = None) -> DataFrame:
        return super().load_snapshot(field_name, time if time is not None else self.write_times)

    def snapshots(self, fields: list[str], times: list[str]) -> DataFrame:
        x = self._table("variable").where(F.col("time").isin(times) & F.col("name").isin([f"{f}_center" for f in fields]))
        return x.select("time", F.split("name", "_")[0].alias("field"), F.col("cell_id").alias("point_id"), F.lit(0).alias("comp"), "value")

    @property
    def vertices(self) -> DataFrame:
        return self._table("cells").select(F.col("cell_id").alias("point_id"), "x", "y", "z")

    @property
    def levels(self) -> DataFrame:
        return self._table("cells").select(F.col("cell_id").alias("point_id"), "level")

    @property
    def nodes(self) -> DataFrame:
        return self._table("nodes")

    @property
    def faces(self) -> DataFrame:
        return self._table("faces")

    @property
    def weights(self) -> DataFrame:
        """2^-d (size0 / 2^level)^d."""
        size = F.broadcast(self._table("size"))
        w = F.pow(F.lit(2.0), -F.col("dims")) * F.pow(F.col("size0") / F.pow(F.lit(2.0), "level"), "dims")
        return self._table("cells").crossJoin(size).select(F.col("cell_id").alias("point_id"), w.alias("w"))
