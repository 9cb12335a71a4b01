"""The snapshot store: Parquet with constants and, per time and field, the values; with an XDMF description.

Layout below one folder: ``constant/{centers,volumes,vertices,connectivity}`` and ``variable`` partitioned by
``time`` and ``field``, so that a selection of times and fields reads only their files.
"""

from __future__ import annotations

import os
from pathlib import Path
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewright.session import folder_for

from tidewright.sources.base import Source
from tidewright.sources.foam import COMPONENTS, FoamSource, header

CONSTANTS = ("centers", "volumes", "vertices", "connectivity")
#: Points of a field in one file of the store.
FILE = 10_000_000
#: XDMF attribute types by number of components.
ATTRIBUTE = {1: "Scalar", 3: "Vector", 6: "Tensor6", 9: "Tensor"}


class Store(Source):
    """Read and write a store. Times sort as numbers and keep their spelling."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark)
        self.path = path

    def write(self, snapshots: DataFrame) -> None:
        """Write rows (time, field, point_id, comp, value); only the times and fields among them are replaced."""
        rows = snapshots.select("time", "field", "point_id", "comp", "value").repartition("time", "field", F.floor(F.col("point_id") / FILE))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("time", "field").parquet(f"{self.path}/variable")

    def write_constant(self, name: str, rows: DataFrame) -> None:
        if name not in CONSTANTS:
            raise ValueError(f"unknown constant {name!r}; known: {', '.join(CONSTANTS)}")
        rows.write.mode("overwrite").parquet(f"{self.path}/constant/{name}")

    def constant(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/constant/{name}")

    @property
    def _all(self) -> DataFrame:
        kind = "point_id bigint, comp int, value double, time string, field string"
        return self.spark.read.schema(kind).parquet(f"{self.path}/variable")

    def _catalog(self) -> list:
        return self._all.select("time", "field").distinct().collect()

    @property
    def write_times(self) -> list[str]:
        return sorted({r["time"] for r in self._catalog()}, key=lambda t: (float(t), t))

    @property
    def field_names(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for r in self._catalog():
            out.setdefault(r["time"], []).append(r["field"])
        return {t: sorted(f) for t, f in out.items()}

    def snapshots(self, fields: list[str], times: list[str]) -> DataFrame:
        return self._all.where(F.col("time").isin(times) & F.col("field").isin(fields)).select("time", "field", "point_id", "comp", "value")

    @property
    def vertices(self) -> DataFrame:
        return self.constant("centers")

    @property
    def weights(self) -> DataFrame:
        return self.constant("volumes")


def write_xdmf(store: Store, name: str = "store.xdmf", chunk: int = 1_000_000) -> str:
    """One grid per time (or one without) with the fields that have a value for every cell; returns the path.

    Parquet is nothing that a viewer reads, so the numbers are laid beside it as raw files that the description
    points to. Every file is written in stretches of ``chunk`` points at their place in it.
    """
    base = folder_for(store.path)
    n_cells = store.weights.count()
    n_points = store.constant("vertices").count()
    length = store.constant("connectivity").agg(F.sum(F.size("stream"))).first()[0] or 0
    shape = store._all.groupBy("time", "field").agg(F.countDistinct("point_id").alias("n"), (F.max("comp") + 1).alias("c"), F.min("point_id").alias("first")).collect()
    fields = {(r["time"], r["field"]): r["c"] for r in shape if r["n"] == n_cells and r["first"] == 0}

    vertices = store.constant("vertices").select(F.lit("vertices.bin").alias("file"), F.col("pid").alias("at"), F.array("x", "y", "z").alias("v"))
    _raw(vertices, base / "raw", chunk, "<f8")
    # The streams of the cells follow each other; where one begins is summed up over stretches of cells first.
    cells = store.constant("connectivity").withColumn("stretch", F.floor(F.col("cid") / chunk))
    before = W.orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
    sums = cells.groupBy("stretch").agg(F.sum(F.size("stream")).alias("n")).select("stretch", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    own = W.partitionBy("stretch").orderBy("cid").rowsBetween(W.unboundedPreceding, -1)
    placed = cells.join(sums, "stretch").withColumn("at", F.col("start") + F.coalesce(F.sum(F.size("stream")).over(own), F.lit(0)))
    numbers = placed.select(F.lit("connectivity.bin").alias("file"), "at", F.posexplode("stream").alias("k", "value")).select("file", (F.col("at") + F.col("k")).alias("at"), F.array("value").alias("v"))
    _raw(numbers, base / "raw", chunk, "<i8")
    kept = store.spark.createDataFrame([(t, f, f"{t}/{f}.bin") for t, f in fields], "time string, field string, file string")
    values = store._all.join(F.broadcast(kept), ["time", "field"]).groupBy("file", "point_id").agg(F.array_sort(F.collect_list(F.struct("comp", "value"))).alias("s"))
    _raw(values.select("file", F.col("point_id").alias("at"), F.transform("s", lambda x: x["value"]).alias("v")), base / "raw", chunk, "<f8")

    def item(location: str, dims: str, kind: str = "Float") -> str:
        return f'<DataItem Dimensions="{dims}" NumberType="{kind}" Precision="8" Format="Binary" Endian="Little">{escape("raw/" + location)}</DataItem>'

    def grid(time: str | None) -> str:
        out = [f'<Grid Name="Grid" GridType="Uniform">{f"<Time Value={quoteattr(time)}/>" if time else ""}']
        out.append(f'<Topology TopologyType="Mixed" NumberOfElements="{n_cells}">{item("connectivity.bin", str(length), "Int")}</Topology>')
        out.append(f'<Geometry GeometryType="XYZ">{item("vertices.bin", f"{n_points} 3")}</Geometry>')
        for (t, f), c in sorted(fields.items()):
            if t == time:
                out.append(f'<Attribute Name={quoteattr(f)} AttributeType="{ATTRIBUTE.get(c, "Matrix")}" Center="Cell">{item(f"{t}/{f}.bin", f"{n_cells} {c}" if c > 1 else str(n_cells))}</Attribute>')
        return "\n".join([*out, "</Grid>"])

    times = store.write_times or [None]
    text = "\n".join(['<?xml version="1.0"?>', '<Xdmf Version="3.0">', "<Domain>", '<Grid Name="Series" GridType="Collection" CollectionType="Temporal">', *map(grid, times), "</Grid>", "</Domain>", "</Xdmf>", ""])
    path = base / name
    path.write_text(text)
    return str(path)


def _raw(rows: DataFrame, base: Path, chunk: int, kind: str) -> None:
    """Write ``v``, the numbers of place ``at``, of every ``file``; all places of a file hold as many numbers."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        path = base / p["file"].iloc[0]
        path.parent.mkdir(parents=True, exist_ok=True)
        p = p.sort_values("at")
        data = np.stack(p["v"].to_numpy()).astype(kind)
        with open(os.open(path, os.O_WRONLY | os.O_CREAT), "wb") as f:
            f.seek(int(p["at"].iloc[0]) * data.shape[1] * 8)
            f.write(data.tobytes())
        return pd.DataFrame({"n": [len(p)]})

    rows.withColumn("chunk", F.floor(F.col("at") / chunk)).groupBy("file", "chunk").applyInPandas(run, "n bigint").agg(F.sum("n")).collect()


def read_xdmf(path: str) -> dict[tuple[str | None, str], np.ndarray]:
    """The numbers that a description points to, by time and by attribute (or Topology, Geometry)."""
    out = {}
    root = Path(path).parent
    for grid in ElementTree.parse(path).getroot().iter("Grid"):
        if grid.get("GridType") != "Uniform":
            continue
        time = grid.find("Time")
        for e in grid:
            i = e.find("DataItem")
            if i is not None:
                kind = "<f8" if i.get("NumberType") == "Float" else "<i8"
                shape = tuple(map(int, i.get("Dimensions").split()))
                out[None if time is None else time.get("Value"), e.get("Name") or e.tag] = np.fromfile(root / i.text, kind).reshape(shape)
    return out


def foam_to_store(source: FoamSource, path: str, fields: list[str] | None = None, times: list[str] | None = None) -> Store:
    """Copy a case that isn't decomposed into a store; fields and times are limited to those that exist."""
    if source.case.distributed:
        raise ValueError("decomposed cases must be reconstructed first")
    store = Store(source.spark, path)
    cells = source.mesh.cells()
    store.write_constant("centers", cells.select("point_id", "x", "y", "z"))
    store.write_constant("volumes", cells.select("point_id", F.col("volume").alias("w")))
    store.write_constant("vertices", source.mesh.points())
    store.write_constant("connectivity", source.mesh.topology())
    # Times with the same fields are written together.
    alike: dict[tuple[str, ...], list[str]] = {}
    names = source.field_names
    for t in [t for t in source.write_times if times is None or t in times]:
        alike.setdefault(tuple(f for f in names[t] if (fields is None or f in fields) and _kind(source.case.file(f, t)) in COMPONENTS), []).append(t)
    for known, own in alike.items():
        if known:
            store.write(source.snapshots(list(known), own))
    return store


def _kind(path: str) -> str | None:
    with open(path, "rb") as f:
        return header(f.read(8192)).get("class")


def copy_mesh(spark: SparkSession, source: str, target: str) -> Store:
    """A new store with only the constants of another."""
    a, b = Store(spark, source), Store(spark, target)
    for name in CONSTANTS:
        b.write_constant(name, a.constant(name))
    return b
