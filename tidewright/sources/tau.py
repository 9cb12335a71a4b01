"""Volume and surface solutions of TAU in classic NetCDF files."""

from __future__ import annotations

from collections.abc import Iterator
import re
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.sources.base import Source, local_path
from tidewright.sources.netcdf import NetCdf

#: Entries of the parameter file and names in the grid files.
ENTRIES = {"solution_prefix": "Output files prefix", "primary_grid": "Primary grid filename", "grid_prefix": "Grid prefix", "n_domains": "Number of domains"}
COORDINATES = ("points_xc", "points_yc", "points_zc")
VOLUME_NAME, SURFACE_NAME = ".pval.unsteady_", ".surface.pval.unsteady_"
TRIANGLES, QUADS, MARKERS = "points_of_surfacetriangles", "points_of_surfacequadrilaterals", "boundarymarker_of_surfaces"


class TauConfig:
    """The parameter file: ``parameter : value # comment``; of repeated parameters the last counts."""

    def __init__(self, file_path: str):
        self.path, self.lines = str(Path(file_path).parent), Path(file_path).read_text().splitlines()

    @staticmethod
    def _value(line: str) -> str:
        return line.split(":")[-1].split("#")[0].strip()

    def value(self, parameter: str) -> str:
        found = [self._value(x) for x in self.lines if parameter in x and "#" not in x.split(":")[0]]
        return found[-1] if found else ""

    @property
    def zones(self) -> dict[str, list[int]]:
        """Boundary name -> markers, of the blocks whose surface data is written; a name in use gets its first marker."""
        name = self.value("Boundary mapping filename")
        lines = self.lines if name == "(thisfile)" else (Path(self.path) / name).read_text().splitlines()
        out: dict[str, list[int]] = {}
        markers: list[int] | None = None
        title, written = "", False
        for line in lines:
            if "Markers" in line:
                markers, title, written = [int(m) for m in self._value(line).split(",")], "", False
            elif markers is None:
                continue
            elif "Write surface data (0/1)" in line:
                written = True
            elif "Name" in line:
                title = self._value(line)
            elif "block end" in line:
                if written:
                    out[f"{title}_marker{markers[0]}" if title in out else title] = markers
                markers = None
        return out

    @property
    def config(self) -> dict:
        out = {k: self.value(v) for k, v in ENTRIES.items()}
        return out | {"n_domains": int(out["n_domains"] or 1), "bmap_file": self.zones}


class _Tau(Source):
    solution = VOLUME_NAME

    def __init__(self, spark: SparkSession, parameter_file: str, distributed: bool = False):
        super().__init__(spark)
        self.para, self.distributed = TauConfig(parameter_file), distributed
        self.config = self.para.config
        base = Path(self.para.path) / f"{self.config['solution_prefix']}{self.solution}"
        tail = ".domain_0" if distributed else ""
        self.iterations = {}
        for p in base.parent.glob(f"{base.name}i=*_t=*{tail}"):
            rest = p.name[len(base.name) :]
            if distributed or ".domain_" not in rest:
                i, t = rest.removeprefix("i=").split("_t=")
                self.iterations[t.removesuffix(tail)] = i
        if not self.iterations:
            raise FileNotFoundError(f"no solution files in {self.para.path}")

    @property
    def write_times(self) -> list[str]:
        return sorted(self.iterations, key=float)

    def file(self, time: str, domain: int | None = None) -> str:
        tail = "" if domain is None else f".domain_{domain}"
        return str(Path(self.para.path) / f"{self.config['solution_prefix']}{self.solution}i={self.iterations[time]}_t={time}{tail}")

    def _open(self, path: str | Path) -> NetCdf:
        return NetCdf(Path(path).read_bytes())

    def _scan(self, files: list[str], fn, kind: str) -> DataFrame:
        """Rows that ``fn`` makes of each file and of the time and domain that its name spells."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for path, content in zip(b["path"], b["content"], strict=True):
                    name = local_path(path).rsplit("/", 1)[-1]
                    domain = re.search(r"[._]domain_(\d+)", name)
                    time = re.search(r"_t=(.*?)(?:\.domain_\d+)?$", name)
                    yield from fn(NetCdf(bytes(content)), time and time[1], int(domain[1]) if domain else 0)

        # File names hold '=': they are given one by one, not as partition folders.
        return self.spark.read.format("binaryFile").load([str(Path(f).resolve()) for f in files]).select("path", "content").mapInPandas(run, kind)


class TauSource(_Tau):
    """Volume solution, whole or in domains; a domain's additional points are left out."""

    def _grid_files(self) -> list[str]:
        if not self.distributed:
            return [str(Path(self.para.path) / self.config["primary_grid"])]
        return [str(Path(self.para.path) / f"{self.config['grid_prefix']}_domain_{k}_grid_1") for k in range(self.config["n_domains"])]

    @staticmethod
    def _points(g: NetCdf) -> np.ndarray:
        if "pcoord" in g.variables:
            v, more = g["pcoord"], g.shape("addpoint_idx")[0]
        else:
            v = np.stack([g[c] for c in COORDINATES], axis=1)
            more = g.shape("addpoint_id")[0] if "addpoint_id" in g.variables else 0
        return v[: len(v) - more]

    @property
    def sizes(self) -> list[int]:
        return [len(self._points(self._open(f))) for f in self._grid_files()]

    def _first_ids(self) -> list[int]:
        return np.concatenate([[0], np.cumsum(self.sizes)]).astype(int).tolist()

    @property
    def field_names(self) -> dict[str, list[str]]:
        n = self.sizes[0]
        out = {}
        for t in self.write_times:
            d = self._open(self.file(t, 0 if self.distributed else None))
            out[t] = [v for v in d.variables if d.shape(v)[:1] == (n,)]
        return out

    def snapshots(self, fields: list[str], times: list[str]) -> DataFrame:
        first = self._first_ids()
        domains = range(self.config["n_domains"]) if self.distributed else [None]
        files = [self.file(t, d) for t in times for d in domains]

        def fn(d: NetCdf, t: str, domain: int):
            for f in fields:
                v = d[f].astype(np.float64)
                yield pd.DataFrame({"time": t, "field": f, "point_id": np.arange(len(v)) + first[domain], "comp": 0, "value": v})

        return self._scan(files, fn, "time string, field string, point_id bigint, comp int, value double")

    @property
    def vertices(self) -> DataFrame:
        first, points = self._first_ids(), self._points

        def fn(g: NetCdf, _time: str | None, domain: int):
            p = points(g).astype(np.float64)
            yield pd.DataFrame({"point_id": np.arange(len(p)) + first[domain], "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]})

        return self._scan(self._grid_files(), fn, "point_id bigint, x double, y double, z double")

    @property
    def weights(self) -> DataFrame:
        """The cell volumes of the last time divided by the largest, or ones."""
        last = self.write_times[-1]
        if "volume" not in self._open(self.file(last, 0 if self.distributed else None)).variables:
            return self.vertices.select("point_id", F.lit(1.0).alias("w"))
        v = self.snapshots(["volume"], [last]).select("point_id", "value")
        return v.crossJoin(F.broadcast(v.agg(F.max("value").alias("most")))).select("point_id", (F.col("value") / F.col("most")).alias("w"))


class TauSurfaceSource(_Tau):
    """Surface solution by zone; the zone is an argument, not a state."""

    solution = SURFACE_NAME

    def elements(self) -> DataFrame:
        """marker and point of every corner of every surface element, triangles first."""

        def fn(g: NetCdf, _time: str | None, _domain: int):
            marker = g[MARKERS]
            start = 0
            for key in (TRIANGLES, QUADS):
                if key in g.variables:
                    e = g[key]
                    own = marker[start : start + len(e)]
                    start += len(e)
                    yield pd.DataFrame({"marker": np.repeat(own, e.shape[1]), "point_id": e.ravel().astype(np.int64)})
            if not start:
                raise ValueError("the grid has no surface elements")

        return self._scan([str(Path(self.para.path) / self.config["primary_grid"])], fn, "marker int, point_id bigint")

    @property
    def zone_names(self) -> list[str]:
        return list(self.config["bmap_file"])

    def zone_ids(self) -> DataFrame:
        """zone and point_id, each once."""
        rows = [(z, m) for z, markers in self.config["bmap_file"].items() for m in markers]
        zones = self.spark.createDataFrame(rows, "zone string, marker int")
        return self.elements().join(F.broadcast(zones), "marker").select("zone", "point_id").distinct()

    @property
    def field_names(self) -> dict[str, list[str]]:
        out = {}
        for t in self.write_times:
            d = self._open(self.file(t))
            n = d.shape("global_id")[0]
            out[t] = [v for v in d.variables if d.shape(v)[:1] == (n,) and v != "global_id"]
        return out

    def snapshots(self, fields: list[str], times: list[str], zone: str | None = None) -> DataFrame:
        def fn(d: NetCdf, t: str, _domain: int):
            ids = d["global_id"].astype(np.int64)
            for f in fields:
                yield pd.DataFrame({"time": t, "field": f, "point_id": ids, "comp": 0, "value": d[f].astype(np.float64)})

        x = self._scan([self.file(t) for t in times], fn, "time string, field string, point_id bigint, comp int, value double")
        return x if zone is None else x.join(self.zone_ids().where(F.col("zone") == zone).select("point_id"), "point_id", "left_semi")

    @property
    def vertices(self) -> DataFrame:
        """zone, point_id, x, y, z."""

        def fn(g: NetCdf, _time: str | None, _domain: int):
            p = np.stack([g[c] for c in COORDINATES], axis=1).astype(np.float64)
            yield pd.DataFrame({"point_id": np.arange(len(p)), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]})

        points = self._scan([str(Path(self.para.path) / self.config["primary_grid"])], fn, "point_id bigint, x double, y double, z double")
        return self.zone_ids().join(points, "point_id")

    @property
    def weights(self) -> DataFrame:
        """zone, point_id, w: the first layer's volumes divided by the zone's largest, or ones."""
        from pyspark.sql import Window as W

        last = self.write_times[-1]
        if "volume" not in self._open(self.file(last)).variables:
            return self.zone_ids().withColumn("w", F.lit(1.0))
        v = self.snapshots(["volume"], [last]).select("point_id", "value")
        return self.zone_ids().join(v, "point_id").select("zone", "point_id", (F.col("value") / F.max("value").over(W.partitionBy("zone"))).alias("w"))
