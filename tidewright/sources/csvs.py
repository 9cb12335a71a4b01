"""Snapshots in delimited text: DaVis files and raw surface files."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.sources.base import Source, numeric


def davis_columns(line: Column) -> Column:
    """All double-quoted names of a VARIABLES line."""
    return F.regexp_extract_all(line, F.lit('"([^"]*)"'), 1)


def surface_columns(line: Column) -> Column:
    """Names of a comment line, divided by blanks."""
    return F.filter(F.split(F.regexp_replace(line, "#", ""), " "), lambda x: x != "")


class _Delimited(Source):
    """Files of one table per time. Every file is read once for all fields asked for (column pruning in the scan)."""

    sep, skip = r"\s+", 0

    def __init__(self, spark: SparkSession, path: str, names: list[str], vertex: list[str], weight: list[str]):
        super().__init__(spark)
        self.path, self.names, self.vertex_names, self.weight_names = path, names, vertex, weight
        self.fields = [n for n in names if n not in {*vertex, *weight}]

    def files(self) -> dict[str, str]:
        """time -> file."""
        raise NotImplementedError

    def time_of(self, path: Column) -> Column:
        """The time that a file's path spells."""
        raise NotImplementedError

    def rows(self, times: list[str] | None = None) -> DataFrame:
        """time, point_id and all columns, of the given times."""
        files = self.files()
        wanted = {t: files[t] for t in (times or files)}
        text = self.spark.read.text(list(wanted.values()), wholetext=True).select(self.time_of(F.col("_metadata.file_path")).alias("time"), "value")
        lines = text.select("time", F.posexplode(F.filter(F.slice(F.split("value", r"\r?\n"), self.skip + 1, 2**30), lambda x: F.trim(x) != "")).alias("point_id", "line"))
        lines = lines.where(~F.col("line").startswith("#"))
        bits = lines.select("time", F.col("point_id").cast("bigint").alias("point_id"), F.split(F.trim("line"), self.sep).alias("_b"))
        return bits.select("time", "point_id", *(F.col("_b")[i].try_cast("double").alias(n) for i, n in enumerate(self.names)))

    @property
    def write_times(self) -> list[str]:
        return sorted(self.files(), key=float)

    @property
    def field_names(self) -> dict[str, list[str]]:
        return {self.write_times[0]: self.fields}

    def snapshots(self, fields: list[str], times: list[str]) -> DataFrame:
        x = self.rows(times)
        pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").alias("value")) for f in fields)))
        return x.select("time", "point_id", pairs.alias("_p")).select("time", F.lit(0).alias("comp"), "point_id", "_p.field", "_p.value")

    @property
    def vertices(self) -> DataFrame:
        return self.rows(self.write_times[:1]).select("point_id", *(F.col(f"`{v}`").alias(k) for v, k in zip(self.vertex_names, "xyz", strict=False)))

    @property
    def weights(self) -> DataFrame:
        x = self.rows(self.write_times[:1])
        if not self.weight_names:
            w = F.lit(1.0)
        elif len(self.weight_names) == 1:
            w = F.col(f"`{self.weight_names[0]}`")
        else:
            w = F.sqrt(sum((F.col(f"`{c}`") * F.col(f"`{c}`") for c in self.weight_names), F.lit(0.0)))
        return x.select("point_id", w.alias("w"))


class DavisSource(_Delimited):
    """Files <prefix><time><suffix> of three header lines and columns divided by blanks; weight isValid."""

    skip = 3

    def __init__(self, spark: SparkSession, path: str, prefix: str = "", suffix: str = ".dat"):
        self.prefix, self.suffix, self.path = prefix, suffix, path
        first = next(iter(sorted(Path(path).glob(f"{prefix}*{suffix}"))), None)
        if first is None:
            raise FileNotFoundError(f"no file {prefix}*{suffix} in {path}")
        with open(first) as f:
            names = next((re.findall(r'"([^"]*)"', line) for line in (f.readline() for _ in range(3)) if "VARIABLES" in line), [])
        super().__init__(spark, path, names, [n for n in ("x", "y") if n in names], [n for n in ("isValid",) if n in names])

    def time_of(self, path: Column) -> Column:
        name = F.element_at(F.split(path, "/"), -1)
        return F.substring(name, len(self.prefix) + 1, F.length(name) - len(self.prefix) - len(self.suffix))

    def files(self) -> dict[str, str]:
        found = {p.name[len(self.prefix) : len(p.name) - len(self.suffix)]: str(p) for p in Path(self.path).glob(f"{self.prefix}*{self.suffix}")}
        return {t: f for t, f in found.items() if numeric(t)}


class SurfaceSource(_Delimited):
    """One file of the same name in each time folder; the header is comment line number ``header``."""

    def __init__(self, spark: SparkSession, path: str, file_name: str, header: int = 1):
        self.path, self.file_name, self.skip = path, file_name, header + 1
        first = next(iter(self.files().values()), None)
        if first is None:
            raise FileNotFoundError(f"no {file_name} in the time folders of {path}")
        with open(first) as f:
            line = [f.readline() for _ in range(header + 1)][header]
        names = [x for x in line.replace("#", "").split() if x]
        areas = [n for n in ("area_x", "area_y", "area_z") if n in names]
        super().__init__(spark, path, names, [n for n in ("x", "y", "z") if n in names], areas)

    def time_of(self, path: Column) -> Column:
        return F.element_at(F.split(path, "/"), -2)

    def files(self) -> dict[str, str]:
        return {p.parent.name: str(p) for p in Path(self.path).glob(f"*/{self.file_name}") if numeric(p.parent.name)}
