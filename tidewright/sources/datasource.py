"""Snapshots as Spark data sources: ``spark.read.format("tidewright_foam").load(case)``.

One input partition per file, made on the driver from a listing; a partition is parsed by one task. Filters
on time and field are taken in while partitions are planned, so files that are not asked for are not opened.
``register(spark)`` makes the formats known to a session and lets it pass filters to Python sources.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from tidewright.sources import vtk
from tidewright.sources.base import numeric
from tidewright.sources.foam import COMPONENTS, FoamCase, header, parse_field

SCHEMA = "time string, field string, point_id bigint, comp int, value double"
_ARROW = pa.schema([("time", pa.string()), ("field", pa.string()), ("point_id", pa.int64()), ("comp", pa.int32()), ("value", pa.float64())])


def _batch(time: str, field: str, values: np.ndarray, first: int = 0) -> pa.RecordBatch:
    n, c = values.shape
    cols = [pa.array([time] * (n * c)), pa.array([field] * (n * c)), pa.array(np.repeat(np.arange(n) + first, c)), pa.array(np.tile(np.arange(c, dtype=np.int32), n)), pa.array(np.ascontiguousarray(values, np.float64).ravel())]
    return pa.RecordBatch.from_arrays(cols, schema=_ARROW)


class Piece(InputPartition):
    """One file, with what is needed to read it."""

    def __init__(self, path: str, time: str, fields: tuple[str, ...], first: int = 0, cells: int = 0):
        super().__init__(path)
        self.path, self.time, self.fields, self.first, self.cells = path, time, fields, first, cells


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute in (("time",), ("field",)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                name = f.attribute[0]
                self.wanted[name] = self.wanted[name] & values if name in self.wanted else values
            else:
                yield f

    def keeps(self, name: str, value: str) -> bool:
        return name not in self.wanted or value in self.wanted[name]


class FoamReader(_Reader):
    def partitions(self) -> list[Piece]:
        case = FoamCase(self.options["path"])
        cells = [case.n_cells(p) for p in range(case.processors)]
        start = np.concatenate([[0], np.cumsum(cells)]).tolist()
        out = []
        for t in filter(lambda t: self.keeps("time", t), case.time_folders):
            for f in filter(lambda f: self.keeps("field", f), case.field_names[t]):
                with open(case.file(f, t), "rb") as file:
                    known = header(file.read(8192)).get("class") in COMPONENTS
                if known:
                    out += [Piece(case.file(f, t, p), t, (f,), int(start[p]), cells[p]) for p in range(case.processors)]
        return out

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        if piece is not None:
            yield _batch(piece.time, piece.fields[0], parse_field(Path(piece.path).read_bytes(), piece.cells), piece.first)


class VtkReader(_Reader):
    def partitions(self) -> list[Piece]:
        prefix, suffix = self.options.get("prefix", ""), self.options.get("suffix", ".vtk")
        found = {p.name[len(prefix) : len(p.name) - len(suffix)]: str(p) for p in Path(self.options["path"]).glob(f"{prefix}*{suffix}")}
        return [Piece(f, t, ()) for t, f in sorted(found.items()) if numeric(t) and self.keeps("time", t)]

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        if piece is not None:
            for f, v in vtk.parse(piece.path, Path(piece.path).read_bytes())[1].items():
                if self.keeps("field", f):
                    yield _batch(piece.time, f, v)


class _Snapshots(DataSource):
    def schema(self) -> str:
        return SCHEMA


class FoamDataSource(_Snapshots):
    @classmethod
    def name(cls) -> str:
        return "tidewright_foam"

    def reader(self, schema) -> FoamReader:
        return FoamReader(dict(self.options))


class VtkDataSource(_Snapshots):
    @classmethod
    def name(cls) -> str:
        return "tidewright_vtk"

    def reader(self, schema) -> VtkReader:
        return VtkReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (FoamDataSource, VtkDataSource):
        spark.dataSource.register(source)
