"""Snapshots and meshes of OpenFOAM cases, ASCII or binary, whole or decomposed.

The driver lists folders and reads headers only; files are read and parsed by the executors, one row of
``binaryFile`` each. A decomposed case's points are numbered processor by processor.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions.checks import existing_path
from tidewright.operators import mesh
from tidewright.sources.base import Source, local_path, numeric

#: Numbers per point of the field classes, and the files of a mesh.
COMPONENTS = {"volScalarField": 1, "volVectorField": 3, "volSymmTensorField": 6, "volTensorField": 9}
MESH_FILES = ("points", "faces", "owner", "neighbour", "boundary")
NUMBER = rb"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?|[-+]?(?:nan|inf)"


def header(data: bytes) -> dict[str, str]:
    """The entries of the file's header."""
    block = re.search(rb"FoamFile\s*\{(.*?)\}", data[:8192], re.S)
    return {m[0].decode(): m[1].decode().strip().strip('"') for m in re.findall(rb"(\w+)\s+([^;]*);", block[1])} if block else {}


def body_start(data: bytes) -> int:
    block = re.search(rb"FoamFile\s*\{.*?\}", data[:8192], re.S)
    return block.end() if block else 0


def parse_list(data: bytes, at: int, width: int, binary: bool, kind: str = "<f8") -> tuple[np.ndarray, int]:
    """The next list of ``width`` numbers per entry: values (n x width) and where it ends."""
    m = re.compile(rb"\s*(?://[^\n]*\n\s*)*(\d+)\s*\(").match(data, at) or re.compile(rb"(?:\n|\s)(\d+)\s*\(").search(data, at)
    if m is None:
        raise ValueError("no list found")
    n, at = int(m[1]), m.end()
    if binary:
        size = n * width * np.dtype(kind).itemsize
        return np.frombuffer(data, kind, n * width, at).reshape(n, width), at + size + 1
    end = re.compile(rb"\n\s*\)").search(data, at - 1)
    stop = end.start() if end else data.rindex(b")")
    text = data[at:stop].replace(b"(", b" ").replace(b")", b" ")
    values = np.array(text.split(), np.float64) if text.strip() else np.zeros(0)
    if len(values) != n * width:
        raise ValueError(f"{n * width} numbers expected, {len(values)} found")
    return values.reshape(n, width), end.end() if end else len(data)


def parse_field(data: bytes, n_cells: int) -> np.ndarray:
    """Values of the internal field (cells x components); a uniform value is repeated for every cell."""
    head = header(data)
    width = COMPONENTS.get(head.get("class", ""))
    if width is None:
        raise ValueError(f"field class {head.get('class')!r} is not supported")
    m = re.search(rb"internalField\s+(nonuniform|uniform)", data)
    if m is None:
        raise ValueError("no internal field")
    if m[1] == b"uniform":
        value = np.array([float(x) for x in re.findall(NUMBER, data[m.end() : data.index(b";", m.end())])])
        return np.repeat(value[None], n_cells, axis=0)
    at = re.compile(rb"List<\w+>\s*").search(data, m.end()).end()
    return parse_list(data, at, width, head.get("format") == "binary")[0]


def parse_faces(data: bytes) -> list[np.ndarray]:
    """Point labels of each face; any number of points, also in the compact binary form."""
    at, binary = body_start(data), header(data).get("format") == "binary"
    if binary:
        offset, at = parse_list(data, at, 1, True, "<i4")
        labels, _ = parse_list(data, at, 1, True, "<i4")
        o, v = offset.ravel(), labels.ravel()
        return [v[a:b].astype(np.int64) for a, b in zip(o[:-1], o[1:], strict=True)]
    return [np.array(m[1].split(), np.int64) for m in re.finditer(rb"\d+\s*\(\s*((?:\d+\s+)*\d+)\s*\)", data[at:])]


class FoamCase:
    """Folder structure of a case."""

    def __init__(self, path: str, distributed: bool | None = None):
        self.path = existing_path(str(path))
        parts = sorted((p for p in Path(self.path).glob("processor*") if p.name[9:].isdigit()), key=lambda p: int(p.name[9:]))
        self.distributed = bool(parts) if distributed is None else distributed
        self.processors = len(parts) if self.distributed else 1
        self.roots = [str(p) for p in parts] if self.distributed else [self.path]
        for r in self.roots:
            lost = [f for f in MESH_FILES if not (Path(r) / "constant/polyMesh" / f).exists()]
            if lost:
                raise FileNotFoundError(f"mesh files missing in {r}: {', '.join(lost)}")
        self.time_folders = sorted((p.name for p in Path(self.roots[0]).iterdir() if p.is_dir() and numeric(p.name)), key=float)
        self.field_names = {t: sorted(p.name for p in (Path(self.roots[0]) / t).iterdir() if p.is_file()) for t in self.time_folders}

    def file(self, field: str, time: str, processor: int = 0) -> str:
        return str(Path(self.roots[processor]) / time / field)

    def n_cells(self, processor: int) -> int:
        """From the note in the header of ``owner``, or from the labels."""
        data = (Path(self.roots[processor]) / "constant/polyMesh/owner").read_bytes()
        m = re.search(rb"nCells:\s*(\d+)", data[:4096])
        if m:
            return int(m[1])
        return int(parse_list(data, body_start(data), 1, header(data).get("format") == "binary", "<i4")[0].max()) + 1


class FoamSource(Source):
    """Cell-centred fields of a case."""

    def __init__(self, spark: SparkSession, path: str, distributed: bool | None = None):
        super().__init__(spark)
        self.case = FoamCase(path, distributed)
        self._cells: list[int] | None = None

    @property
    def cells(self) -> list[int]:
        if self._cells is None:
            self._cells = [self.case.n_cells(p) for p in range(self.case.processors)]
        return self._cells

    @property
    def write_times(self) -> list[str]:
        return self.case.time_folders

    @property
    def field_names(self) -> dict[str, list[str]]:
        return self.case.field_names

    def snapshots(self, fields: list[str], times: list[str]) -> DataFrame:
        cells, start = self.cells, np.concatenate([[0], np.cumsum(self.cells)]).tolist()
        # A file's place in the case says what it holds; only the cells per processor are sent.
        number = {int(Path(r).name[9:]): p for p, r in enumerate(self.case.roots)} if self.case.distributed else None
        files = [self.case.file(f, t, p) for f in fields for t in times for p in range(self.case.processors)]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for path, content in zip(b["path"], b["content"], strict=True):
                    *_, root, t, f = local_path(path).split("/")
                    p = 0 if number is None else number[int(root[9:])]
                    first = int(start[p])
                    v = parse_field(bytes(content), cells[p])
                    k, c = v.shape
                    yield pd.DataFrame({"time": t, "field": f, "point_id": np.repeat(np.arange(k) + first, c), "comp": np.tile(np.arange(c), k), "value": v.ravel()})

        data = self.spark.read.format("binaryFile").load(files).select("path", "content")
        return data.mapInPandas(run, "time string, field string, point_id bigint, comp int, value double")

    @property
    def mesh(self) -> FoamMesh:
        return FoamMesh(self.spark, self.case)

    @property
    def vertices(self) -> DataFrame:
        return self.mesh.cells().select("point_id", "x", "y", "z")

    @property
    def weights(self) -> DataFrame:
        return self.mesh.cells().select("point_id", F.col("volume").alias("w"))


class FoamMesh:
    """Points, faces, owners and neighbours as tables; centres and volumes of cells by joins."""

    def __init__(self, spark: SparkSession, case: FoamCase):
        self.spark, self.case = spark, case

    def _read(self, name: str, processor: int, fn, kind: str) -> DataFrame:
        path = str(Path(self.case.roots[processor]) / "constant/polyMesh" / name)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for content in b["content"]:
                    yield fn(bytes(content))

        return self.spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, kind)

    def points(self, processor: int = 0) -> DataFrame:
        def fn(data: bytes) -> pd.DataFrame:
            v = parse_list(data, body_start(data), 3, header(data).get("format") == "binary")[0]
            return pd.DataFrame({"pid": np.arange(len(v)), "x": v[:, 0], "y": v[:, 1], "z": v[:, 2]})

        return self._read("points", processor, fn, "pid bigint, x double, y double, z double")

    def faces(self, processor: int = 0) -> DataFrame:
        return self._read("faces", processor, lambda data: pd.DataFrame({"fid": np.arange(len(f := parse_faces(data))), "pids": f}), "fid bigint, pids array<bigint>")

    def _labels(self, name: str, processor: int) -> DataFrame:
        def fn(data: bytes) -> pd.DataFrame:
            v = parse_list(data, body_start(data), 1, header(data).get("format") == "binary", "<i4")[0].ravel().astype(np.int64)
            return pd.DataFrame({"fid": np.arange(len(v)), "cid": v})

        return self._read(name, processor, fn, "fid bigint, cid bigint")

    def owner(self, processor: int = 0) -> DataFrame:
        return self._labels("owner", processor)

    def neighbour(self, processor: int = 0) -> DataFrame:
        return self._labels("neighbour", processor)

    def topology(self, processor: int = 0) -> DataFrame:
        return mesh.topology(self.faces(processor), self.owner(processor), self.neighbour(processor))

    def cells(self) -> DataFrame:
        """point_id, x, y, z, volume of all cells; read from constant/C and constant/V where these exist."""
        out, start = None, 0
        for p, root in enumerate(self.case.roots):
            n = self.case.n_cells(p)
            if all((Path(root) / "constant" / f).exists() for f in "CV"):
                x = self._stored(root, n)
            else:
                x = mesh.cell_geometry(mesh.face_geometry(self.points(p), self.faces(p)), self.owner(p), self.neighbour(p))
            x = x.select((F.col("cid") + start).alias("point_id"), "x", "y", "z", "volume")
            out, start = x if out is None else out.union(x), start + n
        return out

    def _stored(self, root: str, n: int) -> DataFrame:
        def one(name: str, cols: list[str]) -> DataFrame:
            def run(batches):
                for b in batches:
                    for content in b["content"]:
                        v = parse_field(bytes(content), n)
                        yield pd.DataFrame({"cid": np.arange(len(v)), **{c: v[:, i] for i, c in enumerate(cols)}})

            kind = "cid bigint, " + ", ".join(f"{c} double" for c in cols)
            return self.spark.read.format("binaryFile").load(str(Path(root) / "constant" / name)).select("content").mapInPandas(run, kind)

        return one("C", ["x", "y", "z"]).join(one("V", ["volume"]), "cid")
