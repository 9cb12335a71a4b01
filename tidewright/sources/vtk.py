"""Point data of unstructured VTK files: legacy ASCII or binary (.vtk) and XML with ASCII or base64 data (.vtu)."""

from __future__ import annotations

import base64
import re
import struct
import zlib
from collections.abc import Iterator
from pathlib import Path
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tidewright.sources.base import Source, local_path, numeric

#: Number types of the two formats.
LEGACY = {"float": ">f4", "double": ">f8", "int": ">i4", "long": ">i8", "vtktypeint64": ">i8", "unsigned_char": ">u1", "short": ">i2"}
XML = {"Float32": "<f4", "Float64": "<f8", "Int32": "<i4", "Int64": "<i8", "UInt8": "<u1", "UInt32": "<u4", "UInt64": "<u8"}


def parse_legacy(data: bytes) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Points (n x 3) and point data (n x components) of a legacy file."""
    binary = data.split(b"\n", 3)[2].strip().upper() == b"BINARY"
    points, fields, at, n_points, inside = np.zeros((0, 3)), {}, 0, 0, False

    def take(n: int, kind: str) -> np.ndarray:
        nonlocal at
        if binary:
            v = np.frombuffer(data, LEGACY[kind.lower()], n, at).astype(np.float64)
            at += n * np.dtype(LEGACY[kind.lower()]).itemsize
            return v
        out: list[bytes] = []
        while len(out) < n:
            out += line().split()
        return np.array(out[:n], np.float64)

    def line() -> bytes:
        nonlocal at
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        text, at = data[at:end], end + 1
        return text

    while at < len(data):
        w = line().split()
        key = w[0].upper() if w else b""
        if key == b"POINTS":
            n_points = int(w[1])
            points = take(3 * n_points, w[2].decode()).reshape(-1, 3)
        elif key in (b"CELLS", b"CELL_TYPES") and binary:
            at += 4 * (int(w[2]) if key == b"CELLS" else int(w[1]))
        elif key == b"POINT_DATA":
            inside = True
        elif key == b"CELL_DATA":
            inside = False
        elif inside and key == b"SCALARS":
            c = int(w[3]) if len(w) > 3 else 1
            line()  # lookup table
            fields[w[1].decode()] = take(n_points * c, w[2].decode()).reshape(-1, c)
        elif inside and key in (b"VECTORS", b"NORMALS", b"TENSORS"):
            c = 9 if key == b"TENSORS" else 3
            fields[w[1].decode()] = take(n_points * c, w[2].decode()).reshape(-1, c)
        elif inside and key == b"FIELD":
            for _ in range(int(w[2])):
                d = line().split()
                while not d:
                    d = line().split()
                c, m = int(d[1]), int(d[2])
                fields[d[0].decode()] = take(c * m, d[3].decode()).reshape(-1, c)
    return points, fields


def parse_xml(data: bytes) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Points and point data of an XML file with inline or appended base64 or ASCII data."""
    raw = re.search(rb'<AppendedData[^>]*encoding="raw"[^>]*>\s*_', data)
    blob = None
    if raw:
        end = data.rindex(b"</AppendedData>")
        blob, data = data[raw.end() : end], data[: raw.end() - 1] + data[end:]
    root = ElementTree.fromstring(data)
    head = "<u8" if root.get("header_type") == "UInt64" else "<u4"
    size = np.dtype(head).itemsize
    packed = root.get("compressor") is not None
    appended = root.find("AppendedData")
    text = "".join(appended.text.split())[1:] if appended is not None and blob is None else ""

    def decode(read) -> bytes:
        if not packed:
            n = int(np.frombuffer(read(0, size), head)[0])
            return read(0, size + n)[size:]
        n = int(np.frombuffer(read(0, size), head)[0])
        sizes = np.frombuffer(read(0, size * (3 + n)), head)[3:]
        body = read(size * (3 + n), int(sizes.sum()), True)
        cuts = np.concatenate([[0], np.cumsum(sizes)]).astype(int)
        return b"".join(zlib.decompress(body[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True))

    def array(e) -> np.ndarray:
        c = int(e.get("NumberOfComponents") or 1)
        form = e.get("format", "ascii")
        if form == "ascii":
            v = np.array((e.text or "").split(), np.float64)
        else:
            if form == "appended" and blob is not None:
                start = int(e.get("offset"))
                v = decode(lambda a, n, second=False: blob[start + a : start + a + n])
            else:
                s = "".join((e.text or "").split()) if form == "binary" else text[int(e.get("offset")) :]

                def read(a: int, n: int, second: bool = False) -> bytes:
                    # With compression the header and the data are two base64 strings; each ends at full groups.
                    skip = -(-a // 3) * 4 if second else 0
                    return base64.b64decode(s[skip : skip + -(-n // 3) * 4])[:n]

                v = decode(read)
            v = np.frombuffer(v, XML[e.get("type")]).astype(np.float64)
        return v.reshape(-1, c)

    points, fields = [], {}
    for piece in root.iter("Piece"):
        points.append(array(piece.find("Points/DataArray")))
        for e in piece.findall("PointData/DataArray"):
            fields.setdefault(e.get("Name"), []).append(array(e))
    return np.concatenate(points), {k: np.concatenate(v) for k, v in fields.items()}


def parse(name: str, data: bytes) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    return parse_xml(data) if name.endswith(".vtu") or data.lstrip()[:1] == b"<" else parse_legacy(data)


class VtkSource(Source):
    """Files <prefix><time><suffix>, one per time."""

    def __init__(self, spark: SparkSession, path: str, prefix: str = "", suffix: str = ".vtk", reader=parse):
        super().__init__(spark)
        self.path, self.prefix, self.suffix, self.reader = path, prefix, suffix, reader

    @classmethod
    def from_flexi(cls, spark: SparkSession, path: str, prefix: str = "", suffix: str = ".000000000.vtu") -> VtkSource:
        return cls(spark, path, prefix, suffix)

    @classmethod
    def from_su2(cls, spark: SparkSession, path: str, prefix: str = "", suffix: str = ".vtk") -> VtkSource:
        return cls(spark, path, prefix, suffix)

    def files(self) -> dict[str, str]:
        found = {p.name[len(self.prefix) : len(p.name) - len(self.suffix)]: str(p) for p in Path(self.path).glob(f"{self.prefix}*{self.suffix}")}
        return {t: f for t, f in found.items() if numeric(t)}

    @property
    def write_times(self) -> list[str]:
        return sorted(self.files(), key=float)

    def _first(self) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        f = self.files()[self.write_times[0]]
        return self.reader(f, Path(f).read_bytes())

    @property
    def field_names(self) -> dict[str, list[str]]:
        return {self.write_times[0]: list(self._first()[1])}

    def snapshots(self, fields: list[str], times: list[str]) -> DataFrame:
        files = [f for t, f in self.files().items() if t in times]
        reader, before, after = self.reader, len(self.prefix), len(self.suffix)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for path, content in zip(b["path"], b["content"], strict=True):
                    name = local_path(path)
                    base = name.rsplit("/", 1)[-1]
                    time = base[before : len(base) - after]
                    _, data = reader(name, bytes(content))
                    for f in fields:
                        k, c = data[f].shape
                        yield pd.DataFrame({"time": time, "field": f, "point_id": np.repeat(np.arange(k), c), "comp": np.tile(np.arange(c), k), "value": data[f].ravel()})

        return self.spark.read.format("binaryFile").load(files).select("path", "content").mapInPandas(run, "time string, field string, point_id bigint, comp int, value double")

    @property
    def vertices(self) -> DataFrame:
        reader = self.reader

        def run(batches):
            for b in batches:
                for path, content in zip(b["path"], b["content"], strict=True):
                    p, _ = reader(path, bytes(content))
                    yield pd.DataFrame({"point_id": np.arange(len(p)), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]})

        return self.spark.read.format("binaryFile").load(self.files()[self.write_times[0]]).select("path", "content").mapInPandas(run, "point_id bigint, x double, y double, z double")

    @property
    def weights(self) -> DataFrame:
        raise NotImplementedError("VTK files hold no weights")


def pack(values: np.ndarray) -> str:
    """An array as inline base64 of an XML file (for writers and tests)."""
    b = values.tobytes()
    return base64.b64encode(struct.pack("<I", len(b)) + b).decode()
