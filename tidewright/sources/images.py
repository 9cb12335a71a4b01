"""Grey-value images as snapshots: PGM (P2, P5) and uncompressed grey TIFF of 8 or 16 bits."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tidewright.sources.base import Source, local_path, numeric


def parse_pgm(data: bytes) -> np.ndarray:
    words, at = [], 0
    while len(words) < 4:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1
            continue
        end = at
        while not data[end : end + 1].isspace():
            end += 1
        words.append(data[at:end])
        at = end
    w, h, most = (int(x) for x in words[1:])
    kind = np.uint8 if most < 256 else np.uint16
    if words[0] == b"P2":
        return np.array(data[at:].split(), kind).reshape(h, w)
    return np.frombuffer(data, kind if kind == np.uint8 else ">u2", w * h, at + 1).astype(kind).reshape(h, w)


def parse_tiff(data: bytes) -> np.ndarray:
    order = "<" if data[:2] == b"II" else ">"
    at = struct.unpack_from(order + "I", data, 4)[0]
    tags = {}
    sizes = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4)}
    for i in range(struct.unpack_from(order + "H", data, at)[0]):
        tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        if kind in sizes:
            code, size = sizes[kind]
            where = at + 2 + 12 * i + 8
            if n * size > 4:
                where = struct.unpack_from(order + "I", data, where)[0]
            tags[tag] = struct.unpack_from(f"{order}{n}{code}", data, where)
    if tags.get(259, (1,))[0] != 1 or tags.get(277, (1,))[0] != 1:
        raise ValueError("only uncompressed images of one channel are supported")
    w, h, bits = tags[256][0], tags[257][0], tags.get(258, (8,))[0]
    raw = b"".join(data[o : o + n] for o, n in zip(tags[273], tags[279], strict=True))
    return np.frombuffer(raw, {8: "u1", 16: order + "u2", 32: order + "u4"}[bits], w * h).reshape(h, w)


def scaled(image: np.ndarray) -> np.ndarray:
    """Grey values of 8 and 16 bits to [0, 1]; others as they are."""
    if image.dtype.itemsize == 1:
        return image / 255.0
    return image / 65535.0 if image.dtype.itemsize == 2 else image.astype(np.float64)


def parse_image(data: bytes) -> np.ndarray:
    return scaled(parse_tiff(data) if data[:2] in (b"II", b"MM") else parse_pgm(data))


class ImageSource(Source):
    """Files <prefix><time><suffix>; a pixel's point_id is row * width + column."""

    def __init__(self, spark: SparkSession, path: str, prefix: str = "", suffix: str = ".tif"):
        super().__init__(spark)
        self.path, self.prefix, self.suffix = path, prefix, suffix

    def files(self) -> dict[str, str]:
        found = {p.name[len(self.prefix) : len(p.name) - len(self.suffix)]: str(p) for p in Path(self.path).glob(f"{self.prefix}*{self.suffix}")}
        return {t: f for t, f in found.items() if numeric(t)}

    @property
    def write_times(self) -> list[str]:
        return sorted(self.files(), key=float)

    @property
    def field_names(self) -> dict[str, list[str]]:
        raise NotImplementedError("images have no fields")

    @property
    def vertices(self) -> DataFrame:
        raise NotImplementedError("images have no vertices")

    @property
    def weights(self) -> DataFrame:
        raise NotImplementedError("images have no weights")

    def load_snapshot(self, field_name: str | list[str], time: str | list[str] | None = None) -> DataFrame:
        """time, point_id, i, j, value; the times may also be given as the first argument."""
        times = field_name if time is None else time
        times = [times] if isinstance(times, str) else list(times)
        known = self.files()
        files = [known[t] for t in times]
        before, after = len(self.prefix), len(self.suffix)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for path, content in zip(b["path"], b["content"], strict=True):
                    v = parse_image(bytes(content))
                    i, j = np.indices(v.shape)
                    name = local_path(path).rsplit("/", 1)[-1]
                    yield pd.DataFrame({"time": name[before : len(name) - after], "point_id": np.arange(v.size), "i": i.ravel(), "j": j.ravel(), "value": v.ravel()})

        return self.spark.read.format("binaryFile").load(files).select("path", "content").mapInPandas(run, "time string, point_id bigint, i int, j int, value double")
