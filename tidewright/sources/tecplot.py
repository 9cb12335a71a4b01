"""Tecplot snapshots: ASCII point files directly, other files through an external program.

The program is run once for a batch of files. Both sides share a job folder: it holds the list of files and of
what is wanted of each, and afterwards the arrays as ``.npy`` files with an index (see ``tecplot_worker``).
"""

from __future__ import annotations

import json
import os
import re
import shutil
import subprocess
import tempfile
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.sources.base import Source, numeric

WORKER = Path(__file__).with_name("tecplot_worker.py")
#: Files that one run of the program reads.
BATCH = 16


class ReaderError(RuntimeError):
    """The program failed or left no result."""


def resolve_reader(program: str | None = None) -> str:
    """The program: the argument, the setting TIDEWRIGHT_TECPLOT_READER, or pvpython on the path."""
    found = shutil.which(str(program or os.environ.get("TIDEWRIGHT_TECPLOT_READER", "pvpython")))
    if found is None:
        raise FileNotFoundError("no program that reads Tecplot files was found")
    return found


def convert(command: list[str], files: list[str], fields: list[str] | None = None, zone: str | None = None, seconds: float = 900.0) -> list[dict]:
    """Of each file: ``names`` (zone -> variables) and, if ``fields`` are given, ``data`` (zone -> variable -> array).

    ``command`` gets the job folder as its last argument. The folder lives beside the task, for as long as the
    program runs; arrays are in memory when this returns.
    """
    with tempfile.TemporaryDirectory(prefix="tidewright-tecplot-") as folder:
        job = [{"path": f, "zone": zone, "fields": fields or []} for f in files]
        (Path(folder) / "job.json").write_text(json.dumps(job))
        try:
            done = subprocess.run([*command, folder], stdin=subprocess.DEVNULL, capture_output=True, timeout=seconds, check=False)
        except subprocess.TimeoutExpired as e:
            raise ReaderError(f"the reader took more than {seconds:g} s") from e
        if done.returncode:
            raise ReaderError(f"the reader ended with {done.returncode}: {done.stderr.decode(errors='replace')[-2000:]}")
        out = []
        for k, name in enumerate(files):
            index = Path(folder) / f"{k}.json"
            if not index.exists():
                raise ReaderError(f"the reader left no result for {name}")
            found = json.loads(index.read_text())
            data = {z: {f: np.load(Path(folder) / a) for f, a in arrays.items()} for z, arrays in found["arrays"].items()}
            out.append({"names": found["names"], "data": data})
        return out


def parse_ascii(text: str) -> dict[str, dict[str, np.ndarray]]:
    """Zone -> variable -> values, of zones in POINT format."""
    names = re.findall(r'"([^"]*)"', re.search(r"VARIABLES\s*=(.*?)(?=\n\s*ZONE|\Z)", text, re.S | re.I)[1])
    out: dict[str, dict[str, np.ndarray]] = {}
    for i, part in enumerate(re.split(r"(?mi)^\s*ZONE\b", text)[1:]):
        head, *rest = part.split("\n")
        title = re.search(r'T\s*=\s*"([^"]*)"', head)
        rows = np.array(" ".join(x for x in rest if x.strip() and not x.lstrip().startswith("#")).split(), np.float64)
        out[title[1].strip() if title else f"zone{i}"] = dict(zip(names, rows.reshape(-1, len(names)).T, strict=True))
    return out


class TecplotSource(Source):
    """Files <base>i=<iteration>...t=<time><suffix>. ASCII files are parsed by the executors; with ``reader`` (for
    example ``[resolve_reader(), str(WORKER)]``) each task hands its files to the external program."""

    def __init__(self, spark: SparkSession, path: str, base_name: str = "", suffix: str = ".plt", reader: list[str] | None = None):
        super().__init__(spark)
        self.reader = reader
        found = {p.name.split("t=")[-1].removesuffix(suffix): str(p) for p in Path(path).glob(f"{base_name}i=*t=*")}
        self.file_names = {t: found[t] for t in sorted((t for t in found if numeric(t)), key=float)}
        if not self.file_names:
            raise FileNotFoundError(f"no solution files in {path}")

    @property
    def write_times(self) -> list[str]:
        return list(self.file_names)

    def _zones(self) -> dict[str, list[str]]:
        f = self.file_names[self.write_times[0]]
        if self.reader:
            return convert(self.reader, [f])[0]["names"]
        return {z: list(v) for z, v in parse_ascii(Path(f).read_text()).items()}

    @property
    def zone_names(self) -> list[str]:
        return list(self._zones())

    @property
    def field_names(self) -> dict[str, list[str]]:
        first = next(iter(self._zones().values()))
        return {self.write_times[0]: [f for f in first if f.upper() not in ("X", "Y", "Z")]}

    def _rows(self, times: list[str], fields: list[str], zone: str | None) -> DataFrame:
        """One row per point: time, zone, point_id and the fields as an array."""
        command = self.reader
        files = self.spark.createDataFrame([(t, self.file_names[t]) for t in times], "time string, path string").repartition(max(1, len(times)))

        def run(batches):
            for b in batches:
                paths = b["path"].tolist()
                for n in range(0, len(paths), BATCH):
                    own = paths[n : n + BATCH]
                    if command:
                        parsed = [r["data"] for r in convert(command, own, fields, zone)]
                    else:
                        parsed = [{z: v for z, v in parse_ascii(Path(p).read_text()).items() if zone in (None, z)} for p in own]
                    for t, z, v in ((t, z, v) for t, zones in zip(b["time"].tolist()[n : n + BATCH], parsed, strict=True) for z, v in zones.items()):
                        x = np.stack([v[f] for f in fields], axis=1)
                        yield pd.DataFrame({"time": t, "zone": z, "point_id": np.arange(len(x)), "v": list(x)})

        return files.mapInPandas(run, "time string, zone string, point_id bigint, v array<double>")

    def snapshots(self, fields: list[str], times: list[str], zone: str | None = None) -> DataFrame:
        pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col("v")[i].alias("value")) for i, f in enumerate(fields))))
        return self._rows(times, fields, zone).select("time", "zone", "point_id", pairs.alias("p")).select("time", "zone", "p.field", "point_id", F.lit(0).alias("comp"), "p.value")

    @property
    def vertices(self) -> DataFrame:
        first = next(iter(self._zones().values()))
        names = [f for f in first if f.upper() in ("X", "Y", "Z")]
        x = self._rows(self.write_times[:1], names, None)
        return x.select("zone", "point_id", *(F.col("v")[i].alias(n.lower()) for i, n in enumerate(names)))

    @property
    def weights(self) -> DataFrame:
        return self.vertices.select("zone", "point_id", F.lit(1.0).alias("w"))
