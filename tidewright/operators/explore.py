"""Figures of image series as plain descriptions (dictionaries), from aggregates made by the cluster.

Any plotting package can draw them: a surface with coordinates, one frame per time, colour limits and the
aspect ratio. The pixels are thinned before they reach the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tidewright.operators.select import every as strided


class Explorer:
    """Views of one zoned image source."""

    def __init__(self, source):
        self.source = source

    def _surface(self, zone: str, every: int) -> dict:
        c = self.source.vertices.where(f"zone = '{zone}'").select("i", "j", "x", "y", "z")
        return self._grid(strided(c, ["i", "j"], every), ["x", "y", "z"])

    @staticmethod
    def _grid(rows: DataFrame, columns: list[str]) -> dict:
        return Explorer._laid_out(rows.toPandas(), columns)

    @staticmethod
    def _laid_out(p: pd.DataFrame, columns: list[str]) -> dict:
        i, j = (np.unique(p[k], return_inverse=True)[1] for k in ("i", "j"))
        out = {}
        for c in columns:
            if len(p) == 0:
                out[c] = []
                continue
            a = np.full((i.max() + 1, j.max() + 1), np.nan)
            a[i, j] = p[c]
            out[c] = a.tolist()
        return out

    def _figure(self, zone: str, frames: dict[str, DataFrame], column: str, every: int, width: int, limits: tuple[float, float]) -> dict:
        data = [{"time": t, "color": self._grid(strided(f, ["i", "j"], every), [column])[column]} for t, f in frames.items()]
        return {"surface": self._surface(zone, every), "frames": data, "limits": limits, "width": width, "aspect": self.source.aspect_ratio(zone)}

    def interact(self, zone: str, times: list[str], mask: str | None = None, every: int = 5, width: int = 1024, limits: tuple[float, float] = (-2.0, 0.5)) -> dict:
        """One frame per time, of one pass over the images."""
        index = {t: self.source.index(t, zone) for t in times}
        pixels = strided(self.source.images(zone, times, mask), ["i", "j"], every).toPandas()
        frames = [{"time": t, "color": self._laid_out(pixels[pixels["t_idx"] == k], ["cp"])["cp"]} for t, k in index.items()]
        return {"surface": self._surface(zone, every), "frames": frames, "limits": limits, "width": width, "aspect": self.source.aspect_ratio(zone)}

    def mean(self, zone: str, times: list[str] | None = None, mask: str | None = None, every: int = 5, width: int = 1024, limits: tuple[float, float] = (-2.0, 0.5)) -> dict:
        return self._figure(zone, {"mean": self.source.statistics(zone, times, mask)}, "mean", every, width, limits)

    def std(self, zone: str, times: list[str] | None = None, mask: str | None = None, every: int = 5, width: int = 1024, limits: tuple[float, float] = (0.0, 0.5)) -> dict:
        return self._figure(zone, {"std": self.source.statistics(zone, times, mask)}, "std", every, width, limits)
