"""What every source answers: which times, which fields, where the points are, what a point weighs."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession

from tidewright.functions.checks import str_or_list
from tidewright.operators.linalg import Matrix


def local_path(path: str) -> str:
    """The path of a file as a scan reports it, without its scheme and escapes."""
    return "/" + unquote(path.split(":", 1)[-1]).lstrip("/")


def numeric(text: str) -> bool:
    """Whether a name is a time."""
    try:
        float(text)
    except ValueError:
        return False
    return True


class Source:
    """Snapshots as rows (time, field, point_id, comp, value); times keep their spelling."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    @property
    def write_times(self) -> list[str]:
        """Times as they are spelled, in numeric order."""
        raise NotImplementedError

    @property
    def field_names(self) -> dict[str, list[str]]:
        """Fields per time."""
        raise NotImplementedError

    @property
    def vertices(self) -> DataFrame:
        """point_id, x, y, z."""
        raise NotImplementedError

    @property
    def weights(self) -> DataFrame:
        """point_id, w."""
        raise NotImplementedError

    def snapshots(self, fields: list[str], times: list[str]) -> DataFrame:
        raise NotImplementedError

    def load_snapshot(self, field_name: str | list[str], time: str | list[str]) -> DataFrame:
        """Rows of the fields at the times; only what is asked for is read."""
        fields, times = str_or_list(field_name, "field_name"), str_or_list(time, "time")
        missing = set(times) - set(self.write_times)
        if missing:
            raise ValueError(f"no such time: {', '.join(sorted(missing))}")
        known = {f for names in self.field_names.values() for f in names}
        if known and set(fields) - known:
            raise ValueError(f"no such field: {', '.join(sorted(set(fields) - known))}")
        return self.snapshots(fields, times)

    def matrix(self, field_name: str, times: list[str] | None = None, comp: int = 0) -> Matrix:
        """A field's component as data matrix, times in order; all times must have the same points."""
        times = times or self.write_times
        x = self.load_snapshot(field_name, times).where(f"comp = {int(comp)}").select("point_id", "time", "value")
        return Matrix.from_long(x, "point_id", "time", "value", times=times, fill=None)
