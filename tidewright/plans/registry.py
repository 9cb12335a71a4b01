"""All core queries by name, and their SQL forms."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tidewright.plans import cases, decompositions, prepared, snapshots
from tidewright.session import ship

Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP = "svd_spectrum"
MODULES = (snapshots, decompositions, cases, prepared)


def shipped(own: dict[str, Query]) -> dict[str, Query]:
    """The queries, each of which first makes sure that the Python workers can import the package."""

    def wrap(f: Query) -> Query:
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        return run

    return {name: wrap(f) for name, f in own.items()}


def queries() -> dict[str, Query]:
    return shipped({name: f for m in MODULES for name, f in m.QUERIES.items()})


def sql() -> dict[str, str]:
    return {name: text for m in MODULES for name, text in m.SQL.items()}
