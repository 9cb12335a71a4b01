"""The k nearest places of every place, exactly, by an index of buckets.

The index is fitted on a bounded sample; every place is put into it. A place meets its own bucket first; the
k-th distance found there bounds the ball that can hold anything nearer, and exactly the buckets that reach
into the ball are asked. Within a bucket the same kind of index, fitted on the bucket's rows, keeps the cost
per row independent of the bucket's size. Buckets of more than ``most`` rows, and of more than ``most`` rows
that ask them, are cut into parts of which each pair is a task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.nearest import Splits, nearest, search
from tidewright.session import cut

#: Rows that an index is fitted on, rows of a bucket, rows of a leaf within a task, rows of a task.
SAMPLE, LEAF, INNER, MOST = 60_000, 1200, 128, 40_000
NEAR = "array<struct<d2:double,id:bigint>>"


def vectors(p: pd.DataFrame) -> np.ndarray:
    return np.stack(p["vec"].to_numpy()).astype(np.float64)


def splits(sample: np.ndarray, n: int, leaf: int, least: int) -> Splits:
    """Median splits of the sample, so that a block holds about ``leaf`` of all ``n`` rows and ``least`` of the sample."""
    return Splits(sample, max(least, int(leaf * len(sample) / max(n, 1))))


def _lists(n: int, row: np.ndarray, ids: np.ndarray, d2: np.ndarray) -> list[list[dict]]:
    """The found rows as one list of (d2, id) per query."""
    cuts = np.searchsorted(row, np.arange(n + 1))
    pairs = list(zip(d2.tolist(), ids.tolist(), strict=True))
    return [[{"d2": d, "id": i} for d, i in pairs[a:b]] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _many(rows: DataFrame, most: int) -> dict[int, int]:
    """Parts of the buckets with more than ``most`` of the ``rows``; there are at most rows / most of them."""
    c = rows.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > most)
    return {r["bucket"]: -(-r["n"] // most) for r in c.collect()}


def _part(rows: DataFrame, parts: dict[int, int], name: str) -> DataFrame:
    """``name``: the place's part of its bucket, and ``<name>s``: how many there are."""
    if not parts:
        return rows.withColumn(name, F.lit(0)).withColumn(f"{name}s", F.lit(1))
    known = rows.sparkSession.createDataFrame(list(parts.items()), f"bucket bigint, {name}s int")
    many = F.coalesce(f"{name}s", F.lit(1))
    return rows.join(F.broadcast(known), "bucket", "left").withColumn(name, F.pmod(F.xxhash64("place"), many).cast("int")).withColumn(f"{name}s", many)


def _all(n: str) -> Column:
    return F.sequence(F.lit(0), F.col(n) - 1)


def exact_knn(places: DataFrame, k: int, fit: Callable = splits, sample: int = SAMPLE, leaf: int = LEAF, most: int = MOST) -> DataFrame:
    """place and near: its k nearest other places as (d2, id), nearest first, of equal distances the smaller id.

    ``places``: place (bigint, unique), vec; vectors are distinct. ``fit(sample, n, leaf, least)`` makes an index with
    ``bucket`` and ``probes``.
    """
    places = cut(places.select("place", "vec"))
    n = places.count()
    if n == 0:
        return places.select("place", F.lit(None).cast(NEAR).alias("near")).limit(0)
    rows = places.orderBy(F.xxhash64("place"), "place").limit(sample).select("vec").toPandas()
    least = max(8, k + 1)
    index = places.sparkSession.sparkContext.broadcast(fit(vectors(rows), n, leaf, least))

    def assign(batches):
        for p in batches:
            if len(p):
                yield p.assign(bucket=index.value.bucket(vectors(p)))

    def local(a: np.ndarray, ia: np.ndarray, b: np.ndarray, ib: np.ndarray, bound: np.ndarray | None = None):
        if len(b) <= 8 * INNER:
            return nearest(a, ia, b, ib, k, bound)
        return search(fit(b, len(b), INNER, least), a, ia, b, ib, k, bound)

    put = cut(places.mapInPandas(assign, "place bigint, vec array<double>, bucket bigint"))
    parts = _many(put, most)
    put = _part(put, parts, "part")

    def home(p: pd.DataFrame) -> pd.DataFrame:
        a, b = p[p["left"]], p[p["right"]]
        x, ids = vectors(a), a["place"].to_numpy()
        row, found, d2 = local(x, ids, vectors(b), b["place"].to_numpy())
        return pd.DataFrame({"place": ids, "vec": a["vec"].to_numpy(), "bucket": a["bucket"].to_numpy(), "near": _lists(len(a), row, found, d2)})

    own_pair = F.array(F.struct(F.col("part").alias("i"), F.col("part").alias("j"), F.lit(True).alias("left"), F.lit(True).alias("right")))
    if parts:
        others = F.filter(_all("parts"), lambda x: x != F.col("part"))
        asks = F.transform(others, lambda x: F.struct(F.col("part").alias("i"), x.alias("j"), F.lit(True).alias("left"), F.lit(False).alias("right")))
        answers = F.transform(others, lambda x: F.struct(x.alias("i"), F.col("part").alias("j"), F.lit(False).alias("left"), F.lit(True).alias("right")))
        own_pair = F.concat(own_pair, asks, answers)
    meets = put.select("place", "vec", "bucket", F.explode(own_pair).alias("t")).select("place", "vec", "bucket", "t.i", "t.j", "t.left", "t.right")
    own = meets.groupBy("bucket", "i", "j").applyInPandas(home, f"place bigint, vec array<double>, bucket bigint, near {NEAR}")
    if parts:
        own = own.groupBy("place").agg(F.first("vec").alias("vec"), F.first("bucket").alias("bucket"), F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))

    def reach(batches):
        for p in batches:
            if len(p) == 0:
                continue
            bound = np.array([v[-1]["d2"] if len(v) == k else np.inf for v in p["near"]])
            r, b = index.value.probes(vectors(p), np.sqrt(bound))
            away = b != p["bucket"].to_numpy()[r]
            r, b = r[away], b[away]
            order = np.argsort(r, kind="stable")
            r, b = r[order], b[order]
            cuts = np.searchsorted(r, np.arange(len(p) + 1))
            yield pd.DataFrame({"place": p["place"], "vec": p["vec"], "most": bound, "near": p["near"], "probes": [b[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]})

    own = cut(own.mapInPandas(reach, f"place bigint, vec array<double>, most double, near {NEAR}, probes array<bigint>"))
    asked = own.select(F.explode("probes").alias("bucket"), "place", "vec", "most")
    crowds = _many(asked, most)
    queries = _part(asked, crowds, "crowd")
    queries = _with(queries, parts, "parts").select("bucket", "crowd", F.explode(_all("parts")).alias("part"), "place", "vec", "most")
    answers = _with(put.select("bucket", "part", "place", "vec"), crowds, "crowds").select("bucket", F.explode(_all("crowds")).alias("crowd"), "part", "place", "vec")

    def probe(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if len(q) == 0 or len(p) == 0:
            return pd.DataFrame({"place": np.zeros(0, np.int64), "near": pd.Series([], dtype=object)})
        bound = q["most"].to_numpy()
        row, found, d2 = local(vectors(q), q["place"].to_numpy(), vectors(p), p["place"].to_numpy(), np.where(np.isinf(bound), bound, bound * (1 + 1e-12)))
        return pd.DataFrame({"place": q["place"], "near": _lists(len(q), row, found, d2)})

    key = ["bucket", "crowd", "part"]
    more = queries.groupBy(*key).cogroup(answers.groupBy(*key)).applyInPandas(probe, f"place bigint, near {NEAR}").where(F.size("near") > 0)
    both = own.select("place", "near").union(more)
    return both.groupBy("place").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))


def _with(rows: DataFrame, parts: dict[int, int], name: str) -> DataFrame:
    """``name``: into how many parts the row's bucket is cut."""
    if not parts:
        return rows.withColumn(name, F.lit(1))
    known = rows.sparkSession.createDataFrame(list(parts.items()), "bucket bigint, _n int")
    return rows.join(F.broadcast(known), "bucket", "left").withColumn(name, F.coalesce("_n", F.lit(1))).drop("_n")
