"""Session set-up and the few engine-wide helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = Path(__file__).resolve().parent


def session(cores: int | str = "*", shuffle: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that the operators expect (UTC, AQE, Arrow)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidewright")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Make the package importable in the Python workers, where neither the path nor the folder does so."""
    root = str(PACKAGE.parent)
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or os.getcwd() == root:
        return
    sc = spark.sparkContext
    if getattr(sc, "_tidewright_shipped", False):
        return
    out = Path(tempfile.mkdtemp(prefix="tidewright-")) / "tidewright.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(PACKAGE.parent))
    sc.addPyFile(str(out))
    sc._tidewright_shipped = True


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read again: its lineage ends there.

    The folder is the cluster's ``spark.checkpoint.dir``. Only a session without one, on one machine,
    gets a folder of its own; anywhere else that is an error.
    """
    _checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def _checkpoints(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if where is None:
            if not (sc.master or "").startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            where = tempfile.mkdtemp(prefix="tidewright-checkpoint-")
        sc.setCheckpointDir(where)


def drop(df: DataFrame) -> None:
    """Delete the checkpoint files of a ``cut`` that nothing refers to any more; only for results superseded by another
    ``cut``, and only where they can be told for certain."""
    plan = df._jdf.queryExecution().logical()
    if plan.getClass().getSimpleName() != "LogicalRDD":
        return
    file = plan.rdd().getCheckpointFile()
    if file.isDefined():
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def folder_for(path: str) -> Path:
    """A shared folder that all executors have mounted; other file systems are refused rather than misread."""
    scheme, _, rest = path.rpartition(":")
    if scheme not in ("", "file"):
        raise ValueError(f"{path}: only folders that the executors have mounted can be written file by file")
    return Path("/" + rest.lstrip("/")) if scheme else Path(path)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that the cluster shares (``spark.checkpoint.dir``)."""
    _checkpoints(spark)
    out = folder_for(spark.sparkContext.getCheckpointDir()) / f"{name}-{uuid.uuid4().hex}"
    out.mkdir(parents=True)
    return str(out)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table as it was read, in at least as many partitions as the cluster has cores.

    A few files with much work per row would else keep a few tasks busy; larger tables are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def once(df: DataFrame, key: str) -> DataFrame:
    """Rows of one id count once; repeated rows hold equal values, so any of them will do.

    A row without an id repeats none: every such row stays.
    """
    own = F.when(F.col(key).isNull(), F.monotonically_increasing_id())
    return df.withColumn("_own", own).dropDuplicates([key, "_own"]).drop("_own")


def parts(df: DataFrame, factor: int = 1) -> int:
    """Shuffle partitions of the session, for the explicit repartitions."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) * factor)


def ranked(df: DataFrame, keys: list[str], order: list[str], block: str, name: str = "rank") -> DataFrame:
    """``df`` with the 0-based position of each row within ``keys``, ordered by (``block``, ``order``).

    ``block`` is a column that grows with the order, so that no task sorts a whole key: positions are
    counted within (keys, block), and the blocks' sizes, one row per block, are summed before it.
    """
    from pyspark.sql import Window as W

    sizes = df.groupBy(*keys, block).agg(F.count("*").alias("_n"))
    before = W.partitionBy(*keys).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(*keys, block, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    local = F.row_number().over(W.partitionBy(*keys, block).orderBy(*order)) - 1
    return df.withColumn("_local", local).join(starts, [*keys, block]).withColumn(name, F.col("_start") + F.col("_local")).drop("_start", "_local")


#: Rows of a stretch, about, where a key's order is cut.
STRETCH = 1_000_000


def stretched(df: DataFrame, order: str, target: int = STRETCH) -> tuple[DataFrame, int]:
    """``df`` with ``_b``, which grows with ``order`` and cuts all rows into stretches of about ``target`` rows, and how many there are.

    Numbers, dates and times are cut into equal widths between their least and their largest value; a null comes
    first. Other orders, and small tables, are one stretch.
    """
    kind = dict(df.dtypes)[order]
    number = F.unix_micros(F.col(order).cast("timestamp")) if kind in ("date", "timestamp", "timestamp_ntz") else F.col(order)
    if kind.split("(")[0] not in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "date", "timestamp", "timestamp_ntz"):
        return df.withColumn("_b", F.lit(0)), 1
    x = number.cast("double")
    r = df.agg(F.count("*").alias("n"), F.min(x).alias("a"), F.max(x).alias("b")).first()
    parts = -(-r["n"] // target)
    if parts < 2 or r["a"] is None or not r["b"] > r["a"]:
        return df.withColumn("_b", F.lit(0)), 1
    at = F.floor((x - F.lit(r["a"])) / F.lit((r["b"] - r["a"]) / parts))
    return df.withColumn("_b", F.coalesce(F.least(F.greatest(at, F.lit(0)), F.lit(parts - 1)), F.lit(-1)).cast("int")), parts


def positions(df: DataFrame, keys: list[str], order: list[str], name: str = "_pos", target: int = STRETCH) -> DataFrame:
    """``df`` with the 0-based position of each row within ``keys``; null keys are a key of their own.

    No task orders more than a stretch of a key (see :func:`stretched`); ties of the first order column stay together.
    """
    from pyspark.sql import Window as W

    x, parts_ = stretched(df, order[0], target)
    if parts_ == 1:
        return x.drop("_b").withColumn(name, (F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1).cast("bigint"))
    safe = [f"_k{i}" for i in range(len(keys))]
    x = x.select("*", *(F.struct(k).alias(s) for k, s in zip(keys, safe, strict=True)))  # a struct of a null is no null: keys join
    return ranked(x, safe, order, "_b", name).drop("_b", *safe).withColumn(name, F.col(name).cast("bigint"))


def with_neighbours(df: DataFrame, position: str, before: int = 0, after: int = 0, block: int = STRETCH) -> DataFrame:
    """``df`` cut into blocks ``_block`` of positions; each block also gets the ``before`` rows before and ``after`` rows
    after it, with ``_own`` false. Windows over (keys, _block) then see all they need of a key, and no task all of it."""
    if max(before, after) >= block:
        raise ValueError("a window must be smaller than a block")
    b, at = F.floor(F.col(position) / block), F.pmod(F.col(position), F.lit(block))
    place = lambda c, own: F.struct(c.alias("b"), F.lit(own).alias("own"))
    places = F.array_compact(F.array(place(b, True), F.when((at < after) & (b > 0), place(b - 1, False)), F.when(at >= block - before, place(b + 1, False)) if before else F.lit(None)))
    x = df.withColumn("_p", F.explode(places))
    return x.withColumn("_block", F.col("_p.b")).withColumn("_own", F.col("_p.own")).drop("_p")
