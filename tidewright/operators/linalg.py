"""Data matrices as DataFrames, and what is computed from them by distributed passes.

A :class:`Matrix` is a DataFrame of rows (``row_id``, ``re`` array<double>, and ``im`` if complex) with the
time as position in the arrays. Two passes do all the work: ``gram`` reduces the rows to an N x N matrix
(N times), and ``lift`` multiplies every row by an N x r matrix. Only N x N and N x r numbers are ever on
the driver. N x N matrices are formed up to ``MOST`` columns (or rows, where these are fewer); a matrix that is
larger in both directions is decomposed by subspace iteration, which needs N x r numbers only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import dense
from tidewright.functions.checks import format_byte_size

#: Largest number of columns (or rows, where these are fewer) whose Gram matrix is formed on the driver.
MOST = 8192
#: Most partial sums of a reduction, and most bytes of them beyond one per core: more input partitions are read
#: by one task after another, so that what is shuffled does not grow with the rows.
PARTIALS, PARTIAL_BYTES = 4096, 1 << 36
#: Numbers of a block that a task forms at once.
NUMBERS = 4_000_000


def _block(p: pd.DataFrame) -> np.ndarray:
    x = np.stack(p["re"].to_numpy()).astype(np.float64)
    return x + 1j * np.stack(p["im"].to_numpy()) if "im" in p.columns else x


def _scattered(cells: pa.Array, n: int, fill: float) -> Iterator[tuple[int, np.ndarray]]:
    """Blocks of dense rows, each with the position of its first, from one list of (k, v) per row; linear in the numbers held."""
    size = np.asarray(pc.list_value_length(cells))
    flat = cells.flatten()
    k, v = np.asarray(flat.field("_k")), np.asarray(pc.fill_null(flat.field("_v"), fill))
    end = np.cumsum(size)
    step = max(1, NUMBERS // n)
    for lo in range(0, len(size), step):
        own = size[lo : lo + step]
        a, b = (end[lo - 1] if lo else 0), end[lo + len(own) - 1]
        out = np.full(len(own) * n, fill)
        at = np.repeat(np.arange(len(own)), own) * n + k[a:b]
        if len(at) > len(out) or len(np.unique(at)) < len(at):
            raise ValueError("a point has several values at one time")
        out[at] = v[a:b]
        yield lo, out.reshape(-1, n)


class Matrix:
    """A data matrix whose rows are points and whose columns are times."""

    def __init__(self, df: DataFrame | None, n: int, complex_: bool | None = None, cells: DataFrame | None = None, fill: float = 0.0):
        """``cells`` (row_id, _c: list of (k, v)) may stand for ``df``: passes then make their own dense blocks."""
        self.complex = bool(complex_) if df is None else "im" in df.columns if complex_ is None else complex_
        self._df = None if df is None else df.select("row_id", "re", *(["im"] if self.complex else []))
        self._cells, self._fill = cells, fill
        self.n = n
        self._rows: int | None = None
        self._gram: np.ndarray | None = None

    @property
    def spark(self) -> SparkSession:
        return (self._cells if self._df is None else self._df).sparkSession

    @property
    def df(self) -> DataFrame:
        """row_id, re (and im): one dense row per point."""
        if self._df is None:
            self._df = self._each(lambda x: x, False)
        return self._df

    def _each(self, fn: Callable[[np.ndarray], np.ndarray], complex_: bool) -> DataFrame:
        """Rows of ``fn`` of each block of rows."""
        if self._cells is None:

            def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for p in batches:
                    if len(p):
                        y = fn(_block(p))
                        out = {"row_id": p["row_id"], "re": list(np.ascontiguousarray(y.real, float))}
                        if complex_:
                            out["im"] = list(np.ascontiguousarray(y.imag, float))
                        yield pd.DataFrame(out)

            kind = f"row_id {dict(self.df.dtypes)['row_id']}, re array<double>" + (", im array<double>" if complex_ else "")
            return self.df.mapInPandas(run, kind)
        n, fill = self.n, self._fill
        lists = lambda y: pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1]), pa.array(np.ascontiguousarray(y, np.float64).ravel()))

        def fused(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lo, x in _scattered(b.column("_c"), n, fill):
                    y = fn(x)
                    cols = [b.column("row_id").slice(lo, len(x)), lists(y.real), *([lists(y.imag)] if complex_ else [])]
                    yield pa.RecordBatch.from_arrays(cols, names=["row_id", "re", "im"][: len(cols)])

        kind = f"row_id {dict(self._cells.dtypes)['row_id']}, re array<double>" + (", im array<double>" if complex_ else "")
        return self._cells.mapInArrow(fused, kind)

    @classmethod
    def from_long(cls, df: DataFrame, row: str, time: str, value: str, times: list | range | None = None, fill: float | None = 0.0) -> Matrix:
        """From one row per (point, time); places without a value are ``fill``, or an error if that is None.

        The times are few (columns of the matrix) and are listed first, so that each row finds its place by
        position and no sort is needed. Rows without a time take no part; a time that ``times`` lacks is an
        error when the matrix is computed.
        """
        listed = times is not None
        if not listed:
            found = df.select(time).where(F.col(time).isNotNull()).distinct().orderBy(time).limit(MOST + 1).collect()
            times = [r[0] for r in found]
        if not times:
            raise ValueError("there are no times")
        if len(times) > MOST:
            raise ValueError(f"more than {MOST} times")
        spark = df.sparkSession
        at = spark.createDataFrame(list(enumerate(times)), f"_k int, {time} {dict(df.dtypes)[time]}")
        x = df.select(F.col(row).alias("row_id"), F.col(time), F.col(value).cast("double").alias("_v"))
        if listed:
            unknown = F.raise_error(F.concat(F.lit("a time that is not listed: "), F.col(time).cast("string")))
            x = x.where(F.col(time).isNotNull()).join(F.broadcast(at), time, "left").withColumn("_k", F.when(F.col("_k").isNull(), unknown.cast("int")).otherwise(F.col("_k")))
        else:
            x = x.join(F.broadcast(at), time)
        one = x.groupBy("row_id").agg(F.collect_list(F.struct("_k", "_v")).alias("_c"))
        if fill is None:
            short = one.where(F.size("_c") != len(times)).limit(1).count()
            if short:
                raise ValueError("snapshots differ in shape: some points lack a time")
        return cls(None, len(times), False, one, 0.0 if fill is None else float(fill))

    @classmethod
    def from_numpy(cls, spark: SparkSession, x: np.ndarray) -> Matrix:
        """From a small local array."""
        if x.ndim != 2:
            raise ValueError("a data matrix has two dimensions")
        columns = [x.real] + ([x.imag] if np.iscomplexobj(x) else [])
        kind = "row_id bigint, re array<double>" + (", im array<double>" if np.iscomplexobj(x) else "")
        # Plain Python numbers: a session without Arrow takes no others.
        rows = [(i, *values) for i, values in enumerate(zip(*(c.astype(float).tolist() for c in columns), strict=True))]
        return cls(spark.createDataFrame(rows, kind), x.shape[1])

    def numpy(self, most: int = 4_000_000) -> np.ndarray:
        """The whole matrix as a local array in order of row_id; refused beyond ``most`` numbers."""
        if self.rows * self.n > most:
            raise ValueError(f"{self.rows} x {self.n} numbers are too many for the driver")
        return _block(self.df.orderBy("row_id").toPandas())

    @property
    def rows(self) -> int:
        if self._rows is None:
            self._rows = (self._cells if self._df is None else self._df).count()
        return self._rows

    # passes over the rows

    def map_rows(self, fn: Callable[[np.ndarray], np.ndarray], n: int, complex_: bool) -> Matrix:
        """A matrix whose blocks of rows are ``fn`` of this one's."""
        return Matrix(self._each(fn, complex_), n, complex_)

    def _blocks(self, fn: Callable[[Iterator[np.ndarray]], Iterator[pa.RecordBatch]], kind: str, partials: int) -> DataFrame:
        """``fn`` of the blocks of each partition, of which there are at most ``partials``."""
        names = ["re"] + (["im"] if self.complex else [])
        cells, n, fill = self._cells, self.n, self._fill
        sparse = cells is not None

        def dense_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
            for b in batches:
                if b.num_rows == 0:
                    continue
                if sparse:
                    yield from (x for _, x in _scattered(b.column("_c"), n, fill))
                    continue
                parts = [np.asarray(b.column(c).flatten(), np.float64).reshape(b.num_rows, -1) for c in names]
                yield parts[0] + 1j * parts[1] if len(parts) > 1 else parts[0]

        source = self.df.select(*names) if cells is None else cells.select("_c")
        return source.coalesce(partials).mapInArrow(lambda batches: fn(dense_blocks(batches)), kind)

    def _partials(self, size: int) -> int:
        cores = self.spark.sparkContext.defaultParallelism
        return max(1, min(PARTIALS, max(cores, PARTIAL_BYTES // max(8 * size, 1))))

    def reduce(self, fn: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...], triangle: bool = False) -> np.ndarray:
        """The sum of ``fn`` over blocks of rows. Each task adds up its own; the partial sums are then added row by
        row of the result by the cluster, so the driver receives one copy. Of a Hermitian result only the upper
        ``triangle`` is sent. The rows are counted on the way."""
        height = shape[0]
        length = int(np.prod(shape[1:]))

        def run(blocks: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
            total, seen = None, 0
            for x in blocks:
                y = fn(x).reshape(height, length)
                total, seen = y if total is None else total + y, seen + len(x)
            if total is not None:
                first = np.arange(height) if triangle else np.zeros(height, int)
                pieces = [[np.ascontiguousarray(part[i, f:], np.float64) for i, f in enumerate(first)] for part in ((total.real, total.imag) if np.iscomplexobj(total) else (total,))]
                flat = [pa.array(p, pa.list_(pa.float64())) for p in pieces]
                count = pa.array([seen] + [0] * (height - 1), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(height, dtype=np.int32)), flat[0], flat[1] if len(flat) > 1 else pa.nulls(height, pa.list_(pa.float64())), count], names=["i", "re", "im", "n"])

        def add(p: pd.DataFrame) -> pd.DataFrame:
            im = [x for x in p["im"] if x is not None]
            return pd.DataFrame({"i": [p["i"].iloc[0]], "re": [np.sum(np.stack(p["re"].to_numpy()), axis=0)], "im": [np.sum(np.stack(im), axis=0) if im else None], "n": [p["n"].sum()]})

        kind = "i int, re array<double>, im array<double>, n bigint"
        got = self._blocks(run, kind, self._partials(height * length)).groupBy("i").applyInPandas(add, kind).collect()
        out = np.zeros((height, length), complex if any(r["im"] is not None for r in got) else float)
        for r in got:
            row = np.array(r["re"]) + (1j * np.array(r["im"]) if r["im"] is not None else 0)
            out[r["i"], length - len(row) :] = row
        if triangle:
            upper = np.triu(out, 1)
            out = out + upper.conj().T
        self._rows = sum(r["n"] for r in got)
        return out.reshape(shape)

    def gram(self) -> np.ndarray:
        """X^H X, N x N."""
        if self._gram is None:
            if self.n > MOST:
                raise ValueError(f"the Gram matrix of {self.n} columns is too large, the limit is {MOST}; SVD with mode 'iterate' does without it")
            self._gram = self.reduce(lambda x: x.conj().T @ x, (self.n, self.n), triangle=True)
        return self._gram

    def gram_times(self, q: np.ndarray) -> np.ndarray:
        """X^H (X q), N x r, in one pass that forms no N x N matrix."""
        sent = self.spark.sparkContext.broadcast(q)
        return self.reduce(lambda x: x.conj().T @ (x @ sent.value), q.shape)

    def triangle(self, fan: int = 8) -> np.ndarray:
        """R of X = Q R, N x N: each task factors its rows, and ``fan`` factors at a time are stacked and factored again.

        Unlike the Gram matrix it doesn't square the condition of X.
        """
        n, cplx = self.n, self.complex
        if n > MOST:
            raise ValueError(f"the triangle of {n} columns is too large, the limit is {MOST}")

        def pack(r: np.ndarray, key: int, seen: int) -> pd.DataFrame:
            return pd.DataFrame({"key": [key], "n": [seen], "r": [np.ascontiguousarray(r).tobytes()]})

        def factor(blocks: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
            r, seen = np.zeros((0, n), complex if cplx else float), 0
            for x in blocks:
                r, seen = np.linalg.qr(np.concatenate([r, x]), mode="r"), seen + len(x)
            yield pa.RecordBatch.from_pandas(pack(r, TaskContext.get().partitionId(), seen), schema=pa.schema([("key", pa.int64()), ("n", pa.int64()), ("r", pa.binary())]))

        def merge(p: pd.DataFrame) -> pd.DataFrame:
            rs = [np.frombuffer(b, complex if cplx else float).reshape(-1, n) for b in p["r"]]
            return pack(np.linalg.qr(np.concatenate(rs), mode="r"), int(p["key"].iloc[0]) // fan, int(p["n"].sum()))

        kind = "key bigint, n bigint, r binary"
        partials = self._partials(n * n)
        rs = self._blocks(factor, kind, partials)
        while partials > 1:
            rs = rs.groupBy(F.floor(F.col("key") / fan).alias("g")).applyInPandas(merge, kind)
            partials = -(-partials // fan)
        got = rs.collect()
        self._rows = sum(g["n"] for g in got)
        return np.linalg.qr(np.concatenate([np.frombuffer(bytes(g["r"]), complex if cplx else float).reshape(-1, n) for g in got]), mode="r")

    def row_gram(self, chunk: int = 4096) -> tuple[list, np.ndarray]:
        """row_ids and X X^H, for few long rows: the rows are cut into stretches of columns that meet in one task each."""
        ids = [r[0] for r in self.df.select("row_id").orderBy("row_id").limit(MOST + 1).collect()]
        if len(ids) > MOST:
            raise ValueError(f"more than {MOST} rows")
        at = {k: i for i, k in enumerate(ids)}
        m = len(ids)

        def part(p: pd.DataFrame) -> pd.DataFrame:
            x = _block(p)
            y = np.zeros((m, m), x.dtype)
            i = p["row_id"].map(at).to_numpy()
            y[np.ix_(i, i)] = x @ x.conj().T
            return pd.DataFrame({"i": np.arange(m), "re": list(y.real), "im": list(y.imag)})

        sums = self._stretches(chunk).groupBy("k").applyInPandas(part, "i int, re array<double>, im array<double>").groupBy("i").applyInPandas(
            lambda p: pd.DataFrame({"i": [p["i"].iloc[0]], "re": [np.sum(np.stack(p["re"].to_numpy()), axis=0)], "im": [np.sum(np.stack(p["im"].to_numpy()), axis=0)]}), "i int, re array<double>, im array<double>"
        )
        out = np.zeros((m, m), complex)
        for r in sums.collect():
            out[r["i"]] = np.array(r["re"]) + 1j * np.array(r["im"])
        return ids, out if self.complex else out.real

    def _stretches(self, chunk: int) -> DataFrame:
        """Each row cut into stretches k of ``chunk`` columns."""
        cols = ["re"] + (["im"] if self.complex else [])
        step = F.sequence(F.lit(0), F.lit((self.n - 1) // chunk))
        return self.df.select("row_id", *cols, F.explode(step).alias("k")).select("row_id", "k", *(F.slice(c, F.col("k") * chunk + 1, chunk).alias(c) for c in cols))

    def times_rows(self, ids: list, u: np.ndarray, chunk: int = 4096) -> np.ndarray:
        """X^H u, N x r, for few long rows with the given ids; a stretch of columns is one task's work."""
        at = {k: i for i, k in enumerate(ids)}
        sent = self.spark.sparkContext.broadcast((at, u))

        def part(p: pd.DataFrame) -> pd.DataFrame:
            where, w = sent.value
            y = _block(p).conj().T @ w[p["row_id"].map(where).to_numpy()]
            return pd.DataFrame({"i": np.arange(len(y)) + int(p["k"].iloc[0]) * chunk, "re": list(np.ascontiguousarray(y.real)), "im": list(np.ascontiguousarray(y.imag))})

        out = np.zeros((self.n, u.shape[1]), complex)
        for r in self._stretches(chunk).groupBy("k").applyInPandas(part, "i int, re array<double>, im array<double>").toLocalIterator():
            out[r["i"]] = np.array(r["re"]) + 1j * np.array(r["im"])
        return out if self.complex or np.iscomplexobj(u) else out.real

    def lift(self, c: np.ndarray, real: bool | None = None) -> Matrix:
        """X c. The N x r matrix is sent to the executors; its size is checked."""
        if c.size > 4 * MOST * MOST:
            raise ValueError("the matrix to multiply by is too large to be sent")
        complex_ = (self.complex or np.iscomplexobj(c)) if real is None else not real
        sent = self.spark.sparkContext.broadcast(c)
        return self.map_rows(lambda x: x @ sent.value, c.shape[1], complex_)

    def column_sum(self) -> np.ndarray:
        return self.reduce(lambda x: x.sum(axis=0)[None], (1, self.n))[0]

    def long(self, names: tuple[str, str, str] = ("row_id", "k", "value")) -> DataFrame:
        """One row per number: row_id, column, value (and imag)."""
        if not self.complex:
            return self.df.select("row_id", F.posexplode("re").alias("k", "value")).toDF(*names)
        z = self.df.select("row_id", F.posexplode(F.arrays_zip("re", "im")).alias("k", "z"))
        return z.select("row_id", "k", F.col("z.re").alias("value"), F.col("z.im").alias("imag")).toDF(*names, "imag")


class Local:
    """A small matrix on the driver with the passes of a :class:`Matrix`, for reduced data."""

    def __init__(self, x: np.ndarray, spark: SparkSession | None = None):
        self.x, self.spark = np.asarray(x), spark
        self.rows, self.n = self.x.shape
        self.complex = np.iscomplexobj(self.x)

    def map_rows(self, fn: Callable[[np.ndarray], np.ndarray], n: int, complex_: bool) -> Local:
        y = fn(self.x)
        return Local(y if complex_ else y.real, self.spark)

    def reduce(self, fn: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
        return fn(self.x).reshape(shape)

    def gram(self) -> np.ndarray:
        return self.x.conj().T @ self.x

    def column_sum(self) -> np.ndarray:
        return self.x.sum(axis=0)

    def lift(self, c: np.ndarray, real: bool | None = None) -> Local:
        y = self.x @ c
        return Local(y.real if real else y, self.spark)

    def numpy(self) -> np.ndarray:
        return self.x


def minus(a: Matrix, b: Matrix) -> Matrix:
    """a - b, row by row."""
    both = a.df.toDF(*[c if c == "row_id" else f"a_{c}" for c in a.df.columns]).join(b.df.toDF(*[c if c == "row_id" else f"b_{c}" for c in b.df.columns]), "row_id")
    complex_ = a.complex or b.complex
    zero = lambda c: F.transform(c, lambda _: F.lit(0.0))
    cols = [F.zip_with("a_re", "b_re", lambda x, y: x - y).alias("re")]
    if complex_:
        cols.append(F.zip_with("a_im" if a.complex else zero("a_re"), "b_im" if b.complex else zero("b_re"), lambda x, y: x - y).alias("im"))
    return Matrix(both.select("row_id", *cols), a.n, complex_)


def beside(matrices: list[Matrix]) -> Matrix:
    """Matrices of the same rows beside each other."""
    out = matrices[0].df
    for m in matrices[1:]:
        other = m.df.select("row_id", *(F.col(c).alias(f"_{c}") for c in m.df.columns if c != "row_id"))
        out = out.join(other, "row_id").select("row_id", *(F.concat(c, f"_{c}").alias(c) for c in m.df.columns if c != "row_id"))
    return Matrix(out, sum(m.n for m in matrices))


class SVD:
    """Truncated singular value decomposition of a :class:`Matrix`.

    ``rank=None`` takes the optimal hard threshold; any rank is kept within 1 and min(M, N). ``mode`` is

    * ``gram_cols`` (N x N) or ``gram_rows`` (M x M): one pass; values below about 1e-8 of the largest are noise;
    * ``qr``: the triangle of a tree of factorings, N x N; small values are as exact as those of X itself;
    * ``iterate``: subspace iteration with N x (rank + ``EXTRA``) numbers and one pass each, for matrices that are
      large in both directions; it ends when the leading values move by less than ``tol`` of the largest, or with
      an error after ``most`` passes. It needs a rank, and knows only the values up to it;
    * ``auto``: ``iterate`` where both M and N exceed ``MOST``, else the smaller Gram matrix.
    """

    EXTRA = 10

    def __init__(self, x: Matrix, rank: int | None = None, mode: str = "auto", tol: float = 1e-10, most: int = 500):
        if mode not in ("auto", "gram_cols", "gram_rows", "qr", "iterate"):
            raise ValueError(f"unknown mode {mode!r}")
        self.x = x
        if mode == "auto":
            # Few columns need no count of the rows before.
            mode = "gram_cols" if x.n <= 1024 or (x.n <= x.rows and x.n <= MOST) else "gram_rows" if x.rows <= MOST else "iterate"
        self.mode = mode
        self._ids = self._u = None
        if mode == "iterate":
            if rank is None:
                raise ValueError("mode 'iterate' needs a rank")
            s, v = self._iterate(rank, tol, most)
        elif mode == "gram_cols":
            s, v = dense.gram_factors(x.gram())
        elif mode == "qr":
            s, vh = np.linalg.svd(x.triangle())[1:]
            v = vh.conj().T
        else:
            self._ids, g = x.row_gram()
            s, u = dense.gram_factors(g)
        small = min(x.rows, x.n)
        self.s_full = s[:small]
        self.opt_rank = len(self.s_full) if mode == "iterate" else dense.hard_threshold_rank(self.s_full, x.rows, x.n)
        self.rank = max(1, min(self.opt_rank if rank is None else rank, len(self.s_full)))
        self.s = self.s_full[: self.rank]
        if mode == "gram_rows":
            self._u = u[:, : self.rank]
            self.V = self._right()
        else:
            self.V = v[:, : self.rank]

    def _iterate(self, rank: int, tol: float, most: int) -> tuple[np.ndarray, np.ndarray]:
        x = self.x
        k = min(rank + self.EXTRA, x.n)
        rng = np.random.default_rng(0)
        q = np.linalg.qr(rng.normal(size=(x.n, k)) + (1j * rng.normal(size=(x.n, k)) if x.complex else 0))[0]
        before = np.full(rank, np.inf)
        for _ in range(most):
            z = x.gram_times(q)
            val, vec = np.linalg.eigh((q.conj().T @ z + z.conj().T @ q) / 2)
            s, vec = np.sqrt(np.maximum(val[::-1], 0.0))[:rank], vec[:, ::-1]
            if np.abs(s - before).max() <= tol * max(s[0], np.finfo(float).tiny):
                return s, q @ vec[:, :rank]
            before = s
            q = np.linalg.qr(z)[0]
        raise ValueError(f"no convergence in {most} passes")

    def _right(self) -> np.ndarray:
        return self.x.times_rows(self._ids, self._u) * dense.safe_inverse(self.s_full)[: self.rank]

    @property
    def U(self) -> Matrix:
        """Left vectors, one row per point."""
        return self.x.lift(self.V * dense.safe_inverse(self.s_full)[: self.rank])

    @property
    def coefficients(self) -> np.ndarray:
        """U^H X, r x N."""
        return self.s[:, None] * self.V.conj().T

    @property
    def s_rel(self) -> np.ndarray:
        """Percent of the sum of all singular values."""
        return 100 * self.s / self.s_full.sum()

    @property
    def s_cum(self) -> np.ndarray:
        return 100 * np.cumsum(self.s) / self.s_full.sum()

    def spectrum(self) -> DataFrame:
        """k, s, s_rel, s_cum."""
        rows = [(k, float(a), float(b), float(c)) for k, (a, b, c) in enumerate(zip(self.s, self.s_rel, self.s_cum, strict=True))]
        return self.x.spark.createDataFrame(rows, "k int, s double, s_rel double, s_cum double")

    def reconstruct(self, rank: int | None = None) -> Matrix:
        """U_r diag(s_r) V_r^H, which is X times the projector on the first r right vectors."""
        r = self.rank if rank is None else max(1, min(rank, self.rank))
        v = self.V[:, :r]
        return self.x.lift(v @ v.conj().T)

    @property
    def required_memory(self) -> int:
        """Bytes of U, s and V."""
        width = 16 if self.x.complex else 8
        return width * self.rank * (self.x.rows + self.x.n) + 8 * self.rank

    def __str__(self) -> str:
        size, unit = format_byte_size(self.required_memory)
        return f"SVD of a {self.x.rows} x {self.x.n} data matrix, rank {self.rank} (optimal rank {self.opt_rank}); {size:.4f} {unit}"
