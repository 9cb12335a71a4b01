"""Spectra: windowed Fourier transform, adaptive multitaper power, and adaptive multitaper SPOD.

Transforms act along the rows, so a row is transformed where it lies. Spectra of the whole matrix are sums
over rows. For SPOD, every tapered transform is a combination of columns, so each bin's eigenproblem follows
from the N x N Gram matrix of the weighted, mean-free data; the adaptive choice of tapers never touches the
rows again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions import dense
from tidewright.operators.linalg import SVD, Local, Matrix, minus


class DFT:
    """Fourier transform of mean-free, windowed rows, with unitary scaling and zero padding to ``nfft``."""

    def __init__(self, x: Matrix, dt: float, nfft: int | None = None, window: str = "boxcar"):
        self.x, self.dt = x, dt
        self.nfft = max(nfft or 0, x.n)
        self.w = dense.window(window, x.n)
        self.window = window
        self.complex = x.complex
        self._amp: np.ndarray | None = None

    def _transform(self):
        w, nfft, cplx = self.w, self.nfft, self.complex

        def run(x: np.ndarray) -> np.ndarray:
            x = (x - x.mean(axis=1, keepdims=True)) * w
            return np.fft.fft(x, nfft, norm="ortho") if cplx else np.fft.rfft(x, nfft, norm="ortho")

        return run

    @property
    def n_bins(self) -> int:
        return self.nfft if self.complex else self.nfft // 2 + 1

    @property
    def frequency(self) -> np.ndarray:
        """Without the zero bin."""
        f = np.fft.fftfreq(self.nfft, self.dt) if self.complex else np.fft.rfftfreq(self.nfft, self.dt)
        return f[1:]

    @property
    def transform(self) -> Matrix:
        return self.x.map_rows(self._transform(), self.n_bins, True)

    def _power(self) -> np.ndarray:
        run = self._transform()
        return self.x.reduce(lambda x: (np.abs(run(x)) ** 2).sum(axis=0)[None], (1, self.n_bins))[0]

    @property
    def amplitude(self) -> np.ndarray:
        """Power per point and bin, corrected for the window; bins that stand for two count twice."""
        if self._amp is None:
            factor = np.ones(self.n_bins) if self.complex else dense.one_sided(self.n_bins, self.nfft)
            self._amp = (self._power() * factor / self.x.rows / np.mean(self.w**2))[1:]
        return self._amp

    @property
    def spectral_density(self) -> np.ndarray:
        return self.amplitude * self.nfft * self.dt

    @property
    def modes(self) -> Matrix:
        """Unit columns of the transform, without the zero bin."""
        run, norm = self._transform(), np.sqrt(self._power()[1:])
        scale = 1 / np.maximum(norm, np.finfo(float).tiny)
        return self.x.map_rows(lambda x: run(x)[:, 1:] * scale, self.n_bins - 1, True)

    def spectrum(self) -> DataFrame:
        """bin, frequency, amplitude, density."""
        rows = [(k + 1, float(f), float(a), float(d)) for k, (f, a, d) in enumerate(zip(self.frequency, self.amplitude, self.spectral_density, strict=True))]
        return self.x.spark.createDataFrame(rows, "bin int, frequency double, amplitude double, density double")

    def partial_reconstruction(self, mode_indices: set[int], include_mean: bool = False) -> Matrix:
        """The rows from the given modes (mode i is bin i + 1); the window is divided out."""
        run, nfft, n, cplx = self._transform(), self.nfft, self.x.n, self.complex
        mask = np.zeros(self.n_bins)
        mask[[i + 1 for i in mode_indices]] = 1
        w = np.maximum(self.w, dense.TINY)

        def back(x: np.ndarray) -> np.ndarray:
            q = run(x) * mask
            y = (np.fft.ifft(q, nfft, norm="ortho") if cplx else np.fft.irfft(q, nfft, norm="ortho"))[:, :n] / w
            return y + x.mean(axis=1, keepdims=True) if include_mean else y

        return self.x.map_rows(back, n, cplx)

    @property
    def reconstruction(self) -> Matrix:
        """All bins and the mean."""
        run, nfft, n, cplx, w = self._transform(), self.nfft, self.x.n, self.complex, np.maximum(self.w, dense.TINY)

        def back(x: np.ndarray) -> np.ndarray:
            q = run(x)
            return (np.fft.ifft(q, nfft, norm="ortho") if cplx else np.fft.irfft(q, nfft, norm="ortho"))[:, :n] / w + x.mean(axis=1, keepdims=True)

        return self.x.map_rows(back, n, cplx)

    def top_modes(self, n: int = 1, f_min: float = -np.inf, f_max: float = np.inf) -> np.ndarray:
        return dense.band_top(self.frequency, self.amplitude, n, f_min, f_max)


class PDFT:
    """DFT of the POD coefficients; modes are lifted, amplitudes are per point of the full data."""

    def __init__(self, x: Matrix, dt: float, rank: int | None = None, nfft: int | None = None, window: str = "boxcar"):
        self.x = x
        self.svd = SVD(x, rank)
        self.inner = DFT(Local(self.svd.coefficients, x.spark), dt, nfft, window)
        self.frequency = self.inner.frequency
        self.back = self.svd.V * dense.safe_inverse(self.svd.s_full)[: self.svd.rank]

    @property
    def amplitude(self) -> np.ndarray:
        return self.inner.amplitude * self.svd.rank / self.x.rows

    @property
    def modes(self) -> Matrix:
        return self.x.lift(self.back @ self.inner.modes.numpy())

    def partial_reconstruction(self, mode_indices: set[int], include_mean: bool = False) -> Matrix:
        return self.x.lift(self.back @ self.inner.partial_reconstruction(mode_indices, include_mean).numpy())

    @property
    def reconstruction(self) -> Matrix:
        return self.x.lift(self.back @ self.inner.reconstruction.numpy())

    def top_modes(self, n: int = 1, f_min: float = -np.inf, f_max: float = np.inf) -> np.ndarray:
        return dense.band_top(self.frequency, self.amplitude, n, f_min, f_max)


class AMPS:
    """Adaptive multitaper power spectrum of one signal."""

    def __init__(self, signal: np.ndarray, dt: float, nfft: int | None = None, adaptive: bool = True, max_tapers: int = 50, tolerance: float = 1e-5, subtract_mean: bool = True):
        x = np.asarray(signal)
        if x.ndim == 2 and x.shape[0] == 1:
            x = x[0]
        if x.ndim != 1:
            raise ValueError("the signal must have one dimension")
        self.dt, self.n = dt, len(x)
        self.nfft = max(nfft or 0, self.n)
        self.complex = np.iscomplexobj(x)
        self.max_tapers = max(2, min(max_tapers, self.n))
        q = np.fft.fft(x - x.mean() if subtract_mean else x, 2 * self.nfft)
        n_freq = self.nfft if self.complex else self.nfft // 2 + 1
        scale = 2 / (self.nfft + 1)

        def power(f: int, k: int) -> float:
            a, b = dense.taper_index(f, k, self.nfft)
            return float(np.sum(dense.parabolic_weights(k) * scale * np.abs((q[a] - q[b]) / 2j) ** 2)) / self.n

        if adaptive:
            last = np.ones(n_freq)
            value = np.zeros(n_freq)

            def change(f: int, k: int) -> float:
                value[f] = power(f, k)
                now = np.log10(value[f] + np.finfo(float).tiny)
                moved, last[f] = abs(now - last[f]), now
                return moved

            self.n_tapers, self.residual = dense.adaptive_sweep(n_freq, self.max_tapers, change, tolerance)
            self.raw = value
        else:
            self.n_tapers, self.residual = np.full(n_freq, self.max_tapers), None
            self.raw = np.array([power(f, self.max_tapers) for f in range(n_freq)])

    @property
    def frequency(self) -> np.ndarray:
        return np.fft.fftfreq(self.nfft, self.dt) if self.complex else np.fft.rfftfreq(self.nfft, self.dt)

    @property
    def spectral_power(self) -> np.ndarray:
        return self.raw if self.complex else self.raw * dense.one_sided(len(self.raw), self.nfft)

    @property
    def spectral_density(self) -> np.ndarray:
        return self.spectral_power * self.nfft * self.dt

    @property
    def half_bandwidth(self) -> np.ndarray:
        return 0.5 * (self.n_tapers + 1) / ((self.nfft + 1) * self.dt)

    def top_power(self, n: int = 1, f_min: float = -np.inf, f_max: float = np.inf) -> np.ndarray:
        return dense.band_top(self.frequency, self.spectral_power, n, f_min, f_max)


def taper_powers(x: np.ndarray, nfft: int, most: int) -> np.ndarray:
    """Powers of the rows of ``x`` with 1 to ``most`` tapers: tapers x rows x bins.

    The parabolic weights of k tapers are k^2 - (i - 1)^2 up to a factor, so two running sums over the tapers give
    the powers for every k.
    """
    q = np.fft.fft(x, 2 * nfft, axis=1)
    f = np.arange(nfft if np.iscomplexobj(x) else nfft // 2 + 1)
    out = np.empty((most, len(x), len(f)))
    plain = squared = np.zeros((len(x), len(f)))
    for k in range(1, most + 1):
        d = np.abs(q[:, (2 * f - k) % (2 * nfft)] - q[:, (2 * f + k) % (2 * nfft)]) ** 2 / 4
        plain, squared = plain + d, squared + (k - 1) ** 2 * d
        out[k - 1] = 6 / (k * (4 * k - 1) * (k + 1)) * (k * k * plain - squared)
    return out * (2 / (nfft + 1) / x.shape[1])


def chosen_tapers(power: np.ndarray, tol: float) -> np.ndarray:
    """The adaptive choice of tapers (see ``dense.adaptive_sweep``) for all rows at once: rows x bins."""
    most, rows, n_freq = power.shape
    level = np.log10(power + np.finfo(float).tiny)
    count, done, last = np.full((rows, n_freq), 2), np.zeros((rows, n_freq), bool), np.ones((rows, n_freq))
    at = np.arange(rows)
    while not done.all():
        for f in np.flatnonzero(~done.all(axis=0)):
            k = count[:, f]
            now = level[k - 1, at, f]
            still = np.abs(now - last[:, f]) <= tol
            beside = np.zeros(rows, bool)
            for g in (f - 1, f + 1):
                if 0 <= g < n_freq:
                    beside |= k - count[:, g] == 1
            open_ = ~done[:, f]
            stop = still | (k >= most) | beside
            last[open_, f] = now[open_]
            done[open_ & stop, f] = True
            count[open_ & ~stop, f] += 1
    return count


def multitaper_power(signals: DataFrame, dt: float, nfft: int | None = None, adaptive: bool = True, max_tapers: int = 50, tolerance: float = 1e-5, subtract_mean: bool = True) -> DataFrame:
    """AMPS of every row (row_id, re): row_id, bin, frequency, power, density, n_tapers. Rows are independent."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            size = np.fromiter(map(len, p["re"]), int, len(p))
            for n in np.unique(size):
                own = p[size == n]
                x = np.stack(own["re"].to_numpy()).astype(float)
                length, most = max(nfft or 0, n), max(2, min(max_tapers, n))
                freq = np.fft.rfftfreq(length, dt)
                step = max(1, 2_000_000 // (most * len(freq)))
                for lo in range(0, len(x), step):
                    y = x[lo : lo + step]
                    power = taper_powers(y - y.mean(axis=1, keepdims=True) if subtract_mean else y, length, most)
                    k = chosen_tapers(power, tolerance) if adaptive else np.full(power.shape[1:], most)
                    v = np.take_along_axis(power, k[None] - 1, axis=0)[0] * dense.one_sided(len(freq), length)
                    r, c = v.shape
                    yield pd.DataFrame({"row_id": np.repeat(own["row_id"].to_numpy()[lo : lo + step], c), "bin": np.tile(np.arange(c), r), "frequency": np.tile(freq, r), "power": v.ravel(), "density": v.ravel() * length * dt, "n_tapers": k.ravel()})

    kind = dict(signals.dtypes)["row_id"]
    return signals.select("row_id", "re").mapInPandas(run, f"row_id {kind}, bin int, frequency double, power double, density double, n_tapers int")


def mode_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Modulus of the cosine between two (complex) modes."""
    return float(abs(np.vdot(a, b)) / max(np.linalg.norm(a) * np.linalg.norm(b), np.finfo(float).tiny))


def tiled_weights(weights: DataFrame, x: Matrix) -> DataFrame:
    """Weights (row_id from 0 on) for a matrix that holds several components of each point below each other."""
    n = weights.count()
    if n == 0 or x.rows % n:
        raise ValueError(f"{x.rows} rows are no multiple of {n} weights")
    return x.df.select("row_id", F.pmod("row_id", F.lit(n)).alias("_p")).join(weights.select(F.col("row_id").alias("_p"), "w"), "_p").select("row_id", "w")


def near_products(g: np.ndarray, length: int, reach: int) -> np.ndarray:
    """Inner products of the rows' transforms of ``length`` at bins p and p + d, from the Gram matrix: row d + reach,
    column p, for d within ``reach``. Only this band of all length x length products is ever formed.

    Along a diagonal t - s = m of g the phases of d are applied first; the transform over m does the rest.
    """
    n = len(g)
    turn = np.exp(-2j * np.pi * np.outer(np.arange(n), np.arange(-reach, reach + 1)) / length)
    by_lag = np.zeros((length, 2 * reach + 1), complex)
    for m in range(-(n - 1), n):
        by_lag[m % length] = np.diagonal(g, m) @ turn[max(m, 0) : n + min(m, 0)]
    return np.fft.fft(by_lag, axis=0).T


class AMSPOD:
    """Adaptive multitaper spectral proper orthogonal decomposition of a :class:`Matrix`.

    ``weight`` is a DataFrame (row_id, w) of quadrature weights; for a matrix that holds several components
    below each other, :func:`tiled_weights` repeats them.
    """

    def __init__(self, x: Matrix, dt: float, nfft: int | None = None, adaptive: bool = True, max_tapers: int = 50, tolerance: float = 1e-5, weight: DataFrame | None = None, subtract_mean: bool = True, keep_n_modes: int = 3):
        self.x, self.dt = x, dt
        self.nfft = max(nfft or 0, x.n)
        self.adaptive = adaptive
        self.keep = keep_n_modes
        self.subtract_mean = subtract_mean
        self.w = weight
        self.weighted = self._weighted()
        n = x.n
        g = self.weighted.gram()
        self.g = g
        self.max_tapers = max(2, min(max_tapers, x.rows, n))
        self.n_freq = self.nfft if x.complex else self.nfft // 2 + 1
        # Inner products of all bins of the rows' transforms, from the Gram matrix alone.
        long_ = 2 * self.nfft
        self.band = near_products(g, long_, 2 * self.max_tapers) / long_ * dt
        ones = self.weighted.column_sum()
        self.sums = np.fft.fft(ones, long_) / np.sqrt(long_) * np.sqrt(dt)
        self.rows = x.rows
        self.n_tapers = np.full(self.n_freq, self.max_tapers)
        self.residual = None
        self._vectors: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        if adaptive:
            before: dict[int, np.ndarray | None] = {}

            def change(f: int, k: int) -> float:
                lam, v = self._solve(f, k)
                b = self._basis_gram(f, k + 0)
                u = v[:, 0]
                own = max(float(np.real(u.conj() @ b @ u)), np.finfo(float).tiny)
                if f not in before:
                    other = abs(self._ones(f, k) @ u) / np.sqrt(own * self.rows)
                else:
                    old = before[f]
                    pad = np.zeros(k, complex)
                    pad[: len(old)] = old
                    norm = max(float(np.real(pad.conj() @ self._raw_gram(f, k) @ pad)), np.finfo(float).tiny)
                    mine = np.sqrt(dense.parabolic_weights(k)) * u
                    other = abs(pad.conj() @ self._raw_gram(f, k) @ mine) / np.sqrt(own * norm)
                before[f] = np.sqrt(dense.parabolic_weights(k)) * u
                self._vectors[f] = (lam, v)
                return 1 - other

            self.n_tapers, self.residual = dense.adaptive_sweep(self.n_freq, self.max_tapers, change, tolerance)
        else:
            for f in range(self.n_freq):
                self._vectors[f] = self._solve(f, self.max_tapers)
        scale = 2 * self.nfft / (dt * n)
        self.lam = np.full((self.n_freq, self.keep), np.nan)
        for f, (lam, _) in self._vectors.items():
            m = min(self.keep, len(lam))
            self.lam[f, :m] = lam[:m] * scale

    def _weighted(self) -> Matrix:
        x = self.x
        if self.w is not None:
            joined = x.df.join(self.w.select("row_id", F.sqrt("w").alias("_w")), "row_id")
            cols = [F.transform(c, lambda v: v * F.col("_w")).alias(c) for c in x.df.columns if c != "row_id"]
            x = Matrix(joined.select("row_id", *cols), x.n)
        if self.subtract_mean:
            x = x.map_rows(lambda v: v - v.mean(axis=1, keepdims=True), x.n, x.complex)
        return x

    def _raw_gram(self, f: int, k: int) -> np.ndarray:
        """Inner products of the tapered transforms 1 to k at bin f, without the parabolic weights."""
        a, b = dense.taper_index(f, k, self.nfft)
        i = np.arange(1, k + 1)
        reach = 2 * self.max_tapers
        # Bins 2f - i and 2f + i: how far apart they are is the row of the band.
        s = lambda x, dx, dy: self.band[dy[None] - dx[:, None] + reach, x[:, None]]
        return (s(a, -i, -i) - s(a, -i, i) - s(b, i, -i) + s(b, i, i)) / 4 * (2 / (self.nfft + 1))

    def _basis_gram(self, f: int, k: int) -> np.ndarray:
        m = np.sqrt(dense.parabolic_weights(k))
        return self._raw_gram(f, k) * m[:, None] * m[None]

    def _ones(self, f: int, k: int) -> np.ndarray:
        a, b = dense.taper_index(f, k, self.nfft)
        return (self.sums[a] - self.sums[b]) / 2j * np.sqrt(2 / (self.nfft + 1)) * np.sqrt(dense.parabolic_weights(k))

    def _solve(self, f: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        b = self._basis_gram(f, k)
        lam, v = np.linalg.eigh((b + b.conj().T) / 2)
        return np.maximum(lam[::-1], 0.0), v[:, ::-1]

    @property
    def frequency(self) -> np.ndarray:
        return np.fft.fftfreq(self.nfft, self.dt) if self.x.complex else np.fft.rfftfreq(self.nfft, self.dt)

    @property
    def half_bandwidth(self) -> np.ndarray:
        return 0.5 * (self.n_tapers + 1) / ((self.nfft + 1) * self.dt)

    @property
    def eigvals(self) -> np.ndarray:
        lam = np.abs(self.lam)
        return lam if self.x.complex else lam * dense.one_sided(self.n_freq, self.nfft)[:, None]

    def coefficients(self, f_idx: list[int]) -> np.ndarray:
        """N x (bins * keep): the modes of the weighted data are its product with this; missing modes are zero."""
        n, long_ = self.x.n, 2 * self.nfft
        out = np.zeros((n, len(f_idx) * self.keep), complex)
        t = np.arange(n)
        for j, f in enumerate(f_idx):
            lam, v = self._vectors[f]
            k = len(lam)
            a, b = dense.taper_index(f, k, self.nfft)
            e = (np.exp(-2j * np.pi * np.outer(t, a) / long_) - np.exp(-2j * np.pi * np.outer(t, b) / long_)) / 2j
            e *= np.sqrt(self.dt / long_) * np.sqrt(2 / (self.nfft + 1)) * np.sqrt(dense.parabolic_weights(k))
            m = min(self.keep, k)
            out[:, j * self.keep : j * self.keep + m] = e @ v[:, :m] / np.sqrt(np.maximum(lam[:m], np.finfo(float).tiny))
        return out

    def modes(self, f_idx: list[int]) -> Matrix:
        """Modes at the given bins, ``keep`` per bin beside each other; the weights are divided out."""
        return self._unweighted(self.weighted.lift(self.coefficients(f_idx)))

    def _unweighted(self, m: Matrix) -> Matrix:
        if self.w is None:
            return m
        joined = m.df.join(self.w.select("row_id", F.sqrt("w").alias("_w")), "row_id")
        cols = [F.transform(c, lambda v: v / F.col("_w")).alias(c) for c in m.df.columns if c != "row_id"]
        return Matrix(joined.select("row_id", *cols), m.n)

    def spectrum(self) -> DataFrame:
        """bin, frequency, n_tapers and the leading eigenvalues as an array."""
        rows = [(k, float(f), int(n), [float(v) for v in e if v == v]) for k, (f, n, e) in enumerate(zip(self.frequency, self.n_tapers, self.eigvals, strict=True))]
        return self.x.spark.createDataFrame(rows, "bin int, frequency double, n_tapers int, eigvals array<double>")

    def top_modes(self, n: int = 10, eig_idx: int | str = 0, f_min: float = -np.inf, f_max: float = np.inf) -> np.ndarray:
        e = self.eigvals
        score = np.nansum(e, axis=1) if eig_idx == "sum" else e[:, eig_idx]
        return dense.log_segment_top(self.frequency, score, n, f_min, f_max)

    def _basis(self, f_idx: list[int], n_modes: int) -> np.ndarray:
        c = self.coefficients(f_idx).reshape(self.x.n, len(f_idx), self.keep)[:, :, :n_modes]
        return c.reshape(self.x.n, -1)

    def _valid(self, n_modes: int) -> int:
        import warnings

        if n_modes < 1:
            raise ValueError("at least one mode is needed")
        most = min(self.keep, int(self.n_tapers.min()))
        if n_modes > most:
            warnings.warn(f"only {most} modes are available at every bin", UserWarning, stacklevel=3)
        return min(n_modes, most)

    def temporal_coefficients(self, n_modes: int = 1) -> np.ndarray:
        """Coefficients (bins, modes, times) of the oblique projection of the weighted data on all modes."""
        n_modes = self._valid(n_modes)
        c = self._basis(list(range(self.n_freq)), n_modes)
        if self.x.complex:
            a = np.linalg.pinv(c.conj().T @ self.g @ c, rcond=1e-10, hermitian=True) @ (c.conj().T @ self.g)
        else:
            both = np.concatenate([c.real, -c.imag], axis=1)
            z = np.linalg.pinv(both.T @ self.g @ both, rcond=1e-10, hermitian=True) @ (both.T @ self.g)
            k = c.shape[1]
            a = z[:k] + 1j * z[k:]
        return a.reshape(self.n_freq, n_modes, self.x.n)

    def partial_reconstruction(self, f_min: float, f_max: float, n_modes: int = 1, start_idx: int = 0, n_snapshots: int = 100, add_mean: bool = False) -> Matrix:
        """From the modes of a closed band; whole numbers are bins, others frequencies."""
        n_modes = self._valid(n_modes)
        if isinstance(f_min, int) and isinstance(f_max, int):
            bins = np.arange(max(f_min, 0), min(f_max, self.n_freq - 1) + 1)
        else:
            bins = np.flatnonzero((self.frequency >= f_min) & (self.frequency <= f_max))
        a = self.temporal_coefficients(n_modes)[bins].reshape(-1, self.x.n)[:, start_idx : start_idx + n_snapshots]
        c = self._basis(bins.tolist(), n_modes) @ a
        out = self._unweighted(self.weighted.lift(c if self.x.complex else c.real, real=not self.x.complex))
        if not add_mean:
            return out
        n = out.n
        mean = self.x.map_rows(lambda v: np.repeat(v.mean(axis=1, keepdims=True), n, axis=1), n, self.x.complex)
        return minus(out, mean.map_rows(lambda v: -v, n, self.x.complex))

    def mode_reconstruction(self, f_idx: int, eig_idx: int = 0, dt: float | None = None, n: int | None = None) -> Matrix:
        """One period of a mode's motion in 25 steps, or ``n`` steps of ``dt``."""
        f = self.frequency[f_idx]
        dt = (1 / (abs(f) * 25) if f else self.dt) if dt is None else dt
        t = np.arange(n or 25) * dt
        m = self.modes([f_idx])
        wave = np.exp(2j * np.pi * f * t)
        cplx = self.x.complex
        return m.map_rows(lambda v: v[:, eig_idx : eig_idx + 1] * wave if cplx else (v[:, eig_idx : eig_idx + 1] * wave).real, len(t), cplx)


class PAMSPOD(AMSPOD):
    """AMSPOD of the POD coefficients of the weighted data; modes are lifted. The caller's data is not changed."""

    def __init__(self, x: Matrix, dt: float, rank: int | None = None, weight: DataFrame | None = None, **options):
        self.full, self.full_weight = x, weight
        self.w, self.x, self.subtract_mean = weight, x, options.get("subtract_mean", True)
        w = self._weighted()
        self.svd = SVD(w, rank)
        self.back = self.svd.V * dense.safe_inverse(self.svd.s_full)[: self.svd.rank]
        self.data = w
        super().__init__(Local(self.svd.coefficients, x.spark), dt, weight=None, **options)

    def modes(self, f_idx: list[int]) -> Matrix:
        return self._lift(super().modes(f_idx).numpy())

    def _lift(self, z: np.ndarray) -> Matrix:
        out = self.data.lift(self.back @ z)
        if self.full_weight is None:
            return out
        joined = out.df.join(self.full_weight.select("row_id", F.sqrt("w").alias("_w")), "row_id")
        return Matrix(joined.select("row_id", *(F.transform(c, lambda v: v / F.col("_w")).alias(c) for c in out.df.columns if c != "row_id")), out.n)

    def partial_reconstruction(self, *args, **kwargs) -> Matrix:
        kwargs.pop("add_mean", None)
        return self._lift(super().partial_reconstruction(*args, **kwargs).numpy())
