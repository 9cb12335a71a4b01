"""Dynamic mode decomposition and its variants.

Everything reduced follows from the Gram matrix of the whole data matrix: with X1 and X2 the columns without
the last and without the first one, X1^H X1, X1^H X2 and X2^H X2 are blocks of it. One distributed pass
therefore serves the operator, the eigenvalues, the amplitudes and the norms of the modes; modes,
reconstructions and errors are lifts of the data matrix by an N x r matrix and stay distributed.

Powers of eigenvalues ascend in time everywhere. Reconstruction errors are reconstruction minus data.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions import dense
from tidewright.functions.checks import format_byte_size
from tidewright.operators.linalg import SVD, Matrix, beside, minus
from tidewright.session import positions


def dft_properties(dt: float, n_times: int) -> tuple[float, float, float]:
    """Sampling frequency, Nyquist frequency and resolution."""
    return 1 / dt, 0.5 / dt, 1 / (dt * n_times)


class Core:
    """The reduced problem, from the Gram matrix ``g`` of matrices of ``lengths`` columns beside each other."""

    def __init__(self, g: np.ndarray, lengths: list[int], rows: int, rank: int | None, unitary: bool = False, optimal: bool = False, tlsq: bool = False, forward_backward: bool | dict = False):
        self.g, self.lengths = g, lengths
        starts = np.cumsum([0, *lengths])
        self.starts = starts
        one = np.concatenate([np.arange(a, b - 1) for a, b in zip(starts[:-1], starts[1:], strict=True)])
        two = one + 1
        g11, g12, g22 = g[np.ix_(one, one)], g[np.ix_(one, two)], g[np.ix_(two, two)]
        n = len(one)
        self.one, self.two = one, two
        self.noise = np.eye(n)
        if tlsq:
            s, v = dense.gram_factors(g11 + g22)
            full = s[: min(2 * rows, n)]
            r = dense.hard_threshold_rank(full, 2 * rows, n) if rank is None else rank
            rank = max(1, min(r, len(full)))
            self.noise = v[:, :rank] @ v[:, :rank].conj().T
            g11, g12 = (self.noise @ a @ self.noise for a in (g11, g12))
        s, v = dense.gram_factors(g11)
        self.s_full = s[: min(rows, n)]
        r = dense.hard_threshold_rank(self.s_full, rows, n) if rank is None else rank
        # No direction that the data lack is taken in.
        usable = int((self.s_full > self.s_full[0] * 1e-7).sum()) if self.s_full[0] > 0 else 1
        self.rank = max(1, min(r, len(self.s_full), usable))
        self.s, self.V = s[: self.rank], v[:, : self.rank]
        inv = dense.safe_inverse(self.s)
        xp = self.s[:, None] * self.V.conj().T
        yp = inv[:, None] * (self.V.conj().T @ g12)
        self.log = None
        if unitary:
            u, _, vh = np.linalg.svd(yp @ xp.conj().T)
            self.operator = u @ vh
        elif forward_backward:
            found = dense.consistent_operator(xp, yp, **(forward_backward if isinstance(forward_backward, dict) else {}))
            self.log, self.operator = found.history, found.operator
        else:
            self.operator = (yp @ self.V) * inv
        self.eigvals, self.eigvecs = np.linalg.eig(self.operator.astype(complex))
        # The modes are X c: c has rows for all columns of the data, zero where they don't take part.
        self.c = np.zeros((len(g), self.rank), complex)
        np.add.at(self.c, two, self.noise @ (self.V * inv) @ self.eigvecs)
        self.mode_gram = self.c.conj().T @ g @ self.c
        self.on_data = self.c.conj().T @ g  # modes^H X
        self.amplitude = [self._optimal(k) if optimal else self.project(self.on_data[:, starts[k]]) for k in range(len(lengths))]

    def project(self, rhs: np.ndarray) -> np.ndarray:
        """pinv(modes) x from modes^H x."""
        return np.linalg.pinv(self.mode_gram, rcond=1e-14, hermitian=True) @ rhs

    def _optimal(self, k: int) -> np.ndarray:
        n = self.lengths[k] - 1
        p = dense.powers(self.eigvals, n)
        a = self.mode_gram * (p @ p.conj().T).conj()
        x = self.on_data[:, self.starts[k] : self.starts[k] + n]
        q = np.einsum("kt,kt->k", p.conj(), x)
        return np.linalg.lstsq(a, q, rcond=None)[0]


class DMD:
    """DMD of one data matrix, or of several of the same rows (an ensemble); then amplitudes, dynamics and
    reconstructions are lists."""

    def __init__(self, data: Matrix | list[Matrix], dt: float, rank: int | None = None, **options):
        self.members = [data] if isinstance(data, Matrix) else list(data)
        self.dt = dt
        self.x = self.members[0] if len(self.members) == 1 else beside(self.members)
        self.complex = self.x.complex
        self.core = Core(self.x.gram(), [m.n for m in self.members], self.x.rows, rank, **options)
        self.tlsq = bool(options.get("tlsq"))

    def _one(self, values: list):
        return values[0] if len(values) == 1 else values

    rank = property(lambda self: self.core.rank)
    operator = property(lambda self: self.core.operator)
    eigvals = property(lambda self: self.core.eigvals)
    eigvecs = property(lambda self: self.core.eigvecs)
    fb_log = property(lambda self: self.core.log)
    amplitude = property(lambda self: self._one(self.core.amplitude))
    eigvals_cont = property(lambda self: np.log(self.core.eigvals) / self.dt)
    frequency = property(lambda self: np.log(self.core.eigvals).imag / (2 * np.pi * self.dt))
    growth_rate = property(lambda self: np.log(self.core.eigvals).real / self.dt)

    @property
    def modes(self) -> Matrix:
        return self.x.lift(self.core.c)

    def _dynamics(self) -> list[np.ndarray]:
        return [a[:, None] * dense.powers(self.eigvals, n) for a, n in zip(self.core.amplitude, self._times(), strict=True)]

    def _times(self) -> list[int]:
        return [m.n for m in self.members]

    @property
    def dynamics(self):
        return self._one(self._dynamics())

    def _mode_norms(self) -> np.ndarray:
        return np.real(np.diag(self.core.mode_gram))

    @property
    def integral_contribution(self):
        """Squared norm of a mode times the sum of its dynamics' moduli."""
        return self._one([self._mode_norms() * np.abs(d).sum(axis=1) for d in self._dynamics()])

    def spectrum(self) -> DataFrame:
        """One row per mode: k, re, im, frequency, growth_rate, amplitude, integral (means over an ensemble)."""
        amp = np.mean([np.abs(a) for a in self.core.amplitude], axis=0)
        integral = np.mean([self._mode_norms() * np.abs(d).sum(axis=1) for d in self._dynamics()], axis=0)
        cols = (self.eigvals.real, self.eigvals.imag, self.frequency, self.growth_rate, amp, integral)
        rows = [(k, *map(float, v)) for k, v in enumerate(zip(*cols, strict=True))]
        return self.x.spark.createDataFrame(rows, "k int, re double, im double, frequency double, growth_rate double, amplitude double, integral double")

    def top_modes(self, n: int = 10, integral: bool = False, f_min: float = -np.inf, f_max: float = np.inf) -> np.ndarray:
        """Indices of the n modes with f_min <= f < f_max of largest amplitude or integral contribution."""
        score = self.integral_contribution if integral else self.amplitude
        if isinstance(score, list):
            score = np.mean(score, axis=0)
        return dense.band_top(self.frequency, np.abs(score), n, f_min, f_max)

    def partial_reconstruction(self, mode_indices: set[int]):
        mask = np.zeros(self.rank)
        mask[list(mode_indices)] = 1
        return self._one([self._lifted(mask[:, None] * d) for d in self._dynamics()])

    def _lifted(self, d: np.ndarray) -> Matrix:
        c = self.core.c @ d
        return self.x.lift(c if self.complex else c.real, real=not self.complex)

    @property
    def reconstruction(self):
        return self.partial_reconstruction(set(range(self.rank)))

    @property
    def reconstruction_error(self):
        rec = [self._lifted(d) for d in self._dynamics()]
        return self._one([minus(r, m) for r, m in zip(rec, self.members, strict=True)])

    def predict(self, initial: np.ndarray | Matrix, n_steps: int) -> Matrix:
        """The n_steps + 1 states from ``initial`` on (one column, rows in order of row_id if an array)."""
        col = initial if isinstance(initial, Matrix) else self._column(initial)
        rhs = self._modes_times(col)
        b = self.core.project(rhs)
        return self._lifted(b[:, None] * dense.powers(self.eigvals, n_steps + 1))

    def _column(self, x: np.ndarray) -> Matrix:
        if len(x) != self.x.rows:
            raise ValueError(f"a state has {self.x.rows} numbers, not {len(x)}")
        # The array meets the rows by their position; the ids stay where they are.
        kind = "_pos bigint, re array<double>" + (", im array<double>" if np.iscomplexobj(x) else "")
        values = self.x.spark.createDataFrame([(k, [float(v.real)], *([[float(v.imag)]] if np.iscomplexobj(x) else [])) for k, v in enumerate(x)], kind)
        return Matrix(positions(self.x.df.select("row_id").withColumn("_all", F.lit(0)), ["_all"], ["row_id"]).join(values, "_pos").drop("_pos", "_all"), 1)

    def _modes_times(self, col: Matrix) -> np.ndarray:
        both = beside([Matrix(self.x.df, self.x.n), col]) if col.complex == self.x.complex else None
        if both is None:
            raise ValueError("initial state and data must both be real or both complex")
        n = self.x.n
        return self.core.c.conj().T @ both.reduce(lambda x: x[:, :n].conj().T @ x[:, n:], (n, 1))[:, 0]

    @property
    def projection_error(self) -> Matrix:
        """Phi Lambda pinv(Phi) X1 - X2."""
        k = self.core
        inner = k.project(k.on_data[:, k.one] @ k.noise)
        c = k.c @ (k.eigvals[:, None] * inner)
        c = (c if self.complex else c.real).astype(complex if self.complex else float)
        np.add.at(c, (k.two, np.arange(len(k.two))), -1.0)
        return self.x.lift(c)

    @property
    def tlsq_error(self) -> tuple[Matrix, Matrix]:
        """What total least squares took out of X1 and X2."""
        k = self.core
        out = []
        for cols in (k.one, k.two):
            c = np.zeros((len(k.g), len(cols)), k.noise.dtype)
            np.add.at(c, cols, np.eye(len(cols)) - k.noise)
            out.append(self.x.lift(c))
        return out[0], out[1]

    @property
    def dft_properties(self) -> tuple[float, float, float]:
        return dft_properties(self.dt, sum(self._times()))

    @property
    def required_memory(self) -> int:
        """Bytes of operator, eigenvalues, eigenvectors and modes."""
        r = self.rank
        return 8 * r * r + 16 * (r + r * r + self.x.rows * r)

    def __str__(self) -> str:
        size, unit = format_byte_size(self.required_memory)
        fs, fn, df = self.dft_properties
        return f"DMD of rank {self.rank}: sampling {fs:g}, Nyquist {fn:g}, resolution {df:g}; {size:.4f} {unit}"

    __repr__ = __str__


class HODMD(DMD):
    """Higher-order DMD: DMD of the time-delayed POD coefficients (delay a third of the columns by default)."""

    def __init__(self, data: Matrix, dt: float, delay: int | None = None, rank_dr: int | None = None, rank: int | None = None, **options):
        self.delay = data.n // 3 if delay is None else delay
        dense.check_delay(self.delay, data.n)
        self.svd_dr = SVD(data, rank_dr)
        self.z = self.svd_dr.coefficients
        self.h = dense.hankel(self.z, self.delay)
        self.x, self.members, self.dt, self.complex = data, [data], dt, data.complex
        self.core = Core(self.h.conj().T @ self.h, [self.h.shape[1]], len(self.h), rank, **options)
        self.tlsq = bool(options.get("tlsq"))
        r = self.svd_dr.rank
        #: Modes in the reduced space; the first block row belongs to the first of the delayed states.
        self.delayed_modes = self.h @ self.core.c
        self.back = self.svd_dr.V * dense.safe_inverse(self.svd_dr.s_full)[:r]

    @property
    def modes(self) -> Matrix:
        return self.x.lift(self.back @ self.delayed_modes[: self.svd_dr.rank])

    def _mode_norms(self) -> np.ndarray:
        return np.linalg.norm(self.delayed_modes[: self.svd_dr.rank], axis=0) ** 2

    def _lifted(self, d: np.ndarray) -> Matrix:
        c = self.back @ (self.delayed_modes[: self.svd_dr.rank] @ d)
        return self.x.lift(c if self.complex else c.real, real=not self.complex)

    def predict(self, initial: Matrix, n_steps: int) -> Matrix:
        """From ``delay`` states (the most recent in the last column): the newest state and n_steps after it.

        Of the delayed prediction the last block row is returned, so the first state is the initial one.
        """
        if initial.n != self.delay:
            raise ValueError(f"{self.delay} initial states are needed")
        n = self.x.n
        both = beside([self.x, initial])
        z0 = self.back.conj().T @ both.reduce(lambda x: x[:, :n].conj().T @ x[:, n:], (n, self.delay))
        b = np.linalg.pinv(self.delayed_modes) @ dense.hankel(z0, self.delay)[:, 0]
        z = self.delayed_modes @ (b[:, None] * dense.powers(self.eigvals, n_steps + 1))
        c = self.back @ z[-self.svd_dr.rank :]
        return self.x.lift(c if self.complex else c.real, real=not self.complex)

    def _first_rows(self, c: np.ndarray) -> Matrix:
        z = (self.h @ c)[: self.svd_dr.rank]
        out = self.back @ z
        return self.x.lift(out if self.complex else out.real, real=not self.complex)

    @property
    def projection_error(self) -> Matrix:
        k = self.core
        c = k.c @ (k.eigvals[:, None] * k.project(k.on_data[:, k.one] @ k.noise))
        np.add.at(c, (k.two, np.arange(len(k.two))), -1.0)
        return self._first_rows(c)

    @property
    def tlsq_error(self) -> tuple[Matrix, Matrix]:
        k = self.core
        out = []
        for cols in (k.one, k.two):
            c = np.zeros((len(k.g), len(cols)), complex)
            np.add.at(c, cols, np.eye(len(cols)) - k.noise)
            out.append(self._first_rows(c))
        return out[0], out[1]


class MSSA:
    """Multivariate singular spectrum analysis.

    Neither the Hankel matrix nor its truncation is formed: its Gram matrix is a sum of shifted blocks of the
    data's, and averaging the anti-diagonals of its rank-r form is one N x N matrix by which the data is lifted.
    """

    def __init__(self, x: Matrix, window_size: int | None = None, rank: int | None = None):
        self.x = x
        self.window_size = min(x.n // 2 if window_size is None else window_size, x.n - 1)
        if self.window_size < 1:
            raise ValueError("the window must hold at least one time")
        self.delay = x.n - self.window_size + 1
        w, d = self.window_size, self.delay
        g = self._gram()
        h = sum(g[i : i + w, i : i + w] for i in range(d))
        s, v = dense.gram_factors(h)
        rows = self._rows() * d
        self.s_full = s[: min(rows, w)]
        r = dense.hard_threshold_rank(self.s_full, rows, w) if rank is None else rank
        self.rank = max(1, min(r, len(self.s_full)))
        self.s, self.V = s[: self.rank], v[:, : self.rank]

    def _gram(self) -> np.ndarray:
        return self.x.gram()

    def _rows(self) -> int:
        return self.x.rows

    def smoother(self) -> np.ndarray:
        """The N x N matrix R with reconstruction = X R."""
        n, w, d = self.x.n, self.window_size, self.delay
        p = self.V @ self.V.conj().T
        out = np.zeros((n, n), p.dtype)
        count = np.zeros(n)
        for i in range(d):
            out[i : i + w, i : i + w] += p
            count[i : i + w] += 1
        return out / count

    @property
    def reconstruction(self) -> Matrix:
        return self.x.lift(self.smoother())

    @property
    def reconstruction_error(self) -> Matrix:
        """Data minus reconstruction."""
        return self.x.lift(np.eye(self.x.n) - self.smoother())


class PMSSA(MSSA):
    """MSSA of the POD coefficients, lifted; both decompositions are cut at the same rank."""

    def __init__(self, x: Matrix, window_size: int | None = None, rank: int | None = None):
        self.svd_dr = SVD(x, rank)
        super().__init__(x, window_size, self.svd_dr.rank)

    def _gram(self) -> np.ndarray:
        z = self.svd_dr.coefficients
        return z.conj().T @ z

    def _rows(self) -> int:
        return self.svd_dr.rank

    @property
    def reconstruction(self) -> Matrix:
        v = self.svd_dr.V
        return self.x.lift(v @ v.conj().T @ self.smoother())

    @property
    def reconstruction_error(self) -> Matrix:
        v = self.svd_dr.V
        return self.x.lift(np.eye(self.x.n) - v @ v.conj().T @ self.smoother())
