"""Models fitted by gradient descent, on the driver, in the data's own singular basis.

Left singular vectors turn the M x N data into at most N x N coordinates without changing any Frobenius
norm, and the losses' gradients lie in that basis; so one distributed Gram pass serves the whole training
and modes are lifted at the end. Errors are data minus reconstruction.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from tidewright.functions import dense
from tidewright.functions.checks import EarlyStopping
from tidewright.operators.dmd import DMD, HODMD
from tidewright.operators.linalg import SVD, Matrix, minus


#: A loss: of label, prediction and number of data entries, its value and its gradient with respect to the
#: (conjugate) prediction.
Loss = Callable[[np.ndarray, np.ndarray, int], tuple[float, np.ndarray]]


def frobenius(label: np.ndarray, prediction: np.ndarray, size: int) -> tuple[float, np.ndarray]:
    """Root mean square error."""
    e = prediction - label
    loss = float(np.linalg.norm(e) / np.sqrt(size))
    return loss, e / (max(loss, 1e-300) * size)


class OptDMD:
    """DMD whose eigenvalues and scaled modes minimise the reconstruction error (AdamW)."""

    delay = 1

    def __init__(self, data: Matrix, dt: float, rank: int | None = None, **options):
        self.x, self.dt = data, dt
        self.dmd_init = self._init_dmd(data, dt, rank, options)
        self._coordinates()
        lam, amp = self.dmd_init.eigvals, self.dmd_init.core.amplitude[0]
        phi = self._start_modes() * amp
        self.complex = data.complex
        if self.complex:
            keep, pair = np.arange(len(lam)), np.zeros(len(lam), bool)
        else:
            keep, pair = dense.conjugate_pairs(lam)
        self.pair, self.lam, self.phi = pair, lam[keep].copy(), phi[:, keep].astype(complex)
        self.log: dict[str, list[float]] = {"train_loss": [], "val_loss": [], "full_loss": [], "lr": []}

    def _init_dmd(self, data, dt, rank, options) -> DMD:
        return DMD(data, dt, rank, **options)

    def _coordinates(self) -> None:
        s, v = dense.gram_factors(self.x.gram())
        # What a Gram matrix leaves below 1e-7 of the largest value is noise. The loss counts the rows of the data.
        keep = (s > s[0] * 1e-7 if s[0] > 0 else s >= 0) & (np.arange(len(s)) < self.x.rows)
        self.height = self.x.rows
        self.z = s[keep][:, None] * v[:, keep].conj().T
        self.back = v[:, keep] / np.where(s[keep] > 0, s[keep], 1)

    def _start_modes(self) -> np.ndarray:
        return self.z @ self.dmd_init.core.c

    def _all(self) -> tuple[np.ndarray, np.ndarray]:
        """Eigenvalues and scaled modes with the conjugates of the pairs."""
        return np.concatenate([self.lam, self.lam[self.pair].conj()]), np.concatenate([self.phi, self.phi[:, self.pair].conj()], axis=1)

    def forward(self, t: np.ndarray) -> np.ndarray:
        lam, phi = self._all()
        y = phi @ (lam[:, None] ** np.asarray(t)[None])
        return y if self.complex else y.real

    def _gradient(self, t: np.ndarray, loss_function: Loss = frobenius) -> tuple[float, list[np.ndarray]]:
        """Loss and its gradients with respect to the conjugates of the kept modes and eigenvalues."""
        loss, e = loss_function(self.z[:, t], self.forward(t), self.height * len(t))
        weight = np.where(self.pair, 2.0, 1.0) if not self.complex else np.ones(len(self.lam))
        p = self.lam[:, None] ** t[None]
        dp = t[None] * self.lam[:, None] ** np.maximum(t - 1, 0)[None]
        g_phi = e @ p.conj().T * weight
        g_lam = np.einsum("mk,mt,kt->k", self.phi.conj(), e, dp.conj()) * weight
        return float(loss), [g_phi, g_lam]

    def loss(self, t: np.ndarray, loss_function: Loss = frobenius) -> float:
        """The loss over the times ``t``; its size counts all rows of the data."""
        return loss_function(self.z[:, t], self.forward(t), self.height * len(t))[0]

    def train(self, epochs: int = 1000, lr: float = 1e-3, batch_size: int | None = None, train_size: float = 0.75, val_size: float = 0.25, scheduler_options: dict | None = None, stopping_options: dict | None = None, loss_key: str = "val_loss", seed: int = 0, loss_function: Loss = frobenius, optimizer: Callable = dense.AdamW) -> dict:
        """``optimizer(parameters, lr)`` changes the parameters in place by ``step(gradients)`` and has its rate as ``lr``."""
        n = self.z.shape[1]
        n_train = max(1, int(n * train_size / (train_size + val_size)))
        train, val = np.arange(n_train), np.arange(n_train, n)
        rng = np.random.default_rng(seed)
        opt = optimizer([self.phi, self.lam], lr)
        plateau = dense.Plateau(opt, **(scheduler_options or {}))
        best: list[np.ndarray] = []
        stop = EarlyStopping(**(stopping_options or {}), save=lambda: best.__setitem__(slice(None), [self.phi.copy(), self.lam.copy()]))
        for _ in range(epochs):
            size = batch_size or n_train
            order = rng.permutation(train) if batch_size else train
            losses = []
            for a in range(0, n_train, size):
                loss, grads = self._gradient(order[a : a + size], loss_function)
                losses.append(loss)
                opt.step(grads)
            self.log["train_loss"].append(float(np.mean(losses)))
            self.log["val_loss"].append(self.loss(val, loss_function) if len(val) else float("nan"))
            self.log["full_loss"].append(self.loss(np.arange(n), loss_function))
            self.log["lr"].append(opt.lr)
            key = loss_key if len(val) or loss_key != "val_loss" else "train_loss"
            plateau.step(self.log[key][-1])
            if stop(self.log[key][-1]):
                break
        if best:
            self.phi, self.lam = best
        return self.log

    eigvals = property(lambda self: self._all()[0])
    eigvals_cont = property(lambda self: np.log(self.eigvals) / self.dt)
    frequency = property(lambda self: np.log(self.eigvals).imag / (2 * np.pi * self.dt))
    growth_rate = property(lambda self: np.log(self.eigvals).real / self.dt)

    def _lift(self, z: np.ndarray) -> Matrix:
        c = self.back @ z
        real = not np.iscomplexobj(c)
        return self.x.lift(c, real=real)

    @property
    def amplitude(self) -> np.ndarray:
        """Norm of the scaled modes."""
        return np.linalg.norm(self._all()[1], axis=0)

    @property
    def modes(self) -> Matrix:
        """Unit modes."""
        return self._lift(self._all()[1] / self.amplitude)

    @property
    def dynamics(self) -> np.ndarray:
        return self.amplitude[:, None] * dense.powers(self.eigvals, self._n())

    def _n(self) -> int:
        return self.z.shape[1]

    @property
    def integral_contribution(self) -> np.ndarray:
        return self.amplitude**2 * np.abs(self.dynamics).sum(axis=1)

    def top_modes(self, n: int = 10, integral: bool = False, f_min: float = -np.inf, f_max: float = np.inf) -> np.ndarray:
        return dense.band_top(self.frequency, self.integral_contribution if integral else self.amplitude, n, f_min, f_max)

    def partial_reconstruction(self, mode_indices: set[int]) -> Matrix:
        lam, phi = self._all()
        i = sorted(mode_indices)
        z = phi[:, i] @ dense.powers(lam[i], self._n())
        return self._lift(z if self.complex else z.real)

    @property
    def reconstruction(self) -> Matrix:
        return self.partial_reconstruction(set(range(len(self.eigvals))))

    @property
    def reconstruction_error(self) -> Matrix:
        return minus(self.x, self.reconstruction)

    def predict(self, initial: np.ndarray, n_steps: int) -> Matrix:
        """From a state in the reduced coordinates (``z``): n_steps + 1 states."""
        lam, phi = self._all()
        b = np.linalg.pinv(phi) @ initial
        z = phi @ (b[:, None] * dense.powers(lam, n_steps + 1))
        return self._lift(z if self.complex else z.real)


class HOOptDMD(OptDMD):
    """OptDMD of time-delayed POD coefficients; the first block row is lifted."""

    def __init__(self, data: Matrix, dt: float, delay: int = 1, rank_dr: int | None = None, rank: int | None = None, **options):
        self.delay, self.rank_dr = delay, rank_dr
        super().__init__(data, dt, rank, **options)

    def _init_dmd(self, data, dt, rank, options) -> DMD:
        return HODMD(data, dt, self.delay, self.rank_dr, rank, **options)

    @property
    def svd_dr(self) -> SVD:
        return self.dmd_init.svd_dr

    def _coordinates(self) -> None:
        self.z, self.back = self.dmd_init.h, self.dmd_init.back
        self.height = len(self.z)

    def _start_modes(self) -> np.ndarray:
        return self.dmd_init.delayed_modes

    def _lift(self, z: np.ndarray) -> Matrix:
        c = self.back @ z[: self.svd_dr.rank]
        return self.x.lift(c, real=not np.iscomplexobj(c))

    def _n(self) -> int:
        return self.x.n


class LinearModel:
    """x_(n+1) = A x_n for one or several trajectories of reduced states (r x N arrays), with learned noise."""

    def __init__(self, data: np.ndarray | list[np.ndarray], dt: float, rank: int | None = None, init_forward_backward: bool = True, sigma_filter: float | None = None):
        self.dm = [data] if isinstance(data, np.ndarray) else list(data)
        if len({d.shape for d in self.dm}) > 1 or len({d.dtype for d in self.dm}) > 1 or self.dm[0].shape[1] < 2:
            raise ValueError("trajectories must agree in shape and type and have at least two states")
        self.dt = dt
        x, y = (np.concatenate([d[:, s] for d in self.dm], axis=1) for s in (slice(None, -1), slice(1, None)))
        self.A = dense.consistent_operator(x, y).operator if init_forward_backward else y @ np.linalg.pinv(x)
        if rank is not None and rank < len(self.A):
            w, v = np.linalg.eig(self.A)
            keep = np.argsort(-np.abs(w), kind="stable")[:rank]
            self.A = ((v[:, keep] * w[keep]) @ np.linalg.pinv(v[:, keep])).real
        self.noise = [d - dense.gaussian_filter(d, sigma_filter) if sigma_filter else np.zeros_like(d) for d in self.dm]
        self.log: dict[str, list[float]] = {"train_loss": [], "val_loss": [], "full_loss": [], "lr": []}
        self._eig()

    def _eig(self) -> None:
        self.eigvals, self.eigvecs = np.linalg.eig(self.A)
        self._inv = np.linalg.pinv(self.eigvecs)

    eigvals_cont = property(lambda self: np.log(self.eigvals.astype(complex)) / self.dt)
    frequency = property(lambda self: np.log(self.eigvals.astype(complex)).imag / (2 * np.pi * self.dt))
    growth_rate = property(lambda self: np.log(self.eigvals.astype(complex)).real / self.dt)

    def forward(self, x: np.ndarray, n_steps: int, backward: bool = False) -> np.ndarray:
        """States 1 to n_steps after (or before) each column of x: n_steps x r x columns."""
        a = np.linalg.pinv(self.A) if backward else self.A
        out = []
        for _ in range(n_steps):
            x = a @ x
            out.append(x)
        return np.array(out)

    def _pairs(self, horizon: int) -> list[tuple[int, int]]:
        return [(k, i) for k, d in enumerate(self.dm) for i in range(d.shape[1] - horizon)]

    def _gradient(self, pairs: list[tuple[int, int]], horizon: int, loss_function: Loss = frobenius) -> tuple[float, list[np.ndarray]]:
        """Loss of the rollouts from the denoised starts, gradients for A and the noise of each trajectory."""
        k, i = np.array(pairs).T
        clean = [d - e for d, e in zip(self.dm, self.noise, strict=True)]
        x = [np.stack([clean[a][:, b] for a, b in pairs], axis=1)]
        for _ in range(horizon):
            x.append(self.A @ x[-1])
        target = [np.stack([clean[a][:, b + h] for a, b in pairs], axis=1) for h in range(1, horizon + 1)]
        both = np.stack(target), np.stack(x[1:])
        loss, e = loss_function(*both, both[0].size)
        g_a = np.zeros_like(self.A)
        g_noise = [np.zeros_like(d) for d in self.dm]
        back = np.zeros_like(x[0])
        for h in range(horizon, 0, -1):
            back = back + e[h - 1]
            g_a += back @ x[h - 1].T
            for m in range(len(pairs)):
                g_noise[k[m]][:, i[m] + h] += e[h - 1][:, m]
            back = self.A.T @ back
        for m in range(len(pairs)):
            g_noise[k[m]][:, i[m]] -= back[:, m]
        return float(loss), [g_a, *g_noise]

    def train(self, epochs: int = 1000, lr: float = 1e-3, batch_size: int | None = None, horizon: int = 1, train_size: float = 0.75, test_size: float = 0.25, scheduler_options: dict | None = None, stopping_options: dict | None = None, loss_key: str = "full_loss", seed: int = 0, loss_function: Loss = frobenius, optimizer: Callable = dense.AdamW) -> dict:
        pairs = self._pairs(horizon)
        n_train = len(pairs) if len(pairs) == 1 else int(len(pairs) * train_size / (train_size + test_size))
        train, val = pairs[:n_train], pairs[n_train:]
        opt = optimizer([self.A, *self.noise], lr)
        plateau, stop = dense.Plateau(opt, **(scheduler_options or {})), EarlyStopping(**(stopping_options or {}))
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            order = [train[j] for j in rng.permutation(len(train))] if batch_size else train
            losses = []
            for a in range(0, len(order), batch_size or len(order)):
                loss, grads = self._gradient(order[a : a + (batch_size or len(order))], horizon, loss_function)
                losses.append(loss)
                opt.step(grads)
            self.log["train_loss"].append(float(np.mean(losses)))
            self.log["val_loss"].append(self._gradient(val, horizon, loss_function)[0] if val else float("nan"))
            self.log["full_loss"].append(self._gradient(pairs, horizon, loss_function)[0])
            self.log["lr"].append(opt.lr)
            plateau.step(self.log[loss_key][-1])
            if stop(self.log[loss_key][-1]):
                break
        self._eig()
        return self.log

    @property
    def amplitude(self) -> list[np.ndarray]:
        return [self._inv @ (d[:, 0] - e[:, 0]) for d, e in zip(self.dm, self.noise, strict=True)]

    @property
    def dynamics(self) -> list[np.ndarray]:
        return [a[:, None] * dense.powers(self.eigvals.astype(complex), d.shape[1]) for a, d in zip(self.amplitude, self.dm, strict=True)]

    @property
    def integral_contribution(self) -> list[np.ndarray]:
        norm = np.linalg.norm(self.eigvecs, axis=0) ** 2
        return [norm * np.abs(d).sum(axis=1) for d in self.dynamics]

    def top_modes(self, n: int = 10, integral: bool = False, f_min: float = -np.inf, f_max: float = np.inf) -> np.ndarray:
        score = np.mean([np.abs(v) for v in (self.integral_contribution if integral else self.amplitude)], axis=0)
        return dense.band_top(self.frequency, score, n, f_min, f_max)

    def predict(self, initial: np.ndarray, n_steps: int, mask: np.ndarray | None = None) -> np.ndarray:
        b = self._inv @ initial * (1 if mask is None else mask)
        return (self.eigvecs @ (b[:, None] * dense.powers(self.eigvals.astype(complex), n_steps + 1))).real

    @property
    def reconstruction(self) -> list[np.ndarray]:
        return [(self.eigvecs @ d).real for d in self.dynamics]

    @property
    def reconstruction_error(self) -> list[np.ndarray]:
        return [d - r for d, r in zip(self.dm, self.reconstruction, strict=True)]


class LinearControlModel:
    """x_(n+1) = A x_n + B g_n by least squares, with its modal solution."""

    def __init__(self, data: np.ndarray, controls: np.ndarray, dt: float):
        if controls.shape[1] != data.shape[1] - 1:
            raise ValueError("one control input less than states is needed")
        self.dm, self.controls, self.dt = data, controls, dt
        ab = data[:, 1:] @ np.linalg.pinv(np.concatenate([data[:, :-1], controls]))
        self.A, self.B = ab[:, : len(data)], ab[:, len(data) :]
        self.eigvals, self.eigvecs = np.linalg.eig(self.A.astype(complex))
        self._inv = np.linalg.pinv(self.eigvecs)

    eigvals_cont = property(lambda self: np.log(self.eigvals) / self.dt)
    frequency = property(lambda self: np.log(self.eigvals).imag / (2 * np.pi * self.dt))
    growth_rate = property(lambda self: np.log(self.eigvals).real / self.dt)
    modes = property(lambda self: self.eigvecs)
    amplitude = property(lambda self: self._inv @ self.dm[:, 0])

    def _forced(self, controls: np.ndarray) -> np.ndarray:
        c = self._inv @ self.B @ controls
        out = np.zeros((len(self.A), controls.shape[1] + 1), complex)
        for n in range(controls.shape[1]):
            out[:, n + 1] = self.eigvals * out[:, n] + c[:, n]
        return out

    @property
    def unforced_dynamics(self) -> np.ndarray:
        return self.amplitude[:, None] * dense.powers(self.eigvals, self.dm.shape[1])

    @property
    def forced_dynamics(self) -> np.ndarray:
        return self._forced(self.controls)

    @property
    def dynamics(self) -> np.ndarray:
        return self.unforced_dynamics + self.forced_dynamics

    def forward(self, x: np.ndarray, controls: np.ndarray, backward: bool = False) -> np.ndarray:
        """States after (or before) x under the controls, one column per control."""
        out = []
        for n in range(controls.shape[1]):
            x = np.linalg.pinv(self.A) @ (x - self.B @ controls[:, n]) if backward else self.A @ x + self.B @ controls[:, n]
            out.append(x)
        return np.array(out).T

    def predict(self, initial: np.ndarray, controls: np.ndarray) -> np.ndarray:
        free = (self._inv @ initial)[:, None] * dense.powers(self.eigvals, controls.shape[1] + 1)
        return (self.eigvecs @ (free + self._forced(controls))).real

    @property
    def reconstruction(self) -> np.ndarray:
        return (self.eigvecs @ self.dynamics).real

    @property
    def reconstruction_error(self) -> np.ndarray:
        return self.dm - self.reconstruction

    @property
    def projection_error(self) -> np.ndarray:
        return self.dm[:, 1:] - (self.A @ self.dm[:, :-1] + self.B @ self.controls)

    @property
    def dft_properties(self) -> tuple[float, float, float]:
        return 1 / self.dt, 0.5 / self.dt, 1 / (self.dt * self.dm.shape[1])

    def train(self, *_args, **_kwargs):
        raise NotImplementedError("the control model is fitted by least squares only")
