"""Reduced-order models: the SVD encoder and the cluster network model."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions import dense
from tidewright.functions.checks import int_larger_than, larger_than, without_repeats
from tidewright.operators.linalg import SVD, Matrix, beside
from tidewright.operators.windows import transitions


class Encoder:
    """What an encoder offers: it is trained on a data matrix, and maps states to fewer numbers and back."""

    @property
    def trained(self) -> bool:
        raise NotImplementedError

    @property
    def state_shape(self) -> int:
        raise NotImplementedError

    @property
    def reduced_state_size(self) -> int:
        raise NotImplementedError

    def train(self, data: Matrix) -> dict:
        raise NotImplementedError

    def encode(self, data: Matrix) -> np.ndarray:
        raise NotImplementedError

    def decode(self, reduced: np.ndarray) -> Matrix:
        raise NotImplementedError

    def check_reduced(self, reduced: np.ndarray) -> np.ndarray:
        """The states as columns; their length must be the reduced size."""
        if reduced.shape[0] != self.reduced_state_size:
            raise ValueError(f"a reduced state has {self.reduced_state_size} numbers, not {reduced.shape[0]}")
        return reduced.reshape(self.reduced_state_size, -1)


class ROM:
    """A model of reduced states with its encoder: predict is encode, predict_reduced, decode."""

    def __init__(self, reduced: np.ndarray, encoder: Encoder):
        if not isinstance(encoder, Encoder):
            raise ValueError("an encoder is needed")
        if not encoder.trained:
            raise ValueError("the encoder must be trained first")
        self.encoder, self.reduced = encoder, encoder.check_reduced(reduced)

    def predict_reduced(self, first: np.ndarray, end: float, step: float, seed: int | None = None) -> np.ndarray:
        raise NotImplementedError

    def predict(self, first: Matrix, end: float, step: float, seed: int | None = None) -> Matrix:
        """From one full state (one column)."""
        if first.n != 1:
            raise ValueError("one initial state is needed")
        return self.encoder.decode(self.predict_reduced(self.encoder.encode(first)[:, 0], end, step, seed))


class SVDEncoder(Encoder):
    """Encode by projection on the left singular vectors, decode by their combination."""

    def __init__(self, rank: int | None = None):
        self.rank = rank
        self.svd: SVD | None = None

    @property
    def trained(self) -> bool:
        return self.svd is not None

    def _need(self) -> SVD:
        if self.svd is None:
            raise ValueError("the encoder must be trained first")
        return self.svd

    def train(self, data: Matrix) -> dict:
        self.svd = SVD(data, self.rank)
        self.back = self.svd.V * dense.safe_inverse(self.svd.s_full)[: self.svd.rank]
        return {"rank": self.svd.rank}

    @property
    def state_shape(self) -> int:
        return self._need().x.rows

    @property
    def reduced_state_size(self) -> int:
        return self._need().rank

    def encode(self, data: Matrix) -> np.ndarray:
        """U^H data, rank x columns."""
        s = self._need()
        if data is s.x:
            return s.coefficients
        n = s.x.n
        both = beside([s.x, data])
        return self.back.conj().T @ both.reduce(lambda x: x[:, :n].conj().T @ x[:, n:], (n, data.n))

    def decode(self, reduced: np.ndarray) -> Matrix:
        return self._need().x.lift(self.back @ self.check_reduced(reduced))


class CNM(ROM):
    """Cluster network model: k-means labels of a reduced trajectory, transition tables, and walks on them."""

    def __init__(self, reduced: np.ndarray, encoder, spark, dt: float, n_clusters: int = 10, model_order: int = 1, seed: int = 0):
        super().__init__(reduced, encoder)
        larger_than(dt, 0.0, "dt")
        int_larger_than(n_clusters, 1, "n_clusters")
        int_larger_than(model_order, 0, "model_order")
        self.dt, self.n_clusters, self.model_order, self.seed = dt, n_clusters, model_order, seed
        # A reduced trajectory is a small array (one state per column of the data matrix), so nothing is distributed here.
        self.spark = spark
        self.cluster_centers, labels = dense.kmeans(np.ascontiguousarray(self.reduced.T, np.float64), n_clusters, seed)
        self.set_labels(labels)

    def set_labels(self, labels: DataFrame | np.ndarray) -> None:
        """Take the cluster sequence: labels in order of time, or a table (t_idx, label), whose tables are made by the cluster."""
        if isinstance(labels, DataFrame):
            self.sequence = without_repeats([r["label"] for r in labels.select("t_idx", "label").orderBy("t_idx").collect()])
            self._ordered()
            rows = transitions(labels.withColumn("_one", F.lit(0)), ["_one"], ["t_idx"], "label", self.model_order, self.dt).collect()
            self.Q: dict[tuple, dict[int, float]] = {}
            self.T: dict[tuple, float] = {}
            for r in sorted(rows, key=lambda r: (list(r["history"]), r["next"])):
                self.Q.setdefault(tuple(r["history"]), {})[r["next"]] = r["p"]
                self.T[(*r["history"], r["next"])] = r["dt"]
        else:
            self.sequence = without_repeats([int(v) for v in labels])
            self._ordered()
            self.Q, self.T = dense.transition_tables(labels, self.model_order, self.dt)
        self.labels = labels

    def _ordered(self) -> None:
        if self.model_order >= len(self.sequence):
            raise ValueError("the model order must be smaller than the number of visited clusters")

    def closest_cluster(self, label: int) -> int:
        """The cluster whose centre is nearest to that of ``label``."""
        d = ((self.cluster_centers - self.cluster_centers[label]) ** 2).sum(axis=1)
        d[label] = np.inf
        return int(np.argmin(d))

    def find_history(self, history: tuple, rng: np.random.Generator) -> tuple:
        """A known history that ends with the longest possible end of ``history``; of several a random one."""
        for k in range(min(len(history), self.model_order), 0, -1):
            fits = [h for h in self.Q if h[-k:] == tuple(history[-k:])]
            if fits:
                return fits[int(rng.integers(len(fits)))]
        raise ValueError("no known history ends with this cluster")

    def walk(self, first: np.ndarray, end: float, seed: int | None = None) -> tuple[list[int], list[float]]:
        """Visited clusters and their times, from the cluster nearest to ``first`` until ``end``."""
        rng = np.random.default_rng(self.seed if seed is None else seed)
        start = int(np.argmin(((self.cluster_centers - first) ** 2).sum(axis=1)))
        ends = {h[-1] for h in self.Q}
        if start not in ends:
            start = self.closest_cluster(start)
        h = self.find_history((start,), rng)
        visited, times = [h[-1]], [0.0]
        while times[-1] < end:
            if h not in self.Q:
                last = self.closest_cluster(h[-1])
                h = self.find_history((*h[:-1], last), rng) if any(x[-1] == last for x in self.Q) else list(self.Q)[int(rng.integers(len(self.Q)))]
            nxt = list(self.Q[h])
            c = nxt[int(rng.choice(len(nxt), p=[self.Q[h][k] for k in nxt]))]
            times.append(times[-1] + self.T[(*h, c)])
            visited.append(c)
            h = (*h[1:], c)
        return visited, times

    def predict_reduced(self, first: np.ndarray, end: float, step: float, seed: int | None = None) -> np.ndarray:
        """Reduced states at 0, step, ... up to ``end``, on splines through the visited centres."""
        larger_than(end, 0.0, "end_time")
        larger_than(step, 0.0, "step_size")
        visited, times = self.walk(np.asarray(first), end, seed)
        at = np.arange(0.0, end + 0.5 * step, step)
        path = self.cluster_centers[visited]
        return np.array([dense.spline(np.array(times), path[:, k], at) for k in range(path.shape[1])])
