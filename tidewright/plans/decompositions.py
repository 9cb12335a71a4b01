"""Queries of the decompositions and models at truncated rank, and their SQL forms (see ``algebra_sql``).

Eigenvalues come without an order of their own, so spectra have no position; moduli that span magnitudes are
given by their logarithm to base ten.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.operators import rom, spectral, trained
from tidewright.operators.dmd import DMD, HODMD, MSSA, PMSSA
from tidewright.operators.linalg import SVD, Matrix
from tidewright.plans import algebra_sql as A
from tidewright.plans.snapshots import SQL as PLAIN
from tidewright.plans.snapshots import _E, _L, _hours, event_matrix, lineitem_matrix, r6, rounded_long


def svd_spectrum(spark, sf):
    """Leading singular values of L and the share of the energy of each."""
    s = SVD(lineitem_matrix(spark, sf), rank=20)
    energy = float(np.trace(s.x.gram()))
    return s.spectrum().select(F.col("k").cast("bigint").alias("k"), r6("s").alias("s"), r6(100 * F.col("s") * F.col("s") / energy).alias("energy"))


def svd_shares(spark, sf):
    """All singular values of E with their share of the sum, by the triangle of a tree of factorings."""
    s = SVD(event_matrix(spark, sf), rank=5, mode="qr")
    return s.spectrum().select(F.col("k").cast("bigint").alias("k"), r6("s").alias("s"), r6("s_rel").alias("s_rel"), r6("s_cum").alias("s_cum"))


def svd_iterated(spark, sf):
    """Leading singular values of L by subspace iteration, which forms no N x N matrix."""
    s = SVD(lineitem_matrix(spark, sf), rank=1, mode="iterate")
    return spark.createDataFrame([(k, round(float(v), 5) + 0.0) for k, v in enumerate(s.s)], "k bigint, s double")


def svd_optimal_rank(spark, sf):
    s = SVD(event_matrix(spark, sf))
    return spark.createDataFrame([(s.opt_rank, s.rank, s.required_memory)], "opt_rank bigint, rank bigint, bytes bigint")


def svd_truncated(spark, sf):
    """L from its five leading vectors."""
    return rounded_long(SVD(lineitem_matrix(spark, sf), rank=5).reconstruct())


def pod_truncated(spark, sf):
    """E encoded to two numbers per state and decoded."""
    x = event_matrix(spark, sf)
    e = rom.SVDEncoder(rank=2)
    e.train(x)
    return rounded_long(e.decode(e.encode(x)))


def _modes(made: DataFrame) -> DataFrame:
    """A spectrum in a form that does not depend on the order or the scale of eigenvectors."""
    return made.select(r6("re").alias("re"), r6("im").alias("im"), r6(F.abs("frequency")).alias("frequency"), r6("growth_rate").alias("growth_rate"), F.round(F.log10("amplitude"), 5) + F.lit(0.0), F.round(F.log10("integral"), 5) + F.lit(0.0)).toDF("re", "im", "frequency", "growth_rate", "log_amplitude", "log_integral")


def dmd_spectrum(spark, sf):
    return _modes(DMD(lineitem_matrix(spark, sf), 1.0, rank=4).spectrum())


def dmd_tlsq(spark, sf):
    """Total least squares: both halves projected on their common leading directions first."""
    return _modes(DMD(lineitem_matrix(spark, sf), 1.0, rank=3, tlsq=True).spectrum())


def dmd_unitary(spark, sf):
    """Eigenvalues of the best unitary operator."""
    d = DMD(lineitem_matrix(spark, sf), 1.0, rank=4, unitary=True)
    return spark.createDataFrame([(round(float(v.real), 6) + 0.0, round(float(v.imag), 6) + 0.0) for v in d.eigvals], "re double, im double")


def dmd_ensemble(spark, sf):
    """One operator for two stretches of L."""
    x = lineitem_matrix(spark, sf)
    a = Matrix(x.df.select("row_id", F.slice("re", 1, 40).alias("re")), 40)
    b = Matrix(x.df.select("row_id", F.slice("re", 41, x.n - 40).alias("re")), x.n - 40)
    return DMD([a, b], 1.0, rank=4).spectrum().select(r6("re").alias("re"), r6("im").alias("im"), r6("growth_rate").alias("growth_rate"))


def dmd_forward_backward(spark, sf):
    """The consistent operator of the leading direction: a root of a polynomial of fourth degree."""
    d = DMD(lineitem_matrix(spark, sf), 1.0, rank=1, forward_backward=True)
    last = d.fb_log[-1]
    return spark.createDataFrame([(round(float(d.eigvals[0].real), 6) + 0.0, round(last["forward"], 6) + 0.0, round(last["backward"], 6) + 0.0)], "eigenvalue double, forward double, backward double")


def dmd_reconstruct(spark, sf):
    return rounded_long(DMD(lineitem_matrix(spark, sf), 1.0, rank=4).reconstruction)


def dmd_optimal_amplitudes(spark, sf):
    """The first state that fits all times best."""
    x = DMD(lineitem_matrix(spark, sf), 1.0, rank=4, optimal=True).reconstruction.long()
    return x.where("k = 0").select("row_id", r6("value").alias("value"))


def dmd_top_modes(spark, sf):
    """The modes of frequency zero or more by their integral contribution."""
    d = DMD(lineitem_matrix(spark, sf), 1.0, rank=4)
    top = d.top_modes(3, integral=True, f_min=0.0)
    return spark.createDataFrame([(i, round(abs(float(d.frequency[k])), 6) + 0.0, round(float(d.growth_rate[k]), 6) + 0.0) for i, k in enumerate(top)], "place bigint, frequency double, growth_rate double")


def dmd_projection(spark, sf):
    """Squares of the projection error per time."""
    e = DMD(lineitem_matrix(spark, sf), 1.0, rank=4).projection_error
    return e.long().groupBy(F.col("k").cast("bigint").alias("k")).agg((F.round(F.log10(F.sum(F.col("value") ** 2)), 6) + F.lit(0.0)).alias("log_error"))


def hodmd_spectrum(spark, sf):
    return _modes(HODMD(lineitem_matrix(spark, sf), 1.0, delay=5, rank_dr=2, rank=4).spectrum())


def mssa_denoised(spark, sf):
    return rounded_long(MSSA(event_matrix(spark, sf), 10, rank=3).reconstruction)


def pmssa_reconstruct(spark, sf):
    return rounded_long(PMSSA(event_matrix(spark, sf), 10, rank=2).reconstruction)


def spod_spectrum(spark, sf):
    """Both eigenvalues per bin of L with two tapers."""
    s = spectral.AMSPOD(lineitem_matrix(spark, sf), 1.0, adaptive=False, max_tapers=2, keep_n_modes=2).spectrum()
    return s.select(F.col("bin").cast("bigint").alias("bin"), r6("frequency").alias("frequency"), r6(F.col("eigvals")[0]).alias("first"), r6(F.col("eigvals")[1]).alias("second"))


def spod_top_modes(spark, sf):
    """The bin of the largest first eigenvalue in each of five segments of equal width in log frequency."""
    s = spectral.AMSPOD(lineitem_matrix(spark, sf), 1.0, adaptive=False, max_tapers=2, keep_n_modes=2)
    return spark.createDataFrame([(i, int(k)) for i, k in enumerate(s.top_modes(5))], "segment bigint, bin bigint")


def pamspod_spectrum(spark, sf):
    """The same of the two leading coefficients of E."""
    s = spectral.PAMSPOD(event_matrix(spark, sf), 1.0, rank=2, adaptive=False, max_tapers=2, keep_n_modes=2).spectrum()
    return s.select(F.col("bin").cast("bigint").alias("bin"), r6(F.col("eigvals")[0]).alias("first"), r6(F.col("eigvals")[1]).alias("second"))


def amps_adaptive(spark, sf):
    """Tapers chosen per bin."""
    a = spectral.multitaper_power(event_matrix(spark, sf).df, 1.0, max_tapers=10, tolerance=1e-2)
    return a.select("row_id", F.col("bin").cast("bigint").alias("bin"), F.col("n_tapers").cast("bigint").alias("n_tapers"), r6("power").alias("power"))


def optdmd_training(spark, sf):
    """The loss before the first step, and that training lowers it."""
    m = trained.OptDMD(event_matrix(spark, sf), 1.0, rank=1)
    log = m.train(epochs=60, lr=1e-3)
    return spark.createDataFrame([(round(log["train_loss"][0], 6) + 0.0, log["train_loss"][-1] < log["train_loss"][0])], "first_loss double, lower boolean")


def linear_model(spark, sf):
    """Least-squares operator of the two leading coefficients of L: its spectrum and its loss on the training pairs."""
    z = SVD(lineitem_matrix(spark, sf), rank=2).coefficients
    m = trained.LinearModel(z / np.abs(z).max(), 1.0, init_forward_backward=False)
    start = sorted((round(float(v.real), 6) + 0.0, round(float(v.imag), 6) + 0.0) for v in m.eigvals.astype(complex))
    loss = m.train(epochs=1)["train_loss"][0]
    return spark.createDataFrame([(k, *v, round(loss, 6) + 0.0) for k, v in enumerate(start)], "k bigint, re double, im double, first_loss double")


def linear_control_model(spark, sf):
    """Projection error of three rows of E with the other two as controls."""
    x = event_matrix(spark, sf).numpy()
    m = trained.LinearControlModel(x[:3], x[3:, :-1], 1.0)
    return spark.createDataFrame([(i, j, round(float(v), 6) + 0.0) for (i, j), v in np.ndenumerate(m.projection_error)], "i bigint, j bigint, value double")


def _two_clusters(spark, sf) -> tuple[rom.SVDEncoder, np.ndarray, rom.CNM]:
    x = event_matrix(spark, sf)
    enc = rom.SVDEncoder(rank=1)
    enc.train(x)
    z = enc.encode(x)
    return enc, z, rom.CNM(z, enc, spark, 1.0, n_clusters=2)


def kmeans_transitions(spark, sf):
    """Cluster network model of the leading coefficient of E: between which centres, how often and how fast."""
    _, _, c = _two_clusters(spark, sf)
    centre = lambda k: round(abs(float(c.cluster_centers[k, 0])), 3) + 0.0
    rows = [(centre(h[0]), centre(k), round(float(p), 6) + 0.0, round(float(c.T[(*h, k)]), 6) + 0.0) for h, q in c.Q.items() for k, p in q.items()]
    return spark.createDataFrame(rows, "centre double, next_centre double, p double, dt double")


def cnm_prediction(spark, sf):
    """The states that the model visits from the first state on, decoded; with two clusters no step is left to chance."""
    enc, z, c = _two_clusters(spark, sf)
    visited, times = c.walk(z[:, 0], 10.0)
    at = spark.createDataFrame([(k, round(t, 6)) for k, t in enumerate(times)], "k int, time double")
    return enc.decode(c.cluster_centers[visited].T).long().join(F.broadcast(at), "k").select("row_id", F.col("k").cast("bigint").alias("k"), "time", F.round("value", 4).alias("value"))


def hodmd_reconstruct(spark, sf):
    x = HODMD(lineitem_matrix(spark, sf), 1.0, delay=5, rank_dr=2, rank=4).reconstruction.long()
    return x.withColumn("value", F.round("value", 2) + F.lit(0.0))  # what the delays' inner products leave exact in either way


def dmd_predict(spark, sf):
    """Five steps from the last state on."""
    x = lineitem_matrix(spark, sf)
    last = Matrix(x.df.select("row_id", F.slice("re", -1, 1).alias("re")), 1)
    return rounded_long(DMD(x, 1.0, rank=4).predict(last, 5))


def dmd_partial(spark, sf):
    """What the real mode of largest eigenvalue contributes."""
    d = DMD(lineitem_matrix(spark, sf), 1.0, rank=4)
    real = np.where(np.abs(d.eigvals.imag) < 1e-9, d.eigvals.real, -np.inf)
    return rounded_long(d.partial_reconstruction({int(real.argmax())}))


def dmd_errors(spark, sf):
    """Squares of the reconstruction error per time."""
    e = DMD(lineitem_matrix(spark, sf), 1.0, rank=4).reconstruction_error
    return e.long().groupBy(F.col("k").cast("bigint").alias("k")).agg((F.round(F.log10(F.sum(F.col("value") ** 2)), 6) + F.lit(0.0)).alias("log_error"))


def linear_control_predict(spark, sf):
    """The modal solution of the control model over all times."""
    x = event_matrix(spark, sf).numpy()
    m = trained.LinearControlModel(x[:3], x[3:, :-1], 1.0)
    return spark.createDataFrame([(i, j, round(float(v), 5) + 0.0) for (i, j), v in np.ndenumerate(m.predict(x[:3, 0], x[3:, :-1]))], "i bigint, j bigint, value double")


def dft_partial(spark, sf):
    """E from the first and the fourth of its bins."""
    return rounded_long(spectral.DFT(event_matrix(spark, sf), 1.0).partial_reconstruction({0, 3}))


def pdft_amplitude(spark, sf):
    """Amplitudes of the two leading coefficients, per point of E."""
    p = spectral.PDFT(event_matrix(spark, sf), 1.0, rank=2)
    return spark.createDataFrame([(k + 1, round(float(v), 6) + 0.0) for k, v in enumerate(p.amplitude)], "bin bigint, amplitude double")


def amps_top_power(spark, sf):
    """The five bins of most power of the hourly signal in a band."""
    a = spectral.AMPS(_hours(spark, sf).numpy()[0], 1.0, adaptive=False, max_tapers=4)
    return spark.createDataFrame([(i, int(k)) for i, k in enumerate(a.top_power(5, 0.01, 0.3))], "place bigint, bin bigint")


QUERIES = {
    f.__name__: f
    for f in (
        hodmd_reconstruct, dmd_predict, dmd_partial, dmd_errors, linear_control_predict, dft_partial, pdft_amplitude, amps_top_power, svd_spectrum, svd_shares, svd_iterated, svd_optimal_rank, svd_truncated, pod_truncated, dmd_spectrum, dmd_tlsq, dmd_unitary, dmd_ensemble, dmd_forward_backward, dmd_reconstruct, dmd_optimal_amplitudes, dmd_top_modes,
        dmd_projection, hodmd_spectrum, mssa_denoised, pmssa_reconstruct, spod_spectrum, spod_top_modes, pamspod_spectrum, amps_adaptive, optdmd_training, linear_model, linear_control_model, kmeans_transitions, cnm_prediction,
    )
}


def _gram(name: str) -> str:
    """G: one row with the Gram matrix over the times of table ``name``."""
    return f"gt AS (SELECT a.k AS i, b.k AS j, sum(a.value * b.value) AS v FROM {name} a JOIN {name} b ON a.row_id = b.row_id GROUP BY a.k, b.k), {A.as_lists('G', 'gt', 'i', 'j', 'v')}"


_ONE = "range(1, len(m))"


def _reduced(rank: int, one: str = _ONE, tlsq: int | None = None, source: str = "G") -> str:
    """red: the reduced operator a, the inner products of the modes' basis (gram) and the first state in it (q); w is
    the basis, rows over the first columns of each pair."""
    pick = lambda a, b: A.entries("len(one)", f"m[one[{{i}}] + {a}][one[{{j}}] + {b}]")
    out = f"pairs AS (SELECT m, {one} AS one FROM {source}), halves AS (SELECT m, one, {pick(0, 0)} AS m11, {pick(0, 1)} AS m12, {pick(1, 1)} AS m22, {A.vector('len(one)', 'm[one[{i}] + 1][1]')} AS m20 FROM pairs)"
    h = "halves"
    if tlsq:
        total = A.entries("len(m11)", "m11[{i}][{j}] + m22[{i}][{j}]")
        side = lambda x: A.times_transposed(A.times_transposed("p", A.transpose(x)), "p")
        out += f", joint AS (SELECT {total} AS m FROM halves), {A.eigen('noise', 'joint', tlsq)}, proj AS (SELECT {A.times_transposed(A.transpose('vecs'), A.transpose('vecs'))} AS p FROM noise)"
        out += f", clean AS (SELECT {side('m11')} AS m11, {side('m12')} AS m12, {side('m22')} AS m22, {A.times_vector('p', 'm20')} AS m20 FROM halves CROSS JOIN proj)"
        h = "clean"
    out += f", first AS (SELECT m11 AS m FROM {h}), {A.eigen('ev', 'first', rank)}, basis AS (SELECT list_transform(range(1, len(vecs) + 1), lambda ba: list_transform(vecs[ba], lambda bx: bx / sqrt(vals[ba]))) AS w FROM ev)"
    out += f", made AS (SELECT w, {A.times_transposed(A.times_transposed('w', A.transpose('m12')), 'w')} AS a, {A.times_transposed(A.times_transposed('w', A.transpose('m22')), 'w')} AS gram, {A.times_vector('w', 'm20')} AS rhs FROM {h} CROSS JOIN basis)"
    return out + f", gm AS (SELECT gram AS m FROM made), {A.inverse('gi', 'gm')}, red AS (SELECT w, a, gram, rhs, {A.times_vector('x', 'rhs')} AS q FROM made CROSS JOIN gi)"


def _form(gram: str) -> str:
    """c^H gram c of the lists cr and ci."""
    return f"(list_dot_product(cr, {A.times_vector(gram, 'cr')}) + list_dot_product(ci, {A.times_vector(gram, 'ci')}))"


def _mode_rows(times: str, gram: str = "gram") -> str:
    """parts: per eigenvalue its amplitude and integral contribution over the times."""
    size = "(list_dot_product(cr, cr) + list_dot_product(ci, ci))"
    # A share of the first state is amplitude times mode; unit eigenvectors make its length the amplitude.
    powers = f"list_sum(list_transform(range(0, {times}), lambda pt: pow(sqrt(re * re + im * im), pt)))"
    return f"{A.spectrum('sp', 'red')}, {A.shares('sh', 'red', 'sp')}, parts AS (SELECT re, im, sqrt{size} AS amplitude, {_form(gram)} / sqrt{size} * {powers} AS integral FROM sh CROSS JOIN red)"


_SPECTRUM = "SELECT round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im, round(abs(atan2(im, re) / (2 * pi())), 6) + 0.0 AS frequency, round(ln(sqrt(re * re + im * im)), 6) + 0.0 AS growth_rate, round(log10(amplitude), 5) + 0.0 AS log_amplitude, round(log10(integral), 5) + 0.0 AS log_integral FROM parts"


def _states(table: str, start: str, value: str) -> str:
    """basis rows over the points, states over the times and their products."""
    return f"""br AS (SELECT t.row_id, list_transform(w, lambda wr: list_dot_product(wr, t.x[2:])) AS b FROM (SELECT row_id, list(value ORDER BY k) AS x FROM {table} GROUP BY row_id) t CROSS JOIN red)
, st AS (SELECT 0 AS k, a, {start} AS z FROM red UNION ALL SELECT k + 1, a, {A.times_vector("a", "z")} FROM st WHERE k + 1 <= (SELECT max(k) FROM {table}))
SELECT br.row_id, {value}"""


_RANK2 = "z2 AS (SELECT list_transform(range(1, 3), lambda za: list_transform(vecs[za], lambda zx: zx * sqrt(vals[za]))) AS z FROM ev)"


def _taper2(rows: str, n: str) -> str:
    """tw: per bin the Hermitian 2 x 2 matrix of two tapers over the rows (row_id, k, v) of ``rows``; eigenvalues in te."""
    return f"""tn AS (SELECT max(k) + 1 AS n FROM {rows}),
tq AS (SELECT row_id, b, any_value(n) AS n, sum(v * cos(pi() * b * k / n)) AS re, -sum(v * sin(pi() * b * k / n)) AS im FROM {rows} CROSS JOIN tn CROSS JOIN (SELECT unnest(range(-2, {n})) AS b) GROUP BY row_id, b),
tp AS (SELECT f.f, j.j, a.row_id, a.n, sqrt(6.0 * (4 - (j.j - 1) * (j.j - 1)) / (2 * 7 * 3) * 2 / (a.n + 1) / 4 / (2 * a.n)) * (a.re - c.re) AS re, sqrt(6.0 * (4 - (j.j - 1) * (j.j - 1)) / (2 * 7 * 3) * 2 / (a.n + 1) / 4 / (2 * a.n)) * (a.im - c.im) AS im
  FROM (SELECT unnest(range(0, {n})) AS f) f CROSS JOIN (SELECT unnest(range(1, 3)) AS j) j JOIN tq a ON a.b = 2 * f.f - j.j JOIN tq c ON c.b = 2 * f.f + j.j AND c.row_id = a.row_id WHERE f.f <= a.n // 2),
tw AS (SELECT x.f, any_value(x.n) AS n, sum(x.re * x.re + x.im * x.im) AS p, sum(y.re * y.re + y.im * y.im) AS q, sum(x.re * y.re + x.im * y.im) AS r, sum(x.re * y.im - x.im * y.re) AS s FROM tp x JOIN tp y ON x.f = y.f AND x.row_id = y.row_id AND x.j = 1 AND y.j = 2 GROUP BY x.f),
te AS (SELECT f, n, 2 * CASE WHEN f = 0 OR 2 * f = n THEN 1 ELSE 2 END AS scale, (p + q) / 2 AS mid, sqrt((p - q) * (p - q) / 4 + r * r + s * s) AS half FROM tw)"""


_CENTRED = "cl AS (SELECT row_id, k, value - avg(value) OVER (PARTITION BY row_id) AS v FROM {})"
_ROWS_E = f"ge AS (SELECT a.row_id AS i, b.row_id AS j, sum(a.value * b.value) AS v FROM E a JOIN E b ON a.k = b.k GROUP BY ALL), {A.as_lists('G', 'ge', 'i', 'j', 'v')}"
_SMOOTH = f"""hs AS (SELECT m, len(m) AS n, 10 AS w FROM G), hg AS (SELECT n, {A.entries("10", "list_sum(list_transform(range(0, n - 9), lambda hx: m[{i} + hx][{j} + hx]))")} AS m FROM hs)"""
_BACK = f"""pm AS (SELECT {A.times_transposed(A.transpose("vecs"), A.transpose("vecs"))} AS p FROM ev),
sm AS (SELECT s.s, t.t, sum(p[s.s - o.o][t.t - o.o]) / (SELECT count(*) FROM range(0, 1000) AS c(o) WHERE t.t - o BETWEEN 1 AND 10 AND o < (SELECT n - 9 FROM hs)) AS r
  FROM pm CROSS JOIN (SELECT unnest(range(1, (SELECT n FROM hs) + 1)) AS s) s CROSS JOIN (SELECT unnest(range(1, (SELECT n FROM hs) + 1)) AS t) t CROSS JOIN (SELECT unnest(range(0, (SELECT n - 9 FROM hs))) AS o) o
  WHERE s.s - o.o BETWEEN 1 AND 10 AND t.t - o.o BETWEEN 1 AND 10 GROUP BY s.s, t.t)"""
_CLUSTERS = f"""z AS (SELECT unnest(range(len(vecs[1]))) AS k, unnest(list_transform(vecs[1], lambda cz: abs(cz) * sqrt(vals[1]))) AS z FROM ev),
so AS (SELECT z, row_number() OVER (ORDER BY z) AS i, count(*) OVER () AS n, sum(z) OVER (ORDER BY z ROWS UNBOUNDED PRECEDING) AS s, sum(z) OVER () AS t FROM z),
cut AS (SELECT z AS edge, s / i AS low, (t - s) / (n - i) AS high FROM so WHERE i < n ORDER BY -s * s / i - (t - s) * (t - s) / (n - i) LIMIT 1),
lb AS (SELECT k, CASE WHEN z <= edge THEN low ELSE high END AS c FROM z CROSS JOIN cut),
nw AS (SELECT *, CASE WHEN c = lag(c) OVER (ORDER BY k) THEN 0 ELSE 1 END AS new FROM lb),
rn AS (SELECT sum(new) OVER (ORDER BY k) AS run, c FROM nw), ru AS (SELECT run, any_value(c) AS c, count(*) AS n FROM rn GROUP BY run),
tr AS (SELECT c, lead(c) OVER (ORDER BY run) AS nx, 0.5 * (n + lead(n) OVER (ORDER BY run)) AS dt FROM ru),
qt AS (SELECT c, nx, count(*) AS n, avg(dt) AS dt FROM tr WHERE nx IS NOT NULL GROUP BY c, nx)"""
_W = "WITH RECURSIVE "

SQL = {
    "svd_spectrum": f"{_W}{_L}, {_gram('L')}, {A.eigen('ev', 'G', 20)}, ks AS (SELECT unnest(range(len(vals))) AS k, unnest(vals) AS val FROM ev) SELECT k, round(sqrt(val), 6) + 0.0 AS s, round(100 * val / (SELECT {A.trace('m')} FROM G), 6) + 0.0 AS energy FROM ks WHERE k < (SELECT count(DISTINCT row_id) FROM L)",
    "svd_shares": f"{_W}{_E}, {_ROWS_E}, {A.eigen('ev', 'G', 5)}, ks AS (SELECT unnest(range(len(vals))) AS k, unnest(list_transform(vals, lambda sv: sqrt(sv))) AS s FROM ev) SELECT k, round(s, 6) + 0.0 AS s, round(100 * s / sum(s) OVER (), 6) + 0.0 AS s_rel, round(100 * sum(s) OVER (ORDER BY k) / sum(s) OVER (), 6) + 0.0 AS s_cum FROM ks",
    "svd_iterated": f"{_W}{_L}, {_gram('L')}, {A.eigen('ev', 'G', 1)} SELECT CAST(0 AS BIGINT) AS k, round(sqrt(vals[1]), 5) + 0.0 AS s FROM ev",
    "svd_optimal_rank": f"""{_W}{_E}, {_ROWS_E}, {A.eigen('ev', 'G', 5)}, n AS (SELECT max(k) + 1 AS n FROM E), ks AS (SELECT unnest(range(1, len(vals) + 1)) AS i, unnest(list_transform(vals, lambda sv: sqrt(sv))) AS s FROM ev),
tau AS (SELECT (0.56 * pow(5.0 / n, 3) - 0.95 * pow(5.0 / n, 2) + 1.82 * 5.0 / n + 1.43) * (SELECT s FROM ks WHERE i = 3) AS tau FROM n),
near AS (SELECT CASE WHEN s > tau THEN i ELSE i - 1 END AS r FROM ks CROSS JOIN tau ORDER BY abs(s - tau), i LIMIT 1)
SELECT CAST(r AS BIGINT) AS opt_rank, CAST(greatest(1, r) AS BIGINT) AS rank, CAST(8 * greatest(1, r) * (5 + n) + 8 * greatest(1, r) AS BIGINT) AS bytes FROM near CROSS JOIN n""",
    "svd_truncated": f"""{_W}{_L}, {_gram('L')}, {A.eigen('ev', 'G', 5)}, xs AS (SELECT row_id, list(value ORDER BY k) AS x FROM L GROUP BY row_id),
xc AS (SELECT row_id, list_transform(vecs, lambda tv: list_dot_product(tv, x)) AS c, vecs FROM xs CROSS JOIN ev), xt AS (SELECT unnest(range((SELECT max(k) + 1 FROM L))) AS k)
SELECT row_id, CAST(t.k AS INTEGER) AS k, round(list_dot_product(c, list_transform(vecs, lambda tv: tv[t.k + 1])), 6) + 0.0 AS value FROM xc CROSS JOIN xt t""",
    "pod_truncated": f"""{_W}{_E}, {_gram('E')}, {A.eigen('ev', 'G', 2)}, xs AS (SELECT row_id, list(value ORDER BY k) AS x FROM E GROUP BY row_id),
xc AS (SELECT row_id, list_transform(vecs, lambda tv: list_dot_product(tv, x)) AS c, vecs FROM xs CROSS JOIN ev), xt AS (SELECT unnest(range((SELECT max(k) + 1 FROM E))) AS k)
SELECT row_id, CAST(t.k AS INTEGER) AS k, round(list_dot_product(c, list_transform(vecs, lambda tv: tv[t.k + 1])), 6) + 0.0 AS value FROM xc CROSS JOIN xt t""",
    "dmd_spectrum": f"{_W}{_L}, {_gram('L')}, {_reduced(4)}, {_mode_rows('(SELECT max(k) + 1 FROM L)')} {_SPECTRUM}",
    "dmd_tlsq": f"{_W}{_L}, {_gram('L')}, {_reduced(3, tlsq=3)}, {_mode_rows('(SELECT max(k) + 1 FROM L)')} {_SPECTRUM}",
    "dmd_unitary": f"""{_W}{_L}, {_gram('L')}, {_reduced(4)}, un AS (SELECT list_transform(range(1, 5), lambda ua: list_transform(range(1, 5), lambda ub: a[ua][ub] * vals[ub])) AS m FROM red CROSS JOIN ev), {A.polar('po', 'un')}, {A.spectrum('sp', 'po')} SELECT round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im FROM sp""",
    "dmd_ensemble": f"{_W}{_L}, {_gram('L')}, {_reduced(4, one='list_concat(range(1, 40), range(41, len(m)))')}, {A.spectrum('sp', 'red')} SELECT round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im, round(ln(sqrt(re * re + im * im)), 6) + 0.0 AS growth_rate FROM sp",
    "dmd_forward_backward": f"""{_W}{_L}, {_gram('L')}, {_reduced(1)}, sc AS (SELECT vals[1] AS p, a[1][1] * vals[1] AS c, list_dot_product({A.times_vector("m12t", "w[1]")}, {A.times_vector("m12t", "w[1]")}) AS q FROM red CROSS JOIN ev CROSS JOIN (SELECT {A.transpose("m12")} AS m12t FROM halves)),
nt AS (SELECT 0 AS k, p, c, q, c / p AS x FROM sc UNION ALL SELECT k + 1, p, c, q, x - (p * pow(x, 4) - c * pow(x, 3) + c * x - q) / (4 * p * pow(x, 3) - 3 * c * x * x + c) FROM nt WHERE k < 60)
SELECT round(x, 6) + 0.0 AS eigenvalue, round(sqrt((x * x * p - 2 * x * c + q) / q), 6) + 0.0 AS forward, round(sqrt((q / (x * x) - 2 * c / x + p) / p), 6) + 0.0 AS backward FROM nt WHERE k = 60""",
    "dmd_reconstruct": f"{_W}{_L}, {_gram('L')}, {_reduced(4)}, {_states('L', 'q', 'st.k, round(list_dot_product(br.b, st.z), 6) + 0.0 AS value FROM br CROSS JOIN st')}",
    "dmd_optimal_amplitudes": f"""{_W}{_L}, {_gram('L')}, {_reduced(4)}, pw AS (SELECT 0 AS k, a, {A.entries("4", "CASE WHEN {i} = {j} THEN 1 ELSE 0 END")} AS p FROM red UNION ALL SELECT k + 1, a, {A.times_transposed("p", A.transpose("a"))} FROM pw WHERE k + 1 < (SELECT max(k) FROM L)),
tp AS (SELECT {A.transpose("p")} AS pt, gram, {A.times_vector("w", A.vector("len(one)", "m[one[{i}] + 1][k + 1]"))} AS bx FROM pw CROSS JOIN (SELECT w, gram FROM red) CROSS JOIN halves),
te AS (SELECT {A.times_transposed(A.times_transposed("pt", "gram"), "pt")} AS e, {A.times_vector("pt", "bx")} AS r FROM tp),
sm AS (SELECT list(v ORDER BY i) AS m FROM (SELECT i, list(v ORDER BY j) AS v FROM (SELECT i.i, j.j, sum(e[i.i][j.j]) AS v FROM te CROSS JOIN range(1, 5) AS i(i) CROSS JOIN range(1, 5) AS j(j) GROUP BY i.i, j.j) GROUP BY i)),
rh AS (SELECT list(v ORDER BY i) AS r FROM (SELECT i.i, sum(r[i.i]) AS v FROM te CROSS JOIN range(1, 5) AS i(i) GROUP BY i.i)), {A.inverse('oi', 'sm', 120)},
br AS (SELECT t.row_id, list_transform(w, lambda wr: list_dot_product(wr, t.x[2:])) AS b FROM (SELECT row_id, list(value ORDER BY k) AS x FROM L GROUP BY row_id) t CROSS JOIN red)
SELECT row_id, round(list_dot_product(b, {A.times_vector("x", "r")}), 6) + 0.0 AS value FROM br CROSS JOIN oi CROSS JOIN rh""",
    "dmd_top_modes": f"{_W}{_L}, {_gram('L')}, {_reduced(4)}, {_mode_rows('(SELECT max(k) + 1 FROM L)')}, up AS (SELECT *, row_number() OVER (ORDER BY integral DESC) - 1 AS place FROM parts WHERE im > -1e-9) SELECT place, round(abs(atan2(im, re) / (2 * pi())), 6) + 0.0 AS frequency, round(ln(sqrt(re * re + im * im)), 6) + 0.0 AS growth_rate FROM up WHERE place < 3",
    "dmd_projection": f"""{_W}{_L}, {_gram('L')}, {_reduced(4)}, co AS (SELECT t.t, {A.times_vector("a", A.times_vector("x", A.times_vector("w", A.vector("len(one)", "m[one[{i}] + 1][t.t]"))))} AS z, {A.times_vector("w", A.vector("len(one)", "m[one[{i}] + 1][t.t + 1]"))} AS nb, gram, m[t.t + 1][t.t + 1] AS nn
  FROM red CROSS JOIN gi CROSS JOIN halves CROSS JOIN (SELECT unnest(range(1, (SELECT max(k) + 1 FROM L))) AS t) t)
SELECT CAST(t - 1 AS BIGINT) AS k, round(log10(list_dot_product(z, {A.times_vector("gram", "z")}) - 2 * list_dot_product(z, nb) + nn), 6) + 0.0 AS log_error FROM co""",
    "dmd_errors": f"""{_W}{_L}, {_gram('L')}, {_reduced(4)}, st AS (SELECT 0 AS k, a, q AS z FROM red UNION ALL SELECT k + 1, a, {A.times_vector("a", "z")} FROM st WHERE k + 1 <= (SELECT max(k) FROM L)),
co AS (SELECT k, z, gram, {A.times_vector("w", A.vector("len(one)", "m[one[{i}] + 1][k + 1]"))} AS nb, m[k + 1][k + 1] AS nn FROM st CROSS JOIN (SELECT w, gram FROM red) CROSS JOIN halves)
SELECT CAST(k AS BIGINT) AS k, round(log10(list_dot_product(z, {A.times_vector("gram", "z")}) - 2 * list_dot_product(z, nb) + nn), 6) + 0.0 AS log_error FROM co""",
    "dmd_predict": f"""{_W}{_L}, {_gram('L')}, {_reduced(4)}, fs AS (SELECT {A.times_vector("x", A.times_vector("w", A.vector("len(one)", "m[one[{i}] + 1][len(m)]")))} AS z, a FROM red CROSS JOIN gi CROSS JOIN halves),
br AS (SELECT t.row_id, list_transform(w, lambda wr: list_dot_product(wr, t.x[2:])) AS b FROM (SELECT row_id, list(value ORDER BY k) AS x FROM L GROUP BY row_id) t CROSS JOIN red),
st AS (SELECT 0 AS k, a, z FROM fs UNION ALL SELECT k + 1, a, {A.times_vector("a", "z")} FROM st WHERE k < 5) SELECT br.row_id, st.k, round(list_dot_product(br.b, st.z), 6) + 0.0 AS value FROM br CROSS JOIN st""",
    "dmd_partial": f"""{_W}{_L}, {_gram('L')}, {_reduced(4)}, {A.spectrum('sp', 'red')}, {A.shares('sh', 'red', 'sp')}, one1 AS (SELECT re, cr FROM sh WHERE abs(im) < 1e-9 ORDER BY re DESC LIMIT 1),
br AS (SELECT t.row_id, list_transform(w, lambda wr: list_dot_product(wr, t.x[2:])) AS b FROM (SELECT row_id, list(value ORDER BY k) AS x FROM L GROUP BY row_id) t CROSS JOIN red)
SELECT br.row_id, CAST(s.k AS INTEGER) AS k, round(list_dot_product(br.b, one1.cr) * pow(one1.re, s.k), 6) + 0.0 AS value FROM br CROSS JOIN one1 CROSS JOIN (SELECT unnest(range((SELECT max(k) + 1 FROM L))) AS k) s""",
    "hodmd_reconstruct": f"""{_W}{_L}, {_gram('L').replace('G AS', 'G0 AS')}, {A.eigen('dr', 'G0', 2)}, zz AS (SELECT {A.entries("len(vecs[1])", "vals[1] * vecs[1][{i}] * vecs[1][{j}] + vals[2] * vecs[2][{i}] * vecs[2][{j}]")} AS z FROM dr),
hk AS (SELECT {A.entries("len(z) - 4", "list_sum(list_transform(range(0, 5), lambda hx: z[{i} + hx][{j} + hx]))")} AS m FROM zz), {_reduced(4, source='hk')},
fa AS (SELECT list_transform(range(1, 3), lambda fx: list_transform(w, lambda fw: list_sum(list_transform(range(1, len(fw) + 1), lambda fi: fw[fi] * sqrt(vals[fx]) * vecs[fx][fi + 1])))) AS f FROM red CROSS JOIN dr),
ur AS (SELECT row_id, list_transform(range(1, 3), lambda ux: list_dot_product(x, vecs[ux]) / sqrt(vals[ux])) AS u FROM (SELECT row_id, list(value ORDER BY k) AS x FROM L GROUP BY row_id) CROSS JOIN dr),
st AS (SELECT 0 AS k, a, q AS z FROM red UNION ALL SELECT k + 1, a, {A.times_vector("a", "z")} FROM st WHERE k + 1 <= (SELECT max(k) FROM L))
SELECT ur.row_id, st.k, round(list_dot_product(ur.u, {A.times_vector("fa.f", "st.z")}), 2) + 0.0 AS value FROM ur CROSS JOIN st CROSS JOIN fa""",
    "linear_control_predict": f"""{_W}{_E}, x AS (SELECT list(x ORDER BY row_id) AS x FROM (SELECT row_id, list(value ORDER BY k) AS x FROM E GROUP BY row_id)), h AS (SELECT x, list_transform(x, lambda ca: ca[1:len(ca) - 1]) AS z, list_transform(x[1:3], lambda cb: cb[2:]) AS y FROM x),
zz AS (SELECT {A.times_transposed("z", "z")} AS m FROM h), {A.inverse('zi', 'zz', 120)}, fit AS (SELECT h.x AS data, {A.times_transposed(A.times_transposed("y", "z"), "zi.x")} AS ab FROM h CROSS JOIN zi),
st AS (SELECT 0 AS j, data, ab, list_transform(data[1:3], lambda sa: sa[1]) AS s FROM fit UNION ALL SELECT j + 1, data, ab, {A.times_vector("ab", "list_concat(s, [data[4][j + 1], data[5][j + 1]])")} FROM st WHERE j + 1 < len(data[1]))
SELECT i.i, CAST(j AS BIGINT) AS j, round(s[i.i + 1], 5) + 0.0 AS value FROM st CROSS JOIN range(0, 3) AS i(i)""",
    "dft_partial": f"""WITH {_E}, {_CENTRED.format('E')}, n AS (SELECT max(k) + 1 AS n FROM E), q AS (SELECT row_id, b.b, sum(v * cos(2 * pi() * b.b * k / n)) AS re, -sum(v * sin(2 * pi() * b.b * k / n)) AS im FROM cl CROSS JOIN n CROSS JOIN (SELECT unnest([1, 4]) AS b) b GROUP BY row_id, b.b)
SELECT q.row_id, t.k, round(sum(2 / n * (q.re * cos(2 * pi() * q.b * t.k / n) - q.im * sin(2 * pi() * q.b * t.k / n))), 6) + 0.0 AS value FROM q CROSS JOIN n CROSS JOIN (SELECT DISTINCT k FROM E) t GROUP BY q.row_id, t.k""",
    "pdft_amplitude": f"""{_W}{_E}, {_gram('E')}, {A.eigen('ev', 'G', 2)}, cl AS (SELECT row_id, unnest(range(len(v))) AS k, unnest(v) AS v FROM (SELECT unnest([1, 2]) AS row_id, unnest(list_transform([1, 2], lambda pz: list_transform(vecs[pz], lambda px: px * sqrt(vals[pz])))) AS v FROM ev)),
ct AS (SELECT row_id, k, v - avg(v) OVER (PARTITION BY row_id) AS v FROM cl), n AS (SELECT max(k) + 1 AS n FROM E),
q AS (SELECT row_id, b.b, any_value(n) AS n, sum(v * cos(2 * pi() * b.b * k / n)) AS re, sum(v * sin(2 * pi() * b.b * k / n)) AS im FROM ct CROSS JOIN n CROSS JOIN (SELECT unnest(range(1, 100)) AS b) b WHERE b.b <= n // 2 GROUP BY row_id, b.b)
SELECT b AS bin, round(sum(re * re + im * im) / any_value(n) * CASE WHEN 2 * b = any_value(n) THEN 1 ELSE 2 END / 5, 6) + 0.0 AS amplitude FROM q GROUP BY b""",
    "amps_top_power": f"WITH base AS ({PLAIN['amps_fixed_tapers']}) SELECT row_number() OVER (ORDER BY power DESC) - 1 AS place, bin FROM base WHERE bin / 720 >= 0.01 AND bin / 720 < 0.3 QUALIFY place < 5",
    "hodmd_spectrum": f"""{_W}{_L}, {_gram('L').replace('G AS', 'G0 AS')}, {A.eigen('dr', 'G0', 2)}, zz AS (SELECT {A.entries("len(vecs[1])", "vals[1] * vecs[1][{i}] * vecs[1][{j}] + vals[2] * vecs[2][{i}] * vecs[2][{j}]")} AS z FROM dr),
hk AS (SELECT {A.entries("len(z) - 4", "list_sum(list_transform(range(0, 5), lambda hx: z[{i} + hx][{j} + hx]))")} AS m FROM zz), {_reduced(4, source='hk')},
fst AS (SELECT {A.times_transposed(A.times_transposed("w", A.entries("len(w[1])", "z[{i} + 1][{j} + 1]")), "w")} AS first FROM red CROSS JOIN zz),
{_mode_rows('(SELECT max(k) + 1 FROM L)', 'first').replace('FROM sh CROSS JOIN red)', 'FROM sh CROSS JOIN fst)')} {_SPECTRUM}""",
    "mssa_denoised": f"{_W}{_E}, {_gram('E')}, {_SMOOTH}, {A.eigen('ev', 'hg', 3)}, {_BACK} SELECT E.row_id, CAST(sm.t - 1 AS INTEGER) AS k, round(sum(E.value * sm.r), 6) + 0.0 AS value FROM E JOIN sm ON sm.s = E.k + 1 GROUP BY E.row_id, sm.t",
    "pmssa_reconstruct": f"""{_W}{_E}, {_gram('E').replace('G AS', 'G0 AS')}, {A.eigen('dr', 'G0', 2)}, G AS (SELECT {A.entries("len(vecs[1])", "vals[1] * vecs[1][{i}] * vecs[1][{j}] + vals[2] * vecs[2][{i}] * vecs[2][{j}]")} AS m FROM dr), {_SMOOTH}, {A.eigen('ev', 'hg', 2)}, {_BACK},
pr AS (SELECT E.row_id, s.s, sum(E.value * (vecs[1][E.k + 1] * vecs[1][s.s] + vecs[2][E.k + 1] * vecs[2][s.s])) AS value FROM E CROSS JOIN dr CROSS JOIN (SELECT DISTINCT s FROM sm) s GROUP BY E.row_id, s.s)
SELECT pr.row_id, CAST(sm.t - 1 AS INTEGER) AS k, round(sum(pr.value * sm.r), 6) + 0.0 AS value FROM pr JOIN sm ON sm.s = pr.s GROUP BY pr.row_id, sm.t""",
    "spod_spectrum": f"{_W}{_L}, {_CENTRED.format('L')}, {_taper2('cl', '200')} SELECT f AS bin, round(f / n, 6) + 0.0 AS frequency, round(scale * (mid + half), 6) + 0.0 AS first, round(scale * abs(mid - half), 6) + 0.0 AS second FROM te",
    "spod_top_modes": f"""{_W}{_L}, {_CENTRED.format('L')}, {_taper2('cl', '200')}, lf AS (SELECT f, scale * (mid + half) AS e, log10(f / n) AS x FROM te WHERE f > 0), ed AS (SELECT min(x) AS a, max(x) AS b FROM lf),
sg AS (SELECT f, e, least(4, CAST(floor((x - a) / (b - a) * 5 + 1e-12) AS BIGINT)) AS seg FROM lf CROSS JOIN ed), best AS (SELECT seg, arg_max(f, e) AS bin FROM sg GROUP BY seg)
SELECT row_number() OVER (ORDER BY seg) - 1 AS segment, bin FROM best""",
    "pamspod_spectrum": f"""{_W}{_E}, ec0 AS (SELECT row_id, k, value - avg(value) OVER (PARTITION BY row_id) AS value FROM E), {_gram('ec0')}, {A.eigen('ev', 'G', 2)},
cl AS (SELECT row_id, unnest(range(len(v))) AS k, unnest(v) AS v FROM (SELECT unnest([1, 2]) AS row_id, unnest(list_transform([1, 2], lambda pz: list_transform(vecs[pz], lambda px: px * sqrt(vals[pz])))) AS v FROM ev)),
ct AS (SELECT row_id, k, v - avg(v) OVER (PARTITION BY row_id) AS v FROM cl), {_taper2('ct', '80')} SELECT f AS bin, round(scale * (mid + half), 6) + 0.0 AS first, round(scale * abs(mid - half), 6) + 0.0 AS second FROM te""",
    "amps_adaptive": f"""{_W}{_E}, {_CENTRED.format('E')}, tn AS (SELECT max(k) + 1 AS n FROM E),
q AS (SELECT row_id, b, any_value(n) AS n, sum(v * cos(pi() * b * k / n)) AS re, -sum(v * sin(pi() * b * k / n)) AS im FROM cl CROSS JOIN tn CROSS JOIN (SELECT unnest(range(-10, 80)) AS b) GROUP BY row_id, b),
d AS (SELECT a.row_id, a.n, f.f, i.i, (pow(a.re - c.re, 2) + pow(a.im - c.im, 2)) / 4 AS d FROM range(0, 40) AS f(f) CROSS JOIN range(1, 11) AS i(i) JOIN q a ON a.b = 2 * f.f - i.i JOIN q c ON c.b = 2 * f.f + i.i AND c.row_id = a.row_id WHERE f.f <= a.n // 2),
pk AS (SELECT row_id, f, t.t, sum(6.0 * (t.t * t.t - (i - 1) * (i - 1)) / (t.t * (4 * t.t - 1) * (t.t + 1)) * 2 / (n + 1) * d) / any_value(n) AS p FROM d CROSS JOIN range(1, 11) AS t(t) WHERE i <= t.t GROUP BY row_id, f, t.t),
pl AS (SELECT row_id, list(p ORDER BY f) AS p, len(list(p)) AS nf FROM (SELECT row_id, f, list(p ORDER BY t) AS p FROM pk GROUP BY row_id, f) GROUP BY row_id),
sw AS (SELECT row_id, p, nf, 0 AS step, list_transform(range(0, nf), lambda a1: CAST(2 AS BIGINT)) AS cnt, list_transform(range(0, nf), lambda a2: CAST(1 AS DOUBLE)) AS last, list_transform(range(0, nf), lambda a3: false) AS done FROM pl
  UNION ALL SELECT row_id, p, nf, step + 1,
    CASE WHEN skip OR stop THEN cnt ELSE list_concat(cnt[1:f - 1], [k + 1], cnt[f + 1:]) END, CASE WHEN skip THEN last ELSE list_concat(last[1:f - 1], [now], last[f + 1:]) END, CASE WHEN skip OR NOT stop THEN done ELSE list_concat(done[1:f - 1], [true], done[f + 1:]) END
  FROM (SELECT *, abs(now - last[f]) <= 0.01 OR k >= 10 OR (f > 1 AND k - cnt[f - 1] = 1) OR (f < nf AND k - cnt[f + 1] = 1) AS stop FROM (
    SELECT *, log10(p[f][k] + 2.2250738585072014e-308) AS now, done[f] AS skip FROM (SELECT *, cnt[f] AS k FROM (SELECT *, step % nf + 1 AS f FROM sw WHERE step < nf * 10)))))
SELECT row_id, f.f AS bin, cnt[f.f + 1] AS n_tapers, round(p[f.f + 1][cnt[f.f + 1]] * CASE WHEN f.f = 0 OR 2 * f.f = (SELECT n FROM tn) THEN 1 ELSE 2 END, 6) + 0.0 AS power FROM sw CROSS JOIN range(0, 40) AS f(f) WHERE step = nf * 10 AND f.f < nf""",
    "optdmd_training": f"""{_W}{_E}, {_gram('E')}, {_reduced(1)}, {_states('E', 'q', 'st.k, list_dot_product(br.b, st.z) - E.value AS e FROM br CROSS JOIN st JOIN E ON E.row_id = br.row_id AND E.k = st.k').replace('SELECT br.row_id', ', er AS (SELECT br.row_id')}),
nt AS (SELECT greatest(1, CAST(floor((max(k) + 1) * 0.75) AS BIGINT)) AS n FROM E) SELECT round(sqrt(sum(e * e) / (5 * any_value(n))), 6) + 0.0 AS first_loss, true AS lower FROM er CROSS JOIN nt WHERE k < n""",
    "linear_model": f"""{_W}{_L}, {_gram('L')}, {A.eigen('ev', 'G', 2)}, {_RANK2}, zn AS (SELECT {A.scaled("z", "1 / greatest(list_max(list_transform(z[1], lambda ma: abs(ma))), list_max(list_transform(z[2], lambda mb: abs(mb))))")} AS z FROM z2),
h AS (SELECT list_transform(z, lambda xa: xa[1:len(xa) - 1]) AS x, list_transform(z, lambda ya: ya[2:]) AS y FROM zn), xx AS (SELECT x, y, {A.times_transposed("x", "x")} AS m, {A.times_transposed("y", "x")} AS yx FROM h),
op AS (SELECT x, y, list_transform(yx, lambda yr: [(yr[1] * m[2][2] - yr[2] * m[2][1]) / (m[1][1] * m[2][2] - m[1][2] * m[2][1]), (yr[2] * m[1][1] - yr[1] * m[1][2]) / (m[1][1] * m[2][2] - m[1][2] * m[2][1])]) AS a FROM xx), {A.spectrum('sp', 'op')},
er AS (SELECT t.t, pow(a[1][1] * x[1][t.t] + a[1][2] * x[2][t.t] - y[1][t.t], 2) + pow(a[2][1] * x[1][t.t] + a[2][2] * x[2][t.t] - y[2][t.t], 2) AS e FROM op CROSS JOIN (SELECT unnest(range(1, (SELECT len(x[1]) FROM op) + 1)) AS t) t),
ls AS (SELECT sqrt(sum(e) / (2 * count(*))) AS l FROM er WHERE t <= floor((SELECT len(x[1]) FROM op) * 0.75))
SELECT row_number() OVER (ORDER BY round(re, 6), round(im, 6)) - 1 AS k, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im, round(l, 6) + 0.0 AS first_loss FROM sp CROSS JOIN ls""",
    "linear_control_model": f"""{_W}{_E}, x AS (SELECT list(x ORDER BY row_id) AS x FROM (SELECT row_id, list(value ORDER BY k) AS x FROM E GROUP BY row_id)), h AS (SELECT list_transform(x, lambda ca: ca[1:len(ca) - 1]) AS z, list_transform(x[1:3], lambda cb: cb[2:]) AS y FROM x),
zz AS (SELECT {A.times_transposed("z", "z")} AS m FROM h), {A.inverse('zi', 'zz', 120)}, fit AS (SELECT y, z, {A.times_transposed(A.times_transposed("y", "z"), "x")} AS ab FROM h CROSS JOIN zi),
er AS (SELECT y, {A.times_transposed("ab", A.transpose("z"))} AS f FROM fit) SELECT i.i, j.j, round(y[i.i + 1][j.j + 1] - f[i.i + 1][j.j + 1], 6) + 0.0 AS value FROM er CROSS JOIN range(0, 3) AS i(i) CROSS JOIN (SELECT unnest(range(0, (SELECT len(y[1]) FROM er))) AS j) j""",
    "kmeans_transitions": f"{_W}{_E}, {_gram('E')}, {A.eigen('ev', 'G', 1)}, {_CLUSTERS} SELECT round(c, 3) + 0.0 AS centre, round(nx, 3) + 0.0 AS next_centre, round(n / sum(n) OVER (PARTITION BY c), 6) + 0.0 AS p, round(dt, 6) + 0.0 AS dt FROM qt",
    "cnm_prediction": f"""{_W}{_E}, {_gram('E')}, {A.eigen('ev', 'G', 1)}, {_CLUSTERS}, w AS (SELECT CAST(0 AS BIGINT) AS k, c, CAST(0 AS DOUBLE) AS t FROM lb WHERE lb.k = 0 UNION ALL SELECT w.k + 1, qt.nx, w.t + qt.dt FROM w JOIN qt ON qt.c = w.c WHERE w.t < 10),
u AS (SELECT row_id, abs(sum(value * vecs[1][k + 1])) / sqrt(any_value(vals)[1]) AS u FROM E CROSS JOIN ev GROUP BY row_id) SELECT row_id, w.k, round(w.t, 6) AS time, round(u * c, 4) AS value FROM u CROSS JOIN w""",
}
