import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators import mesh, outliers, rom, select, spectral, trained, windows
from tidewright.operators.dmd import DMD, HODMD, MSSA, PMSSA, dft_properties
from tidewright.operators.linalg import SVD, Matrix, beside, minus


def series(spark, *rows):
    return spark.createDataFrame([(i, k, float(v)) for i, r in enumerate(rows) for k, v in enumerate(r)], "id int, t int, v double")


@pytest.fixture(scope="module")
def waves():
    """Two oscillating patterns of known frequencies."""
    x, t = np.linspace(-10, 10, 60)[:, None], np.linspace(0, 20, 120, endpoint=False)[None]
    return 5 / np.cosh(x / 2) * np.tanh(x / 2) * np.cos(1.5 * t) + 3 * np.sin(x / 2) * np.sin(1.5 * t) + np.sin(2 * x) * np.cos(2 * t) + 0.7 * np.cos(x) * np.sin(2 * t)


def test_masks(spark):
    p = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (3.0,), (4.0,), (5.0,), (None,)], "x double")
    assert [r[0] for r in p.where(select.mask_box(["x"], [2], [4])).collect()] == [2, 3, 4]
    assert [r[0] for r in p.where(select.mask_sphere(["x"], [2], 1.5)).collect()] == [1, 2, 3]
    with pytest.raises(ValueError):
        select.mask_box(["x"], [1, 2], [3])
    with pytest.raises(ValueError):
        select.mask_sphere([], [], 1)


def test_time_range_compares_numbers(spark):
    d = spark.createDataFrame([("0.10",), ("0.9",), ("10",), ("constant",), (None,)], "t string")
    assert [r[0] for r in select.time_range(d, "t", 0.1, 9).collect()] == ["0.10", "0.9"]


def test_outliers_golden(spark):
    d = series(spark, [3, 2, 4, 8, 1, 0], [3, 2, 4, 5, 1, 0])
    out = {(r["id"], r["t"]): (r["outlier"], r["repaired"]) for r in outliers.iqr_outliers(d, "id", "t", "v").collect()}
    assert out[0, 3] == (True, 2.0) and not out[1, 3][0]
    one = {r["t"]: r["repaired"] for r in outliers.iqr_outliers(d.where("id = 0"), "id", "t", "v", nb=1).collect()}
    assert one[3] == 4.0
    null = spark.createDataFrame([(None, 0, 1.0), (None, 1, None)], "id int, t int, v double")
    assert outliers.iqr_outliers(null.withColumn("_q", F.lit(1)), "id", "t", "v").count() == 2
    assert outliers.iqr_outliers(null.limit(0), "id", "t", "v").count() == 0


def test_windows(spark):
    d = series(spark, range(6))
    for delays, horizon, n in ((1, 1, 5), (1, 2, 4), (2, 1, 4), (2, 2, 3)):
        assert windows.sequence_pairs(d, ["id"], "t", "v", delays, horizon).count() == n
    assert [r["y"] - r["x"] for r in windows.shift_pairs(d, ["id"], "t", "v").collect()] == [1.0] * 5
    assert windows.delay_embedding(d, ["id"], "t", "v", 3).count() == 12
    with pytest.raises(ValueError):
        windows.delay_embedding(d, ["id"], "t", "v", 0)


def test_windows_in_small_blocks(spark):
    """Blocks of a few rows give what one block gives."""
    rng = np.random.default_rng(7)
    rows = [(None if k == 2 else k, int(t), float(rng.integers(0, 3)) if rng.random() > 0.05 else None) for k in range(3) for t in rng.permutation(60)[: 20 + 15 * k]]
    d = spark.createDataFrame(rows, "id int, t int, v double")
    same = lambda f: sorted(map(repr, f(10**6).collect())) == sorted(map(repr, f(4).collect()))
    assert same(lambda b: windows.shift_pairs(d, ["id"], "t", "v", block=b))
    assert same(lambda b: windows.delay_embedding(d, ["id"], "t", "v", 3, block=b))
    assert same(lambda b: windows.sequence_pairs(d, ["id"], "t", "v", 2, 1, block=b))
    assert same(lambda b: windows.run_dedupe(d, ["id"], ["t"], "v", block=b))
    assert same(lambda b: windows.transitions(d, ["id"], ["t"], "v", 2, block=b))
    assert same(lambda b: windows.trajectory_split(d, "id", "t", horizon=2, shift=3, forward_backward=True, block=b))
    assert same(lambda b: outliers.iqr_outliers(d, "id", "t", "v", nb=2, block=b))
    with pytest.raises(ValueError):
        from tidewright.session import with_neighbours

        with_neighbours(d, "t", after=5, block=5)


def test_exact_quantiles(spark):
    from tidewright.operators.quantiles import exact_quantiles

    rng = np.random.default_rng(8)
    data = {1: rng.normal(size=301), 2: np.round(rng.normal(size=200), 1), None: np.array([3.0]), 4: np.array([-2.0, 0.0, 0.0, 5e-320, 1e300])}
    rows = [(k, float(v)) for k, x in data.items() for v in x] + [(1, None), (9, None)]
    got = {r["k"]: [r["q0"], r["q1"], r["q2"]] for r in exact_quantiles(spark.createDataFrame(rows, "k int, v double"), "k", "v", [0.25, 0.5, 0.9]).collect()}
    assert set(got) == set(data)
    for k, x in data.items():
        assert np.allclose(got[k], np.quantile(x, [0.25, 0.5, 0.9]), rtol=1e-12)


def test_trajectory_split(spark):
    d = series(spark, range(21))
    part = lambda **k: {r["part"]: r["count"] for r in windows.trajectory_split(d, "id", "t", **k).groupBy("part").count().collect()}
    assert part() == {"train": 15, "test": 5}
    assert part(shift=2) == {"train": 7, "test": 3}
    assert part(forward_backward=True) == {"train": 30, "test": 10}
    assert part(shuffle=True) == {"train": 15, "test": 5}
    assert windows.trajectory_split(series(spark, [1, 2]), "id", "t").first()["part"] == "train"


def test_transitions_golden(spark):
    d = series(spark, [0, 1, 1, 0, 1, 2, 2, 3, 2, 3]).withColumn("v", F.col("v").cast("int"))
    got = {(tuple(r["history"]), r["next"]): (r["p"], r["dt"]) for r in windows.transitions(d, ["id"], ["t"], "v").collect()}
    assert {k: v[1] for k, v in got.items()} == {((0,), 1): 1.25, ((1,), 0): 1.5, ((1,), 2): 1.5, ((2,), 3): 1.25, ((3,), 2): 1.0}
    two = {(tuple(r["history"]), r["next"]): r["dt"] for r in windows.transitions(d, ["id"], ["t"], "v", 2).collect()}
    assert two == {((0, 1), 0): 1.5, ((1, 0), 1): 1.0, ((0, 1), 2): 1.5, ((1, 2), 3): 1.5, ((2, 3), 2): 1.0, ((3, 2), 3): 1.0}
    p = series(spark, [0, 4, 3, 0, 2, 1, 3]).withColumn("v", F.col("v").cast("int"))
    first = {r["next"]: r["p"] for r in windows.transitions(p, ["id"], ["t"], "v").collect() if list(r["history"]) == [0]}
    assert first == {2: 0.5, 4: 0.5}


def test_matrix_forms(spark):
    x = np.arange(12.0).reshape(3, 4)
    m = Matrix.from_numpy(spark, x)
    assert np.allclose(m.gram(), x.T @ x) and np.allclose(m.row_gram(2)[1], x @ x.T)
    back = Matrix.from_long(m.long().withColumn("k", F.col("k") * 10), "row_id", "k", "value", fill=None)
    assert np.allclose(back.numpy(), x)
    with pytest.raises(ValueError):
        Matrix.from_long(m.long().where("k > 0 or row_id > 0"), "row_id", "k", "value", fill=None).numpy()
    with pytest.raises(ValueError):
        Matrix.from_long(m.long().limit(0), "row_id", "k", "value")
    assert np.allclose(minus(m, m).numpy(), 0) and beside([m, m]).numpy().shape == (3, 8)
    z = Matrix.from_numpy(spark, x + 1j * x[::-1])
    assert np.allclose(z.gram(), (x + 1j * x[::-1]).conj().T @ (x + 1j * x[::-1]))
    assert np.allclose(m.column_sum(), x.sum(axis=0))


@pytest.mark.parametrize("shape", [(40, 15), (15, 15), (15, 70)])
def test_svd(spark, shape):
    x = np.random.default_rng(0).normal(size=shape)
    s = SVD(Matrix.from_numpy(spark, x), rank=10)
    ref = np.linalg.svd(x, compute_uv=False)
    assert np.allclose(s.s, ref[:10]) and s.rank == 10
    assert np.allclose(s.s_cum[-1], 100 * ref[:10].sum() / ref.sum())
    errors = [np.linalg.norm(s.reconstruct(r).numpy() - x) for r in (2, 5, 10)]
    assert errors == sorted(errors, reverse=True)
    assert np.allclose(s.U.gram(), np.eye(10), atol=1e-8)
    assert SVD(Matrix.from_numpy(spark, x), rank=10**4).rank == min(shape)
    assert "rank 10" in str(s)
    with pytest.raises(ValueError):
        SVD(Matrix.from_numpy(spark, x), mode="other")
    rows = SVD(Matrix.from_numpy(spark, x), rank=4, mode="gram_rows")
    assert np.allclose(np.abs(rows.V.T @ s.V[:, :4]), np.eye(4), atol=1e-6)


def test_svd_modes_agree(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 12)) * 10.0 ** -np.arange(12)
    m = Matrix.from_numpy(spark, x).map_rows(lambda v: v, 12, False)
    m = Matrix(m.df.repartition(9), 12)
    ref = np.linalg.svd(x, compute_uv=False)
    exact = SVD(m, mode="qr")
    assert np.allclose(exact.s_full / ref, 1, atol=1e-6) and exact.x.rows == 60  # also the values that a Gram matrix loses
    assert np.allclose(SVD(m, rank=3, mode="iterate").s, ref[:3]) and np.allclose(SVD(m, rank=3).s, ref[:3])
    z = Matrix.from_numpy(spark, x + 1j * x[::-1])
    assert np.allclose(SVD(z, rank=4, mode="qr").s, SVD(z, rank=4).s) and np.allclose(SVD(z, rank=2, mode="iterate").s, SVD(z, rank=2).s)
    with pytest.raises(ValueError):
        SVD(m, mode="iterate")
    assert m.gram_times(np.eye(12)).shape == (12, 12) and np.allclose(m.gram(), x.T @ x)


def test_matrix_from_gappy_rows(spark):
    d = spark.createDataFrame([("a", 1, 2.0), ("a", 3, None), ("b", 2, 5.0), ("b", None, 9.0), (None, 3, 1.0)], "r string, t int, v double")
    m = Matrix.from_long(d, "r", "t", "v", fill=-1.0)
    rows = {r["row_id"]: list(r["re"]) for r in m.df.collect()}
    assert rows == {"a": [2.0, -1.0, -1.0], "b": [-1.0, 5.0, -1.0], None: [-1.0, -1.0, 1.0]}
    assert m.gram().shape == (3, 3) and m.rows == 3
    with pytest.raises(Exception, match="several values"):
        Matrix.from_long(d.union(d), "r", "t", "v").gram()


def test_dmd_finds_known_frequencies(spark, waves):
    m = Matrix.from_numpy(spark, waves)
    dt = 20 / 120
    d = DMD(m, dt, rank=4)
    f = np.sort(np.abs(d.frequency))
    assert np.allclose(f, np.array([1.5, 1.5, 2, 2]) / (2 * np.pi), atol=1e-4)
    assert np.allclose(d.growth_rate, 0, atol=1e-4)
    assert np.allclose(d.reconstruction.numpy(), waves, atol=1e-4)
    assert np.allclose(d.reconstruction_error.numpy(), d.reconstruction.numpy() - waves, atol=1e-10)
    assert np.abs(d.projection_error.numpy()).max() < 1e-4
    assert np.allclose(d.predict(waves[:, 0], 9).numpy(), waves[:, :10], atol=1e-3)
    top = d.top_modes(2, f_min=0.0)
    assert np.allclose(d.partial_reconstruction(set(range(4))).numpy(), waves, atol=1e-4) and len(top) == 2
    assert d.spectrum().count() == 4 and "rank 4" in str(d)
    assert dft_properties(0.1, 500) == (10.0, 5.0, pytest.approx(0.02))


def test_dmd_options_against_numpy(spark, waves):
    noisy = waves + 0.01 * np.random.default_rng(3).normal(size=waves.shape)
    m = Matrix.from_numpy(spark, noisy)
    x, y = noisy[:, :-1], noisy[:, 1:]
    u, s, vh = np.linalg.svd(x, full_matrices=False)
    u, s, v = u[:, :4], s[:4], vh[:4].T
    a = u.T @ y @ v / s
    order = lambda w: np.sort_complex(np.round(w, 7))
    d = DMD(m, 1.0, rank=4)
    assert np.allclose(order(d.eigvals), order(np.linalg.eigvals(a)), atol=1e-6)
    phi = d.modes.numpy()
    assert np.allclose(d.amplitude, np.linalg.lstsq(phi, noisy[:, 0].astype(complex), rcond=None)[0], atol=1e-6)
    o = DMD(m, 1.0, rank=4, optimal=True)
    assert np.linalg.norm(o.reconstruction_error.numpy()) <= np.linalg.norm(d.reconstruction_error.numpy()) * 1.001
    un = DMD(m, 1.0, rank=4, unitary=True)
    assert np.allclose(np.abs(un.eigvals), 1) and np.allclose(un.operator @ un.operator.conj().T, np.eye(4))
    t = DMD(m, 1.0, rank=4, tlsq=True)
    nx, ny = t.tlsq_error
    assert nx.numpy().shape == x.shape and 0 < np.linalg.norm(ny.numpy()) < 0.2 * np.linalg.norm(y)
    fb = DMD(m, 1.0, rank=4, forward_backward={"steps": 100})
    assert len(fb.fb_log) <= 101 and np.allclose(np.abs(fb.eigvals), 1, atol=1e-2)
    e = DMD([Matrix.from_numpy(spark, noisy[:, :60]), Matrix.from_numpy(spark, noisy[:, 60:])], 1.0, rank=4)
    assert len(e.amplitude) == 2 and e.reconstruction[1].numpy().shape == (60, 60) and len(e.top_modes(3)) == 3


def test_hodmd(spark, waves):
    m = Matrix.from_numpy(spark, waves)
    h = HODMD(m, 20 / 120, delay=10, rank_dr=4, rank=4)
    assert np.allclose(np.sort(np.abs(h.frequency)), np.array([1.5, 1.5, 2, 2]) / (2 * np.pi), atol=1e-3)
    assert np.allclose(h.reconstruction.numpy(), waves, atol=1e-2)
    p = h.predict(Matrix.from_numpy(spark, waves[:, :10]), 5).numpy()
    assert p.shape == (60, 6) and np.allclose(p, waves[:, 9:15], atol=1e-2)
    assert h.projection_error.numpy().shape == (60, 110) and h.modes.n == 4
    with pytest.raises(ValueError):
        HODMD(m, 1.0, delay=200)
    single = HODMD(Matrix.from_numpy(spark, waves[:1]), 20 / 120, delay=20, rank_dr=1, rank=4)
    assert np.allclose(single.reconstruction.numpy(), waves[:1], atol=1e-2)


def test_mssa(spark):
    x = np.array([[1.0, 2, 3, 4], [5, 6, 7, 8]])
    m = MSSA(Matrix.from_numpy(spark, x), 3, 2)
    assert np.allclose(m.reconstruction.numpy(), x) and np.allclose(m.reconstruction_error.numpy(), 0, atol=1e-8)
    r = np.random.default_rng(0).normal(size=(4, 20))
    s = MSSA(Matrix.from_numpy(spark, r), 6, 2)
    h = np.concatenate([r[:, i : i + 6] for i in range(15)])
    u, sv, vh = np.linalg.svd(h, full_matrices=False)
    low = ((u[:, :2] * sv[:2]) @ vh[:2]).reshape(15, 4, 6)
    mean, n = np.zeros((4, 20)), np.zeros(20)
    for i in range(15):
        mean[:, i : i + 6] += low[i]
        n[i : i + 6] += 1
    assert np.allclose(s.reconstruction.numpy(), mean / n) and np.allclose(s.s_full[:6], sv)
    assert PMSSA(Matrix.from_numpy(spark, r), 6, 2).reconstruction.numpy().shape == (4, 20)
    assert MSSA(Matrix.from_numpy(spark, x)).window_size == 2


@pytest.mark.parametrize("kind", ["real", "complex"])
@pytest.mark.parametrize("n", [5, 6])
def test_dft_round_trip(spark, kind, n):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3, n)) + (1j * rng.normal(size=(3, n)) if kind == "complex" else 0)
    d = spectral.DFT(Matrix.from_numpy(spark, x), 0.1)
    assert np.allclose(d.reconstruction.numpy(), x)
    assert np.allclose(np.linalg.norm(d.modes.numpy(), axis=0), 1)
    var = (np.abs(x - x.mean(axis=1, keepdims=True)) ** 2).sum()
    assert np.allclose(d.amplitude.sum() * 3, var)
    p = spectral.PDFT(Matrix.from_numpy(spark, x), 0.1, rank=3)
    assert np.allclose(p.reconstruction.numpy(), x) and np.allclose(p.amplitude, d.amplitude)


def test_dft_finds_a_tone(spark):
    t = np.arange(64) * 0.1
    d = spectral.DFT(Matrix.from_numpy(spark, np.sin(2 * np.pi * 2.5 * t)[None]), 0.1, nfft=128, window="hann")
    assert abs(d.frequency[d.top_modes(1)[0]] - 2.5) < 1e-9
    assert spectral.DFT(Matrix.from_numpy(spark, t[None]), 0.1).top_modes(3, 100, 200).tolist() == []


def test_amps():
    t = np.arange(60) * 0.1
    rng = np.random.default_rng(0)
    a = spectral.AMPS(np.sin(2 * np.pi * 2.0 * t) + 0.1 * rng.normal(size=60), 0.1, nfft=120, max_tapers=10)
    assert len(a.frequency) == 61 and abs(a.frequency[a.top_power(1)[0]] - 2.0) < 0.2
    assert a.n_tapers.max() <= 10 and a.n_tapers.min() >= 2 and a.residual.shape[0] == 61
    assert np.allclose(a.spectral_density, a.spectral_power * 12)
    b = spectral.AMPS(np.exp(2j * np.pi * t[:31])[None], 0.1, adaptive=False)
    assert len(b.frequency) == 31 and b.residual is None
    with pytest.raises(ValueError):
        spectral.AMPS(np.ones((2, 5)), 0.1)


def test_tapers_of_many_rows_at_once(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(7, 33)) + np.sin(np.arange(33) / 2)
    d = spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())] + [(9, x[0, :20].tolist())], "row_id bigint, re array<double>")
    for options in ({"max_tapers": 9, "tolerance": 1e-2}, {"max_tapers": 5, "adaptive": False, "nfft": 40}):
        got = spectral.multitaper_power(d, 0.1, **options).toPandas()
        for i, row in [*enumerate(x), (9, x[0, :20])]:
            a = spectral.AMPS(row, 0.1, **options)
            own = got[got["row_id"] == i].sort_values("bin")
            assert np.allclose(own["power"], a.spectral_power) and own["n_tapers"].tolist() == a.n_tapers.tolist() and np.allclose(own["density"], a.spectral_density)


def brute_spod(x, w, dt, nfft, k, f):
    """Eigenvalues of the tapered realisations, formed on the rows themselves."""
    xw = (x - x.mean(axis=1, keepdims=True)) * np.sqrt(w)[:, None]
    q = np.fft.fft(xw, 2 * nfft, norm="ortho") * np.sqrt(dt)
    i = np.arange(1, k + 1)
    t = np.sqrt(2 / (nfft + 1)) * (q[:, (2 * f - i) % (2 * nfft)] - q[:, (2 * f + i) % (2 * nfft)]) / 2j
    mu = 6 * (k**2 - (i - 1) ** 2) / (k * (4 * k - 1) * (k + 1))
    t = t * np.sqrt(mu)
    u, s, _ = np.linalg.svd(t, full_matrices=False)
    return s**2 * 2 * nfft / (dt * x.shape[1]), u / np.sqrt(w)[:, None]


def test_spod_against_rows(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(20, 30))
    w = rng.uniform(0.5, 2, 20)
    weight = spark.createDataFrame([(i, float(v)) for i, v in enumerate(w)], "row_id long, w double")
    s = spectral.AMSPOD(Matrix.from_numpy(spark, x), 0.5, nfft=32, adaptive=False, max_tapers=4, weight=weight)
    modes = s.modes([3, 7]).numpy().reshape(20, 2, 3)
    for j, f in enumerate((3, 7)):
        lam, u = brute_spod(x, w, 0.5, 32, 4, f)
        assert np.allclose(s.eigvals[f], 2 * lam[:3])
        inner = np.abs(np.einsum("ik,i,ik->k", modes[:, j].conj(), w, u[:, :3]))
        assert np.allclose(inner, 1, atol=1e-6)
    assert s.frequency.shape == (17,) and np.allclose(s.half_bandwidth, 0.5 * 5 / (33 * 0.5))


def test_spod_reconstruction_and_adaptive(spark):
    rng = np.random.default_rng(1)
    t = np.arange(40) * 0.1
    x = np.outer(rng.normal(size=12), np.sin(2 * np.pi * 2 * t)) + np.outer(rng.normal(size=12), np.cos(2 * np.pi * 2 * t)) + 0.01 * rng.normal(size=(12, 40))
    s = spectral.AMSPOD(Matrix.from_numpy(spark, x), 0.1, max_tapers=5, tolerance=1e-3, keep_n_modes=2)
    assert s.n_tapers.max() <= 5 and abs(s.frequency[s.top_modes(1)[0]] - 2.0) < 0.3
    rec = s.partial_reconstruction(0, 20, n_modes=1, n_snapshots=40, add_mean=True).numpy()
    assert rec.shape == x.shape and np.linalg.norm(rec - x) < 0.3 * np.linalg.norm(x)
    assert s.temporal_coefficients(1).shape == (21, 1, 40)
    assert s.mode_reconstruction(8).n == 25
    with pytest.warns(UserWarning):
        s.temporal_coefficients(9)
    p = spectral.PAMSPOD(Matrix.from_numpy(spark, x), 0.1, rank=4, adaptive=False, max_tapers=3)
    assert p.modes([4]).numpy().shape == (12, 3) and p.spectrum().count() == 21
    full = spectral.AMSPOD(Matrix.from_numpy(spark, x), 0.1, adaptive=False, max_tapers=3)
    same = spectral.PAMSPOD(Matrix.from_numpy(spark, x), 0.1, rank=12, adaptive=False, max_tapers=3)
    assert np.allclose(full.eigvals, same.eigvals)


def test_encoder_and_cnm(spark, waves):
    m = Matrix.from_numpy(spark, waves)
    e = rom.SVDEncoder(4)
    with pytest.raises(ValueError):
        e.encode(m)
    e.train(m)
    z = e.encode(m)
    assert np.allclose(e.decode(z).numpy(), waves, atol=1e-8)
    assert np.allclose(e.encode(Matrix.from_numpy(spark, waves[:, :3])), z[:, :3]) and (e.state_shape, e.reduced_state_size) == (60, 4)
    c = rom.CNM(z, e, spark, 20 / 120, n_clusters=6)
    assert all(abs(sum(q.values()) - 1) < 1e-9 for q in c.Q.values())
    p = c.predict(Matrix.from_numpy(spark, waves[:, :1]), 5.0, 0.5)
    assert p.numpy().shape == (60, 11)
    assert np.allclose(p.numpy(), c.predict(Matrix.from_numpy(spark, waves[:, :1]), 5.0, 0.5).numpy())
    c.model_order = 2
    c.set_labels(spark.createDataFrame(list(enumerate([0, 4, 3, 0, 2, 1, 3])), "t_idx int, label int"))
    rng = np.random.default_rng(0)
    assert c.Q[0, 4] == {3: 1.0} and c.find_history((4,), rng) == (0, 4) and c.find_history((1, 4), rng) == (0, 4)
    c.set_labels(spark.createDataFrame(list(enumerate([11, 2, 1, 3, 11, 2])), "t_idx int, label int"))
    assert c.find_history((1,), rng)[-1] == 1
    with pytest.raises(ValueError):
        rom.CNM(z, rom.SVDEncoder(), spark, 1.0)
    with pytest.raises(ValueError):
        rom.CNM(z, e, spark, 1.0, n_clusters=1)


def test_optdmd_improves(spark, waves):
    x = waves + 0.05 * np.random.default_rng(0).normal(size=waves.shape)
    m = Matrix.from_numpy(spark, x)
    o = trained.OptDMD(m, 20 / 120, rank=4)
    # gradients agree with differences
    t = np.arange(30)
    _, (g_phi, g_lam) = o._gradient(t)
    for array, grad, at in ((o.phi, g_phi, (0, 1)), (o.lam, g_lam, (0,))):
        for step in (1e-6, 1e-6j):
            array[at] += step
            above = o._gradient(t)[0]
            array[at] -= 2 * step
            change = (above - o._gradient(t)[0]) / 2e-6
            array[at] += step
            expected = grad[at].real if step == 1e-6 else grad[at].imag
            assert abs(change - expected) < 1e-3 * max(1, abs(expected))
    before = o.loss(np.arange(120))
    log = o.train(epochs=80, lr=1e-3)
    assert min(log["full_loss"]) < before and len(o.eigvals) == 4
    assert np.allclose(np.linalg.norm(o.modes.numpy(), axis=0), 1)
    assert np.allclose(o.reconstruction_error.numpy(), x - o.reconstruction.numpy())
    assert o.predict(o.z[:, 0], 3).n == 4 and len(o.top_modes(2)) == 2 and o.integral_contribution.shape == (4,)
    h = trained.HOOptDMD(m, 20 / 120, delay=3, rank_dr=4, rank=4)
    h.train(epochs=5)
    assert h.reconstruction.numpy().shape == x.shape and h.modes.n == 4 and h.dynamics.shape == (4, 120)


def test_linear_model():
    rng = np.random.default_rng(0)
    a = np.array([[0.95, -0.2], [0.2, 0.95]])
    x = np.stack([np.linalg.matrix_power(a, n) @ [1.0, 0.5] for n in range(30)], axis=1)
    m = trained.LinearModel(x, 0.1)
    assert np.allclose(m.A, a, atol=1e-6) and np.allclose(m.reconstruction[0], x, atol=1e-6)
    assert np.allclose(m.predict(x[:, 0], 4), x[:, :5], atol=1e-6)
    assert np.allclose(m.forward(x[:, :1], 2)[1], x[:, 2:3], atol=1e-6) and np.allclose(m.forward(x[:, 2:3], 2, backward=True)[1], x[:, :1], atol=1e-6)
    noisy = [x + 0.01 * rng.normal(size=x.shape) for _ in range(2)]
    n = trained.LinearModel(noisy, 0.1, init_forward_backward=False, sigma_filter=1.0)
    base, grads = n._gradient(n._pairs(2), 2)
    n.A[0, 1] += 1e-6
    assert abs((n._gradient(n._pairs(2), 2)[0] - base) / 1e-6 - grads[0][0, 1]) < 1e-3
    n.A[0, 1] -= 1e-6
    n.noise[1][0, 3] += 1e-6
    assert abs((n._gradient(n._pairs(2), 2)[0] - base) / 1e-6 - grads[2][0, 3]) < 1e-3
    log = n.train(epochs=30, horizon=2)
    assert len(log["full_loss"]) == 30 and len(n.top_modes(1)) == 1 and len(n.amplitude) == 2
    with pytest.raises(ValueError):
        trained.LinearModel([x, x[:, :5]], 0.1)


def test_linear_control_model():
    rng = np.random.default_rng(0)
    a, b = np.array([[0.9, 0.1], [-0.1, 0.9]]), np.array([[1.0], [0.3]])
    g = rng.normal(size=(1, 19))
    x = [np.array([1.0, 0.0])]
    for n in range(19):
        x.append(a @ x[-1] + b @ g[:, n])
    x = np.array(x).T
    m = trained.LinearControlModel(x, g, 0.1)
    assert np.allclose(m.A, a) and np.allclose(m.B, b) and np.allclose(m.reconstruction, x)
    assert np.allclose(m.predict(x[:, 0], g), x) and np.allclose(m.projection_error, 0)
    assert np.allclose(m.forward(x[:, 0], g), x[:, 1:]) and np.allclose(m.forward(x[:, -1], g[:, ::-1], backward=True)[:, -1], x[:, 0])
    with pytest.raises(ValueError):
        trained.LinearControlModel(x, g[:, :-1], 0.1)
    with pytest.raises(NotImplementedError):
        m.train()


def test_mesh_of_boxes(spark):
    m = mesh.box_mesh(spark, 3)
    f = mesh.face_geometry(m["points"], m["faces"])
    c = mesh.cell_geometry(f, m["owner"], m["neighbour"]).orderBy("cid").toPandas()
    assert len(c) == 27 and np.allclose(c["volume"], 1 / 27) and np.allclose(c.iloc[0][["x", "y", "z"]].astype(float), 1 / 6)
    t = mesh.topology(m["faces"], m["owner"], m["neighbour"]).first()["stream"]
    assert t[:2] == [16, 6] and t[2] == 4 and len(t) == 32
    flat = spark.createDataFrame([(0, [0, 0, 0, 0])], "fid bigint, pids array<bigint>")
    assert mesh.face_geometry(m["points"], flat).first()["sx"] == 0.0


def test_knn_weights(spark):
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(80, 2))
    p = spark.createDataFrame([(i, float(a), float(b), 0.0) for i, (a, b) in enumerate(x)], "id int, x double, y double, z double")
    w = {r["id"]: r["w"] for r in mesh.knn_weights(p, "id", ["x", "y", "z"], volume=1.0).collect()}
    d = np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)), axis=1)[:, :4].mean(axis=1) ** 3
    ref = np.sqrt(d / d.sum()) / np.sqrt(d / d.sum()).max()
    assert np.allclose([w[i] for i in range(80)], ref)


def test_knn_weights_of_isolated_points_and_copies(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.uniform(size=(60, 3)), [[50.0, 0, 0]], [[-300.0, 7, 0]], [[0.5, 0.5, 0.5]] * 6, [[90.0, 90, 0]] * 2])
    p = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, x double, y double, z double")
    d = np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)), axis=1)[:, :4]
    mean = d.mean(axis=1) ** 3
    w = {r["id"]: r["w"] for r in mesh.knn_weights(p, "id", ["x", "y", "z"], volume=1.0, k=4).collect()}
    assert np.allclose([w[i] for i in range(len(x))], np.sqrt(mean) / np.sqrt(mean).max())
    raw = mesh.PointWeights(p, "id", ["x", "y", "z"], k=4).raw
    assert raw.orderBy(F.desc("w")).first()["id"] == 61  # the most isolated point weighs most


def test_exact_neighbours_in_parts(spark):
    from tidewright.operators.nearest import exact_knn

    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(900, 3)), rng.normal(size=(600, 3)) * 0.01 + 2])
    p = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "place bigint, vec array<double>")
    d2 = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d2, np.inf)
    ref = np.argsort(d2, axis=1, kind="stable")[:, :4]
    for options in ({}, {"leaf": 300, "most": 60}, {"sample": 50, "leaf": 10}):
        got = {r["place"]: [n["id"] for n in r["near"]] for r in exact_knn(p, 4, **options).collect()}
        assert all(got[i] == ref[i].tolist() for i in range(len(x)))
    assert exact_knn(p.limit(0), 4).count() == 0 and [len(r["near"]) for r in exact_knn(p.limit(2), 4).collect()] == [1, 1]


def test_hull_and_point_weights(spark):
    from tidewright.functions.hull import hull_points, hull_volume

    rng = np.random.default_rng(0)
    cube = np.array([[a, b, c] for a in (0, 1) for b in (0, 2) for c in (0, 3)], float)
    assert abs(hull_volume(np.concatenate([cube, rng.uniform(size=(300, 3)) * [1, 2, 3]])) - 6) < 1e-9
    assert abs(hull_volume(np.array([[0.0, 0], [1, 0], [0, 1], [0.2, 0.2]])) - 0.5) < 1e-12
    ball = rng.normal(size=(400, 3))
    ball /= np.linalg.norm(ball, axis=1)[:, None]
    assert 3.8 < hull_volume(ball) < 4 * np.pi / 3 and len(hull_points(ball)) == 400
    assert hull_volume(np.array([[1.0], [4.0]])) == 3.0 and hull_volume(cube[:2]) == 0.0
    pts = np.concatenate([cube, rng.uniform(size=(60, 3)) * [1, 2, 3]])
    d = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(pts)], "id int, x double, y double, z double").repartition(3)
    w = mesh.PointWeights(d, "id", ["x", "y", "z"])
    assert abs(w.volume - 6) < 1e-9 and abs(w.raw.agg(F.sum("w")).first()[0] - 6) < 1e-9
    assert abs(w.weights.agg(F.max("w")).first()[0] - 1) < 1e-12 and w.max_sqrt > 0
    assert mesh.hull_size(d.withColumn("z", F.lit(0.0)), ["x", "y", "z"]) == pytest.approx(2.0)


def test_spod_helpers(spark):
    assert spectral.mode_similarity(np.array([1, 1j]), np.array([1j, -1])) == pytest.approx(1.0)
    x = Matrix.from_numpy(spark, np.ones((4, 3)))
    w = spark.createDataFrame([(0, 1.0), (1, 2.0)], "row_id long, w double")
    assert {r["row_id"]: r["w"] for r in spectral.tiled_weights(w, x).collect()} == {0: 1.0, 1: 2.0, 2: 1.0, 3: 2.0}
    with pytest.raises(ValueError):
        spectral.tiled_weights(w, Matrix.from_numpy(spark, np.ones((3, 3))))


def test_hours_hold_every_event(spark, tmp_path):
    import datetime as dt

    from tidewright.plans import snapshots

    at = [dt.datetime(2023, 12, 31, 22, 30), dt.datetime(2024, 1, 1, 0, 5), dt.datetime(2024, 2, 2, 3, 0), dt.datetime(2024, 2, 2, 3, 59), None]
    spark.createDataFrame([(t,) for t in at], "ts timestamp").write.parquet(str(tmp_path / "events.parquet"))
    v = snapshots._hours(spark, str(tmp_path)).df.first()["re"]
    assert len(v) == 2 + 32 * 24 + 4 and sum(v) == 4 and v[0] == v[2] == 1 and v[-1] == 2
    d = spark.createDataFrame([(0, 1, 2.0), (0, 5, 3.0), (0, None, 4.0)], "row_id long, t int, v double")
    assert Matrix.from_long(d, "row_id", "t", "v", times=[1, 3, 5]).df.first()["re"] == [2.0, 0.0, 3.0]
    with pytest.raises(Exception, match="not listed"):
        Matrix.from_long(d, "row_id", "t", "v", times=[1, 3]).df.collect()


def test_losses_and_optimizers_can_be_given(spark, waves):
    from tidewright.functions import dense

    def penalised(label, prediction, size):
        loss, g = trained.frobenius(label, prediction, size)
        return 2 * loss, 2 * g

    class Descent:
        def __init__(self, params, lr):
            self.params, self.lr = params, lr

        def step(self, grads):
            for p, g in zip(self.params, grads, strict=True):
                p -= self.lr * g

    m = Matrix.from_numpy(spark, waves[::10])
    o = trained.OptDMD(m, 20 / 120, rank=4)
    first = o.loss(np.arange(90))
    log = o.train(epochs=3, lr=1e-4, loss_function=penalised, optimizer=Descent)
    assert log["train_loss"][0] == pytest.approx(2 * first) and len(log["lr"]) == 3
    z = np.random.default_rng(0).normal(size=(2, 20))
    a, b = (trained.LinearModel(z, 1.0, init_forward_backward=False) for _ in range(2))
    assert b.train(epochs=2, loss_function=penalised, optimizer=Descent)["train_loss"][0] == pytest.approx(2 * a.train(epochs=2)["train_loss"][0])
    g, plain = trained.frobenius(z, z + 1, z.size)[1], trained.frobenius(z, z + 1, z.size)[0]
    e = 1e-6
    assert (trained.frobenius(z, z + 1 + e * g, z.size)[0] - plain) / e == pytest.approx((g**2).sum(), rel=1e-3)
    assert dense.AdamW is not None


def test_operators_are_exported_by_name():
    import tidewright.operators as ops
    from tidewright.functions.checks import with_second_axis

    assert ops.DMD is DMD and "CNM" in dir(ops)
    with pytest.raises(AttributeError):
        ops.Nothing
    x = np.arange(3)
    assert with_second_axis(x).shape == (1, 3) and with_second_axis(x, last=True).shape == (3, 1) and with_second_axis(x[None]).shape == (1, 3)

