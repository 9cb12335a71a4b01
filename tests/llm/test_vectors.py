import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.llm import neighbours, peaks


def frame(spark, x, ids=None):
    return spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids if ids is not None else range(len(x)), x, strict=True)], "member bigint, vec array<double>")


def brute_pairs(x, ids, k):
    out = set()
    for i in range(len(x)):
        d = ((x - x[i]) ** 2).sum(axis=1)
        order = [j for j in np.lexsort((ids, d)) if j != i][:k]
        out |= {(min(int(ids[i]), int(ids[j])), max(int(ids[i]), int(ids[j]))) for j in order}
    return out


@pytest.mark.parametrize("case", ["uniform", "clustered", "copies", "line", "few", "high"])
def test_neighbours_are_exact(spark, case):
    rng = np.random.default_rng(4)
    n = 700
    if case == "uniform":
        x = rng.uniform(size=(n, 3)) * 10
    elif case == "clustered":
        x = rng.normal(size=(n, 3)) * 0.01 + rng.integers(0, 4, size=(n, 1)) * 5.0
    elif case == "copies":
        x = np.repeat(rng.integers(0, 3, size=(30, 3)).astype(float), 20, axis=0)
        x[:230] = [1.0, 1.0, 1.0]
    elif case == "line":
        x = np.arange(300.0)[:, None] * [1, 0, 0]
    elif case == "few":
        x = rng.uniform(size=(4, 3))
    else:
        x = rng.normal(size=(400, 12))
    ids = rng.permutation(len(x) * 3)[: len(x)]
    got = {tuple(r) for r in neighbours.neighbour_pairs(frame(spark, x, ids), 5, leaf=60, sample=300).collect()}
    assert got == brute_pairs(x, ids, 5)


def test_index_is_a_partition_and_probes_find_all():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 3))
    t = neighbours.CrossPolytopes(x[:1500], 4000, leaf=50)
    b = t.bucket(x)
    assert t.leaves > 40 and len(np.unique(b)) == t.leaves
    q = x[:200]
    radius = np.full(200, 0.3)
    rows, found = t.probes(q, radius)
    probed = set(zip(rows.tolist(), found.tolist(), strict=True))
    for i in range(200):
        near = np.flatnonzero(((x - q[i]) ** 2).sum(axis=1) <= 0.09)
        assert all((i, int(b[j])) in probed for j in near)
    rows, found = t.probes(q[:2], np.array([np.inf, 0.0]))
    assert set(found[rows == 0].tolist()) == set(range(t.leaves)) and int(b[1]) in found[rows == 1]
    h = neighbours.hadamard(np.eye(8))
    assert np.allclose(h @ h.T, np.eye(8))


def test_neighbours_edges(spark):
    rows = [(1, [0.0, 0.0]), (2, None), (3, [0.0, float("nan")]), (4, [1.0, 0.0]), (4, [1.0, 0.0]), (None, [0.0, 0.0]), (5, [1.0]), (6, [float("inf"), 0.0]), (7, [0.0, -0.0])]
    d = spark.createDataFrame(rows, "id bigint, v array<double>").withColumn("vec", F.lit(3)).withColumn("member", F.lit(0))
    c = peaks.clean(d, "id", F.col("v"), 2)
    assert sorted(r["member"] for r in c.collect()) == [1, 4, 7]
    assert {tuple(r) for r in neighbours.neighbour_pairs(c, 1).collect()} == {(1, 7), (1, 4)}
    assert neighbours.neighbour_pairs(c.limit(0)).count() == 0
    assert neighbours.neighbour_pairs(c.where("member = 1")).count() == 0


def cliques(rng, dims, n, radius):
    """Tight groups far apart, and points alone."""
    x, group = [], []
    for g in range(n):
        centre = rng.uniform(-1, 1, dims) * 40 * radius
        for _ in range(int(rng.integers(1, 12))):
            x.append(centre + rng.uniform(-1, 1, dims) * radius / (2.2 * np.sqrt(dims)))
            group.append(g)
    return np.array(x), np.array(group)


def components(x, radius):
    near = ((x[:, None] - x[None]) ** 2).sum(axis=2) <= radius**2
    label = np.arange(len(x))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(x))])
        if (new == label).all():
            return label
        label = new


@pytest.mark.parametrize(("dims", "most"), [(3, 12_000), (16, 12_000), (3, 40)])
def test_clusters_of_similar_vectors(spark, dims, most):
    rng = np.random.default_rng(dims)
    x, _ = cliques(rng, dims, 120, 0.3)
    x = np.concatenate([x, np.repeat(x[:3], 50, axis=0)])
    label = components(x, 0.3)
    ids = rng.permutation(len(x))
    smallest = {g: ids[label == g].min() for g in np.unique(label)}
    expected = {(int(ids[i]), int(smallest[label[i]])) for i in range(len(x)) if (label == label[i]).sum() >= 4}
    got = peaks.clusters(frame(spark, x, ids), 0.3, sample=150, leaf=40, most=most)
    rows = got.collect()
    assert {(r["member"], r["cluster_id"]) for r in rows} == expected
    size = {g: int((label == g).sum()) for g in np.unique(label)}
    by_id = {int(smallest[g]): n for g, n in size.items()}
    assert all(r["size"] == by_id[r["cluster_id"]] for r in rows)
    top = {r["cluster_id"]: r["typical"] for r in peaks.typical(got).collect()}
    assert all(len(v) == 3 for v in top.values()) and len(top) == len({c for _, c in expected})


@pytest.mark.parametrize("most", [12_000, 150])
def test_dense_groups_are_counted_by_sums(spark, most):
    rng = np.random.default_rng(9)
    inside = lambda n, r: (v := rng.normal(size=(n, 16))) / np.linalg.norm(v, axis=1)[:, None] * r * rng.uniform(0.2, 1, (n, 1))
    x = np.concatenate([inside(400, 0.7) + 3, inside(90, 0.74), rng.uniform(-8, 8, size=(200, 16)), inside(40, 1.6) + 20])
    ids = rng.permutation(len(x))
    d2 = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    near = d2 <= 1.5**2
    places = frame(spark, x, ids).select(F.col("member").alias("place"), F.lit(1).cast("bigint").alias("weight"), "vec")
    got = {r["place"]: r for r in peaks.peaks(places, 1.5, sample=200, leaf=60, most=most).collect()}
    order = {int(i): k for k, i in enumerate(ids)}
    for i, k in order.items():
        r = got[i]
        assert r["density"] == near[k].sum() - 1
        assert r["spread"] == pytest.approx(np.sqrt(d2[k][near[k]].sum() / r["density"]) if r["density"] else 0.0, abs=1e-6)
        up = [j for j in order if near[k][order[j]] and (got[j]["density"], -j) > (r["density"], -i)]
        assert (r["to"] in up) if up else r["to"] is None
    label = components(x, 1.5)
    smallest = {g: ids[label == g].min() for g in np.unique(label)}
    expected = {(int(ids[i]), int(smallest[label[i]])) for i in range(len(x)) if (label == label[i]).sum() >= 4}
    rows = peaks.clusters(frame(spark, x, ids), 1.5, sample=200, leaf=60, most=most).collect()
    assert {(r["member"], r["cluster_id"]) for r in rows} == expected


def test_pointers_follow_density(spark):
    x = np.array([[0.0], [0.9], [1.8], [2.7], [3.0], [10.0]])
    p = {r["place"]: r for r in peaks.peaks(frame(spark, x).select(F.col("member").alias("place"), F.lit(1).cast("bigint").alias("weight"), "vec"), 1.0).collect()}
    assert [p[i]["density"] for i in range(6)] == [1, 2, 2, 2, 1, 0]
    assert (p[0]["to"], p[1]["to"], p[2]["to"], p[3]["to"], p[4]["to"], p[5]["to"]) == (1, None, 1, 2, 3, None)
    root = {r["place"]: r["to"] for r in peaks.follow(spark.createDataFrame([(i, i - 1) for i in range(1, 40)], "place bigint, to bigint")).collect()}
    assert set(root.values()) == {0} and len(root) == 39


@pytest.mark.parametrize("seed", range(3))
def test_connected_sets_with_several_peaks(spark, seed):
    rng = np.random.default_rng(seed)
    x = rng.uniform(size=(350, 2)) * 9
    label = components(x, 0.35)
    expected = {(i, int(label[i])) for i in range(len(x)) if (label == label[i]).sum() >= 4}
    p = peaks.peaks(frame(spark, x).select(F.col("member").alias("place"), F.lit(1).cast("bigint").alias("weight"), "vec"), 0.35)
    assert p.where("to is null").count() > len(np.unique(label))
    got = peaks.clusters(frame(spark, x), 0.35, sample=100, leaf=50)
    assert {(r["member"], r["cluster_id"]) for r in got.collect()} == expected


def test_clusters_of_nothing(spark):
    d = frame(spark, np.zeros((0, 3)))
    assert peaks.clusters(d, 0.3).count() == 0
    one = frame(spark, np.ones((5, 3)))
    assert {(r["member"], r["cluster_id"], r["size"]) for r in peaks.clusters(one, 0.3).collect()} == {(i, 0, 5) for i in range(5)}


def test_search_within_a_bucket():
    from tidewright.functions.nearest import Splits, nearest, search

    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(2500, 3)), rng.normal(size=(1500, 3)) * 1e-3 + 1])
    ids = rng.permutation(len(x))
    q = np.concatenate([x[::7], rng.uniform(-3, 3, size=(50, 3))])
    iq = np.concatenate([ids[::7], np.arange(50) + len(x)])
    want = nearest(q, iq, x, ids, 5)
    for index in (neighbours.CrossPolytopes(x, len(x), 128, 8), Splits(x, 128)):
        assert all(np.array_equal(a, b) for a, b in zip(search(index, q, iq, x, ids, 5), want, strict=True))
    most = rng.uniform(0, 0.02, len(q))
    want = nearest(q, iq, x, ids, 5, most)
    assert all(np.array_equal(a, b) for a, b in zip(search(neighbours.CrossPolytopes(x, len(x), 128, 8), q, iq, x, ids, 5, most), want, strict=True))


def test_many_rows_of_a_task_are_split_again():
    rng = np.random.default_rng(6)
    b = np.concatenate([rng.uniform(size=(5000, 3)) * 6, rng.normal(size=(600, 3)) * 0.02 + 3])
    a = b[::9] + 0.01
    found = {}
    for kind, i, what in peaks.relate(a, b, 0.3):
        pairs = [(x, y) for x in i for y in what[0]] if kind == "ball" else zip(i, what[0], strict=True)
        for x, y in pairs:
            found[int(x), int(y)] = found.get((int(x), int(y)), 0) + 1
    near = ((a[:, None] - b[None]) ** 2).sum(axis=2) <= 0.09
    assert set(found.values()) == {1} and set(found) == set(zip(*map(np.ndarray.tolist, np.nonzero(near)), strict=True))
