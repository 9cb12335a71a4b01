"""Clusters of mutually similar vectors by density peaks.

The density of a vector is the number of vectors within ``radius``; it points to its nearest denser vector
within ``radius`` (of equal densities the smaller id counts as denser), and vectors without one are peaks.
Following the pointers gives the labels. Dense groups are handled as balls: their members are counted by
sums, and of a ball that lies within reach as a whole only the densest member is a candidate to point to.

Neighbours come from a blocked join. A tree of median splits, fitted on a sample of at most ``sample``
rows, cuts the space into blocks along the directions of largest spread; a vector belongs to one block and
is also sent to those within ``radius`` of it, so every neighbour pair meets in the block of either end. A
block of more than ``most`` vectors is cut into parts, and each pair of parts is a task of its own, so no
task holds an unbounded block. Distances are direct differences in double precision.

Where the vectors within reach of each other form sets that are all similar to each other, each set has one
peak, its smallest id. Elsewhere a set connected by similarity may have several peaks; ``clusters`` then
joins those whose members are similar across the border, so that its clusters are exactly the connected sets.
Which labels need that is told by a mark (the exclusive or of hashed ids) of the vectors that each one is similar
to: where it is that of the whole label for all of its members, the label has no border, and only the others
are compared once more.

Defined results
---------------
* null vectors, vectors of another length than ``dims`` and those with a null, NaN or infinite component
  take no part; neither do null ids; rows of one id count once;
* equal vectors are joined to one place that counts as often as it is held, so any number of copies is
  one row in the neighbour join;
* an empty table gives an empty result; further columns do not take part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewright.functions.nearest import Splits
from tidewright.session import cut, drop

SAMPLE, LEAF, MOST = 20_000, 1500, 40_000
#: Rows of a task beyond which it splits them further for itself; pairs of rows and ball beyond which the ball is
#: cut into pieces, and rows of a piece.
LOCAL, PAIRS, PIECE = 4_096, 200_000, 32


class Blocks:
    """Median splits along the leading directions of a sample; a block is a leaf."""

    def __init__(self, x: np.ndarray, n: int, radius: float, leaf: int = LEAF, directions: int = 8):
        d = x.shape[1]
        self.centre = x.mean(axis=0) if len(x) else np.zeros(d)
        if d <= 3 or len(x) < 2:
            self.axes = np.eye(d)
        else:
            _, v = np.linalg.eigh(np.cov((x - self.centre).T))
            self.axes = v[:, ::-1][:, : min(d, directions)]
        z = (x - self.centre) @ self.axes
        self.axis, self.at, self.low, self.high, self.leaf = [], [], [], [], []
        self.n = 0
        self._split(z, n / max(len(x), 1), radius, leaf)
        self.axis, self.at, self.low, self.high, self.leaf = map(np.array, (self.axis, self.at, self.low, self.high, self.leaf))

    def _split(self, z: np.ndarray, weight: float, radius: float, leaf: int) -> None:
        todo = [(z, -1, 0)]
        while todo:
            own, parent, side = todo.pop()
            me = len(self.axis)
            if parent >= 0:
                (self.low if side == 0 else self.high)[parent] = me
            self.axis.append(-1), self.at.append(0.0), self.low.append(-1), self.high.append(-1), self.leaf.append(-1)
            if len(own) * weight > leaf and len(own) >= 16:
                # A split costs the rows within radius of it on either side; take the cheapest that halves the block.
                mid = np.median(own, axis=0)
                near = (np.abs(own - mid) <= radius).mean(axis=0)
                k = int(np.argmin(near))
                right = own[:, k] > mid[k]
                if near[k] < 0.7 and 0 < right.sum() < len(own):
                    self.axis[me], self.at[me] = k, float(mid[k])
                    todo += [(own[right], me, 1), (own[~right], me, 0)]
                    continue
            self.leaf[me] = self.n
            self.n += 1

    def reach(self, x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows and blocks within ``radius`` of each other, and whether the row is at home there."""
        z = (x - self.centre) @ self.axes
        rows, node, home = np.arange(len(x)), np.zeros(len(x), int), np.ones(len(x), bool)
        out = []
        while len(rows):
            done = self.axis[node] < 0
            out.append((rows[done], self.leaf[node[done]], home[done]))
            rows, node, home = rows[~done], node[~done], home[~done]
            gap = z[rows, self.axis[node]] - self.at[node]
            # The margin allows for rounding in the projection.
            left, right = gap <= radius * (1 + 1e-9) + 1e-9, gap > -radius * (1 + 1e-9) - 1e-9
            at_left = gap <= 0
            rows, node, home = np.concatenate([rows[left], rows[right]]), np.concatenate([self.low[node[left]], self.high[node[right]]]), np.concatenate([(home & at_left)[left], (home & ~at_left)[right]])
        return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool))


def near_pairs(a: np.ndarray, b: np.ndarray, radius: float, step: int = 64):
    """Chunks of (i, j, squared distance) with |a_i - b_j| <= radius.

    Both sides are ordered along the coordinate of largest spread; a chunk of ``a`` meets only the stretch of
    ``b`` that its radius reaches there.
    """
    if len(a) == 0 or len(b) == 0:
        return
    r2 = radius * radius
    axis = int(np.argmax(b.std(axis=0)))
    oa, ob = np.argsort(a[:, axis], kind="stable"), np.argsort(b[:, axis], kind="stable")
    a, b = a[oa], b[ob]
    along = b[:, axis]
    reach = radius + 1e-12 * (1 + np.abs(along).max())
    shift = b.mean(axis=0)
    bs = b - shift
    nb = (bs * bs).sum(axis=1)
    slack = 1e-6 * (r2 + nb.max() * 1e-3 + 1e-3)
    for lo in range(0, len(a), step):
        p = a[lo : lo + step]
        first, last = np.searchsorted(along, p[0, axis] - reach, "left"), np.searchsorted(along, p[-1, axis] + reach, "right")
        p = p - shift
        # The product form only preselects; what passes is measured by its differences.
        rough = (p * p).sum(axis=1)[:, None] + nb[first:last] - 2 * (p @ bs[first:last].T)
        i, j = np.nonzero(rough <= r2 + slack)
        i, j = lo + i, first + j
        diff = a[i] - b[j]
        d2 = (diff * diff).sum(axis=1)
        ok = d2 <= r2
        yield oa[i[ok]], ob[j[ok]], d2[ok]


#: Smallest group of rows that is treated as one ball, and rows looked at for finding such groups.
BALL, PILOTS = 64, 64


def balls(x: np.ndarray, radius: float) -> tuple[list[tuple[np.ndarray, np.ndarray, float]], np.ndarray]:
    """Groups of at least ``BALL`` rows in balls of half the ``radius`` (rows, centre, reach), and the other rows.

    Pilots, spread evenly over the rows, look for crowded places: the rows within ``radius`` of a pilot give a
    centre, and those within half the radius of it a ball. Rows of one ball are all similar to each other, so
    a dense group is counted by its sums, not by its pairs. Rounds go on while they find balls; a dense group
    that no pilot meets holds a small share of the rows and is compared pair by pair, like all other rows.
    """
    free = np.arange(len(x))
    out = []
    while len(free) >= BALL:
        found = False
        for pilot in free[np.unique(np.linspace(0, len(free) - 1, PILOTS).astype(int))]:
            own = x[free] - x[pilot]
            near = free[(own * own).sum(axis=1) <= radius * radius]
            if len(near) < BALL or pilot not in near:
                continue
            centre = x[near].mean(axis=0)
            d = np.sqrt(((x[near] - centre) ** 2).sum(axis=1))
            inside = d <= radius / 2
            if inside.sum() >= BALL:
                out.append((near[inside], centre, float(d[inside].max())))
                free = np.setdiff1d(free, near[inside], assume_unique=True)
                found = True
                if len(free) < BALL:
                    break
        if not found:
            break
    return out, free


def relate(a: np.ndarray, b: np.ndarray, radius: float):
    """How ``a`` and ``b`` are similar: (rows of a, ball) where all of a ball is within ``radius`` of the rows, and
    (i, j, squared distance) for the pairs found otherwise. Each similar pair is in exactly one of these.

    Many rows are split by a tree of their own first, so that the work per row does not grow with them.
    """
    if len(a) == 0 or len(b) == 0:
        return
    if len(b) > LOCAL:
        tree = Blocks(b, len(b), radius)
        if tree.n > 1:
            rows, leaf, home = tree.reach(b, radius)
            members = _by_leaf(rows[home], leaf[home], tree.n)
            for i, j in zip(_by_leaf(*tree.reach(a, radius)[:2], tree.n), members, strict=True):
                for kind, at, what in _relate(a[i], b[j], radius):
                    yield kind, i[at], (j[what[0]], *what[1:])
            return
    yield from _relate(a, b, radius)


def _by_leaf(rows: np.ndarray, leaf: np.ndarray, n: int) -> list[np.ndarray]:
    order = np.argsort(leaf, kind="stable")
    return np.split(rows[order], np.searchsorted(leaf[order], np.arange(1, n)))


def _relate(a: np.ndarray, b: np.ndarray, radius: float):
    if len(a) == 0 or len(b) == 0:
        return
    groups, single = balls(b, radius)
    for group in groups:
        members, centre, reach = group
        d = np.sqrt(((a - centre) ** 2).sum(axis=1))
        whole = d + reach <= radius * (1 - 1e-9)
        some = np.flatnonzero(~whole & (d - reach <= radius * (1 + 1e-9)))
        if whole.any():
            yield "ball", np.flatnonzero(whole), group
        if len(some) * len(members) > PAIRS:
            for kind, i, what in _pieces(a[some], b[members], radius):
                yield kind, some[i], (members[what[0]], *what[1:])
            continue
        for i, j, d2 in near_pairs(a[some], b[members], radius):
            yield "pairs", some[i], (members[j], d2)
    for i, j, d2 in near_pairs(a, b[single], radius):
        yield "pairs", i, (single[j], d2)


def _pieces(a: np.ndarray, b: np.ndarray, radius: float):
    """As :func:`relate`, for rows of ``a`` whose radius ends within a ball ``b``: the ball is cut into small pieces, most of
    which lie within the radius of a row as a whole or not at all."""
    for j in _by_leaf(np.arange(len(b)), *_leaves(b)):
        centre = b[j].mean(axis=0)
        reach = float(np.sqrt(((b[j] - centre) ** 2).sum(axis=1).max()))
        d = np.sqrt(((a - centre) ** 2).sum(axis=1))
        whole = d + reach <= radius * (1 - 1e-9)
        some = np.flatnonzero(~whole & (d - reach <= radius * (1 + 1e-9)))
        if whole.any():
            yield "ball", np.flatnonzero(whole), (j, centre, reach)
        for x, y, d2 in near_pairs(a[some], b[j], radius, step=1024):
            yield "pairs", some[x], (j[y], d2)


def _leaves(b: np.ndarray) -> tuple[np.ndarray, int]:
    tree = Splits(b, PIECE)
    return tree.bucket(b), tree.n


def per_row(i: np.ndarray) -> np.ndarray:
    """Where each row's stretch begins in ``i``, in which the pairs of a row follow each other."""
    return np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1])))


def hashed(ids: np.ndarray) -> np.ndarray:
    """Well-mixed 64-bit numbers of ids."""
    with np.errstate(over="ignore"):
        h = ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        return (h ^ (h >> np.uint64(31))).view(np.int64)


def _vectors(p: pd.DataFrame) -> np.ndarray:
    return np.stack(p["vec"].to_numpy()).astype(np.float64) if len(p) else np.zeros((0, 1))


def placed(rows: DataFrame, tree, radius: float, most: int, sizes: dict[int, int] | None = None) -> DataFrame:
    """``rows`` (place, weight, vec, ...) once per task that needs them: block, part of the left side i, of the right side j.

    Blocks of ``sizes`` have more than one part: their rows at home go to (i, all j), every row to (all i, j).
    """
    spark = rows.sparkSession
    made, parts = spark.sparkContext.broadcast(tree), spark.sparkContext.broadcast(sizes or {})
    cols = rows.columns

    def run(batches):
        for p in batches:
            if len(p) == 0:
                continue
            r, block, home = made.value.reach(_vectors(p), radius)
            # Who is at home is compared with everyone who is there.
            out = {"at": r, "block": block, "i": np.zeros(len(r), int), "j": np.zeros(len(r), int), "left": home, "right": np.ones(len(r), bool)}
            if parts.value:
                split = np.array([parts.value.get(int(b), 1) for b in block])
                big = split > 1
                if big.any():
                    key = p["place"].to_numpy()
                    out["own"] = (hashed(key[r]).view(np.uint64) % split.astype(np.uint64)).astype(int)
                    every = np.repeat(np.flatnonzero(big), split[big])
                    turn = np.arange(len(every)) - np.repeat(np.cumsum(split[big]) - split[big], split[big])
                    asks = home[every]
                    right = {k: v[every] for k, v in out.items()} | {"i": turn, "j": out["own"][every], "left": np.zeros(len(every), bool)}
                    left = {k: v[every[asks]] for k, v in out.items()} | {"i": out["own"][every[asks]], "j": turn[asks], "left": np.ones(asks.sum(), bool), "right": np.zeros(asks.sum(), bool)}
                    out = {k: np.concatenate([v[~big], right[k], left[k]]) for k, v in out.items() if k != "own"}
            at = out.pop("at")
            yield p.iloc[at].reset_index(drop=True).assign(**out)

    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    return rows.mapInPandas(run, f"{schema}, block int, i int, j int, left boolean, right boolean").select(*cols, "block", "i", "j", "left", "right")


def peaks(places: DataFrame, radius: float, sample: int = SAMPLE, leaf: int = LEAF, most: int = MOST, tree: Blocks | None = None, sizes: dict[int, int] | None = None) -> DataFrame:
    """place, weight, density, root mean square distance to the neighbours, mark of the places within ``radius``, its own
    mark, and the denser place it points to (null for peaks)."""
    n = places.count()
    if n == 0:
        none = F.lit(None).cast("bigint")
        return places.select("place", "weight", none.alias("density"), F.lit(0.0).alias("spread"), none.alias("mark"), none.alias("own"), none.alias("to")).limit(0)
    tree = tree or tree_of(places, n, radius, sample, leaf)
    sizes = part_counts(places, tree, radius, most) if sizes is None else sizes

    def density(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("place")
        a, b = p[p["left"]], p[p["right"]]
        w, x, y = b["weight"].to_numpy(), _vectors(a), _vectors(b)
        total, far, mark, h = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a), np.int64), hashed(b["place"].to_numpy())
        for kind, i, what in relate(x, y, radius):
            if kind == "ball":
                members, centre, _ = what
                v, own = y[members] - centre, w[members]
                u = x[i] - centre
                total[i] += own.sum()
                mark[i] ^= np.bitwise_xor.reduce(h[members])
                far[i] += own.sum() * (u * u).sum(axis=1) - 2 * u @ (own @ v) + own @ (v * v).sum(axis=1)
            else:
                j, d2 = what
                if len(i):
                    at = per_row(i)
                    total[i[at]] += np.add.reduceat(w[j], at)
                    far[i[at]] += np.add.reduceat(w[j] * d2, at)
                    mark[i[at]] ^= np.bitwise_xor.reduceat(h[j], at)
        ids = a["place"].to_numpy()
        return pd.DataFrame({"place": ids, "n": np.rint(total).astype(np.int64), "far": np.maximum(far, 0.0), "mark": mark, "own": hashed(ids)})

    first = placed(places, tree, radius, most, sizes).groupBy("block", "i", "j").applyInPandas(density, "place bigint, n bigint, far double, mark bigint, own bigint")
    dense = first.groupBy("place").agg((F.sum("n") - 1).alias("density"), F.sum("far").alias("far"), F.bit_xor("mark").alias("mark"), F.first("own").alias("own"))
    known = cut(places.join(dense, "place").select("place", "weight", "density", "far", "mark", "own", "vec"))

    def denser(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("place")
        a, b = p[p["left"]], p[p["right"]]
        ia, ib = a["place"].to_numpy(), b["place"].to_numpy()
        na, nb = a["density"].to_numpy(), b["density"].to_numpy()
        x, y = _vectors(a), _vectors(b)
        found = [(np.zeros(0, int), np.zeros(0), np.zeros(0, np.int64))]
        for kind, i, what in relate(x, y, radius):
            if kind == "ball":
                # All of the ball is in reach: its densest row stands for it.
                head = what[0][np.lexsort((ib[what[0]], -nb[what[0]]))[0]]
                j, d2 = np.full(len(i), head), ((x[i] - y[head]) ** 2).sum(axis=1)
            else:
                j, d2 = what
            up = (nb[j] > na[i]) | ((nb[j] == na[i]) & (ib[j] < ia[i]))
            i, j, d2 = i[up], j[up], d2[up]
            order = np.lexsort((ib[j], d2, i))
            i, j, d2 = i[order], j[order], d2[order]
            one = np.concatenate(([True], i[1:] != i[:-1])) if len(i) else np.zeros(0, bool)
            found.append((i[one], d2[one], ib[j[one]]))
        i, d2, to = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((to, d2, i))
        i, d2, to = i[order], d2[order], to[order]
        one = np.concatenate(([True], i[1:] != i[:-1])) if len(i) else np.zeros(0, bool)
        return pd.DataFrame({"place": ia[i[one]], "d2": d2[one], "to": to[one]})

    # Alone in its radius a place has nothing to point to.
    crowd = known.where(F.col("density") >= F.col("weight"))
    second = placed(crowd.select("place", "density", "vec"), tree, radius, most, sizes).groupBy("block", "i", "j").applyInPandas(denser, "place bigint, d2 double, to bigint")
    to = second.groupBy("place").agg(F.min(F.struct("d2", "to"))["to"].alias("to"))
    spread = F.when(F.col("density") > 0, F.sqrt(F.col("far") / F.col("density"))).otherwise(0.0)
    return known.select("place", "weight", "density", spread.alias("spread"), "mark", "own").join(to, "place", "left")


def tree_of(places: DataFrame, n: int, radius: float, sample: int, leaf: int) -> Blocks:
    """Blocks fitted on the ``sample`` rows that come first by the hash of their id."""
    fit = places.orderBy(F.xxhash64("place"), "place").limit(sample).select("vec").toPandas()
    return Blocks(_vectors(fit), n, radius, leaf)


def part_counts(places: DataFrame, tree: Blocks, radius: float, most: int) -> dict[int, int]:
    """Number of parts of the blocks with more than ``most`` rows; there are at most n / most of them."""
    made = places.sparkSession.sparkContext.broadcast(tree)

    def sizes_of(batches):
        for p in batches:
            if len(p):
                b, c = np.unique(made.value.reach(_vectors(p), radius)[1], return_counts=True)
                yield pd.DataFrame({"block": b, "n": c})

    count = places.select("vec").mapInPandas(sizes_of, "block int, n bigint").groupBy("block").agg(F.sum("n").alias("n")).where(F.col("n") > most)
    return {r["block"]: -(-r["n"] // most) for r in count.collect()}


def bridges(rooted: DataFrame, tree: Blocks, radius: float, most: int, sizes: dict[int, int]) -> DataFrame:
    """Pairs of peaks (both ways) whose followers are within ``radius`` of each other. ``rooted``: place, vec, root."""

    def across(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("place")
        a, b = p[p["left"]], p[p["right"]]
        ra, rb = a["root"].to_numpy(), b["root"].to_numpy()
        found = [np.zeros((0, 2), np.int64)]
        for kind, i, what in relate(_vectors(a), _vectors(b), radius):
            if kind == "ball":
                one, two = np.unique(ra[i]), np.unique(rb[what[0]])
                pairs = np.column_stack([np.repeat(one, len(two)), np.tile(two, len(one))])
            else:
                pairs = np.column_stack([ra[i], rb[what[0]]])
            found.append(np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0))
        return pd.DataFrame(np.unique(np.concatenate(found), axis=0), columns=["a", "b"])

    made = placed(rooted.select("place", "root", "vec"), tree, radius, most, sizes).groupBy("block", "i", "j").applyInPandas(across, "a bigint, b bigint")
    both = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return made.select(F.explode(both).alias("e")).select("e.a", "e.b").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """a and the smallest id of its connected set, for edges (a, b) given both ways."""
    edges = cut(edges)
    label = last = cut(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to")))
    while True:
        near = edges.join(label.select(F.col("a").alias("b"), F.col("to").alias("n")), "b").groupBy("a").agg(F.min("n").alias("n"))
        nxt = label.join(near, "a").select("a", F.least("to", "n").alias("n"), "to")
        # One more step along the labels found so far.
        jump = label.select(F.col("a").alias("n"), F.col("to").alias("m"))
        nxt = cut(nxt.join(jump, "n", "left").select("a", F.least("n", "m").alias("new"), "to"))
        if nxt.where("new <> to").limit(1).count() == 0:
            return nxt.select("a", "to")
        drop(last)
        last, label = nxt, nxt.select("a", F.col("new").alias("to"))


def follow(pointers: DataFrame) -> DataFrame:
    """place and the peak at the end of its pointers; each round doubles the way that a pointer spans."""
    cur = last = cut(pointers.where("to is not null").select("place", "to"))
    while True:
        nxt = cur.join(cur.select(F.col("place").alias("to"), F.col("to").alias("further")), "to", "left")
        nxt = cut(nxt.select("place", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")))
        if nxt.where("moved").limit(1).count() == 0:
            return nxt.select("place", "to")
        drop(last)
        last, cur = nxt, nxt.select("place", "to")


def clean(rows: DataFrame, key: str, vec: Column, dims: int) -> DataFrame:
    """member and vec (array of doubles) of the rows that take part, each id once."""
    v = vec.cast("array<double>")
    ok = F.col("vec").isNotNull() & (F.size("vec") == dims) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col(key).isNotNull()).select(F.col(key).alias("member"), v.alias("vec")).where(ok).dropDuplicates(["member"])


def clusters(members: DataFrame, radius: float, least: int = 4, sample: int = SAMPLE, leaf: int = LEAF, most: int = MOST) -> DataFrame:
    """member, cluster_id (the smallest member), size, density and spread; clusters of at least ``least`` members."""
    members = cut(members)
    places = cut(members.groupBy("vec").agg(F.min("member").alias("place"), F.count("*").alias("weight")).select("place", "weight", "vec"))
    n = places.count()
    tree = tree_of(places, max(n, 1), radius, sample, leaf) if n else None
    sizes = part_counts(places, tree, radius, most) if n else {}
    p = cut(peaks(places, radius, most=most, tree=tree, sizes=sizes))
    root = cut(p.join(follow(p).withColumnRenamed("to", "root"), "place", "left").select("place", "weight", "density", "spread", "mark", "own", F.coalesce("root", "place").alias("root")))
    if n:
        marks = root.groupBy("root").agg(F.bit_xor("own").alias("whole"), F.min("mark").alias("low"), F.max("mark").alias("high"))
        torn = cut(marks.where("low <> whole or high <> whole").select("root"))
        if torn.limit(1).count():
            crowd = root.join(torn, "root").where(F.col("density") >= F.col("weight")).select("place", "root").join(places.select("place", "vec"), "place")
            border = cut(bridges(crowd, tree, radius, most, sizes))
            if border.limit(1).count():
                joined = connected(border).select(F.col("a").alias("root"), F.col("to").alias("_to"))
                root = root.join(joined, "root", "left").withColumn("root", F.coalesce("_to", "root")).drop("_to")
    size = root.groupBy("root").agg(F.sum("weight").alias("size"), F.min("place").alias("cluster_id")).where(F.col("size") >= least)
    of = root.join(size, "root").select("place", "cluster_id", "size", "density", "spread")
    # A place's members are its copies: those held once are the place itself, others are looked up by their vector.
    single = of.join(places.where("weight = 1").select("place"), "place", "left_semi").withColumnRenamed("place", "member")
    copies = of.join(places.where("weight > 1").select("place", "vec"), "place")
    several = members.join(copies, "vec").select("member", "cluster_id", "size", "density", "spread")
    return single.select(*several.columns).union(several)


def typical(found: DataFrame, n: int = 3) -> DataFrame:
    """Per cluster its size and its ``n`` most typical members: densest, then nearest to their neighbours (to nine
    digits), then of smallest id. A window that keeps only the first rows of a cluster needs no cluster in one task."""
    rn = F.row_number().over(W.partitionBy("cluster_id").orderBy(F.desc("density"), F.round("spread", 9), "member"))
    top = found.withColumn("rn", rn).where(F.col("rn") <= n)
    return top.groupBy("cluster_id").agg(F.first("size").alias("size"), F.transform(F.array_sort(F.collect_list(F.struct("rn", "member"))), lambda x: x["member"]).alias("typical"))
