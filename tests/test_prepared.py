"""The general data-preparation operators on small hostile inputs, against plain versions of their rules."""

import datetime as dt
import random
import re

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from tidewright.operators import compact, regular, rejects, spikes
from tidewright.session import ranked

DIALECTS = "dialect_id int, dialect_name string, sep_char string, quote_char string, column_names array<string>, column_types array<string>, vertex_columns array<string>, field_columns array<string>"
LINES = "line_id bigint, file_id bigint, case_id bigint, dialect_id int, write_time string, line_no int, raw_line string, x int"


@pytest.fixture(scope="module")
def dialects(spark):
    rows = [
        (1, "blank", " ", '"', ["x", "y", "v", "ok"], ["float", "float", "float", "flag"], ["x", "y"], ["v"]),
        (2, "comma", ",", '"', ["name", "x", "v"], ["label", "float", "float"], ["x"], ["v"]),
        (3, "semi", ";", '"', ["x", "name", "ok"], ["float", "label", "flag"], ["x"], []),
    ]
    return spark.createDataFrame(rows, DIALECTS)


def split(s, sep, q='"'):
    """The values of a line, or None where quoting is broken; character by character."""
    out, i, n = [], 0, len(s)
    skip = sep != " "
    while True:
        j = i
        while skip and j < n and s[j] == " ":
            j += 1
        if j < n and s[j] == q:
            k, v = j + 1, ""
            while True:
                if k >= n:
                    return None
                if s[k] == q:
                    if s[k + 1 : k + 2] == q:
                        v, k = v + q, k + 2
                        continue
                    break
                v, k = v + s[k], k + 1
            k += 1
            while skip and k < n and s[k] == " ":
                k += 1
            if k < n and s[k] != sep:
                return None
        else:
            k = s.find(sep, i)
            k = n if k < 0 else k
            v = s[i:k]
            if q in v:
                return None
        out.append(v.strip(" ") if skip else v)
        if k >= n:
            return out
        i = k + 1


def reason(s, d):
    v = split(s, d["sep"])
    if v is None:
        return "quoting"
    if len(v) != len(d["types"]):
        return "column_count"
    for j, (kind, x) in enumerate(zip(d["types"], v, strict=True)):
        if kind == "flag" and x not in ("0", "1"):
            return "invalid_value"
        if kind == "float" and not re.fullmatch(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?", x) and not (j in d["fields"] and x.lower() in ("", "nan")):
            return "invalid_value"
    return None


def test_lines_against_a_reader_of_characters(spark, dialects):
    known = rejects.dialects(dialects.collect())
    rng = random.Random(5)
    rows = []
    for i in range(6000):
        k = rng.choice((1, 2, 3))
        if rng.random() < 0.5:
            s = "".join(rng.choice('",; 1.e-n0a') for _ in range(rng.randrange(1, 14)))
        else:
            s = known[k]["sep"].join(rng.choice(['"a b"', '"a""b"', "1.5", "-2e3", "nan", "NaN", "", "0", "1", " 1 ", '" 7"', '"x', 'y"', "+.5", "5.", "inf", "1e", "é", "٣"]) for _ in range(rng.choice((len(known[k]["types"]), 2, 5))))
        rows.append((i, 0, 0, k, "0", i, s, 1))
    got = {r["line_id"]: r["reason"] for r in rejects.load_lines(spark.createDataFrame(rows, LINES), dialects).collect()}
    for i, *_, k, _t, _n, s, _x in ((r[0], r[1], r[2], r[3], r[4], r[5], r[6], r[7]) for r in rows):
        if not s.strip():
            assert i not in got
        else:
            assert got[i] == reason(s, known[k]), (k, s, got[i])


def test_lines_edges(spark, dialects):
    long = '"' + "b" * 200_000 + '",1,2'
    rows = [
        (1, 1, 1, 2, "0", 0, None, 0), (2, 1, 1, 2, "0", 1, "", 0), (3, 1, 1, 2, "0", 2, "   ", 0), (4, 1, 1, 2, "0", 3, "# a", 0), (5, 1, 1, 2, "0", 4, "TITLE", 0),
        (6, 1, 1, 2, "0", 5, long, 0), (7, 1, 1, None, "0", 6, "a,1,2", 0), (8, 1, None, 9, "0", 7, "a,1,2", 0), (9, 1, 1, 2, "0", 8, 'a,"+1.5", nan ', 0), (9, 1, 1, 2, "0", 8, 'a,"+1.5", nan ', 0), (None, None, None, 2, None, None, "a", 0),
    ]
    got = {r["line_id"]: r for r in rejects.load_lines(spark.createDataFrame(rows, LINES), dialects).collect()}
    assert set(got) == {6, 7, 8, 9, None}
    assert got[6]["reason"] is None and len(got[6]["labels"][0]) == 200_000
    assert got[7]["reason"] == got[8]["reason"] == "no_dialect" and got[None]["reason"] == "column_count"
    assert got[9]["vertices"] == [1.5] and np.isnan(got[9]["fields"][0])
    assert rejects.failed_lines(spark.createDataFrame([], LINES), dialects).count() == 0


FILES = "file_id bigint, case_id bigint, loader string, processor int, write_time string, field_name string, file_path string, n_bytes bigint, body string, rec int"


def test_files_that_add_nothing(spark):
    body = "# point p\n1 2.0\n2 3.5\n"
    rows = [
        (1, 1, "foam", 0, "0.10", "p", "a", 1, body), (2, 1, "foam", 0, "1e-1", "p", "b", 1, "1,2\r\n2,3.50e0"), (3, 1, "foam", 0, "0.1", "p", "c", 1, "2 3.5\n"),
        (4, 1, "foam", 1, "0.1", "p", "d", 1, body), (5, 1, "foam", 0, "0.1", "p", "e", 1, "# only\n\n"), (6, 1, "foam", 0, "0.1", "p", "f", 1, None), (7, 1, "foam", 0, "0.1", "p", "g", 1, "2 3.5\n3 1\n"),
        (8, None, "foam", None, None, None, "h", 1, body), (9, None, "foam", None, None, None, "i", 1, body), (1, 1, "foam", 0, "0.10", "p", "a", 1, body), (10, 2, "foam", 0, "0.1", "p", "a", 1, "1 1\n1 1\n"),
    ]
    d = spark.createDataFrame([(*r, 0) for r in rows], FILES)
    assert sorted(r[0] for r in compact.redundant_files(d).collect()) == [2, 3, 5, 6, 9]
    packed = compact.bundles(d, codec="zstd").persist()
    assert compact.verify(packed).where("not intact").count() == 0
    plain = {r["case_id"]: bytes(r["body"]) for r in compact.bundles(d).collect()}
    for r in packed.collect():
        whole = b"".join(data for _, data in compact.members_of(bytes(r["body"])))
        assert zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(bytes(r["body"])) == whole
        assert whole == b"".join(data for _, data in compact.members_of(plain[r["case_id"]]))
    made = compact.bundles(d, target=200).persist()
    out = made.collect()
    records = sorted(x for r in out for x in bytes(r["body"]).decode().splitlines() if not x.startswith("#"))
    assert records == sorted(["1 2.0", "2 3.5", "1 2.0", "2 3.5", "3 1", "1 2.0", "2 3.5", "1 1"])
    assert compact.verify(made).where("not intact").count() == 0
    assert compact.redundant_files(d.limit(0)).count() == 0 and compact.bundles(d.limit(0)).count() == 0


def test_bytes_are_kept(spark):
    bodies = [b"# comment\r\n1 2.0\r\n\r\n2 3.0\r\n", b"3 1.0\n\n# end", b"\t4 1\n4 1.0\n 5,2 ", b"# nothing\n"]
    d = spark.createDataFrame([(i, 1, "foam", i, "0.1", "p", "a", 1, b.decode(), 0) for i, b in enumerate(bodies)], FILES)
    parts = {int(h["file_id"]): (h, data) for r in compact.bundles(d).collect() for h, data in compact.members_of(bytes(r["body"]))}
    assert parts[0][1] == bodies[0] and parts[1][1] == bodies[1] + b"\n" and parts[1][0]["open"] == "1" and 3 not in parts
    assert parts[2][0]["records"] == "3" and parts[2][1] == bodies[2] + b"\n"  # a line that begins with a tab is no record: text
    assert compact.restored(compact.bundles(d)).count() == 6


def test_frames_are_joined_as_they_are(spark):
    press = zstandard.ZstdCompressor(write_checksum=True)
    texts = [b"1 2\n" * 1000, b"", b"3 4\n"]
    frames = [press.compress(t) for t in texts]
    frames[2] += zstandard.ZstdCompressor().compress(b"5 6\n")  # two frames in one file
    assert [compact.frame_end(f) for f in frames[:2]] == [len(f) for f in frames[:2]]
    d = spark.createDataFrame([(i, 1, f) for i, f in enumerate(frames)] + [(9, 1, None)], "file_id bigint, case_id bigint, frames binary")
    body = bytes(compact.join_frames(d).first()["body"])
    assert zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(body) == texts[0] + b"3 4\n5 6\n"
    with pytest.raises(ValueError):
        compact.frame_end(frames[0][:-6])
    with pytest.raises(Exception, match="cut off|no zstandard"):
        compact.join_frames(spark.createDataFrame([(1, 1, frames[0][:-6])], "file_id bigint, case_id bigint, frames binary")).collect()


def test_bundles_are_few_and_can_be_written(spark, tmp_path):
    rows = [(i, i % 2, "foam", 0, str(i / 100), "p", "", 0, "".join(f"{i * 20 + k} {k}.5\n" for k in range(20)), 0) for i in range(400)]
    made = compact.bundles(spark.createDataFrame(rows, FILES), target=20_000).persist()
    out = made.toPandas()
    assert out["n_records"].sum() == 8000 and out["n_files"].sum() == 400 and 4 <= len(out) <= 8
    w = compact.write_bundles(made, str(tmp_path)).collect()
    assert all(r["intact"] for r in w) and len(list(tmp_path.rglob("*.dat"))) == len(out)


def test_containment_against_all_pairs(spark):
    rng = random.Random(1)
    rows, sets = [], {}
    for i in range(300):
        recs = rng.sample(range(8), rng.randrange(0, 6))
        key = (rng.randrange(2), rng.randrange(2))
        rows.append((i, key[0], "foam", key[1], "0.5", "p", "", 0, "".join(f"{r} {r}.0\n" for r in recs), 0))
        sets[i] = (key, frozenset(recs))
    expected = {i for i, (k, a) in sets.items() if not a or any(j != i and k == m and (a < b or (a == b and j < i)) for j, (m, b) in sets.items())}
    assert {r[0] for r in compact.redundant_files(spark.createDataFrame(rows, FILES)).collect()} == expected


GRID = "series_id bigint, case_id bigint, loader string, field_name string, t_start double, delta_t double, n_slots int"
READ = "reading_id bigint, series_id bigint, write_time string, reading double, slot int, t double"


def test_grid_values(spark):
    g = spark.createDataFrame([(1, 1, "foam", "p", 0.0, 1.0, 6), (2, 1, "foam", "p", 0.0, 1.0, 0), (3, 1, "foam", "p", 0.0, None, 3), (4, 1, "foam", "p", 0.0, 1.0, 2)], GRID)
    rows = [(1, 1, "0", 1.0), (2, 1, "0.25", 3.0), (3, 1, "2.5", 5.0), (4, 1, "2.5", 7.0), (5, 1, "x", 9.0), (6, 1, "4", None), (7, 1, "4", float("nan")), (8, 1, "99", 1.0), (9, None, "1", 1.0), (10, 1, None, 1.0), (1, 1, "0", 1.0)]
    r = spark.createDataFrame([(*x, 0, 0.0) for x in rows], READ)
    out = {(x["series_id"], x["slot"]): x for x in regular.regular(r, g).collect()}
    assert len(out) == 8
    # 0.25 periods of 1.0 and 0.25 of 3.0; the first half of the cell has no reading yet
    assert out[1, 0]["value"] == 2.0 and out[1, 0]["coverage"] == 0.5 and out[1, 0]["n_readings"] == 2
    # 2.5 lies between slots 2 and 3: the earlier one; two readings of one time are averaged
    assert out[1, 2]["n_readings"] == 2 and out[1, 2]["status"] == "read"
    assert out[1, 1]["status"] == "filled" and out[1, 1]["value"] == 3.0
    assert out[1, 3]["status"] == "filled" and out[1, 5]["status"] == "missing" and out[4, 0]["status"] == "missing"
    assert {(x[0], x[1]) for x in regular.empty_slots(r, g).collect()} == {(1, 1), (1, 3), (1, 4), (1, 5), (4, 0), (4, 1)}
    assert regular.empty_slots(r.limit(0), g).count() == 8 and regular.empty_slots(r, g.limit(0)).count() == 0


def test_grid_carries_over_blocks(spark):
    g = spark.createDataFrame([(1, 1, "foam", "p", 0.0, 1.0, 40)], GRID)
    r = spark.createDataFrame([(1, 1, "1", 2.0, 0, 0.0), (2, 1, "30", 4.0, 0, 0.0)], READ)
    out = {x["slot"]: x for x in regular.regular(r, g, hold=100.0, block=4).collect()}
    assert all(out[k]["value"] == 2.0 for k in range(2, 30)) and out[35]["value"] == 4.0 and out[0]["status"] == "missing"


def test_grid_area_against_fine_sampling(spark):
    rng = np.random.default_rng(3)
    times = np.sort(rng.uniform(-2, 22, 60)).round(4)
    values = rng.normal(size=60)
    g = spark.createDataFrame([(1, 1, "foam", "p", 0.0, 1.0, 20)], GRID)
    r = spark.createDataFrame([(i, 1, str(t), float(v), 0, 0.0) for i, (t, v) in enumerate(zip(times, values, strict=True))], READ)
    out = {x["slot"]: x for x in regular.regular(r, g, hold=1.5).collect()}
    keep = (times >= -0.5) & (times < 19.5)
    times, values = times[keep], values[keep]
    for s in range(20):
        at = s - 0.5 + (np.arange(4000) + 0.5) / 4000
        k = np.searchsorted(times, at, "right") - 1
        ok = (k >= 0) & (at - times[np.maximum(k, 0)] <= 1.5)
        assert abs(out[s]["coverage"] - ok.mean()) < 2e-3
        if ok.any():
            assert abs(out[s]["value"] - values[k[ok]].mean()) < 1e-2


SAMPLES = "sample_id bigint, source_id bigint, loader string, t_idx bigint, weight double, isvalid double, pos int"


def brute_faulty(rows):
    out = set()
    for src in {r[1] for r in rows}:
        own = sorted({r for r in rows if r[1] == src and (r[4] if r[2] == "psp" else r[5]) is not None}, key=lambda r: r[3])
        v = np.array([r[4] if r[2] == "psp" else r[5] for r in own])
        ids = np.array([r[0] for r in own])
        bad = ~np.isfinite(v) | (v < 0) | (v > 1)
        out |= set(ids[bad].tolist())
        v, ids = v[~bad], ids[~bad]
        if len(v) == 0:
            continue
        level = np.array([np.median(v[max(0, i - 10) : i + 11]) for i in range(len(v))])
        dev = np.abs(v - level)
        scatter = 1.4826 * np.median(dev)
        if scatter > 0:
            out |= set(ids[dev > 8 * scatter].tolist())
            for i in range(len(v)):
                a, b = i, i
                while a > 0 and v[a - 1] == v[i]:
                    a -= 1
                while b + 1 < len(v) and v[b + 1] == v[i]:
                    b += 1
                if b - a + 1 >= 8:
                    out.add(int(ids[i]))
    return out


def test_faulty_against_plain_loops(spark):
    rng = np.random.default_rng(0)
    rows, k = [], 0
    for src, n in ((1, 500), (2, 5), (3, 1), (4, 60), (None, 40)):
        for t in range(n):
            v = float(np.round(0.5 + 0.02 * rng.normal(), 3)) if src != 4 else 0.25
            if rng.random() < 0.05:
                v = rng.choice([0.99, -0.1, 1.5, float("nan"), float("inf")])
            if src == 1 and 100 <= t < 112:
                v = 0.51
            psp = bool(src and src % 2)
            value = None if rng.random() < 0.02 else float(v)
            rows.append((k, src, "psp" if psp else "csv", t, value if psp else None, None if psp else value))
            k += 1
    rows += rows[:20]
    d = spark.createDataFrame([(*r, 0) for r in rows], SAMPLES)
    expected = brute_faulty(rows)
    assert {r[0] for r in spikes.faulty(d).select("sample_id").collect()} == expected
    # blocks far smaller than a source give the same
    x = d.where("source_id = 1").dropDuplicates(["sample_id"]).select("sample_id", F.col("source_id").alias("source"), "t_idx", F.col("weight").alias("value")).where("value between 0 and 1")
    a = {r[0]: (r[2], r[3]) for r in spikes.deviations(x, block=16).collect()}
    assert a == {r[0]: (r[2], r[3]) for r in spikes.deviations(x).collect()} and len(a) == x.count()
    assert spikes.faulty(d.limit(0)).count() == 0


def test_exact_median_of_many_keys(spark):
    rng = np.random.default_rng(0)
    rows = [(k, float(v)) for k in range(5) for v in rng.choice([0.0, 0.1, 0.10000001, 3.0, 7e9], size=k * 7 + 1)]
    got = {r["k"]: r["median"] for r in spikes.exact_median(spark.createDataFrame(rows, "k int, v double"), "k", "v").collect()}
    assert got == {k: float(np.median([v for i, v in rows if i == k])) for k in range(5)}


def test_robust_pca_separates(spark):
    rng = np.random.default_rng(0)
    base = np.outer(rng.uniform(0.5, 1, 40), 0.5 + 0.2 * np.sin(np.arange(24) / 4))
    sparse = np.zeros_like(base)
    at = rng.choice(base.size, 30, replace=False)
    sparse.flat[at] = rng.choice([-0.4, 0.4], 30)
    low, s = spikes.robust_pca(base + sparse)
    assert np.linalg.norm(low - base) < 1e-3 * np.linalg.norm(base) and np.allclose(s, sparse, atol=1e-2)
    assert np.allclose(spikes.robust_pca(np.zeros((3, 3)))[0], 0)
    m = np.clip(base + 0.001 * rng.normal(size=base.shape), 0, 1)
    m.flat[500] = 0.02
    rows = [(i, 1, "psp", i, float(v), None, 0) for i, v in enumerate(m.ravel())]
    found = spikes.profile_outliers(spark.createDataFrame(rows, SAMPLES)).where("spike").collect()
    assert 500 in {r["sample_id"] for r in found}


def test_repeated_and_crowded_spikes_are_not_normal(spark):
    """What a source repeats is low-rank; the exact test must meet it all the same. So must it in short series."""
    rng = np.random.default_rng(5)
    rows = []
    for src, n in ((1, 960), (2, 30), (3, 5), (4, 400), (5, 1)):
        v = 0.5 + 0.002 * rng.normal(size=n)
        if src == 1:
            v[7::24] = 0.9  # the same place of every profile
        if src == 2:
            v[11] = 0.1
        if src == 4:
            v[100:108] = [0.9, 0.1] * 4  # crowded
            v[200:212] = 0.5
        rows += [(src * 10_000 + i, src, "psp", i, float(x), None, 0) for i, x in enumerate(v)]
    assert {r[0] for r in spikes.faulty(spark.createDataFrame(rows, SAMPLES)).select("sample_id").collect()} == brute_faulty(rows)
    out = {r["source_id"]: r for r in spikes.source_profiles(spark.createDataFrame(rows, SAMPLES)).collect()}
    assert out[1]["spike"] == 40 and out[4]["stuck"] == 12 and out[5]["scatter"] == 0.0 and out[3]["readings"] == 5


def test_rank_over_blocks(spark):
    d = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"), F.floor(F.col("id") / 64).alias("b"))
    got = ranked(d, ["k"], ["v"], "b").collect()
    assert all(r["rank"] == r["v"] // 3 for r in got)
    assert dt.date.today()


def test_rows_without_an_id_all_stay(spark, dialects):
    lines = [(i, 1, 1, 2, "0", n, raw, 0) for n, (i, raw) in enumerate([(None, "a"), (None, "a,1,2"), (None, "b,1,x"), (4, "a"), (4, "a")])]
    got = [(r["line_id"], r["reason"]) for r in rejects.load_lines(spark.createDataFrame(lines, LINES), dialects).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, [(None, "column_count"), (None, None), (None, "invalid_value"), (4, "column_count")]))
    # Readings of two slots, both without an id, both count; a grid without a series gives nothing.
    g = spark.createDataFrame([(1, 1, "foam", "p", 0.0, 1.0, 3), (None, 1, "foam", "p", 0.0, 1.0, 3), (None, 2, "foam", "p", 0.0, 1.0, 3)], GRID)
    r = spark.createDataFrame([(None, 1, "0", 1.0, 0, 0.0), (None, 1, "2", 3.0, 0, 0.0)], READ)
    assert {tuple(x) for x in regular.empty_slots(r, g).collect()} == {(1, 1)}
    # Impossible samples without an id, beside an id that no float holds.
    big = 2**60 + 1
    rows = [(None, 1, "psp", 1, 7.0, None, 0), (None, 1, "psp", 2, 8.0, None, 0), (big, 1, "psp", 3, 9.0, None, 0), *((k, 1, "psp", 3 + k, 0.5 + 0.01 * (k % 3), None, 0) for k in range(1, 40)), (big + 2, 1, "psp", 90, 0.9, None, 0), (None, 1, "psp", 91, 0.1, None, 0)]
    d = spark.createDataFrame(rows, SAMPLES)
    assert sorted(map(repr, map(tuple, spikes.faulty(d).collect()))) == sorted(map(repr, [(None, "impossible"), (None, "impossible"), (big, "impossible"), (big + 2, "spike"), (None, "spike")]))
    ids = [x["sample_id"] for x in spikes.profile_outliers(d).collect()]
    assert len(ids) == 41 and ids.count(None) == 1 and big + 2 in ids
    # Files: distinct ones all stay, copies go, and each record is bundled once.
    files = [(None, "1 1\n2 2\n"), (None, "3 3\n"), (None, "1 1\n2 2\n"), (5, "1 1.0\n2 2\n"), (None, ""), (None, "3 3\n4 4\n"), (None, "4 4\n6 6\n")]
    f = spark.createDataFrame([(i, 1, "foam", 0, "0.1", "p", "a", 1, body, 0) for i, body in files], FILES)
    assert [x[0] for x in compact.redundant_files(f).collect()] == [None] * 4
    made = compact.bundles(f).persist()
    out = [x for b in made.collect() for x in bytes(b["body"]).decode().splitlines() if not x.startswith("#")]
    assert sorted(out) == ["1 1.0", "2 2", "3 3", "4 4", "6 6"] and compact.verify(made).where("not intact").count() == 0


def test_profiles_of_readings_that_share_a_place(spark):
    noise = np.random.default_rng(3).normal(size=480) * 0.01
    value = lambda t: 0.4 + 0.1 * np.sin(2 * np.pi * (t % 24) / 24) + noise[t]
    rows = [(t, 1, "psp", t, float(value(t)), None, 0) for t in range(480)]
    # Readings on places that have one: a spike before and a spike behind it, a usual value, and null times.
    more = [(-1, 1, "psp", 50, 0.95, None, 0), (1000, 1, "psp", 77, 0.02, None, 0), (1001, 1, "psp", 90, float(value(90)) + 0.001, None, 0), (1002, 1, "psp", None, 0.97, None, 0), (1003, 1, "psp", None, float(value(0)), None, 0)]
    every = {r[0]: r[4] for r in (*rows, *more)}
    for data in (rows + more, more + rows):
        out = {x["sample_id"]: x for x in spikes.profile_outliers(spark.createDataFrame(data, SAMPLES).coalesce(1)).collect()}
        assert set(out) == set(every)
        assert all(out[i]["spike"] for i in (-1, 1000, 1002))
        assert {i for i in (-1, 50, 77, 90, 1000, 1001, 1002) if abs(out[i]["sparse"]) > 0.2} == {-1, 1000, 1002}
        assert all(abs(x["normal"] + x["sparse"] - every[i]) < 1e-5 for i, x in out.items())
