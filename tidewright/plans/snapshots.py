"""Queries of the snapshot operators over the driver's tables, and their SQL forms.

Matrices: L is lineitem, supplier x month, sum of quantities (missing cells 0); E is events, event type x
day, counts; H is events per hour as one signal.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewright.functions import dense
from tidewright.operators import mesh, outliers, rom, select, spectral, trained, windows
from tidewright.operators.dmd import DMD, HODMD, MSSA, PMSSA
from tidewright.operators.linalg import SVD, Matrix
from tidewright.session import cut, once, table


def r6(c: Column | str) -> Column:
    """Rounded to six digits, without a negative zero."""
    return F.round(c, 6) + F.lit(0.0)


def _month(c: str) -> Column:
    return (F.year(c) * 12 + F.month(c)).cast("int")


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "lineitem").select("l_suppkey", "l_shipdate", "l_quantity")
    return x.groupBy(F.col("l_suppkey").alias("row_id"), _month("l_shipdate").alias("ym")).agg(F.sum("l_quantity").alias("v"))


def lineitem_matrix(spark: SparkSession, sf: str) -> Matrix:
    return Matrix.from_long(_cells(spark, sf), "row_id", "ym", "v")


def event_matrix(spark: SparkSession, sf: str) -> Matrix:
    x = table(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("v"))
    return Matrix.from_long(x.withColumnRenamed("event_type", "row_id"), "row_id", "day", "v")


def _hours(spark: SparkSession, sf: str) -> Matrix:
    """Events per hour: the 720 hours from 2024-01-01, and all hours up to the events before or after them."""
    h = F.floor((F.unix_seconds(F.col("ts").cast("timestamp")) - F.lit(1704067200)) / 3600)
    x = table(spark, sf, "events").groupBy(h.alias("hour")).agg(F.count("*").alias("v")).withColumn("row_id", F.lit(0))
    span = x.agg(F.least(F.min("hour"), F.lit(0)).alias("first"), F.greatest(F.max("hour"), F.lit(719)).alias("last")).first()
    return Matrix.from_long(x, "row_id", "hour", "v", times=range(span["first"], span["last"] + 1))


def snapshot_series(spark, sf):
    return lineitem_matrix(spark, sf).long()


def catalog_times(spark, sf):
    """Write times of the snapshot files per case, kept as they are spelled, with their number."""
    return table(spark, sf, "snapshot_files").select("case_id", "write_time", F.col("write_time").cast("double").alias("t")).distinct()


def catalog_fields(spark, sf):
    x = table(spark, sf, "snapshot_files").select("case_id", "write_time", "field_name").distinct()
    return x.groupBy("case_id", "write_time").agg(F.concat_ws(",", F.array_sort(F.collect_list("field_name"))).alias("fields"))


def series_shape(spark, sf):
    """Points per case, processor, field and time: a series needs the same number at every time."""
    files = once(table(spark, sf, "snapshot_files"), "file_id")
    n = F.size(F.filter(F.split("body", "\n"), lambda x: (F.trim(x) != "") & ~x.startswith("#")))
    return files.groupBy("case_id", "processor", "field_name").agg(F.min(n).cast("bigint").alias("least"), F.max(n).cast("bigint").alias("most"))


def _points(spark, sf, where=None):
    """Points once each. Repeats hold equal values, so a condition comes first and reaches the scan."""
    x = table(spark, sf, "mesh_vertices").select("point_id", "loader", "x", "y", "z")
    return once(x if where is None else x.where(where), "point_id")


def mask_box(spark, sf):
    return _points(spark, sf, select.mask_box(["x", "y", "z"], [1.0, 1.0, 1.0], [4.0, 5.0, 6.0])).select("point_id")


def mask_sphere(spark, sf):
    return _points(spark, sf, select.mask_sphere(["x", "y", "z"], [3.0, 3.0, 3.0], 2.0)).select("point_id")


def time_window_select(spark, sf):
    x = table(spark, sf, "solution_times").select("reading_id", "series_id", "write_time")
    return once(select.time_range(x, "write_time", 0.05, 0.5), "reading_id")


def zone_select(spark, sf):
    """Samples of one mask of one zone, by time index."""
    x = table(spark, sf, "mask_samples").where((F.col("zone_name") == "Zone0000") & (F.col("mask_name") == "Mask1"))
    return once(x.select("sample_id", "source_id", "t_idx", "weight"), "sample_id")


def temporal_mean_std(spark, sf):
    x = lineitem_matrix(spark, sf).long()
    return select.temporal(x, ["row_id"], "value").select("row_id", r6("mean").alias("mean"), r6("std").alias("std"))


def strided_grid(spark, sf):
    x = lineitem_matrix(spark, sf).long()
    return select.every(x, ["row_id", "k"], 5)


def iqr_outliers(spark, sf):
    cells = cut(lineitem_matrix(spark, sf).long())  # the quartiles and the repair look at it three times
    x = outliers.iqr_outliers(cells, "row_id", "k", "value")
    return x.select("row_id", "k", "value", "outlier", "repaired")


def shift_pairs(spark, sf):
    return windows.shift_pairs(lineitem_matrix(spark, sf).long(), ["row_id"], "k", "value")


def delay_embedding(spark, sf):
    return windows.delay_embedding(event_matrix(spark, sf).long(), ["row_id"], "k", "value", 3)


def sequence_pairs(spark, sf):
    x = windows.sequence_pairs(event_matrix(spark, sf).long(), ["row_id"], "k", "value", 2, 2)
    return x.select("row_id", "k", *(F.col("feature")[i].alias(f"f{i}") for i in (0, 1)), *(F.col("label")[i].alias(f"l{i}") for i in (0, 1)))


def trajectory_split(spark, sf):
    return windows.trajectory_split(event_matrix(spark, sf).long(), "row_id", "k", shift=2, horizon=2)


def run_dedupe(spark, sf):
    e = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    r = windows.run_dedupe(e, ["user_id"], ["ts", "event_id"], "event_type")
    return r.select("user_id", F.col("run").cast("bigint").alias("run"), "event_type", "length")


def _transitions(spark, sf, order):
    e = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    x = windows.transitions(e, ["user_id"], ["ts", "event_id"], "event_type", order)
    return x.select(F.concat_ws(",", "history").alias("history"), F.col("next").alias("next_label"), "n", r6("p").alias("p"), r6("dt").alias("dt"))


def transitions_o1(spark, sf):
    return _transitions(spark, sf, 1)


def transitions_o2(spark, sf):
    return _transitions(spark, sf, 2)


def _grid_frame(spark, a: np.ndarray, digits: int = 6) -> DataFrame:
    rows = [(i, j, float(round(float(v), digits)) + 0.0) for (i, j), v in np.ndenumerate(a)]
    return spark.createDataFrame(rows, "i bigint, j bigint, value double")


def gram_matrix(spark, sf):
    return _grid_frame(spark, lineitem_matrix(spark, sf).gram())


def gram_lagged(spark, sf):
    g = lineitem_matrix(spark, sf).gram()
    return _grid_frame(spark, g[:-1, 1:])


def gram_rows(spark, sf):
    ids, g = event_matrix(spark, sf).row_gram(chunk=7)
    return spark.createDataFrame([(a, b, float(g[i, j])) for i, a in enumerate(ids) for j, b in enumerate(ids)], "a string, b string, value double")


def svd_energy(spark, sf):
    s = SVD(lineitem_matrix(spark, sf), rank=10**6)
    return spark.createDataFrame([(round(float((s.s_full**2).sum()), 3) + 0.0, s.x.rows, s.x.n)], "energy double, n_rows bigint, n_cols bigint")


def svd_reconstruct(spark, sf):
    """At full rank: the data."""
    return rounded_long(SVD(lineitem_matrix(spark, sf), rank=10**6).reconstruct())


def svd_left_gram(spark, sf):
    """U^H U of the leading vectors: the identity."""
    u = SVD(lineitem_matrix(spark, sf), rank=8).U
    return _grid_frame(spark, u.gram())


def pod_round_trip(spark, sf):
    """Encoded and decoded at full rank: the data."""
    x = event_matrix(spark, sf)
    e = rom.SVDEncoder(rank=5)
    e.train(x)
    return rounded_long(e.decode(e.encode(x)))


def rounded_long(m: Matrix) -> DataFrame:
    return m.long().withColumn("value", r6("value"))


def dft_amplitude(spark, sf):
    d = spectral.DFT(event_matrix(spark, sf), 1.0)
    return d.spectrum().select(F.col("bin").cast("bigint").alias("bin"), r6("frequency").alias("frequency"), r6("amplitude").alias("amplitude"), r6("density").alias("density"))


def dft_hann_amplitude(spark, sf):
    d = spectral.DFT(event_matrix(spark, sf), 1.0, nfft=40, window="hann")
    return d.spectrum().select(F.col("bin").cast("bigint").alias("bin"), r6("amplitude").alias("amplitude"))


def dft_top_modes(spark, sf):
    d = spectral.DFT(_hours(spark, sf), 1.0)
    return spark.createDataFrame([(i, int(k) + 1) for i, k in enumerate(d.top_modes(5, 0.01, 0.3))], "place bigint, bin bigint")


def dft_reconstruct(spark, sf):
    return rounded_long(spectral.DFT(event_matrix(spark, sf), 1.0, window="hamming").reconstruction)


def dft_mode_norms(spark, sf):
    """Norm of each mode: 1."""
    m = spectral.DFT(event_matrix(spark, sf), 1.0).modes
    return m.long().groupBy(F.col("k").cast("bigint").alias("k")).agg(r6(F.sum(F.col("value") ** 2 + F.col("imag") ** 2)).alias("norm2"))


def pdft_reconstruct(spark, sf):
    return rounded_long(spectral.PDFT(event_matrix(spark, sf), 1.0, rank=5).reconstruction)


def amps_fixed_tapers(spark, sf):
    a = spectral.multitaper_power(_hours(spark, sf).df, 1.0, adaptive=False, max_tapers=4)
    return a.select(F.col("bin").cast("bigint").alias("bin"), r6("power").alias("power"))


def spod_fixed_trace(spark, sf):
    """Sum of the eigenvalues per bin with two tapers: the tapered power summed over the points."""
    s = spectral.AMSPOD(event_matrix(spark, sf), 1.0, adaptive=False, max_tapers=2, keep_n_modes=2)
    t = np.nansum(s.eigvals, axis=1)
    return spark.createDataFrame([(k, round(float(v), 6) + 0.0) for k, v in enumerate(t)], "bin bigint, total double")


def log_segment_top(spark, sf):
    f = np.array([0.0, 1, 2, 5, 10, 20])
    s = np.array([9.0, 1, 4, 3, 2, 6])
    return spark.createDataFrame([(i, int(k)) for i, k in enumerate(dense.log_segment_top(f, s, 2))], "segment bigint, idx bigint")


def dmd_unitary_moduli(spark, sf):
    """A unitary operator's eigenvalues have modulus 1."""
    d = DMD(lineitem_matrix(spark, sf), 1.0, rank=6, unitary=True)
    return spark.createDataFrame([(k, round(float(abs(v)), 6)) for k, v in enumerate(d.eigvals)], "k bigint, modulus double")


def mssa_reconstruct(spark, sf):
    """At full rank: the data."""
    return rounded_long(MSSA(event_matrix(spark, sf), 10, rank=10).reconstruction)


def antidiagonal_mean(spark, sf):
    """Delay embedding and the mean of its anti-diagonals: the series again."""
    h = windows.delay_embedding(event_matrix(spark, sf).long(), ["row_id"], "k", "value", 6)
    return h.groupBy("row_id", (F.col("k") + F.col("lag")).alias("t")).agg(r6(F.avg("value")).alias("value"), F.count("*").alias("n"))


def mesh_face_geometry(spark, sf):
    m = mesh.box_mesh(spark, 4)
    f = mesh.face_geometry(m["points"], m["faces"])
    area = F.sqrt(F.col("sx") ** 2 + F.col("sy") ** 2 + F.col("sz") ** 2)
    return f.select("fid", r6(area).alias("area"))


def mesh_cell_geometry(spark, sf):
    m = mesh.box_mesh(spark, 4)
    c = mesh.cell_geometry(mesh.face_geometry(m["points"], m["faces"]), m["owner"], m["neighbour"])
    return c.select("cid", *(r6(k).alias(k) for k in ("x", "y", "z", "volume")))


def mesh_topology(spark, sf):
    m = mesh.box_mesh(spark, 3)
    t = mesh.topology(m["faces"], m["owner"], m["neighbour"])
    return t.select("cid", F.size("stream").cast("bigint").alias("n"), F.element_at("stream", 2).alias("n_faces"))


def knn_weights(spark, sf):
    """Weights from the 4 nearest points, the point itself among them."""
    p = _points(spark, sf).where(F.forall(F.array("x", "y", "z"), lambda v: v.isNotNull() & ~F.isnan(v)))
    return mesh.knn_weights(p, "point_id", ["x", "y", "z"], volume=1.0, k=4).select("point_id", r6("w").alias("w"))


def max_normalized_weights(spark, sf):
    """Weights divided by the largest of their case: an aggregation joined back, so no task orders a case."""
    x = table(spark, sf, "mask_samples").where("weight is not null and not isnan(weight) and weight between 0 and 1")
    return mesh.max_normalized(once(x.select("sample_id", "case_id", "weight"), "sample_id"), "case_id", "weight").select("sample_id", r6("w").alias("w"))


def davis_header(spark, sf):
    """Column names of the VARIABLES lines."""
    from tidewright.sources.csvs import davis_columns

    x = once(table(spark, sf, "csv_lines").where(F.col("raw_line").startswith("VARIABLES")).select("line_id", "raw_line"), "line_id")
    return x.select("line_id", F.concat_ws(",", davis_columns(F.col("raw_line"))).alias("names"))


def foam_header(spark, sf):
    """Column names of the second comment line of surface files."""
    from tidewright.sources.csvs import surface_columns

    x = table(spark, sf, "csv_lines").where(F.col("raw_line").startswith("#") & (F.col("line_no") == 1) & F.col("dialect_id").isin(2, 3))
    x = once(x.select("line_id", "raw_line"), "line_id")
    return x.select("line_id", F.concat_ws(",", surface_columns(F.col("raw_line"))).alias("names"))


QUERIES = {
    f.__name__: f
    for f in (
        snapshot_series, catalog_times, catalog_fields, series_shape, mask_box, mask_sphere, time_window_select, zone_select, temporal_mean_std, strided_grid, iqr_outliers, shift_pairs,
        delay_embedding, sequence_pairs, trajectory_split, run_dedupe, transitions_o1, transitions_o2, gram_matrix, gram_lagged, gram_rows, svd_energy, svd_reconstruct,
        svd_left_gram, pod_round_trip, dft_amplitude, dft_hann_amplitude, dft_top_modes, dft_reconstruct, dft_mode_norms, pdft_reconstruct, amps_fixed_tapers, spod_fixed_trace,
        log_segment_top, dmd_unitary_moduli, 
        mssa_reconstruct, antidiagonal_mean, mesh_face_geometry,
        mesh_cell_geometry, mesh_topology, knn_weights, max_normalized_weights, davis_header, foam_header,
    )
}

_L = """
c AS (SELECT l_suppkey AS row_id, CAST(year(l_shipdate) * 12 + month(l_shipdate) AS INTEGER) AS ym, sum(l_quantity) AS v FROM lineitem GROUP BY ALL),
t AS (SELECT ym, CAST(row_number() OVER (ORDER BY ym) - 1 AS INTEGER) AS k FROM (SELECT DISTINCT ym FROM c)),
L AS (SELECT s.row_id, t.k, coalesce(c.v, CAST(0 AS DOUBLE)) AS value FROM (SELECT DISTINCT row_id FROM c) s CROSS JOIN t LEFT JOIN c ON c.row_id = s.row_id AND c.ym = t.ym)"""
_E = """
ec AS (SELECT event_type AS row_id, CAST(ts AS DATE) AS d, count(*) AS v FROM events GROUP BY ALL),
et AS (SELECT d, CAST(row_number() OVER (ORDER BY d) - 1 AS INTEGER) AS k FROM (SELECT DISTINCT d FROM ec)),
E AS (SELECT s.row_id, et.k, CAST(coalesce(ec.v, 0) AS DOUBLE) AS value FROM (SELECT DISTINCT row_id FROM ec) s CROSS JOIN et LEFT JOIN ec ON ec.row_id = s.row_id AND ec.d = et.d)"""
_P = "p AS (SELECT point_id, any_value(loader) AS loader, any_value(x) AS x, any_value(y) AS y, any_value(z) AS z FROM mesh_vertices GROUP BY point_id)"
_R = """
o AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
g AS (SELECT *, sum(CASE WHEN i > 1 AND before IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY i) AS run FROM o),
r AS (SELECT user_id, CAST(run AS BIGINT) AS run, any_value(event_type) AS event_type, count(*) AS length FROM g GROUP BY user_id, run)"""
_X = "round(CAST({} AS DOUBLE), 6) + 0.0"
_DFT = """
, m AS (SELECT row_id, k, value - avg(value) OVER (PARTITION BY row_id) AS x FROM E), n AS (SELECT max(k) + 1 AS n, count(DISTINCT row_id) AS rows FROM E)"""


def _dft(nfft: str, window: str) -> str:
    return f"""WITH {_E}{_DFT},
w AS (SELECT row_id, k, n, rows, {nfft} AS nfft, x * ({window}) AS x, ({window}) AS w FROM m CROSS JOIN n),
q AS (SELECT row_id, b.bin, sum(x * cos(2 * pi() * b.bin * k / nfft)) / sqrt(any_value(nfft)) AS re, sum(x * sin(2 * pi() * b.bin * k / nfft)) / sqrt(any_value(nfft)) AS im, any_value(nfft) AS nfft, any_value(rows) AS rows, avg(w * w) AS w2
  FROM w JOIN (SELECT unnest(range(1, 100)) AS bin) b ON b.bin <= nfft // 2 GROUP BY row_id, b.bin),
a AS (SELECT bin, any_value(nfft) AS nfft, sum(re * re + im * im) * CASE WHEN 2 * bin = any_value(nfft) THEN 1 ELSE 2 END / any_value(rows) / any_value(w2) AS amplitude FROM q GROUP BY bin)
"""


SQL = {
    "snapshot_series": f"WITH {_L} SELECT * FROM L",
    "catalog_times": "SELECT DISTINCT case_id, write_time, CAST(write_time AS DOUBLE) AS t FROM snapshot_files",
    "catalog_fields": "SELECT case_id, write_time, string_agg(field_name, ',' ORDER BY field_name) AS fields FROM (SELECT DISTINCT case_id, write_time, field_name FROM snapshot_files) GROUP BY ALL",
    "series_shape": """WITH f AS (SELECT file_id, any_value(case_id) AS case_id, any_value(processor) AS processor, any_value(field_name) AS field_name, any_value(body) AS body FROM snapshot_files GROUP BY file_id),
n AS (SELECT *, len(list_filter(string_split(body, chr(10)), lambda s: trim(s) <> '' AND s NOT LIKE '#%')) AS n FROM f)
SELECT case_id, processor, field_name, min(n) AS least, max(n) AS most FROM n GROUP BY ALL""",
    "mask_box": f"WITH {_P} SELECT point_id FROM p WHERE x BETWEEN 1 AND 4 AND y BETWEEN 1 AND 5 AND z BETWEEN 1 AND 6",
    "mask_sphere": f"WITH {_P} SELECT point_id FROM p WHERE sqrt((x-3)*(x-3) + (y-3)*(y-3) + (z-3)*(z-3)) <= 2",
    "time_window_select": "SELECT reading_id, any_value(series_id) AS series_id, any_value(write_time) AS write_time FROM solution_times WHERE try_cast(write_time AS DOUBLE) >= 0.05 AND try_cast(write_time AS DOUBLE) < 0.5 GROUP BY reading_id",
    "zone_select": "SELECT sample_id, any_value(source_id) AS source_id, any_value(t_idx) AS t_idx, any_value(weight) AS weight FROM mask_samples WHERE zone_name = 'Zone0000' AND mask_name = 'Mask1' GROUP BY sample_id",
    "temporal_mean_std": f"WITH {_L} SELECT row_id, {_X.format('avg(value)')} AS mean, {_X.format('stddev_samp(value)')} AS std FROM L GROUP BY row_id",
    "strided_grid": f"WITH {_L} SELECT * FROM L WHERE row_id % 5 = 0 AND k % 5 = 0",
    "iqr_outliers": f"""WITH {_L},
q AS (SELECT row_id, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM L GROUP BY row_id),
w AS (SELECT L.*, value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) AS outlier, list_sort(list(value) OVER (PARTITION BY L.row_id ORDER BY k ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING)) AS near FROM L JOIN q ON q.row_id = L.row_id)
SELECT row_id, k, value, outlier, CASE WHEN outlier THEN near[(len(near) + 1) // 2] ELSE value END AS repaired FROM w""",
    "shift_pairs": f"WITH {_L} SELECT a.row_id, a.k, a.value AS x, b.value AS y FROM L a JOIN L b ON a.row_id = b.row_id AND b.k = a.k + 1",
    "delay_embedding": f"WITH {_E} SELECT a.row_id, a.k, CAST(b.k - a.k AS INTEGER) AS lag, b.value FROM E a JOIN E b ON a.row_id = b.row_id AND b.k BETWEEN a.k AND a.k + 2 WHERE a.k + 2 <= (SELECT max(k) FROM E)",
    "sequence_pairs": f"WITH {_E} SELECT a.row_id, a.k, a.value AS f0, b.value AS f1, c.value AS l0, d.value AS l1 FROM E a JOIN E b ON b.row_id = a.row_id AND b.k = a.k + 1 JOIN E c ON c.row_id = a.row_id AND c.k = a.k + 2 JOIN E d ON d.row_id = a.row_id AND d.k = a.k + 3",
    "trajectory_split": f"""WITH {_E},
p AS (SELECT row_id, k AS start, k + 2 AS stop, row_number() OVER (ORDER BY row_id, k) - 1 AS pair, count(*) OVER () AS n FROM E WHERE k % 2 = 0 AND k + 2 <= (SELECT max(k) FROM E))
SELECT row_id, pair, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop, 'forward' AS direction, CASE WHEN pair < floor(n * 0.75) THEN 'train' ELSE 'test' END AS part FROM p""",
    "run_dedupe": f"WITH {_R} SELECT * FROM r",
    "transitions_o1": f"""WITH {_R},
x AS (SELECT event_type AS history, lead(event_type) OVER w AS next_label, length, lead(length) OVER w AS len2 FROM r WINDOW w AS (PARTITION BY user_id ORDER BY run)),
a AS (SELECT history, next_label, count(*) AS n, avg(0.5 * (length + len2)) AS dt FROM x WHERE len2 IS NOT NULL GROUP BY ALL)
SELECT history, next_label, n, {_X.format("n / sum(n) OVER (PARTITION BY history)")} AS p, {_X.format("dt")} AS dt FROM a""",
    "transitions_o2": f"""WITH {_R},
x AS (SELECT lag(event_type) OVER w || ',' || event_type AS history, lead(event_type) OVER w AS next_label, length, lead(length) OVER w AS len2 FROM r WINDOW w AS (PARTITION BY user_id ORDER BY run)),
a AS (SELECT history, next_label, count(*) AS n, avg(0.5 * (length + len2)) AS dt FROM x WHERE len2 IS NOT NULL AND history IS NOT NULL GROUP BY ALL)
SELECT history, next_label, n, {_X.format("n / sum(n) OVER (PARTITION BY history)")} AS p, {_X.format("dt")} AS dt FROM a""",
    "gram_matrix": f"WITH {_L} SELECT CAST(a.k AS BIGINT) AS i, CAST(b.k AS BIGINT) AS j, {_X.format('sum(a.value * b.value)')} AS value FROM L a JOIN L b ON a.row_id = b.row_id GROUP BY a.k, b.k",
    "gram_lagged": f"WITH {_L} SELECT CAST(a.k AS BIGINT) AS i, CAST(b.k - 1 AS BIGINT) AS j, {_X.format('sum(a.value * b.value)')} AS value FROM L a JOIN L b ON a.row_id = b.row_id WHERE a.k < (SELECT max(k) FROM L) AND b.k > 0 GROUP BY a.k, b.k",
    "gram_rows": f"WITH {_E} SELECT a.row_id AS a, b.row_id AS b, sum(a.value * b.value) AS value FROM E a JOIN E b ON a.k = b.k GROUP BY ALL",
    "svd_energy": f"WITH {_L} SELECT round(sum(value * value), 3) + 0.0 AS energy, count(DISTINCT row_id) AS n_rows, count(DISTINCT k) AS n_cols FROM L",
    "svd_reconstruct": f"WITH {_L} SELECT row_id, k, {_X.format('value')} AS value FROM L",
    "svd_left_gram": "SELECT i, j, CAST(CASE WHEN i = j THEN 1 ELSE 0 END AS DOUBLE) AS value FROM (SELECT unnest(range(8)) AS i) CROSS JOIN (SELECT unnest(range(8)) AS j)",
    "pod_round_trip": f"WITH {_E} SELECT row_id, k, {_X.format('value')} AS value FROM E",
    "dft_amplitude": _dft("n", "1") + f"SELECT bin, {_X.format('bin / nfft')} AS frequency, {_X.format('amplitude')} AS amplitude, {_X.format('amplitude * nfft')} AS density FROM a",
    "dft_hann_amplitude": _dft("40", "0.5 - 0.5 * cos(2 * pi() * k / n)") + f"SELECT bin, {_X.format('amplitude')} AS amplitude FROM a",
    "dft_top_modes": """WITH h AS (SELECT CAST(floor((epoch(ts) - 1704067200) / 3600) AS BIGINT) AS k, count(*) AS v FROM events GROUP BY 1),
s AS (SELECT t.k, coalesce(h.v, 0) AS v FROM (SELECT unnest(range(720)) AS k) t LEFT JOIN h ON h.k = t.k),
q AS (SELECT bin, pow(sum(v * cos(2 * pi() * bin * k / 720)), 2) + pow(sum(v * sin(2 * pi() * bin * k / 720)), 2) AS p FROM s CROSS JOIN (SELECT unnest(range(1, 361)) AS bin) WHERE bin >= 7.2 AND bin < 216 GROUP BY bin)
SELECT place, bin FROM (SELECT bin, row_number() OVER (ORDER BY p DESC) - 1 AS place FROM q) WHERE place < 5""",
    "dft_reconstruct": f"WITH {_E} SELECT row_id, k, {_X.format('value')} AS value FROM E",
    "dft_mode_norms": f"WITH {_E} SELECT unnest(range(CAST((max(k) + 1) // 2 AS BIGINT))) AS k, CAST(1 AS DOUBLE) AS norm2 FROM E",
    "pdft_reconstruct": f"WITH {_E} SELECT row_id, k, {_X.format('value')} AS value FROM E",
    "amps_fixed_tapers": f"""WITH h AS (SELECT CAST(floor((epoch(ts) - 1704067200) / 3600) AS BIGINT) AS k, count(*) AS v FROM events GROUP BY 1),
s AS (SELECT t.k, coalesce(h.v, 0) AS v FROM (SELECT unnest(range(720)) AS k) t LEFT JOIN h ON h.k = t.k),
x AS (SELECT k, v - avg(v) OVER () AS v FROM s),
q AS (SELECT b, sum(v * cos(2 * pi() * b * k / 1440)) AS re, -sum(v * sin(2 * pi() * b * k / 1440)) AS im FROM x CROSS JOIN (SELECT unnest(range(-4, 725)) AS b) GROUP BY b),
p AS (SELECT f.f, j.j, 6.0 * (16 - (j.j - 1) * (j.j - 1)) / (4 * 15 * 5) * 2 / 721 * (pow(a.re - c.re, 2) + pow(a.im - c.im, 2)) / 4 AS w
  FROM (SELECT unnest(range(0, 361)) AS f) f CROSS JOIN (SELECT unnest(range(1, 5)) AS j) j JOIN q a ON a.b = 2 * f.f - j.j JOIN q c ON c.b = 2 * f.f + j.j)
SELECT f AS bin, {_X.format("CASE WHEN f IN (0, 360) THEN 1 ELSE 2 END * sum(w) / 720")} AS power FROM p GROUP BY f""",
    "spod_fixed_trace": f"""WITH {_E}, n AS (SELECT max(k) + 1 AS n FROM E), x AS (SELECT row_id, k, value - avg(value) OVER (PARTITION BY row_id) AS v FROM E),
q AS (SELECT row_id, b, any_value(n) AS n, sum(v * cos(pi() * b * k / n)) AS re, -sum(v * sin(pi() * b * k / n)) AS im FROM x CROSS JOIN n CROSS JOIN (SELECT unnest(range(-2, 70)) AS b) GROUP BY row_id, b),
p AS (SELECT f.f, a.n, 6.0 * (4 - (j.j - 1) * (j.j - 1)) / (2 * 7 * 3) * 2 / (a.n + 1) * (pow(a.re - c.re, 2) + pow(a.im - c.im, 2)) / 4 / (2 * a.n) AS w
  FROM (SELECT unnest(range(0, 31)) AS f) f CROSS JOIN (SELECT unnest(range(1, 3)) AS j) j JOIN q a ON a.b = 2 * f.f - j.j JOIN q c ON c.b = 2 * f.f + j.j AND c.row_id = a.row_id WHERE f.f <= a.n // 2)
SELECT f AS bin, {_X.format("sum(w) * 2 * CASE WHEN f = 0 OR 2 * f = any_value(n) THEN 1 ELSE 2 END")} AS total FROM p GROUP BY f""",
    "log_segment_top": "SELECT * FROM (VALUES (CAST(0 AS BIGINT), CAST(2 AS BIGINT)), (1, 5)) AS v(segment, idx)",
    "dmd_unitary_moduli": "SELECT unnest(range(6)) AS k, CAST(1 AS DOUBLE) AS modulus",
    "mssa_reconstruct": f"WITH {_E} SELECT row_id, k, {_X.format('value')} AS value FROM E",
    "antidiagonal_mean": f"WITH {_E}, h AS (SELECT a.row_id, b.k AS t, b.value FROM E a JOIN E b ON a.row_id = b.row_id AND b.k BETWEEN a.k AND a.k + 5 WHERE a.k + 5 <= (SELECT max(k) FROM E)) SELECT row_id, t, {_X.format('avg(value)')} AS value, count(*) AS n FROM h GROUP BY row_id, t",
    "mesh_face_geometry": "SELECT unnest(range(240)) AS fid, CAST(0.0625 AS DOUBLE) AS area",
    "mesh_cell_geometry": "SELECT cid, 0.125 + 0.25 * (cid % 4) + CAST(0 AS DOUBLE) AS x, 0.125 + 0.25 * (cid // 4 % 4) + CAST(0 AS DOUBLE) AS y, 0.125 + 0.25 * (cid // 16) + CAST(0 AS DOUBLE) AS z, CAST(0.015625 AS DOUBLE) AS volume FROM (SELECT unnest(range(64)) AS cid)",
    "mesh_topology": "SELECT unnest(range(27)) AS cid, CAST(32 AS BIGINT) AS n, CAST(6 AS BIGINT) AS n_faces",
    "knn_weights": f"""WITH {_P}, c AS (SELECT * FROM p WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL AND NOT isnan(x) AND NOT isnan(y) AND NOT isnan(z)),
d AS (SELECT a.point_id, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) AS d, b.point_id AS other FROM c a CROSS JOIN c b),
r AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY d, other) AS rn FROM d),
m AS (SELECT point_id, pow(avg(d), 3) AS m FROM r WHERE rn <= 4 GROUP BY point_id), w AS (SELECT point_id, m / sum(m) OVER () AS w FROM m)
SELECT point_id, {_X.format("sqrt(w) / max(sqrt(w)) OVER ()")} AS w FROM w""",
    "max_normalized_weights": f"""WITH s AS (SELECT sample_id, any_value(case_id) AS case_id, any_value(weight) AS weight FROM mask_samples WHERE weight IS NOT NULL AND NOT isnan(weight) AND weight BETWEEN 0 AND 1 GROUP BY sample_id)
SELECT sample_id, {_X.format("weight / max(weight) OVER (PARTITION BY case_id)")} AS w FROM s""",
    "davis_header": "SELECT line_id, array_to_string(regexp_extract_all(any_value(raw_line), '\"([^\"]*)\"', 1), ',') AS names FROM csv_lines WHERE raw_line LIKE 'VARIABLES%' GROUP BY line_id",
    "foam_header": "SELECT line_id, array_to_string(list_filter(string_split(replace(any_value(raw_line), '#', ''), ' '), lambda x: x <> ''), ',') AS names FROM csv_lines WHERE raw_line LIKE '#%' AND line_no = 1 AND dialect_id IN (2, 3) GROUP BY line_id",
}
