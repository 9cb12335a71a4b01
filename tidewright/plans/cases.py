"""Queries through the sources: the tables are written as cases of every format and read back by its reader.

The case is lineitem by month (the time, spelled as year * 12 + month) and by supplier modulo the number of
points: p is the sum of quantities, U holds that, the number of rows and the sum of line numbers, and T, where a
format knows uniform fields, the number of rows of the month. Files are written by the executors into the
folder that the cluster shares, one folder per call.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators import explore, mesh
from tidewright.session import folder_for, once, shared_folder, table
from tidewright.sources import csvs, datasource, export, foam, images, netcdf, store, tau, tecplot, vtk, zoned

SIDE = 3
POINTS = SIDE**3


def r6(c) -> Column:
    return F.round(c, 6) + F.lit(0.0)


def frames(spark: SparkSession, sf: str, points: int = POINTS) -> DataFrame:
    """One row per month: time, the three arrays over the points, and the month's rows."""
    x = table(spark, sf, "lineitem").select((F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("string").alias("time"), (F.col("l_suppkey") % points).alias("k"), "l_quantity", "l_linenumber")
    cell = x.groupBy("time", "k").agg(F.sum("l_quantity").cast("double").alias("q"), F.count("*").cast("double").alias("n"), F.sum("l_linenumber").cast("double").alias("s"))
    m = cell.groupBy("time").agg(F.map_from_entries(F.collect_list(F.struct(F.col("k").cast("int"), F.struct("q", "n", "s")))).alias("m"), F.sum("n").alias("total"))
    every = F.sequence(F.lit(0), F.lit(points - 1))
    return m.select("time", "total", *(_over(every, c).alias(c) for c in ("q", "n", "s")))


def _over(every: Column, c: str) -> Column:
    return F.transform(every, lambda k: F.coalesce(F.element_at("m", k)[c], F.lit(0.0)))


def _u(r) -> np.ndarray:
    return np.stack([np.asarray(r.q), np.asarray(r.n), np.asarray(r.s)], axis=1)


def _coordinates() -> np.ndarray:
    k = np.arange(POINTS)
    return np.stack([k % SIDE, k // SIDE % SIDE, k // SIDE**2], axis=1) / SIDE + 0.5 / SIDE


def _box(spark: SparkSession) -> tuple:
    """The mesh of the box as lists, inner faces first."""
    m = mesh.box_mesh(spark, SIDE)
    points = np.array([[r["x"], r["y"], r["z"]] for r in m["points"].orderBy("pid").collect()])
    owner = {r["fid"]: r["cid"] for r in m["owner"].collect()}
    neighbour = {r["fid"]: r["cid"] for r in m["neighbour"].collect()}
    faces = {r["fid"]: list(r["pids"]) for r in m["faces"].collect()}
    order = sorted(faces, key=lambda f: (f not in neighbour, f))
    return points, [faces[f] for f in order], [owner[f] for f in order], [neighbour[f] for f in order if f in neighbour]


def _put(folder: str, files: dict[str, bytes]) -> None:
    for name, data in files.items():
        path = folder_for(folder) / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)


def foam_case(spark: SparkSession, sf: str, binary: bool = False) -> str:
    folder = shared_folder(spark, "foam")
    _put(folder, export.foam_mesh(*_box(spark), binary=binary))
    export.write_files(frames(spark, sf), folder, lambda r: {f"{r.time}/p": export.foam_field("p", r.q, binary), f"{r.time}/U": export.foam_field("U", _u(r), binary), f"{r.time}/T": export.foam_field("T", r.total, binary)})
    return folder


def foam_parts(spark: SparkSession, sf: str) -> str:
    """A decomposed binary case: three processors of one box each."""
    folder = shared_folder(spark, "foam-parts")
    box = export.foam_mesh(*_box(spark), binary=True)
    _put(folder, {f"processor{p}/{name}": data for p in range(3) for name, data in box.items()})
    export.write_files(frames(spark, sf, 3 * POINTS), folder, lambda r: {f"processor{p}/{r.time}/p": export.foam_field("p", r.q[p * POINTS : (p + 1) * POINTS], True) for p in range(3)})
    return folder


def _rows(x: DataFrame) -> DataFrame:
    return x.select("time", "field", F.col("point_id").cast("bigint").alias("point_id"), F.col("comp").cast("bigint").alias("comp"), "value")


def foam_snapshots(spark, sf):
    """ASCII fields p, U and the uniform T."""
    s = foam.FoamSource(spark, foam_case(spark, sf))
    return _rows(s.load_snapshot(["p", "U", "T"], s.write_times))


def foam_binary(spark, sf):
    s = foam.FoamSource(spark, foam_case(spark, sf, binary=True))
    return _rows(s.load_snapshot(["p", "U"], s.write_times))


def foam_decomposed(spark, sf):
    s = foam.FoamSource(spark, foam_parts(spark, sf))
    return _rows(s.load_snapshot("p", s.write_times))


def foam_format(spark, sf):
    """The same as a Spark format, with the filter on the field taken in by the reader."""
    datasource.register(spark)
    x = spark.read.format("tidewright_foam").option("path", foam_case(spark, sf)).load()
    return _rows(x.where("field = 'U'"))


def foam_catalog(spark, sf):
    """Times and fields as the case's folders tell them."""
    s = foam.FoamSource(spark, foam_case(spark, sf))
    rows = [(i, t, f) for i, t in enumerate(s.write_times) for f in s.field_names[t]]
    return spark.createDataFrame(rows, "place bigint, time string, field string")


def foam_matrix(spark, sf):
    """The data matrix of a vector field's second component."""
    s = foam.FoamSource(spark, foam_case(spark, sf))
    return s.matrix("U", comp=1).long().select(F.col("row_id").alias("point_id"), F.col("k").cast("bigint").alias("k"), "value")


def foam_cells(spark, sf):
    """Centres and volumes that follow from a decomposed mesh."""
    s = foam.FoamSource(spark, foam_parts(spark, sf))
    return s.vertices.join(s.weights, "point_id").select("point_id", *(r6(c).alias(c) for c in ("x", "y", "z", "w")))


def foam_mesh_lists(spark, sf):
    """Points, faces, owners and neighbours as parsed, in numbers."""
    m = foam.FoamSource(spark, foam_case(spark, sf, binary=True)).mesh
    size = lambda name, x, v: x.agg(F.lit(name).alias("list"), F.count("*").alias("n"), F.sum(v).cast("double").alias("total"))
    parts = (("points", m.points(), F.col("x") + 2 * F.col("y") + 4 * F.col("z")), ("faces", m.faces(), F.aggregate("pids", F.lit(0).cast("bigint"), lambda s, p: s + p)), ("owner", m.owner(), "cid"), ("neighbour", m.neighbour(), "cid"))
    out = None
    for p in parts:
        out = size(*p) if out is None else out.union(size(*p))
    return out.withColumn("total", r6("total"))


def _stored(spark, sf) -> store.Store:
    return store.foam_to_store(foam.FoamSource(spark, foam_case(spark, sf)), shared_folder(spark, "store"))


def store_snapshots(spark, sf):
    """Converted to the Parquet store and read from there; one field's values replaced on the way."""
    st = _stored(spark, sf)
    st.write(st.snapshots(["T"], st.write_times).withColumn("value", F.col("value") + 1))
    return _rows(st.load_snapshot(["p", "T"], st.write_times))


def store_catalog(spark, sf):
    st = _stored(spark, sf)
    names = st.field_names
    return spark.createDataFrame([(i, t, f) for i, t in enumerate(st.write_times) for f in names[t]], "place bigint, time string, field string")


def store_constants(spark, sf):
    """Centres, volumes and the length of each cell's topology, in a store that got only another's mesh."""
    first = _stored(spark, sf)
    st = store.copy_mesh(spark, first.path, shared_folder(spark, "mesh"))
    x = st.vertices.join(st.weights, "point_id").join(st.constant("connectivity").select(F.col("cid").alias("point_id"), F.size("stream").cast("bigint").alias("n")), "point_id")
    return x.select("point_id", "n", *(r6(c).alias(c) for c in ("x", "y", "z", "w")))


def xdmf_values(spark, sf):
    """The numbers of the fields as a viewer finds them through the description."""
    held = store.read_xdmf(store.write_xdmf(_stored(spark, sf)))
    rows = [(t, f, i, c, float(v)) for (t, f), a in held.items() if f in ("p", "U") for (i, c), v in np.ndenumerate(a.reshape(len(a), -1))]
    return spark.createDataFrame(rows, "time string, field string, point_id bigint, comp bigint, value double")


def xdmf_mesh(spark, sf):
    """Topology and geometry of the description: the streams are walked cell by cell."""
    held = store.read_xdmf(store.write_xdmf(_stored(spark, sf)))
    time = min(t for t, _ in held)
    stream, points = held[time, "Topology"], held[time, "Geometry"]
    at, rows, cell = 0, [], 0
    while at < len(stream):
        n_faces, at, used = int(stream[at + 1]), at + 2, set()
        for _ in range(n_faces):
            k = int(stream[at])
            used |= set(stream[at + 1 : at + 1 + k].tolist())
            at += 1 + k
        centre = points[sorted(used)].mean(axis=0)
        rows.append((cell, n_faces, len(used), *(round(float(v), 6) + 0.0 for v in centre)))
        cell += 1
    return spark.createDataFrame(rows, "cell bigint, faces bigint, corners bigint, x double, y double, z double")


def davis_case(spark, sf) -> csvs.DavisSource:
    folder = shared_folder(spark, "davis")
    at = _coordinates()
    export.write_files(frames(spark, sf), folder, lambda r: {f"B{r.time}.dat": export.davis(r.time, {"x": at[:, 0], "y": at[:, 1], "Vx": r.q, "Vy": r.n, "isValid": np.arange(POINTS) % 2})})
    return csvs.DavisSource(spark, folder, prefix="B")


def davis_snapshots(spark, sf):
    s = davis_case(spark, sf)
    return _rows(s.load_snapshot(["Vx", "Vy"], s.write_times))


def davis_points(spark, sf):
    """Vertices and the validity weights of the first time."""
    s = davis_case(spark, sf)
    return s.vertices.join(s.weights, "point_id").select("point_id", r6("x").alias("x"), r6("y").alias("y"), "w")


def surface_case(spark, sf) -> csvs.SurfaceSource:
    folder = shared_folder(spark, "surface")
    at = _coordinates()
    k = np.arange(POINTS)
    export.write_files(frames(spark, sf), folder, lambda r: {f"{r.time}/p_U.raw": export.surface("p", {"x": at[:, 0], "y": at[:, 1], "z": at[:, 2], "p": r.q, "U_x": r.n, "area_x": k * 1.0, "area_y": k * 2.0, "area_z": k * 2.0})})
    return csvs.SurfaceSource(spark, folder, "p_U.raw")


def surface_snapshots(spark, sf):
    s = surface_case(spark, sf)
    return _rows(s.load_snapshot(["p", "U_x"], s.write_times))


def surface_points(spark, sf):
    """Vertices and the norms of the area vectors."""
    s = surface_case(spark, sf)
    return s.vertices.join(s.weights, "point_id").select("point_id", r6("x").alias("x"), r6("y").alias("y"), r6("z").alias("z"), r6("w").alias("w"))


def _vtk(spark, sf, suffix: str, make) -> vtk.VtkSource:
    folder = shared_folder(spark, "vtk")
    at = _coordinates()
    export.write_files(frames(spark, sf), folder, lambda r: {f"flow_{r.time}{suffix}": make(at, {"p": np.asarray(r.q), "U": _u(r)})})
    return vtk.VtkSource(spark, folder, "flow_", suffix)


def vtk_snapshots(spark, sf):
    """Legacy binary files."""
    s = _vtk(spark, sf, ".vtk", lambda at, f: export.vtk_legacy(at, f, binary=True))
    return _rows(s.load_snapshot(["p", "U"], s.write_times))


def vtu_snapshots(spark, sf):
    """XML files with base64 data."""
    s = _vtk(spark, sf, ".vtu", export.vtu)
    return _rows(s.load_snapshot(["p", "U"], s.write_times))


def vtk_points(spark, sf):
    """Vertices and fields of legacy ASCII files."""
    s = _vtk(spark, sf, ".vtk", export.vtk_legacy)
    names = ",".join(s.field_names[s.write_times[0]])
    return s.vertices.select("point_id", r6("x").alias("x"), r6("y").alias("y"), r6("z").alias("z"), F.lit(names).alias("fields"))


PARAMETERS = """ -----------------------------------------------------
 TAU parameters: here # a comment
                         Output files prefix: old
                         Output files prefix: (thisfile)/sol # the last counts
                         Primary grid filename: grid.nc
                         Grid prefix: part
                         Number of domains: 3
                         Boundary mapping filename: (thisfile)
                         Markers: 1,2
                             Type: viscous wall
                             Write surface data (0/1): 1
                             Name: wing
                         block end
                         Markers: 3
                             Write surface data (0/1): 1
                             Name: flap
                         block end
                         Markers: 4
                             Type: farfield
                             Name: far
                         block end
""".replace("(thisfile)/", "")


def tau_case(spark, sf) -> str:
    """Volume and surface solutions and the grid; the folder is returned."""
    folder = shared_folder(spark, "tau")
    at = _coordinates()
    point = (["points"],)
    triangles, quads = np.array([[0, 1, 2], [2, 3, 4]], np.int32), np.array([[5, 6, 7, 8], [8, 9, 10, 11]], np.int32)
    grid = netcdf.write_classic(
        {"points": POINTS, "tri": 2, "quad": 2, "three": 3, "four": 4, "elements": 4},
        {name: (["points"], at[:, i].copy()) for i, name in enumerate(tau.COORDINATES)} | {tau.TRIANGLES: (["tri", "three"], triangles), tau.QUADS: (["quad", "four"], quads), tau.MARKERS: (["elements"], np.array([1, 4, 2, 3], np.int32))},
    )
    _put(folder, {"para": PARAMETERS.encode(), "grid.nc": grid})

    def files(r) -> dict[str, bytes]:
        own = {"density": (*point, np.asarray(r.q, np.float64)), "volume": (*point, np.arange(1.0, POINTS + 1))}
        ids = np.arange(12, dtype=np.int32)
        skin = {"global_id": (["points"], ids), "cp": (["points"], np.asarray(r.n[:12], np.float64))}
        tail = f"i={int(r.time) - 23000}_t={r.time}"
        return {f"sol.pval.unsteady_{tail}": netcdf.write_classic({"points": POINTS}, own), f"sol.surface.pval.unsteady_{tail}": netcdf.write_classic({"points": 12}, skin)}

    export.write_files(frames(spark, sf), folder, files)
    return folder


def tau_snapshots(spark, sf):
    s = tau.TauSource(spark, f"{tau_case(spark, sf)}/para")
    return _rows(s.load_snapshot("density", s.write_times))


def tau_points(spark, sf):
    """Vertices, and volumes divided by the largest."""
    s = tau.TauSource(spark, f"{tau_case(spark, sf)}/para")
    return s.vertices.join(s.weights, "point_id").select("point_id", *(r6(c).alias(c) for c in ("x", "y", "z", "w")))


def tau_surface(spark, sf):
    """The pressure of the points of each zone whose surface is written."""
    s = tau.TauSurfaceSource(spark, f"{tau_case(spark, sf)}/para")
    out = None
    for z in s.zone_names:
        x = _rows(s.snapshots(["cp"], s.write_times, zone=z)).withColumn("zone", F.lit(z))
        out = x if out is None else out.union(x)
    return out.select("zone", "time", "point_id", "value")


def tau_domains(spark, sf):
    """A solution in three domains, each with one point of its neighbour that is left out."""
    folder = shared_folder(spark, "tau-domains")
    _put(folder, {"para": PARAMETERS.encode()})
    n = POINTS + 1
    for d in range(3):
        grid = netcdf.write_classic({"points": n, "three": 3, "more": 1}, {"pcoord": (["points", "three"], np.zeros((n, 3)) + d), "addpoint_idx": (["more"], np.array([POINTS], np.int32))})
        _put(folder, {f"part_domain_{d}_grid_1": grid})
    export.write_files(
        frames(spark, sf, 3 * POINTS), folder, lambda r: {f"sol.pval.unsteady_i=1_t={r.time}.domain_{d}": netcdf.write_classic({"points": POINTS}, {"density": (["points"], np.asarray(r.q[d * POINTS : (d + 1) * POINTS], np.float64))}) for d in range(3)}
    )
    s = tau.TauSource(spark, f"{folder}/para", distributed=True)
    return _rows(s.load_snapshot("density", s.write_times))


def tecplot_case(spark, sf) -> tecplot.TecplotSource:
    folder = shared_folder(spark, "tecplot")
    at = _coordinates()
    cut = POINTS // 2

    def files(r) -> dict[str, bytes]:
        zone = lambda a, b: {"X": at[a:b, 0], "Y": at[a:b, 1], "Z": at[a:b, 2], "cp": r.q[a:b]}
        return {f"wing_i=7_t={r.time}.plt": export.tecplot({"ls": zone(0, cut), "te": zone(cut, POINTS)})}

    export.write_files(frames(spark, sf), folder, files)
    return tecplot.TecplotSource(spark, folder, "wing_")


def tecplot_snapshots(spark, sf):
    s = tecplot_case(spark, sf)
    return s.snapshots(["cp"], s.write_times).select("time", "zone", F.col("point_id").cast("bigint").alias("point_id"), "value")


def tecplot_points(spark, sf):
    s = tecplot_case(spark, sf)
    return s.vertices.join(s.weights, ["zone", "point_id"]).select("zone", "point_id", *(r6(c).alias(c) for c in ("x", "y", "z", "w")))


def image_scale(spark, sf):
    """Grey values of 16-bit images (part keys), scaled to [0, 1]."""
    folder = shared_folder(spark, "images")
    x = table(spark, sf, "part").select(F.floor(F.col("p_partkey") / 100).alias("row"), (F.col("p_partkey") % 100).cast("int").alias("col"), (F.col("p_partkey") * 7919 % 65536).cast("int").alias("g"))
    rows = x.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("col", "g"))).alias("c"))

    def files(r) -> dict[str, bytes]:
        a = np.zeros((1, 100), np.uint16)
        for c in r.c:
            a[0, c["col"]] = c["g"]
        return {f"row_{r.row}{'.tif' if r.row % 2 else '.pgm'}": export.tiff(a) if r.row % 2 else export.pgm(a)}

    export.write_files(rows, folder, files)
    out = None
    for suffix in (".tif", ".pgm"):
        s = images.ImageSource(spark, folder, "row_", suffix)
        v = s.load_snapshot(s.write_times) if s.write_times else None
        if v is not None:
            out = v if out is None else out.union(v)
    return out.select((F.col("time").cast("bigint") * 100 + F.col("j")).alias("p_partkey"), r6("value").alias("grey")).where("grey > 0")


def psp_case(spark, sf) -> zoned.PspSource:
    """Zones of pressure images: a source is a pixel, its readings the images."""
    folder = shared_folder(spark, "psp")
    x = once(table(spark, sf, "mask_samples").where("loader = 'psp' and weight is not null and not isnan(weight) and weight between 0 and 1"), "sample_id")
    x = x.select(F.col("zone_name").alias("zone"), "t_idx", F.col("source_id").alias("i"), F.lit(0).alias("j"), F.col("weight").alias("cp"), F.col("mask_name").alias("mask"))
    x.select("zone", "t_idx", "i", "j", "cp").write.parquet(f"{folder}/images")
    pixels = x.groupBy("zone", "mask", "i", "j").agg(F.lit(0.5).alias("w"))
    pixels.write.parquet(f"{folder}/masks")
    pixels.select("zone", "i", "j", F.col("i").cast("double").alias("x"), (F.col("i") * 2.0).alias("y"), (F.col("i") * 0.5).alias("z")).distinct().write.parquet(f"{folder}/coordinates")
    x.select("zone").distinct().select("zone", F.lit(zoned.PspSource.FREQUENCY).alias("key"), F.lit("50").alias("value"), F.lit("samples per second").alias("description")).write.parquet(f"{folder}/zones")
    return zoned.PspSource(spark, folder)


def psp_statistics(spark, sf):
    """Mean and deviation over time of each pixel of each zone."""
    s = psp_case(spark, sf)
    out = None
    for z in s.zone_names:
        x = s.statistics(z).select(F.lit(z).alias("zone"), "i", r6("mean").alias("mean"), r6("std").alias("std"))
        out = x if out is None else out.union(x)
    return out


def psp_masked(spark, sf):
    """Images multiplied by the first mask of their zone."""
    s = psp_case(spark, sf)
    out = None
    for z in s.zone_names:
        x = s.images(z, mask=s.mask_names(z)[0]).select(F.lit(z).alias("zone"), "i", "t_idx", "cp")
        out = x if out is None else out.union(x)
    return out


def psp_views(spark, sf):
    """The mean of every pixel as a figure of each zone shows it."""
    s = psp_case(spark, sf)
    rows = []
    for z in s.zone_names:
        f = explore.Explorer(s).mean(z, every=1)
        x, colour = f["surface"]["x"], f["frames"][0]["color"]
        rows += [(z, float(x[i][0]), round(float(v[0]), 6) + 0.0) for i, v in enumerate(colour)]
    return spark.createDataFrame(rows, "zone string, x double, mean double")


def psp_zones(spark, sf):
    """Masks, frequency, number of times and aspect ratio of each zone, and the image of a time in it."""
    s = psp_case(spark, sf)
    rows = []
    for z in s.zone_names:
        ratio = s.aspect_ratio(z)
        times = s.times(z)
        rows.append((z, ",".join(s.mask_names(z)), s.frequency(z), len(times), s.index(times[-1], z), ratio["y"], ratio["z"]))
    return spark.createDataFrame(rows, "zone string, masks string, frequency double, n_times bigint, last bigint, y double, z double")


def time_to_index(spark, sf):
    """Index of a write time at 50 samples per unit, rounded half to even."""
    x = once(table(spark, sf, "mask_samples").where("loader = 'psp'"), "sample_id")
    return x.select("sample_id", zoned.time_index(F.col("write_time"), 50.0).alias("k"))


def s_cube_case(spark, sf) -> zoned.SCubeSource:
    folder = shared_folder(spark, "s-cube")
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("cell_id"), F.col("p_retailprice").cast("double").alias("x"), F.col("p_size").cast("double").alias("y"), F.lit(0.0).alias("z"), (F.col("p_size") % 8).cast("int").alias("level"))
    p.write.parquet(f"{folder}/cells")
    spark.createDataFrame([(4.0, 2)], "size0 double, dims int").write.parquet(f"{folder}/size")
    value = p.select("cell_id", "y", F.explode(F.array(F.lit("0.5"), F.lit("10"))).alias("time"))
    value = value.select("time", F.explode(F.array(F.lit("p_center"), F.lit("p_vertices"))).alias("name"), "cell_id", (F.col("y") * F.col("time").cast("double")).alias("value"))
    value.write.parquet(f"{folder}/variable")
    return zoned.SCubeSource(spark, folder)


def s_cube_weights(spark, sf):
    """Cell area from its refinement level: 2^-d (size0 / 2^level)^d with d = 2 and size0 = 4."""
    return s_cube_case(spark, sf).weights.select(F.col("point_id").alias("p_partkey"), "w")


def s_cube_snapshots(spark, sf):
    """The centre values of all times."""
    return _rows(s_cube_case(spark, sf).load_snapshot("p")).drop("comp")


QUERIES = {
    f.__name__: f
    for f in (
        foam_snapshots, foam_binary, foam_decomposed, foam_format, foam_catalog, foam_matrix, foam_cells, foam_mesh_lists, store_snapshots, store_catalog, store_constants, xdmf_values, xdmf_mesh,
        davis_snapshots, davis_points, surface_snapshots, surface_points, vtk_snapshots, vtu_snapshots, vtk_points, tau_snapshots, tau_points, tau_surface, tau_domains, tecplot_snapshots, tecplot_points,
        image_scale, psp_statistics, psp_masked, psp_views, psp_zones, time_to_index, s_cube_weights, s_cube_snapshots,
    )
}


def _grid(points: int = POINTS) -> str:
    return f"""m AS (SELECT CAST(year(l_shipdate) * 12 + month(l_shipdate) AS VARCHAR) AS time, CAST(l_suppkey % {points} AS BIGINT) AS point_id, CAST(sum(l_quantity) AS DOUBLE) AS q, CAST(count(*) AS DOUBLE) AS n, CAST(sum(l_linenumber) AS DOUBLE) AS s FROM lineitem GROUP BY ALL),
t AS (SELECT time, CAST(sum(n) AS DOUBLE) AS total, row_number() OVER (ORDER BY CAST(time AS BIGINT)) - 1 AS place FROM m GROUP BY time),
g AS (SELECT t.time, t.total, t.place, p.point_id, coalesce(q, 0.0) AS q, coalesce(n, 0.0) AS n, coalesce(s, 0.0) AS s FROM t CROSS JOIN (SELECT unnest(range({points})) AS point_id) p LEFT JOIN m ON m.time = t.time AND m.point_id = p.point_id)"""


def _fields(*parts: tuple[str, str, int]) -> str:
    return " UNION ALL ".join(f"SELECT time, '{f}' AS field, point_id, CAST({c} AS BIGINT) AS comp, CAST({v} AS DOUBLE) AS value FROM g" for f, v, c in parts)


_U = (("U", "q", 0), ("U", "n", 1), ("U", "s", 2))
_C = f"c AS (SELECT point_id, round((point_id % {SIDE} + 0.5) / {SIDE}, 6) + 0.0 AS x, round((point_id // {SIDE} % {SIDE} + 0.5) / {SIDE}, 6) + 0.0 AS y, round((point_id // {SIDE * SIDE} % {SIDE} + 0.5) / {SIDE}, 6) + 0.0 AS z FROM (SELECT unnest(range({POINTS})) AS point_id))"
_PSP = "p AS (SELECT sample_id, any_value(zone_name) AS zone, any_value(source_id) AS i, any_value(t_idx) AS t_idx, any_value(weight) AS cp, any_value(mask_name) AS mask FROM mask_samples WHERE loader = 'psp' AND weight IS NOT NULL AND NOT isnan(weight) AND weight BETWEEN 0 AND 1 GROUP BY sample_id)"

SQL = {
    "foam_snapshots": f"WITH {_grid()} {_fields(('p', 'q', 0), *_U, ('T', 'total', 0))}",
    "foam_binary": f"WITH {_grid()} {_fields(('p', 'q', 0), *_U)}",
    "foam_decomposed": f"WITH {_grid(3 * POINTS)} {_fields(('p', 'q', 0))}",
    "foam_format": f"WITH {_grid()} {_fields(*_U)}",
    "foam_catalog": f"WITH {_grid()} SELECT place, time, unnest(['T', 'U', 'p']) AS field FROM t",
    "foam_matrix": f"WITH {_grid()} SELECT point_id, place AS k, n AS value FROM g",
    "foam_cells": f"WITH {_C} SELECT point_id + {POINTS} * d AS point_id, x, y, z, round(1 / {POINTS}, 6) + 0.0 AS w FROM c CROSS JOIN (SELECT unnest(range(3)) AS d)",
    "foam_mesh_lists": f"""WITH {_C}, f AS (SELECT d, a, b, e FROM (SELECT unnest(range(3)) AS d), (SELECT unnest(range({SIDE + 1})) AS a), (SELECT unnest(range({SIDE})) AS b), (SELECT unnest(range({SIDE})) AS e)),
pt AS (SELECT i + {SIDE + 1} * (j + {SIDE + 1} * k) AS pid, (i + 2 * j + 4 * k) / {SIDE} AS v FROM (SELECT unnest(range({SIDE + 1})) AS i), (SELECT unnest(range({SIDE + 1})) AS j), (SELECT unnest(range({SIDE + 1})) AS k)),
ix AS (SELECT a, CASE d WHEN 0 THEN 1 WHEN 1 THEN {SIDE} ELSE {SIDE * SIDE} END AS along, CASE d WHEN 0 THEN {SIDE} WHEN 1 THEN {SIDE * SIDE} ELSE 1 END * b + CASE d WHEN 0 THEN {SIDE * SIDE} WHEN 1 THEN 1 ELSE {SIDE} END * e AS rest,
  CASE d WHEN 0 THEN 1 WHEN 1 THEN {SIDE + 1} ELSE {(SIDE + 1) ** 2} END AS pa, CASE d WHEN 0 THEN {SIDE + 1} WHEN 1 THEN {(SIDE + 1) ** 2} ELSE 1 END AS pb, CASE d WHEN 0 THEN {(SIDE + 1) ** 2} WHEN 1 THEN 1 ELSE {SIDE + 1} END AS pe, b, e FROM f)
SELECT 'points' AS list, count(*) AS n, round(sum(v), 6) + 0.0 AS total FROM pt
UNION ALL SELECT 'faces', count(*), CAST(sum(4 * (pa * a + pb * b + pe * e) + 2 * pb + 2 * pe) AS DOUBLE) FROM ix
UNION ALL SELECT 'owner', count(*), CAST(sum(rest + along * greatest(a - 1, 0)) AS DOUBLE) FROM ix
UNION ALL SELECT 'neighbour', count(*), CAST(sum(rest + along * a) AS DOUBLE) FROM ix WHERE a > 0 AND a < {SIDE}""",
    "store_snapshots": f"WITH {_grid()} {_fields(('p', 'q', 0), ('T', 'total + 1', 0))}",
    "store_catalog": f"WITH {_grid()} SELECT place, time, unnest(['T', 'U', 'p']) AS field FROM t",
    "store_constants": f"WITH {_C} SELECT point_id, CAST(32 AS BIGINT) AS n, x, y, z, round(1 / {POINTS}, 6) + 0.0 AS w FROM c",
    "xdmf_values": f"WITH {_grid()} {_fields(('p', 'q', 0), *_U)}",
    "xdmf_mesh": f"WITH {_C} SELECT point_id AS cell, CAST(6 AS BIGINT) AS faces, CAST(8 AS BIGINT) AS corners, x, y, z FROM c",
    "davis_snapshots": f"WITH {_grid()} {_fields(('Vx', 'q', 0), ('Vy', 'n', 0))}",
    "davis_points": f"WITH {_C} SELECT point_id, x, y, CAST(point_id % 2 AS DOUBLE) AS w FROM c",
    "surface_snapshots": f"WITH {_grid()} {_fields(('p', 'q', 0), ('U_x', 'n', 0))}",
    "surface_points": f"WITH {_C} SELECT point_id, x, y, z, CAST(3 * point_id AS DOUBLE) AS w FROM c",
    "vtk_snapshots": f"WITH {_grid()} {_fields(('p', 'q', 0), *_U)}",
    "vtu_snapshots": f"WITH {_grid()} {_fields(('p', 'q', 0), *_U)}",
    "vtk_points": f"WITH {_C} SELECT point_id, x, y, z, 'p,U' AS fields FROM c",
    "tau_snapshots": f"WITH {_grid()} {_fields(('density', 'q', 0))}",
    "tau_points": f"WITH {_C} SELECT point_id, x, y, z, round((point_id + 1) / {POINTS}, 6) + 0.0 AS w FROM c",
    "tau_surface": f"WITH {_grid()}, z AS (SELECT 'wing' AS zone, unnest([0, 1, 2, 5, 6, 7, 8]) AS k UNION ALL SELECT 'flap', unnest([8, 9, 10, 11])) SELECT zone, time, point_id, n AS value FROM g JOIN z ON z.k = point_id",
    "tau_domains": f"WITH {_grid(3 * POINTS)} {_fields(('density', 'q', 0))}",
    "tecplot_snapshots": f"WITH {_grid()} SELECT time, CASE WHEN point_id < {POINTS // 2} THEN 'ls' ELSE 'te' END AS zone, CASE WHEN point_id < {POINTS // 2} THEN point_id ELSE point_id - {POINTS // 2} END AS point_id, q AS value FROM g",
    "tecplot_points": f"WITH {_C} SELECT CASE WHEN point_id < {POINTS // 2} THEN 'ls' ELSE 'te' END AS zone, CASE WHEN point_id < {POINTS // 2} THEN point_id ELSE point_id - {POINTS // 2} END AS point_id, x, y, z, CAST(1 AS DOUBLE) AS w FROM c",
    "image_scale": "SELECT p_partkey, round((p_partkey * 7919 % 65536) / 65535, 6) + 0.0 AS grey FROM part WHERE round((p_partkey * 7919 % 65536) / 65535, 6) > 0",
    "psp_statistics": f"WITH {_PSP} SELECT zone, i, round(avg(cp), 6) + 0.0 AS mean, round(stddev_samp(cp), 6) + 0.0 AS std FROM p GROUP BY zone, i",
    "psp_masked": f"WITH {_PSP}, f AS (SELECT zone, min(mask) AS mask FROM p GROUP BY zone), px AS (SELECT DISTINCT p.zone, p.i FROM p JOIN f ON f.zone = p.zone AND f.mask = p.mask) SELECT p.zone, p.i, p.t_idx, 0.5 * p.cp AS cp FROM p JOIN px ON px.zone = p.zone AND px.i = p.i",
    "psp_views": f"WITH {_PSP} SELECT zone, CAST(i AS DOUBLE) AS x, round(avg(cp), 6) + 0.0 AS mean FROM p GROUP BY zone, i",
    "psp_zones": f"WITH {_PSP} SELECT zone, string_agg(DISTINCT mask, ',' ORDER BY mask) AS masks, CAST(50 AS DOUBLE) AS frequency, max(t_idx) + 1 AS n_times, max(t_idx) AS last, CASE WHEN min(i) < max(i) THEN CAST(2 AS DOUBLE) END AS y, CASE WHEN min(i) < max(i) THEN CAST(0.5 AS DOUBLE) END AS z FROM p GROUP BY zone",
    "time_to_index": "SELECT sample_id, CAST(round_even(any_value(try_cast(write_time AS DOUBLE)) * 50, 0) AS BIGINT) AS k FROM mask_samples WHERE loader = 'psp' GROUP BY sample_id",
    "s_cube_weights": "SELECT p_partkey, CAST(0.25 * pow(4 / pow(2, p_size % 8), 2) AS DOUBLE) AS w FROM part",
    "s_cube_snapshots": "SELECT t.time, 'p' AS field, p_partkey AS point_id, CAST(p_size * CAST(t.time AS DOUBLE) AS DOUBLE) AS value FROM part CROSS JOIN (SELECT unnest(['0.5', '10']) AS time) t",
}
