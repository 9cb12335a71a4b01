import struct
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

import tidewright.sources as sources
from tidewright.sources import csvs, foam, images, netcdf, store, tau, tecplot, vtk, zoned

HEAD = 'FoamFile\n{{\n    version 2.0;\n    format {};\n    class {};\n{}    object {};\n}}\n'


def foam_list(values, binary, kind="<f8"):
    a = np.asarray(values)
    if binary:
        return f"{len(a)}\n(".encode() + a.astype(kind).tobytes() + b")\n"
    rows = "\n".join(str(v) if a.ndim == 1 else f"({' '.join(map(str, v))})" for v in a.tolist())
    return f"{len(a)}\n(\n{rows}\n)\n".encode()


def write_case(root, binary=False, cells=2, poly=False):
    """A row of unit cubes along x."""
    mesh = root / "constant/polyMesh"
    mesh.mkdir(parents=True)
    form = "binary" if binary else "ascii"
    pid = lambda i, j, k: i + (cells + 1) * (j + 2 * k)
    points = [[i, j, k] for k in (0, 1) for j in (0, 1) for i in range(cells + 1)]
    inner = [([pid(i, 0, 0), pid(i, 1, 0), pid(i, 1, 1), pid(i, 0, 1)], i - 1, i) for i in range(1, cells)]
    outer = [([pid(0, 0, 0), pid(0, 0, 1), pid(0, 1, 1), pid(0, 1, 0)], 0), ([pid(cells, 0, 0), pid(cells, 1, 0), pid(cells, 1, 1), pid(cells, 0, 1)], cells - 1)]
    for i in range(cells):
        a, b = i, i + 1
        outer += [([pid(a, 0, 0), pid(b, 0, 0), pid(b, 0, 1), pid(a, 0, 1)], i), ([pid(a, 1, 0), pid(a, 1, 1), pid(b, 1, 1), pid(b, 1, 0)], i), ([pid(a, 0, 0), pid(a, 1, 0), pid(b, 1, 0), pid(b, 0, 0)], i), ([pid(a, 0, 1), pid(b, 0, 1), pid(b, 1, 1), pid(a, 1, 1)], i)]
    faces = [f for f, *_ in inner] + [f for f, _ in outer]
    owner = [o for _, o, _ in inner] + [o for _, o in outer]
    note = f'    note "nPoints:{len(points)}  nCells:{cells}  nFaces:{len(faces)}";\n'
    (mesh / "points").write_bytes(HEAD.format(form, "vectorField", "", "points").encode() + foam_list(points, binary))
    if binary:
        offsets = np.concatenate([[0], np.cumsum([len(f) for f in faces])])
        data = foam_list(offsets, True, "<i4") + foam_list(np.concatenate(faces), True, "<i4")
        (mesh / "faces").write_bytes(HEAD.format(form, "faceCompactList", "", "faces").encode() + data)
    else:
        text = "\n".join(f"{len(f)}({' '.join(map(str, f))})" for f in faces)
        (mesh / "faces").write_text(HEAD.format(form, "faceList", "", "faces") + f"\n{len(faces)}\n(\n{text}\n)\n")
    (mesh / "owner").write_bytes(HEAD.format(form, "labelList", note, "owner").encode() + foam_list(owner, binary, "<i4"))
    (mesh / "neighbour").write_bytes(HEAD.format(form, "labelList", note, "neighbour").encode() + foam_list([n for _, _, n in inner], binary, "<i4"))
    (mesh / "boundary").write_text("boundary")
    for t, scale in (("0", 0.0), ("0.5", 1.0), ("10", 2.0)):
        d = root / t
        d.mkdir()
        if t == "0":
            (d / "p").write_text(HEAD.format(form, "volScalarField", "", "p") + "\ninternalField   uniform 7.5;\n")
            (d / "U").write_text(HEAD.format(form, "volVectorField", "", "U") + "\ninternalField   uniform (1 2 3);\n")
        else:
            p = scale * np.arange(1.0, cells + 1)
            (d / "p").write_bytes(HEAD.format(form, "volScalarField", "", "p").encode() + b"\ninternalField   nonuniform List<scalar> \n" + foam_list(p, binary) + b";\n")
            (d / "U").write_bytes(HEAD.format(form, "volVectorField", "", "U").encode() + b"\ninternalField   nonuniform List<vector> \n" + foam_list(np.stack([p, 2 * p, 3 * p], axis=1), binary) + b";\n")
        (d / "phi").write_text(HEAD.format(form, "surfaceScalarField", "", "phi") + "\ninternalField uniform 0;\n")


@pytest.mark.parametrize("binary", [False, True])
def test_foam_case(spark, tmp_path, binary):
    write_case(tmp_path / "case", binary)
    s = foam.FoamSource(spark, str(tmp_path / "case"))
    assert s.write_times == ["0", "0.5", "10"] and s.field_names["0"] == ["U", "p", "phi"]
    got = s.load_snapshot(["p", "U"], ["0", "10"]).collect()
    at = {(r["time"], r["field"], r["point_id"], r["comp"]): r["value"] for r in got}
    assert at["0", "p", 1, 0] == 7.5 and at["10", "p", 1, 0] == 4.0 and at["10", "U", 0, 2] == 6.0 and at["0", "U", 1, 1] == 2.0 and len(got) == 16
    c = s.mesh.cells().orderBy("point_id").toPandas()
    assert np.allclose(c["volume"], 1) and np.allclose(c["x"], [0.5, 1.5]) and np.allclose(c["y"], 0.5)
    assert s.matrix("p").numpy().tolist() == [[7.5, 1.0, 2.0], [7.5, 2.0, 4.0]]
    for bad in (("q", "0"), ("p", "3")):
        with pytest.raises(ValueError):
            s.load_snapshot(*bad)
    with pytest.raises(Exception):
        s.load_snapshot("phi", "0").collect()


def test_foam_decomposed_and_store(spark, tmp_path):
    for k, n in ((0, 2), (1, 3)):
        write_case(tmp_path / f"par/processor{k}", cells=n)
    s = foam.FoamSource(spark, str(tmp_path / "par"))
    assert s.case.distributed and s.cells == [2, 3]
    assert s.matrix("p", ["0.5"]).numpy().ravel().tolist() == [1, 2, 1, 2, 3]
    assert s.weights.count() == 5
    with pytest.raises(ValueError):
        store.foam_to_store(s, str(tmp_path / "no"))
    write_case(tmp_path / "one")
    one = foam.FoamSource(spark, str(tmp_path / "one"))
    st = store.foam_to_store(one, str(tmp_path / "store"), times=["0.5", "10"])
    assert st.write_times == ["0.5", "10"] and st.field_names["10"] == ["U", "p"]
    assert st.matrix("p").numpy().tolist() == [[1.0, 2.0], [2.0, 4.0]]
    path = store.write_xdmf(st, chunk=3)
    text = open(path).read()
    held = store.read_xdmf(path)
    assert held["0.5", "U"].tolist() == [[1.0, 2.0, 3.0], [2.0, 4.0, 6.0]] and held["10", "p"].tolist() == [2.0, 4.0] and held["10", "Geometry"].shape == (12, 3)
    assert held["0.5", "Topology"][:2].tolist() == [16, 6] and "HDF" not in text
    assert text.count("<Attribute") == 4 and 'AttributeType="Vector"' in text and 'Value="0.5"' in text
    st.write(spark.createDataFrame([("10", "p", k, 0, 9.0) for k in (0, 1)], "time string, field string, point_id bigint, comp int, value double"))
    assert st.matrix("p").numpy().tolist() == [[1.0, 9.0], [2.0, 9.0]]
    assert store.copy_mesh(spark, str(tmp_path / "store"), str(tmp_path / "mesh")).vertices.count() == 2
    with pytest.raises(ValueError):
        st.write_constant("other", one.vertices)
    (tmp_path / "one/constant/polyMesh/faces").unlink()
    with pytest.raises(FileNotFoundError):
        foam.FoamCase(str(tmp_path / "one"))


def test_spark_formats(spark, tmp_path):
    from tidewright.sources import datasource

    datasource.register(spark)
    for k, n in ((0, 2), (1, 3)):
        write_case(tmp_path / f"par/processor{k}", cells=n)
    (tmp_path / "flow_1.vtk").write_text(LEGACY)
    d = spark.read.format("tidewright_foam").load(str(tmp_path / "par"))
    assert d.count() == 3 * 5 * 4 and sorted(r[0] for r in d.select("field").distinct().collect()) == ["U", "p"]
    one = d.where((F.col("time") == "10") & F.col("field").isin("p", "q")).orderBy("point_id").collect()
    assert [r["value"] for r in one] == [2, 4, 2, 4, 6]
    v = spark.read.format("tidewright_vtk").option("prefix", "flow_").load(str(tmp_path))
    assert v.where("field = 'U' and comp = 2").agg(F.sum("value")).first()[0] == 9.0
    assert v.where("time = '7'").count() == 0
    r = datasource.FoamReader({"path": str(tmp_path / "par")})
    assert list(r.pushFilters([datasource.EqualTo(("time",), "0.5"), datasource.In(("field",), ("p",))])) == [] and len(r.partitions()) == 2


def test_faces_of_many_points():
    data = b"FoamFile\n{\n format ascii;\n class faceList;\n}\n2\n(\n12(0 1 2 3 4 5 6 7 8 9 10 11)\n3(0\n1\n2)\n)\n"
    assert [len(f) for f in foam.parse_faces(data)] == [12, 3]


def test_delimited(spark, tmp_path):
    for t in ("00001", "00010"):
        (tmp_path / f"B{t}.dat").write_text(f'TITLE = "B{t}"\nVARIABLES = "x", "y", "Vx", "isValid"\nZONE I=2, J=1, F=POINT\n0.5 1.5 {int(t)}.0 1\n0.6 1.6 nan 0\n')
    s = csvs.DavisSource(spark, str(tmp_path), "B")
    assert s.write_times == ["00001", "00010"] and s.field_names == {"00001": ["Vx"]}
    m = s.load_snapshot("Vx", ["00001", "00010"]).where("point_id = 0").orderBy("time").collect()
    assert [r["value"] for r in m] == [1.0, 10.0]
    assert [tuple(r) for r in s.vertices.orderBy("point_id").collect()] == [(0, 0.5, 1.5), (1, 0.6, 1.6)]
    assert [r["w"] for r in s.weights.orderBy("point_id").collect()] == [1.0, 0.0]
    for t in ("0.1", "0.25"):
        (tmp_path / t).mkdir()
        (tmp_path / t / "U.raw").write_text("# U FACE_DATA 2\n#  x y z  U_x area_x area_y area_z\n0 0 1 2.5 3 4 0\n1 0 1 3.5 0 0 2\n")
    r = csvs.SurfaceSource(spark, str(tmp_path), "U.raw")
    assert r.write_times == ["0.1", "0.25"] and [x["w"] for x in r.weights.orderBy("point_id").collect()] == [5.0, 2.0]
    assert r.matrix("U_x").numpy().tolist() == [[2.5, 2.5], [3.5, 3.5]]
    with pytest.raises(FileNotFoundError):
        csvs.DavisSource(spark, str(tmp_path), "C")


LEGACY = "# vtk DataFile Version 3.0\ntitle\nASCII\nDATASET UNSTRUCTURED_GRID\nPOINTS 2 double\n0 0 0\n1 2 3\nCELLS 1 3\n2 0 1\nCELL_TYPES 1\n3\nPOINT_DATA 2\nSCALARS p double 1\nLOOKUP_TABLE default\n5\n6\nVECTORS U double\n1 2 3\n4 5 6\n"


def test_vtk(spark, tmp_path):
    (tmp_path / "flow_1.vtk").write_text(LEGACY)
    body = LEGACY.replace("ASCII", "BINARY").encode()
    for text, values, kind in (("0 0 0\n1 2 3\n", [0, 0, 0, 1, 2, 3], ">f8"), ("2 0 1\n", [2, 0, 1], ">i4"), ("3\n", [3], ">i4"), ("5\n6\n", [5, 7], ">f8"), ("1 2 3\n4 5 6\n", [1, 2, 3, 4, 5, 6], ">f8")):
        i = body.rindex(text.encode()) if kind == ">f8" else body.index(b"\n" + text.encode()) + 1
        body = body[:i] + np.array(values, kind).tobytes() + b"\n" + body[i + len(text) :]
    (tmp_path / "flow_2.vtk").write_bytes(body)
    s = vtk.VtkSource.from_su2(spark, str(tmp_path), "flow_")
    assert s.field_names == {"1": ["p", "U"]} and s.matrix("p").numpy().tolist() == [[5, 5], [6, 7]]
    assert s.matrix("U", comp=2).numpy().tolist() == [[3, 3], [6, 6]] and s.vertices.orderBy("point_id").collect()[1]["z"] == 3
    with pytest.raises(NotImplementedError):
        s.weights
    p = np.array([[0.0, 0, 0], [1, 2, 3]])
    xml = f'<VTKFile type="UnstructuredGrid" header_type="UInt32"><UnstructuredGrid><Piece><Points><DataArray type="Float64" NumberOfComponents="3" format="ascii">0 0 0 1 2 3</DataArray></Points><PointData><DataArray type="Float32" Name="rho" format="binary">{vtk.pack(np.array([1.5, 2.5], "<f4"))}</DataArray></PointData></Piece></UnstructuredGrid></VTKFile>'
    points, fields = vtk.parse(name="a.vtu", data=xml.encode())
    assert np.allclose(points, p) and fields["rho"].ravel().tolist() == [1.5, 2.5]
    import base64
    import zlib

    raw = np.array([1.5, 2.5], "<f4").tobytes()
    z = zlib.compress(raw)
    packed = base64.b64encode(struct.pack("<IIII", 1, len(raw), len(raw), len(z))).decode() + base64.b64encode(z).decode()
    xml2 = xml.replace('header_type="UInt32"', 'header_type="UInt32" compressor="vtkZLibDataCompressor"').replace(vtk.pack(np.array([1.5, 2.5], "<f4")), packed)
    assert vtk.parse("a.vtu", xml2.encode())[1]["rho"].ravel().tolist() == [1.5, 2.5]


def tiff(a):
    raw = a.astype("<u2").tobytes()
    tags = [(256, 3, a.shape[1]), (257, 3, a.shape[0]), (258, 3, 16), (259, 3, 1), (273, 4, 8), (277, 3, 1), (279, 4, len(raw))]
    ifd = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in tags) + b"\0\0\0\0"
    return b"II*\0" + struct.pack("<I", 8 + len(raw)) + raw + ifd


def test_images(spark, tmp_path):
    a = np.zeros((3, 4), int)
    a[1, 2], a[2, 3] = 32768, 65535
    for t in ("1", "2"):
        (tmp_path / f"im{t}.tif").write_bytes(tiff(a))
    s = images.ImageSource(spark, str(tmp_path), "im")
    got = {(r["i"], r["j"]): r["value"] for r in s.load_snapshot("1").collect()}
    assert got[2, 3] == 1.0 and abs(got[1, 2] - 32768 / 65535) < 1e-12 and s.load_snapshot("image", ["1", "2"]).count() == 24
    assert images.parse_image(b"P5\n# c\n2 1\n255\n\x00\xff").tolist() == [[0.0, 1.0]] and images.parse_image(b"P2 2 1 255\n51 255").tolist() == [[0.2, 1.0]]
    for name in ("field_names", "vertices", "weights"):
        with pytest.raises(NotImplementedError):
            getattr(s, name)


PARA = "Output files prefix : sol/case\nPrimary grid filename : grid.nc # comment\nGrid prefix : grid\n# Number of domains : 9\nNumber of domains : 2\nBoundary mapping filename : (thisfile)\nMarkers : 1, 2\nName : wing\nWrite surface data (0/1) : 1\nblock end\nMarkers : 3\nName : wing\nWrite surface data (0/1) : 1\nblock end\nMarkers : 4\nName : far\nblock end\n"


def test_tau(spark, tmp_path):
    (tmp_path / "sol").mkdir()
    (tmp_path / "para").write_text(PARA)
    c = tau.TauConfig(str(tmp_path / "para")).config
    assert c["n_domains"] == 2 and c["primary_grid"] == "grid.nc" and c["bmap_file"] == {"wing": [1, 2], "wing_marker3": [3]}
    xyz = {k: (["n"], np.arange(6.0) + i) for i, k in enumerate(tau.COORDINATES)}
    grid = {**xyz, tau.TRIANGLES: (["t", "three"], np.array([[0, 1, 2], [2, 3, 4], [3, 4, 5]], "i4")), tau.MARKERS: (["t"], np.array([1, 3, 4], "i4"))}
    (tmp_path / "grid.nc").write_bytes(netcdf.write_classic({"n": 6, "t": 3, "three": 3}, grid))
    for i, t in ((1, "1.0e-01"), (2, "2.0e-01")):
        v = {"p": (["n"], np.arange(6.0) * i), "volume": (["n"], np.array([1.0, 2, 4, 1, 1, 1])), "one": (["k"], np.ones(1))}
        (tmp_path / f"sol/case.pval.unsteady_i={i}_t={t}").write_bytes(netcdf.write_classic({"n": 6, "k": 1}, v))
        (tmp_path / f"sol/case.surface.pval.unsteady_i={i}_t={t}").write_bytes(netcdf.write_classic({"n": 5}, {"global_id": (["n"], np.arange(5, dtype="i4")), "cp": (["n"], np.arange(5.0) * i)}))
    s = tau.TauSource(spark, str(tmp_path / "para"))
    assert s.write_times == ["1.0e-01", "2.0e-01"] and s.field_names["1.0e-01"] == ["p", "volume"]
    assert s.matrix("p").numpy()[2].tolist() == [2.0, 4.0] and s.vertices.orderBy("point_id").collect()[5]["z"] == 7.0
    assert [r["w"] for r in s.weights.orderBy("point_id").collect()][:3] == [0.25, 0.5, 1.0]
    f = tau.TauSurfaceSource(spark, str(tmp_path / "para"))
    ids = {}
    for r in f.zone_ids().collect():
        ids.setdefault(r["zone"], set()).add(r["point_id"])
    assert ids == {"wing": {0, 1, 2}, "wing_marker3": {2, 3, 4}}
    assert {r["point_id"]: r["value"] for r in f.snapshots(["cp"], ["2.0e-01"], "wing").collect()} == {0: 0.0, 1: 2.0, 2: 4.0}
    assert f.vertices.count() == 6 and f.weights.agg(F.sum("w")).first()[0] == 6.0 and f.field_names["1.0e-01"] == ["cp"]
    for d, n in ((0, 3), (1, 2)):
        (tmp_path / f"grid_domain_{d}_grid_1").write_bytes(netcdf.write_classic({"n": n + 1, "three": 3, "a": 1}, {"pcoord": (["n", "three"], np.arange(3.0 * (n + 1)).reshape(-1, 3) + d), "addpoint_idx": (["a"], np.zeros(1, "i4"))}))
        (tmp_path / f"sol/case.pval.unsteady_i=1_t=1.0e-01.domain_{d}").write_bytes(netcdf.write_classic({"n": n}, {"p": (["n"], np.arange(float(n)) + 10 * d)}))
    p = tau.TauSource(spark, str(tmp_path / "para"), distributed=True)
    assert p.sizes == [3, 2] and p.matrix("p").numpy().ravel().tolist() == [0, 1, 2, 10, 11] and p.weights.agg(F.sum("w")).first()[0] == 5.0
    with pytest.raises(FileNotFoundError):
        (tmp_path / "other").write_text(PARA.replace("sol/case", "none/x"))
        tau.TauSource(spark, str(tmp_path / "other"))


def test_psp_and_scube(spark, tmp_path):
    p = str(tmp_path / "psp")
    spark.createDataFrame([("Zone0000", "SamplingFrequency", "10", "Hz"), ("Zone0000", "ZoneName", "HTP", "")], "zone string, key string, value string, description string").write.parquet(p + "/zones")
    spark.createDataFrame([("Zone0000", t, i, j, float(t + i)) for t in range(4) for i in range(2) for j in range(3)], "zone string, t_idx int, i int, j int, cp double").write.parquet(p + "/images")
    spark.createDataFrame([("Zone0000", i, j, 2.0 * i, 1.0 * j, 0.0) for i in range(2) for j in range(3)], "zone string, i int, j int, x double, y double, z double").write.parquet(p + "/coordinates")
    spark.createDataFrame([("Zone0000", "Mask1", i, j, float(i)) for i in range(2) for j in range(3)], "zone string, mask string, i int, j int, w double").write.parquet(p + "/masks")
    s = zoned.PspSource(spark, p)
    assert s.write_times == ["0.0", "0.1", "0.2", "0.3"] and s.mask_names("Zone0000") == ["Mask1"] and s.zone_info("Zone0000")["ZoneName"] == ("HTP", "")
    assert s.images("Zone0000", ["0.3"], "Mask1").agg(F.sum("cp")).first()[0] == 12.0 and s.images("Zone0000", every=2).count() == 8
    st = {(r["i"], r["j"]): (r["mean"], r["std"]) for r in s.statistics("Zone0000").collect()}
    assert st[1, 0][0] == 2.5 and abs(st[1, 0][1] - np.std([1, 2, 3, 4], ddof=1)) < 1e-12 and s.aspect_ratio("Zone0000") == {"x": 1.0, "y": 1.0, "z": 0.0}
    from tidewright.operators.explore import Explorer

    e = Explorer(s)
    fig = e.interact("Zone0000", ["0.1", "0.2"], every=1)
    assert len(fig["frames"]) == 2 and fig["frames"][0]["color"] == [[1.0] * 3, [2.0] * 3] and fig["surface"]["x"] == [[0.0] * 3, [2.0] * 3]
    assert e.mean("Zone0000", mask="Mask1", every=2)["frames"][0]["color"] == [[0.0, 0.0]] and len(e.std("Zone0000")["frames"]) == 1
    with pytest.raises(FileNotFoundError):
        zoned.PspSource(spark, "/no/such/file")
    q = str(tmp_path / "cube")
    spark.createDataFrame([(0, 0.5, 0.5, 0.0, 0), (1, 1.5, 0.5, 0.0, 2)], "cell_id bigint, x double, y double, z double, level int").write.parquet(q + "/cells")
    spark.createDataFrame([("0.4", "p_center", 0, 1.0), ("0.4", "p_center", 1, 2.0), ("0.4", "p_vertices", 0, 3.0)], "time string, name string, cell_id bigint, value double").write.parquet(q + "/variable")
    spark.createDataFrame([(4.0, 2)], "size0 double, dims int").write.parquet(q + "/size")
    c = zoned.SCubeSource(spark, q)
    assert c.field_names == {"0.4": ["p"]} and c.load_snapshot("p").count() == 2 and [r["w"] for r in c.weights.orderBy("point_id").collect()] == [4.0, 0.25]


READER = '''
import json, pathlib, sys
import numpy as np
folder = pathlib.Path(sys.argv[-1])
print("noise on the standard output")
for k, task in enumerate(json.loads((folder / "job.json").read_text())):
    if "broken" in task["path"]:
        sys.exit("cannot read " + task["path"])
    if "silent" in task["path"]:
        continue
    index = {"names": {z: ["X", "Y", "cp"] for z in ("a", "b") if task["zone"] in (None, z)}, "arrays": {}}
    for z in index["names"]:
        for f in task["fields"]:
            name = f"{k}-{z}-{f}.npy"
            np.save(folder / name, np.array([2.0, 3.0, 4.0]))
            index["arrays"].setdefault(z, {})[f] = name
    (folder / f"{k}.json").write_text(json.dumps(index))
'''


def test_tecplot(spark, tmp_path):
    program = tmp_path / "reader.py"
    program.write_text(READER)
    command = [sys.executable, str(program)]
    first, second = tecplot.convert(command, ["x", "y"], ["cp"])
    assert list(first["names"]) == ["a", "b"] and first["data"]["a"]["cp"].tolist() == [2, 3, 4] and second["data"].keys() == {"a", "b"}
    assert tecplot.convert(command, ["x"])[0]["data"] == {} and list(tecplot.convert(command, ["x"], ["X"], "b")[0]["data"]) == ["b"]
    with pytest.raises(tecplot.ReaderError, match="cannot read broken"):
        tecplot.convert(command, ["x", "broken"])
    with pytest.raises(tecplot.ReaderError, match="no result"):
        tecplot.convert(command, ["silent"])
    with pytest.raises(tecplot.ReaderError, match="more than"):
        tecplot.convert([sys.executable, "-c", "import time; time.sleep(60)"], ["x"], seconds=0.5)
    with pytest.raises(FileNotFoundError):
        tecplot.resolve_reader("no-such-program")
    text = 'TITLE = "a"\nVARIABLES = "X", "Y", "cp"\nZONE T="ls", I=2, F=POINT\n0 0 1.5\n1 0 2.5\nZONE T="te", I=1, F=POINT\n0 1 3.5\n'
    for t in ("0.1", "0.2"):
        (tmp_path / f"wing_i=1_t={t}.plt").write_text(text)
    s = tecplot.TecplotSource(spark, str(tmp_path), "wing_")
    assert s.zone_names == ["ls", "te"] and s.field_names == {"0.1": ["cp"]} and s.load_snapshot("cp", ["0.1", "0.2"]).count() == 6
    assert [r["value"] for r in s.snapshots(["cp"], ["0.1"], "te").collect()] == [3.5] and s.vertices.count() == 3 and s.weights.agg(F.sum("w")).first()[0] == 3.0
    e = tecplot.TecplotSource(spark, str(tmp_path), "wing_", reader=command)
    assert e.zone_names == ["a", "b"] and e.snapshots(["cp"], ["0.1"], "a").count() == 3
    with pytest.raises(FileNotFoundError):
        tecplot.TecplotSource(spark, str(tmp_path), "none_")


def test_tecplot_worker(tmp_path):
    import json

    from tidewright.sources import tecplot_worker as w

    class Leaf:
        def __init__(self, n):
            self.n = n

        def GetNumberOfPoints(self):
            return self.n

    class Tree:
        def __init__(self, *parts):
            self.parts = parts

        def GetNumberOfBlocks(self):
            return len(self.parts)

        def HasMetaData(self, i):
            return self.parts[i][0] is not None

        def GetMetaData(self, i):
            return type("Info", (), {"Get": lambda _, key: self.parts[i][0]})()

        def NAME(self):
            return "name"

        def GetBlock(self, i):
            return self.parts[i][1]

    nested = Tree(("file", Tree((" ls ", Leaf(2)), ("te", Leaf(1)), ("empty", Leaf(0)))), (None, None))
    assert [(n, b.n) for n, b in w.leaves(nested)] == [("ls", 2), ("te", 1)]
    block = type("Block", (), {"Points": np.arange(6.0).reshape(2, 3), "PointData": {"cp": np.array([1.0, 2.0])}})
    read = lambda path: {"ls": block}
    (tmp_path / "job.json").write_text(json.dumps([{"path": "f", "zone": None, "fields": ["y", "cp"]}, {"path": "g", "zone": "ls", "fields": []}]))
    w.convert(str(tmp_path), read)
    index = json.loads((tmp_path / "0.json").read_text())
    assert index["names"] == {"ls": ["X", "Y", "Z", "cp"]} and np.load(tmp_path / index["arrays"]["ls"]["y"]).tolist() == [1.0, 4.0]
    assert json.loads((tmp_path / "1.json").read_text())["arrays"] == {}
    (tmp_path / "job.json").write_text(json.dumps([{"path": "f", "zone": "no", "fields": []}]))
    with pytest.raises(KeyError):
        w.convert(str(tmp_path), read)


def test_sources_are_listed():
    assert "FoamSource" in dir(sources) and sources.FoamSource is foam.FoamSource
    with pytest.raises(AttributeError):
        sources.NoSuchSource
