"""Files of the formats that the sources read, as bytes, and their writing by the executors.

``write_files`` takes one row per file; a task that runs twice writes the same bytes again and renames.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tidewright.session import folder_for
from tidewright.sources.foam import COMPONENTS
from tidewright.sources.vtk import pack

#: What the lists of the field classes are called in files.
LISTS = {1: "scalar", 3: "vector", 6: "symmTensor", 9: "tensor"}


def write_files(rows: DataFrame, folder: str, files: Callable[[pd.Series], dict[str, bytes]]) -> int:
    """Write the files (name below ``folder`` -> bytes) that ``files`` makes of each row; returns their number."""
    base = folder_for(folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = 0
            for r in b.itertuples(index=False):
                for name, data in files(r).items():
                    path = base / name
                    path.parent.mkdir(parents=True, exist_ok=True)
                    part = path.with_name(path.name + ".part")
                    part.write_bytes(data)
                    part.replace(path)
                    n += 1
            yield pd.DataFrame({"n": [n]})

    return sum(r["n"] for r in rows.mapInPandas(run, "n bigint").collect())


def foam_header(kind: str, name: str, binary: bool = False, note: str = "") -> bytes:
    more = f'    note        "{note}";\n' if note else ""
    return f"FoamFile\n{{\n    version     2.0;\n    format      {'binary' if binary else 'ascii'};\n    class       {kind};\n{more}    object      {name};\n}}\n".encode()


def foam_list(values: np.ndarray, binary: bool = False, kind: str = "<f8") -> bytes:
    """A list of numbers, or of rows of numbers."""
    a = np.asarray(values)
    if binary:
        return f"{len(a)}\n(".encode() + a.astype(kind).tobytes() + b")\n"
    lines = [repr(v) if a.ndim == 1 else f"({' '.join(map(repr, v))})" for v in a.tolist()]
    return "\n".join([str(len(a)), "(", *lines, ")", ""]).encode()


def foam_field(name: str, values: np.ndarray, binary: bool = False) -> bytes:
    """An internal field; a single value (or row of components) is written as uniform."""
    a = np.asarray(values, np.float64)
    uniform = a.ndim == 0
    width = 1 if a.ndim < 2 else a.shape[1]
    kind = next(k for k, c in COMPONENTS.items() if c == width)
    if uniform:
        return foam_header(kind, name, binary) + f"\ninternalField   uniform {float(a)!r};\n".encode()
    return foam_header(kind, name, binary) + f"\ninternalField   nonuniform List<{LISTS[width]}> \n".encode() + foam_list(a, binary) + b";\n"


def foam_mesh(points: np.ndarray, faces: list[list[int]], owner: list[int], neighbour: list[int], binary: bool = False) -> dict[str, bytes]:
    """The files of constant/polyMesh; inner faces first, one neighbour for each of them."""
    note = f"nPoints:{len(points)}  nCells:{max(owner) + 1}  nFaces:{len(faces)}  nInternalFaces:{len(neighbour)}"
    if binary:
        cuts = np.concatenate([[0], np.cumsum([len(f) for f in faces])])
        listed = foam_header("faceCompactList", "faces", True) + foam_list(cuts, True, "<i4") + foam_list(np.concatenate(faces), True, "<i4")
    else:
        text = "\n".join(f"{len(f)}({' '.join(map(str, f))})" for f in faces)
        listed = foam_header("faceList", "faces") + f"\n{len(faces)}\n(\n{text}\n)\n".encode()
    base = "constant/polyMesh"
    return {
        f"{base}/points": foam_header("vectorField", "points", binary) + foam_list(points, binary),
        f"{base}/faces": listed,
        f"{base}/owner": foam_header("labelList", "owner", binary, note) + foam_list(np.array(owner), binary, "<i4"),
        f"{base}/neighbour": foam_header("labelList", "neighbour", binary, note) + foam_list(np.array(neighbour), binary, "<i4"),
        f"{base}/boundary": foam_header("polyBoundaryMesh", "boundary") + b"\n0\n(\n)\n",
    }


def _table(columns: dict[str, np.ndarray]) -> str:
    return "\n".join(" ".join(map(repr, r)) for r in zip(*(np.asarray(c, np.float64).tolist() for c in columns.values()), strict=True))


def davis(title: str, columns: dict[str, np.ndarray]) -> bytes:
    """Three header lines and a table."""
    names = ", ".join(f'"{n}"' for n in columns)
    n = len(next(iter(columns.values())))
    return f'TITLE = "{title}"\nVARIABLES = {names}\nZONE T="Frame 0", I={n}, J=1\n{_table(columns)}\n'.encode()


def surface(name: str, columns: dict[str, np.ndarray]) -> bytes:
    """A raw surface file: two comment lines and a table."""
    n = len(next(iter(columns.values())))
    return f"# {name}  FACE_DATA {n}\n#  {'  '.join(columns)}\n{_table(columns)}\n".encode()


def vtk_legacy(points: np.ndarray, fields: dict[str, np.ndarray], binary: bool = False) -> bytes:
    """Points and point data of an unstructured grid without cells."""

    def numbers(a: np.ndarray) -> bytes:
        a = np.asarray(a, np.float64)
        return a.astype(">f8").tobytes() + b"\n" if binary else ("\n".join(map(repr, a.ravel().tolist())) + "\n").encode()

    out = [f"# vtk DataFile Version 3.0\nsnapshot\n{'BINARY' if binary else 'ASCII'}\nDATASET UNSTRUCTURED_GRID\nPOINTS {len(points)} double\n".encode(), numbers(points), f"POINT_DATA {len(points)}\n".encode()]
    for name, a in fields.items():
        out += [(f"SCALARS {name} double 1\nLOOKUP_TABLE default\n" if np.ndim(a) == 1 else f"VECTORS {name} double\n").encode(), numbers(a)]
    return b"".join(out)


def vtu(points: np.ndarray, fields: dict[str, np.ndarray]) -> bytes:
    """The same as XML with inline base64."""

    def array(name: str, a: np.ndarray) -> str:
        a = np.asarray(a, np.float64)
        return f'<DataArray type="Float64" Name="{name}" NumberOfComponents="{1 if a.ndim == 1 else a.shape[1]}" format="binary">{pack(a)}</DataArray>'

    body = f'<Piece NumberOfPoints="{len(points)}" NumberOfCells="0"><PointData>{"".join(array(n, a) for n, a in fields.items())}</PointData><Points>{array("Points", points)}</Points></Piece>'
    return f'<?xml version="1.0"?><VTKFile type="UnstructuredGrid" version="0.1" byte_order="LittleEndian" header_type="UInt32"><UnstructuredGrid>{body}</UnstructuredGrid></VTKFile>'.encode()


def pgm(image: np.ndarray) -> bytes:
    """A binary grey image of 8 or 16 bits."""
    wide = image.dtype.itemsize == 2
    return f"P5\n{image.shape[1]} {image.shape[0]}\n{65535 if wide else 255}\n".encode() + image.astype(">u2" if wide else "u1").tobytes()


def tiff(image: np.ndarray) -> bytes:
    """An uncompressed grey image of 8 or 16 bits in one strip."""
    h, w = image.shape
    bits = 8 * image.dtype.itemsize
    tags = [(256, 4, w), (257, 4, h), (258, 3, bits), (259, 3, 1), (262, 3, 1), (273, 4, 8), (277, 3, 1), (278, 4, h), (279, 4, image.nbytes)]
    entries = b"".join(np.array([t, k], "<u2").tobytes() + np.array([1, v], "<u4").tobytes() for t, k, v in tags)
    body = image.astype(f"<u{image.dtype.itemsize}").tobytes()
    return b"II*\0" + np.array([8 + len(body)], "<u4").tobytes() + body + np.array([len(tags)], "<u2").tobytes() + entries + b"\0\0\0\0"


def tecplot(zones: dict[str, dict[str, np.ndarray]]) -> bytes:
    """Zones of points in ASCII."""
    names = ", ".join(f'"{n}"' for n in next(iter(zones.values())))
    parts = [f'ZONE T="{z}", I={len(next(iter(c.values())))}, F=POINT\n{_table(c)}\n' for z, c in zones.items()]
    return f'TITLE = "snapshot"\nVARIABLES = {names}\n{"".join(parts)}'.encode()
