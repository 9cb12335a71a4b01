"""Sources and sinks of snapshots. Readers are imported on demand, so that one needs no other's packages."""

from importlib import import_module

_WHERE = {
    "DavisSource": "csvs", "SurfaceSource": "csvs", "FoamSource": "foam", "FoamMesh": "foam", "VtkSource": "vtk", "Store": "store", "write_xdmf": "store", "foam_to_store": "store", "copy_mesh": "store",
    "ImageSource": "images", "TauConfig": "tau", "TauSource": "tau", "TauSurfaceSource": "tau", "PspSource": "zoned", "SCubeSource": "zoned", "TecplotSource": "tecplot", "register": "datasource",
}


def __getattr__(name: str):
    if name not in _WHERE:
        raise AttributeError(name)
    return getattr(import_module(f"tidewright.sources.{_WHERE[name]}"), name)


def __dir__() -> list[str]:
    return sorted(_WHERE)
