"""Snapshot operators. The decompositions and models are imported on demand, by name."""

from importlib import import_module

_WHERE = {
    "Matrix": "linalg", "SVD": "linalg", "DMD": "dmd", "HODMD": "dmd", "MSSA": "dmd", "PMSSA": "dmd", "DFT": "spectral", "PDFT": "spectral", "AMPS": "spectral", "AMSPOD": "spectral", "PAMSPOD": "spectral",
    "OptDMD": "trained", "HOOptDMD": "trained", "LinearModel": "trained", "LinearControlModel": "trained", "SVDEncoder": "rom", "CNM": "rom", "PointWeights": "mesh", "Explorer": "explore",
}


def __getattr__(name: str):
    if name not in _WHERE:
        raise AttributeError(name)
    return getattr(import_module(f"tidewright.operators.{_WHERE[name]}"), name)


def __dir__() -> list[str]:
    return sorted(_WHERE)
