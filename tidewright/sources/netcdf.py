"""Classic NetCDF files (versions 1, 2 and 5) without further packages."""

from __future__ import annotations

import numpy as np

#: The format's number types and list tags.
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
DIMENSION, VARIABLE, ATTRIBUTE = 10, 11, 12


class NetCdf:
    """Dimensions, attributes and variables of a file's bytes; a variable is read when asked for."""

    def __init__(self, data: bytes):
        if data[:3] != b"CDF" or data[3] not in (1, 2, 5):
            raise ValueError("not a classic NetCDF file")
        self.data, self.version, self.at = data, data[3], 4
        self.wide = ">i8" if self.version == 5 else ">i4"
        self.records = self._number(self.wide)
        self.dimensions = [(self._name(), self._number(self.wide)) for _ in range(self._list(DIMENSION))]
        self.attributes = self._attributes()
        self.variables = {}
        for _ in range(self._list(VARIABLE)):
            name = self._name()
            dims = [self._number(self.wide) for _ in range(self._number(self.wide))]
            attributes = self._attributes()
            kind = self._number(">i4")
            size = self._number(self.wide)
            begin = self._number(">i4" if self.version == 1 else ">i8")
            self.variables[name] = (dims, attributes, TYPES[kind], size, begin)

    def _number(self, kind: str) -> int:
        v = np.frombuffer(self.data, kind, 1, self.at)[0]
        self.at += np.dtype(kind).itemsize
        return int(v)

    def _name(self) -> str:
        n = self._number(self.wide)
        s = self.data[self.at : self.at + n].decode()
        self.at += -(-n // 4) * 4
        return s

    def _list(self, tag: int) -> int:
        found, n = self._number(">i4"), self._number(self.wide)
        if n and found != tag:
            raise ValueError("damaged NetCDF header")
        return n

    def _attributes(self) -> dict:
        out = {}
        for _ in range(self._list(ATTRIBUTE)):
            name = self._name()
            kind = TYPES[self._number(">i4")]
            n = self._number(self.wide)
            size = n * np.dtype(kind).itemsize
            raw = self.data[self.at : self.at + size]
            out[name] = raw.decode() if kind == "S1" else np.frombuffer(raw, kind)
            self.at += -(-size // 4) * 4
        return out

    def shape(self, name: str) -> tuple[int, ...]:
        return tuple(self.records if self._unlimited(d) else self.dimensions[d][1] for d in self.variables[name][0])

    def _unlimited(self, d: int) -> bool:
        return self.dimensions[d][1] == 0

    def __getitem__(self, name: str) -> np.ndarray:
        dims, _, kind, size, begin = self.variables[name]
        shape, item = self.shape(name), np.dtype(kind)
        if not dims or not self._unlimited(dims[0]):
            return np.frombuffer(self.data, item, int(np.prod(shape)), begin).reshape(shape).astype(item.newbyteorder("="))
        step = sum(v[3] for v in self.variables.values() if v[0] and self._unlimited(v[0][0]))
        n = int(np.prod(shape[1:]))
        rows = [np.frombuffer(self.data, item, n, begin + r * step) for r in range(self.records)]
        return np.array(rows).reshape(shape).astype(item.newbyteorder("="))


def write_classic(dimensions: dict[str, int], variables: dict[str, tuple[list[str], np.ndarray]]) -> bytes:
    """The bytes of a version-1 file without record variables (for tests and exports)."""
    codes = {"i1": 1, "i2": 3, "i4": 4, "f4": 5, "f8": 6}
    i4 = lambda v: np.array(v, ">i4").tobytes()
    name = lambda s: i4(len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    order = list(dimensions)

    def header(begin: dict[str, int]) -> bytes:
        out = b"CDF\x01" + i4(0) + i4(DIMENSION) + i4(len(order)) + b"".join(name(d) + i4(dimensions[d]) for d in order) + i4(0) + i4(0)
        out += i4(VARIABLE) + i4(len(variables))
        for v, (dims, x) in variables.items():
            out += name(v) + i4(len(dims)) + b"".join(i4(order.index(d)) for d in dims) + i4(0) + i4(0) + i4(codes[x.dtype.str[1:]]) + i4(-(-x.nbytes // 4) * 4) + i4(begin[v])
        return out

    at, begin, body = len(header(dict.fromkeys(variables, 0))), {}, b""
    for v, (_, x) in variables.items():
        begin[v] = at + len(body)
        raw = x.astype(x.dtype.newbyteorder(">")).tobytes()
        body += raw + b"\0" * (-len(raw) % 4)
    return header(begin) + body
