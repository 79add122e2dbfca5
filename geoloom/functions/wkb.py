"""Well-known binary decoding (ISO and extended dialects, either byte order).

Spark ships no accessor for geometry columns, so bytes are decoded in Arrow
batches, once, right after the scan; everything after that is plain columns.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT, LINE, POLYGON, MULTIPOINT, MULTILINE, MULTIPOLYGON, COLLECTION = range(1, 8)

# Flags of the extended dialect.
_HAS_Z, _HAS_M, _HAS_SRID = 0x80000000, 0x40000000, 0x20000000


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def head(self) -> tuple[str, int, int]:
        """Byte order, base type and number of ordinates of the geometry that starts here."""
        order = "<" if self.data[self.at] == 1 else ">"
        (code,) = struct.unpack_from(order + "I", self.data, self.at + 1)
        self.at += 5
        if code & _HAS_SRID:
            self.at += 4
        width = 2 + bool(code & _HAS_Z) + bool(code & _HAS_M)
        code &= 0x0FFFFFFF
        thousands, base = divmod(code, 1000)
        width = max(width, {0: 2, 1: 3, 2: 3, 3: 4}[thousands])
        return order, base, width

    def count(self, order: str) -> int:
        (n,) = struct.unpack_from(order + "I", self.data, self.at)
        self.at += 4
        return n

    def vertices(self, order: str, width: int, n: int) -> np.ndarray:
        out = np.frombuffer(self.data, order + "f8", n * width, self.at).reshape(n, width)[:, :2]
        self.at += 8 * n * width
        return out.astype("f8")


class _Places(_Reader):
    """Says where vertices are instead of reading them."""

    def vertices(self, order: str, width: int, n: int) -> tuple[int, int, str, int]:
        at, self.at = self.at, self.at + 8 * n * width
        return at, n, order, width


def _read(r: _Reader) -> Iterator[tuple[int, list[np.ndarray]]]:
    order, base, width = r.head()
    if base == POINT:
        yield POINT, [r.vertices(order, width, 1)]
    elif base == LINE:
        yield LINE, [r.vertices(order, width, r.count(order))]
    elif base == POLYGON:
        yield POLYGON, [r.vertices(order, width, r.count(order)) for _ in range(r.count(order))]
    elif base in (MULTIPOINT, MULTILINE, MULTIPOLYGON, COLLECTION):
        for _ in range(r.count(order)):
            yield from _read(r)
    else:
        raise ValueError(f"geometry type {base} is not supported")


def parts(data: bytes | None) -> list[tuple[int, list[np.ndarray]]]:
    """Simple parts of a geometry as (base type, rings); empty and null geometries have none.

    A point is one ring of one vertex, a line one ring, a polygon its shell
    followed by its holes. Empty points (NaN ordinates) and empty rings vanish.
    """
    if not data:
        return []
    out = []
    for base, rings in _read(_Reader(bytes(data))):
        rings = [ring for ring in rings if len(ring) and not np.isnan(ring).any()]
        if rings:
            out.append((base, rings))
    return out


def places(data: bytes) -> list[tuple[int, list[tuple[int, int, str, int]]]]:
    """Parts of a geometry as (base type, rings), each ring by its first byte, number of vertices, byte order and ordinates of a vertex."""
    return list(_read(_Places(bytes(data))))


def alike(geometries: Sequence[bytes | None]) -> Iterator[tuple[np.ndarray, list[tuple[int, list[np.ndarray]]]]]:
    """Geometries that differ by their ordinates only, decoded together: their rows, and parts as those of ``parts``, whose rings are (row, vertex, axis)."""
    size = np.array([len(g) if g is not None else 0 for g in geometries], int)
    for n in np.unique(size[size > 0]):
        rows = np.flatnonzero(size == n)
        raw = np.frombuffer(b"".join(bytes(geometries[i]) for i in rows), np.uint8).reshape(-1, n)
        while len(rows):
            shape, fixed = places(raw[0].tobytes()), np.ones(n, bool)
            for at, count, _, width in (ring for _, rings in shape for ring in rings):
                fixed[at : at + 8 * count * width] = False
            same = (raw[:, fixed] == raw[0, fixed]).all(axis=1)
            read = lambda at, count, order, width: np.ascontiguousarray(raw[same, at : at + 8 * count * width]).view(f"{order}f8").astype("f8").reshape(-1, count, width)[:, :, :2]  # noqa: B023, E731
            found = [(base, [read(*ring) for ring in rings if ring[1]]) for base, rings in shape]
            whole = ~np.any([np.isnan(v).any(axis=(1, 2)) for _, rings in found for v in rings] or [np.zeros(same.sum(), bool)], axis=0)
            if whole.any() and any(rings for _, rings in found):
                yield rows[same][whole], [(base, [v[whole] for v in rings]) for base, rings in found if rings]
            for i in rows[same][~whole]:  # empty points and rings vanish
                if own := parts(geometries[i]):
                    yield np.array([i]), [(base, [v[None] for v in rings]) for base, rings in own]
            rows, raw = rows[~same], raw[~same]


def simple_rings(column: pa.BinaryArray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Polygons of one ring, decoded together: (rows, vertices by row) per number of vertices, and the rows of all other geometries."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset).astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    size = np.diff(offsets)
    out, left = [], np.ones(len(column), bool)
    for n in np.unique(size[(size > 13) & (size % 16 == 13)]):
        rows = np.flatnonzero(size == n)
        raw = data[offsets[rows][:, None] + np.arange(n)]
        for order, text in ((1, "<"), (0, ">")):
            head = struct.pack(f"{text}BIII", order, POLYGON, 1, (n - 13) // 16)
            same = (raw[:, :13] == np.frombuffer(head, np.uint8)).all(axis=1)
            v = np.ascontiguousarray(raw[same, 13:]).view(f"{text}f8").astype("f8").reshape(-1, (n - 13) // 16, 2)
            whole = ~np.isnan(v).any(axis=(1, 2))
            if whole.any():
                found = rows[same][whole]
                out.append((found, v[whole]))
                left[found] = False
    return out, np.flatnonzero(left)


@F.pandas_udf(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))
def _point_xy(geometry: pd.Series) -> pd.DataFrame:
    xy = np.full((len(geometry), 2), np.nan)
    for i, data in enumerate(geometry):
        if data is None:
            continue
        if len(data) == 21 and data[1] + data[4] == 1:
            xy[i] = struct.unpack_from("<2d" if data[0] == 1 else ">2d", data, 5)
        elif found := parts(data):
            xy[i] = found[0][1][0][0]
    return pd.DataFrame({"x": xy[:, 0], "y": xy[:, 1]})


def point_xy(geometry: Column) -> Column:
    """struct(x, y) of a point, or of a geometry's first vertex; both null where it is null or empty."""
    return _point_xy(geometry)


@F.pandas_udf(T.BinaryType())
def point_wkb(x: pd.Series, y: pd.Series) -> pd.Series:
    """Points as well-known binary; null where a coordinate is null."""
    return pd.Series([None if pd.isna(a) or pd.isna(b) else encode_point(a, b) for a, b in zip(x, y)], dtype=object)


def encode_point(x: float, y: float) -> bytes:
    return struct.pack("<BI2d", 1, POINT, x, y)


def encode_line(vertices) -> bytes:
    v = np.asarray(vertices, "<f8")
    return struct.pack("<BII", 1, LINE, len(v)) + v.tobytes()


def encode_polygon(*rings) -> bytes:
    out = struct.pack("<BII", 1, POLYGON, len(rings))
    for ring in rings:
        v = np.asarray(ring, "<f8")
        out += struct.pack("<I", len(v)) + v.tobytes()
    return out
