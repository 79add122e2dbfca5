"""Areas that polygons share with buffers, summed tile by tile in Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.functions.kernels import APOTHEM, SIDES, STEP
from geoloom.operators.spatial import CELL, level_of, side_of
from geoloom.session import spread

#: Places and edges of a tile beyond which these are dealt out to several groups.
PLACES, EDGES = 16_384, 131_072
#: Pairs of places and shapes, and edges of such pairs, that are worked on at once.
PAIRS_AT_ONCE, EDGES_AT_ONCE = 1 << 18, 1 << 16

_NX, _NY = (f((np.arange(SIDES) + 0.5) * STEP) for f in (np.cos, np.sin))
_HALF = math.tan(STEP / 2)


def _side(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Side of the buffer that is seen from its centre in a direction, and where along it, from -_HALF to _HALF."""
    k = np.floor(np.arctan2(y, x) / STEP).astype(int)
    nx, ny = _NX[k % SIDES], _NY[k % SIDES]
    return k, (nx * y - ny * x) / (nx * x + ny * y)


def _sector(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Signed area of the buffer of inner radius 1 between two directions less than half a turn apart."""
    area = ((b[0] - a[0] + SIDES // 2) % SIDES - SIDES // 2) * _HALF + (b[1] - a[1]) / 2
    return area - SIDES * _HALF * np.round(area / (SIDES * _HALF))


def edge_areas(x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray, r: float) -> np.ndarray:
    """Signed area of the buffer around the origin that lies between the origin and each edge; summed over rings, the overlap."""
    d = r * APOTHEM
    c = x1 * y2 - x2 * y1
    out = c / 2
    at = np.flatnonzero((x1 * x1 + y1 * y1 > d * d) | (x2 * x2 + y2 * y2 > d * d))
    if not len(at):
        return out
    x1, y1, x2, y2, c = (v[at] for v in (x1, y1, x2, y2, c))
    dx, dy = x2 - x1, y2 - y1
    with np.errstate(divide="ignore", invalid="ignore"):
        length2 = dx * dx + dy * dy
        t = np.where(length2 > 0, np.clip(-(x1 * dx + y1 * dy) / length2, 0, 1), 0.0)
        near = np.flatnonzero(np.hypot(x1 + t * dx, y1 + t * dy) <= r)
        t0, t1 = np.ones(len(at)), np.zeros(len(at))
        if len(near):
            enter, leave = np.zeros(len(near)), np.ones(len(near))
            px, py, qx, qy = x1[near], y1[near], dx[near], dy[near]
            for nx, ny in zip(_NX[: SIDES // 2], _NY[: SIDES // 2]):  # opposite sides bound the same strip
                a, b = nx * px + ny * py, nx * qx + ny * qy
                mid, half = -a / b, d / np.abs(b)
                level = b == 0
                if level.any():
                    mid[level], half[level] = np.where(np.abs(a[level]) > d, 2.0, 0.0), np.where(np.abs(a[level]) > d, 0.0, np.inf)
                np.maximum(enter, mid - half, out=enter)
                np.minimum(leave, mid + half, out=leave)
            t0[near], t1[near] = enter, leave
        hit = t1 > t0
        whole = ~hit
        first, last = _side(x1, y1), _side(x2, y2)
        t = np.where(hit, t0, 1.0)
        before = _sector(first, _side(x1 + t * dx, y1 + t * dy))
        area = np.where(whole | (t0 > 0), before, 0.0)
        left = np.flatnonzero(hit & (t1 < 1))
        area[left] += _sector(_side(x1[left] + t1[left] * dx[left], y1[left] + t1[left] * dy[left]), (last[0][left], last[1][left]))
    out[at] = np.where(hit, c * (t1 - t0) / 2, 0.0) + area * (d * d)
    return out


def _rows_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the list and place in it of every entry of lists laid end to end."""
    of = np.repeat(np.arange(len(counts)), counts)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)


def _runs(counts: np.ndarray, most: int, rows: int) -> Iterator[tuple[int, int]]:
    """Runs of lists that hold ``most`` entries, or are ``rows`` lists; one at least."""
    total, i = np.cumsum(counts), 0
    while i < len(counts):
        j = max(i + 1, min(i + rows, int(np.searchsorted(total, (total[i - 1] if i else 0) + most, "right"))))
        yield i, j
        i = j


class _Tiles:
    """Places and shapes of whole groups."""

    def __init__(self, table: pa.Table, keys: np.ndarray):
        group = np.r_[0, np.cumsum((keys[1:] != keys[:-1]).any(axis=1))]
        column = lambda name: table[name].combine_chunks()
        numbers = lambda a: a.to_numpy(zero_copy_only=False)
        is_shape = numbers(column("edges").is_valid())
        self.group = group[~is_shape]
        self.x, self.y = (numbers(column(c))[~is_shape] for c in "xy")
        shapes = table.filter(pa.array(is_shape)).combine_chunks()
        edges, codes = (shapes[c].combine_chunks() for c in ("edges", "codes"))
        self.n_edges, self.n_codes = (numbers(v.value_lengths()) for v in (edges, codes))
        self.first_edge, self.first_code = (np.cumsum(n) - n for n in (self.n_edges, self.n_codes))
        self.edges = [numbers(edges.flatten().field(c)) for c in ("x1", "y1", "x2", "y2")]
        self.code, self.times = (numbers(codes.flatten().field(c)) for c in ("code", "times"))
        self.box = [numbers(shapes[c].combine_chunks()) for c in ("xmin", "ymin", "xmax", "ymax")]
        self.n_shapes = np.bincount(group[is_shape], minlength=group[-1] + 1)
        self.first_shape = np.cumsum(self.n_shapes) - self.n_shapes

    def _overlaps(self, place: np.ndarray, shape: np.ndarray, r: float) -> np.ndarray:
        """Overlap of the buffer around a place and a shape, pair by pair; those of size infinity are the shapes themselves."""
        out = np.empty(len(place))
        for i, j in _runs(self.n_edges[shape], EDGES_AT_ONCE, len(place)):
            own = shape[i:j]
            of, k = _rows_of(self.n_edges[own])
            at, x, y = self.first_edge[own][of] + k, self.x[place[i:j]][of], self.y[place[i:j]][of]
            ends = [e[at] - o for e, o in zip(self.edges, (x, y, x, y))]
            areas = edge_areas(*ends, r) if math.isfinite(r) else (ends[0] * ends[3] - ends[2] * ends[1]) / 2
            out[i:j] = np.bincount(of, areas, minlength=j - i)
        return np.maximum(out, 0.0)

    def sums(self, sizes: Sequence[float], codes: int) -> Iterator[tuple[np.ndarray, ...]]:
        """(x, y, k, a): area by place and by code and size, which are numbered together."""
        counts = self.n_shapes[self.group]
        if not counts.sum():
            return
        for i, j in _runs(counts, PAIRS_AT_ONCE, max(1, PAIRS_AT_ONCE // (codes * len(sizes)))):
            place, k = _rows_of(counts[i:j])
            place += i
            shape = self.first_shape[self.group[place]] + k
            low, high = ([self.box[b + n][shape] - v[place] for b, v in enumerate((self.x, self.y))] for n in (0, 2))
            near = sum(np.maximum(0, np.maximum(a, -b)) ** 2 for a, b in zip(low, high))
            far = sum(np.maximum(-a, b) ** 2 for a, b in zip(low, high))
            found = np.zeros((j - i) * codes * len(sizes))
            for s, r in enumerate(sizes):
                for met, size in ((far < (r * APOTHEM) ** 2, math.inf), ((far >= (r * APOTHEM) ** 2) & (near <= r * r), r)):
                    pairs = np.flatnonzero(met) if r > 0 else []
                    if not len(pairs):
                        continue
                    own, at = shape[pairs], place[pairs]
                    overlap = self._overlaps(at, own, size)
                    of, k = _rows_of(self.n_codes[own])
                    listed = self.first_code[own][of] + k
                    key = ((at[of] - i) * codes + self.code[listed]) * len(sizes) + s
                    found += np.bincount(key, overlap[of] * self.times[listed], minlength=len(found))
            some = np.flatnonzero(found)
            at = i + some // (codes * len(sizes))
            yield self.x[at], self.y[at], some % (codes * len(sizes)), found[some]


_KEYS = ["cx", "cy", "level", "__p", "__e"]


def _summed(sizes: Sequence[float], codes: int):
    def done(held: list[tuple[pa.RecordBatch, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if held:
            tiles = _Tiles(pa.Table.from_batches([b for b, _ in held]), np.concatenate([k for _, k in held]))
            for x, y, k, a in tiles.sums(sizes, codes):
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(k, pa.int32()), pa.array(a)], ["x", "y", "k", "a"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.RecordBatch, np.ndarray]] = []  # batches whose last group may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.column_stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in _KEYS])
            others = np.flatnonzero((keys != keys[-1]).any(axis=1))
            cut = others[-1] + 1 if len(others) else 0
            if cut:
                yield from done([*held, (batch.slice(0, cut), keys[:cut])])
                held = []
            elif held and (held[-1][1][-1] != keys[-1]).any():
                yield from done(held)
                held = []
            held.append((batch.slice(cut), keys[cut:]))
        yield from done(held)

    return run


def _dealt(places: DataFrame, shapes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with numbers of groups (__p, __e), so that none holds far more than ``PLACES`` and ``EDGES``."""
    tile = _KEYS[:3]
    crowded: dict[tuple, list[int]] = {}  # as many as all places and edges by these numbers, at most
    for n, (side, weight, most) in enumerate(((places, F.count("*"), PLACES), (shapes, F.sum(F.size("edges")), EDGES))):
        for r in side.groupBy(*tile).agg(weight.alias("n")).where(F.col("n") > most).collect():
            crowded.setdefault(tuple(r[:3]), [1, 1])[n] = math.ceil(r[3] / most)
    if not crowded:
        return tuple(s.withColumns({c: F.lit(0) for c in _KEYS[3:]}) for s in (places, shapes))
    table = F.broadcast(places.sparkSession.createDataFrame([(*k, *v) for k, v in crowded.items()], "cx long, cy long, level int, __np int, __ne int"))
    either = lambda n: F.coalesce(F.col(n), F.lit(1))
    every = lambda n: F.explode(F.sequence(F.lit(0), either(n) - 1))
    one = lambda key, n: F.pmod(key, either(n)).cast("int")
    places, shapes = (s.join(table, tile, "left") for s in (places, shapes))
    places = places.withColumn("__p", one(F.xxhash64("x", "y"), "__np")).withColumn("__e", every("__ne"))
    shapes = shapes.withColumn("__e", one(F.xxhash64("edges"), "__ne")).withColumn("__p", every("__np"))
    return places.drop("__np", "__ne"), shapes.drop("__np", "__ne")


def overlay(places: DataFrame, shapes: DataFrame, sizes: Sequence[float], codes: int) -> DataFrame:
    """(x, y, k, a): area that shapes of code k / n cover of buffers of size k % n, of n sizes, around places.

    ``places`` (x, y) should be distinct and finite. ``shapes`` has edges, the box
    of these, and ``codes`` (code, times): what it is listed as, by numbers below
    ``codes``, and how often. Places and shapes meet in tiles as wide as the largest
    buffer or, for wide shapes, as those; a place lies in one tile of each such
    level, and a shape in the few that it may reach. A shape in a buffer counts by
    its area; edges are looked at only if it may cross the rim. Tiles that hold
    much are dealt out to several groups.
    """
    reach = max(sizes)
    base = max(0, math.ceil(math.log2(2 * reach / CELL))) if reach > 0 else 0
    width = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"))
    shapes = shapes.select("edges", "codes", "xmin", "ymin", "xmax", "ymax").withColumn("level", F.greatest(F.lit(base), level_of(width)))
    levels = sorted(r[0] for r in shapes.select("level").distinct().collect())  # some thirty at most
    side = side_of(F.col("level"))
    places = places.select("x", "y").withColumn("level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    places = places.withColumns({f"c{a}": F.floor(F.col(a) / side) for a in "xy"})
    at = lambda c: F.floor(c / side)
    for a in "xy":
        shapes = shapes.withColumn(f"c{a}", F.explode(F.sequence(at(F.col(f"{a}min") - reach), at(F.col(f"{a}max") + reach))))
    places, shapes = _dealt(places, shapes)
    both = spread(places.unionByName(shapes, allowMissingColumns=True), *_KEYS).sortWithinPartitions(*_KEYS)
    return both.mapInArrow(_summed([float(s) for s in sizes], codes), "x double, y double, k int, a double")
