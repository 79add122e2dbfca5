"""Points near other points, and regions, plots or cells that contain points.

Containment uses a trapezoidal decomposition: a region's boundary is cut at grid
cells that shrink until each holds few edges, and inside a cell at the x of the
vertices into slabs in which edges do not cross; a slab keeps its edges in
ascending order, and the parity of the boundary below the cell. Cells that no
edge enters are one slab without edges if they lie inside, and none otherwise.
So a region of V vertices makes about V slabs of bounded size in O(V log V)
steps, and these, not regions, are the rows that are distributed. A point looks
up its one cell on each level in use, keeps the slabs that span its x and finds
its place among a slab's edges by binary search: with the parity below, an odd
number of edges under the point means inside.

Neighbours of points come through the same slabs: the region of a point is the
right half of the square around its disc, which is a single slab, and the exact
distance is checked afterwards.

All joins are plain equi-joins on cell keys, so adaptive execution splits a hot
cell (a dense town, a stack of coincident points) over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions.wkb import POLYGON, parts, point_xy, simple_rings
from geoloom.session import cut_lineage

#: Side in metres of the cells of level 0, and the grid's origin, which no coordinate of a map is likely to hit.
BASE_CELL, ORIGIN = 32.0, 7.3190561
#: Distance in metres within which a point counts as on an edge; covers the rounding of stored coordinates.
EDGE_TOLERANCE = 1e-6
#: Edges of a cell beyond which it is divided, and the finest level.
MAX_EDGES, FINEST = 16, -12
#: Bytes of geometry that are decomposed at a time, if not one geometry is larger.
TOGETHER = 4 << 20

_SLAB = (
    "ref string, level int, cx long, cy long, x0 double, x1 double, ylo double, yhi double, below int, "
    "ax array<double>, ay array<double>, bx array<double>, by array<double>"
)


def distinct_points(df: DataFrame, id_col: str = "id", geometry: str = "geometry") -> DataFrame:
    """(id, x, y), once each, of rows with an id and a non-empty point."""
    xy = df.where(F.col(id_col).isNotNull() & F.col(geometry).isNotNull()).select(
        F.col(id_col).alias("id"), point_xy(F.col(geometry)).alias("p")
    )
    return xy.select("id", "p.x", "p.y").where("x is not null and y is not null").distinct()


def _edges(geometries: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges (x1, y1, x2, y2) of all polygon parts, the part of each edge in ascending order, and the geometry of each part."""
    edges, owner, part_of = [], [], []
    n = 0
    fast, rest = simple_rings(geometries)
    for at, rings in fast:  # rings: geometry, vertex, axis
        nxt = np.roll(rings, -1, axis=1)
        edges.append(np.concatenate([rings, nxt], axis=2).reshape(-1, 4))
        owner.append(np.repeat(np.arange(n, n + len(at)), rings.shape[1]))
        part_of.append(at)
        n += len(at)
    for k in rest:
        for base, rings in parts(geometries[int(k)].as_py()):
            if base == POLYGON:
                own = np.vstack([np.hstack([v, np.roll(v, -1, axis=0)]) for v in rings])
                edges.append(own)
                owner.append(np.full(len(own), n))
                part_of.append(np.array([k]))
                n += 1
    if not n:
        return np.empty((0, 4)), np.empty(0, int), np.empty(0, int)
    e, o = np.concatenate(edges), np.concatenate(owner)
    keep = (e[:, 0] != e[:, 2]) | (e[:, 1] != e[:, 3])
    return e[keep], o[keep], np.concatenate(part_of)


def _left(e: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether points lie to the left of their edges; the same point and edge always give the same answer."""
    return (e[:, 2] - e[:, 0]) * (y - e[:, 1]) - (e[:, 3] - e[:, 1]) * (x - e[:, 0]) > 0


def _spans(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and values of the ranges [first, first + count), one after the other."""
    row = np.repeat(np.arange(len(count)), count)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + first[row]


class _Nodes:
    """Grid cells of parts with the edges that enter them (pairs of ``node`` and ``edge``, by node) and the parity at their corner."""

    def __init__(self, edges, part, level, cx, cy, odd, node, edge, tolerance):
        self.edges, self.part, self.level, self.cx, self.cy, self.odd, self.tolerance = edges, part, level, cx, cy, odd, tolerance
        self.side = BASE_CELL * 2.0**level
        self.x, self.y = cx * self.side - ORIGIN - 2 * tolerance, cy * self.side - ORIGIN - 2 * tolerance
        self.x1, self.y1 = self.x + self.side + 4 * tolerance, self.y + self.side + 4 * tolerance
        e, x, y, x1, y1 = edges[edge], self.x[node], self.y[node], self.x1[node], self.y1[node]
        near = (np.minimum(e[:, 0], e[:, 2]) <= x1) & (np.maximum(e[:, 0], e[:, 2]) >= x)
        near &= (np.minimum(e[:, 1], e[:, 3]) <= y1) & (np.maximum(e[:, 1], e[:, 3]) >= y)
        corners = [_left(e, a, b) for a in (x, x1) for b in (y, y1)]
        near &= ~((corners[0] == corners[1]) & (corners[1] == corners[2]) & (corners[2] == corners[3]))
        self.node, self.edge = node[near], edge[near]
        self.count = np.bincount(self.node, minlength=len(part))

    def take(self, mask: np.ndarray) -> _Nodes:
        number = np.cumsum(mask) - 1
        kept = mask[self.node]
        return _Nodes(
            self.edges, self.part[mask], self.level[mask], self.cx[mask], self.cy[mask], self.odd[mask], number[self.node[kept]], self.edge[kept], self.tolerance
        )

    def children(self) -> _Nodes:
        """Quarters; the parity at a quarter's corner follows from the edges crossed on the way from the cell's own."""
        four = np.repeat(np.arange(len(self.part)), 4)
        i = np.tile(np.arange(4), len(self.part))
        cx, cy, level = 2 * self.cx[four] + i % 2, 2 * self.cy[four] + i // 2, self.level[four] - 1
        side = BASE_CELL * 2.0**level
        x, y = cx * side - ORIGIN - 2 * self.tolerance, cy * side - ORIGIN - 2 * self.tolerance
        node, edge = (4 * self.node[:, None] + np.arange(4)).ravel(), np.repeat(self.edge, 4)
        order = np.argsort(node, kind="stable")
        node, edge = node[order], edge[order]
        e, old = self.edges[edge], node // 4
        corner = _left(e, x[node], self.y[old])
        flips = ((e[:, 1] > self.y[old]) != (e[:, 3] > self.y[old])) & (_left(e, self.x[old], self.y[old]) != corner)
        flips ^= ((e[:, 0] > x[node]) != (e[:, 2] > x[node])) & (corner != _left(e, x[node], y[node]))
        odd = self.odd[four] ^ (np.bincount(node, flips, len(four)).astype(int) % 2 == 1)
        return _Nodes(self.edges, self.part[four], level, cx, cy, odd, node, edge, self.tolerance)


def _roots(edges: np.ndarray, owner: np.ndarray, tolerance: float) -> _Nodes:
    """At most four cells per part, of a side that matches its extent."""
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    part, number = owner[first], np.diff(np.append(first, len(owner)))
    low = [np.minimum.reduceat(np.minimum(edges[:, k], edges[:, k + 2]), first) - tolerance for k in (0, 1)]
    high = [np.maximum.reduceat(np.maximum(edges[:, k], edges[:, k + 2]), first) + tolerance for k in (0, 1)]
    extent = np.maximum(high[0] - low[0], high[1] - low[1])
    level = np.maximum(FINEST, np.ceil(np.log2(np.maximum(extent, tolerance) / BASE_CELL))).astype(int)
    side = BASE_CELL * 2.0**level
    c0, c1 = ([np.floor((v + ORIGIN) / side).astype(int) for v in box] for box in (low, high))
    nx, ny = c1[0] - c0[0] + 1, c1[1] - c0[1] + 1
    own, k = _spans(np.zeros(len(part), int), nx * ny)
    cx, cy = c0[0][own] + k % nx[own], c0[1][own] + k // nx[own]
    node, edge = _spans(first[own], number[own])
    e = edges[edge]
    x, y = (c[node] * side[own][node] - ORIGIN - 2 * tolerance for c in (cx, cy))
    right = _left(e, x, y) != (e[:, 3] > e[:, 1])
    odd = np.bincount(node, ((e[:, 1] > y) != (e[:, 3] > y)) & right, len(own)).astype(int) % 2 == 1
    return _Nodes(edges, part[own], level[own], cx, cy, odd, node, edge, tolerance)


def _slabs(leaf: _Nodes) -> tuple[np.ndarray, ...]:
    """(node, x0, x1, ylo, yhi, below) of the slabs of leaf cells, the number of edges of each, and these edges in ascending order."""
    e, m = leaf.edges[leaf.edge], len(leaf.part)
    lo = np.clip(np.minimum(e[:, 0], e[:, 2]), leaf.x[leaf.node], leaf.x1[leaf.node])
    hi = np.clip(np.maximum(e[:, 0], e[:, 2]), leaf.x[leaf.node], leaf.x1[leaf.node])
    owner, x = np.concatenate([leaf.node, leaf.node, np.arange(m), np.arange(m)]), np.concatenate([lo, hi, leaf.x, leaf.x1])
    order = np.lexsort((x, owner))
    new = np.append(True, (np.diff(x[order]) != 0) | (np.diff(owner[order]) != 0))
    rank = np.empty(len(x), int)
    rank[order] = np.cumsum(new) - 1
    xs, at = x[order][new], owner[order][new]
    real = np.flatnonzero(at[:-1] == at[1:])  # a cut that opens a slab
    number = np.full(len(xs), -1)
    number[real] = np.arange(len(real))
    node, x0, x1 = at[real], xs[real], xs[real + 1]

    k = len(lo)
    row, cut = _spans(rank[:k], rank[k : 2 * k] - rank[:k])
    slab, edge = number[cut], leaf.edge[row]

    # Parity below the cell: that of its corner, changed by edges crossed along its lower side, without the slab's own edges down there.
    mid = (x0 + x1) / 2
    low = np.flatnonzero((e[:, 1] > leaf.y[leaf.node]) != (e[:, 3] > leaf.y[leaf.node]))
    begin = np.searchsorted(node, np.arange(m))
    i, s = _spans(begin[leaf.node[low]], np.bincount(node, minlength=m)[leaf.node[low]])
    e_low, n_low = e[low][i], leaf.node[low][i]
    passed = _left(e_low, leaf.x[n_low], leaf.y[n_low]) != _left(e_low, mid[s], leaf.y[n_low])
    own = leaf.edges[edge]
    beneath = _left(own, mid[slab], leaf.y[node[slab]]) == (own[:, 2] > own[:, 0])
    below = (leaf.odd[node] + np.bincount(s, passed, len(real)) + np.bincount(slab, beneath, len(real))).astype(int) % 2

    done: list[tuple] = []
    while True:
        own = leaf.edges[edge]
        slope = (own[:, 3] - own[:, 1]) / (own[:, 2] - own[:, 0])
        height = lambda v: own[:, 1] + slope * (v[slab] - own[:, 0])
        order = np.lexsort((slope, height((x0 + x1) / 2), slab))
        slab, edge, y0, y1 = slab[order], edge[order], height(x0)[order], height(x1)[order]
        count = np.bincount(slab, minlength=len(x0))
        # Neighbours that change places cross, which only happens in a region that crosses itself.
        d0, d1 = np.diff(y0), np.diff(y1)
        swap = np.flatnonzero((np.diff(slab) == 0) & (np.minimum(d0, d1) < -EDGE_TOLERANCE) & (np.maximum(d0, d1) > EDGE_TOLERANCE))
        where = slab[swap]
        x = x0[where] + (x1[where] - x0[where]) * d0[swap] / (d0[swap] - d1[swap])
        fit = (x > x0[where] + EDGE_TOLERANCE) & (x < x1[where] - EDGE_TOLERANCE)
        where, once = np.unique(where[fit], return_index=True)
        again = np.zeros(len(x0), bool)
        again[where] = True
        ylo, yhi = leaf.y[node].copy(), leaf.y1[node].copy()
        closed = (count > 0) & (count % 2 == 0) & (below == 0)
        begin = (np.cumsum(count) - count)[count > 0]
        if len(begin):
            least = np.minimum.reduceat(np.minimum(y0, y1), begin)
            most = np.maximum.reduceat(np.maximum(y0, y1), begin)
            ylo[count > 0] = np.where(closed[count > 0], least, ylo[count > 0])
            yhi[count > 0] = np.where(closed[count > 0], most, yhi[count > 0])
        keep = ~again & ((count > 0) | (below == 1))
        done.append((node[keep], x0[keep], x1[keep], ylo[keep], yhi[keep], below[keep], count[keep], edge[keep[slab]]))
        if not len(where):
            return tuple(np.concatenate(c) for c in zip(*done))
        cut_at = x[fit][once]
        row, old = _spans(np.cumsum(count)[where] - count[where], count[where])
        edge = np.concatenate([edge[old], edge[old]])
        slab = np.concatenate([row, row + len(where)])
        node, below = np.tile(node[where], 2), np.tile(below[where], 2)
        x0, x1 = np.concatenate([x0[where], cut_at]), np.concatenate([cut_at, x1[where]])


def _batches_of(refs: pa.Array, geometries: pa.BinaryArray, tolerance: float) -> Iterator[pa.RecordBatch]:
    edges, owner, part_of = _edges(geometries)
    if not len(edges):
        return
    order = np.argsort(owner, kind="stable")
    nodes = _roots(edges[order], owner[order], tolerance)
    while len(nodes.part):
        split = (nodes.count > MAX_EDGES) & (nodes.level > FINEST)
        leaf = nodes.take(~split & ((nodes.count > 0) | nodes.odd))
        if len(leaf.part):
            node, x0, x1, ylo, yhi, below, count, edge = _slabs(leaf)
            offsets = pa.array(np.append(0, np.cumsum(count)).astype(np.int32))
            e = leaf.edges[edge]
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(e[:, k]))) for k in range(4)]
            columns = [refs.take(pa.array(part_of[leaf.part[node]])), pa.array(leaf.level[node].astype(np.int32)), pa.array(leaf.cx[node]), pa.array(leaf.cy[node])]
            columns += [*map(pa.array, (x0, x1, ylo, yhi, below.astype(np.int32))), *lists]
            yield pa.RecordBatch.from_arrays(columns, [c.split(" ")[0] for c in _SLAB.split(", ")])
        nodes = nodes.take(split).children()


def _decompose(tolerance: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum(pc.binary_length(batch["geometry"]).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < len(batch):
                to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + TOGETHER, "right")))
                own = batch.slice(at, to - at)
                yield from _batches_of(own["ref"], own["geometry"], tolerance)
                at = to

    return run


def decompose(polygons: DataFrame, *, tolerance: float = EDGE_TOLERANCE) -> DataFrame:
    """Slabs of (ref, geometry): a row per slab of each grid cell of each polygon part, edges as four arrays in ascending order."""
    return polygons.select("ref", "geometry").where("ref is not null and geometry is not null").mapInArrow(_decompose(tolerance), _SLAB)


def _inside(px: Column, py: Column, tolerance: float) -> Column:
    """Binary search of a point among the ordered edges of its slab."""

    def rise(i: Column) -> Column:
        """Twice the signed area under the edge-to-point triangle, as a distance along the edge's normal."""
        ax, ay, bx, by = (F.get(c, i) for c in ("ax", "ay", "bx", "by"))
        up = ((bx - ax) * (py - ay) - (by - ay) * (px - ax)) / F.hypot(bx - ax, by - ay)
        return F.when(bx < ax, -up).otherwise(up)

    n = F.size("ax")

    def step(s: Column, _: Column) -> Column:
        mid = ((s["lo"] + s["hi"]) / 2).cast("int")
        go = rise(mid) > tolerance
        searching = s["lo"] < s["hi"]
        return F.struct(
            F.when(searching & go, mid + 1).otherwise(s["lo"]).alias("lo"),
            F.when(searching & ~go, mid).otherwise(s["hi"]).alias("hi"),
        )

    steps = F.sequence(F.lit(1), F.ceil(F.log2(n + 1)).cast("int"))
    start = F.struct(F.lit(0).alias("lo"), n.alias("hi"))
    found = F.aggregate(
        steps, start, step, lambda s: ((s["lo"] + F.col("below")) % 2 == 1) | F.coalesce(F.abs(rise(s["lo"])) <= tolerance, F.lit(False))
    )
    # Most slabs have two edges, between which a search is two comparisons.
    first, second = rise(F.lit(0)), rise(F.lit(1))
    odd = F.col("below") == 1
    pair = F.when(first <= tolerance, odd | (first >= -tolerance)).when(second <= tolerance, ~odd | (second >= -tolerance)).otherwise(odd)
    return F.when(n == 0, odd).when(n == 2, pair).otherwise(found)


def _cell(v: Column, side: Column | float) -> Column:
    return F.floor((v + ORIGIN) / side)


def _located(points: DataFrame, slabs: DataFrame, levels: list[int], tolerance: float) -> DataFrame:
    """Points (id, x, y) with every slab that contains them."""
    side = F.lit(BASE_CELL) * F.pow(F.lit(2.0), F.col("level"))
    probes = points.select("id", "x", "y", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")).alias("level"))
    probes = probes.withColumns({"cx": _cell(F.col("x"), side), "cy": _cell(F.col("y"), side)})
    near = (
        probes.join(slabs, ["level", "cx", "cy"])
        .where((F.col("x") >= F.col("x0") - tolerance) & (F.col("x") <= F.col("x1") + tolerance))
        .where((F.col("y") >= F.col("ylo") - tolerance) & (F.col("y") <= F.col("yhi") + tolerance))
    )
    return near.where(_inside(F.col("x"), F.col("y"), tolerance))


def containing(points: DataFrame, polygons: DataFrame, *, tolerance: float = EDGE_TOLERANCE) -> DataFrame:
    """Distinct (id, ref) of every polygon ``ref`` that contains the point ``id``.

    ``points`` has id, x, y; ``polygons`` has ref (string) and geometry (WKB).
    Outer boundaries (within ``tolerance``) count, holes do not, and a geometry
    of several parts contains what one of its parts contains. Null refs, null or
    empty geometries and geometries that are not areas contain nothing. Repeated
    rows count once. Overlapping polygons are all reported.
    """
    slabs = cut_lineage(decompose(polygons, tolerance=tolerance))
    levels = [r[0] for r in slabs.select("level").distinct().collect()]  # at most some forty
    return _located(points, slabs, levels, tolerance).select("id", "ref").distinct()


def pairs_within(points: DataFrame, distance: float, *, tolerance: float = EDGE_TOLERANCE) -> DataFrame:
    """Distinct (id, other), id < other, of points at most ``distance`` apart.

    Each point's region is the right half of the square around its disc: one
    slab, in at most four cells, in which other points are located like in any
    region; the exact distance decides. Of two points only the left one's region
    is looked at (the lower one's, the smaller id's if they share x, or both).
    Coincident points are pairs. ``tolerance`` absorbs the rounding of stored
    coordinates.
    """
    reach = distance + tolerance
    level = max(FINEST, int(np.ceil(np.log2(2 * reach / BASE_CELL))))
    side = BASE_CELL * 2.0**level
    x, y = F.col("x"), F.col("y")
    slabs = points.select(
        F.col("id").alias("other"), x.alias("ox"), y.alias("oy"), F.lit(level).alias("level"), x.alias("x0"), (x + reach).alias("x1"),
        (y - reach).alias("ylo"), (y + reach).alias("yhi"), F.lit(0).alias("below"), F.array(x, x).alias("ax"), F.array(y - reach, y + reach).alias("ay"),
        F.array(x + reach, x + reach).alias("bx"), F.array(y - reach, y + reach).alias("by"),
    )
    for c, lo, hi in (("cx", "x0", "x1"), ("cy", "ylo", "yhi")):
        slabs = slabs.withColumn(c, F.explode(F.sequence(_cell(F.col(lo) - tolerance, side), _cell(F.col(hi) + tolerance, side))))
    dx, dy = F.col("x") - F.col("ox"), F.col("y") - F.col("oy")
    ahead = (dx > 0) | ((dx == 0) & ((dy > 0) | ((dy == 0) & (F.col("other") < F.col("id")))))
    met = _located(points, slabs, [level], tolerance).where(ahead & (F.col("id") != F.col("other")) & (dx * dx + dy * dy <= reach * reach))
    return met.select(F.least("id", "other").alias("id"), F.greatest("id", "other").alias("other")).distinct()
