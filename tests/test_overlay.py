"""Areas shared with buffers, against an independent geometry library in Spark's own jars."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from geoloom import Calculator
from geoloom.functions import wkb
from geoloom.functions.kernels import APOTHEM, STEP
from geoloom.operators import overlay
from geoloom.operators.prepare import to_polygons
from geoloom.plans import variables


def star(rnd, cx, cy, r, n):
    turns = [(k + rnd.uniform(0, 0.9)) * 2 * math.pi / n for k in range(n)]
    ring = [(cx + f * math.cos(t), cy + f * math.sin(t)) for t in turns for f in [rnd.uniform(0.3, 1) * r]]
    return [*ring, ring[0]]


@pytest.fixture(scope="module")
def library(spark):
    jts = spark._jvm.org.locationtech.jts
    reader, factory = jts.io.WKBReader(), jts.geom.GeometryFactory()
    read = lambda *rings: reader.read(bytearray(wkb.encode_polygon(*rings)))
    return read, lambda x, y, r: factory.createPoint(jts.geom.Coordinate(x, y)).buffer(r)


def test_edge_areas(library):
    read, buffer = library
    rnd = random.Random(7)
    corner = lambda k, r: (r * math.cos(k * STEP), r * math.sin(k * STEP))
    rings = [star(rnd, rnd.uniform(-150, 150), rnd.uniform(-150, 150), rnd.uniform(5, 300), rnd.randint(3, 11)) for _ in range(150)]
    rings += [
        [(-10, -10), (10, 10), (10, -10), (-10, -10)],  # through the origin
        [(0, 0), (500, 0), (500, 500), (0, 0)],  # a corner at the origin
        [corner(k, 100) for k in (*range(32), 0)],  # the buffer itself
        [corner(k, 150) for k in (*range(32), 0)],  # around it
        [corner(k, 100) for k in (3, 4, 20, 3)],  # a side of it
        [(-900, 100 * APOTHEM), (900, 100 * APOTHEM), (0, 900), (-900, 100 * APOTHEM)],
    ]
    for ring in rings:
        polygon = read(ring)
        v = np.array(ring, float)
        if np.sum(v[:-1, 0] * v[1:, 1] - v[1:, 0] * v[:-1, 1]) < 0:
            v = v[::-1]
        got = overlay.edge_areas(*v[:-1].T, *v[1:].T, 100.0).sum()
        assert abs(got - polygon.intersection(buffer(0.0, 0.0, 100.0)).getArea()) < 1e-6


@pytest.mark.parametrize("places,edges,rows", [(16_384, 131_072, 10_000), (3, 8, 7)])
def test_landuse_against_library(spark, library, monkeypatch, places, edges, rows):
    """Small and wide shapes with holes and several codes; tiles that hold much in several groups, and groups in several batches."""
    read, buffer = library
    monkeypatch.setattr(overlay, "PLACES", places)
    monkeypatch.setattr(overlay, "EDGES", edges)
    monkeypatch.setattr(overlay, "PAIRS_AT_ONCE", 4 * rows)
    monkeypatch.setattr(overlay, "EDGES_AT_ONCE", rows)
    rnd = random.Random(8)
    box = lambda x, y, w: [(x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y)]
    shapes = [("a", [star(rnd, rnd.uniform(0, 900), rnd.uniform(0, 900), rnd.uniform(5, 200), rnd.randint(3, 9))]) for _ in range(20)]
    shapes += [("b", [box(-40_000, -30_000, 60_000), box(200, 200, 150)]), ("a", [box(440, 430, 3)]), (None, [box(0, 0, 900)]), ("c", [box(9e5, 9e5, 9)])]
    shapes += [shapes[0]] * 2 + [("b", shapes[0][1])]
    layer = spark.createDataFrame([(c, bytearray(wkb.encode_polygon(*rings))) for c, rings in shapes], "code string, geometry binary")
    at = [(k, rnd.uniform(0, 900), rnd.uniform(0, 900)) for k in range(12)]
    at += [(k + 100, *at[k][1:]) for k in range(12)] + [(200, None, None), (201, math.nan, 1.0), (202, -9e6, 3.0)]
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        found = variables.landuse(spark.createDataFrame(at, "id long, x double, y double"), to_polygons(layer, "code"), [90.0, 400.0], 2020).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    got = {(r.id, r.varname): r.value for r in found}
    assert len(found) == len(got) == len(at) * 3 * 2 * 2
    polygons = [(c, read(*rings)) for c, rings in shapes]
    for k, x, y in at:
        for r in (90.0, 400.0):
            around = buffer(x, y, r) if k < 100 else None
            for code in "abc":
                a, p = (got[k, f"LS{code}_{int(r):04d}_{v}"] for v in "ap")
                if k < 100:
                    assert abs(a - sum(s.intersection(around).getArea() for c, s in polygons if c == code)) < 1e-5
                    assert abs(p - a / around.getArea()) < 1e-12 and got[k + 100, f"LS{code}_{int(r):04d}_a"] == a
                elif k >= 200:
                    assert a == p == 0 or (k, code) == (202, "b")


def test_plots_and_points_listed_often_are_taken_once(spark, monkeypatch):
    """What grows with pairs sees every place and every geometry once, whatever codes it has."""
    seen, own = [], variables.overlay
    monkeypatch.setattr(variables, "overlay", lambda places, shapes, *more: seen.append((places.count(), shapes.count())) or own(places, shapes, *more))
    x, y = 1_000_000.0, 2_000_000.0
    plot = [bytearray(wkb.encode_polygon([(x + d, y), (x + d + 10, y), (x + d + 10, y + 10), (x + d, y + 10), (x + d, y)])) for d in (0, 50)]
    rows = [(110, plot[0]), (110, plot[0]), (120, plot[0]), (120, plot[1]), (None, plot[1])]
    c = Calculator(spark=spark, verbose=False).register_layer("landuse_2015", spark.createDataFrame(rows, "code int, geometry binary"))
    c.add_point_with_table(pd.DataFrame({"x": [x] * 4, "y": [y] * 4}), "x", "y", 5179).calculate_landuse_area_ratio(2015, [500])
    got = {(r.id, r.varname): r.value for r in c.result_df.where(F.col("varname").like("%_a")).collect()}
    assert got == pytest.approx({(k, n): v for k in (1, 2, 3, 4) for n, v in (("LS110_0500_a", 200.0), ("LS120_0500_a", 200.0))})
    assert seen == [(1, 2)]
