"""Decoding, projections and kernels; the kernels against an independent geometry library in Spark's own jars."""

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.functions import kernels as K
from geoloom.functions import projection, wkb
from geoloom.operators.prepare import simplify, to_polygons, to_segments


def big_endian_polygon(ring):
    return struct.pack(">BIII", 0, 3, 1, len(ring)) + b"".join(struct.pack(">2d", *p) for p in ring)


RING = [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 0.0)]


def test_dialects():
    assert wkb.parts(None) == [] and wkb.parts(b"") == []
    assert np.array_equal(wkb.parts(big_endian_polygon(RING))[0][1][0], RING)
    srid = struct.pack("<BII2d", 1, 0x20000001, 5179, 1.0, 2.0)
    assert np.array_equal(wkb.parts(srid)[0][1][0], [(1.0, 2.0)])
    for code in (1001, 0x80000001):
        assert np.array_equal(wkb.parts(struct.pack("<BI3d", 1, code, 1.0, 2.0, 9.0))[0][1][0], [(1.0, 2.0)])
    assert np.array_equal(wkb.parts(struct.pack("<BI4d", 1, 3001, 1, 2, 8, 9))[0][1][0], [(1.0, 2.0)])
    assert wkb.parts(struct.pack("<BI2d", 1, 1, math.nan, math.nan)) == []
    assert wkb.parts(struct.pack("<BII", 1, 3, 0)) == []
    multi = struct.pack("<BII", 1, 6, 2) + wkb.encode_polygon(RING) + big_endian_polygon(RING)
    assert [b for b, _ in wkb.parts(multi)] == [wkb.POLYGON] * 2
    with pytest.raises(ValueError):
        wkb.parts(struct.pack("<BI", 1, 99))


def test_simplify():
    v = np.array([(0, 0), (1, 0.5), (2, 0), (3, 5), (4, 0)], float)
    assert simplify(v, 1.0).tolist() == [[0, 0], [2, 0], [3, 5], [4, 0]]


def test_projection(spark):
    rows = [(127.5, 38.0), (126.0, 33.2), (131.9, 37.3), (124.1, 38.9)]
    df = spark.createDataFrame(rows, "lon double, lat double")
    for epsg in (5179, 5186, 32652, 3857, 4326):
        x, y = projection.project(F.col("lon"), F.col("lat"), epsg)
        lon, lat = projection.unproject(F.col("x"), F.col("y"), epsg)
        back = df.select(x.alias("x"), y.alias("y"), "lon", "lat").select(lon - F.col("lon"), lat - F.col("lat"), "x", "y").collect()
        assert max(abs(v) for r in back for v in r[:2]) < 1e-9
        if epsg == 5179:
            assert abs(back[0][2] - 1_000_000) < 1e-6 and abs(back[0][3] - 2_000_000) < 1e-6
    with pytest.raises(ValueError):
        projection.project(F.col("lon"), F.col("lat"), 5174)


def star(rnd, cx, cy, r, n):
    turns = [(k + rnd.uniform(0, 0.9)) * 2 * math.pi / n for k in range(n)]
    far = [rnd.uniform(0.3, 1) * r for _ in turns]
    ring = [(cx + f * math.cos(t), cy + f * math.sin(t)) for f, t in zip(far, turns)]
    return [*ring, ring[0]]


def test_kernels_against_library(spark):
    jts = spark._jvm.org.locationtech.jts
    reader, origin = jts.io.WKBReader(), jts.geom.GeometryFactory().createPoint(jts.geom.Coordinate(0.0, 0.0))
    rnd = random.Random(3)
    rows = []
    for i in range(60):
        ring = star(rnd, rnd.uniform(-150, 150), rnd.uniform(-150, 150), rnd.uniform(5, 300), rnd.randint(5, 11))
        r = rnd.choice([50.0, 100.0])
        rows.append((i, r, bytearray(wkb.encode_polygon(ring)), reader.read(bytearray(wkb.encode_polygon(ring)))))
    layer = spark.createDataFrame([(i, r, g) for i, r, g, _ in rows], "no int, r double, geometry binary")
    own = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    edges = to_polygons(layer, "no", "r").select("no", "r", F.explode("edges").alias("e")).select("no", "r", "e.*")
    enter, leave = K.clip(*own, F.col("r"))
    got = edges.groupBy("no").agg(
        F.sum(K.clipped_length(*own, F.col("r"))).alias("length"), F.min(K.segment_distance(*own)).alias("d"),
        F.max(enter <= leave).alias("hits"), F.sum(K.ray_crossing(*own).cast("int")).alias("n"),
    ).join(K.with_wedge_area(edges).groupBy("no").agg(F.sum("area").alias("area")), "no")
    for r in got.collect():
        _, size, _, polygon = rows[r.no]
        buffer = origin.buffer(size)
        assert abs(r.area - polygon.intersection(buffer).getArea()) < 1e-6
        assert abs(r.length - polygon.getExteriorRing().intersection(buffer).getLength()) < 1e-6
        assert abs(r.d - polygon.getExteriorRing().distance(origin)) < 1e-9
        assert (r.hits or r.n % 2 == 1) == polygon.intersects(buffer)


def test_ring_against_library(spark):
    jts = spark._jvm.org.locationtech.jts
    factory = jts.geom.GeometryFactory()
    origin = factory.createPoint(jts.geom.Coordinate(0.0, 0.0))
    ring = origin.buffer(130.0).difference(origin.buffer(100.0))
    rnd = random.Random(4)
    boxes = [(i, x, y, x + 30, y + 30) for i, (x, y) in enumerate((rnd.uniform(-170, 140), rnd.uniform(-170, 140)) for _ in range(300))]
    df = spark.createDataFrame(boxes, "i int, a double, b double, c double, d double")
    meets = K.box_meets_ring(F.col("a"), F.col("b"), F.col("c"), F.col("d"), F.lit(100.0), F.lit(130.0))
    for r in df.withColumn("m", meets).collect():
        envelope = factory.toGeometry(jts.geom.Envelope(r.a, r.c, r.b, r.d))
        assert r.m == ring.intersects(envelope)


def test_segments(spark):
    rows = [(1, bytearray(wkb.encode_line([(0, 0), (3, 4), (3, 9)]))), (2, None), (3, bytearray(wkb.encode_point(1, 2)))]
    got = to_segments(spark.createDataFrame(rows, "year int, geometry binary"), "year").drop("fid").collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, 0, 3, 4, False), (1, 3, 4, 3, 9, False), (3, 1, 2, 1, 2, False)]
    assert to_segments(spark.createDataFrame([], "year int, geometry binary"), "year").count() == 0


def test_geometries_of_one_layout_are_decoded_together():
    hole = [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 1.0)]
    multi = lambda order: struct.pack(f"{'<' if order else '>'}BII", order, 6, 2) + wkb.encode_polygon(RING, hole) + big_endian_polygon(RING)
    odd = [None, b"", struct.pack("<BI2d", 1, 1, math.nan, math.nan), struct.pack("<BII", 1, 3, 0), struct.pack("<BI3d", 1, 1001, 1.0, 2.0, 9.0), multi(0), wkb.encode_polygon(RING, [])]
    many = [wkb.encode_line([(k, 1.0), (k + 2.0, k)]) for k in range(9)] + [multi(1)] * 3 + odd + [big_endian_polygon([(k, k), (k, 2.0), (3.0, k), (k, k)]) for k in range(4)]
    found = list(wkb.alike(many))
    assert max(len(rows) for rows, _ in found) == 9
    got = {int(i): [(base, [v[k].tolist() for v in rings]) for base, rings in shape] for rows, shape in found for k, i in enumerate(rows)}
    assert got == {i: [(base, [v.tolist() for v in rings]) for base, rings in own] for i, g in enumerate(many) if (own := wkb.parts(g))}
