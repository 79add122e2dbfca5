import math
import random
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from geoloom.functions import wkb
from geoloom.operators import chunking
from geoloom.operators.fill import Categorical, Numeric, fill_missing, filled_cells
from geoloom.operators.locate import _batches_of, containing, distinct_points, pairs_within
from geoloom.operators.spatial import box_join, buffers, nearest, row_ids
from geoloom.operators.wide import attribute_key, to_wide, unresolved_cells

CATALOGUE = [("D_Road_0100", "double"), ("N_Bus", "int"), ("On_Bridge", "boolean"), ("year", "double")]
ROWS = "id long, varname string, year int, value double, id_ string, unresolved int"


def wide_of(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], ROWS)
    return to_wide(df, spark.createDataFrame(CATALOGUE, "varname string, value_type string"))


def test_attribute_key(spark):
    names = ["D_Road_0100", " d-road_100\t", "D_ROAD_00100", "D_Road_1000", "A0_0", None]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(attribute_key(F.col("n"))).collect()]
    assert got[0] == got[1] == got[2] == "d_road_100" and got[3] == "d_road_1000" and got[4] == "a0_0" and got[5] is None


def test_wide(spark):
    nan = math.nan
    rows = [
        (1, "d-road_100", 2000, 5.0), (1, "D_Road_0100", 2000, 5.0005), (1, "N_Bus", 2000, 3.0), (1, "On_Bridge", 2000, 1.0), (1, "year", 2000, 7.5),
        (1, "N_Bus", None, 2.5), (2, "N_Bus", 2000, 1.0), (2, "n_bus", 2000, 2.0), (2, "On_Bridge", 2000, 2.0), (2, "D_Road_0100", 2000, nan),
        (3, "D_Road_0100", 2005, None), (4, "other", 2005, 1.0), (5, None, 2005, 1.0), (None, "N_Bus", 2000, 1.0), (6, "N_Bus", 2000, 1e300), (6, "D_Road_0100", 2000, 1e300),
    ]
    w = wide_of(spark, rows)
    assert w.columns == ["id", "year", "D_Road_0100", "N_Bus", "On_Bridge", "year_", "unresolved"]
    assert dict(w.dtypes)["N_Bus"] == "bigint" and dict(w.dtypes)["On_Bridge"] == "boolean"
    got = {(r[0], r[1]): tuple(r)[2:] for r in w.collect()}
    assert got[1, 2000] == (5.0, 3, True, 7.5, [])
    assert got[1, None] == (None, None, None, None, ["N_Bus"])
    assert got[2, 2000] == (None, None, None, None, ["N_Bus", "On_Bridge"])
    assert got[3, 2005] == got[4, 2005] == got[5, 2005] == (None, None, None, None, [])
    assert got[6, 2000] == (1e300, None, None, None, ["N_Bus"])
    assert len(got) == 7
    assert (1, "N_Bus", 0) in {tuple(r) for r in unresolved_cells(w).collect()}
    assert wide_of(spark, []).count() == 0
    many = [("a", "double")] * 5001 + [("b", "int")]
    assert to_wide(spark.createDataFrame([(1, "b", 1, 2.0, "", 1)], ROWS), spark.createDataFrame(many, "varname string, value_type string")).columns == ["id", "year", "a", "b", "unresolved"]
    with pytest.raises(ValueError, match="two types"):
        wide_of_two = spark.createDataFrame([("a", "int"), ("a", "double")], "varname string, value_type string")
        to_wide(spark.createDataFrame([(1, "a", 1, 2.0, "", 1)], ROWS), wide_of_two)
    wide = [(f"v{k:03d}", "double") for k in range(200)]  # several words of the mask
    got = to_wide(spark.createDataFrame([(1, f"v{k:03d}", 1, float(k), "", 1) for k in (0, 61, 62, 63, 124, 199)], ROWS), spark.createDataFrame(wide, "varname string, value_type string")).first()
    assert {k: got[f"v{k:03d}"] for k in range(200) if got[f"v{k:03d}"] is not None} == {k: float(k) for k in (0, 61, 62, 63, 124, 199)}
    empty = to_wide(spark.createDataFrame([(1, "a", 1, 1.0, "", 1)], ROWS), spark.createDataFrame([], "varname string, value_type string"))
    assert [tuple(r) for r in empty.collect()] == [(1, 1, [])]


def test_fill_accuracy_and_marks(spark):
    rnd = random.Random(1)
    rows, truth = [], {}
    for i in range(3000):
        route, year = rnd.randint(0, 39), rnd.choice([2005, 2010, 2015])
        width = 5 + route % 7 + (year - 2005) * 0.1 + rnd.gauss(0, 0.3)
        lanes = 1 + route % 4
        truth[i] = (width, lanes)
        hide = i % 5 == 0
        rows.append((i, f"R{route}", "abc"[route % 3], year, [None, math.nan, -99.0, 0.0][i // 5 % 4] if hide else width, 0.0 if hide else float(lanes), "kept"))
    rows.append((5000, None, None, None, None, None, "kept"))
    df = spark.createDataFrame(rows, "id long, route string, kind string, year int, width double, lanes double, value string")
    fields = [Categorical("lanes", 1, 16), Numeric("width", 1.5, 80.0)]
    out = fill_missing(df, fields, [["kind"], ["kind", "route"]], time="year")
    got = {r.id: r for r in out.collect()}
    assert len(got) == 3001 and got[1].value == "kept"
    filled = [i for i in truth if got[i].width_filled]
    assert filled == [i for i in truth if i % 5 == 0] and all(got[i].width_value == truth[i][0] for i in truth if i % 5)
    assert np.mean([abs(got[i].width_value - truth[i][0]) for i in filled]) < 0.35
    assert np.mean([got[i].lanes_value == truth[i][1] for i in filled]) > 0.99
    assert got[5000].width_filled and 1.5 <= got[5000].width_value <= 80 and 1 <= got[5000].lanes_value <= 16
    cells = filled_cells(out, "id", ["lanes", "width"], "t")
    assert cells.count() == 2 * (len(filled) + 1) and cells.columns == ["tbl", "row_id", "field"]


def test_rarely_seen_groups_fall_back(spark):
    rows = [(i, "a", f"r{i % 7}", 2000 + i % 2, 10.0 + i % 7, 300 if i % 7 < 4 else 301) for i in range(200)]
    rows += [(900, "a", "new", 2000, None, None), (901, "a", None, None, None, None), (902, None, "r1", 2000, None, None), (903, "a", "r2", 2001, None, None)]
    df = spark.createDataFrame(rows, "id long, kind string, route string, year int, v double, k int")
    out = {r.id: r for r in fill_missing(df, [Numeric("v", 0, 99), Categorical("k", 0, 400)], [["kind"], ["route"]], time="year").collect()}
    assert abs(out[903].v_value - 12) < 0.2 and out[903].k_value == 300  # more classes than any group has seen
    assert all(12 < out[i].v_value < 14 for i in (900, 901, 902)) and len(out) == 204


def test_fill_without_data(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, math.nan)], "id long, g string, v double")
    out = fill_missing(df, [Numeric("v", 0, 1)], [["g"]]).collect()
    assert [(r.v_value, r.v_filled) for r in sorted(out)] == [(None, True)] * 2
    assert fill_missing(df.limit(0), [Categorical("v", 1, 3)], [["g"]]).count() == 0
    with pytest.raises(ValueError):
        fill_missing(df.withColumn("V_filled", F.lit(1)), [Numeric("v", 0, 1)], [["g"]])


def square(x, y, s):
    return [(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]


def locate(spark, polygons, points):
    df = spark.createDataFrame([(r, bytearray(g) if g is not None else None) for r, g in polygons], "ref string, geometry binary")
    pts = spark.createDataFrame(points, "id long, x double, y double")
    return {tuple(r) for r in containing(pts, df).collect()}


def test_containing_cases(spark):
    holed = wkb.encode_polygon(square(0, 0, 10), square(3, 3, 4))
    two = struct.pack("<BII", 1, 6, 2) + wkb.encode_polygon(square(100, 0, 10)) + wkb.encode_polygon(square(200, 0, 10))
    polygons = [("h", holed), ("h", holed), ("m", two), ("big", wkb.encode_polygon(square(-5000, -5000, 1e6))), (None, holed), ("n", None), ("e", struct.pack("<BII", 1, 3, 0))]
    points = [(1, 1.0, 1.0), (2, 5.0, 5.0), (3, 10.0, 4.0), (4, 0.0, 0.0), (5, 105.0, 5.0), (6, 205.0, 10.0), (7, 150.0, 5.0), (8, 10.5, 4.0)]
    got = locate(spark, polygons, points)
    assert {r for r in got if r[1] != "big"} == {(1, "h"), (3, "h"), (4, "h"), (5, "m"), (6, "m")}
    assert {i for i, r in got if r == "big"} == set(range(1, 9))
    assert locate(spark, [], points) == set() and locate(spark, polygons, []) == set()


def test_containing_against_brute_force(spark):
    rnd = random.Random(5)
    polygons, points = [], [(i, rnd.uniform(0, 2000), rnd.uniform(0, 2000)) for i in range(400)]
    for k in range(80):
        cx, cy, r, n = rnd.uniform(0, 2000), rnd.uniform(0, 2000), rnd.choice([20, 100, 900]), rnd.randint(3, 12)
        turns = sorted(rnd.uniform(0, 6.28) for _ in range(n))
        ring = [(cx + rnd.uniform(0.2, 1) * r * math.cos(t), cy + rnd.uniform(0.2, 1) * r * math.sin(t)) for t in turns]
        polygons.append((str(k), [*ring, ring[0]]))
    polygons.append(("bow", [(0.0, 0.0), (2000.0, 1500.0), (2000.0, 0.0), (0.0, 1900.0), (0.0, 0.0)]))  # crosses itself
    want = set()
    for ref, ring in polygons:
        for i, x, y in points:
            odd = sum(((a[1] > y) != (b[1] > y)) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(ring, ring[1:])) % 2
            if odd:
                want.add((i, ref))
    assert locate(spark, [(k, wkb.encode_polygon(r)) for k, r in polygons], points) == want


def test_slabs_stay_small():
    turns = np.linspace(0, 2 * math.pi, 8001)[:-1]
    reach = 6500 + 50 * np.sin(40 * turns)
    ring = np.column_stack([reach * np.cos(turns), reach * np.sin(turns)])
    geometry = pa.array([wkb.encode_polygon([*ring, ring[0]])], pa.binary())
    slabs = pa.Table.from_batches(_batches_of(pa.array(["r"]), geometry, 1e-6)).to_pylist()
    edges = [len(r["ax"]) for r in slabs]
    assert max(edges) <= 16 and sum(edges) < 10 * len(ring) and len(slabs) < 4 * len(ring)
    wide = [r["level"] for r in slabs if r["ax"]]
    assert sum(w > 3 for w in wide) < len(wide) / 50  # cells that edges enter are small, but for those barely entered


def test_points(spark):
    rows = [(1, wkb.encode_point(0, 0)), (1, wkb.encode_point(0, 0)), (2, wkb.encode_point(15, 20)), (3, wkb.encode_point(0, 0)), (4, None), (5, wkb.encode_point(math.nan, math.nan)), (None, wkb.encode_point(0, 0)), (6, wkb.encode_point(40, 20.5))]
    df = spark.createDataFrame([(i, bytearray(g) if g else None, "c") for i, g in rows], "id long, geometry binary, x string")
    pts = distinct_points(df)
    assert {r[0] for r in pts.collect()} == {1, 2, 3, 6}
    assert {tuple(r) for r in pairs_within(pts, 25.0).collect()} == {(1, 2), (1, 3), (2, 3)}
    assert pairs_within(pts.limit(0), 25.0).count() == 0


def test_box_join_and_nearest(spark):
    rnd = random.Random(7)
    pts = [(i, rnd.uniform(0, 5e4), rnd.uniform(0, 5e4)) for i in range(60)]
    segs = []
    for k in range(150):
        x, y, r = rnd.uniform(0, 5e4), rnd.uniform(0, 5e4), rnd.choice([0, 50, 3000, 20000])
        segs.append((2000 + k % 2, x, y, x + rnd.uniform(-r, r), y + rnd.uniform(-r, r)))
    p = spark.createDataFrame(pts, "id long, x double, y double")
    s = spark.createDataFrame(segs, "year int, x1 double, y1 double, x2 double, y2 double")

    def away(x, y, a):
        d = (a[3] - a[1], a[4] - a[2])
        l2 = d[0] ** 2 + d[1] ** 2
        t = min(1, max(0, ((x - a[1]) * d[0] + (y - a[2]) * d[1]) / l2)) if l2 else 0
        return math.hypot(a[1] + t * d[0] - x, a[2] + t * d[1] - y)

    got = {(r.id, r.year): r.distance for r in nearest(p, s, ["year"]).collect()}
    assert len(got) == 120
    for i, x, y in pts:
        for year in (2000, 2001):
            assert abs(got[i, year] - min(away(x, y, a) for a in segs if a[0] == year)) < 1e-6
    assert nearest(p, s.limit(0), ["year"]).count() == 0
    # One far feature, a crowd of features in one cell, and points without coordinates.
    crowd = [(2000, 100 + k * 0.01, 5.0, 100 + k * 0.01, 5.0) for k in range(3000)] + [(2001, 9e6, 0.0, 9e6, 1.0)] * 2
    odd = spark.createDataFrame([(1, 0.0, 5.0), (2, -8e6, 5.0), (3, None, 1.0), (4, math.nan, 1.0), (5, 110.004, 5.0)], "id long, x double, y double")
    found = {(r.id, r.year): round(r.distance, 3) for r in nearest(odd, spark.createDataFrame(crowd, s.schema), ["year"]).collect()}
    assert found == {(1, 2000): 100.0, (2, 2000): 8000100.0, (5, 2000): 0.004, (1, 2001): 9000000.0, (2, 2001): 17000000.0, (5, 2001): 8999889.996}

    boxed = s.withColumns({f"r{a}{k}": f(f"{a}1", f"{a}2") for a in "xy" for k, f in ((0, F.least), (1, F.greatest))})
    pairs = box_join(buffers(p, [100.0, 4000.0]), boxed).count()
    want = sum(
        min(a[1], a[3]) <= x + r and max(a[1], a[3]) >= x - r and min(a[2], a[4]) <= y + r and max(a[2], a[4]) >= y - r
        for _, x, y in pts for r in (100, 4000) for a in segs
    )
    assert pairs == want and box_join(buffers(p, [1.0]), boxed.limit(0)).count() == 0


def test_numbers_and_chunks(spark):
    df = spark.range(1000, numPartitions=7).withColumn("x", F.rand(1) * 1e4).withColumn("y", F.rand(2) * 1e4)
    numbered = row_ids(df.drop("id").withColumn("k", F.monotonically_increasing_id()))
    rows = numbered.orderBy("k").collect()
    assert [r.id for r in rows] == list(range(1, 1001))
    pts = df.withColumn("id", F.col("id") + 1)
    for chunks, size in ((chunking.by_order(pts, 30), 30), (chunking.by_hilbert(pts, 30), 30), (chunking.by_closeness(pts, 4, 800), 4)):
        assert chunks.count() == 1000 and chunks.groupBy("chunk_id").count().agg(F.max("count")).first()[0] <= size
    wide = chunking.by_closeness(pts, 4, 800).groupBy("chunk_id").agg(F.hypot(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("w"))
    assert wide.agg(F.max("w")).first()[0] <= 800
