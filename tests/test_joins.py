"""Joins go through shuffles: sides whose rows are made by an explode look small to Spark, however many they are."""

import math
import random

from pyspark.sql import functions as F

from geoloom import engine
from geoloom.operators import spatial
from geoloom.operators.spatial import nearest
from geoloom.plans import variables
from geoloom.queries import interface, reference
from geoloom.session import cut_lineage


def broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin")


def layers(spark, n=60):
    rows = spark.range(n)
    points = rows.selectExpr("id", "id * 9000D % 40000 as x", "id * 7000D % 30000 as y")
    at = {"x1": "id * 811D % 40000", "y1": "id * 577D % 30000"}
    return points, rows.selectExpr("id as fid", "2020 as year", "2D as lanes", "3D as width", *[f"{e} as {c}" for c, e in at.items()], f"{at['x1']} + 300 as x2", f"{at['y1']} - 100 as y2")


def test_nearest_is_not_broadcast(spark):
    points, lines = layers(spark)
    assert broadcasts(nearest(points, lines, ["year"])) == 0


def test_search_starts_near_the_point(spark):
    """Points in, beside and far from features that lie close together, in groups of different extents."""
    rng = random.Random(4)
    lines = [(year, x := rng.uniform(0, w), y := rng.uniform(0, w), x + rng.uniform(-400, 400), y + rng.uniform(-400, 400)) for year, w in ((2000, 900.0), (2005, 60_000.0)) for _ in range(150)]
    at = [(k, rng.uniform(-w, 2 * w), rng.uniform(-w, 2 * w)) for k, w in enumerate([500.0, 60_000.0, 3e6] * 20)] + [(99, 1e15, -1e15)]
    got = {(r.id, r.year): r.distance for r in nearest(spark.createDataFrame(at, "id long, x double, y double"), spark.createDataFrame(lines, "year int, x1 double, y1 double, x2 double, y2 double"), ["year"]).collect()}

    def distance(px, py, x1, y1, x2, y2):
        t = min(1, max(0, ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2)))
        return math.hypot(x1 + t * (x2 - x1) - px, y1 + t * (y2 - y1) - py)

    want = {(k, year): min(distance(x, y, *s[1:]) for s in lines if s[0] == year) for k, x, y in at for year in (2000, 2005)}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-6) for k in want)


def test_line_lengths_are_not_broadcast(spark):
    points, lines = layers(spark)
    assert broadcasts(variables.line_lengths(points, lines, [500.0, 2000.0], [2020], "Road")) == 0


def test_landuse_is_not_broadcast(spark):
    points, lines = layers(spark)
    corners = {"xmin": "x1", "ymin": "y2", "xmax": "x2", "ymax": "y1"}
    edges = F.array(*[F.struct(*[F.col(c).alias(n) for c, n in zip(e, ("x1", "y1", "x2", "y2"))]) for e in (("xmin", "ymin", "xmax", "ymin"), ("xmax", "ymin", "xmax", "ymax"), ("xmax", "ymax", "xmin", "ymax"), ("xmin", "ymax", "xmin", "ymin"))])
    plots = lines.selectExpr("fid", "'110' as code", *[f"{e} as {n}" for n, e in corners.items()]).withColumn("edges", edges)
    assert broadcasts(variables.landuse(points, plots, [1000.0], 2020)) == 0


def test_long_lines_far_apart_are_cut_into_few_pieces(spark):
    lines = spark.range(50).selectExpr("2020 as year", "id * 8110D % 400000 as x1", "id * 57700D % 300000 as y1").selectExpr("*", "x1 + 6000 as x2", "y1 - 4000 as y2")
    side = spatial._search_side(lines, ["year"])
    assert spatial._pieces(lines, ["year"], side).count() <= 3 * 50 < spatial._pieces(lines, ["year"], spatial.CELL).count()


def test_search_among_long_lines_and_a_crowd(spark):
    """Long lines all over, with a crowd of short ones in one place: wide cells at first, narrow ones where they are too full."""
    rng = random.Random(5)
    lines = [(x := rng.uniform(0, 3e5), y := rng.uniform(0, 3e5), x + rng.uniform(-9e3, 9e3), y + rng.uniform(-9e3, 9e3)) for _ in range(60)]
    lines += [(x := rng.uniform(1e5, 1.01e5), y := rng.uniform(1e5, 1.01e5), x + rng.uniform(-40, 40), y + rng.uniform(-40, 40)) for _ in range(300)]
    at = [(k, rng.uniform(0, 3e5), rng.uniform(0, 3e5)) for k in range(30)] + [(100 + k, rng.uniform(9.9e4, 1.02e5), rng.uniform(9.9e4, 1.02e5)) for k in range(30)]
    shown = spark.createDataFrame(lines, "x1 double, y1 double, x2 double, y2 double")
    assert spatial._search_side(shown, []) > spatial.CELL
    got = {r.id: r.distance for r in nearest(spark.createDataFrame(at, "id long, x double, y double"), shown).collect()}

    def distance(px, py, x1, y1, x2, y2):
        t = min(1, max(0, ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2)))
        return math.hypot(x1 + t * (x2 - x1) - px, y1 + t * (y2 - y1) - py)

    want = {k: min(distance(x, y, *s) for s in lines) for k, x, y in at}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-6) for k in want)


def test_a_cut_collects_the_drivers_garbage(spark):
    collected = lambda: sum(b.getCollectionCount() for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = collected()
    cut_lineage(spark.range(3))
    assert collected() > before


def test_chosen_roads_are_not_broadcast(spark):
    assert [broadcasts(f(spark, "/root/testdata/sf0.001")) for f in (reference.main_road_llw, reference.main_road_llw_all)] == [0, 0]


def test_buffers_look_up_only_cells_near_lines(spark):
    at = spark.createDataFrame([(1, 0.0, 0.0, 2000.0, 3), (2, 9e5, 0.0, 2000.0, 3)], "id long, x double, y double, r double, level int")
    blocks = spark.createDataFrame([(3, 0, 0), (3, -1, 0)], "level int, bx long, by long")
    cells = variables._buffer_cells(at, blocks).collect()
    assert {c.id for c in cells} == {1} and {(c.cx >> 3, c.cy >> 3) for c in cells} == {(0, 0), (-1, 0)}


def test_lines_listed_often_count_as_often_and_are_kept_once(spark):
    points, lines = layers(spark)
    value = lambda df: {(r.id, r.varname): r.value for r in variables.line_lengths(points, df, [500.0, 2000.0], [2020], "Road").collect()}
    once, often = value(lines), value(lines.unionByName(lines).unionByName(lines))
    assert any(once.values()) and all(math.isclose(often[k], 3 * once[k], rel_tol=1e-9) for k in once)
    plan = variables.line_lengths(points, lines, [500.0], [2020], "Road")._jdf.queryExecution().optimizedPlan().toString()
    assert "AS times#" in plan


def test_named_main_roads_are_not_broadcast(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(engine, "cut_lineage", lambda df: seen.append(broadcasts(df)) or df)
    interface.calc_main_road_llw(spark, "/root/testdata/sf0.001")
    assert seen == [0, 0]


def test_lines_and_points_listed_often_are_kept_once(spark, monkeypatch):
    points, lines = layers(spark)
    kept = []
    monkeypatch.setattr(spatial, "cut_lineage", lambda df: kept.append(cut_lineage(df)) or kept[-1])
    found = lambda p, s: sorted((r.id, round(r.distance, 9)) for r in nearest(p, s, ["year"]).collect())
    once = found(points, lines)
    sizes, kept[:] = [df.count() for df in kept], []
    often = found(points.unionByName(points.withColumn("id", F.col("id") + 1000)), lines.unionByName(lines).unionByName(lines))
    assert often == once + [(k + 1000, d) for k, d in once] and [df.count() for df in kept] == sizes


def test_areas_listed_often_are_looked_up_once(spark, monkeypatch):
    corners = [(0.0, 0.0), (900.0, 0.0), (900.0, 500.0), (0.0, 500.0)]
    edges = [(fid, 2020, *a, *b, True) for fid in range(5) for a, b in zip(corners, corners[1:] + corners[:1])]
    segments = spark.createDataFrame(edges, "fid long, year int, x1 double, y1 double, x2 double, y2 double, is_area boolean")
    points = spark.createDataFrame([(1, 300.0, 200.0), (2, 300.0, 200.0), (3, 1000.0, 200.0), (4, None, 1.0)], "id long, x double, y double")
    seen, own = [], variables.box_join
    monkeypatch.setattr(variables, "box_join", lambda left, right: seen.append((left.count(), right.count())) or own(left, right))
    assert {(r.id, r.value) for r in variables.distance(points, segments, "D_River").collect()} == {(1, 0.0), (2, 0.0), (3, 100.0)}
    assert seen == [(2, 1)]


def test_buffers_at_the_same_place_are_looked_up_once(spark, monkeypatch):
    points, lines = layers(spark)
    seen, own = [], variables.buffers
    monkeypatch.setattr(variables, "buffers", lambda p, sizes: seen.append(p.count()) or own(p, sizes))
    value = lambda p: {(r.id, r.varname): r.value for r in variables.line_lengths(p, lines, [500.0, 2000.0], [2015, 2020], "Road").collect()}
    once, twice = value(points), value(points.unionByName(points.withColumn("id", F.col("id") + 1000)))
    assert seen == [points.count()] * 2 and any(once.values())
    assert twice == once | {(k + 1000, n): v for (k, n), v in once.items()}
