"""Queries over small tables of their own."""

import math

import pytest

import __spark_entry__ as entry
from geoloom.functions import wkb
from geoloom.queries import reference


def test_every_main_road_counts(spark, tmp_path):
    at = lambda key, p, q: (reference.X0 + key * p % 200_000, reference.Y0 + key * q % 200_000)
    x, y = at(1, 7919, 104729)
    near = [o for o in range(97, 60_000) if math.dist((x, y), at(o, 49979687, 67867967)) < 1500]
    once, twice = next(o for o in near if o % 10), next(o for o in near if o % 10 == 0)
    spark.createDataFrame([(1,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(once,), (twice,)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    length = lambda o: math.hypot(o % 401 - 200, o * 7 % 401 - 200)
    got = {r.varname: r.value for r in entry.queries()["main_road_llw_all"](spark, str(tmp_path)).collect()}
    assert got["MR1_L_2000"] == pytest.approx(length(once) + 2 * length(twice), abs=0.01)


def box(x, y, s):
    return bytearray(wkb.encode_polygon([(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]))


def test_layers_are_whole(spark, tmp_path):
    chunk = spark.createDataFrame([(1, bytearray(wkb.encode_point(0.0, 0.0)))], "id long, geometry binary")
    chunk.write.parquet(f"{tmp_path}/chunk.parquet")
    plots = [(k, year, code, box(-w, -w, 2 * w)) for k, (year, code, w) in enumerate([(2000, "110", 10.0), (2015, "110", 20.0), (2020, "120", 30.0), (2023, "110", 5.0)])]
    spark.createDataFrame([*plots, plots[0]], "landuse_id long, year int, code string, geometry binary").write.parquet(f"{tmp_path}/aoi_landuse.parquet")
    got = {(r.year, r.varname): round(r.value, 3) for r in entry.queries()["layer_landuse"](spark, str(tmp_path)).collect() if r.varname.endswith("_a")}
    assert got == {(2000, "LS110_0100_a"): 400.0, (2015, "LS110_0100_a"): 1600.0, (2020, "LS120_0100_a"): 3600.0, (2023, "LS110_0100_a"): 100.0}

    cells = [(k, kind, -15.0, -15.0, 15.0, 15.0, v) for k, kind, v in ((1, "dem", 7.0), (1, "dem", 7.0), (2, "dsm", 9.0))]
    spark.createDataFrame(cells, "cell_id long, elev_type string, xmin double, ymin double, xmax double, ymax double, value double").write.parquet(f"{tmp_path}/aoi_elevation.parquet")
    got = {r.varname: r.value for r in entry.queries()["layer_elevation"](spark, str(tmp_path)).collect()}
    assert got == {"Altitude_k": 7.0, "Altitude_a": 9.0}
